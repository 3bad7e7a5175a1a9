"""Unified diffs: changed lines, and what they say about review threads and findings."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed format of a hunk's first line: old and new start and count, section.
HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?(.*)$", re.M)
CHANGES = (
    "deleted array<int>, inserted_after array<int>, new_ranges array<struct<start:int,end:int>>, "
    "added array<string>, removed array<string>, sections array<string>"
)
HUNKS = (
    "array<struct<number:int,old_start:int,old_count:int,new_start:int,new_count:int,section:string,"
    "inserted_after:array<int>,lines:array<struct<tag:string,old:int,new:int,text:string>>>>"
)


class Patches:
    """The hunks of a batch of patches and their lines, each kind of value as one array over all patches.

    A line belongs to a patch's last hunk before it and is removed, added or unchanged (`-`, `+` or a blank; others don't
    count). Its number in the old file is the hunk's start and the old lines of the hunk before it, in the new file alike.
    """

    def __init__(self, patches: pa.Array) -> None:
        lines, counts = [], []
        for patch in patches.to_pylist():
            found = (patch or "").splitlines()
            lines += found
            counts.append(len(found))
        self.size, row = len(counts), np.repeat(np.arange(len(counts)), counts)
        text = pa.array(lines, pa.string())
        ends = np.frombuffer(text.buffers()[1], np.int32)[: len(lines) + 1] if lines else np.zeros(1, np.int32)
        signs, full = np.full(len(lines), ord(" "), np.uint8), ends[1:] > ends[:-1]
        if full.any():
            signs[full] = np.frombuffer(text.buffers()[2], np.uint8)[ends[:-1][full]]
        heads = [(i, head) for i in np.flatnonzero(signs == ord("@")).tolist() if (head := HUNK.match(lines[i]))]
        at = np.array([i for i, _ in heads], np.int64)
        starts = np.array([[1 if x is None else int(x) for x in head.groups()[:4]] for _, head in heads], np.int64).reshape(-1, 4)
        self.old_start, self.old_count, self.new_start, self.new_count = starts.T
        self.sections = [head[5].strip() for _, head in heads]
        self.hunk_row = row[at]
        hunk = np.searchsorted(at, np.arange(len(lines)), "right") - 1
        own = (hunk >= 0) & np.isin(signs, [ord(x) for x in "+- "])
        own[own] = self.hunk_row[hunk[own]] == row[own]
        place = np.flatnonzero(own)
        self.hunk, self.sign = hunk[place], signs[place]
        self.text = pc.utf8_slice_codeunits(text.take(pa.array(place)), 1)
        self.begin = np.searchsorted(self.hunk, np.arange(len(at) + 1))
        # an empty side is named by the line before it
        self.old = self._number(self.sign != ord("+"), self.old_start + (self.old_count == 0))
        self.new = self._number(self.sign != ord("-"), self.new_start + (self.new_count == 0))
        before = np.r_[np.uint8(ord(" ")), self.sign[:-1]][: len(self.sign)]
        before[self.begin[:-1][self.begin[:-1] < len(before)]] = ord(" ")
        #: added lines that begin to be put in after an old line without replacing it
        self.puts_in = (self.sign == ord("+")) & (before == ord(" "))

    def _number(self, counts: np.ndarray, start: np.ndarray) -> np.ndarray:
        upto = np.r_[0, np.cumsum(counts)]
        return start[self.hunk] + upto[:-1] - upto[self.begin[self.hunk]]

    def is_(self, sign: str) -> np.ndarray:
        return self.sign == ord(sign)

    def lists(self, owner: np.ndarray, owners: int, values: pa.Array) -> pa.Array:
        """For each of so many owners the list of its values, whose owners ascend."""
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(owners + 1)), pa.int32()), values)

    def by_patch(self, which: np.ndarray, values: pa.Array) -> pa.Array:
        return self.lists(self.hunk_row[self.hunk[which]], self.size, values.filter(pa.array(which)))

    def by_hunk(self, which: np.ndarray, values: pa.Array) -> pa.Array:
        return self.lists(self.hunk[which], len(self.sections), values.filter(pa.array(which)))

    def of_hunks(self, **columns: pa.Array | np.ndarray) -> pa.Array:
        """For each patch the list of its hunks, as structs of these columns."""
        arrays = [x if isinstance(x, pa.Array) else pa.array(x, pa.int32()) for x in columns.values()]
        return self.lists(self.hunk_row, self.size, pa.StructArray.from_arrays(arrays, list(columns)))


def _hunks(patches: pa.Array) -> pa.Array:
    p = Patches(patches)
    number = np.arange(len(p.sections)) - np.searchsorted(p.hunk_row, p.hunk_row) + 1
    every = np.ones(len(p.sign), bool)
    tags = pa.array([" ", "+", "-"]).take(pa.array(p.is_("+") + 2 * p.is_("-")))
    old, new = pa.array(p.old, pa.int32(), mask=p.is_("+")), pa.array(p.new, pa.int32(), mask=p.is_("-"))
    lines = pa.StructArray.from_arrays([tags, old, new, p.text], ["tag", "old", "new", "text"])
    return p.of_hunks(
        number=number, old_start=p.old_start, old_count=p.old_count, new_start=p.new_start, new_count=p.new_count, section=pa.array(p.sections, pa.string()),
        inserted_after=p.by_hunk(p.puts_in, pa.array(p.old - 1, pa.int32())), lines=p.by_hunk(every, lines),
    )


def _changes(patches: pa.Array) -> pa.Array:
    p = Patches(patches)
    begins = p.new_start + (p.new_count == 0)
    old = pa.array(p.old, pa.int32())
    return pa.StructArray.from_arrays(
        [
            p.by_patch(p.is_("-"), old), p.by_patch(p.puts_in, pa.array(p.old - 1, pa.int32())), p.of_hunks(start=begins, end=np.maximum(begins, begins + p.new_count - 1)),
            p.by_patch(p.is_("+"), p.text), p.by_patch(p.is_("-"), p.text), p.lists(p.hunk_row, p.size, pa.array(p.sections, pa.string())),
        ],
        ["deleted", "inserted_after", "new_ranges", "added", "removed", "sections"],
    )


def _added(patches: pa.Array) -> pa.Array:
    p = Patches(patches)
    return p.by_patch(p.is_("+"), pa.StructArray.from_arrays([pa.array(p.new, pa.int32()), p.text], ["line", "text"]))


def _removals(patches: pa.Array) -> pa.Array:
    p = Patches(patches)
    number = np.arange(len(p.sections)) - np.searchsorted(p.hunk_row, p.hunk_row) + 1
    return p.of_hunks(number=number, old_start=p.old_start, old_count=p.old_count, removed=np.bincount(p.hunk[p.is_("-")], minlength=len(p.sections)))


def _changed_text(patches: pa.Array) -> pa.Array:
    p = Patches(patches)
    return p.of_hunks(section=pa.array(p.sections, pa.string()), lines=p.by_hunk(~p.is_(" "), p.text))


def changes_of(patch: str | None) -> tuple:
    """Old lines deleted or replaced, old lines after which lines are inserted, new ranges, added and removed lines, sections."""
    return tuple(_changes(pa.array([patch], pa.string())).to_pylist()[0].values())


def read_by(parse: Callable[[pa.Array], pa.Array], kind: str, patch: str) -> Column:
    def of(patches: pa.Array) -> pa.Array:
        return parse(patches)

    return F.arrow_udf(of, kind)(F.col(patch))


def hunk_lines(patch: str) -> Column:
    """HUNKS of a column of patches: every line with its tag and its number in the old and the new file, where it is in them.

    inserted_after are the old lines after which lines are put in without replacing the line before. A null patch has no hunks.
    """
    return read_by(_hunks, HUNKS, patch)


def changes(patch: str) -> Column:
    """CHANGES of a column of patches; a null patch changes nothing."""
    return read_by(_changes, CHANGES, patch)


def added_lines(patch: str) -> Column:
    """The lines that patches add, with their numbers in the new file."""
    return read_by(_added, "array<struct<line:int,text:string>>", patch)


def hunk_removals(patch: str) -> Column:
    """The hunks of patches with their place in the old file and how many lines they remove."""
    return read_by(_removals, "array<struct<number:int,old_start:int,old_count:int,removed:int>>", patch)


def changed_text(patch: str) -> Column:
    """The hunks of patches with the text of the lines that they add or remove."""
    return read_by(_changed_text, "array<struct<section:string,lines:array<string>>>", patch)


def touches(found: Column, start: Column, end: Column, slack: int = 0) -> Column:
    """Whether changes remove, replace or insert next to old lines from start - slack to end + slack."""
    low, high = start - slack, end + slack
    return F.exists(found["deleted"], lambda n: n.between(low, high)) | F.exists(found["inserted_after"], lambda n: n.between(low - 1, high))


def lines_changed_by_compare(threads: DataFrame, slack: int) -> DataFrame:
    """threads with by_compare: whether the deciding compare changed the flagged lines; null where it can't tell.

    threads (diff_side, start_line, end_line or null for a whole file; of the compare: direct, complete; of the
    compare's file: file_status, patch, all null without one).
    """
    rows = threads.withColumn("_found", changes("patch"))
    line = touches(F.col("_found"), F.col("start_line"), F.col("end_line"), slack)
    told = (
        F.when(~F.coalesce("direct", F.lit(False)) | ~F.col("diff_side").eqNullSafe("RIGHT"), F.lit(None).cast("boolean"))
        .when(F.col("file_status").isNull(), F.when(F.col("complete"), False)).when(F.col("file_status") == "removed", True)
        .when(F.col("patch").isNull(), F.lit(None).cast("boolean")).when(F.col("end_line").isNull(), F.trim("patch") != "").otherwise(line)
    )
    return rows.withColumn("by_compare", told).drop("_found")


def has_thumbs_down(reactions: Column, author: Column) -> Column:
    """A thumbs-down of anyone but the comment's author; a deleted account is no one else's."""
    return F.exists(reactions, lambda r: (r["content"] == "THUMBS_DOWN") & ~r["user"].eqNullSafe(author))


def anchored(findings: DataFrame, files: DataFrame, keys: list[str], slack: int = 3) -> DataFrame:
    """findings (keys, path, start_line, end_line) with anchored: whether they lie within `slack` lines of a changed hunk.

    files (keys, path, patch): one row per file, so that a finding meets one list of ranges.
    """
    ranges = files.select(*keys, "path", changes("patch")["new_ranges"].alias("_ranges"))
    near = F.exists("_ranges", lambda r: (r["start"] - slack <= F.col("end_line")) & (F.col("start_line") <= r["end"] + slack))
    return findings.join(ranges, [*keys, "path"], "left").withColumn("anchored", F.coalesce(near, F.lit(False))).drop("_ranges")
