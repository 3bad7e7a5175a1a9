"""Lines of code over time: ranges followed between two versions of a file, and defects that a later fix points to."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.members import may_be_among
from ..functions.texts import lines_of, stripped
from .contamination import staged
from .diffs import hunk_removals
from .paths import is_test

#: A pair of versions is aligned as a whole if its equal line pairs (i, j) are no more than this. Else it is first cut at
#: the lines that both versions have once, as far as those are in one order; a piece of more pairs keeps its equal first
#: and last lines, and the rest of it counts as replaced.
MOST_PAIRS = 2_000_000
PIECES = "array<struct<tag:string,i1:int,i2:int,j1:int,j2:int>>"


def equal_pairs(old: list[str], new: list[str]) -> int:
    counts = Counter(new)
    return sum(counts[line] for line in old)


def anchors(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Places of the lines that both have once: the longest run that ascends in both."""
    once_old, once_new = Counter(old), Counter(new)
    place = {line: j for j, line in enumerate(new) if once_new[line] == 1}
    pairs = [(i, place[line]) for i, line in enumerate(old) if once_old[line] == 1 and line in place]
    tails, heads, before = [], [], [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before[k] = heads[at - 1] if at else -1
        tails[at : at + 1], heads[at : at + 1] = [j], [k]
    out, k = [], heads[-1] if heads else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def equal_runs(old: list[str], new: list[str]) -> list[tuple[int, int, int]]:
    """(i, j, n): n equal lines from old i and new j, ascending."""
    if equal_pairs(old, new) <= MOST_PAIRS:
        return [(b.a, b.b, b.size) for b in SequenceMatcher(None, old, new, autojunk=False).get_matching_blocks() if b.size]
    fixed = anchors(old, new)
    if not fixed:
        most = min(len(old), len(new))
        head = next((k for k in range(most) if old[k] != new[k]), most)
        tail = next((k for k in range(most - head) if old[-1 - k] != new[-1 - k]), most - head)
        return [(0, 0, head)] * (head > 0) + [(len(old) - tail, len(new) - tail, tail)] * (tail > 0)
    out, i, j = [], 0, 0
    for a, b in [*fixed, (len(old), len(new))]:
        out += [(i + x, j + y, n) for x, y, n in equal_runs(old[i:a], new[j:b])]
        if a < len(old):
            out.append((a, b, 1))
        i, j = a + 1, b + 1
    return out


def aligned(old: list[str], new: list[str]) -> list[tuple[str, int, int, int, int]]:
    """(tag, i1, i2, j1, j2): old lines i1 to i2 became new lines j1 to j2 (from 0, ends excluded)."""
    out, i, j = [], 0, 0
    for a, b, n in [*equal_runs(old, new), (len(old), len(new), 0)]:
        if i < a or j < b:
            out.append(("replace" if i < a and j < b else "delete" if i < a else "insert", i, a, j, b))
        if n and out and out[-1][0] == "equal" and out[-1][2] == a and out[-1][4] == b:
            out[-1] = ("equal", out[-1][1], a + n, out[-1][3], b + n)
        elif n:
            out.append(("equal", a, a + n, b, b + n))
        i, j = a + n, b + n
    return out


def pieces(old: Column, new: Column) -> Column:
    """PIECES of two arrays of lines; null where a version is missing."""

    def align(olds: pd.Series, news: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else aligned(list(a), list(b)) for a, b in zip(olds, news)], dtype=object)

    return F.pandas_udf(align, PIECES)(old, new)


def forward(found: Column, start: Column, end: Column) -> Column:
    """struct(start, end): where old lines start to end (from 1) are in the new file.

    Replaced lines take the whole of what replaced them, lines put in between two of the range's lines belong to it, and
    a range that is gone is empty (end = start - 1) at the place it was removed from.
    """
    low, high = start - 1, end
    inside = lambda p: F.greatest(p["i1"], low) < F.least(p["i2"], high)
    amid = lambda p: (p["tag"] == "insert") & (low < p["i1"]) & (p["i1"] < high)
    hit = F.filter(found, lambda p: F.when(p["tag"] == "insert", amid(p)).otherwise((p["tag"] != "delete") & inside(p)))
    gone = F.get(F.filter(found, lambda p: (p["tag"] == "delete") & inside(p)), 0)["j1"]
    same = lambda p: p["tag"] == "equal"
    first = F.array_min(F.transform(hit, lambda p: F.when(same(p), p["j1"] + F.greatest(p["i1"], low) - p["i1"]).otherwise(p["j1"])))
    last = F.array_max(F.transform(hit, lambda p: F.when(same(p), p["j1"] + F.least(p["i2"], high) - p["i1"]).otherwise(p["j2"])))
    empty = F.coalesce(gone, F.lit(0))
    start, end = F.coalesce(first, empty) + 1, F.coalesce(last, empty)
    return F.when(found.isNotNull(), F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))


def back(found: Column, start: Column, end: Column) -> Column:
    """struct(start, end): where new lines start to end (from 1) are in the old file, if all of them are unchanged there."""
    low, high = start - 1, end
    hit = F.filter(found, lambda p: (p["tag"] == "equal") & (F.greatest(p["j1"], low) < F.least(p["j2"], high)))
    lines = F.aggregate(hit, F.lit(0), lambda n, p: n + F.least(p["j2"], high) - F.greatest(p["j1"], low))
    first = F.array_min(F.transform(hit, lambda p: p["i1"] + F.greatest(p["j1"], low) - p["j1"])) + 1
    last = F.array_max(F.transform(hit, lambda p: p["i1"] + F.least(p["j2"], high) - p["j1"]))
    return F.when((lines == high - low) & (high > low), F.struct(first.cast("int").alias("start"), last.cast("int").alias("end")))


def mapped_ranges(ranges: DataFrame, versions: DataFrame, keys: list[str]) -> DataFrame:
    """ranges (keys, path, old_commit, new_commit, start_line, end_line) with forward and back, structs of start and end.

    versions (keys, path, commit, text): one row a version. back reads the range as lines of the new version. Both are
    null if a version is missing; back also if a line is new or changed. Each pair of versions is aligned once,
    however many ranges it has. Versions are never broadcast: a plan knows their number but not how long their lines are.
    """
    pair = [*keys, "path", "old_commit", "new_commit"]
    text = lambda c: versions.select(*keys, "path", F.col("commit").alias(f"{c}_commit"), lines_of(F.col("text")).alias(f"_{c}")).hint("merge")
    pairs = ranges.select(*pair).distinct()
    both = pairs.join(text("old"), [*keys, "path", "old_commit"]).join(text("new"), [*keys, "path", "new_commit"])
    found = both.select(*pair, pieces(F.col("_old"), F.col("_new")).alias("_pieces")).hint("merge")
    start, end = F.col("start_line"), F.col("end_line")
    joined = ranges.join(found, pair, "left")
    return joined.select(*ranges.columns, forward(F.col("_pieces"), start, end).alias("forward"), back(F.col("_pieces"), start, end).alias("back"))


@dataclass(frozen=True)
class DefectRules:
    #: Fixed pattern and labels of bug fixes.
    fix_title: str = r"(?i)\b(fix(e[sd])?|bug ?fix|regression|crash(es)?|broken|incorrect(ly)?|wrong)\b"
    fix_labels: tuple[str, ...] = ("bug", "type: bug", "type:bug", "kind/bug", "bug fix", "bugfix", "regression", "fix")
    window_end: str = "2026-06-30"
    after_days: int = 90
    max_fix_lines: int = 30
    max_files: int = 15
    conf: float = 1.0


#: Fixed endings of source files.
SOURCE_FILE = r"(?i)\.(py|pyi|pyx|[mc]?[jt]s|[jt]sx|c|h|cc|cpp|cxx|hh|hpp|hxx|ipp|inl|cu|cuh|go|java|kt|kts|scala|cs|rs)$"
#: Lines of a file that lie in one bin: ranges meet the blamed lines of the bins they reach into.
BIN = 64


def is_fix(prs: DataFrame, rules: DefectRules) -> DataFrame:
    """Of prs (title, labels, created_at) the bug fixes of the window that follows the corpus."""
    day, end = F.substring("created_at", 1, 10), F.lit(rules.window_end).cast("date")
    window = day.between(F.date_add(end, 1).cast("string"), F.date_add(end, rules.after_days).cast("string"))
    labels = F.transform(F.coalesce("labels", F.array().cast("array<string>")), F.lower)
    known = F.array(*(F.lit(label.lower()) for label in rules.fix_labels))
    return prs.filter(window & (F.coalesce(F.col("title").rlike(rules.fix_title), F.lit(False)) | F.arrays_overlap(labels, known)))


def rewritten_ranges(files: DataFrame, keys: list[str], rules: DefectRules) -> DataFrame:
    """(keys, path, hunk, start_line, end_line): the old lines of each hunk that removes 1 to max_fix_lines lines."""
    return ranges_of(files.select(*keys, "path", hunk_removals("patch").alias("_removals")), keys, rules)


def ranges_of(read: DataFrame, keys: list[str], rules: DefectRules) -> DataFrame:
    """rewritten_ranges of files whose patches have been read (keys, path, _removals)."""
    hunks = read.select(*keys, "path", F.explode("_removals").alias("h"))
    kept = hunks.filter(F.col("h.removed").between(1, rules.max_fix_lines))
    return kept.select(*keys, "path", F.col("h.number").alias("hunk"), F.col("h.old_start").alias("start_line"), (F.col("h.old_start") + F.col("h.old_count") - 1).alias("end_line"))


def blamed_blocks(ranges: DataFrame, blame: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, hunk, sha, first_line, block): runs of neighbouring lines of a range that one commit wrote.

    blame (keys, path, line, sha, text, boundary). A line of the history's boundary counts for nothing.
    """
    reach = F.sequence(F.floor(F.col("start_line") / BIN), F.floor(F.col("end_line") / BIN))
    binned = ranges.withColumn("_bin", F.explode(reach))
    lines = blame.filter("NOT boundary").withColumn("_bin", F.floor(F.col("line") / BIN))
    hit = lines.join(binned, [*keys, "path", "_bin"]).filter("line BETWEEN start_line AND end_line")
    run = [*keys, "path", "hunk", "sha"]
    island = F.col("line") - F.row_number().over(Window.partitionBy(*run).orderBy("line"))
    found = hit.withColumn("_island", island).groupBy(*run, "_island").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("_lines"))
    return found.select(*run, F.get("_lines", 0)["line"].alias("first_line"), F.transform("_lines", lambda x: x["text"]).alias("block"))


def located(text: Column, block: Column) -> Column:
    """The first line (from 1) at which the lines of block stand one after the other in text, spaces around lines aside; else null."""
    clean = lambda lines: F.transform(lines, stripped)
    both = F.array(F.struct(clean(lines_of(text)).alias("lines"), clean(block).alias("block")))

    def first(x: Column) -> Column:
        n = F.size(x["block"])
        places = F.when(F.size(x["lines"]) >= n, F.sequence(F.lit(1), F.size(x["lines"]) - n + 1))
        return F.get(F.filter(places, lambda i: (F.get(x["lines"], i - 1) == F.get(x["block"], 0)) & (F.slice(x["lines"], i, n) == x["block"])), 0)

    return F.get(F.transform(both, first), 0)


def commits_of(shas: DataFrame, corpus: DataFrame, commits: DataFrame, messages: DataFrame) -> DataFrame:
    """shas (repo, sha) with the number of the corpus pull request that each belongs to; others are left out.

    A head commit names its pull request, then any of its commits (the larger number, if several have it), then the
    first number in the commit's message, as `(#N)` at a line's end or a merge's first words, that is in the corpus.
    corpus (repo, number, head_oid), commits (repo, number, oid), messages (repo, sha, message).
    """
    heads = corpus.select("repo", F.col("head_oid").alias("sha"), F.lit(1).alias("_rank"), "number")
    own = commits.join(corpus.select("repo", "number"), ["repo", "number"], "left_semi").select("repo", F.col("oid").alias("sha"), F.lit(0).alias("_rank"), "number")
    by_oid = heads.unionByName(own).groupBy("repo", "sha").agg(F.max(F.struct("_rank", "number"))["number"].alias("_oid_number"))
    asked = shas.select("repo", "sha").distinct()
    # fixed forms of a pull request's number in a message
    said = F.regexp_extract_all("message", F.lit(r"(?m)\(#[0-9]+\)\s*$|^Merge pull request #[0-9]+\b"), F.lit(0))
    numbers = F.transform(said, lambda m: F.regexp_extract(m, "[0-9]+", 0).try_cast("long"))
    named = messages.join(asked, ["repo", "sha"], "left_semi").select("repo", "sha", F.posexplode(numbers).alias("_at", "number"))
    by_message = named.join(corpus.select("repo", "number"), ["repo", "number"], "left_semi").groupBy("repo", "sha").agg(F.min_by("number", "_at").alias("_said"))
    both = asked.join(by_oid, ["repo", "sha"], "left").join(by_message, ["repo", "sha"], "left")
    return both.select("repo", "sha", F.coalesce("_oid_number", "_said").alias("number")).filter("number IS NOT NULL")


def escaped_defects(
    merged: DataFrame, files: DataFrame, blame: DataFrame, messages: DataFrame, corpus: DataFrame, commits: DataFrame, versions: DataFrame, rules: DefectRules
) -> tuple[DataFrame, DataFrame]:
    """Lines of corpus pull requests that a later bug fix rewrote, and what was skipped.

    merged (repo, number, title, labels, created_at, merge_commit): pull requests of any time. files (repo, number, path,
    status, patch): those of each merge commit; blame (repo, number, path, line, sha, text, boundary): lines before it.
    corpus (repo, number, corpus, head_oid, reviewed_commit) with commits and messages as in commits_of; versions (repo,
    commit, path, text). Only human and approval_only pull requests count as corpus.

    defects (repo, number, fix, fix_title, merge_commit, sha, issue_id, path, start_line, end_line, severity, conf,
    description): one row an issue, which a pull request, fix, path and first line tell apart; of several fixed blocks
    there, that of the first hunk and smallest commit. skipped (repo, reason, n): fixes and blocks left out.
    """
    known = corpus.filter("corpus IN ('human', 'approval_only')")
    fixes = is_fix(merged, rules).join(known.select("repo").distinct(), "repo", "left_semi").select("repo", F.col("number").alias("fix"), F.col("title").alias("fix_title"), "merge_commit")
    fixes = staged(fixes)
    key = ["repo", "fix"]
    # files, their lines and versions are of all pull requests: most go before they are dealt out
    of_fixes = fixes.filter("merge_commit IS NOT NULL").select(*key)
    source = (F.col("status") == "modified") & (F.col("patch") != "") & F.col("path").rlike(SOURCE_FILE) & ~is_test(F.col("path"))
    rewritten = may_be_among(files.withColumnRenamed("number", "fix").filter(source), of_fixes, key).join(of_fixes, key, "left_semi")
    rewritten = staged(rewritten.select(*key, "path", hunk_removals("patch").alias("_removals")))
    counts = rewritten.groupBy("repo", "fix").agg(F.count("*").alias("_files"))
    told = fixes.join(counts, ["repo", "fix"], "left")
    reason = (
        F.when(F.col("merge_commit").isNull(), "no merge commit").when(F.col("_files").isNull(), "no source file rewritten")
        .when(F.col("_files") > rules.max_files, "too many files")
    )
    ranges = staged(ranges_of(rewritten.join(counts.filter(F.col("_files") <= rules.max_files), key, "left_semi"), key, rules))
    lines = may_be_among(blame.withColumnRenamed("number", "fix"), ranges, [*key, "path"])
    blocks = staged(blamed_blocks(ranges, lines, key))
    owned = staged(blocks.join(commits_of(blocks, known, commits, messages), ["repo", "sha"]).join(known.select("repo", "number", "reviewed_commit"), ["repo", "number"]))
    text = versions.select("repo", F.col("commit").alias("reviewed_commit"), "path", "text")
    text = may_be_among(text, owned, ["repo", "reviewed_commit", "path"])
    placed = owned.join(text, ["repo", "reviewed_commit", "path"], "left").withColumn("start_line", located(F.col("text"), F.col("block")))
    lost = placed.filter("start_line IS NULL").select("repo", F.lit("lines not found at the reviewed commit").alias("reason"))
    skipped = told.select("repo", reason.alias("reason")).filter("reason IS NOT NULL").unionByName(lost).groupBy("repo", "reason").agg(F.count("*").alias("n"))
    row = F.struct("hunk", "sha", "first_line", F.size("block").alias("size"))
    issues = placed.filter("start_line IS NOT NULL").groupBy("repo", "number", "fix", "path", "start_line").agg(F.min(row).alias("b"))
    named = issues.join(fixes, key)
    pull = F.concat_ws("#", "repo", "number")
    defects = named.select(
        "repo", "number", "fix", "fix_title", "merge_commit", "b.sha", F.concat(F.concat_ws(":", pull, F.concat(F.lit("fix"), "fix"), "path", "start_line")).alias("issue_id"),
        "path", "start_line", (F.col("start_line") + F.col("b.size") - 1).alias("end_line"), F.lit("important").alias("severity"), F.lit(rules.conf).alias("conf"),
        F.concat(F.lit("A later fix, #"), "fix", F.lit(' "'), "fix_title", F.lit('", rewrote these lines.')).alias("description"),
    )
    return defects, skipped
