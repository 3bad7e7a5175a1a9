"""Suggestion blocks of review comments, and whether a later change applied them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import lines_of, stripped
from .diffs import hunk_lines

#: Fixed form of a suggestion: a fence, closed by the same signs on a line of their own.
BLOCK = r"(?dms)^[ \t]*(`{3,}|~{3,})[ \t]*suggestion\b[^\n]*\n(.*?)^[ \t]*\1[ \t]*$"
#: Fixed beginning of the headline of a commit made from suggestions; one that names a reviewer applies theirs only.
APPLY = r"(?i)^apply suggestions? from (?:code review|@([\w-]+))"
#: Shorter lines prove nothing.
LEAST_CHARS = 2
APPLIED, NOT_APPLIED, NONE = "applied", "not_applied", "none"
IN_PATCH, BY_COMMIT = "suggested text found in the change to the flagged lines", "a suggestion commit after the comment changed the flagged lines"
UNCHANGED, NOT_FOUND = "flagged lines unchanged", "suggested text not found in the change"


def blocks(body: Column) -> Column:
    """The bodies of the suggestion blocks of a comment, in order."""
    return F.regexp_extract_all(F.replace(F.coalesce(body, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit(BLOCK), F.lit(2))


def suggestion(body: Column) -> Column:
    """The last suggestion of a comment, or null."""
    found = blocks(body)
    return F.get(found, F.size(found) - 1)


def applied_in_patch(suggested: Column, hunks: Column, start: Column, end: Column) -> Column:
    """Whether the hunks that change old lines start to end have every longer line of the suggestion on their new side,
    and one of them as an added line. A blank suggestion is applied where they delete lines and add none.
    """
    touches = lambda h: F.exists(h["lines"], lambda x: (x["tag"] == "-") & x["old"].between(start, end)) | F.exists(h["inserted_after"], lambda n: n.between(start - 1, end))
    changed = F.flatten(F.transform(F.filter(hunks, touches), lambda h: h["lines"]))
    side = lambda x, *tags: F.transform(F.filter(x, lambda line: line["tag"].isin(*tags)), lambda line: stripped(line["text"]))
    wanted = F.filter(F.transform(lines_of(suggested), stripped), lambda line: F.length(line) >= LEAST_CHARS)

    def told(x: Column) -> Column:
        added, new, gone = side(x["changed"], "+"), side(x["changed"], "+", " "), F.exists(x["changed"], lambda line: line["tag"] == "-")
        whole = (F.size(F.array_except(x["wanted"], new)) == 0) & F.arrays_overlap(x["wanted"], added)
        return F.when(stripped(suggested) == "", gone & (F.size(added) == 0)).otherwise((F.size(x["wanted"]) > 0) & whole)

    # array_except and arrays_overlap see each array once
    return F.get(F.transform(F.array(F.struct(changed.alias("changed"), wanted.alias("wanted"))), told), 0)


def suggestion_states(threads: DataFrame, commits: DataFrame) -> DataFrame:
    """threads with suggestion (applied, not_applied or none) and the reason.

    threads (repo, number, thread_id, body, reviewer, opened_at, diff_side, start_line, end_line, lines_changed, patch):
    body and reviewer of the first comment, lines_changed of the labels, patch of the deciding compare's file or null.
    commits (repo, number, headline, committed_at). A suggestion whose lines didn't change isn't applied. Else the patch
    decides (right side only), then a commit made from suggestions at or after the thread's opening: of a code review,
    or from this reviewer. An unknown opening time is before every commit.
    """
    key = ["repo", "number", "thread_id"]
    rows = threads.withColumn("_text", suggestion(F.col("body")))
    asked = rows.filter(F.col("_text").isNotNull() & F.coalesce("lines_changed", F.lit(False)))
    headline = stripped(F.col("headline"))
    made = commits.filter(headline.rlike(APPLY)).select("repo", "number", "committed_at", F.regexp_extract(headline, APPLY, 1).alias("_from"))
    late = (F.col("committed_at") >= F.coalesce("opened_at", F.lit(""))) & ((F.col("_from") == "") | F.col("_from").eqNullSafe(F.col("reviewer")))
    by_commit = asked.select(*key, "opened_at", "reviewer").join(made, ["repo", "number"]).filter(late).select(*key).distinct().withColumn("_commit", F.lit(True))
    found = applied_in_patch(F.col("_text"), F.col("_hunks"), F.col("start_line"), F.col("end_line"))
    in_patch = (F.col("diff_side") == "RIGHT") & F.col("end_line").isNotNull() & (F.col("patch") != "") & found
    patched = asked.withColumn("_hunks", hunk_lines("patch")).filter(in_patch).select(*key).distinct().withColumn("_patch", F.lit(True))
    joined = rows.join(patched, key, "left").join(by_commit, key, "left")
    changed, hit = F.coalesce("lines_changed", F.lit(False)), F.coalesce("_patch", "_commit", F.lit(False))
    state = F.when(F.col("_text").isNull(), NONE).when(changed & hit, APPLIED).otherwise(NOT_APPLIED)
    why = F.when(F.col("_text").isNull(), "").when(~changed, UNCHANGED).when(F.col("_patch"), IN_PATCH).when(F.col("_commit"), BY_COMMIT).otherwise(NOT_FOUND)
    return joined.select(*threads.columns, state.alias("suggestion"), why.alias("reason"))
