"""Facts of reviews and replayed rounds: who reviewed, the reviewed commit, deciding compares, target rounds, latest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import author_kind

PR = ["repo", "number"]


def review_flags(prs: DataFrame, reviews: DataFrame) -> DataFrame:
    """prs (repo, number, author) with by_human, by_ai and changes_requested; reviews (repo, number, login, login_type, state).

    Agents count as by_ai only. An author's own review counts for nothing but by_ai.
    """
    kind, other = author_kind(F.col("login"), F.col("login_type")), ~F.col("login").eqNullSafe(F.col("author"))
    human = (kind == "human") & other
    flags = reviews.join(prs.select(*PR, "author"), PR).groupBy(*PR).agg(
        F.bool_or(human).alias("by_human"), F.bool_or(kind == "ai").alias("by_ai"),
        F.bool_or(human & (F.col("state") == "CHANGES_REQUESTED")).alias("changes_requested"),
    )
    return prs.join(flags, PR, "left").fillna(False, ["by_human", "by_ai", "changes_requested"])


def reviewed_commits(prs: DataFrame, reviews: DataFrame, anchors: DataFrame) -> DataFrame:
    """(repo, number, commit): that of the earliest review by another human, else of any review, else the earliest
    thread's anchor, else the head.

    prs (repo, number, author, head), reviews (repo, number, login, login_type, commit, submitted_at), anchors (repo,
    number, commit, created_at). Rows without commit or time don't count; equal times go to the smaller commit.
    """
    dated = reviews.filter("commit IS NOT NULL AND submitted_at IS NOT NULL").join(prs.select(*PR, "author"), PR)
    human = (author_kind(F.col("login"), F.col("login_type")) == "human") & ~F.col("login").eqNullSafe(F.col("author"))
    at = F.struct("submitted_at", "commit")
    first = dated.groupBy(*PR).agg(F.min(F.when(human, at))["commit"].alias("_human"), F.min(at)["commit"].alias("_any"))
    anchored = anchors.filter("commit IS NOT NULL").groupBy(*PR).agg(F.min(F.struct("created_at", "commit"))["commit"].alias("_anchor"))
    joined = prs.join(first, PR, "left").join(anchored, PR, "left")
    return joined.select(*PR, F.coalesce("_human", "_any", "_anchor", "head").alias("commit"))


def deciding_compares(threads: DataFrame, compares: DataFrame, files: DataFrame) -> DataFrame:
    """threads (repo, number, thread_id, path, anchor) with the compare_id that decides each, null if none.

    Of the compares (repo, number, compare_id, base, direct, complete) from the thread's anchor: a direct one that
    lists the path (files: repo, number, compare_id, path), else a direct complete one, else any; the smallest id of those.
    """
    keyed = compares.select(*PR, F.col("base").alias("anchor"), "compare_id", "direct", "complete")
    listed = files.select(*PR, "compare_id", "path").distinct().withColumn("_lists", F.lit(True))
    pairs = threads.select(*PR, "path", "anchor").distinct().join(keyed, [*PR, "anchor"]).join(listed, [*PR, "compare_id", "path"], "left")
    step = F.when(F.col("direct") & F.coalesce("_lists", F.lit(False)), 1).when(F.col("direct") & F.col("complete"), 2).otherwise(3)
    best = pairs.groupBy(*PR, "path", "anchor").agg(F.min(F.struct(step, "compare_id"))["compare_id"].alias("compare_id"))
    return threads.join(best, [*PR, "path", "anchor"], "left")


def target_rounds(issues: DataFrame, replayed: DataFrame, present: DataFrame) -> DataFrame:
    """issues (repo, number, issue_id, opened_in) with target_round: the latest replayed round (repo, number, round) at
    or before the one it was opened in at which its code is there (present: repo, number, issue_id, round); else null.
    An issue that no round opened counts as opened in round 1."""
    opened = issues.withColumn("opened_in", F.coalesce("opened_in", F.lit(1)))
    seen = present.join(replayed.select(*PR, "round").distinct(), [*PR, "round"], "left_semi")
    found = opened.join(seen, [*PR, "issue_id"]).filter("round <= opened_in")
    best = found.groupBy(*PR, "issue_id").agg(F.max("round").cast("int").alias("target_round"))
    return opened.join(best, [*PR, "issue_id"], "left")


def round_diffs(packed: DataFrame, stored: DataFrame) -> DataFrame:
    """One diff a head commit (repo, number, head, diff): that of a pack where there is one, else a stored one."""
    both = packed.withColumn("_order", F.lit(1)).unionByName(stored.withColumn("_order", F.lit(2)))
    return both.groupBy(*PR, "head").agg(F.min(F.struct("_order", "diff"))["diff"].alias("diff"))


def latest_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The newest complete run (run_id, created_at, complete) of each key; equal times go to the larger id."""
    newest = F.max(F.struct("created_at", "run_id"))
    return runs.filter("complete").groupBy(*keys).agg(newest.alias("_run")).select(*keys, "_run.run_id", "_run.created_at")
