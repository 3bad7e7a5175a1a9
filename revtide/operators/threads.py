"""Outcomes, labels, gold provenance and review rounds of review threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import ranked, running_sum
from .contamination import staged

REVIEW_KINDS = ("human", "ai")
DISMISSED = ("thumbs_down", "resolved_no_change", "ignored")
PROVENANCE = ("applied_suggestion", "human_fixed", "human_open_at_merge", "judge_only")


def outcome(thumbs_down: Column, changed: Column, resolved: Column, replied: Column) -> Column:
    """First match wins."""
    return (
        F.when(thumbs_down, "thumbs_down").when(changed, "fixed").when(resolved, "resolved_no_change")
        .when(replied, "open_at_merge").otherwise("ignored")
    )


def lines_changed(by_compare: Column, is_outdated: Column) -> Column:
    """What the compare says; where it can't tell (null), whether the thread is outdated."""
    return F.coalesce(by_compare, is_outdated)


def has_reply(comments: DataFrame) -> DataFrame:
    """(thread_id, replied): someone other than the opener, and not a bot or a deleted account, commented later."""
    opener = F.min_by("author", "ord").over(Window.partitionBy("thread_id"))
    first = F.min("ord").over(Window.partitionBy("thread_id"))
    rows = comments.withColumns({"_opener": opener, "_first": first})
    reply = (F.col("ord") > F.col("_first")) & F.col("author").isNotNull() & ~F.col("author").eqNullSafe(F.col("_opener")) & ~F.col("is_bot")
    return rows.groupBy("thread_id").agg(F.max(reply.cast("int")).cast("boolean").alias("replied"))


def needs_addressed_check(kind: Column, result: Column, applied: Column) -> Column:
    return kind.isin(*REVIEW_KINDS) & (result == "fixed") & ~applied


def needs_classification(kind: Column, result: Column, replied: Column) -> Column:
    return kind.isin(*REVIEW_KINDS) & (result != "fixed") & (replied | result.isin(*DISMISSED))


def judged_labels(threads: DataFrame, high_risk: list[str]) -> DataFrame:
    """threads (author_kind, outcome, replied, applied, addressed, stance, category, classified) with judged_outcome,
    polarity, strength and high_risk_dismissal. A polarity that still waits for a judgment is null."""
    kind, result = F.col("author_kind"), F.col("outcome")
    review, fixed = kind.isin(*REVIEW_KINDS), F.col("outcome") == "fixed"
    done = F.col("applied") | F.coalesce(F.col("addressed").isin("addressed", "partially"), F.lit(False))
    denied = F.coalesce(F.col("addressed") == "not_addressed", F.lit(False))
    waits = needs_classification(kind, result, F.col("replied")) & ~F.col("classified")
    agrees = F.coalesce(F.col("stance").isin("agree", "fixed_elsewhere"), F.lit(False))
    disagrees = F.coalesce(F.col("stance") == "disagree", F.lit(False))
    verdict = (
        F.when(~review, "neutral").when(fixed & done, "positive/strong").when(fixed & denied, "neutral").when(fixed, None)
        .when(waits, None).when(result == "thumbs_down", "negative/strong").when(agrees, "positive/medium")
        .when(disagrees, "negative/medium").when(result.isin(*DISMISSED), "negative/weak").otherwise("neutral")
    )
    rows = threads.withColumn("_verdict", verdict)
    risky = F.coalesce(F.col("_verdict").startswith("negative") & F.col("category").isin(*high_risk), F.lit(False))
    shown = F.when(risky, "neutral").otherwise(F.col("_verdict"))
    return rows.withColumns(
        {
            "judged_outcome": F.when(review & fixed & ~done & denied, "changed_unaddressed").otherwise(result),
            "polarity": F.substring_index(shown, "/", 1),
            "strength": F.when(F.contains(shown, F.lit("/")), F.substring_index(shown, "/", -1)),
            "high_risk_dismissal": risky,
        }
    ).drop("_verdict")


def gold_provenance(judged: DataFrame) -> Column:
    """Why a human thread is a gold issue, or null."""
    result = F.col("judged_outcome")
    return (
        F.when((F.col("author_kind") != "human") | (result == "thumbs_down"), None)
        .when(F.col("applied") & (result == "fixed"), "applied_suggestion")
        .when((result == "fixed") & F.col("addressed").isin("addressed", "partially"), "human_fixed")
        .when((result == "open_at_merge") & (F.col("stance") == "agree"), "human_open_at_merge")
    )


def build_gold(threads: DataFrame) -> DataFrame:
    """threads (repo, number, grp, thread_id, created_at, path, provenance) -> one gold issue per group: the earliest
    thread is primary, members are sorted, the strongest provenance counts."""
    rank = F.array_position(F.array(*map(F.lit, PROVENANCE)), F.col("provenance"))
    return threads.filter("provenance IS NOT NULL").groupBy("repo", "number", "grp").agg(
        F.min_by("thread_id", F.struct("created_at", "thread_id")).alias("primary_thread"),
        F.min_by("path", F.struct("created_at", "thread_id")).alias("path"),
        F.min_by("provenance", rank).alias("provenance"), F.array_join(F.array_sort(F.collect_list("thread_id")), ",").alias("members"),
    )


def review_rounds(threads: DataFrame, reviewed: DataFrame) -> DataFrame:
    """threads (repo, number, thread_id, anchor, created_at), reviewed (repo, number, commit) -> rounds of a PR.

    Round 1 is the reviewed commit with every anchor seen before its first thread; the others follow by first thread.
    """
    pr = ["repo", "number"]
    commits = threads.filter("anchor IS NOT NULL AND created_at IS NOT NULL").groupBy(*pr, F.col("anchor").alias("commit")).agg(
        F.min("created_at").alias("started_at"), F.count("*").alias("threads")
    )
    base = reviewed.select(*pr, F.col("commit").alias("_reviewed"))
    own = commits.join(base, [*pr]).filter(F.col("commit") == F.col("_reviewed")).select(*pr, F.col("started_at").alias("_start"))
    rows = base.join(own, pr, "left").join(commits, pr, "left")
    early = F.coalesce((F.col("commit") == F.col("_reviewed")) | (F.col("started_at") < F.col("_start")), F.lit(False))
    one = rows.groupBy(*pr, "_reviewed", "_start").agg(F.sum(F.when(early, F.col("threads")).otherwise(0)).alias("threads"))
    first = one.select(*pr, F.lit(1).alias("round"), F.col("_reviewed").alias("commit"), F.coalesce("_start", F.lit("")).alias("started_at"), "threads")
    turn = F.row_number().over(Window.partitionBy(*pr).orderBy("started_at", "commit")) + 1
    later = rows.filter(F.col("commit").isNotNull() & ~early).withColumn("round", turn).select(*pr, "round", "commit", "started_at", "threads")
    return first.unionByName(later)


def select_rounds(rounds: DataFrame, most: int) -> DataFrame:
    """The first round, then those with the most threads (earlier on a tie), up to `most`."""
    later = F.when(F.col("round") == 1, 0).otherwise(1)
    turn = F.row_number().over(Window.partitionBy("repo", "number").orderBy(later, F.desc("threads"), "round"))
    return rounds.withColumn("_turn", turn).filter(F.col("_turn") <= most).drop("_turn")


#: A place with about so many threads is sorted a day at a time; each thread is looked at with a chance of 1 / SAMPLED to find such places.
LARGE, SAMPLED = 65_536, 1_024


def threads_before(prs: DataFrame, threads: DataFrame, most: int) -> DataFrame:
    """For each PR (repo, number, path, created_at) the latest `most` earlier threads of its repo and path.

    PRs and threads of a path are brought into one order, so that no pairs of them are made: what came before a PR there
    are its threads. Times are text that begins with a day; the few paths with very many threads are sorted a day at a
    time. Which ones these are is told from a sample and decides nothing but the way.
    """
    keys = ["repo", "path"]
    known = threads.select(*keys, "thread_id", "created_at").filter("repo IS NOT NULL AND path IS NOT NULL AND created_at IS NOT NULL")
    asked = prs.select("repo", "number", "path", "created_at").filter("repo IS NOT NULL AND path IS NOT NULL AND created_at IS NOT NULL")
    met = known.select(*keys).filter(F.rand(7) < 1 / SAMPLED).groupBy(*keys).agg(F.count("*").alias("_n"))
    large = F.broadcast(staged(met.filter(F.col("_n") >= LARGE / SAMPLED).select(*keys)))  # at most a place for each LARGE threads or so
    few = _before_in_one_order(*(x.join(large, keys, "left_anti") for x in (asked, known)), most)
    return few.unionByName(_before_by_day(*(x.join(large, keys, "left_semi") for x in (asked, known)), most))


def _before_in_one_order(asked: DataFrame, known: DataFrame, most: int) -> DataFrame:
    both = asked.withColumn("_thread", F.lit(0)).unionByName(known.withColumn("_thread", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("_told", F.when(F.col("_thread") == 1, F.struct("thread_id")))
    before = [F.expr(f"lag(_told, {k}) IGNORE NULLS OVER (PARTITION BY repo, path ORDER BY created_at, _thread, thread_id DESC)") for k in range(1, most + 1)]
    seen = both.withColumn("_before", F.array(*before)).filter("_thread = 0")
    each = seen.select("repo", "number", "path", F.posexplode("_before").alias("_at", "_one")).filter("_one IS NOT NULL")
    return each.select("repo", "number", "path", "_one.thread_id", (F.col("_at") + 1).alias("rank"))


def _before_by_day(asked: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """Numbers the threads of a path and counts how many came before a PR, which tells its last ones."""
    day, place = F.substring("created_at", 1, 10), F.concat_ws("\0", "repo", "path")
    known = ranked(known.withColumn("_place", place), "_place", day, ["created_at", F.desc("thread_id")], "_seq", "_all").drop("_all")
    both = asked.withColumn("_thread", F.lit(0)).unionByName(known.select("repo", "path", "created_at").withColumn("_thread", F.lit(1)), allowMissingColumns=True)
    counted = running_sum(both, ["repo", "path"], day, ["created_at", "_thread"], "_thread", "_upto", "_all")
    seen = counted.filter("_thread = 0 AND _upto > 0").select("repo", "number", "path", "_upto")
    last = seen.withColumn("_seq", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_upto") - most + 1), F.col("_upto"))))
    found = last.join(known.drop("created_at", "_place"), ["repo", "path", "_seq"])
    return found.select("repo", "number", "path", "thread_id", (F.col("_upto") - F.col("_seq") + 1).cast("int").alias("rank"))
