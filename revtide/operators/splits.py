"""Time-ordered splits without leakage, and samples in hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import ranked, running_sum, salted_hash
from ..params import SplitParams

TIME = ["created_at", "repo", "number"]


def key() -> Column:
    return F.concat("repo", F.lit("#"), F.col("number").cast("string"))


def day() -> Column:
    return F.substring("created_at", 1, 10)


def assign(items: DataFrame, params: SplitParams) -> DataFrame:
    """items (repo, number, language, created_at, corpus) with split.

    Human PRs by their rank in time within the language; clean PRs by the dates at which the human PRs were cut. A
    language with clean PRs only ranks those among themselves, without a validation floor.
    """
    has_human = items.groupBy("language").agg(F.max((F.col("corpus") == "human").cast("int")).alias("_has_human"))
    rows = items.join(F.broadcast(has_human), "language")  # one row a language
    leads = (F.col("corpus") == "human") | (F.col("_has_human") == 0)
    lead = ranked(rows.filter(leads), "language", day(), TIME)
    n = F.col("group_size")
    train = F.bround(n * params.train).cast("long")
    until = F.bround(n * (params.train + params.validation)).cast("long")
    floor = F.when(F.col("_has_human") == 1, params.min_validation).otherwise(0)
    start = F.when(until - train < floor, F.greatest(F.lit(0), until - floor)).otherwise(train)
    lead = lead.withColumns({"_start": start, "_until": until})
    split = F.when(F.col("rank") <= F.col("_start"), "train").when(F.col("rank") <= F.col("_until"), "validation").otherwise("test")
    cuts = lead.groupBy("language").agg(
        F.min(F.when(F.col("rank") == F.col("_start") + 1, F.col("created_at"))).alias("_validation_from"),
        F.min(F.when(F.col("rank") == F.col("_until") + 1, F.col("created_at"))).alias("_test_from"),
    )
    rest = rows.filter(~leads).join(F.broadcast(cuts), "language")
    by_date = (
        F.when(F.col("created_at") < F.col("_validation_from"), "train")
        .when(F.col("_test_from").isNull() | (F.col("created_at") < F.col("_test_from")), "validation")
        .otherwise("test")
    )
    return lead.withColumn("split", split).select(*items.columns, "split").unionByName(
        rest.withColumn("split", by_date).select(*items.columns, "split")
    )


def hold_out(assigned: DataFrame, params: SplitParams) -> DataFrame:
    """test PRs become test-private or test-public: consecutive blocks in time, of each the lowest key hash is private."""
    tests = assigned.filter(F.col("split") == "test")
    part = F.concat_ws("/", "language", F.when(F.col("corpus") == "human", "human").otherwise("clean"))
    rows = ranked(tests.withColumn("_part", part), "_part", day(), TIME)
    blocks = F.floor(F.col("group_size") * params.private_share).cast("long")
    base, extra = F.floor(F.col("group_size") / blocks).cast("long"), F.col("group_size") % blocks
    at, wide = F.col("rank") - 1, (F.floor(F.col("group_size") / blocks).cast("long") + 1) * (F.col("group_size") % blocks)
    block = F.when(at < wide, F.floor(at / (base + 1))).otherwise(extra + F.floor((at - wide) / base)).cast("long")
    rows = rows.withColumns({"_block": F.when(blocks > 0, block), "_hash": salted_hash(params.private_salt, key())})
    turn = F.row_number().over(Window.partitionBy("_part", "_block").orderBy("_hash"))
    private = F.col("_block").isNotNull() & (turn == 1)
    done = rows.withColumn("split", F.when(private, "test-private").otherwise("test-public")).select(*assigned.columns)
    return assigned.filter(F.col("split") != "test").unionByName(done)


def split_table(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("split", "language").agg(
        F.count("*").alias("prs"), F.sum((F.col("corpus") == "human").cast("int")).alias("human"),
        F.min("created_at").alias("first"), F.max("created_at").alias("last"),
    )


def split_counts(assigned: DataFrame, gold: DataFrame) -> DataFrame:
    """assigned (repo, number, split, language, corpus, source), gold (repo, number, issues, important) -> counts a cell."""
    rows = assigned.join(gold.withColumn("_gold", F.lit(True)), ["repo", "number"], "left")
    own, bench = (F.col("corpus") == "human") & F.col("_gold").isNotNull(), F.col("source") == "benchmark"
    total = lambda c: F.coalesce(F.sum(F.when(own, F.col(c))), F.lit(0))
    return rows.groupBy("split", "language").agg(
        F.count_if(own).alias("gold_prs"), F.count_if(own & (F.col("issues") > 0)).alias("issue_prs"), F.count_if(own & (F.col("important") > 0)).alias("important_prs"),
        total("issues").alias("issues"), total("important").alias("important"), F.count_if(~bench & (F.col("corpus") == "approval_only")).alias("clean_prs"),
        F.count_if(~bench & (F.col("corpus") == "ai_feedback")).alias("ai_feedback_prs"), F.count_if(bench).alias("benchmark_prs"),
    )


def validation_cuts(assigned: DataFrame) -> DataFrame:
    """When each language's validation period begins."""
    return assigned.filter(F.col("split") == "validation").groupBy("language").agg(F.min("created_at").alias("cut"))


def admitted(feedback: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows created before their language's cut; without one before the earliest cut; without any cut none."""
    earliest = cuts.agg(F.min("cut").alias("_earliest"))
    limit = F.coalesce("cut", "_earliest")
    rows = feedback.join(F.broadcast(cuts), "language", "left").crossJoin(F.broadcast(earliest))  # one row
    return rows.filter(F.col("created_at") < limit).select(*feedback.columns)


def screen(items: DataFrame, params: SplitParams) -> DataFrame:
    """A fixed share of each language's PRs in salted hash order, at least one."""
    hashed = items.withColumn("_hash", salted_hash(params.screen_salt, key()))
    rows = ranked(hashed, "language", F.substring("_hash", 1, 3), ["_hash"])
    quota = F.greatest(F.lit(1), F.bround(params.screen_fraction * F.col("group_size")).cast("long"))
    return rows.filter(F.col("rank") <= quota).select(*items.columns, "rank")


def round_robin(items: DataFrame, repo: str, stratum: str, salt: str, most: int) -> DataFrame:
    """`most` rows: repos in turn, in a repo its strata in turn, in a stratum by hash."""
    hashed = items.withColumn("_hash", salted_hash(salt, key()))
    inner = F.row_number().over(Window.partitionBy(repo, stratum).orderBy("_hash"))
    rows = hashed.withColumn("_inner", inner).filter(F.col("_inner") <= most)
    outer = F.row_number().over(Window.partitionBy(repo).orderBy("_inner", stratum))
    rows = rows.withColumn("_outer", outer).filter(F.col("_outer") <= most)
    return rows.orderBy("_outer", repo).limit(most).select(*items.columns)


def until_enough(items: DataFrame, group: str, first: str, size: str, enough: int) -> DataFrame:
    """Whole rows in order (rows with `first` set, then hash order) until those before reach `enough`, per group."""
    hashed = items.withColumn("_hash", F.sha2(key(), 256))
    prefix = F.concat(F.when(F.col(first), "0").otherwise("1"), F.substring("_hash", 1, 3))
    summed = running_sum(hashed, [group], prefix, ["_hash"], size)
    return summed.filter(F.col("before") < enough).select(*items.columns, "before")
