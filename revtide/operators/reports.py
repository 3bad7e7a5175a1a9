"""Usage, corpus and rigor reports, and production metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import ranked, running_sum, value_bucket

#: Groups (splits) whose levels are broadcast at most.
GROUPS = 10_000


def usage_by(ledger: DataFrame, *by: str) -> DataFrame:
    """ledger (stage, run_id, at, cached, ok, tokens, cost, seconds) -> one row per group and, by rollup, a total."""
    live, ok = ~F.col("cached"), ~F.col("cached") & F.col("ok")
    n = lambda c: F.sum(c.cast("long"))
    return ledger.rollup(*by).agg(
        n(live).alias("live"), n(F.col("cached")).alias("cached"), n(live & ~F.col("ok")).alias("failed"),
        F.sum(F.when(live, F.col("tokens")).otherwise(0)).alias("tokens"), F.round(F.sum(F.when(live, F.col("cost")).otherwise(0.0)), 4).alias("cost"),
        F.round(F.sum(F.when(ok, F.col("seconds"))) / n(ok), 4).alias("seconds_per_call"),
    )


def run_wall_clock(ledger: DataFrame) -> DataFrame:
    times = ledger.groupBy("run_id").agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.count("*").alias("calls"))
    return times.withColumn("minutes", F.round((F.unix_timestamp("ended") - F.unix_timestamp("started")) / 60, 4))


def latency(rounds: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, and nearest-rank median and 90th percentile per group.

    Values are counted first, and their running sum is taken range by range, so no group is sorted in one task.
    """
    counts = rounds.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    rows = running_sum(value_bucket(counts, value), [group], F.col("_range"), [value], "_n", "_before", "_all")
    upto = F.col("_before") + F.col("_n")
    at = lambda q: F.min(F.when(upto > F.least(F.col("_all") - 1, F.floor(F.col("_all") * q)), F.col(value)))
    mean = F.round(F.sum(F.col(value) * F.col("_n")) / F.sum("_n"), 4)
    return rows.groupBy(group).agg(mean.alias("mean"), at(0.5).alias("p50"), at(0.9).alias("p90"))


def corpus_table(threads: DataFrame, group: str, kinds: list[str]) -> DataFrame:
    """Threads of each group by kind of author, as columns, and the share fixed."""
    shares = threads.groupBy(group).agg(F.count("*").alias("threads"), F.round(F.avg((F.col("outcome") == "fixed").cast("double")), 6).alias("fixed"))
    return threads.groupBy(group).pivot("author_kind", kinds).count().fillna(0).join(shares, group)


def mid_rank(df: DataFrame, metric: str, out: str) -> DataFrame:
    """Mid-rank percentile of a metric over its non-null values; a null scores 0. Equal values are counted first."""
    counts = df.filter(F.col(metric).isNotNull()).groupBy(F.col(metric).alias("_v")).agg(F.count("*").alias("_n")).withColumn("_every", F.lit(1))
    ranks = running_sum(value_bucket(counts, "_v"), ["_every"], F.col("_range"), ["_v"], "_n", "_below", "_all")
    ranks = ranks.select("_v", ((F.col("_below") + 0.5 * F.col("_n")) / F.col("_all")).alias(out))
    return df.join(ranks, df[metric] == ranks["_v"], "left").drop("_v").withColumn(out, F.coalesce(out, F.lit(0.0)))


def rigor(repos: DataFrame, weights: dict[str, float], group: str, most: int) -> DataFrame:
    """Weighted sum of mid-rank percentiles, and the `most` highest of each group."""
    rows = repos
    for metric in weights:
        rows = mid_rank(rows, metric, f"_{metric}")
    total = sum((F.col(f"_{m}") * w for m, w in weights.items()), F.lit(0.0))
    rows = rows.withColumn("rigor", F.round(total, 6))
    turn = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("rigor"), "repo"))
    return rows.withColumn("rank", turn).filter(F.col("rank") <= most).select(group, "rank", "repo", "rigor")


def production_metrics(findings: DataFrame) -> DataFrame:
    """findings (policy, weight, outcome, confirmed, thumbs_down) -> acted-on, thumbs-down and dismissal rates."""
    acted = (F.col("outcome") == "fixed") & F.col("confirmed")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return findings.groupBy("policy").agg(
        F.count("*").alias("findings"), F.round(F.sum(F.when(acted, F.col("weight")).otherwise(0.0)) / F.sum("weight"), 6).alias("acted_on"),
        share(F.col("thumbs_down")).alias("thumbs_down"), share(F.col("outcome") == "resolved_no_change").alias("dismissed"),
    )


def rollback(findings: DataFrame, old: str, new: str, window: int, acted_margin: float, down_margin: float, z: float = 1.6448536269514722) -> DataFrame:
    """First `window` findings of the new policy against the last of the old: one-sided two-proportion tests."""
    acted = ((F.col("outcome") == "fixed") & F.col("confirmed")).cast("int").alias("acted")
    pick = lambda policy, order: findings.filter(F.col("policy") == policy).orderBy(*order).limit(window).select(acted, F.col("thumbs_down").cast("int").alias("down"))
    sums = lambda rows, p: rows.agg(F.count("*").alias(f"{p}_n"), F.sum("acted").alias(f"{p}_acted"), F.sum("down").alias(f"{p}_down"))
    both = sums(pick(old, [F.desc("at"), F.desc("id")]), "old").crossJoin(sums(pick(new, ["at", "id"]), "new"))  # one row each

    def worse(kind: str, sign: int, margin: float) -> Column:
        p, q = F.col(f"old_{kind}") / F.col("old_n"), F.col(f"new_{kind}") / F.col("new_n")
        pooled = (F.col(f"old_{kind}") + F.col(f"new_{kind}")) / (F.col("old_n") + F.col("new_n"))
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("old_n") + 1 / F.col("new_n")))
        change = sign * (p - q)
        return F.coalesce((change >= margin) & (error > 0) & (change / error > z), F.lit(False))

    return both.withColumns({"acted_drops": worse("acted", 1, acted_margin), "down_rises": worse("down", -1, down_margin)})


def lesson_stage(firings: DataFrame, today: Column) -> DataFrame:
    """firings (lesson, repo, at, acted, down) -> candidate, recurring, strong or retired by its own record."""
    average = firings.agg(F.avg(F.col("acted").cast("double")).alias("_a"), F.avg(F.col("down").cast("double")).alias("_d"))
    rows = firings.groupBy("lesson").agg(
        F.count("*").alias("firings"), F.count_distinct("repo").alias("repos"), F.avg(F.col("acted").cast("double")).alias("acted_on"),
        F.avg(F.col("down").cast("double")).alias("down_rate"), F.max("at").alias("last"),
    ).crossJoin(F.broadcast(average))
    good = (F.col("acted_on") >= F.col("_a")) & (F.col("down_rate") <= F.col("_d"))
    retired = ((F.col("firings") >= 10) & (F.col("acted_on") < F.col("_a") / 2)) | (F.datediff(today, F.col("last")) > 90)
    stage = (
        F.when(retired, "retired").when((F.col("firings") >= 20) & (F.col("repos") >= 2) & good, "strong")
        .when((F.col("firings") >= 5) & good, "recurring").otherwise("candidate")
    )
    return rows.select("lesson", "firings", "repos", stage.alias("stage"))


def overfitting(promotions: DataFrame, run: int = 3) -> DataFrame:
    """promotions (ord, validation_delta, test_delta): alarm where validation rose and test fell over `run` promotions.

    Ranks and running sums are taken range by range of ord; a promotion then counts for itself and the `run` - 1 after it.
    """
    apart = ((F.col("validation_delta") > 0) & (F.col("test_delta") < 0)).cast("int")
    rows = value_bucket(promotions.withColumns({"_every": F.lit(1), "_apart": apart}), "ord")
    rows = ranked(rows, "_every", F.col("_range"), ["ord"], "_rank", "_size").drop("_size")
    for name in ("validation", "test"):
        delta = f"{name}_delta"
        rows = running_sum(rows, ["_every"], F.col("_range"), ["_rank"], delta, "_before", "_whole").withColumn(f"{name}_total", F.col("_before") + F.col(delta)).drop("_before", "_whole")
    recent = rows.select(F.explode(F.sequence(F.col("_rank"), F.col("_rank") + run - 1)).alias("_rank"), "_apart").groupBy("_rank").agg(F.sum("_apart").alias("_n"))
    found = rows.join(recent, "_rank").withColumn("alarm", F.col("_n") == run)
    return found.select(*promotions.columns, "validation_total", "test_total", "alarm")


def concentration(rows: DataFrame, group: str, member: str, cap: float) -> DataFrame:
    """Each member's share of its group, and the factor that brings it down to the cap."""
    counts = rows.groupBy(group, member).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(group))
    return counts.withColumn("share", share).withColumn("factor", F.least(F.lit(1.0), F.lit(cap) / F.col("share")))


def capped_weights(rows: DataFrame, group: str, member: str, weight: str, cap: float) -> DataFrame:
    """(group, member, weight, share, factor, capped_share): factors that bring each member's share down to the cap.

    Weights above a level are taken down to it, so that after that none has a share over the cap: with k members over the
    level and R the weight of the rest, it is cap R / (1 - cap k), for the smallest k whose next weight is no higher. Only
    the first 1 / cap members of a group can be over it. If a group has too few members for the cap, all get the least
    weight (equal shares, still over the cap). A null weight counts as 0; a group without weight has null shares.
    """
    most = int(1 / cap) + 1
    weights = rows.groupBy(group, member).agg(F.coalesce(F.sum(weight), F.lit(0.0)).cast("double").alias("weight"))
    totals = weights.groupBy(group).agg(F.sum("weight").alias("_sum"), F.min("weight").alias("_least"), F.count("*").alias("_members"))
    turn = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("weight"), member))
    top = weights.withColumn("_turn", turn).filter(F.col("_turn") <= most).groupBy(group).agg(F.array_sort(F.collect_list(-F.col("weight"))).alias("_top"))
    high = lambda k: F.coalesce(-F.get("_top", k), F.lit(0.0))  # noqa: E731  the weight after the first k
    rest = lambda k: F.col("_sum") + F.aggregate(F.slice("_top", 1, k), F.lit(0.0), lambda s, x: s + x)
    open_ks = F.filter(F.sequence(F.lit(0), F.lit(most)), lambda k: k * cap < 1)
    levels = F.transform(open_ks, lambda k: F.struct((cap * rest(k) / (1 - cap * k)).alias("level"), high(k).alias("next")))
    level = F.get(F.filter(levels, lambda x: x["next"] <= x["level"]), 0)["level"]
    enough = F.col("_members") * cap >= 1
    found = totals.join(top, group).select(group, "_sum", F.when(enough, level).otherwise(F.col("_least")).alias("_level"))
    joined = weights.join(F.broadcast(found) if found.count() <= GROUPS else found, group)
    factor = F.when(F.col("weight") > F.col("_level"), F.col("_level") / F.col("weight")).otherwise(1.0)
    level_sums = joined.groupBy(group).agg(F.sum(F.least("weight", "_level")).alias("_after"))
    joined = joined.join(level_sums, group)
    part = lambda x, whole: F.when(F.col(whole) > 0, x / F.col(whole))
    return joined.select(group, member, "weight", part(F.col("weight"), "_sum").alias("share"), factor.alias("factor"), part(F.least("weight", "_level"), "_after").alias("capped_share"))


def label_report(judged: DataFrame) -> DataFrame:
    """Threads by author kind, outcome and polarity, with totals of each level (null names) and the share of all threads."""
    counts = judged.groupBy("author_kind", "judged_outcome", "polarity").agg(F.count("*").alias("_n"))
    levels = ["author_kind", "judged_outcome", "polarity"]
    named = counts.select(*(F.coalesce(c, F.lit("undecided")).alias(c) for c in levels), "_n")
    rows = named.rollup(*levels).agg(F.sum("_n").alias("threads"))
    total = named.agg(F.sum("_n").alias("_all"))  # one row
    return rows.crossJoin(F.broadcast(total)).select(*levels, "threads", (F.col("threads") / F.col("_all")).alias("share"))


def summary_counts(scored: DataFrame) -> DataFrame:
    """Findings, the share of each credit, PR-rounds and pull requests of a run, in one row."""
    n = lambda name: F.sum((F.col("credit") == name).cast("long")).alias(name)
    return scored.agg(
        F.count("*").alias("findings"), n("tp"), n("vu"), n("fp"), n("neutral"), n("error"),
        F.count_distinct("repo", "number").alias("prs"), F.count_distinct("repo", "number", "round").alias("rounds"),
    )
