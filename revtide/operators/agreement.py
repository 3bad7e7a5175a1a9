"""Agreement between labelers. Undefined statistics are null."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cohen(pairs: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """pairs (truth, verdict) -> n, accuracy and Cohen's kappa, overall or per group."""
    groups = groups or []
    cells = pairs.groupBy(*groups, "truth", "verdict").agg(F.count("*").alias("n"))
    total = cells.groupBy(*groups).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("verdict"), F.col("n")).otherwise(0)).alias("same"))
    rows = cells.groupBy(*groups, F.col("truth").alias("c")).agg(F.sum("n").alias("a"))
    columns = cells.groupBy(*groups, F.col("verdict").alias("c")).agg(F.sum("n").alias("b"))
    chance = rows.join(columns, [*groups, "c"]).groupBy(*groups).agg(F.sum(F.col("a") * F.col("b")).alias("chance"))
    joined = total.join(chance, groups, "left") if groups else total.crossJoin(chance)  # one row each
    observed, expected = F.col("same") / F.col("n"), F.coalesce("chance", F.lit(0)) / (F.col("n") * F.col("n"))
    kappa = F.when(expected < 1, (observed - expected) / (1 - expected))
    return joined.filter("n > 0").select(*groups, "n", observed.alias("accuracy"), kappa.alias("kappa"))


def fleiss(ratings: DataFrame) -> DataFrame:
    """ratings (item, category) -> Fleiss' kappa with each item's own number of raters; items with one rating are left out."""
    counts = ratings.groupBy("item", "category").agg(F.count("*").alias("c"))
    items = counts.groupBy("item").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("agree")).filter("n >= 2")
    observed = items.agg(F.count("*").alias("items"), F.avg(F.col("agree") / (F.col("n") * (F.col("n") - 1))).alias("observed"))
    shares = counts.join(items.select("item"), "item", "left_semi").groupBy("category").agg(F.sum("c").alias("c"))
    expected = shares.agg((F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("expected"))
    kappa = F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected")))
    return observed.crossJoin(expected).select("items", "observed", kappa.alias("kappa"))  # one row each


def consistency(ratings: DataFrame) -> DataFrame:
    """ratings (item, category) of repeated judgments -> share of unanimous items and of agreeing pairs."""
    counts = ratings.groupBy("item", "category").agg(F.count("*").alias("c"))
    items = counts.groupBy("item").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("agree"), F.count("*").alias("kinds"))
    return items.filter("n >= 2").agg(
        F.avg((F.col("kinds") == 1).cast("double")).alias("unanimous"), (F.sum("agree") / F.sum(F.col("n") * (F.col("n") - 1))).alias("pairs")
    )


def set_f1(reference: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    a = reference.select(*keys).distinct().withColumn("_r", F.lit(1))
    b = candidate.select(*keys).distinct().withColumn("_c", F.lit(1))
    n = a.join(b, keys, "full").agg(F.count("_r").alias("r"), F.count("_c").alias("c"), F.count(F.col("_r") + F.col("_c")).alias("hits"))
    p, q = F.when(F.col("c") > 0, F.col("hits") / F.col("c")), F.when(F.col("r") > 0, F.col("hits") / F.col("r"))
    f = F.when(p + q > 0, 2 * p * q / (p + q)).when(p.isNotNull() & q.isNotNull(), 0.0)
    return n.select(p.alias("precision"), q.alias("recall"), f.alias("f1"))


def latest(labels: DataFrame) -> DataFrame:
    """The last label (by ord) of each labeler, whatever the case of the name, and item."""
    turn = F.row_number().over(Window.partitionBy(F.lower("labeler"), "item").orderBy(F.desc("ord")))
    return labels.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")


def answers(labels: DataFrame) -> DataFrame:
    """Per item the verdict counts, a status (majority, single, tie, unsure) and the answer, null without one."""
    n = lambda v: F.sum((F.col("verdict") == v).cast("long")).alias(v)
    counts = latest(labels).groupBy("item").agg(n("valid"), n("not_valid"), n("unsure"))
    usable = F.col("valid") + F.col("not_valid")
    status = F.when(usable == 0, "unsure").when(usable < 2, "single").when(F.col("valid") == F.col("not_valid"), "tie").otherwise("majority")
    answer = F.when(status.isin("majority", "single"), F.col("valid") > F.col("not_valid"))
    return counts.withColumns({"status": status, "answer": answer})


def inter_annotator(labels: DataFrame) -> DataFrame:
    """One row (method, kappa, labelers, items): Fleiss' kappa of three or more labelers, Cohen's of two; unsure is left out."""
    kept = latest(labels).withColumn("labeler", F.lower("labeler"))
    first, second, labelers = kept.agg(F.min("labeler"), F.max("labeler"), F.count_distinct("labeler")).first()
    usable = kept.filter("verdict <> 'unsure'")
    n = F.lit(labelers).cast("long").alias("labelers")
    if labelers >= 3:
        found = fleiss(usable.select("item", F.col("verdict").alias("category")))
        return found.select(F.lit("fleiss").alias("method"), "kappa", n, "items")
    if labelers == 2:
        one = usable.filter(F.col("labeler") == first).select("item", F.col("verdict").alias("truth"))
        other = usable.filter(F.col("labeler") == second).select("item", "verdict")
        return cohen(one.join(other, "item")).select(F.lit("cohen").alias("method"), "kappa", n, F.col("n").alias("items"))
    return kept.limit(0).agg(F.lit("").alias("method"), F.max(F.lit(None).cast("double")).alias("kappa"), n, F.count("*").alias("items"))
