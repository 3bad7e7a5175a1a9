"""Ranks inside a few large groups without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, group: str, bucket: Column, order: list, rank: str = "rank", size: str = "group_size") -> DataFrame:
    """df with the 1-based rank of each row inside its group, and the group's size.

    bucket must not decrease in the order (a day for times, a prefix for hashes). Rows are counted per group and
    bucket, running sums over those counts give each bucket's offset, and only a bucket is sorted at a time.
    """
    # one column names group and bucket, nulls as well, so that the offsets' join and the order inside need one exchange
    rows = df.withColumn("_cell", F.struct(F.col(group).alias("g"), bucket.alias("b")))
    counts = rows.groupBy("_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_cell.g").orderBy("_cell.b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("_cell.g")).alias(size))
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy(*order))
    joined = rows.join(offsets, "_cell").withColumn(rank, F.col("_before") + inside)
    return joined.select(*df.columns, rank, size)


def running_sum(df: DataFrame, group: list[str], bucket: Column, order: list, value: str, before: str = "before", whole: str = "whole") -> DataFrame:
    """df with the sum of value over the rows before each in its group, and over all of them; bucket as in ranked."""
    rows = df.withColumn("_bucket", bucket)
    sums = rows.groupBy(*group, "_bucket").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_sum").over(earlier), F.lit(0)), whole: F.sum("_sum").over(Window.partitionBy(*group))})
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(sums.drop("_sum"), [*group, "_bucket"])
    return joined.withColumn(before, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).select(*df.columns, before, whole)


def value_bucket(df: DataFrame, value: str, out: str = "_range", cuts: int = 200) -> DataFrame:
    """df with the number of the range that a value without nulls lies in, between approximate quantiles of all."""
    from pyspark.ml.feature import Bucketizer

    found = df.agg(F.percentile_approx(F.col(value).cast("double"), [i / cuts for i in range(1, cuts)])).first()[0] or []
    splits = [-float("inf"), *sorted(set(found)), float("inf")]
    rows = df.withColumn("_as_double", F.col(value).cast("double"))
    return Bucketizer(splits=splits, inputCol="_as_double", outputCol=out).transform(rows).drop("_as_double")


def salted_hash(salt: str, key: Column) -> Column:
    """Hex SHA-256 of salt, a zero character and the key."""
    return F.sha2(F.concat(F.lit(f"{salt}\0"), key), 256)
