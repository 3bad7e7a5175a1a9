"""Rows that may be among others by key, and the steps that let them go before they are dealt out."""

from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__
from revtide.functions.members import may_be_among

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_equal_row_goes_and_most_others_do(spark):
    rows = spark.range(20_000).select((F.col("id") % 11).cast("int").alias("repo"), F.col("id").alias("number"))
    rows = rows.unionByName(spark.createDataFrame([(None, 1), (1, None)], "repo int, number long"))
    keys = rows.filter("number % 40 = 0").select(F.col("repo").cast("long"), F.col("number").cast("int"))  # other types, equal values
    found = may_be_among(rows, keys, ["repo", "number"])
    assert found.join(keys, ["repo", "number"], "left_semi").count() == keys.count() == 500
    assert found.count() < 600
    assert may_be_among(rows, keys.limit(0), ["repo", "number"]).count() == 0
    # rows go before they are made different
    dealt = plan(may_be_among(rows.distinct(), keys, ["repo", "number"])).splitlines()
    places = [next(k for k, line in enumerate(dealt) if word in line) for word in ("HashAggregate", "BroadcastHashJoin")]
    assert places[0] < places[1]


def test_escaped_defects_deal_out_no_patches(spark):
    """Files of other pull requests go first; what is left of a patch are its hunks' places."""
    defects = __spark_entry__.queries()["o13_escaped_defects"](spark, DATA)
    text = plan(defects)
    assert "ArrowEvalPython" not in text and "chr(10)" not in text and "@@" not in "".join(line for line in text.splitlines() if "Exchange" in line)
