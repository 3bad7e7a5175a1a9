"""References read symbols back."""

from __future__ import annotations

from pyspark.sql import functions as F

from revtide.operators import symbols


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_references_find_symbols_once(spark):
    """Neither result finds the symbols anew: what is told of them is read back."""
    files = spark.createDataFrame([(1, "a.py", "call load_x(); h.hpp"), (1, "b.py", "load_x"), (1, "c.py", "h-hpp")], "number int, path string, text string")
    asked = spark.range(2).select(F.lit(1).alias("number"), F.udf(lambda k: ("load_x", "h.hpp")[k])("id").alias("name"))
    hits, dropped = symbols.references(asked, files, files.select("number", "path").limit(0), ["number"], 1)
    assert sorted((r.path, r.hits, r.names) for r in hits.collect()) == [("a.py", 1, ["h.hpp"])]
    assert [(r.name, r.files) for r in dropped.collect()] == [("load_x", 2)]
    assert not any("EvalPython" in plan(df) for df in (hits, dropped))
