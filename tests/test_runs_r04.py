"""Runs that share their findings are dealt once, and meet once."""

from __future__ import annotations

from pyspark.sql import functions as F

from revtide.functions.ranks import ranked
from revtide.operators import resampling, scoring
from revtide.params import ScoringParams

FINDING = "repo string, number long, round int, language string, finding_id string, severity string, klass string, gold_id string, judged_severity string, evidence_level int"
PARAMS = ScoringParams()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def runs_of(spark):
    kinds = ["tp", "vu", "fp", None]
    rows = [("r", k % 7 if k % 29 else None, k % 2, "go", f"f{k:03}", ["important", "nit"][k % 3 % 2], kinds[k % 4], f"g{k % 6}" if k % 5 else None, ["nit", "important", None][k % 3], k % 5) for k in range(300)]
    one = spark.createDataFrame(rows, FINDING)
    two = one.withColumns({"klass": F.expr("CASE WHEN evidence_level = 1 THEN 'tp' ELSE klass END"), "gold_id": F.expr("CASE WHEN evidence_level < 3 THEN 'g1' END")}).filter("number <> 3")
    gold = spark.createDataFrame([("r", n, x, "go", f"g{g}", "important", 0.75) for n in range(9) for x in (0, 1) for g in range(4)], "repo string, number long, round int, language string, gold_id string, severity string, conf double")
    both = one.withColumns({"klass2": F.expr("CASE WHEN evidence_level = 1 THEN 'tp' ELSE klass END"), "gold2": F.expr("CASE WHEN evidence_level < 3 THEN 'g1' END")})
    each = "filter(array(struct(0 AS run, klass, gold_id), CASE WHEN number <> 3 THEN struct(1 AS run, klass2 AS klass, gold2 AS gold_id) END), x -> x IS NOT NULL)"
    return [one, two], both.withColumn("runs", F.expr(each)).drop("klass", "gold_id", "klass2", "gold2"), gold


def test_tallies_of_runs_equal_those_of_each_from_one_exchange(spark):
    single, both, gold = runs_of(spark)
    found = scoring.tallies(both, gold, PARAMS, [0, 1])
    assert plan(found).count("Exchange hashpartitioning") == 1
    for k, run in enumerate(single):
        wanted = scoring.tallies(run, gold, PARAMS)
        own = found.filter(F.col("run") == k).select(wanted.columns)
        assert sorted(map(str, own.collect())) == sorted(map(str, wanted.collect()))


def test_two_runs_meet_in_one_exchange(spark):
    single, _, gold = runs_of(spark)
    c, i = (scoring.tallies(run, gold, PARAMS).filter(f"number IS NOT NULL AND number <> {n}").localCheckpoint() for n, run in zip((8, 1), single))
    both = resampling.met(c, i)
    assert plan(both).count("Exchange hashpartitioning") == 1
    both = both.localCheckpoint()
    common = c.join(i, scoring.ROUND, "left_semi")
    assert sorted(map(str, resampling.side_of(both, "c").select(c.columns).collect())) == sorted(map(str, common.collect()))
    wanted = resampling.pr_sums(common, i.join(c, scoring.ROUND, "left_semi"))
    assert sorted(map(str, resampling.met_sums(both).select(wanted.columns).collect())) == sorted(map(str, wanted.collect()))
    assert both.filter("has_i AND NOT common").count() == i.filter("number = 8").count() > 0


def test_ranks_take_one_exchange_of_the_rows(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 501).alias("v")).withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ranked(rows, "g", F.floor(F.col("v") / 50), ["v"])
        assert sum("Exchange hashpartitioning(_cell" in line for line in plan(found).splitlines()) <= 3  # the rows, their counts, and those joined
        got = sorted((r.g or 0, r.v, r["rank"], r.group_size) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    values = {g: sorted(v for x, v in ((r.g or 0, r.v) for r in rows.collect()) if x == g) for g in (0, 1, 2)}
    assert got == [(g, v, k + 1, len(values[g])) for g in (0, 1, 2) for k, v in enumerate(values[g])]
