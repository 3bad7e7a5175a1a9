"""Steps whose work has to stay small on large tables."""

from __future__ import annotations

from revtide.operators import ranking


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounds_are_merged_in_a_stream(spark):
    """No Python call a round; the groups of a round that several batches hold are those of one, and no ord comes last."""
    schema = "repo string, number long, round int, ord long, finding_id string, path string, start_line int, end_line int, title string, body string, trace string, severity string, raised_by array<string>, lessons_cited array<string>"
    row = lambda number, ord, name: ("r", number, 1, ord, name, "a.py", 5, 6, "Missing bound check", "Wrong", None, "nit", [name], [])
    rows = spark.createDataFrame([row(n, o, f"f{n}{k}") for n in range(4) for k, o in enumerate((None, 3, 2, 5, 4, 1, 6))], schema)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        merged = ranking.merge_duplicates(rows, 5)
        assert "FlatMapGroupsInPandas" not in plan(merged)
        found = {r.number: sorted(r.raised_by) for r in merged.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == {n: [f"f{n}{k}" for k in range(7)] for n in range(4)}
