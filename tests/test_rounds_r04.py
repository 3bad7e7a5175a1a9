"""Repeated findings are merged apart from the many that nothing repeats."""

from __future__ import annotations

from revtide.operators import ranking

SCHEMA = "repo string, number long, round int, ord long, finding_id string, path string, start_line int, end_line int, title string, body string, trace string, severity string, raised_by array<string>, lessons_cited array<string>"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def row(number, ord, name, path="a.py", start=5, title="Missing bound check", severity="nit"):
    return ("r", number, 1, ord, name, path, start, start + 1, title, "Wrong", None, severity, [f"by {name}", f"by {name}"], [])


def test_findings_of_a_path_are_dealt_once(spark):
    rows = spark.createDataFrame([row(1, k, f"f{k}", start=5 + 4 * k) for k in range(6)] + [row(1, 9, "x", path="b.py"), row(None, 9, "y"), row(None, 10, "z")], SCHEMA)
    pairs = ranking.similar_pairs(rows, 5)
    assert plan(pairs).count("Exchange hashpartitioning") == 1
    assert sorted((r.a, r.b, r.overlap) for r in pairs.collect()) == [(f"f{k}", f"f{j}", 1.0) for k in range(6) for j in range(k + 1, 6) if j - k == 1]


def test_only_repeats_are_dealt_by_group(spark):
    far = [row(1, k, f"f{k}", start=100 * k) for k in range(50)]
    rows = spark.createDataFrame([*far, row(1, 60, "g", start=301, severity="important"), row(None, 1, "n"), row(1, 70, "f7", start=700)], SCHEMA)
    merged = ranking.merge_duplicates(rows, 5)
    windows = [line for line in plan(merged).splitlines() if "Window" in line]
    assert windows and not any("_group" in line and "path" in line for line in windows)
    found = {r.finding_id: sorted(r.raised_by) for r in merged.collect()}
    assert found.pop("g") == ["by f3", "by g"] and found.pop("n") == ["by n"]  # rows of one name are one finding
    assert found == {f"f{k}": [f"by f{k}"] for k in range(50) if k != 3}
