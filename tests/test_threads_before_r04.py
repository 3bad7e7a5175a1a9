"""Threads before a pull request: one order a path, by few exchanges, and alike for paths that are sorted a day at a time."""

from __future__ import annotations

import numpy as np
import pytest

from revtide.operators import threads


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("large", [65_536, 60, 0])
def test_threads_before_equal_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(threads, "LARGE", large)
    monkeypatch.setattr(threads, "SAMPLED", 1)
    rng = np.random.default_rng(4)
    paths = [None, *("a" * 20), "b", "c", "d"]
    at = lambda: None if rng.integers(30) == 0 else f"2020-01-{1 + rng.integers(9):02d} {rng.integers(3):02d}"
    known = [("r", paths[rng.integers(len(paths))], f"t{rng.integers(90)}", at()) for _ in range(200)]
    asked = [("r", n, paths[rng.integers(len(paths))], at()) for n in range(60)]
    want = set()
    for r, n, p, t in asked:
        before = [(x, y) for _, q, y, x in known if p is not None and q == p and t is not None and x is not None and x < t]
        before.sort(key=lambda x: x[1])
        before.sort(key=lambda x: x[0], reverse=True)
        want |= {(r, n, p, y, k + 1) for k, (_, y) in enumerate(before[:3])}
    rows = spark.createDataFrame(known, "repo string, path string, thread_id string, created_at string")
    prs = spark.createDataFrame(asked, "repo string, number long, path string, created_at string")
    found = [tuple(r) for r in threads.threads_before(prs, rows, 3).select("repo", "number", "path", "thread_id", "rank").collect()]
    assert set(found) == want and len(found) == len(want) > 60


def test_threads_are_dealt_once(spark):
    rows = spark.createDataFrame([("r", "a", "t", "2020-01-01")], "repo string, path string, thread_id string, created_at string")
    prs = spark.createDataFrame([("r", 1, "a", "2020-01-02")], "repo string, number long, path string, created_at string")
    found = threads._before_in_one_order(prs, rows, 3)
    assert plan(found).count("Exchange hashpartitioning") == 1
    assert [(r.thread_id, r["rank"]) for r in found.collect()] == [("t", 1)]
