"""Exchanges of scores and bootstraps: few, small, and with the results that they had."""

from __future__ import annotations

import numpy as np

from revtide.llm import shingles, simhash
from revtide.operators import resampling, scoring
from revtide.params import ScoringParams

FINDING = "repo string, number long, round int, language string, finding_id string, severity string, klass string, gold_id string, judged_severity string, evidence_level int"


def test_tallies_take_one_exchange_and_equal_the_tally_of_scores(spark):
    kinds = ["tp", "vu", "fp", None]
    rows = [("r", k % 7 if k % 29 else None, k % 2, "go", f"f{k:03}", ["important", "nit"][k % 3 % 2], kinds[k % 4], f"g{k % 6}" if k % 5 else None, ["nit", "important", None][k % 3], k % 5) for k in range(300)]
    findings = spark.createDataFrame(rows, FINDING)
    gold = spark.createDataFrame([("r", n, x, "go", f"g{g}", "important", 0.75) for n in range(9) for x in (0, 1) for g in range(4)] + [("r", 1, 0, "go", None, "nit", 1.0)], "repo string, number long, round int, language string, gold_id string, severity string, conf double")
    params = ScoringParams()
    found = scoring.tallies(findings, gold, params)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    scored = scoring.score_findings(findings, gold, params)
    assert scored.count() == 300
    columns = ["repo", "number", "round", "language", "tp", "vu", "fp", "tp_important", "alarms", "gold", "gold_important", "issues"]
    known = "number IS NOT NULL"
    wanted = scoring.tally(scored, gold, params).filter("number > 0 OR issues > 0")  # tally fills a null number with 0
    assert sorted(map(tuple, found.filter(known).select(columns).filter("number > 0").collect())) == sorted(map(tuple, wanted.select(columns).filter("number > 0").collect()))
    assert found.filter("number = 8").count() == 2  # gold only


def test_draws_are_packed_small_and_whole():
    rng = np.random.default_rng(1)
    for n, drawn in ((40_000, 40_000), (40_000, 500), (3, 3), (10, 5_000), (16_384, 16_384)):
        places = rng.integers(0, n, drawn)
        found = np.zeros(-(-n // resampling.RANGE) * resampling.RANGE, np.int64)
        size = 0
        for k, draws in resampling.packed(places, n):
            found[k * resampling.RANGE : (k + 1) * resampling.RANGE] += resampling.unpacked(draws)
            size += len(draws)
        assert (found[:n] == np.bincount(places, minlength=n)).all() and not found[n:].any()
        assert drawn < 10_000 or size < drawn / 2  # were two bytes a draw


def test_near_duplicates_need_no_fingerprints(spark, monkeypatch):
    """The prefix filter finds every link, so no other index runs before it."""

    def unused(*_):
        raise AssertionError("fingerprints were taken")

    monkeypatch.setattr(simhash, "near_duplicates", unused)
    words = [f"w{k}" for k in range(100)]
    texts = [" ".join(words), " ".join([*words[:-2], "x", "y"]), " ".join(words[::-1]), None]
    kept = shingles.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
