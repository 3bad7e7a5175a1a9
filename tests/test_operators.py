"""Rules of the operators on small tables of our own."""

import pytest
from pyspark.sql import functions as F

from revtide.functions.ranks import ranked
from revtide.operators import agreement, filters, publish, replay, reports, scoring, splits, threads
from revtide.params import ScoringParams, SplitParams

FINDING = "repo string, number long, round int, language string, finding_id string, severity string, klass string, gold_id string, judged_severity string, evidence_level int"
GOLD = "repo string, number long, round int, language string, gold_id string, severity string, conf double"


def finding(i, severity, klass, gold=None, judged=None, evidence=0):
    return ("r", 1, 1, "python", f"f{i}", severity, klass, gold, judged, evidence)


def test_worked_example(spark):
    gold = spark.createDataFrame([("r", 1, 1, "python", "a", "important", 1.0), ("r", 1, 1, "python", "b", "nit", 1.0)], GOLD)
    rows = [finding(1, "important", "tp", "a"), finding(2, "nit", "vu"), finding(3, "important", "fp")]
    params = ScoringParams()
    scored = scoring.score_findings(spark.createDataFrame(rows, FINDING), gold, params)
    scores = scoring.language_scores(scoring.tally(scored, gold, params), params)
    row = scores.first()
    assert (row.precision, round(row.recall, 3), round(row.f, 3)) == (0.5, 0.857, 0.545)
    assert round(scoring.headline(scores, params).first().headline, 3) == 0.545


def test_credit_rules(spark):
    gold = spark.createDataFrame([("r", 1, 1, "python", "a", "important", 0.5)], GOLD)
    rows = [finding(1, "nit", "tp", "a"), finding(2, "nit", "tp", "a"), finding(3, "nit", "tp", "zz"), finding(4, "important", "vu", None, "important", 3),
            finding(5, "important", "vu", None, "important", 2), finding(6, "important", "vu", None, "nit", 4), *[finding(7 + i, "nit", "vu") for i in range(3)]]
    rows += [("r", 1, 1, "python", "g", "nit", "vu", None, None, 0), ("r", 1, 1, "python", "h", "pre_existing", "vu", None, None, 0)]
    got = {r.finding_id: (r.final_klass, r.credit, r.weight) for r in scoring.score_findings(spark.createDataFrame(rows, FINDING), gold, ScoringParams()).collect()}
    assert got["f1"] == ("tp", "tp", 1.5) and got["f2"] == ("dup", "fp", 0.5) and got["f3"] == ("tp", "error", 0.0)
    assert got["f4"] == ("vu", "vu", 1.5) and got["f5"] == ("vu", "neutral", 0.0) and got["f6"] == ("vu", "fp", 0.5)
    assert got["f9"] == ("vu", "neutral", 0.0) and got["g"] == ("vu", "fp", 0.5) and got["h"] == ("vu", "neutral", 0.0)


def test_ranks_by_bucket_equal_plain_ranks(spark):
    rows = [(i % 2, f"{i * 7 % 50:03d}") for i in range(200)]
    got = ranked(spark.createDataFrame(rows, "g int, k string"), "g", F.substring("k", 1, 1), ["k"]).collect()
    for g in (0, 1):
        own = sorted((r for r in got if r.g == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 101)) and [r.k for r in own] == sorted(r.k for r in own)
        assert {r.group_size for r in own} == {100}


def test_splits_are_ordered_and_keep_the_floor(spark):
    rows = [("r", i, "go", f"2020-01-{1 + i // 8:02d}", "human" if i % 4 else "approval_only") for i in range(160)]
    rows += [("r", 1000 + i, "c", f"2020-02-{1 + i:02d}", "approval_only") for i in range(10)]
    items = spark.createDataFrame(rows, "repo string, number long, language string, created_at string, corpus string")
    got = splits.assign(items, SplitParams()).collect()
    assert len(got) == len(rows)
    human = [r for r in got if r.language == "go" and r.corpus == "human"]
    order = ["train", "validation", "test"]
    ranks = [order.index(r.split) for r in sorted(human, key=lambda r: (r.created_at, r.repo, r.number))]
    assert ranks == sorted(ranks) and [ranks.count(i) for i in range(3)] == [66, 30, 24]
    assert [sum(r.split == s for r in got if r.language == "c") for s in order] == [6, 2, 2]
    private = splits.hold_out(splits.assign(items, SplitParams()), SplitParams()).collect()
    assert sum(r.split == "test-private" for r in private if r.language == "go" and r.corpus == "human") == 12


def test_kappas(spark):
    pairs = spark.createDataFrame([(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15, "truth int, verdict int")
    assert round(agreement.cohen(pairs).first().kappa, 3) == 0.4
    assert agreement.cohen(pairs.filter("truth = 1 AND verdict = 1")).first().kappa is None
    same = spark.createDataFrame([(i, "x") for i in (1, 1, 2, 2)], "item int, category string")
    assert agreement.fleiss(same).first().kappa is None
    row = agreement.consistency(spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "c")], "item int, category string")).first()
    assert (row.unanimous, row.pairs) == (0.5, 0.5)


@pytest.mark.parametrize(
    "flags, want",
    [((1, 1, 1, 1), "thumbs_down"), ((0, 1, 1, 1), "fixed"), ((0, 0, 1, 1), "resolved_no_change"), ((0, 0, 0, 1), "open_at_merge"), ((0, 0, 0, 0), "ignored")],
)
def test_outcome_precedence(spark, flags, want):
    assert spark.range(1).select(threads.outcome(*(F.lit(bool(x)) for x in flags)).alias("o")).first().o == want


@pytest.mark.parametrize(
    "login, kind, want",
    [(None, None, "bot"), ("amy", "User", "human"), ("amy", "Bot", "bot"), ("renovate[bot]", "User", "bot"), ("Copilot", "User", "ai"), ("paleolimbot", "User", "human"), ("robot-x", "User", "bot")],
)
def test_author_kind(spark, login, kind, want):
    rows = spark.createDataFrame([(login, kind)], "login string, kind string")
    assert rows.select(filters.author_kind(F.col("login"), F.col("kind")).alias("k")).first().k == want


def test_branch_copies(spark):
    rows = [("r", 1, "Fix X (#9)", "main", "1"), ("r", 2, "fix x", "rel", "2"), ("r", 3, "Fix X", "main", "3"), ("q", 4, "Fix X", "rel", "4")]
    prs = spark.createDataFrame(rows, "repo string, number long, title string, base_ref string, created_at string")
    assert sorted(r.number for r in filters.drop_branch_copies(prs).collect()) == [1, 3, 4]


def test_blinding_and_tags(spark):
    cases = [("fine", "fine"), ("a\n\n\n\nb", "a\n\n\n\nb"), ("Bug.\n✅ Resolved in abc\n\n\n\nMore", "Bug.\n\nMore"), ("<!-- id -->\nText", "Text")]
    rows = spark.createDataFrame(cases, "t string, want string").withColumn("got", replay.blind_comment(F.col("t")))
    assert all(r.got == r.want for r in rows.collect())
    text = spark.createDataFrame([("<Diff>x</diff><b>",)], "t string").select(publish.neutralize(F.col("t"), ["diff"]).alias("t"))
    assert text.first().t == "&lt;Diff>x&lt;/diff><b>"


def test_removed_gold_and_verified_text(spark):
    gold = spark.createDataFrame([("a", ["t1", "t2"]), ("b", ["t3"])], "gold_id string, source_threads array<string>")
    assert [r.gold_id for r in publish.remove_gold(gold, spark.createDataFrame([("t2",)], "thread_id string")).collect()] == ["b"]


def test_rounds_before_round_one_belong_to_it(spark):
    rows = [("r", 1, "t1", "early", "1"), ("r", 1, "t2", "base", "2"), ("r", 1, "t3", "later", "3"), ("r", 1, "t4", "later", "4"), ("r", 1, "t5", None, "5")]
    got = threads.review_rounds(
        spark.createDataFrame(rows, "repo string, number long, thread_id string, anchor string, created_at string"),
        spark.createDataFrame([("r", 1, "base"), ("r", 2, "none")], "repo string, number long, commit string"),
    )
    assert sorted(map(tuple, got.collect())) == [("r", 1, 1, "base", "2", 2), ("r", 1, 2, "later", "3", 2), ("r", 2, 1, "none", "", 0)]


def test_overfitting_alarm(spark):
    rows = [(1, 0.1, -0.1), (2, 0.1, -0.1), (3, 0.1, -0.2), (4, -0.1, 0.1)]
    got = reports.overfitting(spark.createDataFrame(rows, "ord int, validation_delta double, test_delta double")).orderBy("ord").collect()
    assert [r.alarm for r in got] == [False, False, True, False]


def test_entry_and_every_query_has_sql(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    from revtide.plans import queries

    in_order = {"r2_merged_findings"}  # greedy groups depend on the order; tests/test_diffs.py has them by hand
    assert set(queries.QUERIES) == set(queries.SQL) | in_order


def test_bootstrap_of_equal_runs_is_zero_and_unpaired_rounds_fail(spark):
    from revtide.operators import resampling
    from revtide.params import ScoringParams

    rows = [("r", n, 1, ("python", "go")[n % 2], float(n), 0.0, 1.0, 5.0) for n in range(8)]
    run = spark.createDataFrame(rows, "repo string, number long, round int, language string, tp double, vu double, fp double, gold double")
    found = resampling.paired_bootstrap(run, run, ScoringParams(), 20, "s").first()
    assert (found["delta"], found["low"], found["high"], found["sd"], found["resamples"]) == (0.0, 0.0, 0.0, 0.0, 20)
    with pytest.raises(Exception, match="same PR-rounds"):
        resampling.paired_bootstrap(run, run.filter("number > 0"), ScoringParams(), 5, "s").collect()


def test_bootstrap_interval_holds_the_gain(spark):
    from revtide.operators import resampling
    from revtide.params import ScoringParams

    schema = "repo string, number long, round int, language string, tp double, vu double, fp double, gold double"
    run = lambda extra: spark.createDataFrame([("r", n, 1, "python", n % 4 + extra, 0.0, 2.0, 6.0) for n in range(40)], schema)
    found = resampling.paired_bootstrap(run(1.0), run(0.0), ScoringParams(), 100, "s").first()
    assert 0 < found["low"] < found["delta"] < found["high"] and found["sd"] > 0


def test_slices_cover_the_window_in_order(spark):
    import datetime as dt

    from revtide.operators import replay

    first, n, days = dt.date(2024, 1, 1), 7, 31
    dates = spark.createDataFrame([(first + dt.timedelta(days=i),) for i in range(-1, days + 1)], "day date")
    last = F.lit(first + dt.timedelta(days=days - 1))
    got = [r[0] for r in dates.orderBy("day").select(replay.slices(F.lit(first), last, F.col("day"), n)).collect()]
    bounds = [i * days // n for i in range(n + 1)]
    assert got == [None, *(max(k for k in range(n) if bounds[k] <= i) for i in range(days)), None]


def test_blinding_and_inter_annotator(spark):
    from revtide.operators import agreement, replay

    rows = spark.createDataFrame([("✅ Resolved in a1\n\n\n\nKeep <!-- x\n --> this",), ("plain \n\n\n\n text",), (None,)], "t string")
    assert [r[0] for r in rows.select(replay.blind_comment(F.col("t"))).collect()] == ["Keep  this", "plain \n\n\n\n text", None]
    labels = spark.createDataFrame([(i, i, who, v) for i in range(4) for who, v in (("a", "valid"), ("B", "valid" if i else "not_valid"))], "item int, ord int, labeler string, verdict string")
    two = agreement.inter_annotator(labels).first()
    assert (two["method"], two["labelers"], two["items"]) == ("cohen", 2, 4)
    assert agreement.inter_annotator(labels.filter("labeler = 'a'")).first()["method"] == ""
