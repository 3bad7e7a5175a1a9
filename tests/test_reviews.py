"""Rules of the review, path and ranking operators on small tables of our own."""

import pytest
from pyspark.sql import functions as F

from revtide.operators import paths, ranking, reviews

PR = "repo string, number long"


@pytest.mark.parametrize(
    "glob, path, fits",
    [
        ("src/**/*.py", "src/a.py", True), ("src/**/*.py", "src/x/y/a.py", True), ("src/*.py", "src/x/a.py", False), ("a?.py", "ab.py", True), ("a?.py", "a/.py", False),
        ("docs/**", "docs/a/b", True), ("a.py", "axpy", False), ("a.py", "a.py\n", False),
    ],
)
def test_globs(spark, glob, path, fits):
    assert spark.range(1).select(paths.in_scope(F.lit(path), [glob])).first()[0] is fits


def test_exclusion_wins_and_no_globs_is_everything(spark):
    one = spark.range(1)
    assert one.select(paths.in_scope(F.lit("src/a.py"), [])).first()[0] is True
    assert one.select(paths.in_scope(F.lit("src/a.py"), ["src/**", "!**/a.py"])).first()[0] is False
    assert one.select(paths.in_scope(F.lit("src/b.py"), ["!**/a.py"])).first()[0] is True


def test_tests_and_subjects_share_a_stem(spark):
    names = {"x/_ridge.py": False, "tests/ridge.py": True, "x/test_ridge.py": True, "x/ridge.test.ts": True, "x/RidgeTest.java": True, "x/contest.py": False}
    for path, expected in names.items():
        row = spark.range(1).select(paths.is_test(F.lit(path)), paths.stem(F.lit(path))).first()
        assert row[0] is expected and (row[1] == "ridge" or path.endswith("contest.py")), path


@pytest.mark.parametrize("a, b, steps", [("a/b/x", "a/b/y", 0), ("a/b/x", "a/c/y", 2), ("x", "a/b/y", 2), ("a/x", "a/b/c/y", 2), ("x", "y", 0)])
def test_steps_between_folders(spark, a, b, steps):
    assert spark.range(1).select(paths.distance(F.lit(a), F.lit(b))).first()[0] == steps


def test_near_tests_take_the_closest_and_leave_changed_ones(spark):
    changed = spark.createDataFrame([(1, "src/a.py"), (1, "src/test_a.py")], "pr long, path string")
    tree = spark.createDataFrame([(1, p) for p in ("src/test_a.py", "tests/test_a.py", "src/tests/a_test.py", "q/w/e/r/t/test_a.py", "tests/test_b.py")], "pr long, path string")
    got = [(r.path, r.distance) for r in paths.near_tests(changed, tree, 5).orderBy("rank").collect()]
    assert got == [("src/tests/a_test.py", 1), ("tests/test_a.py", 2)]


def test_reviewed_commit_falls_back(spark):
    prs = spark.createDataFrame([("r", n, "ann", f"h{n}") for n in range(1, 6)], f"{PR}, author string, head string")
    rows = [
        ("r", 1, "ann", "User", "own", "1"), ("r", 1, "joe", "User", "human", "3"), ("r", 1, "some-bot", "Bot", "bot", "2"), ("r", 2, "some-bot", "Bot", "bot", "2"),
        ("r", 2, "ann", "User", "own", "1"), ("r", 3, "joe", "User", None, "1"), ("r", 3, "joe", "User", "late", None),
    ]
    seen = spark.createDataFrame(rows, f"{PR}, login string, login_type string, commit string, submitted_at string")
    anchors = spark.createDataFrame([("r", 3, "a2", "2"), ("r", 3, "a1", "1"), ("r", 4, None, "1")], f"{PR}, commit string, created_at string")
    got = {r.number: r.commit for r in reviews.reviewed_commits(prs, seen, anchors).collect()}
    assert got == {1: "human", 2: "own", 3: "a1", 4: "h4", 5: "h5"}


def test_target_round_is_the_latest_one_with_the_code(spark):
    issues = spark.createDataFrame([("r", 1, "a", 3), ("r", 1, "b", 2), ("r", 1, "c", None), ("r", 1, "d", 2)], f"{PR}, issue_id string, opened_in int")
    replayed = spark.createDataFrame([("r", 1, 1), ("r", 1, 2)], f"{PR}, round int")
    present = spark.createDataFrame([("r", 1, i, n) for i, n in (("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 1), ("c", 2), ("d", 3))], f"{PR}, issue_id string, round int")
    assert {r.issue_id: r.target_round for r in reviews.target_rounds(issues, replayed, present).collect()} == {"a": 2, "b": 1, "c": 1, "d": None}


def test_deciding_compare(spark):
    threads = spark.createDataFrame([("r", 1, "t1", "p", "x"), ("r", 1, "t2", "q", "x"), ("r", 1, "t3", "p", "y"), ("r", 1, "t4", "p", None), ("r", 1, "t5", "p", "z")], f"{PR}, thread_id string, path string, anchor string")
    compares = spark.createDataFrame([("r", 1, "1", "x", False, True), ("r", 1, "2", "x", True, True), ("r", 1, "3", "x", True, False), ("r", 1, "4", "y", False, False)], f"{PR}, compare_id string, base string, direct boolean, complete boolean")
    files = spark.createDataFrame([("r", 1, "3", "p"), ("r", 1, "1", "q")], f"{PR}, compare_id string, path string")
    got = {r.thread_id: r.compare_id for r in reviews.deciding_compares(threads, compares, files).collect()}
    assert got == {"t1": "3", "t2": "2", "t3": "4", "t4": None, "t5": None}


def test_review_flags_of_empty_and_own_reviews(spark):
    prs = spark.createDataFrame([("r", 1, "ann"), ("r", 2, None)], f"{PR}, author string")
    rows = [("r", 1, "ann", "User", "CHANGES_REQUESTED"), ("r", 1, "copilot", "User", "COMMENTED"), ("r", 2, "joe", "User", "CHANGES_REQUESTED")]
    seen = spark.createDataFrame(rows, f"{PR}, login string, login_type string, state string")
    got = {r.number: (r.by_human, r.by_ai, r.changes_requested) for r in reviews.review_flags(prs, seen).collect()}
    assert got == {1: (False, True, False), 2: (True, False, True)}
    assert {tuple(r)[3:] for r in reviews.review_flags(prs, seen.limit(0)).collect()} == {(False, False, False)}


FINDING = f"{PR}, round int, finding_id string, head string, path string, start_line int, end_line int, title string, body string, category string, severity string, bucket string, confidence double, consensus boolean, evidence_level int"


def finding(i, severity="important", bucket="act_on", confidence=0.9, category="logic", title="same", line=1):
    return ("r", 1, 1, i, "h", "p", line, line, title, None, category, severity, bucket, confidence, False, 1)


def test_ranks(spark):
    rows = [
        finding("a"), finding("b", category="style"), finding("c", confidence=0.1), finding("d", severity="nit"), finding("e", bucket="consider", category=None),
        *[finding(f"n{i}", bucket="consider", confidence=0.8) for i in range(3)], finding("z", bucket="dismissed", title="other"),
    ]
    out = {r.finding_id: r for r in ranking.rank_findings(spark.createDataFrame(rows, FINDING), ranking.RankRules()).collect()}
    assert (out["a"].severity, out["a"].bucket, out["a"].rank) == ("important", "act_on", 1)
    assert [out[i].bucket for i in "bcde"] == ["consider", "noted", "consider", "consider"] and out["b"].severity == out["e"].severity == "nit"
    assert [out[f"n{i}"].bucket for i in range(3)] == ["noted"] * 3 and out["z"].rank == 9
    assert out["b"].stable_id == out["a"].stable_id + "x" and len({r.stable_id for r in out.values()}) == 9


def test_similar_pairs_need_place_and_words(spark):
    rows = [finding("a", title="null pointer here"), finding("b", title="null pointer there", line=4), finding("c", title="null pointer here", line=40), finding("d", title="other matter"), finding("e", title=None)]
    got = [(r.a, r.b, round(r.overlap, 3)) for r in ranking.similar_pairs(spark.createDataFrame(rows, FINDING), 3).collect()]
    assert got == [("a", "b", 0.5)]


def test_suppression_spares_high_risk(spark):
    rules = [{"id": "l1", "categories": ["logic", "security"], "paths": ["p"], "pattern": "sam"}, {"id": "l2", "categories": ["logic"], "paths": [], "pattern": "."}]
    rows = [finding("a"), finding("b", category="security"), finding("c", title="x"), finding("d", category=None)]
    got = {r.finding_id: (r.lesson, r.bucket) for r in ranking.suppressed(spark.createDataFrame(rows, FINDING), rules, ["security"]).collect()}
    assert got == {"a": ("l1", "dismissed"), "b": (None, "act_on"), "c": ("l2", "dismissed"), "d": (None, "act_on")}


def test_rates_of_nothing(spark):
    rounds = spark.createDataFrame([], "proposed long, malformed long")
    row = ranking.well_formed(rounds, spark.createDataFrame([], "severity string, anchored boolean")).first()
    assert (row.parsed, row.parse_rate, row.anchor_rate) == (0, 1.0, 1.0)
    empty = spark.createDataFrame([], f"{PR}, round int, lessons_cited array<string>, raised_by array<string>")
    assert [tuple(r) for r in ranking.lesson_exposure(empty, ["x"]).collect()] == [("x", 0)]


def test_lessons_fire_once_a_round(spark):
    rows = [("r", 1, 1, ["x", "x"], ["check:x"]), ("r", 1, 1, ["x"], ["reader"]), ("r", 1, 2, [], ["check:x", "check:y"])]
    findings = spark.createDataFrame(rows, f"{PR}, round int, lessons_cited array<string>, raised_by array<string>")
    assert {r.lesson: r.fired for r in ranking.lesson_exposure(findings, ["x", "y", "z"]).collect()} == {"x": 2, "y": 1, "z": 0}
