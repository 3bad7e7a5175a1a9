"""Writing rules, headlines, lessons, benchmarks and human labels, case by case."""

import json

import pytest
from pyspark.sql import functions as F

from revtide.operators import prose
from revtide.sources import benchmarks


def test_writing_rules(spark):
    texts = [
        "I think it might fail", "`it seems` and ```maybe\nperhaps```", "The lock is required to be taken by then", "It is used. It was never been broken", "a -- b – c", "Mightily", None, "is carefully checked", "was written by the time", "Überprüft: it is ändérted",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", prose.violations(F.col("t")).alias("v")).orderBy("i").collect()
    assert [[tuple(v) for v in r.v] for r in rows] == [
        [("hedging", "I think"), ("hedging", "might")], [], [("passive_voice", "be taken")], [("passive_voice", "been broken")], [("em_dash", " -- "), ("em_dash", "–")], [], [], [("passive_voice", "is carefully checked")], [], [("passive_voice", "is ändérted")],
    ]
    titles = spark.createDataFrame([(0, "Fix it. Now"), (1, "Ends with a dot. "), (2, "e.g. lower"), (3, "x" * 60 + ".")], "i int, t string").select("i", prose.violations(F.col("t"), True).alias("v")).orderBy("i").collect()
    assert [[tuple(v) for v in r.v] for r in titles] == [[("title_sentences", "Fix it. Now")], [("title_period", "Ends with a dot.")], [], [("title_period", "x" * 39 + ".")]]


def test_headlines_up_to_a_round(spark):
    commits = [("r", 1, 0, "a", "2026-01-01", "A"), ("r", 1, 1, "b", "2026-01-03", None), ("r", 1, 2, "c", "2026-01-02", "C"), ("r", 1, 3, "a", None, "A2")]
    rounds = [("r", 1, 1, "c", None), ("r", 1, 2, "x", "2026-01-02"), ("r", 1, 3, "x", None), ("r", 1, 4, "a", "2026-09"), ("r", 2, 1, "a", "2026-09")]
    found = prose.headlines(spark.createDataFrame(commits, "repo string, number long, ord int, oid string, committed_at string, headline string"), spark.createDataFrame(rounds, "repo string, number long, round int, commit string, started_at string"))
    assert sorted((r["round"], r.headline) for r in found.collect()) == [(1, "A"), (1, "C"), (2, "A"), (2, "C"), (4, "A")]


def test_globs_of_a_column(spark):
    cases = [("a/b.py", ["*.py"], False), ("a/b.py", ["**/*.py"], True), ("b.py", ["**/*.py"], True), ("a/b.py", ["!a/**"], False), ("c/b.py", ["!a/**"], True), ("a/b.py", [], True), ("a/b.py", None, True), ("a.b", ["a?b"], True), ("a+b(1)", ["a+b(?)"], True), ("axb", ["a.b"], False)]
    rows = spark.createDataFrame([(i, p, g) for i, (p, g, _) in enumerate(cases)], "i int, p string, g array<string>")
    assert [r.s for r in rows.select("i", prose.scoped(F.col("p"), F.col("g")).alias("s")).orderBy("i").collect()] == [want for *_, want in cases]


def test_a_lesson_without_problems_and_one_with_all(spark):
    schema = "lesson string, kind string, change string, text string, applies_when string, why_not_check string, evidence array<string>, engine string, pattern string, exclude string, select string, paths array<string>"
    good = ("good", "check", "add", "Close every file", None, None, ["a/b#1, a/b#2", "c.d/e-f#3"], "structural_pattern", "close", None, "file", ["*.py"])
    bad = ("bad", "prompt", "add", "Use v2.0 and src/a/b.py since 0a1b2c3d with every open file", "", None, ["a/b#9"], None, None, None, None, None)
    late = ("late", "check", "change", "Use the lock", None, None, ["a/b#1 a/b#2 c.d/e-f#3"], "added_lines_regex", "close", "file", None, None)
    feed = spark.createDataFrame([("a/b", 1, "x"), ("a/b", 2, "y"), ("c.d/e-f", 3, "x")], "repo string, number long, author string")
    files = spark.createDataFrame([("a/b", 1, "m.py", "@@ -1 +1 @@\n-file close\n+file.close()"), ("a/b", 2, "m.go", None)], "repo string, number long, path string, patch string")
    known = spark.createDataFrame([("k", "use every open file with src since"), ("m", "nothing alike")], "lesson string, text string")
    found = prose.lesson_problems(spark.createDataFrame([good, bad, late], schema), feed, files, known, prose.LessonRules()).collect()
    assert {r.lesson for r in found} == {"bad", "late"} and [r.problem for r in found if r.lesson == "late"] == ["the check fires on none of the pull requests it cites"]
    assert sorted(r.problem for r in found if r.lesson == "bad") == sorted([
        "not durable: names a commit hash (0a1b2c3d)", "not durable: names a version number (v2.0)", "not durable: names a file path (src/a/b.py)", "not specific: it does not say when it applies", "cites pull requests outside the feed: 1",
        "evidence of 0 pull requests by 0 authors", "already covered by k", "does not say why no check can express it",
    ])


def written(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_golden_files_become_gold(spark, tmp_path):
    url = "https://github.com/o/r/pull/7"
    one = written(tmp_path / "a.json", [{"pr_title": "T", "url": url, "comments": [{"comment": " Bug ", "severity": "HIGH", "category": "perf"}, {"comment": "x", "severity": "odd", "category": None}]}])
    two = written(tmp_path / "b.json", [{"pr_title": "U", "url": "https://github.com/o/r/pull/8/", "original_url": "z", "comments": []}])
    whole = written(tmp_path / "all.json", {url: {"golden_comments": ["a", "b"]}})
    prs = benchmarks.read_golden(spark, [one, two], whole)
    assert {(r.repo, r.number, r.title, len(r.comments)) for r in prs.collect()} == {("o/r", 7, "T", 2), ("o/r", 8, "U", 0)}
    gold = benchmarks.gold_issues(prs, 0.9).orderBy("ord").collect()
    assert [(g.id, g.severity, g.category, g.description, g.start_line, g.conf) for g in gold] == [("o/r#7:martian-1", "important", "performance", "Bug", 0, 0.9), ("o/r#7:martian-2", "important", "other", "x", 0, 0.9)]
    with pytest.raises(benchmarks.BenchmarkError, match="other golden comments"):
        benchmarks.read_golden(spark, [one], written(tmp_path / "few.json", {url: {"golden_comments": ["a"]}}))
    with pytest.raises(benchmarks.BenchmarkError, match="not in the golden"):
        benchmarks.read_golden(spark, [two], whole)
    with pytest.raises(benchmarks.BenchmarkError, match="address"):
        benchmarks.read_golden(spark, [written(tmp_path / "c.json", [{"url": "http://x.org/1", "comments": []}])])


def test_samples_of_one_pull_request_are_merged(spark, tmp_path):
    url = "https://github.com/o/r/pull/7"
    of = lambda commit, *notes: [{"githubPrUrl": url, "source_commit": "s", "target_commit": commit, "project_main_language": "Go", "comments": [{"note": n, "category": "Performance", "path": "p", "from_line": a, "to_line": b, "side": side} for n, a, b, side in notes]}]
    good, bad = written(tmp_path / "p.json", of("t", ("later", 9, 5, "right"), ("old side", 3, 4, "left"), ("one line", 2, None, None))), written(tmp_path / "n.json", of("t", ("wrong", 1, 1, "right")))
    prs = benchmarks.read_samples(spark, good, bad)
    row = prs.first()
    assert [(c.text, c.valid) for c in row.comments] == [("later", True), ("old side", True), ("one line", True), ("wrong", False)] and (row.language, row.head_commit) == ("Go", "t")
    gold = benchmarks.gold_issues(prs, 1.0).orderBy("ord").collect()
    assert [(g.id[-1], g.start_line, g.end_line, g.severity, g.category) for g in gold] == [("2", 0, 0, "nit", "performance"), ("3", 2, 2, "nit", "performance"), ("1", 5, 9, "nit", "performance")]
    assert benchmarks.read_samples(spark, good).first().comments[-1].valid
    with pytest.raises(benchmarks.BenchmarkError, match="other commits"):
        benchmarks.read_samples(spark, good, written(tmp_path / "m.json", of("u", ("x", 1, 1, "right"))))


def test_golden_entries_are_written_by_repo(spark, tmp_path):
    prs = spark.createDataFrame([("o/r", 2, "B", "u2", "corpus"), ("o/r", 1, "A", "u1", "corpus"), ("p/q", 3, "C", "u3", "corpus"), ("p/q", 4, "D", "u4", "corpus"), ("p/q", 5, "E", "u5", "benchmark")], "repo string, number long, title string, url string, source string")
    gold = spark.createDataFrame([("o/r", 1, 1, "nit", "tests", " t "), ("o/r", 2, 2, "important", "new", "y"), ("o/r", 2, 1, "pre_existing", "auth", "x"), ("o/r", 2, 3, "nit", "style", " "), ("p/q", 3, None, None, None, None)], "repo string, number long, ord int, severity string, category string, description string")
    entries, left = benchmarks.golden_entries(prs, gold)
    assert {r.reason: r.n for r in left.collect()} == {"clean": 1, "no_gold": 1}
    benchmarks.write_golden(entries, str(tmp_path / "g"))
    files = [p for p in (tmp_path / "g").rglob("*.json")]
    assert [p.parent.name for p in files] == ["_repo=o__r"]
    read = [json.loads(line) for line in files[0].read_text().splitlines()]
    assert [r["pr_title"] for r in read] == ["A", "B"] and read[1]["comments"] == [{"comment": "x", "severity": "Low", "category": "security"}, {"comment": "y", "severity": "High", "category": "bug"}]


def test_every_problem_of_a_labels_file_is_listed(spark):
    label = lambda who, *items, **more: json.dumps({"labeler": who, "labeled_at": "2026", "tool_version": "1", "items": [dict(zip(("id", "verdict", "note"), i)) for i in items], **more})
    files = {
        "d/labels-amy.json": label("amy", ("a", "valid", "ok"), ("b", "unsure")), "d/Labels-AMY.json": label("amy", ("a", "valid")), "d/labels-bo.json": label("bo", ("a", "maybe"), ("a", "valid"), ("z", "valid"), (None, "valid")), "d/labels-x.json": "{", "d/labels-c-.json": label("c-"),
        "d/labels-d.json": label("e", ("a", "valid"), labeled_at=None), "d/labels-f.json": json.dumps({"labeler": "f", "labeled_at": "2026", "tool_version": "1"}),
    }
    labels, problems = benchmarks.human_labels(spark.createDataFrame(list(files.items()), "file string, value string"), spark.createDataFrame([("a",), ("b",)], "item string"))
    told = {}
    for r in problems.collect():
        told.setdefault(r.file[2:], set()).add(r.problem)
    assert told["labels-bo.json"] == {"item 1: no verdict: maybe", "item 2: a appears twice", "item 3: z is not in the sample", "item 4: needs an id"}
    assert "not JSON" in told["labels-x.json"] and told["labels-c-.json"] == {"no labeler's name"} and told["labels-d.json"] == {"the file must be named labels-e.json", "labeled_at must be text"} and told["labels-f.json"] == {"items must be a list"}
    assert told["labels-amy.json"] == {"d/Labels-AMY.json is already amy's file"} and {tuple(r) for r in labels.collect()} == {("amy", "a", "valid", "")}
