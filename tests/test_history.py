"""Versions, suggestions, diffs and checks, case by case."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from revtide.functions.texts import lines_of, stripped
from revtide.operators import diffs, history, patches, suggestions


def test_lines_and_strips_are_those_of_text(spark):
    texts = ["", "a", "a\n", "a\n\nb", "\n", "a\r\nb\rc", "x\x0by\x0cz\x1c1\x1d2\x1e3\x854 5 ", "\r\n\r\n", " é ", "\t a b \x1f"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", lines_of(F.col("t")).alias("lines"), stripped(F.col("t")).alias("s")).collect()
    assert [(r.lines, r.s) for r in sorted(rows)] == [(t.splitlines(), t.strip()) for t in texts]


def expected_forward(old, new, start, end):
    """Old lines start to end, by what became of each of them."""
    places, inside, gone = [], [], None
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        for i in range(max(i1, start - 1), min(i2, end)):
            if tag == "equal":
                places += [j1 + i - i1, j1 + i - i1 + 1]
            elif tag == "replace":
                places += [j1, j2]
            elif gone is None:
                gone = j1
        if tag == "insert" and start - 1 < i1 < end:
            places += [j1, j2]
    return (min(places) + 1, max(places)) if places else ((gone or 0) + 1, gone or 0)


def expected_back(old, new, start, end):
    equal = {}
    for tag, i1, i2, j1, _ in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        equal |= {j1 + k: i1 + k for k in range(i2 - i1)} if tag == "equal" else {}
    found = [equal.get(j) for j in range(start - 1, end)]
    return None if not found or None in found else (min(found) + 1, max(found) + 1)


def edited(rng):
    old = [rng.choice("abcdefg}") * rng.randint(1, 2) for _ in range(rng.randint(1, 14))]
    new = list(old)
    for _ in range(rng.randint(0, 4)):
        at = rng.randrange(len(new) + 1)
        new[at : at + rng.randint(0, 2)] = [rng.choice("xyz}") for _ in range(rng.randint(0, 2))]
    if rng.random() < 0.3:
        new = new[len(new) // 2 :] + new[: len(new) // 2]  # moved
    return old, new


def test_ranges_follow_their_lines(spark):
    """Inserted, deleted, replaced, moved and repeated lines, both ways; an unknown version maps nothing."""
    rng = random.Random(5)
    pairs = [edited(rng) for _ in range(60)] + [(["a", "b", "c"], []), ([], ["a"]), (["a", "b", "c"], ["c", "a", "b"]), (list("abcd"), list("ad"))]
    versions = [(f"p{i}", c, "\n".join(v)) for i, pair in enumerate(pairs) for c, v in zip(("old", "new"), pair)]
    ranges = [(f"p{i}", "old", "new", s, e) for i, (old, _) in enumerate(pairs) for s in range(1, len(old) + 1) for e in range(s, min(len(old), s + 3) + 1)]
    ranges += [("p0", "old", "gone", 1, 1), ("p60", "old", "new", 3, 2)]
    found = history.mapped_ranges(
        spark.createDataFrame(ranges, "path string, old_commit string, new_commit string, start_line int, end_line int"), spark.createDataFrame(versions, "path string, commit string, text string"), []
    ).collect()
    assert len(found) == len(ranges)
    for r in found:
        if r.new_commit == "gone":
            assert r.forward is None and r.back is None
        elif r.end_line >= r.start_line:
            old, new = pairs[int(r.path[1:])]
            assert tuple(r.forward) == expected_forward(old, new, r.start_line, r.end_line)
            assert (r.back and tuple(r.back)) == expected_back(old, new, r.start_line, r.end_line)


def applies(old, new, found):
    """Rebuilds the new version from the pieces, and checks that equal ones are."""
    i = j = 0
    for tag, i1, i2, j1, j2 in found:
        assert (i1, j1) == (i, j) and (tag == "equal") == (old[i1:i2] == new[j1:j2] and i2 > i1) or tag == "replace"
        assert tag != "equal" or old[i1:i2] == new[j1:j2]
        i, j = i2, j2
    assert (i, j) == (len(old), len(new))


@pytest.mark.parametrize("most", [0, 3, 40, 2_000_000])
def test_alignment_is_bounded_and_whole(monkeypatch, most):
    """Under any bound the pieces cover both versions, and equal pieces are equal; without a bound they are the library's."""
    rng = random.Random(most)
    for _ in range(300):
        old, new = edited(rng)
        monkeypatch.setattr(history, "MOST_PAIRS", most)
        found = history.aligned(old, new)
        applies(old, new, found)
        if history.equal_pairs(old, new) <= most:
            assert found == difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes()


def test_many_equal_lines_take_little_time():
    import time

    old = ["}"] * 20_000 + [f"a{i}" for i in range(100)] + ["}"] * 20_000
    new = ["}"] * 20_001 + [f"a{i}" for i in range(100)] + ["x"] + ["}"] * 20_000
    began = time.time()
    found = history.aligned(old, new)
    applies(old, new, found)
    assert time.time() - began < 5 and sum(i2 - i1 for tag, i1, i2, *_ in found if tag == "equal") >= 40_000


def test_located_takes_the_first_place(spark):
    cases = [("a\nb\na\nb\n", ["b"], 2), (" a \n\tb\r\nc", ["a", "b"], 1), ("a\nb", ["a", "c"], None), ("a", ["a", "b"], None), ("", ["a"], None), (None, ["a"], None), ("x\na\na\nb", ["a", "b"], 3)]
    rows = spark.createDataFrame([(i, t, b) for i, (t, b, _) in enumerate(cases)], "i int, t string, b array<string>")
    got = {r.i: r.at for r in rows.select("i", history.located(F.col("t"), F.col("b")).alias("at")).collect()}
    assert [got[i] for i in range(len(cases))] == [at for *_, at in cases]


def test_blocks_are_runs_of_one_commit(spark):
    """Ranges over the bins' edges, boundary lines, gaps, several commits."""
    ranges = spark.createDataFrame([("r", 1, "f", 1, 60, 70), ("r", 1, "f", 2, 130, 131)], "repo string, fix long, path string, hunk int, start_line int, end_line int")
    lines = [(n, "b" if n == 65 else "a", f"t{n}", n == 62) for n in range(50, 140)]
    blame = spark.createDataFrame([("r", 1, "f", *x) for x in lines], "repo string, fix long, path string, line int, sha string, text string, boundary boolean")
    got = sorted((r.hunk, r.sha, r.first_line, r.block) for r in history.blamed_blocks(ranges, blame, ["repo", "fix"]).collect())
    text = lambda a, b: [f"t{n}" for n in range(a, b + 1)]
    assert got == [(1, "a", 60, text(60, 61)), (1, "a", 63, text(63, 64)), (1, "a", 66, text(66, 70)), (1, "b", 65, ["t65"]), (2, "a", 130, text(130, 131))]


def test_fixes_and_their_ranges(spark):
    rules = history.DefectRules(window_end="2026-01-31", after_days=28, max_fix_lines=2)
    prs = [("Fix it", None, "2026-02-01T00:00"), ("prefix", [], "2026-02-05"), ("Docs", ["docs", "KIND/BUG"], "2026-02-28T23:59"), ("fixes x", [], "2026-01-31T23:00"), ("bugfix", [], "2026-03-01"), (None, ["bug"], "2026-02-10"), ("Crashes!", [], None)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(prs)], "i int, title string, labels array<string>, created_at string")
    assert {r.i for r in history.is_fix(frame, rules).collect()} == {0, 2, 5}
    patch = "@@ -1,3 +1,2 @@\n a\n-b\n c\n@@ -10 +9,2 @@\n+n\n x\n@@ -20,3 +20 @@\n-1\n-2\n-3\n+4"
    files = spark.createDataFrame([(1, "f", patch), (2, "g", None)], "n int, path string, patch string")
    assert [tuple(r) for r in history.rewritten_ranges(files, ["n"], rules).collect()] == [(1, "f", 1, 1, 3)]


def test_commits_go_to_their_pull_requests(spark):
    corpus = spark.createDataFrame([("r", 1, "h1"), ("r", 2, "h2"), ("r", 3, "h1"), ("r", 9, "h9")], "repo string, number long, head_oid string")
    commits = spark.createDataFrame([("r", 1, "x"), ("r", 2, "x"), ("r", 2, "h9"), ("r", 77, "y")], "repo string, number long, oid string")
    said = [("h1", "(#2)"), ("m", "Merge pull request #2 from a"), ("q", "See (#9) first\nthen (#1)\n"), ("t", "Title (#55) \n (#3)  "), ("u", "none (#2) here"), ("z", "See merge pull request #2"), ("big", "(#99999999999999999999)")]
    shas = spark.createDataFrame([("r", s) for s in ("h1", "x", "h9", "y", *(s for s, _ in said))], "repo string, sha string")
    messages = spark.createDataFrame([("r", s, m) for s, m in said], "repo string, sha string, message string")
    got = {r.sha: r.number for r in history.commits_of(shas, corpus, commits, messages).collect()}
    assert got == {"h1": 3, "x": 2, "h9": 9, "m": 2, "q": 1, "t": 3}


FENCED = [
    ("no", []), (None, []), ("```suggestion\nx = 1\n```", ["x = 1\n"]), ("a\r\n```suggestion\r\nb\r\n```\r\n", ["b\n"]), ("```suggestion\n```", [""]), ("````suggestion\n```\nc\n````", ["```\nc\n"]),
    ("~~~ suggestion:-0+1\nd\n~~~", ["d\n"]), ("```suggestion\nopen", []), ("```python\nx\n```", []), ("```suggestion\na\n```\n```suggestion\nb\n```", ["a\n", "b\n"]), ("```suggestions\na\n```", []), ("  ```suggestion\n  e\n  ```  ", ["  e\n"]),
    ("```suggestion\na\n~~~\n```", ["a\n~~~\n"]),
]


def test_suggestion_blocks(spark):
    rows = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(FENCED)], "i int, b string")
    got = {r.i: (r.all, r.last) for r in rows.select("i", suggestions.blocks(F.col("b")).alias("all"), suggestions.suggestion(F.col("b")).alias("last")).collect()}
    assert [got[i] for i in range(len(FENCED))] == [(want, want[-1] if want else None) for _, want in FENCED]


def test_suggestions_applied_in_a_patch(spark):
    patch = "@@ -1,4 +1,4 @@\n a1\n-old1\n-old2\n+new1\n+new2\n b1\n@@ -10,2 +10,1 @@\n c1\n-gone"
    cases = [
        ("new1\nnew2\n", 2, 3, True), ("new2", 3, 3, True), (" new1 \nb1", 2, 2, True), ("a1\nb1", 2, 3, False), ("new1\nold1", 2, 3, False), ("new1", 4, 4, False), ("", 11, 11, True), ("", 2, 3, False),
        ("}", 2, 3, False), ("x", 10, 11, False), (" \n", 11, 12, True), ("new1", 12, 14, False), ("c1", 11, 11, False),
    ]
    rows = spark.createDataFrame([(i, patch, *c[:3]) for i, c in enumerate(cases)], "i int, patch string, s string, a int, b int").withColumn("h", diffs.hunk_lines("patch"))
    got = {r.i: r.told for r in rows.select("i", suggestions.applied_in_patch(F.col("s"), F.col("h"), F.col("a"), F.col("b")).alias("told")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for *_, want in cases]


def test_suggestions_applied_by_a_commit(spark):
    body = "```suggestion\nnothing like it\n```"
    threads = [(1, "t1", body, "amy", "2026-01-02", True), (1, "t2", body, "joe", "2026-01-02", True), (1, "t3", body, None, None, True), (1, "t4", body, "amy", "2026-01-09", True), (1, "t5", body, "amy", "2026-01-01", None), (2, "t6", body, "x", "2026-01-01", True)]
    frame = spark.createDataFrame([("r", n, i, b, w, o, "RIGHT", 1, 1, c, None) for n, i, b, w, o, c in threads], "repo string, number long, thread_id string, body string, reviewer string, opened_at string, diff_side string, start_line int, end_line int, lines_changed boolean, patch string")
    made = [("r", 1, "Apply suggestion from @amy", "2026-01-03"), ("r", 2, " apply suggestions from code review ", "2026-01-01"), ("r", 1, "Apply suggestions from code review", "2026-01-01")]
    got = {r.thread_id: (r.suggestion, r.reason) for r in suggestions.suggestion_states(frame, spark.createDataFrame(made, "repo string, number long, headline string, committed_at string")).collect()}
    applied, not_found = ("applied", suggestions.BY_COMMIT), ("not_applied", suggestions.NOT_FOUND)
    assert got == {"t1": applied, "t2": not_found, "t3": applied, "t4": not_found, "t5": ("not_applied", suggestions.UNCHANGED), "t6": applied}


def test_diffs_of_odd_shapes(spark):
    texts = {
        1: None, 2: "", 3: "no diff\nat all", 4: "--- a/x\n+++ b/y\n@@ -1 +1 @@\n-a\n+b", 5: "--- a/x\n+++ /dev/null\n@@ -1 +0,0 @@\n-a", 6: "diff --git a/p q b/p q\nold mode 100644\nnew mode 100755",
        7: "diff --git a/x b/x\r\n--- a/x\r\n+++ b/x\r\n@@ -1,2 +1 @@\r\n a\r\n--- b\r\nindex 1\r\n\\ No newline\r\n", 8: "--- a/z\nno plus", 9: "diff --git a/e b/e\nnew file mode 100644\nindex 0..0",
        10: "diff --git a/x b/x\n@@ -1 +1 @@\n-diff --git a/y b/y\n+diff --git a/z b/z",
    }
    rows = spark.createDataFrame(list(texts.items()), "i int, t string")
    got = [(r.i, r.path, r.status, r.patch, r.previous_path) for r in patches.split_diff(rows, "t", ["i"]).orderBy("i", "ord").collect()]
    assert got == [
        (4, "y", "modified", "@@ -1 +1 @@\n-a\n+b", "x"), (5, "x", "removed", "@@ -1 +0,0 @@\n-a", None), (6, "p q", "modified", None, None), (7, "x", "modified", "@@ -1,2 +1 @@\n a\n--- b\n\\ No newline", None),
        (9, "e", "added", None, None), (10, "x", "modified", "@@ -1 +1 @@\n-diff --git a/y b/y\n+diff --git a/z b/z", None),
    ]


def test_checks_on_odd_files(spark):
    checks = [
        patches.Check("a", patches.REGEX, pattern=r"print\(", exclude="noqa"), patches.Check("b", patches.STRUCTURAL, select="assert", pattern="is not None"),
        patches.Check("c", patches.THRESHOLD, threshold=5), patches.Check("d", patches.REGEX, pattern="x" * 3, paths=("*.go",)),
    ]
    long = "  print(" + "y" * 200
    files = [
        ("f1", "modified", "py", f"@@ -1 +3,3 @@\n+{long}\n+print(1) # noqa\n c\n+print(2)", 4, 5), ("f2", "removed", "py", "@@ -1 +1 @@\n+print(1)", 1, 9), ("f3", None, None, None, None, 6), ("f4", "added", "py", "@@ -0,0 +1,3 @@\n+assert x is not None\n+assert y\n+z", None, None),
        ("f5", "added", "py", "@@ -0,0 +1,3 @@\n+assert x is not None\n+z\n+assert y is not None", 5, 9), ("f.go", "added", "go", "@@ -0,0 +1 @@\n+xxx", 0, 1), ("d/f.go", "added", "go", "@@ -0,0 +1 @@\n+xxx", 0, 1),
    ]
    frame = spark.createDataFrame(files, "path string, status string, language string, patch string, before int, after int")
    got = {(r.path, r.rule): (r.line, r.detail) for r in patches.run_checks(frame, checks, []).collect()}
    assert got == {
        ("f1", "a"): (3, f"(Line 3: `{long.strip()[:120]}` and 1 more added lines.)"), ("f1", "c"): (6, "(4 lines before this change, 5 after.)"), ("f3", "c"): (6, "(0 lines before this change, 6 after.)"),
        ("f5", "b"): (1, "(2 added assertion lines, first at line 1.)"), ("f.go", "d"): (1, "(Line 1: `xxx`.)"),
    }
