"""Patches read a batch at a time against a plain reading line by line."""

import random

import pyarrow as pa

from revtide.operators import diffs, patches

LINES = ["@@ -1,2 +1,3 @@ f", "@@ -5,0 +6,2 @@", "@@ -3 +2,0 @@  x ", "@@ -0,0 +1 @@", "@@ bad", "+a", "-b", " c", "", "+", "-", "\\ No newline", "+é", "é", "+++ x", "+x\x0cq", "@"]


def plain(patch):
    """(head, old lines put in after, lines) of each hunk, a line at a time."""
    out, old, new, replacing = [], 0, 0, False
    for line in (patch or "").splitlines():
        head, tag = diffs.HUNK.match(line), line[:1] or " "
        if head:
            starts = [1 if x is None else int(x) for x in head.groups()[:4]]
            old, new, replacing = starts[0] + (starts[1] == 0), starts[2] + (starts[3] == 0), False
            out.append(((len(out) + 1, *starts, head[5].strip()), [], []))
        elif out and tag == "+":
            if not replacing and out[-1][1][-1:] != [old - 1]:
                out[-1][1].append(old - 1)
            out[-1][2].append({"tag": tag, "old": None, "new": new, "text": line[1:]})
            new += 1
        elif out and tag in " -":
            replacing = tag == "-"
            out[-1][2].append({"tag": tag, "old": old, "new": None if replacing else new, "text": line[1:]})
            old, new = old + 1, new + (not replacing)
    names = ["number", "old_start", "old_count", "new_start", "new_count", "section"]
    return [dict(zip(names, head)) | {"inserted_after": inserted, "lines": lines} for head, inserted, lines in out]


def test_a_batch_of_patches_is_read_as_line_by_line():
    rng = random.Random(7)
    patches = [None, "", "no hunk", *("\n".join(rng.choices(LINES, k=rng.randint(0, 14))) + rng.choice(["", "\n", "\r\n"]) for _ in range(3000))]
    want, batch = [plain(p) for p in patches], pa.array(patches, pa.string())
    assert diffs._hunks(batch).to_pylist() == want
    assert diffs._added(batch).to_pylist() == [[{"line": x["new"], "text": x["text"]} for h in hunks for x in h["lines"] if x["tag"] == "+"] for hunks in want]
    removed = [[sum(x["tag"] == "-" for x in h["lines"]) for h in hunks] for hunks in want]
    assert [[h["removed"] for h in hunks] for hunks in diffs._removals(batch).to_pylist()] == removed
    assert diffs._changed_text(batch).to_pylist() == [[{"section": h["section"], "lines": [x["text"] for x in h["lines"] if x["tag"] != " "]} for h in hunks] for hunks in want]
    for found, hunks in zip(diffs._changes(batch).to_pylist(), want):
        assert found["deleted"] == [x["old"] for h in hunks for x in h["lines"] if x["tag"] == "-"] and found["inserted_after"] == [n for h in hunks for n in h["inserted_after"]]
    assert diffs._hunks(pa.array([], pa.string())).to_pylist() == []


def test_added_lines_of_a_column(spark):
    rows = spark.createDataFrame([(1, "@@ -1 +1,2 @@ f\n-a\n+b\n+c"), (2, None)], "i int, patch string").select("i", diffs.added_lines("patch").alias("a"))
    assert {r.i: [(x.line, x.text) for x in r.a] for r in rows.collect()} == {1: [(1, "b"), (2, "c")], 2: []}


def test_a_header_of_a_diff_is_searched_once(spark):
    """Each pattern stands once in the plan, so no filter or later column searches again."""
    rows = spark.createDataFrame([("k", "diff --git a/x b/y\r\nrename from x\nrename to y\n")], "k string, d string")
    found = patches.split_diff(rows, "d", ["k"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(pattern) for pattern in patches.HEADER.values()] == [1] * len(patches.HEADER)
    assert [(r.path, r.status, r.patch, r.previous_path) for r in found.collect()] == [("y", "renamed", None, "x")]
