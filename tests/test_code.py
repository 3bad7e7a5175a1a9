"""Symbols, packs, feed samples, near copies, capped shares and bundles against plain versions of their rules."""

import gzip
import hashlib
import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from revtide.operators import contamination, feed, packs, reports, symbols
from revtide.sources import bundle


def defined(spark, lines):
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(lines)], "i int, language string, line string")
    return [r.names for r in rows.select("i", symbols.defined(F.col("line"), F.col("language")).alias("names")).orderBy("i").collect()]


def test_definitions_of_each_language(spark):
    lines = [
        ("python", "    async def load_it(x):", ["load_it"]), ("python", "class Größe(Base):", ["Größe"]), ("python", "MAX_SIZE: int = 3", ["MAX_SIZE"]), ("python", "x = deffer(1)", []),
        ("typescript", "export const makeIt = (a) => {", ["makeIt"]), ("typescript", "function* gen$1() {", ["gen$1"]), ("typescript", "  private async run2(a: b): void {", ["run2"]), ("cpp", "#define LIMIT 3", ["LIMIT"]),
        ("cpp", "  int Foo::bar(int a);", ["bar"]), ("cpp", "return call_me(1);", []), ("cpp", "enum class Kind { A };", ["Kind"]), ("go", "func (s *T) Serve(w W) {", ["Serve"]), ("go", "type Name struct {", ["Name"]),
        ("jvm", "public static int count(int a) {", ["count"]), ("jvm", "record Point(int x) {}", ["Point"]), ("rust", "pub fn run_all<T>() {", ["run_all"]), ("rust", "macro_rules! vec_of {", ["vec_of"]), (None, "def other(x)", ["other"]),
    ]
    assert defined(spark, [x[:2] for x in lines]) == [x[2] for x in lines]


def test_symbols_keep_their_most_telling_kind(spark):
    files = [
        (1, "src/a.py", "@@ -1 +1,2 @@ def outer_name(x):\n-def gone_one():\n+def new_one(self):\n+def run():\n+ab = 1"), (1, "src/b.py", "@@ -1 +1 @@ class new_one\n-x\n+y"), (1, "tests/test_a.py", "@@ -1 +1 @@\n+def test_it():"),
        (1, "include/deep/thing.hpp", None), (1, "src/utils.py", None), (1, "README", "@@ -1 +1 @@ then call_this(1)\n+func Any"), (2, "x.go", ""),
    ]
    found = symbols.changed_symbols(spark.createDataFrame(files, "pr int, path string, patch string"), ["pr"], 9).orderBy("rank").collect()
    assert [(r.name, r.kind, r.source) for r in found] == [
        ("gone_one", "definition", "src/a.py"), ("new_one", "definition", "src/a.py"), ("Any", "definition", "README"), ("thing.hpp", "header", "include/deep/thing.hpp"), ("outer_name", "hunk_context", "src/a.py"), ("call_this", "hunk_context", "README"),
    ]


@pytest.mark.parametrize("most", [200_000, 0])
def test_references_are_whole_words(spark, monkeypatch, most):
    """Words beside letters of any script, dollar signs, header names; common symbols dropped; other and changed files left out."""
    monkeypatch.setattr(symbols, "BROADCAST_WORDS", most)
    names = spark.createDataFrame([(1, n) for n in ("load", "gen$1", "a.hpp", "every")] + [(2, "load")], "pr int, name string")
    files = [(1, "a.py", "load(x) every"), (1, "b.py", "reload loads éload every"), (1, "c.js", "x gen$1; every"), (1, "d.js", "gen$12 gen every"), (1, "e.c", '#include "a.hpp"\nload'), (1, "f.c", "xa.hpp a.hppx a_hpp"), (1, "g.txt", "load"), (1, "h.py", "load"), (2, "z.py", "nothing"), (1, "n.py", None)]
    hits, common = symbols.references(names, spark.createDataFrame(files, "pr int, path string, text string"), spark.createDataFrame([(1, "h.py")], "pr int, path string"), ["pr"], 3)
    assert {(r.pr, r.path): (r.hits, r.names) for r in hits.collect()} == {(1, "a.py"): (1, ["load"]), (1, "c.js"): (1, ["gen$1"]), (1, "e.c"): (2, ["a.hpp", "load"])}
    assert [tuple(r) for r in common.collect()] == [(1, "every", 4)]


def brute_pack(rows, budget):
    files, used, out, seen = 0, 0, {}, set()
    for path, commit, role, size, turn in rows:
        if (path, commit) in seen:
            continue
        seen.add((path, commit))
        if turn is not None and turn > budget.max_referencing:
            out[path, commit] = "referencing: over max_referencing"
        elif files == budget.max_files or used >= budget.max_bytes:
            out[path, commit] = f"{role}: pack full (max_files or max_bytes)"
        elif size is None:
            out[path, commit] = f"{role}: binary or unreadable"
        elif size > budget.max_file_bytes:
            out[path, commit] = f"{role}: {size} bytes > max_file_bytes"
        elif used + size > budget.max_bytes:
            out[path, commit] = f"{role}: would exceed max_bytes"
        else:
            out[path, commit], files, used = None, files + 1, used + size
    return out


def test_packs_skip_and_go_on(spark):
    rng, budget, rows, want = random.Random(1), packs.PackBudget(6, 100, 40, 3), [], {}
    for pr in range(60):
        some = [(f"f{rng.randrange(15)}", rng.choice("hb"), rng.choice(["changed", "test", "referencing"]), rng.choice([None, 0, 5, 20, 39, 40, 41, 90]), rng.choice([None, None, 1, 3, 4])) for _ in range(rng.randrange(0, 25))]
        want |= {(pr, *k): v for k, v in brute_pack(some, budget).items()}
        rows += [(pr, i, *x) for i, x in enumerate(some)]
    found = packs.packed(spark.createDataFrame(rows, "pr int, ord int, path string, commit string, role string, bytes long, turn int"), ["pr"], budget).collect()
    assert {(r.pr, r.path, r.commit): r.skipped for r in found} == want and all(r.taken == (r.skipped is None) for r in found)
    assert sum(v is None for v in want.values()) > 100 and len({v for v in want.values()}) > 8


def test_order_statistics_are_nearest_ranks(spark):
    for n in (1, 2, 9, 10, 11, 500):
        values = [random.Random(n).randrange(50) for _ in range(n)]
        got = packs.order_statistics(spark.createDataFrame([(v,) for v in values], "v int"), "v").first()
        ordered = sorted(values)
        assert (got.median, got.p90) == ((ordered[(n - 1) // 2] + ordered[n // 2]) / 2, ordered[min(n - 1, int(0.9 * n))])


def test_references_go_by_hits_and_steps(spark):
    hits = spark.createDataFrame([(1, "a/b/x.py", 2), (1, "a/y.py", 2), (1, "z.py", 3), (1, "tests/t.py", 1)], "pr int, path string, hits int")
    found = packs.ordered_references(hits, spark.createDataFrame([(1, "a/c.py"), (1, "q/r/s.py")], "pr int, path string"), ["pr"]).orderBy("turn").collect()
    assert [(r.path, r.steps, r.role) for r in found] == [("z.py", 1, "referencing"), ("a/y.py", 0, "referencing"), ("a/b/x.py", 1, "referencing"), ("tests/t.py", 2, "test")]


def brute_feed(pool, size, salt):
    """One pull request after the other, looking through whole queues."""
    out = []
    by_language = {}
    for p in pool:
        if p["rounds"]:
            by_language.setdefault(p["language"] or "", []).append(p)
    total = {k: sum(len(p["rounds"]) for p in v) for k, v in by_language.items()}
    whole = sum(total.values())
    exact = {k: size * n / whole for k, n in total.items()} if whole else {}
    quotas = {k: math.floor(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (-(exact[k] - quotas[k]), k))[: size - sum(quotas.values())]:
        quotas[k] += 1
    for language, prs in by_language.items():
        quota = total[language] if whole <= size else quotas[language]
        left = sorted(prs, key=lambda p: hashlib.sha256(f"{salt}\0{p['repo']}#{p['number']}".encode()).hexdigest())
        gold = [p for p in prs if p["gold_set"]]
        share = sum(p["important"] > 0 for p in gold) / len(gold) if gold else 0.0
        chosen, used = [], 0
        while used < quota:
            kind = lambda p: 0 if p["important"] else 1 if p["issues"] else 2
            ahead = sum(p["important"] > 0 for p in chosen) < math.floor(share * (len(chosen) + 1) + 0.5)
            fits = [(([0, 1, 2] if ahead else [1, 0, 2])[kind(p)], i) for i, p in enumerate(left) if len(p["rounds"]) <= quota - used]
            if not fits:
                break
            chosen.append(left.pop(min(fits)[1]))
            used += len(chosen[-1]["rounds"])
        out += [(p["repo"], p["number"], turn) for turn, p in enumerate(chosen, 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [0, 1, 7, 40, 150, 10_000])
def test_feed_samples_equal_looking_at_every_pull_request(spark, size):
    rng, pool = random.Random(size), []
    for i in range(160):
        issues = rng.choice([0, 0, 1, 3])
        pool.append({"repo": f"r{i % 3}", "number": i, "language": rng.choice(["go", "python", "rust", None]), "rounds": list(range(1, rng.choice([0, 1, 2, 3, 5]) + 1)), "gold_set": rng.random() < 0.8, "issues": issues, "important": min(issues, rng.choice([0, 0, 1]))})
    frame = spark.createDataFrame(pool, "repo string, number long, language string, rounds array<int>, gold_set boolean, issues int, important int")
    found = feed.feed_sample(frame, size, "s")
    assert sorted((r.repo, r.number, r.turn) for r in found.collect()) == brute_feed(pool, size, "s")
    if size == 40:
        taken = {(r.repo, r.number) for r in found.collect()}
        chosen = [p for p in pool if (p["repo"], p["number"]) in taken]
        row = feed.composition(frame, found).filter("language = 'all'").first()
        assert (row.pr_rounds, row.prs, row.with_important) == (sum(len(p["rounds"]) for p in chosen), len(chosen), sum(p["important"] > 0 for p in chosen)) and row.pr_rounds <= 40
        assert row.later_rounds == sum(len(p["rounds"]) - 1 for p in chosen) and row.pool_prs == sum(bool(p["rounds"]) for p in pool)


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(rows, order):
    texts = {}
    for item, split, text in rows:
        texts.setdefault(" ".join((text or "").lower().split()), []).append((item, split))
    names, sets = list(texts), [shingles(t) for t in texts]
    group = list(range(len(names)))
    for i in range(len(names)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for g in set(group):
        members = [m for k, name in enumerate(names) if group[k] == g for m in texts[name]]
        ranks = [order.index(s) if s in order else len(order) for _, s in members]
        if min(ranks) < max(ranks):
            out += [(item, split, order[min(ranks)], r == min(ranks)) for (item, split), r in zip(members, ranks)]
    return Counter(out)


@pytest.mark.parametrize("part", [256, 7])
def test_near_copies_equal_comparing_all(spark, monkeypatch, part):
    """Copies, chains of near copies, short and empty texts, a large group of near copies, whose buckets are cut into parts."""
    monkeypatch.setattr(contamination, "PART", part)
    rng, rows, order = random.Random(4), [], ["train", "validation", "test"]
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 60))] for _ in range(50)]
    common = [f"c{i}" for i in range(80)]
    for i in range(260):
        words = list(common if i % 4 == 0 else rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 5])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        rows.append((i, rng.choice([*order, "other"]), rng.choice([" ", "  ", "\n"]).join(words).upper() if i % 7 == 0 else " ".join(words)))
    rows += [(900, "train", None), (901, "test", "  "), (902, "test", "a b"), (903, "train", "A  b"), (904, "validation", "b a")]
    found = contamination.near_contaminated(spark.createDataFrame(rows, "item int, split string, text string"), order).collect()
    assert Counter((r["item"], r.split, r.earliest, r.kept) for r in found) == brute_groups(rows, order)
    assert contamination.near_contaminated(spark.createDataFrame([], "item int, split string, text string"), order).count() == 0


def brute_capped(weights, cap):
    """Takes the level down bit by bit until no share is over the cap."""
    if len(weights) * cap < 1:
        return [min(weights)] * len(weights)
    low, high = 0.0, max(weights)
    for _ in range(200):
        level = (low + high) / 2
        held = [min(w, level) for w in weights]
        low, high = (low, level) if max(held) > cap * sum(held) + 1e-12 else (level, high)
    return [min(w, low) for w in weights]


def test_capped_weights_equal_lowering_the_level(spark):
    rng, groups = random.Random(3), {}
    for g in range(12):
        groups[f"g{g}"] = [float(rng.choice([1, 1, 2, 5, 40, 300])) for _ in range(rng.randrange(1, 60))]
    rows = [(g, f"m{i}", w / 2) for g, ws in groups.items() for i, w in enumerate(ws) for _ in range(2)] + [("none", "a", None)]
    frame = spark.createDataFrame(rows, "g string, m string, w double")
    for cap in (0.05, 0.15, 0.5, 1.0):
        found = {(r.g, r.m): r for r in reports.capped_weights(frame, "g", "m", "w", cap).collect()}
        for g, ws in groups.items():
            held = brute_capped(ws, cap)
            for i, (w, h) in enumerate(zip(ws, held)):
                r = found[g, f"m{i}"]
                assert r.weight == w and r.factor * w == pytest.approx(h, rel=1e-6) and r.capped_share == pytest.approx(h / sum(held), rel=1e-6)
            assert len(ws) * cap < 1 or max(r.capped_share for (x, _), r in found.items() if x == g) <= cap + 1e-9
        assert found["none", "a"].share is None and found["none", "a"].factor == 1.0


def records(spark):
    issue = {"id": "i", "path": "p", "start_line": 1, "end_line": 2, "severity": "nit", "category": "c", "provenance": "x", "conf": 0.5, "description": 'é "q"\n', "source_threads": ["t"]}
    rows = {
        "pr": [{"repo": "r", "number": 1, "title": "T", "patched": ["a"], "comments": [{"id": "c", "stripped": True}], "threads": [{"id": "t", "comments": [{"id": "c", "body": "line\nline"}]}]}, {"repo": "r", "number": 2, "title": None}],
        "judgment": [{"repo": "r", "number": 1, "thread_id": "t", "judgment": "classify", "value": "v"}], "judged_labels": [{"repo": "r", "number": 1, "labels": [{"thread_id": "t", "outcome": "fixed"}]}],
        "gold": [{"repo": "r", "number": 1, "reviewed_commit": "c", "issues": [issue]}], "round_gold": [{"repo": "r", "number": 1, "reviewed_commit": "d", "rounds": 2, "issues": []}],
        "escaped_defect": [{"repo": "r", "number": 1, "fix": 9, "issue": issue}], "decision": [{"at": "2026", "hypothesis": "h", "change": "c", "delta": "d", "verdict": "v"}], "policy_version": [{"hash": "p"}],
        "split": [{"repo": "r", "number": 1, "split": "train"}, {"repo": "r", "number": 7, "split": "test"}], "round_diff": [{"repo": "r", "number": 1, "head": "d", "paths": ["a"]}], "benchmark": [{"repo": "r", "number": 5, "benchmark": "b", "comments": []}],
        "cached_answer": [{"key": "k", "cost_usd": 0.25, "input_tokens": 2**40}],
    }
    return {kind: spark.read.schema(bundle.table_schema(kind)).json(spark.sparkContext.parallelize([json.dumps(r) for r in some], 1)) for kind, some in rows.items()}


def contents(tables):
    return {kind: sorted(map(str, df.collect())) for kind, df in tables.items()}


def test_bundles_come_back_as_they_were(spark, tmp_path):
    """All kinds, written as a folder, and read again from it and from one file."""
    tables = records(spark)
    counts = bundle.write_bundle(tables, str(tmp_path / "b"), {"generator": "g"})
    head, back = bundle.read_bundle(spark, str(tmp_path / "b"))
    assert contents(back) == contents(tables) and counts == head["counts"] == {k: df.count() for k, df in tables.items()} and head["generator"] == "g"
    lines = [f.read() for p in sorted((tmp_path / "b").rglob("*.gz")) for f in [gzip.open(p, "rt", encoding="utf-8")]]
    with gzip.open(tmp_path / "one.jsonl.gz", "wt", encoding="utf-8") as out:
        out.write("\n" + "".join(lines))
    assert contents(bundle.read_bundle(spark, str(tmp_path / "one.jsonl.gz"))[1]) == contents(tables)
    few = bundle.write_bundle({"split": tables["split"].limit(0)}, str(tmp_path / "empty"))
    assert few == {"split": 0} and bundle.read_bundle(spark, str(tmp_path / "empty"))[1]["split"].count() == 0
    with pytest.raises(bundle.BundleError, match="unknown"):
        bundle.write_bundle({"other": tables["split"]}, str(tmp_path / "x"))


@pytest.mark.parametrize(
    "lines, message",
    [
        (['{"kind": "split", "repo": "r"}'], "one manifest"), ([], "one manifest"), (['{"kind": "manifest", "bundle_schema": 1}'] * 2, "one manifest"), (['{"kind": "manifest", "bundle_schema": 99}'], "newer"), (['{"kind": "manifest"}'], "newer"),
        (['{"kind": "manifest", "bundle_schema": 1}', '{"kind": "surprise"}'], "surprise"), (['{"kind": "manifest", "bundle_schema": 1}', "no json"], "unknown"), (['{"kind": "manifest", "bundle_schema": 1, "counts": {"split": 2}}', '{"kind": "split"}'], "split: 1 of 2"),
    ],
)
def test_what_is_no_bundle_is_refused(spark, tmp_path, lines, message):
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as out:
        out.write("\n".join(lines))
    with pytest.raises(bundle.BundleError, match=message):
        bundle.read_bundle(spark, str(tmp_path / "b.jsonl.gz"))


def test_imports_keep_or_replace(spark):
    new = records(spark)
    first, report = bundle.import_bundle({}, new)
    counts = {r.kind: (r.added, r.kept) for r in report.collect()}
    assert counts == {k: (1, 1) if k == "split" else (df.count(), 0) for k, df in new.items()}
    assert contents(first) == contents({**new, "split": new["split"].filter("number = 1")})
    changed = {**new, "pr": new["pr"].withColumn("title", F.lit("other")), "gold": new["gold"].withColumn("reviewed_commit", F.lit("new")), "decision": new["decision"].unionByName(new["decision"].withColumn("delta", F.lit("e")))}
    second, report = bundle.import_bundle(first, changed)
    counts = {r.kind: (r.added, r.kept) for r in report.collect()}
    assert (counts["pr"], counts["gold"], counts["decision"], counts["policy_version"], counts["split"], counts["cached_answer"]) == ((0, 2), (1, 0), (1, 1), (0, 1), (1, 1), (0, 1))
    assert contents(second)["pr"] == contents(first)["pr"] and second["gold"].first().reviewed_commit == "new" and second["decision"].count() == 2


def test_a_kind_is_read_from_its_own_folders(spark, tmp_path):
    """Also where a folder holds several kinds, and names that file paths encode."""
    path = tmp_path / "a b+c%41"
    bundle.write_bundle({"split": spark.sql("SELECT 'r' repo, 1L number, 'train' split"), "gold": spark.sql("SELECT 'r' repo, 2L number")}, str(path))
    (path / "more é").mkdir()
    (path / "more é" / "x.txt").write_text('\n \x1c\n{"kind": "gold", "repo": "q", "number": 3}\n{"kind": "policy_version", "hash": "h"}\n')
    manifest = next((path / "folder=%21manifest").glob("*.gz")) if (path / "folder=%21manifest").exists() else next((path / "folder=!manifest").glob("*.gz"))
    manifest.unlink()
    for crc in manifest.parent.glob(".*.crc"):
        crc.unlink()
    (manifest.parent / "m.txt").write_text('{"kind": "manifest", "bundle_schema": 1}')
    _, tables = bundle.read_bundle(spark, str(path))
    assert sorted(r.number for r in tables["gold"].collect()) == [2, 3] and tables["policy_version"].first().hash == "h" and tables["split"].first().number == 1
    assert [len(tables[k].inputFiles()) for k in ("benchmark", "decision")] == [0, 0]
