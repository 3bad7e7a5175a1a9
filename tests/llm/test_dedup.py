import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from revtide.llm import exact_dedup, shingles, simhash
from revtide.llm.components import connected_components

DATA = "/root/testdata/sf0.001"

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected_exact(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[(text or "").translate(LOWER)].append(doc)
    out = []
    for text, docs in groups.items():
        ids = [d for d in docs if d is not None]
        best, left = max(ids, default=None), True
        for d in docs:
            kept = d == best and left
            left = left and not kept
            out.append((d, best, len(docs), kept, hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_exact_on_odd_rows(odd_docs, clashing_docs):
    want = sorted(map(str, expected_exact([(r.doc_id, r.text) for r in odd_docs.collect()])))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    for docs in (odd_docs, clashing_docs):
        got = exact_dedup.mark_duplicates(docs).select(*columns).collect()
        assert sorted(str(tuple(r)) for r in got) == want


def test_exact_smallest_and_drop(odd_docs, no_docs):
    kept = exact_dedup.drop_duplicates(odd_docs, keep="smallest")
    assert kept.columns == odd_docs.columns
    texts = [(r.text or "").translate(LOWER) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({(r.text or "").translate(LOWER) for r in odd_docs.collect()})
    assert 1 in {r.doc_id for r in kept.collect()}
    assert exact_dedup.drop_duplicates(no_docs).count() == 0


def brute_fingerprint(text, width=4):
    words = (text or "").translate(LOWER).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, radius=4):
    """pairs: (doc_id, fingerprint) -> smallest doc_id reachable."""
    ids, fps = [p[0] for p in pairs], np.array([p[1] for p in pairs], np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius):
            a, b = find(i), find(int(j))
            root[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


@pytest.mark.parametrize("text", ["", None, "one", "a b c d", "A b C d e é", " x  y\tz\n", "w " * 20_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2**64 == brute_fingerprint(text)


def test_simhash_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    want_fp = {d: brute_fingerprint(t) for d, t in docs.items()}
    want = brute_components(sorted(want_fp.items()))
    got = simhash.op5_simhash(spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.fingerprint == f"{want_fp[r.doc_id]:016x}"
        assert r.component_id == want[r.doc_id]


def test_simhash_odd_rows(odd_docs, clashing_docs, no_docs):
    for docs in (odd_docs, clashing_docs):
        found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
        assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (7, 7), (8, 7), (9, 7), (10, 10)} <= found
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("fan", [2, 4, 32])
def test_large_bucket_links_like_brute_force(fan):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(600)]
    fps = np.unique(np.array([int(centres[i % 6]) ^ f for i, f in enumerate(flips)], np.uint64))
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    fps = fps[np.argsort(rank)]
    keys = np.repeat(np.array([1, 2, 3]), [len(fps), 5, 1])
    rows = np.concatenate([fps, fps[:5], fps[:1]])
    labels = simhash.link_buckets(keys, np.zeros(len(keys), np.uint64), rows, fan=fan, tree=1)
    want = brute_components(list(enumerate(fps.tolist())))
    assert labels[: len(fps)].tolist() == [want[i] for i in range(len(fps))]
    assert labels[-1] == len(rows) - 1


def test_the_index_prunes_and_loses_nothing():
    """Buckets of all sizes in indexes of several buckets: every link of brute force inside a bucket, few comparisons."""
    rng = np.random.default_rng(6)
    centres = rng.integers(0, 2**63, 900, dtype=np.uint64)
    near = centres[:300] ^ np.array([sum(1 << int(b) for b in rng.choice(44, 4, replace=False)) for _ in range(300)], np.uint64)
    fps = np.sort(np.concatenate([centres, near]))
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    fps = fps[np.argsort(rank)]
    buckets, agree = (fps >> np.uint64(44)).astype(np.int64), np.full(len(fps), ((1 << 20) - 1) << 44, np.uint64)
    links = 0
    for tree in (1, 64, 5000):
        labels = simhash.link_buckets(buckets, agree, fps, tree=tree)
        for i in range(len(fps)):
            close = np.flatnonzero((np.bitwise_count(fps ^ fps[i]) <= 4) & (buckets == buckets[i]))
            links += len(close) - 1
            assert len(set(labels[close])) == 1
    assert links >= 3 * 600
    index = simhash.GrayIndex(fps, agree=int(agree[0]))
    index.components(4)
    assert index.visited < 0.02 * len(fps) ** 2


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 1000 + i) for i in range(50)] + [(5, 5), (200, 201)]
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(61)}, 100: 100, **{1000 + i: 100 for i in range(50)}, 200: 200, 201: 200}


def brute_similar(docs):
    """doc_id -> smallest doc_id reachable over 5-word shingle similarities of 0.8 or more."""
    sets = {}
    for d, text in docs:
        words = (text or "").translate(LOWER).split()
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return root


def edited_docs():
    """Copies of 12 texts with 0 to 6 words changed, a chain of edits, texts that share a passage, short texts."""
    rng = np.random.default_rng(8)
    draw = lambda n: [f"w{i}" for i in rng.integers(0, 900, n)]
    texts = []
    for _ in range(12):
        base = draw(int(rng.integers(30, 200)))
        for edits in range(7):
            copy = list(base)
            for at in rng.integers(0, len(base), edits):
                copy[at] = f"edit{rng.integers(0, 10**6)}"
            texts.append(copy)
    chain = draw(100)
    for _ in range(15):
        chain = chain[2:] + draw(2)
        texts.append(chain)
    passage = draw(100)
    texts += [passage + draw(15 + i % 20) for i in range(40)] + [draw(i % 7) for i in range(14)] + [["Same", "few"], ["same", "few"]]
    return [(int(i), " ".join(t)) for i, t in zip(rng.permutation(len(texts)) + 1, texts)]


def test_pipeline_near_stage_equals_brute_force(spark, odd_docs):
    import corpus_pipeline

    docs = edited_docs()
    want = brute_similar(docs)
    frame = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in docs], odd_docs.schema)
    groups = {r.node: r.root for r in shingles.near_duplicates(frame).collect()}
    assert {d: groups.get(d, d) for d in want} == want and len(set(want.values())) < len(want) - 30
    kept = corpus_pipeline.near(spark, frame, "")
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_near_stage_odd_rows(odd_docs, clashing_docs, no_docs):
    for docs in (odd_docs, clashing_docs):
        kept = shingles.drop_near_duplicates(docs)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 7, 10, 11, 12]
    assert shingles.drop_near_duplicates(no_docs).count() == 0


def test_stages_keep_rows_with_null_and_repeated_ids(spark, odd_docs):
    """A row goes only by its own text: other rows with its id stay."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base + " end"), (2, "quite another text of the same number that stays"), (None, "first of none"), (None, base + " tail")]
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], odd_docs.schema).withColumns({c: F.lit(0) for c in ("_row", "_doc", "_id", "node")})
    kept = shingles.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str((r.doc_id, r.text[:5])) for r in kept.collect()) == sorted(map(str, [(1, "w0 w1"), (2, "quite"), (None, "first")]))
    exact = spark.createDataFrame([(1, "A"), (2, "a"), (2, "b"), (2, "B"), (None, "c"), (None, "C"), (None, "d")], "doc_id long, text string")
    exact = exact.withColumns({c: F.lit(0) for c in ("_digest", "_run", "_row", "_doc", "_best", "id")})
    got = exact_dedup.drop_duplicates(exact)
    assert got.columns == exact.columns
    assert sorted((r.doc_id or 0, r.text.lower()) for r in got.collect()) == [(0, "c"), (0, "d"), (2, "a"), (2, "b")]
