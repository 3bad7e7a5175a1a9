"""Filter audit, url filters and whitening against plain versions of their rules."""

import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from revtide.llm import filter_audit, url_filter, whitening

DATA = "/root/testdata/sf0.001"


def failing(text, repeats):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    upper = len(re.findall("[A-Z]", text))
    fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * upper > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), repeats)
    return {x for x, failed in zip("ABCDE", fails) if failed}


def brute_audit(docs, labels):
    """Every document goes through every order on its own."""
    smallest = {}
    for doc, text, _ in docs:
        if doc is not None:
            smallest[text or ""] = min(doc, smallest.get(text or "", doc))
    out, shapley, parts = Counter(), Counter(), {lang or "" for *_, lang in docs}
    for doc, text, lang in docs:
        text, part = text or "", lang or ""
        fails = failing(text, doc is not None and smallest[text] < doc)
        good, toxic = (any(label[i] == 1 for label in labels if label[0] == doc and doc is not None) for i in (1, 2))
        for order in map("".join, permutations("ABCDE")):
            gone = next((i for i, x in enumerate(order, 1) if x in fails), 6)
            for step, x in enumerate(order, 1):
                key = (part, order, step)
                found = {"kept": gone > step, "removed": gone == step, "redundant": gone < step and x in fails, "unique_fails": fails == {x},
                         "good_lost": gone == step and good, "toxic_lost": gone == step and toxic}
                for name, counts in found.items():
                    out[key, name] += counts
                shapley[part, x] += gone == step
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    every = [(p, "".join(o), s) for p in parts for o in permutations("ABCDE") for s in range(1, 6)]
    return {k: (*(out[k, n] for n in names), shapley[k[0], k[1][k[2] - 1]]) for k in every}


def rows_of(found):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found.collect()}


def test_audit_equals_every_document_through_every_order(spark, odd_docs, clashing_docs, no_docs):
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (7, None, 1), (8, 1, 1), (9, 0, 0), (None, 1, 1), (99, 1, 1), (10, 1, None)]
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    want = brute_audit([(r.doc_id, r.text, r.lang) for r in odd_docs.collect()], labels)
    for docs in (odd_docs, clashing_docs.withColumns({c: F.lit("x") for c in ("part", "mask", "_salt", "quality")})):
        found = filter_audit.audit(docs, given)
        assert found.count() == 120 * 5 * 3 and rows_of(found) == want
    assert filter_audit.audit(no_docs, given).count() == 0
    none = rows_of(filter_audit.audit(odd_docs, given.limit(0)))
    assert {k: v[:4] for k, v in none.items()} == {k: v[:4] for k, v in want.items()} and not any(sum(v[4:6]) for v in none.values())


def test_words_are_ascii_separated_and_case_counts(spark):
    text = " ".join(f"w{i}" for i in range(79)) + " W0 a\x0bb c\x1cd e f " + "w1\t" * 17
    docs = [(3, text, "en"), (1, text + " ", "en"), (2, text, "en")]
    found = rows_of(filter_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert found == brute_audit(docs, [])
    assert failing(text, False) == set() and found["en", "EABCD", 1][1] == 1


def test_weights_solve_the_constrained_least_squares_exactly():
    """The weights of a fit equal those of Shapley's formula, and whole values add up to what all filters remove."""
    from math import factorial

    for n in (2, 3, 4, 5):
        weights = filter_audit.shapley_weights(n)
        for i in range(n):
            for s in range(1, 1 << n):  # the empty coalition removes nothing
                size = s.bit_count() - (s >> i & 1)
                share = Fraction(factorial(size) * factorial(n - size - 1), factorial(n))
                assert weights[i][s] == factorial(n) * (share if s >> i & 1 else -share)
    rng = np.random.default_rng(1)
    removed = [0, *map(int, rng.integers(0, 10**12, 31))]
    values = [sum(w * v for w, v in zip(row, removed)) for row in filter_audit.shapley_weights()]
    assert sum(values) == 120 * removed[-1]


def place(url):
    host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "").groups() if "://" in (url or "") else ("", "")
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), path


def fits(rule, host, path):
    if rule.site:
        own, start = rule.site[: rule.site.index("/")], rule.site[rule.site.index("/") :]
        return (host == own or host.endswith("." + own)) and path.startswith(start)
    return re.search(url_filter.regex_of(rule.pattern).replace(r"\z", r"\Z"), host + path) is not None


def brute_verdict(url, rules):
    host, path = place(url)
    fit = [(r.site is not None, len(r.pattern), r.verdict == "block", r.pattern, r.verdict, r.site) for r in rules if fits(r, host, path)]
    best = max(fit, default=None)
    return (host, path, best[5], best[4], best[3]) if best else (host, path, None, "allow", None)


URLS = [
    None, "", "no scheme", "http://", "://x.org/", "HTTP://WWW.Example.ORG/en/1", "http://example.org/en/1234", "http://example.org/en/2", "http://example.org/es/1",
    "http://notexample.org/es/1", "http://a.b.example.org/es/", "http://example.org?/es/1", "http://example.org#/es/", "http://org/", "http://org", "http://xorg/x",
    "http://x.com/fr/1", "http://x.com/de/1", "http://com/de/", "http://x.com/DE/1", "http://x.com/fr", "http://user@x.org:80/a", "http://a.org:80/", "http://x.net/ads/1",
    "http://ads.x.net/", "http://x.net/my-ads-2", "http://x.net/heads", "http://x.net/a.exe", "http://x.net/a.exe?x", "http://x.net/a.exes", "http://x.net/login?next=/",
    "http://x.net/loginx", "http://x.net/a\nb/login", "ftp://x.net/a?u=http://example.org/es/", "http://ads.example.org/en/9", "http://ädsé.net/ads", "http://x.net/" + "a/" * 9000,
    "http://x.net/%61ds", "http://x.net/aaa/img/bbb.gif", "http://x.net/img/.gif", "http://free.x.net/y/z.js",
]


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_urls_equal_trying_every_rule(spark, monkeypatch, broadcast):
    """Wildcards, anchors and rules without a whole token included; rules broadcast and joined."""
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", broadcast)
    extra = [url_filter.Rule(p, v) for p, v in (("/img/*.gif", "block"), ("||free.", "allow"), ("z.js|", "block"), ("oo*", "block"), ("|x.net/aa", "allow"), ("|x.net/aa*b^", "block"))]
    urls = spark.createDataFrame([(i % 40, u) for i, u in enumerate(URLS * 2)], "page_id long, url string")
    for rules in (url_filter.RULES, url_filter.RULES + extra, extra, []):
        got = url_filter.judge(urls, rules).select("page_id", "url", "host", "path", "rule", "verdict", "pattern").collect()
        want = [(i % 40, u, *brute_verdict(u, rules)) for i, u in enumerate(URLS * 2)]
        assert Counter(map(tuple, got)) == Counter(want)


def test_rules_are_filed_under_their_rarest_token(spark):
    places = spark.createDataFrame([(f"a{i}.example.org/en/{i}",) for i in range(9)] + [("x.net/en/es",)], "_place string")
    index = {r.pattern: r.token for r in url_filter.rule_index(places, [*url_filter.SITES, url_filter.Rule("oo*", "block")]).collect()}
    assert index == {"||org/": "org", "||example.org/es/": "es", "||example.org/en/1": "example", "||com/fr/": "com", "||com/de/": "com", "oo*": ""}
    assert url_filter.tokens_of("||example.org/en/1") == ["example", "org", "en"]  # 1 may go on


def test_urls_in_odd_tables(spark):
    names = ("host", "path", "rule", "verdict", "pattern", "_row", "_place", "_salt", "_best", "_url", "token")
    urls = spark.createDataFrame([(None, "http://a.org/x"), (None, "http://a.org/x"), (2, None)], "page_id long, url string")
    got = url_filter.judge(urls.withColumns({n: F.lit("clash") for n in names}))
    assert got.columns == ["page_id", "url", "_row", "_place", "_salt", "_best", "_url", "token", "host", "path", "rule", "verdict", "pattern"]
    assert sorted((str(r.page_id), r.verdict, str(r.rule), r._url) for r in got.collect()) == [("2", "allow", "None", "clash"), *[("None", "allow", "org/", "clash")] * 2]
    assert url_filter.judge(urls.limit(0)).count() == 0


def brute_whitening(vectors, components=16):
    """vectors -> n, deviations, whitened (up to the sign), explained, by numpy alone."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(col) for col in zip(*fit)]
    centred = np.array([[n * c - s for c, s in zip(v, sums)] for v in fit], float) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    rows = np.array([[n * c - s for c, s in zip(v, sums)] for v in x], float) / n
    return n, [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x], rows @ basis[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def assert_whitened(rows, vectors):
    n, deviations, white, explained = brute_whitening(vectors)
    got = {}
    for r in rows:
        got.setdefault(r.component, {})[r.vec_id] = r
        assert r.n == n and r.identity_error < 1e-9 and r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
    assert len(got) == white.shape[1] and len(rows) == white.size
    for c, of in got.items():
        mine = np.array([of[i].whitened for i in range(len(vectors))])
        sign = np.sign(mine @ white[:, c - 1])
        assert np.allclose(sign * mine, white[:, c - 1], atol=1e-7)
        assert [int(of[i].deviation) for i in range(len(vectors))] == deviations


@pytest.mark.parametrize("block, chunk", [(1024, 1 << 30), (16, 100)])
def test_whitening_equals_numpy(spark, monkeypatch, block, chunk):
    """One block and many, one matrix and several; copies, constant and tied directions."""
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
    monkeypatch.setattr(whitening, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 20)) * np.linspace(2, 0.2, 20)).astype(np.float32)
    vectors[:, 19] = 0.5
    vectors[100:220] = vectors[7]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert_whitened(found.collect(), vectors)


def test_whitening_query(spark):
    given = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    number = {r.vec_id: i for i, r in enumerate(given)}
    found = whitening.op13_whitening(spark, DATA)
    assert dict(found.dtypes) | {"deviation": "bigint", "component": "int", "n": "bigint"} == dict(found.dtypes)
    rows = found.replace(list(number), list(number.values()), "vec_id").collect() if list(number) != list(range(len(number))) else found.collect()
    assert_whitened(rows, [r.embedding for r in given])


def test_whitening_odd_rows(spark):
    fine = [[1.0, 2.0, 3.0], [2.0, 1.0, 0.0], [0.5, 0.25, 9.0], [1.0, 2.0, 3.0]]
    odd = [None, [], [1.0], [None, 1.0, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1e30, 0.0, 0.0]]
    rows = [(i, v, "x") for i, v in enumerate(fine + odd)] + [(None, [0.5, 0.25, 9.0], "x")]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, _row string").withColumns({c: F.lit("y") for c in ("n", "component", "_x", "_salt", "whitened")})
    found = whitening.whiten(docs)
    assert found.columns == ["vec_id", "embedding", "_row", "_x", "_salt", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = found.collect()
    assert Counter(r.vec_id for r in rows) == Counter({0: 2, 1: 2, 2: 2, 3: 2, None: 2})  # three vectors span two directions
    assert_whitened([r for r in rows if r.vec_id is not None], fine)
    for few in (docs.limit(0), docs.filter("vec_id IN (0, 3)"), docs.filter("vec_id > 3")):
        assert whitening.whiten(few).collect() == [] and whitening.whiten(few).columns == found.columns
