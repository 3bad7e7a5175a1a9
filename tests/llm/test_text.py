import hashlib
import html
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from revtide.llm import hmm, html_text, licenses, neighbours, pii

DATA = "/root/testdata/sf0.001"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def test_pii_query_base_spans(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = pii.op6_pii(spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        want = brute_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


CASES = [
    "a@b.c@d.e x_y@z.w_q@r.s", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255", "4111 1111-1111 1111 and 4111111111111112",
    "+1 (017) 555-7713, +12 34", "é漢 mail é.x@y.zz +49 30 1234567 end", "@@..@", "9" * 30, "1-" * 5000 + "1", "x" * 9000 + "@y.z",
    "+1 (974) 555-3436 4000 0000 0000 0002 10.0.0.1 q@w.e", "", None,
]


def test_pii_cases_and_odd_rows(spark, odd_docs, clashing_docs, no_docs):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "doc_id long, text string")
    for docs in (frame, odd_docs, clashing_docs):
        texts = sorted(str((r.doc_id, brute_spans(r.text))) for r in docs.collect())
        got = pii.find_spans(docs).select("_doc.doc_id", pii.digest_form("base").alias("s")).collect()
        assert sorted(str((r.doc_id, r.s)) for r in got) == texts
    assert pii.find_spans(no_docs).count() == 0


def test_pii_bootstraps_unseen_identifiers(spark):
    """Planted identifiers of forms that no base pattern knows, in contexts of seeds; the same forms elsewhere stay."""
    cards = ("4111111111111111", "4012888888881881", "4222222222222220", "5555555555554444", "5105105105105100", "6011111111111117")
    texts = [f"pay with card {n} now" for n in cards]
    texts += [f"please write to ann{i}@mail.example.com today" for i in range(5)] + [f"call me at +1 (20{i}) 555-013{i} tonight" for i in range(5)]
    texts += [f"server address 10.0.{i}.7 is down" for i in range(5)]
    planted = [
        ("pay with card 4111/1111/1111/1119 now", "card", "4111/1111/1111/1119"), ("please write to joan at mail dot org today", "email", "joan at mail dot org"),
        ("please write to bob@localhost today", "email", "bob@localhost"), ("call me at 020 7946 0958 tonight", "phone", "020 7946 0958"),
        ("server address fe80:0:0:0:202:b3ff:fe1e:8329 is down", "ip", "fe80:0:0:0:202:b3ff:fe1e:8329"),
    ]
    clean = ["number 4111111111111113 there", "pay with card 4111111111111112 now", "room 020 7946 0111 free", "look at chapter dot 5", "about 12 of 300"]
    docs = [*texts, *(t for t, *_ in planted), *clean]
    rows = pii.find_spans(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    added = {(r._doc.doc_id, s.kind, s.value) for r in rows for s in r.added}
    unseen = {(len(texts) + i, kind, value) for i, (_, kind, value) in enumerate(planted)}
    assert added == unseen


def test_pii_masks_documents(odd_docs, spark):
    docs = spark.createDataFrame([(1, "mail é.x@y.zz, 10.0.0.1!", "en", "a", 24), (2, None, None, None, None), (3, "clean", "en", "a", 5)], odd_docs.schema)
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.mask_documents(docs).collect()}
    assert got == {1: ("mail é[EMAIL], [IP]!", 20), 2: (None, None), 3: ("clean", 5)}


def test_pii_masks_every_row_by_its_own_spans(spark, odd_docs, clashing_docs, no_docs):
    rows = [(1, "the second text of this id"), (1, "mail a@b.cd"), (None, "an ip 10.0.0.1"), (None, "a long clean text without data"), (1, "mail a@b.cd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("_row", "_doc", "base", "added", "_text")})
    got = pii.mask_documents(docs)
    assert got.columns == docs.columns
    want = [(1, "the second text of this id"), (1, "mail [EMAIL]"), (None, "an ip [IP]"), (None, "a long clean text without data"), (1, "mail [EMAIL]")]
    assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == sorted(map(str, want))
    assert pii.mask_documents(clashing_docs).columns == clashing_docs.columns and pii.mask_documents(no_docs).count() == 0
    assert pii.mask_documents(odd_docs).count() == odd_docs.count()


def page(body):
    return f"<html><head><title>t</title><script>var a='</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "markup, text",
    [
        (None, ""), ("", ""), ("plain &lt;b&gt;", "plain <b>"), ("<p>a<p>b &amp;amp; c", "a\n\nb &amp; c"),
        (page("<nav>n</nav><article><h1>T  x</h1><p><b>One.<br><p>Two\n three</p></article><footer>f</footer>"), "T x\n\nOne.\n\nTwo three"),
        (page("<div class='ad'>x<div>y</div>z</div><p>kept</p><form>q</form><div id=comments>c</div>"), "kept"),
        (page("<article><p>a</p><aside>s</aside><!-- c --><p>b</p><div class='share-box'>s</div></article>out"), "a\n\nb"),
        (page("<article><header><h1>Head</h1></header><p>a</p></article>"), "Head\n\na"),
        (page("<main><p>x" + " y" * 20_000 + "</p></main>"), "x" + " y" * 20_000),
        ("<ul><li class='share'>a<li>b</ul><p>kept text</p>", "b\n\nkept text"), ("<ul><li>b<li class='share'>a</ul><p>kept</p>", "b\n\nkept"),
        ("<div class='post social-enabled'><p>body</p></div><p class='disclaimer-free'>free</p>", "body\n\nfree"),
        (page("<aside><article>teaser</article></aside><div><p>text of the page</p></div>"), "text of the page"),
        (page("<!-- <article> --><main><p>one</p></main>"), "one"), (page("<div>" * 300 + "deep" + "</div>" * 300), "deep"),
    ],
)
def test_main_text(markup, text):
    assert html_text.main_text(markup, set()) == text


@pytest.mark.parametrize(
    "markup, text",
    [
        ("<div class='entry has-sidebar'><article><p>body one</p></article></div>", "body one"), ("<div class='content no-sidebar'><p>body</p></div>", "body"), ("<div class='post-with-ads'><p>body</p></div>", "body"),
        ("<div class='news-notice'><p>body</p></div>", "body"), ("<div class='press-related'><p>body</p></div>", "body"), ("<form action='/'><div><h1>T</h1><p>the body of the page</p></div></form>", "T\n\nthe body of the page"),
        ("<form><main><p>body</p></main></form><p>x</p>", "body"), ("<nav>menu<p>body</p>", "body"), ("<aside>note<div><p>body</p></div>", "body"), ("<div role=complementary><main><p>body</p></main></div>", "body"),
        ("<div class='widget'><article><p>the article</p></article></div><div class='widget'>w</div>", "the article"), ("<div class=comments>" + "long comment " * 50 + "</div><article><p>short</p></article>", "short"),
        ("<div class='site-nav'>n</div><div class='sidebar-left'>s</div><div class='main-menu'>m</div><div class='cookie_notice'>c</div><p>body of some length</p>", "s\n\nbody of some length"),
    ],
)
def test_no_element_that_holds_the_article_is_hidden(markup, text):
    assert html_text.main_text(page(markup), set()) == text == html_text.main_text(markup, set())


def test_counts_decide_where_a_host_has_pages(spark):
    """A class name that a small host would lose its text by; comments, which differ on every page, go on both."""
    of = lambda i: page(f"<div class='widget'><p>Text {i} of the page, {'w ' * (i % 7)}</p></div><div class='menu'>all the same</div><div class=comments><p>{i}</p>{'<b>c</b>' * i}</div>")
    rows = [(i, "http://big.example.com/", of(i)) for i in range(30)] + [(99, "http://small.example.com/", of(99))]
    names = {c: F.lit("clash") for c in ("_host", "_template", "_salt", "_html", "_doc", "n_chars")}
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(names))
    assert found.columns == ["page_id", "url", "html", "_host", "_template", "_salt", "_html", "_doc", "text", "n_chars"]
    got = {r.page_id: r.text for r in found.collect()}
    assert all(got[i] == f"Text {i} of the page, {'w ' * (i % 7)}".strip() for i in range(30)) and got[99] == ""


def test_site_templates_go(spark):
    box = "<div class='x'>Read our rules here</div>"
    rows = [(i, f"http://h{i % 2}.example.com/{i}", page(f"<div>{box}<p>Page {i}</p></div>")) for i in range(40)]
    rows += [(100, None, None), (101, "http://solo.example.org/", page(f"{box}<p>solo</p>"))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Page 3" and got[100] == "" and got[101] == "Read our rules here\n\nsolo"
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_structure_that_recurs_goes_and_articles_stay(spark):
    """Menus, boxes and footers whose texts differ on every page, without telling names; copies of a page are one page."""
    words = lambda i, n: " ".join(f"w{(i * 7 + k * k) % 97}" for k in range(n))

    def of(i):
        menu = "".join(f"<li><a href='/{i}{k}'>{words(i + k, 1)}</a></li>" for k in range(4))
        body = "".join(f"<p>{words(i + k, 30)}</p>" for k in range(1 + i % 5))
        return page(f"<div class='top'><ul>{menu}</ul></div><div class='x1'><div class='body'>{body}</div></div><div class='end'><b>{words(i, 5)}</b></div>")

    rows = [(i, "http://big.example.com/a", of(i)) for i in range(40)] + [(100 + i, "http://big.example.com/b", of(41)) for i in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for i, _, markup in rows:
        assert got[i] == "\n\n".join(re.findall("<p>(.*?)</p>", markup))
        assert got[i] != html_text.main_text(markup, set())  # what is left without the templates


def test_html_hosts_join_without_a_broadcast(spark, monkeypatch):
    want = sorted(map(tuple, html_text.op7_html_text(spark, DATA).collect()), key=str)
    monkeypatch.setattr(html_text, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, html_text.op7_html_text(spark, DATA).collect()), key=str) == want


def test_html_query_on_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in html_text.op7_html_text(spark, DATA).collect():
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1].replace("<br>", " ")
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_hmm_query_base_score(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    words = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for d, t in docs.items() if zlib.crc32(str(d).encode()) % 10 for w in words(t))
    total, distinct = sum(c.values()), len(c)
    got = hmm.op10_hmm_score(spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        w = words(docs[r.doc_id])
        base = sum(math.log10((c[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.train_tokens == total
        assert (r.n_tokens, r.n_known) == (len(w), sum(c[x] > 0 for x in w))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_hmm_tables_of_any_size_agree_on_base(odd_docs, clashing_docs, no_docs, monkeypatch):
    every, none = F.lit(True), F.lit(False)
    want = sorted(str((r.doc_id, r.n_known, round(r.base_score, 6))) for r in hmm.score(odd_docs, every).collect())
    monkeypatch.setattr(hmm, "HEAD_WORDS", 3)
    got = hmm.score(clashing_docs.withColumns({c: F.lit(1) for c in ("_row", "_text", "_k0", "_train")}), every).collect()
    assert sorted(str((r.doc_id, r.n_known, round(r.base_score, 6))) for r in got) == want
    assert all(math.isfinite(r.score) for r in got)
    assert hmm.score(no_docs, every).count() == 0
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in hmm.score(odd_docs, none).collect())


def test_hmm_score_end_to_end(spark, monkeypatch):
    """The score column against a forward recursion over word probabilities, with words of all kinds."""
    monkeypatch.setattr(hmm, "HEAD_WORDS", 12)
    monkeypatch.setattr(hmm, "EMITTED", 6)
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "x!", "ö?"]
    texts = [" ".join(rng.choice(vocabulary, 30, p=np.r_[np.full(12, 0.07), 0.08, 0.05, 0.03])) for _ in range(40)] + ["unseen w1", ""]
    fitted = []
    estimated = hmm.Parameters.estimated.__func__
    monkeypatch.setattr(hmm.Parameters, "estimated", classmethod(lambda cls, *x: fitted.append(estimated(cls, *x)) or fitted[-1]))
    heads = []
    monkeypatch.setattr(hmm, "encode", lambda rows, head, of=hmm.encode: heads.append(head) or of(rows, head))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = hmm.score(docs, F.col("doc_id") % 4 != 0).collect()
    counts = Counter(w for i, t in enumerate(texts) if i % 4 for w in hmm.tokens(t))
    p, head = fitted[-1], heads[0]
    own = [w for w, k in head.number.items() if k < head.words]
    mass = np.zeros(hmm.SHAPES)
    for s in range(hmm.SHAPES):
        rest = [c for w, c in counts.items() if w not in own and hmm.shape(w) == s]
        mass[s] = sum(rest) + hmm.SMOOTH * (len(rest) + 1)
    for r in rows:
        total, alpha = 0.0, None
        for w in [*hmm.tokens(texts[r.doc_id]), None]:
            if w is None:
                seen = p.emit[head.end]
            elif w in own:
                seen = p.emit[head.number[w]]
            else:
                seen = p.emit[head.words + hmm.shape(w)] * (counts[w] + hmm.SMOOTH) / mass[hmm.shape(w)]
            alpha = (p.start if alpha is None else alpha @ p.move) * seen
            total, alpha = total + math.log10(alpha.sum()), alpha / alpha.sum()
        assert math.isclose(r.score, total, rel_tol=1e-9)


def brute_forward(s, p):
    total = 0.0
    alpha = p.start * p.emit[s[0]]
    for x in s[1:]:
        total, alpha = total + math.log10(alpha.sum()), (alpha / alpha.sum() @ p.move) * p.emit[x]
    return total + math.log10(alpha.sum())


def test_forward_and_baum_welch():
    rng = np.random.default_rng(1)
    unigram = rng.random(12) + 0.1
    p = hmm.Parameters.initial(unigram, 3)
    data = [rng.integers(0, 12, n) for n in (1, 2, 2, 5, 40, 900)]
    data = [np.sort(s) for s in data]
    likelihood = []
    for _ in range(4):
        got = hmm.log_likelihoods(data, p)
        assert np.allclose(got, [brute_forward(s, p) for s in data])
        likelihood.append(got.sum())
        start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((12, 3))
        hmm.expected_counts(data, np.ones(len(data), bool), p, start, move, emit)
        assert np.isclose(start.sum(), len(data)) and np.isclose(emit.sum(), sum(map(len, data)))
        assert np.isclose(move.sum(), sum(map(len, data)) - len(data))
        assert np.allclose(emit.sum(axis=1), np.bincount(np.concatenate(data), minlength=12))
        p = hmm.Parameters.estimated(start, move, emit, unigram)
    assert likelihood == sorted(likelihood)


def test_neighbours_recall_and_form(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = neighbours.op1_neighbours(spark, DATA).collect()
    hits = asked = 0
    for q in ids[ids % 20 == 0]:
        exact = v @ v[ids == q][0]
        exact[ids == q] = -np.inf
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21))
        assert np.allclose([r.score for r in own], [exact[ids == r.vec_id][0] for r in own])
        hits += len({r.vec_id for r in own} & set(ids[np.lexsort((ids, -exact))][:20].tolist()))
        asked += 20
    assert hits >= 0.9 * asked


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]),
            (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [9.0, 9.0]), (8, [1.0, 2.0, 3.0]), (9, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for docs in (frame, frame.selectExpr("*", "1 AS rank", "'x' AS score", "2 AS _id", "3 AS query_id")):
        got = sorted(map(tuple, neighbours.search(docs, lambda i: i % 20 == 0).collect()))
        assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert neighbours.search(frame.limit(0), lambda i: i % 20 == 0).count() == 0


def test_anisotropic_codes_favour_the_parallel_error():
    rng = np.random.default_rng(2)
    v = rng.standard_normal((500, 16))
    books = neighbours.fit(v)
    plain, best = neighbours.encode(v, books, rounds=0), neighbours.encode(v, books)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    error = lambda c: (((v - np.stack([books[j][c[:, j]] for j in range(8)], 1).reshape(v.shape)) * unit).sum(1) ** 2).mean()
    assert error(best) < error(plain)


def test_license_scan(spark, odd_docs, clashing_docs, no_docs):
    assert licenses.collision_probability(0.8 / 2.2) > 0.99
    filler = " ".join(f"w{i}" for i in range(3000))
    mit, line = licenses.TEMPLATES["mit-notice"], licenses.TEMPLATES["gpl-3.0-line"]
    texts = [f"{filler} {mit} {filler}", mit.upper().replace("\n", " "), f"{line}\n{filler}\n{line}", filler, mit[: len(mit) // 2], None, ""]
    got = [r.licenses for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    names = [sorted({x.license for x in found}) for found in got]
    assert names == [["mit-notice"], ["mit-notice"], ["gpl-3.0-line"], [], [], [], []]
    assert {x.start for x in got[2]} >= {0} and got[0][0].start == 3000
    for docs in (odd_docs, clashing_docs):
        assert all(not r.licenses for r in licenses.scan_licenses(docs).collect())
    assert licenses.scan_licenses(no_docs).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, DATA)
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_every_pipeline_stage_on_odd_tables(spark, odd_docs, clashing_docs, no_docs):
    """Null and repeated ids, null and empty texts, extra columns called like helpers, an empty table."""
    import corpus_pipeline

    own = clashing_docs.withColumns({c: F.lit(0) for c in ("_row", "_doc", "_id", "_text", "_fp", "_key", "_salt", "_language", "_best", "a", "b")})
    texts = {(r.doc_id, r.text) for r in odd_docs.collect()}
    for docs in (own, no_docs):
        for name, step in corpus_pipeline.STAGES:
            before, found = docs.count(), step(spark, docs, "")
            if name == "packing":
                assert (found.count() > 0) == (before > 0)
                break
            rows = found.collect()
            assert found.columns == docs.columns and len(rows) <= before and (len(rows) > 0) == (before > 0), name
            if name in ("language_id", "exact_dedup", "near_dedup"):
                assert {(r.doc_id, r.text) for r in rows} <= texts, name
            docs = spark.createDataFrame(rows, found.schema)


def missed_licenses(templates):
    """Names of templates that a scan misses at some place of a text, once for each place."""
    scanner, missed = licenses.Scanner(templates), []
    for words in ([f"w{i}" for i in range(40)], [f"other{i * 7 % 83}" for i in range(60)]):
        for name, template in templates.items():
            found = scanner.scan([" ".join([*words[:i], template, *words[i:]]) for i in range(len(words))])
            missed += [name for i, hits in enumerate(found) if (name, i) not in {(x[0], x[1]) for x in hits}]
    return missed


def test_every_license_is_found_at_every_place():
    assert missed_licenses(licenses.TEMPLATES) == []
    assert missed_licenses({f"line-{i}": f"Released under the Licence number{i}" for i in range(60)}) == []


def test_collision_probability_of_real_windows():
    sizes = [n for _, _, n, *_ in licenses.Scanner(licenses.TEMPLATES).templates if n >= licenses.SMALLEST_BLOCK]
    assert all(licenses.collision_probability(licenses.window_similarity(n)) > 0.99 for n in sizes)


def test_neighbours_with_many_equal_vectors(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(3_600, 8)), 3)
    v[rng.permutation(len(v))[:1_200]] = v[0]
    ids = rng.permutation(len(v)) + 1
    rows = [(int(i), x.tolist()) for i, x in zip(ids, v)]
    asked = set(ids[:8].tolist())
    found = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i.isin(*asked)).collect()
    for query in asked:
        scores = (v * v[ids == query]).sum(axis=1)
        want = [int(i) for _, i in sorted(zip(-scores, ids)) if i != query][:20]
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == query), key=lambda r: r["rank"])] == want
