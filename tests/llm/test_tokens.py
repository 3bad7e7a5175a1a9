import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
import regex

from revtide.llm import bpe, langid, packing
from revtide.llm.shared import lucky_ids, most_frequent

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.load_tokenizer(bpe.vocabulary())


def test_bpe_query_equals_the_library(spark, tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = bpe.op4_bpe(spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = tokenizer.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("most, chunk", [(0, 1), (3, 40_000), (1000, 10**9)])
def test_bpe_odd_rows_with_any_table_size(odd_docs, clashing_docs, no_docs, tokenizer, most, chunk, monkeypatch):
    monkeypatch.setattr(bpe, "HEAD_WORDS", most)
    monkeypatch.setattr(bpe, "CHUNK_WORDS", chunk)
    for docs in (odd_docs, clashing_docs):
        got = bpe.encode(docs, bpe.vocabulary()).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.collect())
        assert set(got[0].asDict()) == {*docs.columns, "ids", "decoded"}
        for r in got:
            ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
            assert r.ids == ids and r.decoded == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.encode(no_docs, bpe.vocabulary()).count() == 0


def test_each_word_is_encoded_once_and_decoded_by_its_pieces(spark, tokenizer):
    words = ["hello", "hello,", "zaïre", "<|endoftext|>x", "\u200b", "漢字"]
    rows = bpe.word_table(spark.createDataFrame([(w,) for w in words], "word string"), bpe.vocabulary()).collect()
    assert sorted(r.word for r in rows) == sorted(words)
    for r in rows:
        ids = tokenizer.encode(r.word, add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == tokenizer.decode(ids, skip_special_tokens=False)


def test_most_frequent_never_exceeds_its_bound(spark):
    counts = spark.createDataFrame([(f"w{i}", 2_000_000 if i < 50 else i) for i in range(3000)], "word string, n long")
    for most in (0, 3, 49, 51, 700, 10_000):
        got = [r.n for r in most_frequent(counts, most, "word").collect()]
        assert len(got) <= most and (most < 3000 or len(got) == 3000)
        assert most < 51 or min(most, 3000) - len(got) < 20 + most / 5


def check_packing(rows, docs, tokenizer):
    got, fill = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        fill[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for doc, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[doc].append((k, at, len(part), zlib.crc32(part.tobytes())))
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in want.items()}
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    return len(fill)


def test_cached_ids_equal_the_library(tokenizer):
    """Special tokens, their spellings in other letters, combining marks and odd spaces, with a cache that overflows."""
    rng = np.random.default_rng(7)
    signs = [*"aAbHhJTz K'’sSt1 23.,<|>\t\n\x0b\x1c\x85\xa0éÉßİıΣς中\u0331\u030c\u212a", "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "'ll"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(3000)] + [None, ""]
    cache = bpe.IdCache(bpe.vocabulary(), 500)
    for i in range(0, len(texts), 300):
        some = texts[i : i + 300]
        wanted = tokenizer.encode_batch([t or "" for t in some], add_special_tokens=False)
        assert cache.encode(some) == [np.array(e.ids, "<u4").tobytes() for e in wanted]


def test_packing_query(spark, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows = packing.op8_packing(spark, DATA).collect()
    used = check_packing(rows, docs, tokenizer)
    assert used <= 1.05 * sum(r.length for r in rows) / 4096 + 1


def test_packing_odd_rows(odd_docs, clashing_docs, no_docs, tokenizer):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for frame in (odd_docs, clashing_docs):
        check_packing(packing.pack_documents(frame, bpe.vocabulary()).collect(), docs, tokenizer)
    assert packing.pack_documents(no_docs, bpe.vocabulary()).count() == 0


def test_linear_program_beats_best_fit():
    demand = np.bincount(np.repeat([2047, 1366, 683], 300), minlength=4097)
    count = lambda found: sum(n for _, n in found)
    assert count(packing.plan(demand)) == 300 < count(packing.best_fit(demand, 4096))


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_the_demand(seed):
    rng = np.random.default_rng(seed)
    demand = np.bincount(rng.integers(1, [4097, 3000, 600, 9][seed], 3000), minlength=4097)
    for found in (packing.plan(demand), packing.rounded(demand, 4096)):
        held = np.zeros(4097, int)
        for filling, n in found:
            assert sum(size * copies for size, copies in filling) <= 4096
            for size, copies in filling:
                held[size] += copies * n
        assert (held == demand).all()


def test_language_query_on_held_out_rows(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = langid.op3_language_id(spark, DATA).collect()
    assert len(got) == len(truth)
    right = [r.lang_pred == truth[r.doc_id].lang for r in got if r.held_out and truth[r.doc_id].lang]
    assert np.mean(right) >= 0.95
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1


def test_language_odd_rows(odd_docs, clashing_docs, no_docs):
    model = langid.train(odd_docs)
    for docs in (odd_docs, clashing_docs):
        found = {(r.doc_id, r.lang_pred) for r in langid.identify(docs, model).collect()}
        assert {(1, "en"), (2, "en"), (3, "und"), (4, "und"), (5, "und"), (6, "und"), (11, "fr")} <= found
    empty = langid.train(no_docs)
    assert langid.identify(no_docs, empty).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_docs, empty).collect()} == {"und"}


def test_unseen_word_falls_back_to_shorter_ngrams(spark):
    rows = [(i, "kastel zamek", "x") for i in range(5)] + [(9, "bruno foresta", "y")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict("kaste")[0] == "x" and model.predict("forest")[0] == "y"
    assert np.allclose(model.backoff("éé"), 0)


def brute_language_model(rows):
    """languages, log frequencies of words, log frequencies of n-grams."""
    languages = sorted({lang for _, lang in rows})
    words, grams = ({x: defaultdict(int) for x in languages} for _ in range(2))
    for text, lang in rows:
        for w in regex.findall(r"\p{L}+", text.lower()):
            words[lang][w] += 1
            padded = f"^{w}$"
            for g in [*w, *(padded[i : i + k] for k in (2, 3, 4) for i in range(len(padded) - k + 1))]:
                grams[lang][g] += 1

    def logs(counts):
        totals = {x: max(1, sum(c.values())) for x, c in counts.items()}
        least = 0.5 / max(totals.values())
        return {k: np.array([np.log(counts[x][k] / totals[x] + least) for x in languages]) for k in {k for c in counts.values() for k in c}}

    return languages, logs(words), logs(grams)


def brute_language(text, languages, words, grams):
    total, found = np.zeros(len(languages)), regex.findall(r"\p{L}+", (text or "").lower())
    for w in found:
        if w in words:
            total = total + words[w]
            continue
        padded = f"^{w}$"
        for k in (4, 3, 2, 1):
            known = [grams[g] for g in ([padded[i : i + k] for i in range(len(padded) - k + 1)] if k > 1 else w) if g in grams]
            if known:
                total = total + np.mean(known, axis=0)
                break
    odds = np.exp(total - total.max())
    return (languages[int(odds.argmax())], odds.max() / odds.sum()) if found else ("und", 0.0)


def test_language_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    model = brute_language_model([(r.text, r.lang) for r in docs if r.text and r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2])
    got = {r.doc_id: r for r in langid.op3_language_id(spark, DATA).collect()}
    for r in docs:
        lang, score = brute_language(r.text, *model)
        assert got[r.doc_id].lang_pred == lang and np.isclose(got[r.doc_id].score, score)


def test_only_letters_make_words():
    assert langid.words_of("10 ² ½ a²b É_x") == ["a", "b", "é", "x"] and langid.words_of("½ ²") == langid.words_of(None) == []


def test_the_sample_is_never_empty(spark):
    rows = spark.range(2000).withColumnRenamed("id", "doc_id")
    assert 300 < lucky_ids(rows, 400, "doc_id").count() < 500 and lucky_ids(rows, 5000, "doc_id").count() == 2000
