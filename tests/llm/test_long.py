"""Texts with very many spans and very long words."""

import re

from pyspark.sql import functions as F

from revtide.llm import bpe, pii


def test_pii_in_one_text_of_many_spans(spark):
    """100,000 base spans in one text, and masking it: as plain expressions find and replace them."""
    n = 100_000
    text = " ".join(f"mail user{i}@mail{i % 50}.example.com x{i}y" if i % 2 else f"host 10.0.{i % 256}.{i // 256 % 256} up" for i in range(n))
    docs = spark.createDataFrame([(1, text), (2, "mail a1@b.cd"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_spans(docs).select("_doc.doc_id", pii.digest_form("base").alias("s"), F.size("added").alias("n")).collect()}
    hits = [(m.start(), m.end(), "email" if "@" in m.group() else "ip") for m in re.finditer(r"user\S+|(?<=host )\S+", text)]
    assert len(hits) == n and got[1].s == ",".join(f"{kind}:{a}:{b}" for a, b, kind in hits) and got[3].s == ""
    masked = {r.doc_id: r.text for r in pii.mask_documents(docs).collect()}
    want = re.sub(r"(?<=host )\S+", "[IP]", re.sub(r"user\S+", "[EMAIL]", text))
    assert masked[2] == "mail [EMAIL]" and masked[3] is None
    plain = re.sub(r"\[[A-Z]+\]", "[]", masked[1])
    assert plain.count("[]") >= n and (got[1].n or masked[1] == want)


def test_bpe_of_very_long_words(spark):
    """Words of 100,000 and 1,000,000 characters (over 65,535 ids each), once and repeated, beside short ones."""
    tokenizer = bpe.load_tokenizer(bpe.vocabulary())
    mixed = "".join(chr(97 + i * i % 26) + str(i % 10) for i in range(500_000))
    texts = [f"short {mixed[:100_000]} words {mixed[:100_000]}!", mixed, "short words", "x" * 70_000 + " é", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode(docs, bpe.vocabulary()).select("doc_id", "ids", "decoded").collect()}
    assert len(got[1].ids) > 65_535
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == tokenizer.decode(ids, skip_special_tokens=False)
