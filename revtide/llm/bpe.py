"""BPE encoding and decoding through a table of distinct words.

White space always separates tokens of this vocabulary's pre-tokenizer, and so does the start of the signs that end a
word, so a text's ids are the ids of its words one after the other. A pass over the texts splits them. It writes a text
as the numbers of its words, and each distinct word of a chunk of texts once, with its number in that chunk. The
distinct words of all chunks are the word table: each is encoded once and decoded through a join of its ids with the
vocabulary's pieces. The table's rows go back to the chunks by a join on the word, and in each chunk the ids reach
their places in the texts by the words' numbers.

Words are joined once a chunk and not once an occurrence, so no key is hot. The numbered texts are written in buckets
of chunks and don't move again. A sample of documents names words so frequent that nearly every chunk has them: they
have fixed numbers, the most frequent the lowest, and their rows of the word table are broadcast. Which words those are changes no result.
"""

from __future__ import annotations

import os
import re
import uuid
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lucky_ids, shared_folder, small_batches, stage, table

#: Documents (about) that name the frequent words, how many of those are broadcast at most, and tasks that encode them.
SAMPLE_DOCS, HEAD_WORDS, HEAD_TASKS = 20_000, 400_000, 32
#: A chunk of texts ends after so many words (a text isn't cut).
CHUNK_WORDS = 5_000_000
#: How ids of this vocabulary, which are under 65,536, are packed.
ID = "<u2"
#: Words that go back to the chunks in one batch; texts of a chunk that get their ids at once.
PACKED_WORDS, TEXTS_AT_ONCE = 200_000, 500
#: A longer word goes by its hash where its ids have a row each, so that such rows stay small.
LONG_WORD = 64
#: Buckets of the numbered texts for each partition of the input, and at most.
BUCKETS_PER_PARTITION, MOST_BUCKETS = 4, 20_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: A word, apart from the signs that end it: the pre-tokenizer separates them too. Else what white space separates.
PART = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[.,;:!?%*#$&]++(?:[ \t-\r]|\Z))|[^ \t-\r]+")


#: How special tokens of the vocabulary begin, and one that separates words encoded in one go.
SPECIAL, SEPARATOR = "<|", "<|endoftext|>"


def plain_lower(text: str) -> str:
    """A-Z to a-z where the tokenizer's own lower-casing gives the same: not beside special tokens or combining marks."""
    raw = text.encode()
    return text if SPECIAL in text or b"\xcc" in raw or b"\xcd" in raw else raw.lower().decode()


class IdCache:
    """Ids of whole texts (little-endian unsigned 32-bit); remembers at most `most` words, the oldest half goes first."""

    def __init__(self, path: str, most: int):
        tokenizer = load_tokenizer(path)
        self.encode_batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        self.ids, self.most, self.separator = {}, most, tokenizer.token_to_id(SEPARATOR)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        parts, gaps, missing = [], [], set()
        for text in texts:
            words = PART.findall(plain_lower(text or ""))
            found = list(map(self.ids.get, words))
            parts.append(found)
            if None in found:
                open_at = [(i, words[i]) for i, x in enumerate(found) if x is None]
                missing.update(w for _, w in open_at)
                gaps.append((found, open_at))
        new = self.encoded(list(missing))
        for found, open_at in gaps:
            for i, w in open_at:
                found[i] = new[w]
        if len(self.ids) + len(new) > self.most:
            self.ids = dict(islice(self.ids.items(), len(self.ids) // 2, None))
        self.ids.update(new)
        return list(map(b"".join, parts))

    def encoded(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words: many in one go, apart by a special token; words that may hold one on their own."""
        odd, plain = [w for w in words if SPECIAL in w], [w for w in words if SPECIAL not in w]
        ids = {w: array("I", e.ids).tobytes() for w, e in zip(odd, self.encode_batch(odd, add_special_tokens=False))}
        for i in range(0, len(plain), 1_000):
            some = plain[i : i + 1_000]
            found = np.array(self.encode_batch([SEPARATOR.join(some)], add_special_tokens=False)[0].ids, "<u4")
            raw, start = found.tobytes(), 0
            for w, end in zip(some, [*(4 * np.flatnonzero(found == self.separator)).tolist(), len(raw)], strict=True):
                ids[w], start = raw[start:end], end + 4
        return ids


@lru_cache(maxsize=1)
def worker_cache(path: str, most: int) -> IdCache:
    """One for all tasks of a Python worker."""
    return IdCache(path, most)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece): the vocabulary, whose size is fixed."""
    rows = sorted((i, p) for p, i in load_tokenizer(path).get_vocab(with_added_tokens=True).items())
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "piece"]), "id int, piece string")


def named(word: str) -> tuple[Column, Column]:
    """The name that a word goes by (itself, or for a long one a blank and its hash: no word has a blank), and a long word."""
    long = F.length(word) > LONG_WORD
    return F.when(long, F.concat(F.lit(" "), F.sha2(word, 256))).otherwise(F.col(word)), F.when(long, F.col(word))


def named_table(words: DataFrame, path: str) -> DataFrame:
    """words (name, long), distinct -> (name, ids, decoded): encoded once each, decoded by joining their ids with the pieces.

    Every id of a word has a row of its own, which carries the name only.
    """

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = IdCache(path, 0)
        for some in batches:
            ids = tokenizer.encoded(some.tolist())
            yield pd.Series([np.frombuffer(ids[w], "<u4").astype(np.int32) for w in some])

    coded = words.select("name", encoded(F.coalesce("long", "name")).alias("ids"))
    exploded = coded.select("name", F.posexplode_outer("ids").alias("at", "id"))
    joined = exploded.join(F.broadcast(pieces(words.sparkSession, path)), "id", "left")
    place = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("id").cast("long"))  # by which pieces sort
    parts = F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct(place.alias("place"), "piece"))))
    found = joined.groupBy("name").agg(parts.alias("parts"))
    ids = F.transform("parts", lambda x: x["place"].bitwiseAND(F.lit(2**31 - 1)).cast("int"))
    return found.select("name", ids.alias("ids"), F.array_join(F.transform("parts", lambda x: x["piece"]), " ").alias("decoded"))


def word_table(words: DataFrame, path: str) -> DataFrame:
    """words (word), distinct -> (word, ids, decoded)."""
    name, long = named("word")
    rows = words.select("word", name.alias("name"), long.alias("long"))
    return rows.join(named_table(rows.select("name", "long"), path), "name").select("word", "ids", "decoded")


class Head:
    """The frequent words, numbered from 0, with their ids one after the other and their decoded texts."""

    def __init__(self, words: list[str], found: pa.Table):
        at = {w: i for i, w in enumerate(found["name"].to_pylist())}
        found = found.take(pa.array([at[w] for w in words], pa.int64())).combine_chunks()
        self.lengths = np.array(pc.list_value_length(found["ids"]), np.uint32)
        self.ids = np.array(pc.list_flatten(found["ids"]), np.int32)
        self.words, self.said, self.size = "\n".join(words), "\n".join(found["decoded"].to_pylist()), len(words)

    @cached_property
    def number(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.words.split("\n"))} if self.size else {}

    @cached_property
    def decoded(self) -> list[str]:
        return self.said.split("\n") if self.size else []


def frequent_words(docs: DataFrame, path: str, most: int = HEAD_WORDS) -> Head:
    """The most frequent words of about SAMPLE_DOCS of docs (_text), at most `most` of them and none that is long."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [w for text in batch["_text"] if text for w in PART.findall(plain_lower(text))]
            for i in range(0, len(found), 50_000):
                yield pd.DataFrame({"word": pd.Series(found[i : i + 50_000], dtype=object)})

    counts = lucky_ids(docs, SAMPLE_DOCS, "_text").mapInPandas(split, "word string").filter(F.length("word") <= LONG_WORD).groupBy("word").count()
    words = stage(counts.orderBy(F.desc("count"), "word").limit(most)).orderBy(F.desc("count"), "word").select("word")
    return Head(words.toArrow()["word"].to_pylist(), named_table(words.select(F.col("word").alias("name"), F.lit(None).cast("string").alias("long")).repartition(HEAD_TASKS, "name"), path).toArrow())


def numbered(docs: DataFrame, head, keep: list[str]) -> DataFrame:
    """Rows of two kinds by _chunk: keep and the _numbers of a text's words, or a _word with its _number in the chunk."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = head.value.number
        first, chunk, words = TaskContext.get().partitionId() << 24, 0, 0
        known = dict(frequent)

        def new_words() -> Iterator[pa.RecordBatch]:
            tail = list(islice(known, len(frequent), None))
            for i in range(0, len(tail), 20_000):
                some = tail[i : i + 20_000]
                at = pa.array(range(len(frequent) + i, len(frequent) + i + len(some)), pa.int32())
                yield out([None] * len(keep), len(some), None, at, pa.array(some, pa.string()))

        def out(kept, n, numbers, at, word) -> pa.RecordBatch:
            columns = [pa.nulls(n, kind) if x is None else x for x, kind in zip([*kept, numbers, at, word], kinds)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, first + chunk)), *columns], ["_chunk", *names])

        for batch in batches:
            kinds = [*(batch.column(c).type for c in keep), pa.binary(), pa.int32(), pa.string()]
            texts = []
            for text in batch.column("_text").to_pylist():
                parts = PART.findall(plain_lower(text or ""))
                found = list(map(known.get, parts))
                if None in found:
                    for i, x in enumerate(found):
                        if x is None:
                            found[i] = known.setdefault(parts[i], len(known))
                texts.append(array("I", found).tobytes())
                words += len(found)
            yield out([batch.column(c) for c in keep], len(texts), pa.array(texts, pa.binary()), None, None)
            if words > chunk_words:
                yield from new_words()
                chunk, words, known = chunk + 1, 0, dict(frequent)
        if words:
            yield from new_words()

    names, chunk_words = [*keep, "_numbers", "_number", "_word"], CHUNK_WORDS
    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, "_text").mapInArrow(split, f"_chunk long, {kept}_numbers binary, _number int, _word string")


def bucketed(rows: DataFrame, key: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """rows, written to the shared folder in buckets of key: what is grouped by key later doesn't move. And read plainly."""
    spark, name = rows.sparkSession, f"buckets_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    rows.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").saveAsTable(name)
    return spark.table(name), spark.read.schema(rows.schema).parquet(path)


def packed(found: DataFrame) -> DataFrame:
    """Words (_of, _number, ids, decoded) -> rows that hold many words of one chunk, as they lie together in a task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= PACKED_WORDS:
                yield from of(held)
                held, size = [], 0
        if size:
            yield from of(held)

    def of(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).sort_by([("_of", "ascending"), ("_number", "ascending")]).combine_chunks()
        chunks, lists, decoded = np.array(rows["_of"]), rows["ids"].chunk(0), rows["decoded"].to_pylist()
        numbers, lengths, ids = np.array(rows["_number"], "<u4"), np.array(pc.list_value_length(lists), "<u4"), np.array(pc.list_flatten(lists), ID)
        ends = np.cumsum(lengths)
        first = np.flatnonzero(np.r_[True, chunks[1:] != chunks[:-1]])
        columns: list[list] = [[], [], [], []]
        for a, b in zip(first, [*first[1:], len(chunks)]):
            some = ids[ends[a] - lengths[a] : ends[b - 1]]
            for column, x in zip(columns, (numbers[a:b].tobytes(), lengths[a:b].tobytes(), some.tobytes(), "\n".join(decoded[a:b]))):
                column.append(x)
        kinds = (pa.binary(), pa.binary(), pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(chunks[first]), *map(pa.array, columns, kinds)], ["_of", "numbers", "lengths", "ids", "decoded"])

    return found.mapInArrow(pack, "_of long, numbers binary, lengths binary, ids binary, decoded string")


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The keep columns of docs (all, if not given) with ids (array of int) and decoded (string) of the whole text.

    As the tokenizers library gives them without special tokens, truncation or padding. A null or empty text has no
    ids. Columns of docs named ids or decoded are replaced; rows may repeat and ids may be null; other columns may have
    any name; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kept = [c for c in keep or docs.columns if c.lower() not in ("ids", "decoded")]
    plain = [f"_k{i}" for i in range(len(kept))]  # own names, so that none clashes
    rows = docs.select(*(F.col(f"`{c}`").alias(p) for c, p in zip(kept, plain)), F.col(text_col).alias("_text"))
    head = spark.sparkContext.broadcast(frequent_words(rows, path, HEAD_WORDS))
    buckets = min(MOST_BUCKETS, BUCKETS_PER_PARTITION * max(1, rows.rdd.getNumPartitions()))
    chunks, unordered = bucketed(numbered(rows, head, plain), "_chunk", buckets)
    name, long = named("_word")
    spoken = unordered.filter("_word IS NOT NULL")
    words = spoken.select(F.col("_chunk").alias("_of"), "_number", name.alias("name")).repartition("name")
    # the aggregate reads all columns, so that the words go through one exchange for it and for the join; long words, which are few, on their own
    distinct = words.groupBy("name").agg(F.min(F.struct("_of", "_number")).alias("first")).filter("first IS NOT NULL").select("name")
    longs = spoken.filter(long.isNotNull()).groupBy(name.alias("name")).agg(F.max("_word").alias("long"))
    found = words.join(named_table(distinct.join(longs, "name", "left"), path), "name").select("_of", "_number", "ids", "decoded")
    found = packed(found)

    def assemble(texts: pa.Table, tail: pa.Table) -> pa.Table:
        h = head.value
        column = lambda name, kind: np.frombuffer(b"".join(tail[name].to_pylist()), kind)
        own, ids = column("lengths", "<u4").astype(np.int64), column("ids", ID).astype(np.int32)
        order = np.argsort(column("numbers", "<u4"))
        begins = (np.cumsum(own) - own)[order] + len(h.ids)
        head_own = h.lengths.astype(np.int64)
        lengths, flat = np.concatenate([head_own, own[order]]), np.concatenate([h.ids, ids])
        starts = np.concatenate([np.cumsum(head_own) - head_own, begins])
        said = "\n".join(tail["decoded"].to_pylist()).split("\n") if len(order) else []
        decoded = np.array([*h.decoded, *(said[i] for i in order)], object)

        def of(some: pa.Table) -> pa.Table:
            raw = some["_numbers"].to_pylist()
            numbers = np.frombuffer(b"".join(raw), "<u4")
            ends = np.cumsum([len(x) // 4 for x in raw])
            n = lengths[numbers]
            before = np.concatenate([[0], np.cumsum(n)])
            at = np.repeat(starts[numbers] - before[:-1], n) + np.arange(before[-1])
            offsets = np.concatenate([[0], before[ends]]).astype(np.int32)
            texts_of = [" ".join(filter(None, x)) for x in np.split(decoded[numbers], ends[:-1])]
            result = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[at])), pa.array(texts_of, pa.string())]
            return pa.Table.from_arrays([*(some[p].combine_chunks() for p in plain), *result], [*plain, "ids", "decoded"])

        return pa.concat_tables([of(texts.slice(i, TEXTS_AT_ONCE)) for i in range(0, len(texts), TEXTS_AT_ONCE)])

    kinds = ", ".join(f"`{p}` {rows.schema[p].dataType.simpleString()}" for p in plain)
    texts = chunks.filter("_numbers IS NOT NULL").select("_chunk", *plain, "_numbers")
    grouped = texts.groupBy("_chunk").cogroup(found.groupBy("_of"))
    joined = grouped.applyInArrow(assemble, f"{kinds}, ids array<int>, decoded string")
    return joined.select(*(F.col(p).alias(c) for c, p in zip(kept, plain)), "ids", "decoded")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = encode(table(spark, sf_dir, "documents"), vocabulary(), keep=["doc_id"])
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
