"""Hidden Markov language model.

Training texts give every word's count. The most frequent words, at most EMITTED, are symbols of their own; the others
share one symbol for each of a few spellings, within which a word keeps its smoothed share of counts, so that the
probabilities of all words add up to one. Texts are encoded as symbols once. Baum-Welch runs over all training sequences: a partition adds up its expected
counts, Spark adds those of the partitions, and the next parameters follow. Scoring is the scaled forward recursion
over a whole text, plus the shares of its rarer words, which reach the text's row through a join on the word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import id_remainder, most_frequent, small_batches, stage, table

#: States; passes over all training texts; symbols of words; words whose counts are broadcast. All are fixed bounds.
STATES, PASSES, EMITTED, HEAD_WORDS = 8, 2, 20_000, 150_000
SMOOTH = 0.1
#: Spellings that rarer words are told apart by: ASCII or not, ended by a sign or not. Then the end of a text.
SHAPES = 4
COUNTED = 200_000
#: For training a text is cut into parts of so many tokens, so that many are worked on together: of PART moves one isn't
#: counted, and a part that isn't its text's first begins in the settled shares of states. Scoring never cuts. Tokens at once.
PART, AT_ONCE = 512, 200_000


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shape(word: bytes) -> int:
    return 2 * (not word.isascii()) + (not word[-1:].isalnum() and word[-1] < 128)


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c, shape) over all texts, by partial counts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()

        def so_far() -> pd.DataFrame:
            words = list(counts)
            return pd.DataFrame({"word": pd.Series(words, dtype=object), "c": list(counts.values()), "shape": [shape(w) for w in words]})

        for batch in batches:
            for text in batch["t"]:
                counts.update(tokens(text))
                if len(counts) > COUNTED:
                    yield so_far()
                    counts.clear()
        if counts:
            yield so_far()

    parts = docs.select(F.col(text_col).alias("t")).mapInPandas(count, "word binary, c long, shape int")
    return parts.groupBy("word", "shape").agg(F.sum("c").alias("c"))


class Head:
    """Numbers of the most frequent words by falling count, those under `emitted` symbols of their own; totals of all.

    By number, and last for a word without one: its symbol, what it adds to the base score, and what it adds to the
    model's score besides its symbol's probability (its share among the words of its spelling).
    """

    def __init__(self, words: list[bytes], counts: np.ndarray, emitted: int, shapes: np.ndarray, total: int, distinct: int, ends: int):
        order = np.argsort(-counts, kind="stable")
        self.number = {words[i]: k for k, i in enumerate(order)}
        n, self.words = counts[order].astype(float), min(emitted, len(order))
        self.total, self.distinct, self.ends = total, distinct, ends
        self.end = self.words + SHAPES
        self.symbols = self.end + 1
        self.base_norm = np.log10(total + SMOOTH * (distinct + 1))
        spelling = np.array([shape(w) for w in self.number], np.int64)
        #: smoothed mass of the words behind each spelling's symbol, with one unseen word in each
        own = spelling[: self.words]
        rest = np.maximum(shapes - np.stack([np.bincount(own, n[: self.words], SHAPES), np.bincount(own, minlength=SHAPES)], axis=1), 0)
        mass = rest[:, 0] + SMOOTH * (rest[:, 1] + 1)
        self.unigram = np.r_[n[: self.words] + SMOOTH, mass, ends + SMOOTH]
        self.norm = np.log10(mass)
        self.log = np.r_[np.log10(n + SMOOTH), 0.0]
        self.symbol = np.r_[np.arange(self.words), self.words + spelling[self.words :], -1]
        self.extra = np.r_[np.zeros(self.words), self.log[self.words : -1] - self.norm[spelling[self.words :]], 0.0]


def encode(docs: DataFrame, head: Head) -> DataFrame:
    """docs but for _text: each text's symbols, counts, what its words add to the two scores, and its rarer words."""
    shared, keep = docs.sparkSession.sparkContext.broadcast(head), [c for c in docs.columns if c != "_text"]
    names = [*keep, "symbols", "n_tokens", "n_known", "base", "extra", "rare", "times"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value
        number, end = h.number.get, float(np.log10(h.ends + SMOOTH))
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column("_text").to_pylist():
                words = tokens(text)
                at = np.fromiter(map(number, words, repeat(-1)), np.int64, len(words))
                symbols, extra = np.append(h.symbol[at], h.end), float(h.extra[at].sum())
                rare: Counter = Counter()
                for i in np.flatnonzero(at < 0).tolist():
                    s = shape(words[i])
                    symbols[i], extra = h.words + s, extra - h.norm[s]
                    rare[words[i]] += 1
                known = len(words) - rare.total() + (h.ends > 0)
                out.append((symbols.astype("<u2").tobytes(), len(symbols), known, end + float(h.log[at].sum()), extra, list(rare), list(rare.values())))
            columns = [pa.array(x, kind) for x, kind in zip(zip(*out), kinds)] if out else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names)

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kept}, symbols binary, n_tokens long, n_known long, base double, extra double, rare array<binary>, times array<long>"
    return docs.mapInArrow(work, schema)


class Parameters:
    """Start (K), transition (K, K) and emission (symbols, K) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit
        self.settled = start  # the share of each state far from the start
        for _ in range(200):
            self.settled = self.settled @ move

    @classmethod
    def initial(cls, unigram: np.ndarray, states: int) -> Parameters:
        """Unigram emissions, each state's tilted at random (from a fixed seed), and moves that tend to stay."""
        rng = np.random.default_rng(7)
        emit = unigram[:, None] * np.exp(1.5 * rng.standard_normal((len(unigram), states)))
        move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    @classmethod
    def estimated(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray) -> Parameters:
        """From expected counts; the smoothed unigram shares keep every symbol possible in every state."""
        states = len(start)
        prior = unigram / unigram.sum()
        emit = emit + 0.01 * unigram[:, None] / states + 1e-3 * prior[:, None]
        move, start = move + 1e-3, start + 1e-3
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def grouped(sequences: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Indexes of sequences of like length, longest first, about AT_ONCE symbols together."""
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    sizes = np.array([len(sequences[i]) for i in order])
    at = 0
    while at < len(order):
        n = max(1, AT_ONCE // max(1, int(sizes[at])))
        yield order[at : at + n]
        at += n


def by_time(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, alive): alive[t] sequences, sorted longest first, have a symbol at t; symbols are in order of time."""
    lengths = np.array([len(s) for s in sequences])
    alive = len(lengths) - np.searchsorted(lengths[::-1], np.arange(1, lengths[0] + 1))
    starts = np.r_[0, np.cumsum(alive)]
    flat = np.empty(starts[-1], np.int64)
    for k, s in enumerate(sequences):
        flat[starts[: len(s)] + k] = s
    return flat, alive


def log_likelihoods(sequences: list[np.ndarray], p: Parameters) -> np.ndarray:
    """log10 of each whole sequence's probability, by the scaled forward recursion."""
    out = np.zeros(len(sequences))
    for group in grouped(sequences):
        flat, alive = by_time([sequences[i] for i in group])
        total, at, alpha = np.zeros(len(group)), 0, None
        for n in alive.tolist():
            seen = p.emit[flat[at : at + n]]
            alpha = p.start * seen if alpha is None else (alpha[:n] @ p.move) * seen
            scale = alpha.sum(axis=1)
            alpha = alpha / scale[:, None]
            total[:n] += np.log10(scale)
            at += n
        out[group] = total
    return out


def expected_counts(
    sequences: list[np.ndarray], first: np.ndarray, p: Parameters, start: np.ndarray, move: np.ndarray, emit: np.ndarray
) -> None:
    """Forward and backward over the sequences; adds what they are expected to count. Only first ones count as starts."""
    for group in grouped(sequences):
        begins = first[group]
        begin = np.where(begins[:, None], p.start, p.settled)
        flat, alive = by_time([sequences[i] for i in group])
        alive, at = alive.tolist(), 0
        seen = p.emit[flat]
        alpha, scales, places = np.empty_like(seen), np.empty(len(flat)), []
        for t, n in enumerate(alive):
            a = begin * seen[:n] if t == 0 else (alpha[places[-1] : places[-1] + n] @ p.move) * seen[at : at + n]
            scale = a.sum(axis=1)
            alpha[at : at + n], scales[at : at + n] = a / scale[:, None], scale
            places.append(at)
            at += n
        beta = np.ones((len(group), len(p.start)))
        for t in range(len(alive) - 1, 0, -1):
            n, at, before = alive[t], places[t], places[t - 1]
            ahead = seen[at : at + n] * beta[:n] / scales[at : at + n, None]
            alpha[at : at + n] *= beta[:n]  # now the state probabilities at t
            move += p.move * (alpha[before : before + n].T @ ahead)
            beta[:n] = ahead @ p.move.T
        alpha[: alive[0]] *= beta[: alive[0]]
        alpha /= alpha.sum(axis=1, keepdims=True)
        start += alpha[: alive[0]][begins].sum(axis=0)
        for k in range(len(p.start)):
            emit[:, k] += np.bincount(flat, alpha[:, k], len(emit))


def baum_welch(encoded: DataFrame, p: Parameters, unigram: np.ndarray) -> Parameters:
    """One pass over all sequences of encoded."""
    spark, states, symbols = encoded.sparkSession, len(p.start), len(p.emit)
    shared = spark.sparkContext.broadcast(p)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = shared.value
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))
        for batch in batches:
            parts, first = [], []
            for raw in batch["symbols"]:
                whole = np.frombuffer(raw, "<u2").astype(np.int64)
                parts += [whole[i : i + PART] for i in range(0, len(whole), PART)]
                first += [i == 0 for i in range(0, len(whole), PART)]
            expected_counts(parts, np.array(first, bool), now, start, move, emit)
        values = np.r_[start, move.ravel(), emit.ravel()]
        used = np.flatnonzero(values)
        for i in range(0, len(used), 10_000):
            yield pd.DataFrame({"at": used[i : i + 10_000], "value": values[used[i : i + 10_000]]})

    sums = encoded.select("symbols").mapInPandas(work, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    values = np.zeros(states + states * states + symbols * states)  # its size is fixed by STATES and EMITTED
    values[sums["at"].to_numpy()] = sums["value"]
    start, move, emit = np.split(values, [states, states + states * states])
    return Parameters.estimated(start, move.reshape(states, states), emit.reshape(symbols, states), unigram)


def score(docs: DataFrame, learn: Column, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep columns of docs with n_tokens, n_known, train_tokens, base_score and score (log10).

    learn: which rows of docs the model learns from; all are scored. Null texts count as empty, which still have their
    end token. Rows may repeat, ids may be null, other columns may have any name. With no row to learn from every word
    is unknown; an empty table gives no rows.
    """
    keep = keep or ["doc_id"]
    plain = [f"_k{i}" for i in range(len(keep))]  # own names, so that none clashes
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.coalesce(learn, F.lit(False)).alias("_train"),
        *(F.col(f"`{c}`").alias(k) for c, k in zip(keep, plain)), F.col(text_col).alias("_text"),
    )
    training = rows.filter("_train")
    counts, ends = stage(count_words(training, "_text")), training.count()
    shapes = np.zeros((SHAPES, 2))
    for s, total, distinct in counts.groupBy("shape").agg(F.sum("c"), F.count("*")).collect():
        shapes[s] = total, distinct
    top = most_frequent(counts, HEAD_WORDS, "word", "c").select("word", "c").toArrow().to_pydict()
    total, distinct = int(shapes[:, 0].sum()) + ends, int(shapes[:, 1].sum()) + (ends > 0)
    head = Head(top["word"], np.array(top["c"], np.int64), EMITTED, shapes, total, distinct, ends)

    encoded = stage(encode(rows, head))
    p = Parameters.initial(head.unigram, STATES)
    for _ in range(PASSES if ends else 0):
        p = baum_welch(encoded.filter("_train"), p, head.unigram)

    rare = encoded.select("_row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("_row", F.col("x.rare").alias("word"), "x.times")
    known = rare.join(counts.select("word", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = known.groupBy("_row").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + SMOOTH)).alias("_more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("_seen")
    )
    more = F.coalesce("_more", F.lit(0.0))
    return _forward(encoded.drop("rare", "times"), p).join(sums, "_row", "left").select(
        *(F.col(k).alias(c) for c, k in zip(keep, plain)), "n_tokens", (F.col("n_known") + F.coalesce("_seen", F.lit(0))).alias("n_known"),
        F.lit(head.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(float(head.base_norm))).alias("base_score"),
        (F.col("forward") + F.col("extra") + more).alias("score"),
    )


def _forward(encoded: DataFrame, p: Parameters) -> DataFrame:
    shared = encoded.sparkSession.sparkContext.broadcast(p)

    @F.pandas_udf("double")
    def forward(symbols: pd.Series) -> pd.Series:
        return pd.Series(log_likelihoods([np.frombuffer(s, "<u2").astype(np.int64) for s in symbols], shared.value))

    return encoded.withColumn("forward", forward("symbols")).drop("symbols")


def op10_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_remainder("doc_id", 10) == 0)
    return score(docs, ~F.col("held_out"), keep=["doc_id", "held_out"])
