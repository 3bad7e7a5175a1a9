"""Language identification by known words first, then by progressively shorter character n-grams.

The model is learned from a bounded sample of labelled documents: how often each word and each n-gram of 1 to 4
characters occurs in each language. A known word adds its log frequency in each language. An unseen word falls back to
the longest n-gram order at which it has any known n-gram, and adds the mean of those.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_name, id_remainder, lucky_ids, small_batches, stage, table

#: Labelled documents (about) that the model is fitted on, which bounds it; longest n-gram; words a worker remembers.
SAMPLE_DOCS, LONGEST, REMEMBERED = 1_500, 4, 50_000
SMOOTH, UNKNOWN = 0.5, "und"
#: Runs of letters and of other signs that count as word characters, such as superscript figures, which are no letters.
RUN, LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text, in lower case."""
    runs = RUN.findall((text or "").lower())
    return runs if all(map(str.isalpha, runs)) else [w for r in runs for w in LETTERS.findall(r)]


class Model:
    """Log frequencies of words and n-grams per language; rows of the scores belong to the words and n-grams."""

    def __init__(self, languages: list[str], words: pa.Table, grams: pa.Table):
        self.languages = languages
        self.words, self.scores = self._table(words)
        self.grams, self.gram_scores = self._table(grams)
        self.memo: dict[str, np.ndarray] = {}

    def _table(self, counts: pa.Table) -> tuple[dict[str, int], np.ndarray]:
        at = {language: i for i, language in enumerate(self.languages)}
        keys: dict[str, int] = {}
        rows = [keys.setdefault(k, len(keys)) for k in counts["key"].to_pylist()]
        n = np.zeros((len(keys), max(1, len(at))))
        n[rows, [at[x] for x in counts["lang"].to_pylist()]] = counts["n"]
        totals = np.maximum(n.sum(axis=0), 1)
        return keys, np.log(n / totals + SMOOTH / totals.max())  # unseen weighs the same in every language

    def backoff(self, word: str) -> np.ndarray:
        """Mean of the known n-grams of the longest order that has any; the marks of a word's ends alone are none."""
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= REMEMBERED:
                self.memo.clear()
            found, padded = np.zeros(len(self.languages)), f"^{word}$"
            for size in range(LONGEST, 0, -1):
                pieces = [padded[i : i + size] for i in range(len(padded) - size + 1)] if size > 1 else list(word)
                known = [at for g in pieces if (at := self.grams.get(g)) is not None]
                if known:
                    found = self.gram_scores[known].mean(axis=0)
                    break
            self.memo[word] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.languages:
            return UNKNOWN, 0.0
        ids = np.array([self.words.get(w, -1) for w in words])
        total = self.scores[ids[ids >= 0]].sum(axis=0) if len(self.scores) else np.zeros(len(self.languages))
        for i in np.flatnonzero(ids < 0).tolist():
            total = total + self.backoff(words[i])
        odds = np.exp(total - total.max())
        best = int(np.argmax(odds))
        return self.languages[best], float(odds[best] / odds.sum())


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """The model of docs with a language: about SAMPLE_DOCS of them, chosen by a hash of the id; all their words."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    words = F.split(F.lower(F.col(text_col)), r"[^\p{L}]+")
    counts = lucky_ids(known, SAMPLE_DOCS, id_col).select(F.col(lang_col).alias("lang"), F.explode(words).alias("key")).filter("key <> ''")
    counts = stage(counts.groupBy("lang", "key").agg(F.count("*").alias("n")))
    padded = F.concat(F.lit("^"), F.col("key"), F.lit("$"))
    lengths = F.sequence(F.lit(2), F.least(F.lit(LONGEST), F.length("key") + 2))
    parts = F.transform(
        lengths, lambda k: F.transform(F.sequence(F.lit(1), F.length("key") + 3 - k), lambda i: F.substring(padded, i, k))
    )
    parts = F.concat(F.flatten(parts), F.filter(F.split("key", ""), lambda c: c != ""))
    grams = counts.select("lang", "n", F.explode(parts).alias("key")).groupBy("lang", "key").agg(F.sum("n").alias("n"))
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    return Model(languages, counts.select("lang", "key", "n").toArrow(), grams.select("lang", "key", "n").toArrow())


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, the probability of that language among those learned.

    `und` with score 0 for a null text, one without a letter, or if no language was learned. Of equal languages the
    first by name is predicted. Columns of docs named like the two are replaced; whole texts are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    rest = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    found = free_name(docs, "_language")
    marked = docs.select(*(f"`{c}`" for c in rest), of(text_col).alias(found))
    return marked.select(*(f"`{c}`" for c in rest), f"{found}.lang_pred", f"{found}.score")


def held_out() -> Column:
    return id_remainder("doc_id", 4) == 2


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
