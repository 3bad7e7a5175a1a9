"""Removals, attribution, manifests and merges of stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def neutralize(text: Column, tags: list[str]) -> Column:
    """text in which the opening and closing block tags no longer work."""
    return F.regexp_replace(text, rf"(?i)<(/?\s*(?:{'|'.join(tags)})\b)", r"&lt;$1")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of incoming keys replace all stored rows of those keys."""
    return stored.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def merge_keeping(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows stay; incoming ones of new keys are added, the first of each key."""
    new = incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")
    return stored.withColumn("added", F.lit(False)).unionByName(new.withColumn("added", F.lit(True)))


def remove(rows: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(removed.select(*keys).distinct(), keys, "left_anti")


def remove_gold(gold: DataFrame, dropped: DataFrame) -> DataFrame:
    """gold (gold_id, source_threads) without issues built from a dropped thread (thread_id)."""
    hit = gold.select("gold_id", F.explode("source_threads").alias("thread_id")).join(dropped, "thread_id", "left_semi")
    return gold.join(hit.select("gold_id").distinct(), "gold_id", "left_anti")


def leaks(rows: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """How many exported rows carry a removed key; must be 0."""
    return rows.join(removed, keys, "left_semi").agg(F.count("*").alias("leaks"))


def attribution(rows: DataFrame, text: str) -> DataFrame:
    """rows with the SHA-256 of the text as exported."""
    return rows.withColumn("sha256", F.sha2(F.coalesce(text, F.lit("")), 256))


def verify_text(attributed: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """attributed (key, sha256) against fetched (key, text): accepted, changed or missing."""
    rows = attributed.select(key, "sha256").join(fetched.select(key, "text"), key, "left")
    same = F.sha2(F.col("text"), 256) == F.col("sha256")
    return rows.select(key, F.when(F.col("text").isNull(), "missing").when(same, "accepted").otherwise("changed").alias("status"))


def manifest(**kinds: DataFrame) -> DataFrame:
    """(kind, records) of the exported tables."""
    counts = [df.agg(F.lit(kind).alias("kind"), F.count("*").alias("records")) for kind, df in kinds.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


def contaminated(splits: DataFrame, order: list[str]) -> DataFrame:
    """splits (item, split, text): texts that are equal up to case and white space, given to the earliest split."""
    norm = F.sha2(F.regexp_replace(F.lower(F.trim(F.col("text"))), r"\s+", " "), 256)
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("split"))
    rows = splits.select("item", "split", norm.alias("_h"), rank.alias("_rank"))
    first = rows.groupBy("_h").agg(F.min("_rank").alias("_first"), F.count("*").alias("copies"))
    kept = F.col("_rank") == F.col("_first")
    return rows.join(first.filter("copies > 1"), "_h").select("item", "split", "copies", kept.alias("kept"))
