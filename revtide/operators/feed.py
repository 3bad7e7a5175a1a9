"""The sample of rounds that a proposer reads: whole pull requests, gold first, Important ones at the pool's share."""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import salted_hash
from .sampling import largest_remainder

#: A pull request waits in the queue of its gold: Important issues, other issues, none.
QUEUES = ("important", "gold", "rest")


def queue(issues: Column, important: Column) -> Column:
    return F.when(important > 0, "important").when(issues > 0, "gold").otherwise("rest")


def quotas(pool: DataFrame, size: int) -> DataFrame:
    """(language, quota): size over the languages by their rounds; all rounds if they are no more than size."""
    rounds = pool.groupBy("language").agg(F.sum(F.size("rounds")).alias("rounds"))
    shares = largest_remainder(rounds.select(F.col("language").alias("name"), F.col("rounds").cast("double").alias("weight")), size)
    whole = rounds.agg(F.sum("rounds").alias("_all"))  # one row
    found = rounds.join(shares.select(F.col("name").alias("language"), "share"), "language").crossJoin(F.broadcast(whole))
    return found.select("language", F.when(F.col("_all") <= size, F.col("rounds")).otherwise(F.col("share")).cast("long").alias("quota"))


def important_share(rows: DataFrame) -> DataFrame:
    """(language, important_share): of the pull requests with a gold set, those with an Important issue; 0 without any."""
    gold = F.col("gold_set").cast("int")
    return rows.groupBy("language").agg(F.coalesce(F.sum(gold * (F.col("important") > 0).cast("int")) / F.nullif(F.sum(gold), F.lit(0)), F.lit(0.0)).alias("important_share"))


def reachable(pool: DataFrame, salt: str, most: DataFrame) -> DataFrame:
    """pool with quota, and only the rows that the draw of a language can come to.

    It takes the first pull request of a queue that fits, so of each queue and number of rounds at most the first
    `quota` are ever looked at. Those are found by their hash: first by its beginning, then in order.
    """
    key = F.concat_ws("#", "repo", F.col("number").cast("string"))
    rows = pool.withColumn("_hash", salted_hash(salt, key)).join(F.broadcast(most), "language")  # a row a language
    group = ["language", "_queue", F.size("rounds")]
    rows = rows.withColumn("_queue", queue(F.col("issues"), F.col("important"))).filter(F.size("rounds") <= F.col("quota"))
    turn = F.row_number().over(Window.partitionBy(*group, F.substring("_hash", 1, 2)).orderBy("_hash"))
    first = rows.withColumn("_turn", turn).filter(F.col("_turn") <= F.col("quota"))
    turn = F.row_number().over(Window.partitionBy(*group).orderBy("_hash"))
    return first.withColumn("_turn", turn).filter(F.col("_turn") <= F.col("quota")).drop("_turn")


def drawn(rows: list[tuple[str, int]], quota: int, share: float) -> list[int]:
    """Places of the rows (queue, number of rounds), in hash order, that a draw of `quota` rounds takes, in its order.

    Each time the Important queue comes first while fewer than the rounded share of those taken so far and this one are
    Important, else the queue of other gold; then the other of the two, then the rest.
    """
    waiting: dict[tuple[str, int], deque[int]] = {}
    for place, row in enumerate(rows):
        waiting.setdefault(row, deque()).append(place)
    taken, room, important = [], quota, 0
    while room > 0:
        ahead = important < math.floor(share * (len(taken) + 1) + 0.5)
        for name in ("important", "gold", "rest") if ahead else ("gold", "important", "rest"):
            fits = [(places[0], n) for (q, n), places in waiting.items() if q == name and places and n <= room]
            if fits:
                place, n = min(fits)
                waiting[name, n].popleft()
                taken.append(place)
                room, important = room - n, important + (name == "important")
                break
        else:
            break
    return taken


def feed_sample(pool: DataFrame, size: int, salt: str) -> DataFrame:
    """pool (repo, number, language, rounds, gold_set, issues, important) with turn, for those drawn: `size` rounds in all.

    Pull requests without a round take no part; whole ones only, so a language may stay under its quota. A null language
    is one of its own, named as the empty string.
    """
    named = pool.filter(F.size("rounds") > 0).withColumn("language", F.coalesce("language", F.lit("")))
    rows = reachable(named, salt, quotas(named, size).join(important_share(named), "language"))

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_hash", kind="stable")
        some = list(zip(group["_queue"], group["rounds"].map(len)))
        taken = drawn(some, int(group["quota"].iloc[0]), float(group["important_share"].iloc[0]))
        return group.iloc[taken].assign(turn=range(1, len(taken) + 1))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy("language").applyInPandas(draw, f"{schema}, turn int").select(*pool.columns, "turn")


def composition(pool: DataFrame, sample: DataFrame) -> DataFrame:
    """Counts of a sample beside its pool's, by language, and of all languages (`all`)."""
    named = lambda df: df.filter(F.size("rounds") > 0).withColumn("language", F.coalesce("language", F.lit("")))
    has = lambda c: F.sum((F.col(c) > 0).cast("long"))
    later = F.size("rounds") - F.array_contains("rounds", 1).cast("int")

    def both(rows: DataFrame, *measures: Column) -> DataFrame:
        return rows.rollup("language").agg(*measures).withColumn("language", F.coalesce("language", F.lit("all")))

    chosen = both(
        named(sample), F.sum(F.size("rounds")).alias("pr_rounds"), F.count("*").alias("prs"), F.sum(later).alias("later_rounds"), has("issues").alias("with_gold_issue"),
        has("important").alias("with_important"), F.sum("issues").alias("gold_issues"), F.sum("important").alias("important_issues"),
    )
    gold = F.col("gold_set").cast("int")
    share = F.coalesce(F.sum(gold * (F.col("important") > 0).cast("int")) / F.nullif(F.sum(gold), F.lit(0)), F.lit(0.0))
    whole = both(named(pool), F.sum(F.size("rounds")).alias("pool_pr_rounds"), F.count("*").alias("pool_prs"), has("issues").alias("pool_with_gold_issue"), F.round(share, 4).alias("pool_important_share"))
    return whole.join(chosen, "language", "left").fillna(0)
