"""Integer shares of a sample, eligibility for splits and selection of a split."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TEST_FAMILY = ("test", "test-public", "test-private")


def largest_remainder(weights: DataFrame, total: int) -> DataFrame:
    """weights (name, weight; a short list) with whole shares of total that add up to it; all 0 without weight."""
    whole = weights.agg(F.sum("weight").alias("_sum"))
    rows = weights.crossJoin(F.broadcast(whole)).withColumn("_exact", F.when(F.col("_sum") > 0, F.lit(max(total, 0)) * F.col("weight") / F.col("_sum")).otherwise(0.0))
    rows = rows.withColumn("_floor", F.floor("_exact"))
    turn = F.row_number().over(Window.orderBy(F.desc(F.col("_exact") - F.col("_floor")), "name"))
    left = F.lit(max(total, 0)) - F.sum("_floor").over(Window.partitionBy())
    share = F.when(F.col("_sum") > 0, F.col("_floor") + (turn <= left).cast("long")).otherwise(F.lit(0))
    return rows.withColumn("share", share.cast("long")).select(*weights.columns, "share")


def repo_quotas(repos: DataFrame, weights: DataFrame, total: int) -> DataFrame:
    """repos (name of the group, repo, ord) with quota: total over the groups by weight, then evenly, first ones first."""
    shares = largest_remainder(weights.join(repos.select("name").distinct(), "name", "left_semi"), total).select("name", "share")
    group = Window.partitionBy("name")
    rows = repos.join(F.broadcast(shares), "name", "left").withColumns({"_n": F.count("*").over(group), "_turn": F.row_number().over(group.orderBy("ord"))})
    missing = F.raise_error(F.lit("a group without a weight")).cast("long")
    share = F.coalesce("share", missing)
    quota = F.floor(share / F.col("_n")) + (F.col("_turn") <= share % F.col("_n")).cast("long")
    return rows.select(*repos.columns, quota.cast("long").alias("quota"))


def allocated(total: int, caps: np.ndarray) -> np.ndarray:
    """total over slots that hold caps at most: round by round evenly over the open ones, the first taking what is over."""
    given, left = np.zeros(len(caps), np.int64), max(0, total)
    while left and (is_open := given < caps).any():
        n = int(is_open.sum())
        offer = np.zeros_like(given)
        offer[is_open] = left // n + (np.arange(n) < left % n)
        grant = np.minimum(offer, np.maximum(caps - given, 0))
        given, left = given + grant, left - int(grant.sum())
    return given


def allocate(slots: DataFrame, group: str, total: str) -> DataFrame:
    """slots (group, ord, cap and the group's total; a short list a group) with share."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        return rows.assign(share=allocated(int(rows[total].iloc[0]), rows["cap"].to_numpy(np.int64)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slots.schema.fields)
    return slots.groupBy(group).applyInPandas(of, f"{schema}, share long")


def eligible(prs: DataFrame, gold: DataFrame, excluded: list[str], renames: dict[str, str]) -> DataFrame:
    """prs (repo, number, corpus, source, split, ...) that take part in splits, with fixed, the split they have to keep.

    Human PRs with gold and approval-only ones, outside excluded repos by their present names; benchmark PRs are
    always in the test split, whatever their repo.
    """
    now = {k.strip().lower(): v.lower() for k, v in renames.items()}
    gone = [now.get(x.strip().lower(), x.strip().lower()) for x in excluded]
    name = F.lower(F.trim("repo"))
    for old, new in now.items():
        name = F.when(name == old, new).otherwise(name)
    bench = F.col("source") == "benchmark"
    has_gold = prs.join(gold.select("repo", "number").distinct().withColumn("_gold", F.lit(True)), ["repo", "number"], "left")
    fits = ((F.col("corpus") == "human") & F.col("_gold").isNotNull()) | (F.col("corpus") == "approval_only")
    kept = has_gold.filter(fits & (bench | ~name.isin(gone)))
    return kept.withColumn("fixed", F.when(bench, "test").otherwise(F.col("split"))).select(*prs.columns, "fixed")


def select_split(assigned: DataFrame, split: str, dev: str = "dev") -> DataFrame:
    """(repo, number) of a split of assigned (repo, number, split, fixed, benchmark), in order; test is all of its kinds.

    The dev split is every PR but benchmark ones, and refused once splits are stored: it would mix them.
    """
    if split == dev:
        ours = assigned.filter("NOT benchmark")
        if ours.filter("fixed IS NOT NULL").limit(1).count():
            raise ValueError(f"splits are stored: {dev!r} would mix train and validation")
        return ours.select("repo", "number").orderBy("repo", "number")
    if split not in (*TEST_FAMILY, "train", "validation"):
        raise ValueError(f"unknown split {split!r}")
    return assigned.filter(F.col("split").isin(list(TEST_FAMILY) if split == "test" else [split])).select("repo", "number").orderBy("repo", "number")
