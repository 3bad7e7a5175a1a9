"""Context packs: files chosen under several budgets, and statistics of packs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import running_sum, value_bucket
from .contamination import staged
from .paths import distance, is_test


@dataclass(frozen=True)
class PackBudget:
    max_files: int = 60
    max_bytes: int = 2_000_000
    max_file_bytes: int = 200_000
    max_referencing: int = 20


def ordered_references(hits: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """hits (keys, path, hits) with role and turn: most hits first, then the fewest folder steps to a changed file, then path."""
    pairs = hits.join(changed.select(*keys, F.col("path").alias("_c")), keys, "left")
    near = pairs.groupBy(*keys, "path", "hits").agg(F.min(distance(F.col("path"), F.col("_c"))).alias("steps"))
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("hits"), F.asc_nulls_last("steps"), "path"))
    return near.select(*keys, "path", "hits", "steps", F.when(is_test(F.col("path")), "test").otherwise("referencing").alias("role"), turn.alias("turn"))


def packed(candidates: DataFrame, keys: list[str], budget: PackBudget) -> DataFrame:
    """candidates (keys, path, commit, role, ord, bytes or null, turn or null) with taken and skipped (a reason or null).

    Files are taken in order of ord. A file that doesn't fit is skipped with its reason and later ones may still fit; once
    files or bytes are used up, all others are. Of a path and commit the first candidate counts, the others go.
    bytes null: unreadable. turn: a referencing file's, at most max_referencing. The rows of one pack, without their
    texts, are one group: a pack's candidates are the files of one change and what refers to it.
    """
    first = Window.partitionBy(*keys, "path", "commit").orderBy("ord")
    rows = candidates.withColumn("_first", F.row_number().over(first)).filter("_first = 1").drop("_first")
    most_files, most_bytes, most_file, most_turns = budget.max_files, budget.max_bytes, budget.max_file_bytes, budget.max_referencing

    used, files = lambda acc: acc["used"], lambda acc: acc["files"]

    def add(acc: Column, x: Column) -> Column:
        role = lambda text: F.concat(x["role"], F.lit(f": {text}"))
        why = (
            F.when(x["turn"] > most_turns, "referencing: over max_referencing")
            .when((files(acc) >= most_files) | (used(acc) >= most_bytes), role("pack full (max_files or max_bytes)")).when(x["bytes"].isNull(), role("binary or unreadable"))
            .when(x["bytes"] > most_file, F.concat(x["role"], F.lit(": "), x["bytes"], F.lit(" bytes > max_file_bytes"))).when(used(acc) + x["bytes"] > most_bytes, role("would exceed max_bytes"))
        )
        taken = why.isNull()
        return F.struct(
            (files(acc) + taken.cast("int")).alias("files"), (used(acc) + F.when(taken, x["bytes"]).otherwise(0)).alias("used"), F.concat(acc["why"], F.array(why)).alias("why")
        )

    start = F.struct(F.lit(0).alias("files"), F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("why"))
    whole = rows.withColumns({"bytes": F.col("bytes").cast("long"), "turn": F.col("turn").cast("int")})
    rest = [c for c in whole.columns if c not in keys and c != "ord"]
    each = whole.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(*rest).alias("r")))).alias("_rows"))
    reasons = F.aggregate(F.transform("_rows", lambda x: x["r"]), start, add, lambda acc: acc["why"])
    told = each.withColumn("_why", reasons).select(*keys, F.explode(F.arrays_zip("_rows", "_why")).alias("_z")).select(*keys, "_z._rows.ord", "_z._rows.r.*", F.col("_z._why").alias("skipped"))
    return told.select(*rows.columns, F.col("skipped").isNull().alias("taken"), "skipped")


def order_statistics(rows: DataFrame, value: str) -> DataFrame:
    """(measure, median, p90) of a numeric column: equal values are counted first, their running sums give the ranks."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")).withColumn("_every", F.lit(1))
    ranks = running_sum(value_bucket(counts, "_v"), ["_every"], F.col("_range"), ["_v"], "_n", "_before", "_all")
    upto = F.col("_before") + F.col("_n")
    at = lambda k: F.min(F.when(upto > k, F.col("_v")))
    middle = (at(F.floor((F.col("_all") - 1) / 2)) + at(F.floor(F.col("_all") / 2))) / 2
    return ranks.agg(F.lit(value).alias("measure"), middle.alias("median"), at(F.least(F.col("_all") - 1, F.floor(F.col("_all") * 9 / 10))).alias("p90"))


def pack_statistics(files: DataFrame, packs: DataFrame, keys: list[str]) -> DataFrame:
    """(measure, median, p90) of files, bytes and seconds of packs; a pack of no files counts with none.

    files: packed rows (keys, taken, bytes), packs (keys, seconds). p90 is the nearest rank.
    """
    sums = files.filter("taken").groupBy(*keys).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    rows = packs.join(sums, keys, "left").fillna(0, ["files", "bytes"])
    rows = staged(rows.select("files", "bytes", "seconds"))
    found = [order_statistics(rows, measure) for measure in ("files", "bytes", "seconds")]
    return found[0].unionByName(found[1]).unionByName(found[2])


def pack_counts(files: DataFrame, most: int = 8) -> DataFrame:
    """(kind, name, n): taken files by role, and the `most` frequent reasons of skipped ones without their role, by name on ties."""
    roles = files.filter("taken").groupBy(F.lit("role").alias("kind"), F.col("role").alias("name")).agg(F.count("*").alias("n"))
    reason = F.trim(F.regexp_replace("skipped", "^[^:]*:", ""))
    skips = files.filter("skipped IS NOT NULL").groupBy(F.lit("skipped").alias("kind"), reason.alias("name")).agg(F.count("*").alias("n"))
    return roles.unionByName(skips.orderBy(F.desc("n"), "name").limit(most))
