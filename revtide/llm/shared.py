"""Pieces that several operators of this subpackage use."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys of a hot group are dealt over this many salts.
SALTS = 64
#: Rows and bytes in an Arrow batch: texts may be long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 1000, "2m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers that read whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, set as spark.checkpoint.dir or by setCheckpointDir."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))  # one machine, as in tests
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def salt(*cols: str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def attach(rows: DataFrame, found: DataFrame, keys: list[str], salt_col: str) -> DataFrame:
    """Join found (one row a key) to rows, however many rows a key has.

    found first goes to the distinct (key, salt) pairs, at most SALTS a key; rows then join on key and salt,
    so the rows of one key spread over SALTS join keys.
    """
    leaves = rows.groupBy(*keys, salt_col).agg(F.lit(1).alias("_leaf")).join(found, keys).drop("_leaf")
    return rows.join(leaves, [*keys, salt_col])


def lucky_ids(rows: DataFrame, about: int, *cols: str) -> DataFrame:
    """About so many of rows, chosen by a hash of cols; all if they are no more. The share is exact at any size."""
    share = min(1.0, about / max(1, rows.count()))
    return rows.filter(F.xxhash64(F.lit("sample"), *cols).cast("double") / 2.0**64 + 0.5 <= share)


def most_frequent(counts: DataFrame, most: int, key: str, by: str = "n") -> DataFrame:
    """Rows of the highest counts, never more than `most`: levels of counts, and of the level that is cut a part by hash.

    Two small aggregations find the cut (under 1,000 and under 5,000 rows), so that the bound holds before it's used.
    """
    level, part = F.floor(F.log2(F.col(by)) * 8).cast("int"), F.pmod(F.xxhash64(key), F.lit(4096)).cast("int")
    cut, room = -1, most
    for at, rows in sorted(map(tuple, counts.groupBy(level).count().collect()), reverse=True):
        if rows > room:
            cut = at
            break
        room -= rows
    parts = 0
    if cut >= 0:
        for at, rows in sorted(map(tuple, counts.filter(level == cut).groupBy(part).count().collect())):
            if rows > room:
                break
            parts, room = at + 1, room - rows
    return counts.filter((level > cut) | ((level == cut) & (part < parts)))


def without_numbers(rows: DataFrame, gone: DataFrame, number: str) -> DataFrame:
    """rows whose number (a long) is not among gone (number), without a shuffle of rows.

    gone goes to every task as bits, 4 KB for each 32,768 numbers in use: about 3 MB for 15 million rows.
    """
    bucket, position = F.expr(f"bitmap_bucket_number({number})"), F.expr(f"bitmap_bit_position({number})")
    bits = gone.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(position).alias("_bits"))
    byte = F.conv(F.hex(F.expr(f"substring(_bits, CAST(bitmap_bit_position({number}) DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    there = F.getbit(byte, F.pmod(position, F.lit(8)).cast("int")) == 1
    found = rows.join(F.broadcast(bits), bucket == F.col("_bucket"), "left")
    return found.filter(~F.coalesce(there, F.lit(False))).select(*rows.columns)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
