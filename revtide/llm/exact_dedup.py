"""Exact duplicates by a tree-merge of sorted digest runs, in DataFrame operations only.

Every row gets the SHA-256 of its normalised text and, to verify a match, its length and a second hash. That is read
from the texts once and staged. Rows are dealt into RUNS runs. The lowest level reduces each run, sorted by digest, to
one entry per verified digest: the identifier that stays and the number of rows. Then runs are exchanged in binomial
rounds: in round i a run whose number has bit i set goes to the run without that bit, which merges what all tasks send
it in the order of digests and keeps one verified identifier per digest. The identifier is a struct, for which Spark
aggregates by sorting, before an exchange and after it, so every level's runs are sorted. The last run is spread by
digest over all tasks. What it says goes back down to the lowest runs and from there to the rows, so that the rows of
one text, however many, are spread over RUNS join keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, stage, table, without_numbers

#: A power of two.
RUNS = 64
DIGEST = ["_digest", "_length", "_check"]


def digests(docs: DataFrame, text_col: str, id_col: str, columns: list[str]) -> DataFrame:
    """(_doc, _id, _row, digest columns, _run) of every row; _doc holds the given columns."""
    norm = ascii_lower(F.col(text_col))
    row = F.monotonically_increasing_id()
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_doc"), F.col(id_col).alias("_id"), row.alias("_row"),
        F.unhex(F.sha2(norm, 256)).alias("_digest"), F.length(norm).alias("_length"), F.xxhash64(norm).alias("_check"),
        F.pmod(F.xxhash64(F.col(id_col), row), F.lit(RUNS)).cast("int").alias("_run"),
    )


def merge_runs(rows: DataFrame, keep: str = "largest") -> DataFrame:
    """One row per run and digest of the lowest level, with the _best (id, row) and group_size of the whole table."""
    best = F.max if keep == "largest" else F.min
    # of ids null counts last, whatever stays
    entry = F.struct(F.col("_id").isNotNull() if keep == "largest" else F.col("_id").isNull(), F.col("_id").alias("id"), F.col("_row").alias("row"))
    lowest = rows.groupBy("_run", *DIGEST).agg(best(entry).alias("_best"), F.count("*").alias("_rows"))
    level = lowest
    for bit in range(RUNS.bit_length() - 1):
        level = level.withColumn("_run", F.col("_run").bitwiseAND(F.lit(~(1 << bit))))
        level = level.groupBy("_run", *DIGEST).agg(best("_best").alias("_best"), F.sum("_rows").alias("_rows"))
    root = level.select(*DIGEST, "_best", F.col("_rows").alias("group_size"))
    return lowest.select(*DIGEST, "_run").join(root, DIGEST)


def found_groups(docs: DataFrame, text_col: str, id_col: str, keep: str, columns: list[str]) -> DataFrame:
    """(_doc, _digest, keep_id, group_size, kept) of every row."""
    rows = stage(digests(docs, text_col, id_col, columns))
    joined = rows.join(merge_runs(rows.drop("_doc"), keep), [*DIGEST, "_run"])
    return joined.select("_doc", "_digest", F.col("_best.id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_best.row")).alias("kept"))


def mark_duplicates(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "largest", columns: list[str] | None = None
) -> DataFrame:
    """The columns (all, if not given) of docs with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z only. A null text counts as empty. Ids are compared without
    nulls; if all ids of a group are null, keep_id is null and one row of the group is kept. Of rows that repeat an id
    and a text one is kept. An empty table gives no rows. Columns of docs named like the four are replaced; other names
    are free.
    """
    new = ("keep_id", "group_size", "kept", "text_sha256")
    columns = [c for c in columns or docs.columns if c.lower() not in new]
    found = found_groups(docs, text_col, id_col, keep, columns)
    return found.select("_doc.*", "keep_id", "group_size", "kept", F.lower(F.hex("_digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "largest") -> DataFrame:
    """The rows of docs that stay, with the columns of docs, whatever they are called; only digests are shuffled."""
    rows = stage(digests(docs, text_col, id_col, docs.columns))
    short = rows.drop("_doc")
    gone = short.join(merge_runs(short, keep), [*DIGEST, "_run"]).filter("_row <> _best.row").select("_row")
    return without_numbers(rows.select("_doc", "_row"), gone, "_row").select("_doc.*")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_duplicates(table(spark, sf_dir, "documents"), columns=["doc_id"])


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""
