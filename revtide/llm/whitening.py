"""Whitening of embeddings with distributed block matrices.

Vectors become whole numbers. The fit list has each distinct vector once, numbered from 0 without gaps; its rows less
their mean are the rows of an indexed row matrix, which is cut into blocks of rows. The blocks transposed times the
blocks are the scatter, whose eigenvectors and eigenvalues are found on the driver (a matrix as wide as a vector). The
blocks times the whitening matrix are the whitened rows. Both products split the middle dimension, so that a task
multiplies a few blocks and only their small products are summed. Whitened rows go back to all rows of their vector.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import attach, salt, stage, table

COMPONENTS = 16
#: Entries become floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this wouldn't be exact as whole doubles.
LARGEST = 2.0**46
#: A block has at least so many rows, and more where that would make more than BLOCKS of them.
BLOCK_ROWS, BLOCKS = 1024, 100_000
#: Rows of a block matrix, whose rows Spark numbers by int, and tasks of a product at most.
CHUNK, SPLITS = 1 << 30, 10_000
#: The columns added.
OUT = " component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
#: Eigenvalues below this share of the largest are no variance but rounding.
LEAST_SHARE = 1e-12


def whole(vector: Column) -> Column:
    # rows that take no part may come here too: their entries need some value
    small = lambda c: F.when(F.abs(c) < LARGEST, c).otherwise(0).cast("double")
    return F.transform(vector, lambda c: F.floor(small(c) * SCALE) + SHIFT)


def usable(vector: Column) -> Column:
    """Neither null nor empty, and all entries numbers of a size that whole doubles hold."""
    fine = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LARGEST), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows, staged, with a long `name` from 0 without gaps: a row's place in its partition after those before it."""
    held = stage(rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = held.groupBy(part.alias("_part")).count().orderBy("_part").collect()  # a row per partition
    before, starts = 0, []
    for at, count in sizes:
        starts.append((at, before))
        before += count
    first = held.sparkSession.createDataFrame(starts, "_part long, _start long")
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return held.withColumn("_part", part).join(F.broadcast(first), "_part").select(place.alias(name), *rows.columns)


def chunks(fit: DataFrame, n: int, mean: list[float]) -> list[tuple[int, BlockMatrix]]:
    """The centred rows of the fit list as block matrices of at most CHUNK rows, each with the number of its first row."""
    rows = max(BLOCK_ROWS, -(-min(n, CHUNK) // BLOCKS))
    centre = F.array(*(F.lit(m) for m in mean))
    centred = F.zip_with("_x", centre, lambda x, m: x.cast("double") - m)
    out = []
    for first in range(0, n, CHUNK):
        own = fit.filter(F.col("_index").between(first, first + CHUNK - 1))
        vectors = own.select((F.col("_index") - first).alias("index"), array_to_vector(centred).alias("vector"))
        matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), min(CHUNK, n - first), len(mean))
        out.append((first, matrix.toBlockMatrix(rows, len(mean)).persist(StorageLevel.MEMORY_AND_DISK)))
    return out


def product(left: BlockMatrix, right: BlockMatrix, shared: int) -> BlockMatrix:
    """left x right with the `shared` blocks of the middle dimension dealt over as many tasks, at most SPLITS."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, max(1, min(SPLITS, shared)))
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def inner(matrices: list[BlockMatrix]) -> np.ndarray:
    """The sum of transposed times itself over the matrices; as wide as a row."""
    return sum(product(m.transpose(), m, m.numRowBlocks).toLocalMatrix().toArray() for m in matrices)


def whiten(
    rows: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, columns: list[str] | None = None
) -> DataFrame:
    """The columns (all, if not given) of rows with component, n, deviation, whitened, explained and identity_error.

    One row per row and component. Rows take no part whose vector is null, empty, has a null or non-finite entry or one
    of 2**46 and more, or isn't as long as most vectors are (the longer length on a tie). Components of no variance (a
    share of the largest below 1e-12) are left out: an empty table, or one distinct vector, gives no rows. Rows with
    equal vectors count once in the fit list and each get their rows; null or repeated ids change nothing. deviation is
    a decimal of 38 digits. Columns of rows named like the six are replaced; other names are free.
    """
    new = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    columns = [c for c in columns or rows.columns if c.lower() not in new]
    vector = F.col(f"`{vector_col}`")
    fine = rows.filter(usable(vector)).select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"), whole(vector).alias("_x"))
    lengths = fine.groupBy(F.size("_x").alias("_length")).count().orderBy(F.desc("count"), F.desc("_length")).head(1)
    kind = {f.name: f.dataType for f in rows.schema}
    empty = rows.sparkSession.createDataFrame([], ", ".join(f"`{c}` {kind[c].simpleString()}" for c in columns) + ("," if columns else "") + OUT)
    if not lengths:
        return empty
    width = lengths[0]["_length"]
    fine = fine.filter(F.size("_x") == width)
    fit = numbered(fine.select("_x").distinct(), "_index")
    summed = fit.select(F.posexplode("_x").alias("_at", "_entry")).groupBy("_at").agg(F.sum(F.col("_entry").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n"))
    sums = [int(r.s) for r in summed.orderBy("_at").collect()]  # as many as a vector has entries
    n = fit.count()
    parts = chunks(fit, n, [s / n for s in sums])
    values, vectors = np.linalg.eigh(inner([m for _, m in parts]) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = int((values[:components] > max(LEAST_SHARE * values[0], 0)).sum())
    if not kept:
        return empty
    basis = vectors[:, :kept] / np.sqrt(values[:kept])
    block = Matrices.dense(width, kept, basis.ravel("F").tolist())
    right = BlockMatrix(rows.sparkSession.sparkContext.parallelize([((0, 0), block)], 1), width, kept)
    projected = [(first, product(m, right, 1).persist(StorageLevel.MEMORY_AND_DISK)) for first, m in parts]
    error = float(np.abs(inner([m for _, m in projected]) / n - np.eye(kept)).max())
    found = None
    for first, m in projected:
        part = callMLlibFunc("getIndexedRows", m.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
        part = part.select((F.col("index") + first).alias("_index"), vector_to_array("vector").alias("_white"))
        found = part if found is None else found.unionAll(part)
    found = stage(found)
    for _, m in parts + projected:
        m._java_matrix_wrapper._java_model.blocks().unpersist(False)
    wide = lambda c: c.cast("decimal(38,0)")
    total = F.array(*(F.lit(s).cast("decimal(38,0)") for s in sums))
    squares = F.zip_with("_x", total, lambda x, s: (wide(wide(x) * n) - s))
    deviation = F.aggregate(squares, F.lit(0).cast("decimal(38,0)"), lambda a, d: wide(a + wide(d * d)))
    known = fit.join(found, "_index").select("_x", deviation.alias("deviation"), "_white")
    out = attach(fine.withColumn("_salt", salt("_row")), known, ["_x"], "_salt")
    shares = F.array(*(F.lit(float(v / values.sum())) for v in values[:kept]))
    out = out.select("_row.*", "deviation", F.posexplode("_white").alias("_c", "whitened"))
    return out.select(
        *(F.col(f"`{c}`") for c in columns), (F.col("_c") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("_c")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation as long; null where a long can't hold it (from about 10**8 distinct vectors of this kind)."""
    found = whiten(table(spark, sf_dir, "embeddings"), columns=["vec_id"])
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))
