"""Nearest neighbours by inner product: anisotropic product quantisation, four-bit table scans, exact reranking.

Codebooks of 16 centres for each pair of dimensions are fitted on a bounded sample; every row is then encoded. The
loss of a code weighs the residual parallel to the vector ETA times as much as the rest, because that part moves large
inner products most. Rows and queries are dealt into blocks; where a block of queries meets a block of rows, a table
of inner products with all centres is summed over the rows' codes, the best SCANNED vectors are scored exactly in double
precision, and the best of each block compete in the end. Equal vectors of a block are scanned and scored once and
stand for all their ids; every vector whose sum equals that of the last of the SCANNED is scored too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import salt, table

NEAREST, SCANNED = 20, 400
#: Rows that codebooks are fitted on (about), centres (four bits), dimensions of a code, weight of the parallel error.
SAMPLE_ROWS, CENTRES, WIDTH, ETA, ROUNDS = 10_000, 16, 2, 4.0, 8
ROWS_IN_BLOCK, QUERIES_IN_BLOCK = 8_192, 1_024


def padded(vectors: np.ndarray) -> np.ndarray:
    """With zero dimensions up to a multiple of two codes."""
    return np.pad(vectors, ((0, 0), (0, -vectors.shape[1] % (2 * WIDTH))))


def encode(vectors: np.ndarray, books: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Codes (rows, parts): nearest centres, then coordinate descent on the anisotropic loss."""
    x = padded(vectors)
    parts = x.reshape(len(x), -1, WIDTH)
    unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).reshape(parts.shape)
    codes = np.empty(parts.shape[:2], np.uint8)
    parallel = np.zeros(len(x))  # inner product of the residual with the unit vector
    for j in range(parts.shape[1]):
        codes[:, j] = ((parts[:, j, None] - books[j]) ** 2).sum(axis=2).argmin(axis=1)
        parallel += ((parts[:, j] - books[j][codes[:, j]]) * unit[:, j]).sum(axis=1)
    for _ in range(rounds):
        for j in range(parts.shape[1]):
            residual = parts[:, j, None] - books[j]
            along = (residual * unit[:, j, None]).sum(axis=2)
            others = parallel - np.take_along_axis(along, codes[:, j, None].astype(int), 1)[:, 0]
            loss = (residual**2).sum(axis=2) + (ETA - 1) * (others[:, None] + along) ** 2
            codes[:, j] = loss.argmin(axis=1)
            parallel = others + np.take_along_axis(along, codes[:, j, None].astype(int), 1)[:, 0]
    return codes


def fit(sample: np.ndarray) -> np.ndarray:
    """Codebooks (parts, CENTRES, WIDTH): each part's centres solve the weighted least squares of its rows."""
    x = padded(sample)
    parts = x.reshape(len(x), -1, WIDTH)
    rng = np.random.default_rng(11)
    books = parts[rng.integers(0, len(x), CENTRES)].transpose(1, 0, 2).copy()
    unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).reshape(parts.shape)
    for turn in range(ROUNDS):
        codes = encode(sample, books, rounds=0 if turn < ROUNDS // 2 else 1)
        chosen = np.stack([books[j][codes[:, j]] for j in range(len(books))], axis=1)
        parallel = ((parts - chosen) * unit).sum(axis=(1, 2))
        for j in range(len(books)):
            for c in range(CENTRES):
                own = codes[:, j] == c
                if not own.any():
                    books[j, c] = parts[rng.integers(0, len(x)), j]
                    continue
                u, p = unit[own, j], parts[own, j]
                others = parallel[own] - ((p - books[j, c]) * u).sum(axis=1)
                left = len(p) * np.eye(WIDTH) + (ETA - 1) * u.T @ u
                right = p.sum(axis=0) + (ETA - 1) * (u * ((p * u).sum(axis=1) + others)[:, None]).sum(axis=0)
                books[j, c] = np.linalg.solve(left, right)
    return books


def scan(queries: np.ndarray, packed: np.ndarray, books: np.ndarray) -> Iterator[np.ndarray]:
    """For each query the approximate inner products with all rows; two four-bit codes share a byte of `packed`."""
    q = padded(queries).reshape(len(queries), -1, WIDTH)
    tables = np.einsum("qjw,jcw->qjc", q, books).astype(np.float32)
    pairs = (tables[:, 1::2, :, None] + tables[:, 0::2, None, :]).reshape(len(queries), -1, CENTRES**2)
    for two in pairs:
        total = np.zeros(packed.shape[1], np.float32)
        for codes, values in zip(packed, two):
            total += values[codes]
        yield total


def distinct_vectors(base: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row of each distinct vector, the ids of its smallest `most` rows one vector after the other, and how many."""
    rows = np.ascontiguousarray(base).view(np.dtype((np.void, base.dtype.itemsize * base.shape[1]))).ravel()
    _, first, group = np.unique(rows, return_index=True, return_inverse=True)
    members = pd.DataFrame({"group": group.ravel(), "id": ids}).drop_duplicates().sort_values(["group", "id"])
    members = members.groupby("group").head(most)
    return first, members["id"].to_numpy(), np.bincount(members["group"], minlength=len(first))


def shortlist(near: np.ndarray, scanned: int) -> np.ndarray:
    """Places of the largest `scanned` values and of all that tie with the last of them."""
    if len(near) <= scanned:
        return np.arange(len(near))
    return np.flatnonzero(near >= np.partition(near, len(near) - scanned)[len(near) - scanned])


def search(vectors: DataFrame, is_query, k: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) of the k rows with the largest inner product, for rows where is_query holds.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose size isn't the
    most frequent one (of equally frequent ones the largest). A row isn't its own neighbour, nor is another row with
    its id. Rows with a null id take no part. Ties go to the smaller id; rows that repeat id and vector count once. An
    empty table gives no rows; other columns aren't read.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    rows = rows.select(F.col(id_col).alias("_id"), v.cast("array<double>").alias("_v"))
    sizes = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    result = f"query_id {kind}, {id_col} {kind}, score double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], result).select(
            "query_id", F.lit(1).alias("rank"), id_col, "score"
        )
    dimensions, total = sizes[0]
    rows = rows.filter(F.size("_v") == dimensions)
    share = min(1.0, SAMPLE_ROWS / total)
    lucky = F.pmod(F.xxhash64(F.lit("codebook"), "_id"), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000))
    sample = rows.filter(lucky).orderBy("_id").limit(2 * SAMPLE_ROWS).toPandas()
    shared = vectors.sparkSession.sparkContext.broadcast(fit(np.stack(sample["_v"])))

    @F.pandas_udf("binary")
    def code(batch: pd.Series) -> pd.Series:
        codes = encode(np.stack(batch.to_numpy()), shared.value) if len(batch) else np.zeros((0, 2), np.uint8)
        return pd.Series([x.tobytes() for x in codes[:, 0::2] | codes[:, 1::2] << 4])

    queries = rows.filter(is_query(F.col("_id")))
    row_blocks, query_blocks = -(-total // ROWS_IN_BLOCK), -(-max(1, queries.count()) // QUERIES_IN_BLOCK)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    indexed = rows.withColumn("_code", code("_v")).withColumn("_r", salt("_id", salts=row_blocks)).withColumn("_q", each(query_blocks))
    asked = queries.withColumn("_q", salt("_id", salts=query_blocks)).withColumn("_r", each(row_blocks))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(left) and len(right):
            base = np.stack(left["_v"].to_numpy())
            first, ids, sizes = distinct_vectors(base, left["_id"].to_numpy(), k + 1)
            base, ends = base[first], np.cumsum(sizes)
            packed = np.ascontiguousarray(np.frombuffer(b"".join(left["_code"]), np.uint8).reshape(len(left), -1)[first].T)
            ask = np.stack(right["_v"].to_numpy())
            for i, near in enumerate(scan(ask, packed, shared.value)):
                own = right["_id"].iloc[i]
                best = shortlist(near, SCANNED)
                exact = np.repeat((base[best] * ask[i]).sum(axis=1), sizes[best])
                inner = np.arange(len(exact)) - np.repeat(np.cumsum(sizes[best]) - sizes[best], sizes[best])
                member = ids[np.repeat(ends[best] - sizes[best], sizes[best]) + inner]
                exact, member = exact[member != own], member[member != own]
                order = np.lexsort((member, -exact))
                found = pd.DataFrame({"query_id": own, id_col: member[order], "score": exact[order]})
                parts.append(found.drop_duplicates().head(k))
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], id_col: [], "score": []}).astype({"query_id": ids_type, id_col: ids_type})

    ids_type = "int64" if kind in ("bigint", "int", "smallint", "tinyint") else object
    found = indexed.groupBy("_r", "_q").cogroup(asked.groupBy("_r", "_q")).applyInPandas(meet, result)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    ranked = found.dropDuplicates(["query_id", id_col, "score"]).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", id_col, "score")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
