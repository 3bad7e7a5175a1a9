"""Near duplicates by SimHash fingerprints and a Gray-order hierarchical index.

Distinct fingerprints are cut into BLOCKS bit blocks. Two fingerprints that differ in at most RADIUS bits agree on at
least BLOCKS - RADIUS of them, so for every choice of that many blocks there is an order in which they lie near each
other: the chosen bits first, all sorted by Gray rank. Fingerprints that agree on the chosen bits are one bucket;
buckets are dealt over the cluster, and a task indexes about TREE of its fingerprints at a time, whole buckets only, so
no link is lost. In an index FAN neighbours in Gray order share a node, which holds the masked bit pattern that they
have in common, FAN nodes the next, and so on up, a child keeping only the bits its parent lacks. Each fingerprint is
searched from the root down: differences add up, and a whole group is dropped once they exceed RADIUS or lie in the
chosen bits, where another order finds the pair. Groups whose
members are all linked to the searching fingerprint already are dropped too, which keeps dense clusters near linear.
All links come from these searches. An index gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import attach, salt, small_batches, stage, table

WIDTH, RADIUS, SEED = 4, 4, 42
#: Bit blocks; members of a node; fingerprints of an index, but for larger buckets.
BLOCKS, FAN, TREE = 6, 8, 32_768
#: Most (searching fingerprint, node) pairs held at once while an index is searched, most fingerprints searching at once.
FRONTIER, MOST_QUERIES = 2_000_000, 4_096


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Signed 64-bit SimHash; 0 for null or a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    begin = starts[: max(1, len(words) - width + 1)].tolist()
    end = (starts[min(width, len(words)) :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(begin), 8192):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begin[i : i + 8192], end[i : i + 8192])], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(begin)).view(">u8")[0].astype(np.int64))


def fingerprints(width: int = WIDTH):
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return of


CUTS = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
CHOICES = list(combinations(range(BLOCKS), BLOCKS - RADIUS))
#: By number of the order, the bits that agree in it.
CHOSEN = np.array([sum(((1 << CUTS[b + 1]) - (1 << CUTS[b])) for b in c) for c in CHOICES], np.uint64)


def folded(shift: int) -> Callable[[Column], Column]:
    return lambda x: x.withField("_gray", x["_gray"].bitwiseXOR(F.shiftrightunsigned(x["_gray"], shift)))


def orders(fp: Column) -> Column:
    """For each choice of BLOCKS - RADIUS blocks: its number, the chosen bits, and the word with those first in Gray order."""
    found = []
    for number, chosen in enumerate(CHOICES):
        word, bits = F.lit(0).cast("long"), 0
        for b in [*chosen, *(b for b in range(BLOCKS) if b not in chosen)]:
            size = CUTS[b + 1] - CUTS[b]
            part = F.shiftrightunsigned(fp, CUTS[b]).bitwiseAND(F.lit((1 << size) - 1))
            word = F.shiftleft(word, size).bitwiseOR(part)
            bits += size if b in chosen else 0
        key = F.shiftrightunsigned(word, 64 - bits)
        found.append(F.struct(F.lit(number).cast("long").alias("_order"), key.alias("_key"), word.alias("_gray")))
    ranked = F.array(*found)
    for shift in (1, 2, 4, 8, 16, 32):  # the position in the reflected Gray order is the prefix XOR of the bits
        ranked = F.transform(ranked, folded(shift))
    return F.transform(ranked, lambda x: x.withField("_gray", x["_gray"].bitwiseXOR(F.lit(-(2**63)))))  # as signed numbers sort


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a[i] with b[i]: every component takes its smallest label."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        parent = np.arange(len(labels))
        np.minimum.at(parent, np.maximum(la, lb), np.minimum(la, lb))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
        labels = parent[labels]
    return labels


class GrayIndex:
    """Hierarchical index over fingerprints sorted by Gray rank. Pairs that differ in a bit of `agree` aren't looked for."""

    def __init__(self, fps: np.ndarray, fan: int = FAN, agree: int = 0):
        self.fps, self.fan, self.agree, self.visited = fps, fan, np.uint64(agree), 0
        both, some, self.levels = fps, fps, []
        while True:
            starts = np.arange(0, len(both), fan)
            both, some = np.bitwise_and.reduceat(both, starts), np.bitwise_or.reduceat(some, starts)
            self.levels.append((~(both ^ some), both))  # bits that all members share, and their pattern
            if len(both) <= fan:
                break

    def search(self, queries: np.ndarray, labels: np.ndarray, uniform: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query index, member index) within radius whose labels differ; uniform: the one label below a node, or -1."""
        top = len(self.levels[-1][0])
        q, node = np.repeat(queries, top), np.tile(np.arange(top), len(queries))
        spent = np.zeros(len(q), np.int64)
        above = np.zeros(len(q), np.uint64)
        for i in range(len(self.levels) - 1, -1, -1):
            shared, pattern = self.levels[i]
            apart = (self.fps[q] ^ pattern[node]) & shared[node] & ~above
            spent = spent + np.bitwise_count(apart)
            keep = (spent <= radius) & (apart & self.agree == 0) & (uniform[i][node] != labels[q])
            q, node, spent = q[keep], node[keep], spent[keep]
            if len(q) * self.fan > FRONTIER and len(queries) > 1:
                halves = (self.search(x, labels, uniform, radius) for x in np.array_split(queries, 2))
                return tuple(map(np.concatenate, zip(*halves)))
            above = np.repeat(shared[node], self.fan)
            q, spent = np.repeat(q, self.fan), np.repeat(spent, self.fan)
            node = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
            inside = node < (len(self.levels[i - 1][0]) if i else len(self.fps))
            q, node, spent, above = q[inside], node[inside], spent[inside], above[inside]
        self.visited += len(q)
        apart = (self.fps[q] ^ self.fps[node]) & ~above
        keep = (spent + np.bitwise_count(apart) <= radius) & (apart & self.agree == 0) & (labels[q] != labels[node])
        return q[keep], node[keep]

    def uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        low, high, out = labels, labels, []
        for _ in self.levels:
            starts = np.arange(0, len(low), self.fan)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            out.append(np.where(low == high, low, -1))
        return out

    def components(self, radius: int) -> np.ndarray:
        labels, done, block = np.arange(len(self.fps)), 0, 64
        while done < len(self.fps):
            queries = np.arange(done, min(len(self.fps), done + block))
            labels = merge_labels(labels, *self.search(queries, labels, self.uniform(labels), radius))
            done, block = done + block, min(2 * block, MOST_QUERIES)
        return labels


def link_buckets(
    buckets: np.ndarray, agree: np.ndarray, fps: np.ndarray, radius: int = RADIUS, fan: int = FAN, tree: int = TREE
) -> np.ndarray:
    """Rows by order and bucket, in Gray order -> for each row the first row of its group in its index.

    agree: the bits that are equal in a bucket of the row's order. An index holds whole buckets of one order.
    """
    labels = np.arange(len(fps))
    ends = np.r_[np.flatnonzero(buckets[1:] != buckets[:-1]) + 1, len(fps)]
    orders_end = np.r_[np.flatnonzero(agree[1:] != agree[:-1]) + 1, len(fps)]
    at = 0
    while at < len(fps):
        end = int(ends[min(np.searchsorted(ends, at + tree), len(ends) - 1)])
        end = min(end, int(orders_end[np.searchsorted(orders_end, at, "right")]))
        if end - at > 1:
            labels[at:end] = at + GrayIndex(fps[at:end], fan, agree[at]).components(radius)
        at = end
    return labels


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def found(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["_rep"].to_numpy()
        keys = rows["_order"].to_numpy() * 2**32 + rows["_key"].to_numpy()
        labels = link_buckets(keys, CHOSEN[rows["_order"].to_numpy()], rows["_fp"].to_numpy().view(np.uint64))
        moved = labels != np.arange(len(labels))
        return pd.DataFrame({"a": ids[moved], "b": ids[labels[moved]]})

    held: list[pd.DataFrame] = []  # of the last bucket, which may go on in the next batch
    for rows in batches:
        if not len(rows):
            continue
        keys = rows["_order"].to_numpy() * 2**32 + rows["_key"].to_numpy()
        if held and tuple(held[-1][["_order", "_key"]].iloc[-1]) == tuple(rows[["_order", "_key"]].iloc[-1]):
            held.append(rows)
            continue
        cut = int(np.flatnonzero(keys == keys[-1])[0])
        whole = pd.concat([*held, rows.iloc[:cut]]) if held else rows.iloc[:cut]
        held = [rows.iloc[cut:]]
        if len(whole):
            yield found(whole)
    if held:
        yield found(pd.concat(held))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """(id, _fp, component_id) for every row of docs: the smallest id reachable over links of at most RADIUS bits.

    A null or wordless text has fingerprint 0 and is linked like any other. Rows with a null id take part through
    their fingerprint; where a fingerprint has null ids only, it is not linked and component_id is null. An empty
    table gives no rows; other columns of docs are not read.
    """
    marked = docs.select(F.col(id_col), fingerprints(width)(F.col(text_col)).alias("_fp"), salt(id_col).alias("_salt"))
    marked = stage(marked)
    distinct = marked.groupBy("_fp").agg(F.min(id_col).alias("_rep"))
    keyed = distinct.filter("_rep IS NOT NULL").select("_fp", "_rep", F.explode(orders(F.col("_fp"))).alias("o")).select("_fp", "_rep", "o.*")
    keyed = keyed.repartition("_order", "_key").sortWithinPartitions("_order", "_gray")
    edges = keyed.select("_order", "_key", "_fp", "_rep").mapInPandas(_links, "a long, b long")
    roots = connected_components(edges)
    linked = distinct.join(roots, distinct["_rep"] == roots["node"], "left").select(
        "_fp", F.coalesce("root", "_rep").alias("component_id")
    )
    return attach(marked, linked, ["_fp"], "_salt").select(id_col, "_fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")
