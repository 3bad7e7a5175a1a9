"""Packing of token sequences by a configuration linear program over the length histogram.

Texts become pieces of at most CAPACITY tokens. The driver only ever sees how many pieces there are of each length (and
salt). Over that histogram multiplicative weights approximate the configuration LP: each step prices a length by how
little of its demand is covered, a knapsack dynamic program finds the dearest filling of a sequence, and its share
grows. Shares are rounded down to whole sequences; what is left over is packed by best fit, also on the histogram. If
best fit alone needs fewer sequences, its packing is taken. Every sequence is then a known filling, so a piece finds
its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import vocabulary, worker_cache
from .shared import salt, small_batches, stage, table

CAPACITY, END = 4096, 1
#: In the linear program lengths are rounded up to the finest power of two that leaves so many of them; its step size.
CLASSES, RATE = 128, 0.3
#: Pieces of one length are ranked in this many parts.
PARTS = 256
#: Words that a worker remembers.
REMEMBERED = 600_000

Filling = tuple[tuple[int, int], ...]  # (length, copies), longest first


def pieces(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each text's ids, ended by END, cut every `capacity` tokens."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, end = worker_cache(path, REMEMBERED), np.array([END], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            texts = cache.encode(batch["_text"].tolist())
            for doc, ids in zip(batch[id_col].astype(object).where(batch[id_col].notna(), None), texts):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=[id_col, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, F.col(text_col).alias("_text"))
    return rows.mapInPandas(cut, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def dearest_filling(prices: np.ndarray, capacity: int) -> Filling:
    """Knapsack by dynamic programming: prices[n] for length n (0 where there is none)."""
    sizes = np.flatnonzero(prices > 0)
    sizes = sizes[sizes <= capacity]
    offered = prices[sizes]
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    fit = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if n := fit[room]:
            gains = best[room - sizes[:n]] + offered[:n]
            k = gains.argmax()
            if gains[k] > best[room]:
                best[room], took[room] = gains[k], sizes[k]
    counts: dict[int, int] = defaultdict(int)
    room = capacity
    while room > 0:
        if took[room]:
            counts[int(took[room])] += 1
            room -= int(took[room])
        else:
            room -= 1
    return tuple(sorted(counts.items(), reverse=True))


def fractional_shares(demand: np.ndarray, capacity: int, rate: float = RATE) -> dict[Filling, float]:
    """Multiplicative weights for the covering LP min sum(x), every demand covered: fillings and their shares x.

    A length's weight shrinks by exp(-coverage) as its demand is covered; its price is weight over demand. Each step
    the dearest filling covers `rate` of the demand of one of its lengths; in the end the shares are scaled so that
    the least covered length is covered once.
    """
    sizes = np.flatnonzero(demand)
    shares: dict[Filling, float] = defaultdict(float)
    if not len(sizes):
        return shares
    covered, enough = np.zeros(len(demand)), np.log(len(sizes) + 1) / rate
    while (least := covered[sizes].min()) < enough:
        prices = np.zeros(len(demand))
        prices[sizes] = np.exp(least - covered[sizes]) / demand[sizes]
        filling = dearest_filling(prices, capacity)
        size, copies = map(np.array, zip(*filling))
        times = rate * float(np.min(demand[size] / copies))
        covered[size] += copies * times / demand[size]
        shares[filling] += times
    return {filling: x / least for filling, x in shares.items()}


def best_fit(left: np.ndarray, capacity: int, opened: list[tuple[Filling, int]] = ()) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on a histogram, into opened sequences first: sequences that are filled alike are one entry."""
    by_room: dict[int, dict[Filling, int]] = defaultdict(dict)
    used = np.zeros(capacity + 1, bool)

    def put(room: int, filling: Filling, n: int) -> None:
        by_room[room][filling] = by_room[room].get(filling, 0) + n
        used[room] = True

    for filling, n in opened:
        put(capacity - sum(size * copies for size, copies in filling), filling, n)
    for size in np.flatnonzero(left)[::-1].tolist():
        n = int(left[size])
        while n:
            if not used[size:].any():
                copies = min(capacity // size, n)
                times = n // copies
                put(capacity - copies * size, ((size, copies),), times)
                n -= copies * times
                continue
            room = size + int(np.argmax(used[size:]))
            filling, there = by_room[room].popitem()
            copies = min(room // size, n)
            times = min(there, n // copies)
            if there > times:
                by_room[room][filling] = there - times
            if not by_room[room]:
                used[room] = False
            put(room - copies * size, (*filling, (size, copies)), times)
            n -= copies * times
    return [(filling, n) for there in by_room.values() for filling, n in there.items()]


def rounded(demand: np.ndarray, capacity: int, classes: int = CLASSES) -> list[tuple[Filling, int]]:
    """The LP over lengths rounded up to multiples of a step, its shares rounded down, with the true lengths in them."""
    step = 1
    while len(set((-(-np.flatnonzero(demand) // step)).tolist())) > classes:
        step *= 2
    grid = -(-np.arange(capacity + 1) // step)
    shares = fractional_shares(np.bincount(grid, demand, grid[-1] + 1), capacity // step)
    queues = {int(g): [[n, int(demand[n])] for n in np.flatnonzero((grid == g) & (demand > 0))] for g in set(grid.tolist())}
    opened: list[tuple[Filling, int]] = []
    for filling, share in sorted(shares.items(), key=lambda x: -x[1]):
        wanted = int(share)
        while wanted:
            taken: Counter = Counter()
            for g, copies in filling:
                queue, need = list(map(list, queues[g])), copies
                while need and queue:
                    length, there = queue[-1]
                    k = min(need, there)
                    taken[length] += k
                    need, queue[-1][1] = need - k, there - k
                    if there == k:
                        queue.pop()
                if need:
                    break
            else:
                times = min(wanted, *(int(_there(queues[int(grid[n])], n)) // k for n, k in taken.items()))
                for n, k in taken.items():
                    queue = queues[int(grid[n])]
                    for entry in queue:
                        if entry[0] == n:
                            entry[1] -= k * times
                    queues[int(grid[n])] = [x for x in queue if x[1]]
                opened.append((tuple(sorted(taken.items(), reverse=True)), times))
                wanted -= times
                continue
            break
    left = np.zeros_like(demand)
    for queue in queues.values():
        for n, there in queue:
            left[n] = there
    return best_fit(left, capacity, opened)


def _there(queue: list[list[int]], length: int) -> int:
    return next(n for size, n in queue if size == length)


def plan(demand: np.ndarray, capacity: int = CAPACITY) -> list[tuple[Filling, int]]:
    """Fillings and how many sequences have each; together they hold the demand exactly."""
    return min(rounded(demand, capacity), best_fit(demand, capacity), key=lambda found: sum(n for _, n in found))


class Places:
    """Place of the r-th piece of each length, by binary search over ranges of ranks."""

    def __init__(self, fillings: list[tuple[Filling, int]]):
        ranges, seen, sequence = [], defaultdict(int), 0
        for filling, n in fillings:
            offset = 0
            for size, copies in filling:
                ranges.append((size, seen[size], copies, sequence, offset))
                seen[size] += copies * n
                offset += copies * size
            sequence += n
        self.ranges = np.array(sorted(ranges), np.int64).reshape(-1, 5)
        self.total = max(seen.values(), default=0) + 1
        self.starts = self.ranges[:, 0] * self.total + self.ranges[:, 1]

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, first, copies, sequence, offset = self.ranges[
            np.searchsorted(self.starts, length * self.total + rank, side="right") - 1
        ].T
        at = rank - first
        return sequence + at // copies, offset + at % copies * size


def pack(parts: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """parts (id, piece, start, length, ids_crc32), each length from 1 to capacity, with sequence_id and offset.

    Rows that are alike in all columns may swap places. A null id is a value like any other. An empty table gives no
    rows. Pieces of one length are ranked in PARTS parts, so a length that most pieces have is not one task's work.
    """
    parts = stage(parts.withColumn("_part", salt(id_col, "piece", "start", salts=PARTS)))
    base = np.zeros((capacity + 1, PARTS), np.int64)  # at most that many rows come back
    for length, part, n in parts.groupBy("length", "_part").count().toPandas().itertuples(index=False):
        base[length, part] = n
    demand = base.sum(axis=1)
    before = np.cumsum(base, axis=1) - base
    shared = parts.sparkSession.sparkContext.broadcast((before, Places(plan(demand, capacity))))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, part: pd.Series, rank: pd.Series) -> pd.DataFrame:
        first, places = shared.value
        size = length.to_numpy()
        sequence, offset = places.of(size, first[size, part.to_numpy()] + rank.to_numpy() - 1)
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    order = Window.partitionBy("length", "_part").orderBy(id_col, "piece", "start", "ids_crc32")
    ranked = parts.withColumn("_rank", F.row_number().over(order).cast("long"))
    placed = ranked.withColumn("_at", place("length", "_part", "_rank"))
    return placed.select(*[c for c in parts.columns if c != "_part"], "_at.*")


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """Every text of docs in as few sequences of at most CAPACITY tokens as the plan finds; null text counts as empty."""
    return pack(pieces(docs, path))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())
