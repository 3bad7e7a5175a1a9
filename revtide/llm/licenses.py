"""License scans: MinHash bands over overlapping text windows, verified by exact shingle containment.

A text is cut into blocks as long as a template; two neighbouring blocks are a window, so every occurrence of the
template lies within one. A window and a template that share a band of their MinHash signatures are compared exactly:
a template is found where a window contains at least CONTAINED of its shingles. A template with fewer words than a
shingle is one shingle of all its words. Templates of fewer shingles than the smallest block have to be there whole, so
they are looked up by a shingle's hash instead of their signature, which misses none.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table

SHINGLE, CONTAINED = 5, 0.8
#: Bands of one row: a window of twice the template's size that contains 0.8 of it has a similarity of 0.8 / 2.2 or more.
BANDS, ROWS = 16, 1
#: Fewest shingles of a block; templates of fewer are looked up by hash.
SMALLEST_BLOCK = 4
#: Fixed texts of public license notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "bsd-2-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}
WORD = re.compile(r"[a-z0-9]+")


def collision_probability(similarity: float) -> float:
    return 1 - (1 - similarity**ROWS) ** BANDS


def window_similarity(size: int) -> float:
    """Least similarity of a template of `size` shingles with a full window that contains CONTAINED of it."""
    held = math.ceil(CONTAINED * size)
    return held / (2 * max(size, SMALLEST_BLOCK) + size - held)


def shingle_hashes(words: list[str], memo: dict[str, int]) -> np.ndarray:
    """64-bit hashes of the shingles, in order; of all words together if there are fewer."""
    codes = []
    for w in words:
        c = memo.get(w)
        if c is None:
            if len(memo) > 200_000:
                memo.clear()
            c = memo[w] = zlib.crc32(w.encode())
        codes.append(c)
    x = np.array(codes, np.uint64)
    n = max(0, len(x) - SHINGLE + 1)
    if not n:
        x, n = (np.pad(x, (0, SHINGLE - len(x))), 1) if len(x) else (x, 0)
    h = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        h = (h ^ x[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(BANDS, blocks): the smallest of each hash function over each block."""
    odd = np.random.default_rng(3).integers(1, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((BANDS, len(starts)), np.uint64)
    for i, a in enumerate(odd):
        mixed = hashes * a
        out[i] = np.minimum.reduceat(mixed ^ mixed >> np.uint64(32), starts)
    return out


class Scanner:
    """Templates with their words, shingles and signatures."""

    def __init__(self, templates: dict[str, str]):
        self.memo: dict[str, int] = {}
        self.templates = []
        for name, text in sorted(templates.items()):
            words = WORD.findall(text.lower())
            hashes = shingle_hashes(words, self.memo)
            self.templates.append((name, self.shingles(words), len(hashes), minima(hashes, np.array([0]))[:, 0], hashes[0]))

    @staticmethod
    def shingles(words: list[str]) -> set[tuple[str, ...]]:
        return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
        """For each text (license, start, end, share of its shingles), positions in words of the window's matches."""
        found: list[list] = [[] for _ in texts]
        words = [WORD.findall((t or "").lower()) for t in texts]
        hashes = [shingle_hashes(w, self.memo) for w in words]
        full = [i for i, h in enumerate(hashes) if len(h)]
        if not full:
            return found
        flat = np.concatenate([hashes[i] for i in full])
        for size in sorted({n for _, _, n, _, _ in self.templates}):
            block = max(size, SMALLEST_BLOCK)
            starts = [np.arange(0, len(hashes[i]), block) for i in full]
            owner = np.repeat(full, [len(s) for s in starts])
            inside = np.concatenate(starts)
            base = np.repeat(np.cumsum([0] + [len(hashes[i]) for i in full[:-1]]), [len(s) for s in starts])
            pair = np.r_[owner[1:] == owner[:-1], False]
            if size >= SMALLEST_BLOCK:
                least = minima(flat, base + inside)
                window = least.copy()
                window[:, :-1][:, pair[:-1]] = np.minimum(least[:, :-1], least[:, 1:])[:, pair[:-1]]
            for name, shingles, n, signature, one in self.templates:
                if n != size:
                    continue
                if size < SMALLEST_BLOCK:
                    own = np.logical_or.reduceat(flat == one, base + inside)
                    near = own | pair & np.r_[own[1:], False]
                else:
                    near = (window == signature[:, None]).any(axis=0)
                for b in np.flatnonzero(near).tolist():
                    i, at = int(owner[b]), int(inside[b])
                    part = words[i][at : at + 2 * block + SHINGLE - 1]
                    hits = [k for k in range(max(1, len(part) - SHINGLE + 1)) if tuple(part[k : k + SHINGLE]) in shingles]
                    share = len({tuple(part[k : k + SHINGLE]) for k in hits}) / len(shingles)
                    if share >= CONTAINED:
                        found[i].append((name, at + hits[0], min(len(words[i]), at + hits[-1] + SHINGLE), share))
        return [sorted(set(x)) for x in found]


def scan_licenses(docs: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """docs with licenses: array of (license, start, end, contained), start and end counted in words.

    Words are runs of a-z and 0-9 after lower-casing. A null or empty text has none; a license may be found several
    times. A column of docs named licenses is replaced; rows may repeat; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(templates or TEMPLATES))

    @F.pandas_udf("array<struct<license:string,start:int,end:int,contained:double>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        keys = ("license", "start", "end", "contained")
        for texts in batches:
            out = []
            for i in range(0, len(texts), 200):
                out += shared.value.scan(texts.iloc[i : i + 200].tolist())
            yield pd.Series([[dict(zip(keys, x)) for x in found] for found in out], dtype=object)

    return docs.drop("licenses").withColumn("licenses", of(text_col))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"])))
    return found.select("doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"))
