"""Rounds of the near-duplicate stage: buckets of the same documents count once, pairs stay fewer than rows; kept rows aren't shuffled."""

import numpy as np
import pandas as pd

from revtide.llm import exact_dedup, shingles
from revtide.llm.shared import stage, without_numbers


def test_buckets_of_the_same_documents_count_once(spark):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words), " ".join([*words, "end"]), " ".join(f"x{i}" for i in range(50))]
    docs = spark.createDataFrame(list(enumerate(texts)), "_id long, _text string")
    common = spark.sparkContext.broadcast((np.zeros(0, np.int64), np.zeros(0, np.int64)))
    rows = shingles.prefixes(docs, common)
    assert shingles.buckets(rows, True).count() > 2
    once = shingles.buckets(rows, False).collect()
    assert [(r._hub, r._id) for r in sorted(once, key=lambda r: r._id)] == [(0, 0), (0, 1)]
    best = max(r._hub_left for r in shingles.buckets(rows, True).collect())
    assert {r._hub_left for r in once} == {best}


def test_second_round_joins_groups_by_fewer_pairs_than_rows():
    size, bits = 40, np.zeros(128, np.uint8).tobytes()
    rows = pd.DataFrame({"_key": 1, "_id": np.arange(size), "_n": 100, "_left": 100, "_hub": -1, "_label": np.arange(size), "_sketch": [bits] * size})
    pairs = lambda of: pd.concat(list(of(iter([rows]))))
    assert len(pairs(shingles._second_round)) == size - 1
    assert len(pairs(shingles._third_round)) == size * (size - 1) // 2
    root = {}
    for a, b in pairs(shingles._second_round).itertuples(index=False):
        assert shingles.joining(np.array([a]), np.array([b]), root).all()


def test_rows_without_numbers(spark):
    gone = [0, 1, 7, 8, 32_768, 32_769, 65_536, (1 << 33) + 5]
    kept = [2, 6, 9, 32_767, 65_535, 65_537, 1 << 33, (1 << 33) + 6, (2 << 33)]
    rows = spark.createDataFrame([(n, "x") for n in gone + kept], "_row long, text string")
    found = without_numbers(rows, spark.createDataFrame([(n,) for n in gone], "_row long"), "_row")
    assert sorted(r._row for r in found.collect()) == kept
    assert without_numbers(rows, rows.select("_row").limit(0), "_row").count() == len(rows.collect())


def test_exact_duplicates_go_without_a_shuffle_of_texts(spark):
    docs = stage(spark.createDataFrame([(i, f"text {i % 3}", "en") for i in range(9)], "doc_id long, text string, lang string"))
    found = exact_dedup.drop_duplicates(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_doc" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    assert not any("_doc" in line for line in plan.splitlines() if "SortMergeJoin" in line)
    assert sorted(r.doc_id for r in found.collect()) == [6, 7, 8]
