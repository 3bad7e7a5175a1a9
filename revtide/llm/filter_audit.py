"""Audit of how text filters interact: what each removes in every order, and its Shapley share.

Every document gets one bit per filter that it fails. A coalition of filters removes the documents that fail any of
its members; the removals of all 32 coalitions are tabulated for each part of the table. The Shapley values are the
solution of a least squares problem: additive values of the filters are fitted to the coalitions' removals under the
Shapley kernel's weights, with the constraint that they sum to what all filters remove. Its normal equations are
solved in rationals, once for a unit removal of each coalition, which gives whole weights for orders times value; a
part's values are then sums of its removals in whole numbers. What a step removes in an order is the difference of two
coalitions: that of the filters up to it and that of those before it.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import UPPER, attach, salt, stage, table

FILTERS = "ABCDE"
ORDERS, COALITIONS = factorial(len(FILTERS)), 1 << len(FILTERS)
#: What is counted of a coalition's removals: documents, good ones, toxic ones.
COUNTS = ("all", "good", "toxic")


def solve(matrix: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """The exact solution of a small regular system."""
    rows = [[*row, value] for row, value in zip(matrix, right, strict=True)]
    for i in range(len(rows)):
        pivot = next(j for j in range(i, len(rows)) if rows[j][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        rows = [row if j == i else [a - row[i] * b for a, b in zip(row, rows[i], strict=True)] for j, row in enumerate(rows)]
    return [row[-1] for row in rows]


def shapley_weights(filters: int = len(FILTERS)) -> list[list[int]]:
    """For each filter the weight of every coalition's removal in (number of orders) x (Shapley value).

    The last value is what the constraint leaves: v(all) less the others. So a coalition S with kernel weight w fits
    sum over i < last of x_i ([i in S] - [last in S]) to v(S) - [last in S] v(all).
    """
    last, every = filters - 1, (1 << filters) - 1
    inner = range(1, every)
    kernel = {s: Fraction(filters - 1, comb(filters, k) * k * (filters - k)) for s in inner for k in [s.bit_count()]}
    has = lambda s, i: s >> i & 1
    design = {s: [has(s, i) - has(s, last) for i in range(last)] for s in inner}
    normal = [[sum((kernel[s] * design[s][i] * design[s][j] for s in inner), Fraction()) for j in range(last)] for i in range(last)]
    columns = []
    for coalition in range(every + 1):
        unit = {s: (s == coalition) - has(s, last) * (coalition == every) for s in inner}
        right = [sum((kernel[s] * design[s][i] * unit[s] for s in inner), Fraction()) for i in range(last)]
        values = solve(normal, right)
        columns.append([*values, (coalition == every) - sum(values)])
    scaled = [[factorial(filters) * column[i] for column in columns] for i in range(filters)]
    if any(x.denominator != 1 for row in scaled for x in row):
        raise ArithmeticError("the weights of Shapley values times orders have to be whole")
    return [[int(x) for x in row] for row in scaled]


def failures(text: Column) -> Column:
    """The bits of the filters that look at the text alone: A, B, C, D."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    count, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    fails = (count < 100, 100 * distinct < 80 * count, 100 * upper > 10 * F.length(text), text.rlike(r"[#$%&*|]"))
    return sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(fails)), F.lit(0))


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of every document."""
    text = F.coalesce("text", F.lit(""))
    row = F.monotonically_increasing_id()
    seen = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("_digest"), F.length(text).alias("_length"),
        failures(text).alias("_mask"), F.pmod(row, F.lit(64)).cast("int").alias("_salt"),
    )
    rows = stage(seen)
    key = ["_digest", "_length"]
    first = rows.groupBy(*key).agg(F.min("doc_id").alias("_first"))
    known = attach(rows, first, key, "_salt")
    judged = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic")
    )
    repeats = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))
    flag = lambda c: F.coalesce(c, F.lit(0))
    mask = F.col("_mask") + F.when(repeats, 1 << FILTERS.index("E")).otherwise(0)
    return known.join(judged, "doc_id", "left").select("part", mask.alias("mask"), flag("_good").alias("good"), flag("_toxic").alias("toxic"))


def removals(rows: DataFrame) -> DataFrame:
    """One row a part: its documents and for each of COUNTS an array of what every coalition removes, by its number."""
    cells = rows.groupBy("part", "mask").agg(F.count("*").alias("all"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    hit = lambda c, s: F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(c)).otherwise(0))
    sums = (F.array(*(hit(c, s) for s in range(COALITIONS))).alias(c) for c in COUNTS)
    return cells.groupBy("part").agg(F.sum("all").alias("n"), *sums)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    docs (doc_id, text, lang), labels (doc_id, quality, toxic). A part is a language, the empty one for null. One row
    for each of its 120 orders and 5 steps, zeros included; an empty table has no parts and no rows. A null text is
    empty: it fails A only (and E if a smaller id has an empty text). A null doc_id is neither smaller than another nor
    larger, and has no label. Of rows that repeat an id and a text none is a copy of the other; an id with several
    labels is good or toxic if one of them says so. Further columns, whatever their names, aren't read.
    """
    parts = removals(marked(docs.select("doc_id", "text", "lang"), labels.select("doc_id", "quality", "toxic")))
    values = (sum((F.col("all")[s] * w for s, w in enumerate(weights) if w), F.lit(0)) for weights in shapley_weights())
    orders = ",".join("".join(order) for order in permutations(FILTERS))
    steps = parts.withColumn("values", F.array(*values)).withColumn("filter_order", F.explode(F.split(F.lit(orders), ",")))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = lambda letters: F.expr(" + ".join(f"IF(instr({letters}, '{x}') > 0, {1 << i}, 0)" for i, x in enumerate(FILTERS)))
    now = F.expr(f"instr('{FILTERS}', substring(filter_order, step, 1)) - 1")
    steps = steps.select("*", bits("substring(filter_order, 1, step - 1)").alias("before"), bits("substring(filter_order, 1, step)").alias("upto"), now.alias("now"))
    every = COALITIONS - 1
    own = F.col("upto") - F.col("before")
    gone = {c: F.get(c, F.col("upto")) - F.get(c, F.col("before")) for c in COUNTS}
    return steps.select(
        "part", "filter_order", "step", (F.col("n") - F.get("all", F.col("upto"))).alias("kept"), gone["all"].alias("removed"),
        (F.get("all", own) - gone["all"]).alias("redundant"), (F.get("all", F.lit(every)) - F.get("all", every - own)).alias("unique_fails"),
        gone["good"].alias("good_lost"), gone["toxic"].alias("toxic_lost"), F.get("values", F.col("now")).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE) AS e,
  coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic
  FROM d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
cells AS (SELECT part, concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END) AS fails,
  count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
-- the step at which each cell goes in each order: the first of its filters there; 6 if it stays
g AS (SELECT cells.*, filter_order, least(6, CASE WHEN contains(fails, 'A') THEN instr(filter_order, 'A') END, CASE WHEN contains(fails, 'B') THEN instr(filter_order, 'B') END, CASE WHEN contains(fails, 'C') THEN instr(filter_order, 'C') END, CASE WHEN contains(fails, 'D') THEN instr(filter_order, 'D') END, CASE WHEN contains(fails, 'E') THEN instr(filter_order, 'E') END) AS gone FROM cells, o),
k AS (SELECT unnest([1, 2, 3, 4, 5]) AS step),
r AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS x, sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN gone < step AND contains(fails, substr(filter_order, step, 1)) THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails = substr(filter_order, step, 1) THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost FROM g, k GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r
"""
