"""Spans of a text: matches with their places, running values over arrays, settled overlaps, replaced spans.

Arrays are worked off in blocks, so that none is copied once for each of its elements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use reads it."""
    return F.get(F.transform(F.array(value), use), 0)


def blocks(values: Column) -> Column:
    starts = F.filter(F.sequence(F.lit(0), F.size(values), F.lit(BLOCK)), lambda b: b < F.size(values))
    return F.transform(starts, lambda b: F.slice(values, b + 1, F.lit(BLOCK)))


def running(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Before each of values, what the associative step makes of those before it."""
    total = lambda some: F.aggregate(some, start, step)
    inner = lambda some, first: F.aggregate(
        some, F.struct(first.alias("now"), F.slice(F.array(start), 1, 0).alias("out")),
        lambda acc, v: F.struct(step(acc["now"], v).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")), lambda acc: acc["out"],
    )

    def of(cut: Column) -> Column:
        begins = F.aggregate(F.transform(cut, total), F.array(start), lambda acc, t: F.concat(acc, F.array(step(F.get(acc, F.size(acc) - 1), t))))
        return F.flatten(F.zip_with(cut, F.slice(begins, 1, F.size(cut)), inner))

    return once(blocks(values), of)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array of struct(start, end, value, match, before) of all matches: places in code points, the group's text, the whole
    match, and the text between the match before and this. The group has to end its match, apart from signs that begin it too."""
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"), F.split(text, pattern, -1).alias("gaps")
    )

    def placed(x: Column) -> Column:
        lengths = F.transform(x["found"], lambda m, i: F.length(m) + F.length(F.get(x["gaps"], i)))
        before = running(lengths, F.lit(0), lambda a, n: a + n)
        return once(F.struct(x["found"].alias("found"), x["values"].alias("values"), x["gaps"].alias("gaps"), before.alias("before")), lambda y: F.transform(y["found"], lambda m, i: span_of(y, m, i)))

    def span_of(x: Column, m: Column, i: Column) -> Column:
        gap, value = F.get(x["gaps"], i), F.get(x["values"], i)
        start = F.get(x["before"], i) + F.length(gap)
        inside = F.length(m) - F.instr(F.reverse(m), F.reverse(value)) - F.length(value) + 1 if group else F.lit(0)
        return F.struct((start + inside).alias("start"), (start + inside + F.length(value)).alias("end"), value.alias("value"), m.alias("match"), gap.alias("before"))

    return once(parts, placed)


def settled(spans: Column) -> Column:
    """Of spans, struct(start, end, rank, ...), those that no kept one of a smaller rank (or an earlier one) overlaps, by start.

    Overlapping spans stand together, so ranks are compared inside each run of them only.
    """

    def runs(x: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(0), F.size(x["spans"]) - 1), lambda i: F.get(x["spans"], i)["start"] >= F.get(x["ends"], i))
        end = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(x["spans"]))
        return F.flatten(once(opens, lambda at: F.transform(at, lambda p, k: kept(F.slice(x["spans"], p + 1, end(at, k) - p)))))

    def kept(some: Column) -> Column:
        by_rank = F.array_sort(F.transform(some, lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s.alias("s"))))
        add = lambda acc, r: F.when(F.exists(acc, lambda t: (t["start"] < r["s"]["end"]) & (r["s"]["start"] < t["end"])), acc).otherwise(F.concat(acc, F.array(r["s"])))
        chosen = F.aggregate(by_rank, F.slice(some, 1, 0), add)
        return F.when(F.size(some) == 1, some).otherwise(F.array_sort(chosen))

    ordered = once(F.array_sort(spans), lambda s: F.struct(s.alias("spans"), running(F.transform(s, lambda x: x["end"]), F.lit(0), lambda a, b: F.greatest(a, b)).alias("ends")))
    return F.when(F.size(spans) < 2, spans).otherwise(once(ordered, runs))


def replaced(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """text with each of spans, struct(start, end, ...), which don't overlap and are in order, replaced by its mark.

    The text of a block of spans is cut out once, and its pieces are found from its beginning.
    """

    def block(acc: Column, some: Column) -> Column:
        last = F.get(some, F.size(some) - 1)["end"]
        part = F.struct(F.substring(text, acc["at"] + 1, last - acc["at"]).alias("part"), acc["at"].alias("first"), some.alias("some"))

        def pieces(x: Column) -> Column:
            begin = lambda i: F.when(i == 0, x["first"]).otherwise(F.get(x["some"], i - 1)["end"])
            piece = lambda s, i: F.concat(F.substring(x["part"], begin(i) - x["first"] + 1, s["start"] - begin(i)), mark(s))
            return F.array_join(F.transform(x["some"], piece), "")

        return F.struct(last.alias("at"), F.concat(acc["out"], once(part, pieces)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(blocks(spans), start, block, whole))
