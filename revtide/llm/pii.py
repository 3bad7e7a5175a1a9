"""Personal data: base patterns and bootstrapped contextual extraction, in DataFrame operations only.

Base spans of the four kinds are found and validated by expressions. They are the seeds, each a whole instance. Looser
patterns find candidates: mail addresses without a domain's dot or with the signs spelled out, IPv6 addresses, numbers
with other separators, and any token with a digit. The words around an occurrence give three lexical patterns: the word
before, the two words before, and the words before and after. Over the graph of patterns and instances, pattern
confidence (the share of a pattern's occurrences that are known to be of a kind) and instance scores (by the kind of
pattern, the mean confidence over an instance's occurrences; the best of the three) are computed in turn, for ROUNDS
rounds. Unseen instances that reach ACCEPT under a pattern as sure become further spans. What a kind's base pattern
matches and its check refuses (a number that fails Luhn) isn't of that kind: it lowers a pattern's confidence and isn't
added as that kind.

Spans of a text are rows that carry the row's number and nothing else of it, however many they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .shared import stage, table

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base kinds, possessive where no shorter match could help.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have before its pattern is worth running.
TRIGGERS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
#: Candidates besides base spans: spelled-out or unusual mail addresses, IPv6 addresses, longer numbers, tokens with a digit.
LOOSE = "|".join([
    r"(?<![^\s<(\[])[^\s@<>()\[\],;:]+(?:@|\x20?[(\[]at[)\]]\x20?|\x20at\x20(?=[^\s]+\x20dot\x20))[^\s@<>()\[\],;:]+(?:(?:\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[^\s@<>()\[\],;:]+)*",
    r"(?<!\S)(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}",
    r"(?<!\S)[(+]?[0-9](?:[\x20().\/-]{0,2}[0-9]){6,}+",
    r"(?<!\S)[^\s0-9]*+[0-9]\S*",
])
LOOSE_TRIGGER = r"[0-9]|@|[(\[ ]at[)\] ]"
#: What a candidate must look like to be of a kind.
FORMS = {"email": r"@|[(\[ ]at[)\] ]", "ip": r"[0-9A-Fa-f]*[.:][0-9A-Fa-f]*[.:]", "card": r"(?:[0-9][^0-9]*){12}", "phone": r"(?:[0-9][^0-9]*){7}"}
OCTET = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
SPAN = "struct<start:int,rank:int,kind:string,end:int,value:string,before:string,after:string>"
ROUNDS, SUPPORT, LIKELY, ACCEPT = 3, 3, 0.5, 0.8
#: Matches of a text whose positions are added up at once.
BLOCK = 128


def matches(text: Column, pattern: str, trigger: str, kind: str, rank: int) -> Column:
    """Array of SPAN of all matches of pattern, leftmost first, positions in code points.

    The pieces between the matches and the matches themselves add up to the text, so their lengths give positions.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast(f"array<{SPAN}>")

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["before"])
        end = start + F.length(pair["match"])
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"),
            pair["match"].alias("value"), F.right(pair["before"], F.lit(60)).alias("before"), F.left(pair["after"], F.lit(40)).alias("after"),
        ).cast(SPAN)
        return F.struct(end.cast("int").alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def positions(x: Column) -> Column:
        """Block by block, so that long arrays aren't copied for every match: where each block begins, then its matches."""
        n = F.size(x["found"])
        gap = lambda i: F.get(x["gaps"], i)
        pairs = F.transform(x["found"], lambda m, i: F.struct(m.alias("match"), gap(i).alias("before"), gap(i + 1).alias("after")))
        starts = F.filter(F.sequence(F.lit(0), n, F.lit(BLOCK)), lambda b: b < n)
        blocks = lambda p: F.transform(starts, lambda b: F.slice(p, b + 1, F.lit(BLOCK)))
        return F.flatten(F.transform(F.transform(F.array(pairs), blocks), placed)[0])

    def placed(blocks: Column) -> Column:
        length = lambda some: F.aggregate(some, F.lit(0), lambda n, p: n + F.length(p["before"]) + F.length(p["match"]))
        begins = F.aggregate(F.transform(blocks, length), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.get(acc, F.size(acc) - 1) + n)))
        inner = lambda some, at: F.aggregate(some, F.struct(at.alias("at"), none.alias("spans")), add, lambda acc: acc["spans"])
        return F.zip_with(blocks, F.slice(begins, 1, F.size(blocks)), inner)

    spans = F.transform(F.array(F.struct(found.alias("found"), gaps.alias("gaps"))), positions)[0]
    return F.when(text.rlike(trigger), spans).otherwise(none)


def luhn(digits: Column) -> Column:
    figures = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")),
    )
    return F.aggregate(figures, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: str, span: Column) -> Column:
    digits = F.regexp_replace(span["value"], "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(span["value"], r"\."), lambda part: part.rlike(OCTET))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def checker(kind: str) -> Callable[[Column], Column]:
    return lambda span: valid(kind, span)


def base_spans(text: Column) -> Column:
    return F.concat(*(F.filter(matches(text, PATTERNS[k], TRIGGERS[k], k, i), checker(k)) for i, k in enumerate(KINDS)))


def digest_form(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    parts = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(parts, ",")


def learn(occurrences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """occurrences (value, kind or null, patterns) -> accepted instances (value, kind), sure patterns (pattern, kind).

    A seed that is found as several kinds counts as the last of them by name.
    """
    each = occurrences.select("value", "kind", F.explode("patterns").alias("pattern"))
    edges = each.groupBy("pattern", "value").agg(F.count("*").alias("n"), F.max("kind").alias("kind"))
    edges = stage(edges)
    seeds = edges.filter("kind IS NOT NULL").groupBy("value").agg(F.max("kind").alias("kind")).withColumn("score", F.lit(1.0))
    totals = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    unknown = edges.drop("kind").join(seeds, "value", "left_anti")
    sort = F.substring("pattern", 1, 1).alias("sort")  # which of the three
    weight = unknown.groupBy("value", sort).agg(F.sum("n").alias("weight"))
    known = seeds
    for _ in range(ROUNDS):
        hits = edges.drop("kind").join(known, "value").groupBy("pattern", "kind").agg(
            F.sum(F.col("n") * F.col("score")).alias("hit"), F.sum(F.when(F.col("score") == 1.0, 1).otherwise(0)).alias("support")
        )
        patterns = hits.join(totals, "pattern").withColumn("sure", F.col("hit") / F.col("total"))
        patterns = stage(patterns.filter((F.col("support") >= SUPPORT) & (F.col("sure") >= LIKELY)).select("pattern", "kind", "sure"))
        scores = unknown.join(patterns, "pattern").groupBy("value", "kind", sort).agg(F.sum(F.col("n") * F.col("sure")).alias("hit"))
        scores = scores.filter(looks_like(F.col("value"), F.col("kind"))).join(weight, ["value", "sort"])
        found = scores.groupBy("value", "kind").agg(F.max(F.col("hit") / F.col("weight")).alias("score"))
        found = stage(found.filter(F.col("score") >= LIKELY))
        known = seeds.unionByName(found)
    accepted = found.filter(F.col("score") >= ACCEPT).groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    return accepted, patterns.filter(F.col("sure") >= ACCEPT).drop("sure")


def looks_like(value: Column, kind: Column) -> Column:
    """Whether a value has the form of a kind and isn't what the kind's base pattern matched and its check refused."""
    out = F.lit(False)
    for k, form in FORMS.items():
        out = F.when(kind == k, value.rlike(form) & ~value.rlike(f"^(?:{PATTERNS[k]})$")).otherwise(out)
    return out


def lexical_patterns(before: Column, after: Column) -> Column:
    """The word before, the two words before, the words before and after; without case and signs. Missing ones are ''."""
    word = lambda text, pattern: F.lower(F.regexp_extract(text, pattern, 1))
    one, two = word(before, r"([\p{L}\p{N}=:]+)[^\p{L}\p{N}]*$"), word(before, r"([\p{L}\p{N}]+[^\p{L}\p{N}]+[\p{L}\p{N}=:]+)[^\p{L}\p{N}]*$")
    nearby = word(after, r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+)")
    return F.array(F.concat(F.lit("1 "), one), F.concat(F.lit("2 "), F.regexp_replace(two, r"\s+", " ")), F.concat(F.lit("3 "), one, F.lit(" _ "), nearby))


def find_spans(docs: DataFrame, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """(_doc, base, added): a struct of the given columns (all, if not given) and arrays of spans for every row of docs.

    A null or empty text has no spans. Rows may repeat and ids may be null: spans are joined by a number of the row.
    Other columns may have any name. An empty table gives no rows. Added spans don't overlap base spans.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.struct(*(F.col(f"`{c}`") for c in columns or docs.columns)).alias("_doc"),
        base_spans(text).alias("base"), matches(text, LOOSE, LOOSE_TRIGGER, "candidate", 9).alias("loose"),
    )
    rows = stage(rows)
    each = rows.select("_row", F.explode(F.concat("base", "loose")).alias("t"))
    seed = F.col("t.kind") != "candidate"
    value = F.when(seed, F.col("t.value")).otherwise(F.regexp_replace(F.col("t.value"), r"[^\p{L}\p{N}]+$", ""))
    spans = each.select(
        "_row", F.col("t.start").alias("start"), (F.col("t.start") + F.length(value)).alias("end"), value.alias("value"),
        F.when(seed, F.col("t.kind")).alias("kind"), lexical_patterns(F.col("t.before"), F.col("t.after")).alias("patterns"),
    )
    # a candidate overlaps a base span that begins up to its start and ends after it, or the next one that begins before its end
    upto = Window.partitionBy("_row").orderBy("start")
    after = Window.partitionBy("_row").orderBy(F.desc("start"))
    base_end = F.max(F.when(F.col("kind").isNotNull(), F.col("end"))).over(upto)
    base_start = F.min(F.when(F.col("kind").isNotNull(), F.col("start"))).over(after)
    over = F.coalesce(base_end > F.col("start"), F.lit(False)) | F.coalesce(base_start < F.col("end"), F.lit(False))
    occurrences = stage(spans.withColumn("_over", over).filter("kind IS NOT NULL OR NOT _over").drop("_over"))
    accepted, sure = learn(occurrences)
    new = occurrences.filter("kind IS NULL").drop("kind").join(accepted, "value")
    new = new.select("_row", "start", "end", "value", "kind", F.explode("patterns").alias("pattern")).join(sure, ["pattern", "kind"])
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    span = F.struct("start", rank.alias("rank"), "kind", "end", "value", F.lit("").alias("before"), F.lit("").alias("after")).cast(SPAN)
    added = new.groupBy("_row").agg(F.collect_set(span).alias("added"))
    none = F.array().cast(f"array<{SPAN}>")
    return rows.drop("loose").join(added, "_row", "left").select("_doc", "base", F.coalesce("added", none).alias("added"))


def masked(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in brackets; of overlapping spans the first counts.

    Spans are worked off in blocks: the text of a block is cut out once, and its pieces are found from its beginning.
    """
    begin = lambda at: F.struct(at.cast("int").alias("at"), F.lit("").alias("out"))

    def block(acc: Column, some: Column) -> Column:
        first, last = acc["at"], F.array_max(F.transform(some, lambda s: s["end"]))
        part = F.substring(text, first + 1, F.greatest(last - first, F.lit(0)))

        def within(x: Column) -> Column:
            def add(inner: Column, s: Column) -> Column:
                kept = F.substring(x["part"], inner["at"] - x["first"] + 1, s["start"] - inner["at"])
                out = F.concat(inner["out"], kept, F.lit("["), F.upper(s["kind"]), F.lit("]"))
                return F.when(s["start"] < inner["at"], inner).otherwise(F.struct(s["end"].alias("at"), out.alias("out")))

            return F.aggregate(x["some"], begin(x["first"]), add)

        done = F.transform(F.array(F.struct(part.alias("part"), first.alias("first"), some.alias("some"))), within)
        return F.transform(done, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], x["out"]).alias("out")))[0]

    def blocks(ordered: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ordered), F.lit(BLOCK)), lambda b: b < F.size(ordered))
        return F.transform(starts, lambda b: F.slice(ordered, b + 1, F.lit(BLOCK)))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.aggregate(F.transform(F.array(F.array_sort(spans)), blocks)[0], begin(F.lit(0)), block, rest)


def mask_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data masked in the text, and n_chars to match if there is such a column; all rows stay.

    Each row is masked by its own spans, so null and repeated ids and clashing names don't matter; a null text stays null.
    """
    spans, text = F.concat("base", "added"), F.col(f"_doc.`{text_col}`")
    changed = F.when(F.size(spans) > 0, masked(text, spans)).otherwise(text)
    found = find_spans(docs, text_col).select("_doc", changed.alias("_text"))
    new = {text_col: F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return found.select(*(new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"), columns=["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "_doc.doc_id", *map(count, KINDS), F.sha2(digest_form(F.col("base")), 256).alias("base_sha256"),
        digest_form(F.concat("base", "added")).alias("spans"),
    )
