"""Findings of a review round: verdicts folded into classes, repeats, suppression, ranking, and diagnostics of runs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.members import may_be_among
from .contamination import staged
from .paths import in_scope

ROUND = ["repo", "number", "round"]
#: Fixed word list left out when findings are compared.
STOP_WORDS = [
    "the", "and", "for", "with", "this", "that", "from", "into", "when", "not", "are", "was", "were", "has", "have", "its", "can", "will", "than", "then",
]
SIMILARITY = 0.25
#: Orders of buckets and severities in a report.
BUCKETS, SEVERITIES = ["act_on", "consider", "noted", "dismissed"], ["important", "pre_existing", "nit"]


@dataclass(frozen=True)
class RankRules:
    nit_only: tuple[str, ...] = ("style",)
    high_risk: tuple[str, ...] = ("security",)
    threshold: float = 0.5
    nit_cap: int = 3


def fold_verdicts(findings: DataFrame, matched: DataFrame, validity: DataFrame) -> DataFrame:
    """findings (repo, number, round, finding_id, posted) with klass, gold_id and judged_severity.

    matched (…, finding_id, gold_id, duplicate_of) decides first: tp with a gold issue, else dup of another finding.
    Of the rest validity (…, finding_id, valid, severity) makes a posted finding vu or fp; one not posted is fp.
    """
    keys = [*ROUND, "finding_id"]
    rows = findings.join(matched.select(*keys, "gold_id", "duplicate_of"), keys, "left").join(validity.select(*keys, "valid", "severity"), keys, "left")
    klass = (
        F.when(F.col("gold_id").isNotNull(), "tp").when(F.col("posted") & F.col("duplicate_of").isNotNull(), "dup")
        .when(F.col("posted") & F.col("valid"), "vu").otherwise("fp")
    )
    return rows.select(*keys, klass.alias("klass"), "gold_id", F.when(klass == "vu", F.col("severity")).alias("judged_severity"))


def words(title: Column, body: Column) -> Column:
    """The distinct words of a title and a body's first sentence, stop words left out."""
    first = F.substring_index(F.coalesce(body, F.lit("")), ". ", 1)
    found = F.regexp_extract_all(F.lower(F.concat_ws(" ", title, first)), F.lit("[a-z0-9_]{3,}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(STOP_WORDS)))


def similar_pairs(findings: DataFrame, slack: int) -> DataFrame:
    """(repo, number, round, a, b, overlap) of findings a < b of a round on the same lines that share enough words.

    findings (repo, number, round, finding_id, path, start_line, end_line, title, body); lines may be `slack` apart.
    """
    rows = findings.select(*ROUND, "path", "finding_id", "start_line", "end_line", words(F.col("title"), F.col("body")).alias("words"))
    needed = " AND ".join(f"{c} IS NOT NULL" for c in (*ROUND, "path", "finding_id", "start_line", "end_line"))
    # findings of a path are dealt once, and most paths have one
    of_path = rows.filter(f"{needed} AND size(words) > 0").groupBy(*ROUND, "path").agg(F.collect_list(F.struct("finding_id", "start_line", "end_line", "words")).alias("_all"))
    each = of_path.filter("size(_all) > 1").select(*ROUND, "_all", F.explode("_all").alias("a"))
    a = F.col("a")
    near = lambda b: (a["start_line"] - slack <= b["end_line"]) & (b["start_line"] - slack <= a["end_line"]) & (a["finding_id"] < b["finding_id"])
    pairs = each.select(*ROUND, "a", F.explode(F.filter("_all", near)).alias("b"))
    overlap = F.size(F.array_intersect("a.words", "b.words")) / F.size(F.array_union("a.words", "b.words"))
    kept = pairs.withColumn("overlap", overlap).filter(F.col("overlap") >= SIMILARITY)
    return kept.select(*ROUND, F.col("a.finding_id").alias("a"), F.col("b.finding_id").alias("b"), "overlap")


def similar_to(one: str, two: str, slack: int) -> Column:
    """Whether two findings' lines overlap and their words do enough; columns begin with one and two."""
    shared, either = F.size(F.array_intersect(f"{one}words", f"{two}words")), F.size(F.array_union(f"{one}words", f"{two}words"))
    return same_place(one, two, slack) & (F.size(f"{one}words") > 0) & (F.size(f"{two}words") > 0) & (shared >= SIMILARITY * either)


def same_place(one: str, two: str, slack: int) -> Column:
    return (F.col(f"{one}start_line") - slack <= F.col(f"{two}end_line")) & (F.col(f"{two}start_line") - slack <= F.col(f"{one}end_line"))


def merge_duplicates(findings: DataFrame, slack: int) -> DataFrame:
    """One finding per issue of a round: the best wording, with raised_by and lessons_cited of all its repeats.

    findings (repo, number, round, ord, finding_id, path, start_line, end_line, title, body, trace, severity, raised_by,
    lessons_cited). In order, a finding joins the first group that has one similar to it, so groups aren't transitive
    closures; a task goes through its rounds one after the other and holds the groups of one. Best is the most
    severe, then one that no check raised, then the longest.
    """
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    pairs = similar_pairs(findings, slack).select(*ROUND, both.alias("p"))
    near = staged(pairs.groupBy(*ROUND, F.col("p.a").alias("finding_id")).agg(F.collect_set("p.b").alias("_near")))

    def group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        round_, of, begun = None, {}, {}
        for rows in batches:
            groups = []
            for key, finding, near_ones in zip(zip(*(rows[c] for c in ROUND)), rows["finding_id"], rows["_near"]):
                if key != round_:
                    round_, of, begun = key, {}, {}
                known = [of[x] for x in near_ones if x in of]
                of[finding] = min(known, key=begun.get, default=finding)
                begun.setdefault(of[finding], len(begun))
                groups.append(of[finding])
            yield rows[[*ROUND, "finding_id"]].assign(_group=groups)

    kinds = ", ".join(f"`{c}` {findings.schema[c].dataType.simpleString()}" for c in (*ROUND, "finding_id"))
    severity = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    size = -F.length(F.coalesce("body", F.lit(""))) - F.length(F.coalesce("trace", F.lit("")))
    rank = F.struct(severity.alias("s"), F.get("raised_by", F.lit(0)).startswith("check:").alias("c"), size.alias("l"), "ord", "finding_id")
    # rows of one name are one finding; few findings have others near them, so the rest isn't dealt by group
    same = Window.partitionBy(*ROUND, "finding_id")
    told = F.collect_list(F.struct("ord", "raised_by", "lessons_cited")).over(same)
    once_of = lambda rows: rows.withColumn("_rank", rank).withColumns({"_turn": F.row_number().over(same.orderBy("_rank")), "_all": told}).filter("_turn = 1")
    once = once_of(findings)
    few = once_of(may_be_among(findings, near, [*ROUND, "finding_id"]))
    repeats = staged(few.select(*ROUND, "ord", "finding_id", "_rank", "_all").join(near, [*ROUND, "finding_id"]))
    by_round = repeats.select(*ROUND, "ord", "finding_id", "_near").repartition(*ROUND).sortWithinPartitions(*ROUND, F.asc_nulls_last("ord"), "finding_id")
    grouped = by_round.mapInPandas(group, f"{kinds}, _group string")
    of_group = Window.partitionBy(*ROUND, "_group")
    repeats = repeats.drop("_near").join(grouped, [*ROUND, "finding_id"])
    repeats = repeats.withColumns({"_best": F.row_number().over(of_group.orderBy("_rank")) == 1, "_joined": F.flatten(F.collect_list("_all").over(of_group))})
    decided = repeats.select(*ROUND, "finding_id", "_best", F.when(F.col("_best"), F.col("_joined")).alias("_joined"))
    merged = once.join(decided, [*ROUND, "finding_id"], "left").filter(F.coalesce("_best", F.lit(True)))
    merged = merged.withColumn("_all", F.sort_array(F.coalesce("_joined", "_all")))
    union = lambda c: F.array_distinct(F.concat(c, F.flatten(F.transform("_all", lambda x: x[c]))))
    return merged.withColumns({c: union(c) for c in ("raised_by", "lessons_cited")}).select(*findings.columns)


def rereview(findings: DataFrame, prior: DataFrame, slack: int) -> DataFrame:
    """findings with `bucket` as a re-review leaves it and `again`, what it did.

    findings (repo, number, round, finding_id, path, start_line, end_line, title, body, category, severity, bucket),
    prior (repo, number, path, lines, title, body, category, dismissed): a posted finding that repeats a prior one
    (similar, or on its lines and of its category) is dismissed if that was, else noted; others that are not Important
    are noted too.
    """
    keys = [*ROUND, "finding_id"]
    side = lambda rows, mark, cols: rows.select("repo", "number", "path", *cols, *(F.col(c).alias(f"{mark}{c}") for c in ("start_line", "end_line", "category")), words(F.col("title"), F.col("body")).alias(f"{mark}words"))
    both = side(findings, "n_", ["round", "finding_id"]).join(side(prior, "p_", ["dismissed"]), ["repo", "number", "path"])
    repeat = similar_to("n_", "p_", slack) | (same_place("n_", "p_", 0) & F.col("n_category").eqNullSafe(F.col("p_category")))
    seen = both.filter(repeat).groupBy(*keys).agg(F.bool_or("dismissed").alias("_dismissed"))
    again = (
        F.when(~F.col("bucket").isin("act_on", "consider"), None).when(F.col("_dismissed"), "dismissed_before").when(F.col("_dismissed").isNotNull(), "raised_before")
        .when(F.col("severity") != "important", "not_important")
    )
    rows = findings.join(seen, keys, "left").withColumn("again", again)
    bucket = F.when(F.col("again") == "dismissed_before", "dismissed").when(F.col("again").isNotNull(), "noted").otherwise(F.col("bucket"))
    return rows.withColumn("bucket", bucket).select(*findings.columns, "again")


def suppressed(findings: DataFrame, rules: list[dict], high_risk: list[str]) -> DataFrame:
    """findings (category, path, title, body, bucket) with `lesson`, the first rule that fits, and bucket dismissed there.

    A rule has id, categories, paths (globs) and pattern. Categories of high risk are never touched.
    """
    text, lesson = F.concat_ws("\n", "title", "body"), F.lit(None).cast("string")
    for rule in reversed(rules):
        fits = F.col("category").isin(rule["categories"]) & in_scope(F.col("path"), rule["paths"]) & text.rlike(rule["pattern"])
        lesson = F.when(fits, rule["id"]).otherwise(lesson)
    out = findings.withColumn("lesson", F.when(~F.coalesce(F.col("category").isin(high_risk), F.lit(False)), lesson))
    return out.withColumn("bucket", F.when(F.col("lesson").isNotNull(), "dismissed").otherwise(F.col("bucket")))


def rank_findings(findings: DataFrame, rules: RankRules) -> DataFrame:
    """findings (repo, number, round, finding_id, head, path, start_line, title, category, severity, bucket, confidence,
    consensus, evidence_level) with final severity, bucket, stable_id and rank in their round.

    Equal nits and equal ranks go by finding_id. Copies of one stable id get one more x each.
    """
    category = F.coalesce("category", F.lit(""))
    nit_only = category.isin(list(rules.nit_only)) & ~category.isin(list(rules.high_risk))
    out = findings.withColumn("severity", F.when(nit_only, "nit").otherwise(F.col("severity")))
    out = out.withColumn("bucket", F.when((F.col("bucket") == "act_on") & (F.col("severity") == "nit"), "consider").otherwise(F.col("bucket")))
    out = out.withColumn("severity", F.when(F.col("bucket") == "consider", "nit").otherwise(F.col("severity")))
    unsure = F.col("bucket").isin("act_on", "consider") & (F.col("confidence") < rules.threshold)
    out = out.withColumn("bucket", F.when(unsure, "noted").otherwise(F.col("bucket")))
    nits = Window.partitionBy(*ROUND, "bucket").orderBy(F.desc("confidence"), F.desc("consensus"), F.desc("evidence_level"), "finding_id")
    over = (F.col("bucket") == "consider") & (F.row_number().over(nits) > rules.nit_cap)
    out = out.withColumn("_over", over).withColumn("bucket", F.when(F.col("_over"), "noted").otherwise(F.col("bucket")))
    key = F.sha1(F.concat_ws("\0", "head", "path", "start_line", "title").cast("binary"))
    out = out.withColumn("stable_id", F.concat(F.lit("f"), F.substring(key, 1, 10)))
    copies = F.row_number().over(Window.partitionBy(*ROUND, "stable_id").orderBy("finding_id")) - 1
    out = out.withColumn("stable_id", F.concat("stable_id", F.repeat(F.lit("x"), copies)))
    place = lambda c, names: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col(c)), F.lit(0)), F.lit(len(names) + 1))
    order = [place("bucket", BUCKETS), place("severity", SEVERITIES), F.desc("confidence"), "path", "start_line", "finding_id"]
    return out.drop("_over").withColumn("rank", F.row_number().over(Window.partitionBy(*ROUND).orderBy(*order)))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def verifier_report(findings: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    """Rejection and false-dismissal rates: findings (keys, bucket), judged notes (keys, klass), not posted ones."""
    out = findings.join(judged.select(*keys, F.col("klass").alias("_k")), keys, "left")
    dismissed, noted = F.col("bucket") == "dismissed", F.col("bucket") == "noted"
    n = {
        "proposed": F.lit(True), "dismissed": dismissed, "dismissed_judged": dismissed & F.col("_k").isNotNull(),
        "false_dismissals": dismissed & (F.col("_k") == "tp"), "noted_judged": noted & F.col("_k").isNotNull(), "noted_matching_gold": noted & (F.col("_k") == "tp"),
    }
    counts = out.agg(*(F.count_if(where).alias(name) for name, where in n.items()))
    return counts.withColumns({"rejection_rate": ratio(F.col("dismissed"), F.col("proposed")), "false_dismissal_rate": ratio(F.col("false_dismissals"), F.col("dismissed_judged"))})


def false_dismissals(findings: DataFrame, judged: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first `most` dismissed findings (keys, bucket) that judged notes (keys, klass) match with gold."""
    wrong = judged.filter("klass = 'tp'").select(*keys)
    return findings.filter("bucket = 'dismissed'").join(wrong, keys, "left_semi").select(*keys).orderBy(*keys).limit(most)


def act_on_load(findings: DataFrame, flag: int) -> DataFrame:
    """Findings to act on a round: mean, largest, and rounds with more than `flag`."""
    rounds = findings.groupBy(*ROUND).agg(F.count_if(F.col("bucket") == "act_on").alias("n"))
    return rounds.agg(F.count("*").alias("rounds"), F.avg("n").alias("per_round"), F.max("n").alias("most"), F.count_if(F.col("n") > flag).alias("over_flag"))


def well_formed(rounds: DataFrame, findings: DataFrame) -> DataFrame:
    """Parse rate over rounds (proposed, malformed) and anchor rate over findings (severity, anchored), 1 where there are none."""
    none, keep = F.lit(0).cast("long"), F.col("severity") != "pre_existing"
    parts = rounds.select(F.col("proposed").cast("long"), F.col("malformed").cast("long"), none.alias("anchorable"), none.alias("anchored")).unionByName(
        findings.select(none.alias("proposed"), none.alias("malformed"), keep.cast("long").alias("anchorable"), (keep & F.col("anchored")).cast("long").alias("anchored"))
    )
    total = lambda c: F.coalesce(F.sum(c), none)
    both = parts.agg(*(total(c).alias(name) for c, name in (("proposed", "parsed"), ("malformed", "malformed"), ("anchorable", "anchorable"), ("anchored", "anchored"))))
    one = lambda part, whole: F.coalesce(ratio(part, whole), F.lit(1.0))
    return both.withColumns({"parse_rate": one(F.col("parsed"), F.col("parsed") + F.col("malformed")), "anchor_rate": one(F.col("anchored"), F.col("anchorable"))})


def lesson_exposure(findings: DataFrame, lessons: list[str]) -> DataFrame:
    """(lesson, fired): rounds in which a finding cites the lesson or its check raised one; 0 for lessons that never did.

    findings (repo, number, round, lessons_cited, raised_by), arrays of strings.
    """
    checks = F.transform(F.filter("raised_by", lambda r: r.startswith("check:")), lambda r: F.substring(r, 7, F.length(r)))
    fired = findings.select(*ROUND, F.explode(F.array_union("lessons_cited", checks)).alias("lesson")).filter(F.col("lesson").isin(lessons)).distinct()
    spark = findings.sparkSession
    touched = spark.createDataFrame([(x,) for x in sorted(set(lessons))], "lesson string")
    return touched.join(fired.groupBy("lesson").agg(F.count("*").alias("fired")), "lesson", "left").fillna(0, ["fired"])


def precision_by_source(findings: DataFrame, sources: str) -> DataFrame:
    """(source, raised, posted, rounds, precision) of each entry of the array column `sources` of scored findings."""
    rows = findings.select(*ROUND, F.explode(F.array_distinct(sources)).alias("source"), "posted", "credit", "weight")
    good = F.sum(F.when(F.col("posted") & F.col("credit").isin("tp", "vu"), F.col("weight")).otherwise(0.0))
    bad = F.sum(F.when(F.col("posted") & (F.col("credit") == "fp"), F.col("weight")).otherwise(0.0))
    by_round = rows.groupBy("source", *ROUND).agg(F.count("*").alias("raised"), F.count_if("posted").alias("posted"), good.alias("good"), bad.alias("bad"))
    total = by_round.groupBy("source").agg(F.sum("raised").alias("raised"), F.sum("posted").alias("posted"), F.count("*").alias("rounds"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    return total.select("source", "raised", "posted", "rounds", ratio(F.col("good"), F.col("good") + F.col("bad")).alias("precision"))


def known_answers(labels: DataFrame) -> DataFrame:
    """labels (author_kind, outcome, applied, addressed) of people and agents with truth and how it is known."""
    fixed = F.col("outcome") == "fixed"
    how = F.when(F.col("outcome") == "thumbs_down", "thumbs_down").when(fixed & F.col("applied"), "applied_suggestion").when(fixed & (F.col("addressed") == "addressed"), "addressed_fix")
    return labels.filter(F.col("author_kind").isin("human", "ai")).withColumn("how", how).filter("how IS NOT NULL").withColumn("truth", F.col("how") != "thumbs_down")


def audit_items(candidates: DataFrame, n: int) -> DataFrame:
    """Up to n candidates (id, truth): those that are not true first, each half in the order of the id's hash."""
    return candidates.orderBy("truth", F.sha2(F.col("id"), 256), "id").limit(n)
