"""Severity-weighted scores of stored review runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import ScoringParams

ROUND = ["repo", "number", "round"]


def weight_of(severity: Column, params: ScoringParams) -> Column:
    out = F.lit(None).cast("double")
    for name, weight in params.severity_weights.items():
        out = F.when(severity == name, weight).otherwise(out)
    return out


def _scored(findings: DataFrame, gold: DataFrame, params: ScoringParams, runs: list[int] | None = None) -> DataFrame:
    """Scored findings and, with `_issue`, the gold issues they were matched with, dealt by round.

    Findings and issues travel together, so that one exchange serves the match, the order in a round and its sums. With
    runs, a finding has `runs` (run, klass, gold_id) for each run it is of, and is taken apart after the exchange.
    """
    keys = [*ROUND, "gold_id"]
    if runs:
        findings = findings.withColumn("gold_id", F.lit(None).cast("string"))
    issue = F.struct(F.col("severity").alias("severity"), F.col("conf").cast("double").alias("conf"))
    issues = gold.select(*keys, *(["language"] if "language" in findings.columns else []), issue.alias("_issue"))
    rows = findings.select(*keys, *(c for c in findings.columns if c not in keys)).unionByName(issues, allowMissingColumns=True)
    # a task sorts the rows of all runs, so that it gets fewer rounds the more runs there are
    rows = rows.repartition(len(runs) * int(findings.sparkSession.conf.get("spark.sql.shuffle.partitions")), *ROUND) if runs else rows.repartition(*ROUND)
    own = []
    if runs:
        own, none = ["run"], F.lit(None).cast("string")
        every = F.array(*(F.struct(F.lit(k).alias("run"), none.alias("klass"), F.col("gold_id")) for k in runs))
        each = rows.withColumn("_of", F.explode(F.when(F.col("_issue").isNull(), F.col("runs")).otherwise(every)))
        rows = each.withColumns({"run": F.col("_of.run"), "klass": F.col("_of.klass"), "gold_id": F.col("_of.gold_id")}).drop("_of", "runs")
    by_round = ["number", "round", "repo", *own]  # the most telling first: rows are sorted by it
    order = Window.partitionBy(*by_round, "gold_id").orderBy("finding_id")
    known = F.max("_issue").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    turn = F.sum((F.col("klass") == "tp").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.lit(True)
    for key in keys:  # a null key names no issue
        whole = whole & F.col(key).isNotNull()
    rows = rows.withColumns({"_known": F.when(whole, known), "_turn": turn})
    rows = rows.withColumns({"gold_severity": F.col("_known.severity"), "_conf": F.col("_known.conf")})
    claimed, severity = weight_of(F.col("severity"), params), F.col("severity")
    is_tp = (F.col("klass") == "tp") & F.col("gold_severity").isNotNull()
    is_nit = (F.col("klass") == "vu") & (severity == "nit")
    nits = F.sum(is_nit.cast("int")).over(Window.partitionBy(*by_round).orderBy("finding_id"))
    rows = rows.withColumns({"_first": is_tp & (F.col("_turn") == 1), "_nits": nits})
    vu = F.col("klass") == "vu"
    inflated = vu & (severity == "important") & F.col("judged_severity").eqNullSafe("nit")
    earned = vu & (severity == "important") & F.col("judged_severity").eqNullSafe("important") & (F.col("evidence_level") >= params.vu_min_evidence)
    over_cap = is_nit & (F.col("_nits") > params.max_neutral_vu_per_round)
    missing = (F.col("klass") == "tp") & F.col("gold_severity").isNull()
    credit = (
        F.when(missing, "error").when(F.col("_first"), "tp").when(earned, "vu").when(inflated | over_cap, "fp")
        .when(vu, "neutral").otherwise("fp")
    )
    weight = (
        F.when(missing, 0.0).when(F.col("_first"), weight_of(F.col("gold_severity"), params) * F.col("_conf"))
        .when(earned, params.valid_unlabeled_credit * params.severity_weights["important"])
        .when(inflated, params.severity_weights["nit"]).when(over_cap, claimed).when(vu, 0.0).otherwise(claimed)
    )
    klass = F.when(is_tp & ~F.col("_first"), "dup").otherwise(F.col("klass"))
    return rows.withColumns({"final_klass": klass, "credit": credit, "weight": weight}).drop("_known", "_turn", "_conf", "_first", "_nits")


def score_findings(findings: DataFrame, gold: DataFrame, params: ScoringParams) -> DataFrame:
    """findings with final_klass, credit (tp, vu, fp, neutral, error), weight and gold_severity; gold has a row an issue.

    In posted order (finding_id) the first true positive on a gold issue earns the issue's weight, later ones are
    duplicates. A valid unlabeled Important earns part credit if judged Important with enough evidence, and costs a
    Nit if judged one; valid unlabeled Nits past the round's cap cost their weight. A true positive on an unknown
    gold issue is an error row.
    """
    return _scored(findings, gold, params).filter("_issue IS NULL").drop("_issue")


def tally(scored: DataFrame, gold: DataFrame, params: ScoringParams) -> DataFrame:
    """One row per PR-round of findings or gold: tp, vu, fp, gold and the Important parts of tp and gold."""
    part = lambda name: F.sum(F.when(F.col("credit") == name, F.col("weight")).otherwise(0.0)).alias(name)
    sums = scored.groupBy(*ROUND, "language").agg(
        part("tp"), part("vu"), part("fp"),
        F.sum(F.when((F.col("credit") == "tp") & (F.col("gold_severity") == "important"), F.col("weight")).otherwise(0.0)).alias("tp_important"),
        F.max((F.col("severity") == "important").cast("int")).alias("alarms"),
    )
    worth = weight_of(F.col("severity"), params) * F.col("conf")
    totals = gold.groupBy(*ROUND, "language").agg(
        F.sum(worth).alias("gold"), F.sum(F.when(F.col("severity") == "important", worth).otherwise(0.0)).alias("gold_important"),
        F.count("*").alias("issues"),
    )
    return sums.join(totals, [*ROUND, "language"], "full").fillna(0)


def tallies(findings: DataFrame, gold: DataFrame, params: ScoringParams, runs: list[int] | None = None) -> DataFrame:
    """What tally gives of the scored findings, from one exchange of findings and gold.

    With runs, the numbers of several runs on the same gold, findings have `runs` (run, klass, gold_id), an array with
    each run that a finding is of, instead of klass and gold_id, and the tallies have the column run.
    """
    # of most findings neither their order in the round nor what was judged tells anything, so that they are dealt without
    severity = F.col("severity")
    ordered = lambda klass: (klass == "tp") | ((klass == "vu") & (severity == "nit"))
    judged = lambda klass: (klass == "vu") & (severity == "important")
    matched = lambda klass, gold_id: F.when(klass == "tp", gold_id).alias("gold_id")
    some = (lambda told: F.exists("runs", lambda x: told(x["klass"]))) if runs else (lambda told: told(F.col("klass")))
    if runs:
        klass = [F.transform("runs", lambda x: F.struct(x["run"].alias("run"), x["klass"].alias("klass"), matched(x["klass"], x["gold_id"]))).alias("runs")]
    else:
        klass = [F.col("klass"), matched(F.col("klass"), F.col("gold_id"))]
    findings = findings.select(
        *ROUND, "language", *klass, "severity", F.when(some(ordered), F.col("finding_id")).alias("finding_id"),
        F.when(some(judged), F.col("judged_severity")).alias("judged_severity"), F.when(some(judged), F.col("evidence_level")).alias("evidence_level"),
    )
    issue = F.col("_issue")
    finding, important = issue.isNull(), issue["severity"] == "important"
    part = lambda name, more=F.lit(True): F.sum(F.when(finding & (F.col("credit") == name) & more, F.col("weight")).otherwise(0.0))
    worth = F.when(~finding, weight_of(issue["severity"], params) * issue["conf"])
    sums = {
        "tp": part("tp"), "vu": part("vu"), "fp": part("fp"), "tp_important": part("tp", F.col("gold_severity") == "important"),
        "alarms": F.max(F.when(finding, (F.col("severity") == "important").cast("int"))),
        "gold": F.sum(worth), "gold_important": F.sum(F.when(important, worth).otherwise(0.0)), "issues": F.count("_issue"),
    }
    found = _scored(findings, gold, params, runs).groupBy(*(["run"] if runs else []), *ROUND, "language").agg(*(c.alias(name) for name, c in sums.items()))
    return found.fillna(0, list(sums))


def ratio(top: Column, bottom: Column, empty: float | None) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(empty).cast("double"))


def precision(tp: Column, vu: Column, fp: Column) -> Column:
    return ratio(tp + vu, tp + vu + fp, 1.0)


def f_beta(p: Column, r: Column, beta: float) -> Column:
    b2 = beta * beta
    return ratio((1 + b2) * p * r, b2 * p + r, 0.0)


def language_scores(tallies: DataFrame, params: ScoringParams) -> DataFrame:
    """precision, recall and f of each language, pooled over its PR-rounds."""
    sums = tallies.groupBy("language").agg(
        F.count("*").alias("rounds"), F.count_distinct("repo", "number").alias("prs"),
        *(F.sum(c).alias(c) for c in ("tp", "vu", "fp", "gold")),
    )
    p, r = precision(F.col("tp"), F.col("vu"), F.col("fp")), ratio(F.col("tp"), F.col("gold"), 1.0)
    return sums.select("language", "rounds", "prs", p.alias("precision"), r.alias("recall"), f_beta(p, r, params.beta).alias("f"))


def headline(scores: DataFrame, params: ScoringParams) -> DataFrame:
    """S: the languages' f, weighted, the weights renormalised over the languages present."""
    weight = F.coalesce(*(F.when(F.col("language") == k, F.lit(w)) for k, w in params.language_weights.items()))
    return scores.agg(ratio(F.sum(weight * F.col("f")), F.sum(weight), 0.0).alias("headline"))


def important_recall(tallies: DataFrame) -> DataFrame:
    """Recall on Important gold, and the share of clean PR-rounds with an Important finding."""
    clean = F.col("issues") == 0
    return tallies.agg(
        ratio(F.sum("tp_important"), F.sum("gold_important"), 1.0).alias("important_recall"),
        ratio(F.sum(F.when(clean, F.col("alarms"))).cast("double"), F.sum(clean.cast("int")), 0.0).alias("alarm_rate"),
    )


def precision_by(scored: DataFrame, *groups: str) -> DataFrame:
    """Findings, credited weights and weighted precision of each group; null where nothing was credited or charged."""
    part = lambda name: F.sum(F.when(F.col("credit") == name, F.col("weight")).otherwise(0.0))
    good, bad = part("tp") + part("vu"), part("fp")
    return scored.groupBy(*groups).agg(F.count("*").alias("findings"), ratio(good, good + bad, None).alias("precision"))


def class_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("final_klass", "credit").agg(F.count("*").alias("findings"))


def scored_counts(scored: DataFrame) -> DataFrame:
    """Findings by their part in the sums: valid unlabeled ones told apart by what they cost or earn."""
    over, inflated = over_cap(), (F.col("severity") == "important") & (F.col("judged_severity") == "nit")
    unlabeled = F.when(over, "vu_over_cap").when(inflated, "vu_inflated").when(F.col("credit") == "vu", "vu_credited").otherwise("vu_neutral")
    kind = F.when(F.col("final_klass") == "vu", unlabeled).otherwise(F.col("final_klass"))
    return scored.groupBy(kind.alias("kind")).agg(F.count("*").alias("findings"))


def over_cap() -> Column:
    """A valid unlabeled Nit beyond the cap of its round."""
    return (F.col("final_klass") == "vu") & (F.col("severity") == "nit") & (F.col("credit") == "fp")


def charged_findings(scored: DataFrame, most: int) -> DataFrame:
    """The heaviest false positives and valid Nits beyond the cap, `most` of each kind."""
    kind = F.when(over_cap(), "nit_beyond_cap").otherwise("false_positive")
    rows = scored.filter(F.col("credit") == "fp").withColumn("kind", kind)
    turn = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("weight"), *ROUND, "finding_id"))
    return rows.withColumn("rank", turn).filter(F.col("rank") <= most).select("kind", "rank", *ROUND, "finding_id", "weight")


def severity_confusion(scored: DataFrame) -> DataFrame:
    """Claimed against gold severity of true positives."""
    hits = scored.filter(F.col("credit") == "tp")
    return hits.groupBy(F.col("severity").alias("claimed"), "gold_severity").agg(F.count("*").alias("findings"))


def compare_runs(candidate: DataFrame, incumbent: DataFrame) -> DataFrame:
    """PR-rounds of two runs' tallies: in both, only in one, and what the candidate gains on those in both."""
    c = candidate.select(*ROUND, F.col("tp").alias("c_tp"), F.col("fp").alias("c_fp"))
    i = incumbent.select(*ROUND, F.col("tp").alias("i_tp"), F.col("fp").alias("i_fp"))
    both = c.join(i, ROUND, "full")
    kind = F.when(F.col("i_tp").isNull(), "only_candidate").when(F.col("c_tp").isNull(), "only_incumbent").otherwise("common")
    return both.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("rounds"), F.sum(F.col("c_tp") - F.col("i_tp")).alias("tp_gain"), F.sum(F.col("c_fp") - F.col("i_fp")).alias("fp_gain")
    )


def missed_gold(scored: DataFrame, gold: DataFrame, params: ScoringParams, most: int) -> DataFrame:
    """The heaviest gold issues that no finding earned, `most` for each severity."""
    hit = scored.filter(F.col("credit") == "tp").select(*ROUND, "gold_id")
    missed = gold.join(hit, [*ROUND, "gold_id"], "left_anti").withColumn("weight", weight_of(F.col("severity"), params) * F.col("conf"))
    turn = F.row_number().over(Window.partitionBy("severity").orderBy(F.desc("weight"), *ROUND, "gold_id"))
    return missed.withColumn("rank", turn).filter(F.col("rank") <= most).select("severity", "rank", *ROUND, "gold_id", "weight")
