"""Public review benchmarks and files of human labels: read, checked, turned into gold issues, and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.texts import stripped

MARTIAN, AACR = "martian", "aacr"
COMMENT = "struct<text:string,severity:string,category:string,path:string,start_line:int,end_line:int,side:string,valid:boolean>"
GOLDEN = "pr_title STRING, url STRING, original_url STRING, comments ARRAY<STRUCT<comment: STRING, severity: STRING, category: STRING>>"
SAMPLES = (
    "githubPrUrl STRING, source_commit STRING, target_commit STRING, project_main_language STRING, "
    "comments ARRAY<STRUCT<note: STRING, category: STRING, path: STRING, from_line: INT, to_line: INT, side: STRING>>"
)
#: Fixed form of a pull request's address, and fixed labels of the benchmarks with ours.
PR_URL = r"(?U)^https://github\.com/([\w.-]+/[\w.-]+)/pull/([0-9]+)/?\z"
MARTIAN_SEVERITY = {"critical": "important", "high": "important", "medium": "important", "low": "nit"}
MARTIAN_CATEGORY = {
    "bug": "correctness", "concurrency": "concurrency", "api": "types/contracts", "security": "security", "style": "style", "doc_defect": "documentation",
    "data": "correctness", "perf": "performance", "speculative": "other", "test_gap": "tests",
}
AACR_LABELS = {
    "code defect": ("important", "correctness"), "security vulnerability": ("important", "security"), "performance": ("nit", "performance"),
    "maintainability and readability": ("nit", "design"),
}
SEVERITY_OUT = {"important": "High", "pre_existing": "Low", "nit": "Low"}
CATEGORY_OUT = {
    "correctness": "bug", "error handling": "bug", "memory/undefined behavior": "bug", "billing": "bug", "idempotency": "bug", "types/contracts": "api",
    "compatibility": "api", "performance": "perf", "tests": "test_gap", "documentation": "doc_defect", "comments": "doc_defect", "design": "style", "style": "style",
    "security": "security", "privacy": "security", "auth": "security", "concurrency": "concurrency", "data retention": "data", "migrations/schema": "data", "other": "speculative",
}
LOGIN, VERDICTS = r"^[A-Za-z0-9](?:[A-Za-z0-9]|-(?=[A-Za-z0-9])){0,38}\z", ("valid", "not_valid", "unsure")


class BenchmarkError(ValueError):
    """A benchmark whose files contradict each other or aren't its own."""


def looked_up(key: Column, table: dict[str, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for name, value in table.items():
        out = F.when(key == name, value).otherwise(out)
    return out


def text_of(c: Column | str) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))


def refuse(rows: DataFrame, url: str, why: str) -> None:
    bad = [str(r[0]) for r in rows.select(url).limit(5).collect()]
    if bad:
        raise BenchmarkError(f"{why}: {', '.join(bad)}")


def keyed(rows: DataFrame, url: str) -> DataFrame:
    """rows with repo and number of a pull request's address; an address of none is an error."""
    refuse(rows.filter(~F.coalesce(stripped(F.col(url)).rlike(PR_URL), F.lit(False))), url, "not the address of a pull request")
    return rows.withColumns({"repo": F.regexp_extract(stripped(F.col(url)), PR_URL, 1), "number": F.regexp_extract(stripped(F.col(url)), PR_URL, 2).cast("long")})


def read_golden(spark: SparkSession, paths: list[str], combined: str | None = None) -> DataFrame:
    """(benchmark, url, repo, number, title, original_url, comments) of golden comment files, a row a pull request.

    Of an address in several files the entry of the last file by name counts. combined, a file of {url: {golden_comments}},
    has to name only addresses of the golden files, each with as many comments.
    """
    rows = spark.read.schema(GOLDEN).option("multiLine", "true").json(paths).withColumn("_file", F.input_file_name())
    one = keyed(rows.groupBy("url").agg(F.max_by(F.struct("pr_title", "original_url", "comments"), "_file").alias("r")).select("url", "r.*"), "url")
    comment = lambda c: F.struct(
        stripped(text_of(c["comment"])).alias("text"), text_of(c["severity"]).alias("severity"), text_of(c["category"]).alias("category"), F.lit("").alias("path"),
        F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit("right").alias("side"), F.lit(True).alias("valid"),
    )
    comments = F.transform(F.coalesce("comments", F.array().cast("array<struct<comment:string,severity:string,category:string>>")), comment)
    found = one.select(F.lit(MARTIAN).alias("benchmark"), "url", "repo", "number", text_of("pr_title").alias("title"), text_of("original_url").alias("original_url"), comments.alias("comments"))
    if combined:
        whole = spark.read.option("wholetext", "true").text(combined)
        entries = whole.select(F.explode(F.from_json("value", "map<string,struct<golden_comments:array<string>>>")).alias("url", "e"))
        both = entries.join(found.select("url", F.size("comments").alias("_n")), "url", "left")
        refuse(both.filter("_n IS NULL"), "url", "not in the golden comments")
        refuse(both.filter(F.greatest(F.size("e.golden_comments"), F.lit(0)) != F.col("_n")), "url", "other golden comments than in the golden file")
    return found


def noted(valid: bool):
    return lambda c: F.struct(
        stripped(text_of(c["note"])).alias("text"), F.lit("").alias("severity"), text_of(c["category"]).alias("category"), text_of(c["path"]).alias("path"),
        F.coalesce(c["from_line"], F.lit(0)).alias("start_line"), F.coalesce(c["to_line"], F.lit(0)).alias("end_line"), F.coalesce(c["side"], F.lit("right")).alias("side"), F.lit(valid).alias("valid"),
    )


def read_samples(spark: SparkSession, positive: str, negative: str | None = None, lines: bool = False) -> DataFrame:
    """(benchmark, url, repo, number, language, base_commit, head_commit, comments) of positive and negative samples.

    lines: the files are JSON Lines, which many tasks read, and not one array. Comments of the negative samples stay, as not
    valid, after the others. Samples of one address have to be of the same commits.
    """
    parts = []
    for order, path in enumerate([positive, negative] if negative else [positive]):
        rows = spark.read.schema(SAMPLES).option("multiLine", str(not lines)).json(path)
        numbered = rows.withColumn("_at", F.monotonically_increasing_id())
        parts.append(numbered.select(F.lit(order).alias("_order"), "_at", F.col("githubPrUrl").alias("url"), "source_commit", "target_commit", "project_main_language", F.transform("comments", noted(order == 0)).alias("c")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    grouped = both.groupBy("url").agg(
        F.count_distinct(F.struct("source_commit", "target_commit")).alias("_commits"), F.min_by("source_commit", F.struct("_order", "_at")).alias("base_commit"),
        F.min_by("target_commit", F.struct("_order", "_at")).alias("head_commit"), F.min_by("project_main_language", F.struct("_order", "_at")).alias("language"),
        F.array_sort(F.collect_list(F.struct("_order", "_at", "c"))).alias("_parts"),
    )
    refuse(grouped.filter("_commits > 1"), "url", "the positive and negative samples review other commits")
    comments = F.flatten(F.transform("_parts", lambda p: F.coalesce(p["c"], F.array().cast(f"array<{COMMENT}>"))))
    return keyed(grouped, "url").select(F.lit(AACR).alias("benchmark"), "url", "repo", "number", text_of("language").alias("language"), "base_commit", "head_commit", comments.alias("comments"))


def gold_issues(prs: DataFrame, conf: float) -> DataFrame:
    """(repo, number, benchmark, id, ord, path, start_line, end_line, severity, category, conf, description): a gold issue a valid comment.

    Lines are those on the right side, in order; (0, 0) where there is no place. Unknown labels are important and `other`.
    ord is a pull request's order by path, first line and id, from 1.
    """
    valid = prs.select("repo", "number", "benchmark", F.posexplode(F.filter("comments", lambda c: c["valid"])).alias("_n", "c"))
    severity, category = stripped(F.lower("c.severity")), stripped(F.lower("c.category"))
    martian = F.col("benchmark") == MARTIAN
    placed = (F.col("c.path") != "") & (F.lower("c.side") == "right") & (F.col("c.start_line") >= 1)
    last = F.when(F.col("c.end_line") == 0, F.col("c.start_line")).otherwise(F.coalesce("c.end_line", "c.start_line"))
    line = lambda of: F.when(placed, of(F.col("c.start_line"), last)).otherwise(0).cast("int")
    issue = F.concat(F.concat_ws("#", "repo", "number"), F.lit(":"), "benchmark", F.lit("-"), F.col("_n") + 1)
    rows = valid.select(
        "repo", "number", "benchmark", issue.alias("id"), text_of("c.path").alias("path"), line(F.least).alias("start_line"), line(F.greatest).alias("end_line"),
        F.when(martian, looked_up(severity, MARTIAN_SEVERITY, "important")).otherwise(looked_up(category, {k: v[0] for k, v in AACR_LABELS.items()}, "important")).alias("severity"),
        F.when(martian, looked_up(category, MARTIAN_CATEGORY, "other")).otherwise(looked_up(category, {k: v[1] for k, v in AACR_LABELS.items()}, "other")).alias("category"),
        F.lit(conf).alias("conf"), stripped(text_of("c.text")).alias("description"),
    )
    order = F.row_number().over(Window.partitionBy("repo", "number", "benchmark").orderBy("path", "start_line", "id"))
    return rows.withColumn("ord", order)


def golden_entries(prs: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of golden comment files, (repo, number, pr_title, url, comments), and (reason, n) of what was left out.

    prs (repo, number, title, url, source), gold (repo, number, ord or null for a gold set without issues, severity,
    category, description). Pull requests of benchmarks aren't exported; those without a gold set count as no_gold, those
    without an issue that has a description as clean.
    """
    own = prs.filter("source <> 'benchmark'")
    comment = F.struct(
        stripped(text_of("description")).alias("comment"), looked_up(F.col("severity"), SEVERITY_OUT, "Low").alias("severity"), looked_up(F.col("category"), CATEGORY_OUT, "bug").alias("category")
    )
    listed = F.array_sort(F.collect_list(F.when(stripped(text_of("description")) != "", F.struct("ord", comment.alias("c")))))
    sets = gold.groupBy("repo", "number").agg(F.transform(listed, lambda x: x["c"]).alias("comments"))
    joined = own.join(sets, ["repo", "number"], "left")
    reason = F.when(F.col("comments").isNull(), "no_gold").when(F.size("comments") == 0, "clean")
    entries = joined.filter(F.size("comments") > 0).select("repo", "number", F.col("title").alias("pr_title"), "url", "comments")
    return entries, joined.select(reason.alias("reason")).filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def write_golden(entries: DataFrame, path: str) -> None:
    """A folder for each repo, with its pull requests in order; a slash in its name is written as two underscores."""
    rows = entries.withColumn("_repo", F.replace(F.col("repo"), F.lit("/"), F.lit("__"))).repartition("_repo").sortWithinPartitions("_repo", "number")
    rows.select("_repo", "pr_title", "url", "comments").write.partitionBy("_repo").json(path)


LABELS = "labeler STRING, labeled_at STRING, tool_version STRING, items ARRAY<STRUCT<id: STRING, verdict: STRING, note: STRING>>"


def human_labels(files: DataFrame, sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels (labeler, item, verdict, note) of the valid files, and (file, problem) of the others: every problem is listed.

    files (file, value: its JSON), sample (item). A file is named labels-<labeler>.json and has the labels of one person,
    each item of the sample once at most; of several files of a person the first by name counts.
    """
    parsed = files.select("file", F.from_json("value", LABELS).alias("d"), F.try_parse_json("value").isNotNull().alias("_json"))
    labeler, named = F.col("d.labeler"), F.lower(F.substring_index("file", "/", -1))
    good = F.coalesce(labeler.rlike(LOGIN), F.lit(False))
    whole = F.array(
        F.when(~F.coalesce("_json", F.lit(False)), "not JSON"), F.when(F.col("_json") & ~good, "no labeler's name"),
        F.when(good & (named != F.concat(F.lit("labels-"), F.lower(labeler), F.lit(".json"))), F.concat(F.lit("the file must be named labels-"), labeler, F.lit(".json"))),
        *(F.when(F.col("_json") & F.col(f"d.{c}").isNull(), f"{c} must be text") for c in ("labeled_at", "tool_version")), F.when(F.col("_json") & F.col("d.items").isNull(), "items must be a list"),
    )
    of_file = parsed.select("file", F.explode(F.filter(whole, lambda p: p.isNotNull())).alias("problem"))
    items = parsed.select("file", labeler.alias("labeler"), F.posexplode("d.items").alias("_at", "x")).select("file", "labeler", "_at", "x.*")
    again = F.row_number().over(Window.partitionBy("file", "id").orderBy("_at")) > 1
    known = items.withColumn("_again", again).join(sample.select(F.col("item").alias("id")).distinct().withColumn("_in", F.lit(True)), "id", "left")
    why = (
        F.when(F.col("id").isNull(), "needs an id").when(F.col("_in").isNull(), F.concat("id", F.lit(" is not in the sample"))).when(F.col("_again"), F.concat("id", F.lit(" appears twice")))
        .when(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)), F.concat(F.lit("no verdict: "), text_of("verdict")))
    )
    of_items = known.select("file", F.concat(F.lit("item "), F.col("_at") + 1, F.lit(": "), why).alias("problem")).filter("problem IS NOT NULL")
    wrong = of_file.unionByName(of_items)
    valid = parsed.join(wrong.select("file").distinct(), "file", "left_anti").select("file", labeler.alias("labeler"))
    first = valid.groupBy(F.lower("labeler").alias("_who")).agg(F.min("file").alias("_first"))
    told = valid.withColumn("_who", F.lower("labeler")).join(first, "_who")
    second = told.filter("file <> _first").select("file", F.concat("_first", F.lit(" is already "), "labeler", F.lit("'s file")).alias("problem"))
    kept = told.filter("file = _first").select("file")
    return items.join(kept, "file", "left_semi").select("labeler", F.col("id").alias("item"), "verdict", text_of("note").alias("note")), wrong.unionByName(second)
