"""Queries of prose rules, commit headlines, lessons, benchmarks and human labels, with the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import prose
from ..operators.contamination import shared_folder
from ..sources import benchmarks
from .diff_queries import case
from .history_queries import MERGED
from .inputs import PRS, Input
from .queries import query
from .review_queries import KEY, LINE

# ------------------------------------------------------------------------------------------ T12, comment lint

#: Titles and bodies, each with what it breaks.
TITLES = [("Check the bound", []), ("This might fail.", [("hedging", "might"), ("title_period", "This might fail.")]), ("Wrong sum. Fix it", [("title_sentences", "Wrong sum. Fix it")]), ("Use `might` here", [])]
BODIES = [
    ("The index is computed twice — once here.", [("em_dash", "—"), ("passive_voice", "is computed")]), ("A lock is needed, and `it seems` fine.", []), ("Great catch! I hope this helps.", [("praise", "Great catch"), ("chatbot", "I hope this helps")]),
    ("Simply leverage the robust API in order to win", [("filler", "Simply"), ("filler", "in order to"), ("ai_vocabulary", "leverage"), ("ai_vocabulary", "robust")]), ("It was quickly written to disk -- twice", [("em_dash", " -- ")]),
    ("Two threads were started and one was quickly lost; perhaps it is shown.", [("hedging", "perhaps"), ("passive_voice", "were started"), ("passive_voice", "is shown")]),
]
WRITTEN = Input("lineitem", {
    **KEY, "finding_id": LINE, "title": case("l_partkey % 4", [t for t, _ in TITLES]), "body": case("l_suppkey % 6", [t for t, _ in BODIES]), "posted": "l_linenumber % 3 > 0", "t": "CAST(l_partkey % 4 AS INT)", "b": "CAST(l_suppkey % 6 AS INT)",
})
expected = lambda part, texts: ", ".join(f"('{part}', {i}, {k}, '{rule}', '{hit}')" for i, (_, found) in enumerate(texts) for k, (rule, hit) in enumerate(found))
LINT_SQL = f"SELECT w.repo, w.number, w.finding_id, v.part, v.ord, v.rule, v.excerpt FROM {WRITTEN.sql} w JOIN (VALUES {expected('title', TITLES)}, {expected('body', BODIES)}) v(part, form, ord, rule, excerpt) ON v.form = CASE v.part WHEN 'title' THEN w.t ELSE w.b END WHERE w.posted"


@query(LINT_SQL)
def t12_comment_lint(spark, sf_dir):
    return prose.lint(WRITTEN.df(spark, sf_dir), ["repo", "number", "finding_id"])


@query(f"SELECT rule, count(*) AS violations FROM ({LINT_SQL}) GROUP BY rule")
def t12_lint_counts(spark, sf_dir):
    return prose.lint_counts(t12_comment_lint(spark, sf_dir))


# ------------------------------------------------------------------------------------------ J5, commit headlines

COMMITTED = Input("lineitem", {
    **KEY, "ord": "CAST(l_linenumber AS INT)", "oid": "concat('c', CAST(l_linenumber AS STRING))", "committed_at": "CASE WHEN l_partkey % 9 > 0 THEN CAST(l_shipdate AS STRING) END", "headline": "CASE WHEN l_suppkey % 7 > 0 THEN concat('Commit ', CAST(l_partkey AS STRING)) ELSE '' END",
})
REPLAYED = Input("orders", {
    "repo": KEY["repo"].replace("l_", "o_"), "number": "o_orderkey", "round": "1", "commit": "concat('c', CAST(o_custkey % 9 AS STRING))", "started_at": "CASE WHEN o_custkey % 5 > 0 THEN CAST(o_orderdate AS STRING) END",
})


@query(f"""WITH c AS (SELECT DISTINCT * FROM {COMMITTED.sql}), r AS (SELECT * FROM {REPLAYED.sql})
SELECT c.repo, c.number, r.round, c.ord, c.headline FROM c JOIN r USING (repo, number) WHERE headline <> '' AND CASE WHEN EXISTS (SELECT 1 FROM c x WHERE x.repo = r.repo AND x.number = r.number AND x.oid = r.commit) THEN ord <= CAST(substr(r.commit, 2) AS INT) ELSE committed_at <= started_at END""")
def j5_headlines(spark, sf_dir):
    return prose.headlines(COMMITTED.df(spark, sf_dir).distinct(), REPLAYED.df(spark, sf_dir))


# ------------------------------------------------------------------------------------------ R5, lessons

#: Each order proposes a lesson; its evidence names itself and others, of which some are in the feed.
TEXTS_OF = ["Check that every retry has a limit", "Name the file src/core/io.py in full", "Follow v1.2 of the rules since 3f2a9c1d", "Check that every retry has its limit"]
PROPOSED = Input("orders", {
    "lesson": "concat('n', CAST(o_orderkey AS STRING))", "form": "CAST(o_custkey % 4 AS INT)", "kind": "CASE WHEN o_custkey % 3 = 0 THEN 'check' ELSE 'prompt' END", "change": "CASE WHEN o_custkey % 5 = 0 THEN 'change' ELSE 'add' END",
    "text": case("o_custkey % 4", TEXTS_OF), "applies_when": "CASE WHEN o_custkey % 7 > 0 THEN 'always' ELSE ' ' END", "why_not_check": "CASE WHEN o_custkey % 2 = 0 THEN 'needs judgment' END", "a": "o_orderkey", "n": "CAST(o_custkey % 6 AS INT)",
    "engine": "CASE o_custkey % 6 WHEN 0 THEN 'added_lines_regex' ELSE 'threshold' END", "pattern": "CASE WHEN o_orderkey % 2 = 0 THEN 'retry' ELSE 'absent' END", "exclude": "'# ok'", "select": "CAST(NULL AS STRING)",
}, "o_totalprice > 150000")
FEED = Input("orders", {"repo": "'a/b'", "number": "o_orderkey", "author": PRS.columns["author"]}, "o_orderkey % 3 > 0")
LESSONS_SQL = f"""WITH l AS (SELECT * FROM {PROPOSED.sql}), f AS (SELECT * FROM {FEED.sql}), c AS (SELECT lesson, a, unnest(range(a, a + n)) AS number FROM l),
e AS (SELECT lesson, count(f.number) AS prs, count(DISTINCT author) AS authors, count(*) - count(f.number) AS away, bool_or(f.number % 4 = 1) AS hit FROM c LEFT JOIN f USING (number) GROUP BY lesson),
j AS (SELECT l.*, coalesce(prs, 0) AS prs, coalesce(authors, 0) AS authors, coalesce(away, 0) AS away, coalesce(hit, FALSE) AND pattern = 'retry' AS hit FROM l LEFT JOIN e USING (lesson))"""


@query(f"""{LESSONS_SQL} SELECT lesson, 'not durable: names a commit hash (3f2a9c1d)' AS problem FROM j WHERE form = 2 UNION ALL SELECT lesson, 'not durable: names a version number (v1.2)' FROM j WHERE form = 2
UNION ALL SELECT lesson, 'not durable: names a file path (src/core/io.py)' FROM j WHERE form = 1 UNION ALL SELECT lesson, 'not specific: it does not say when it applies' FROM j WHERE kind = 'prompt' AND applies_when = ' '
UNION ALL SELECT lesson, 'cites pull requests outside the feed: ' || away FROM j WHERE away > 0 UNION ALL SELECT lesson, 'evidence of ' || prs || ' pull requests by ' || authors || ' authors' FROM j WHERE prs < 3 OR authors < 2
UNION ALL SELECT lesson, 'already covered by k1' FROM j WHERE change = 'add' AND form IN (0, 3) UNION ALL SELECT lesson, 'does not say why no check can express it' FROM j WHERE kind = 'prompt' AND change = 'add' AND why_not_check IS NULL
UNION ALL SELECT lesson, 'the check fires on none of the pull requests it cites' FROM j WHERE kind = 'check' AND engine = 'added_lines_regex' AND prs > 0 AND NOT hit""")
def r5_lesson_problems(spark, sf_dir):
    rows = PROPOSED.df(spark, sf_dir)
    cited = F.transform(F.filter(F.sequence(F.lit(0), F.lit(5)), lambda i: i < F.col("n")), lambda i: F.concat(F.lit("see a/b#"), F.col("a") + i, F.lit(" and more")))
    lessons = rows.withColumns({"evidence": cited, "paths": F.array(F.lit("src/**"), F.lit("!src/gen/*"))})
    feed = FEED.df(spark, sf_dir)
    form = F.col("number") % 4
    path = F.when(form == 2, "src/gen/x.py").when(form == 3, "docs/x.md").otherwise("src/lib/x.py")
    patch = F.when(form == 0, "@@ -1 +1,2 @@\n retry\n+retry # ok\n-retry").otherwise("@@ -1 +1 @@\n+one retry")
    known = spark.createDataFrame([("k1", TEXTS_OF[0]), ("k2", "Something else entirely"), ("k3", "Check that limits")], "lesson string, text string")
    return prose.lesson_problems(lessons, feed, feed.select("repo", "number", path.alias("path"), patch.alias("patch")), known, prose.LessonRules())


# ------------------------------------------------------------------------------------------ S3 to S6 benchmarks, S9 human labels

NOTED = Input("lineitem", {
    "number": "l_orderkey", "url": "concat('https://github.com/o/r', CAST(l_orderkey % 11 AS STRING), '/pull/', CAST(l_orderkey AS STRING))", "note": f"concat(' Note ', {LINE}, ' ')", "key": LINE, "valid": "l_linenumber % 3 > 0",
    "category": case("l_partkey % 5", ["Code Defect", "performance", "Maintainability and Readability", "odd"]), "path": "CASE WHEN l_suppkey % 6 > 0 THEN concat('f', CAST(l_partkey % 9 AS STRING)) ELSE '' END",
    "from_line": "CAST(l_quantity AS INT) - 3", "to_line": "CASE WHEN l_suppkey % 4 > 0 THEN CAST(l_suppkey % 60 AS INT) ELSE 0 END", "side": case("l_partkey % 3", ["right", "LEFT", "Right"]),
}, "l_orderkey % 4 = 0")


@query(f"""WITH n AS (SELECT *, 'o/r' || (number % 11) AS repo, row_number() OVER (PARTITION BY url ORDER BY valid DESC, key) AS k FROM (SELECT DISTINCT * FROM {NOTED.sql})),
v AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY key) AS i, path <> '' AND side <> 'LEFT' AND from_line >= 1 AS placed, CASE WHEN to_line = 0 THEN from_line ELSE to_line END AS last FROM n WHERE valid)
SELECT repo, number, repo || '#' || number || ':aacr-' || i AS id, path, CASE WHEN placed THEN least(from_line, last) ELSE 0 END AS start_line, CASE WHEN placed THEN greatest(from_line, last) ELSE 0 END AS end_line,
CASE WHEN category IN ('performance', 'Maintainability and Readability') THEN 'nit' ELSE 'important' END AS severity, CASE category WHEN 'Code Defect' THEN 'correctness' WHEN 'performance' THEN 'performance' WHEN 'odd' THEN 'other' ELSE coalesce(CASE WHEN category IS NOT NULL THEN 'design' END, 'other') END AS category, trim(note) AS description FROM v""")
def s4_s5_benchmark_gold(spark, sf_dir):
    """Positive and negative samples written as the benchmark has them, read back and turned into gold issues."""
    folder = f"{shared_folder(spark)}/samples-{uuid.uuid4().hex}"
    rows = NOTED.df(spark, sf_dir).distinct()
    comment = F.struct("note", "category", "path", "from_line", "to_line", "side")
    for name, valid in (("positive", True), ("negative", False)):
        listed = F.transform(F.array_sort(F.collect_list(F.struct("key", comment.alias("c")))), lambda x: x["c"])
        entries = rows.filter(F.col("valid") == valid).groupBy(F.col("url").alias("githubPrUrl")).agg(listed.alias("comments"))
        entries.withColumns({"source_commit": F.lit("s"), "target_commit": F.lit("t"), "project_main_language": F.lit("Go")}).write.json(f"{folder}/{name}")
    prs = benchmarks.read_samples(spark, f"{folder}/positive", f"{folder}/negative", lines=True)
    return benchmarks.gold_issues(prs, 1.0).select("repo", "number", "id", "path", "start_line", "end_line", "severity", "category", "description")


EXPORTED = Input("lineitem", {
    **KEY, "ord": LINE, "severity": case("l_partkey % 3", ["important", "nit", "pre_existing"]), "category": case("l_suppkey % 4", ["correctness", "tests", "odd", "privacy"]), "description": "CASE WHEN l_linenumber % 4 > 0 THEN concat(' Issue ', CAST(l_partkey AS STRING)) ELSE '  ' END",
}, "l_suppkey % 3 > 0")
SOURCES = Input("orders", {"repo": MERGED.columns["repo"], "number": "o_orderkey", "title": PRS.columns["title"], "url": "concat('u', CAST(o_orderkey AS STRING))", "source": PRS.columns["source"]})
ENTRIES_SQL = f"""WITH g AS (SELECT DISTINCT * FROM {EXPORTED.sql}), p AS (SELECT p.*, g.ord, trim(g.description) AS d, CASE g.severity WHEN 'important' THEN 'High' ELSE 'Low' END AS s, CASE g.category WHEN 'correctness' THEN 'bug' WHEN 'tests' THEN 'test_gap' WHEN 'privacy' THEN 'security' ELSE 'bug' END AS c
FROM {SOURCES.sql} p LEFT JOIN g USING (repo, number) WHERE source <> 'benchmark')"""


@query(f"{ENTRIES_SQL} SELECT repo, number, title AS pr_title, url, string_agg(d || '/' || s || '/' || c, ';' ORDER BY ord) AS comments FROM p WHERE d <> '' GROUP BY ALL")
def s6_golden_entries(spark, sf_dir):
    entries, _ = benchmarks.golden_entries(SOURCES.df(spark, sf_dir), EXPORTED.df(spark, sf_dir).distinct())
    return entries.withColumn("comments", F.array_join(F.transform("comments", lambda c: F.concat_ws("/", c["comment"], c["severity"], c["category"])), ";"))


@query(f"{ENTRIES_SQL}, k AS (SELECT repo, number, count(ord) AS n, count(*) FILTER (d <> '') AS said FROM p GROUP BY ALL) SELECT CASE WHEN n = 0 THEN 'no_gold' ELSE 'clean' END AS reason, count(*) AS n FROM k WHERE said = 0 GROUP BY 1")
def s6_left_out(spark, sf_dir):
    return benchmarks.golden_entries(SOURCES.df(spark, sf_dir), EXPORTED.df(spark, sf_dir).distinct())[1]


LABELED = Input("labels", {"file": "concat('x/labels-p', CAST(doc_id % 40 AS STRING), CASE WHEN doc_id % 40 = 7 THEN 'q' ELSE '' END, '.json')", "who": "CAST(doc_id % 40 AS INT)", "item": "doc_id", "verdict": "CASE WHEN doc_id % 23 = 0 THEN 'maybe' WHEN quality = 1 THEN 'valid' ELSE 'unsure' END"})


@query(f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY item) AS n FROM {LABELED.sql}) SELECT file, 'item ' || n || ': ' || CASE WHEN item % 31 = 0 THEN item || ' is not in the sample' ELSE 'no verdict: maybe' END AS problem FROM l WHERE item % 31 = 0 OR verdict = 'maybe'
UNION ALL SELECT DISTINCT file, 'the file must be named labels-p7.json' FROM l WHERE who = 7""")
def s9_label_problems(spark, sf_dir):
    return labels_of(spark, sf_dir)[1]


@query(f"""WITH l AS (SELECT * FROM {LABELED.sql}), bad AS (SELECT DISTINCT file FROM l WHERE item % 31 = 0 OR verdict = 'maybe' OR who = 7) SELECT 'p' || who AS labeler, CAST(item AS VARCHAR) AS item, verdict, '' AS note FROM l WHERE file NOT IN (SELECT file FROM bad)""")
def s9_human_labels(spark, sf_dir):
    return labels_of(spark, sf_dir)[0]


def labels_of(spark, sf_dir):
    rows = LABELED.df(spark, sf_dir)
    items = F.transform(F.array_sort(F.collect_list(F.struct("item", "verdict"))), lambda x: F.struct(x["item"].cast("string").alias("id"), x["verdict"].alias("verdict")))
    who = F.concat(F.lit("p"), F.col("who").cast("string"))
    files = rows.groupBy("file", "who").agg(items.alias("items")).select("file", F.to_json(F.struct(who.alias("labeler"), F.lit("2026").alias("labeled_at"), F.lit("1").alias("tool_version"), "items")).alias("value"))
    return benchmarks.human_labels(files, rows.filter("item % 31 > 0").select(F.col("item").cast("string").alias("item")))
