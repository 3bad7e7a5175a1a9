"""Queries of the review, path and ranking operators, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import paths, ranking, reviews
from .inputs import THREADS, Input
from .queries import JUDGED, KIND_SQL, SCORED, judged_of, query, rounded, scored_of

LINE = "concat(CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(CAST(l_quantity AS INT) AS STRING), '-', substr(CAST(l_shipdate AS STRING), 1, 10))"
KEY = {"repo": "concat('repo', CAST(l_orderkey % 11 AS STRING))", "number": "l_orderkey"}
ROUND = {**KEY, "round": "CAST(1 + l_linenumber % 2 AS INT)"}
OPEN_PRS = Input("orders", {
    "repo": "concat('repo', CAST(o_orderkey % 11 AS STRING))", "number": "o_orderkey", "author": "CASE WHEN o_orderkey % 2 = 0 THEN 'amy' ELSE 'joe' END",
    "head": "concat('h', CAST(o_orderkey AS STRING))",
})
REVIEWS = Input("lineitem", {
    **KEY, "login": THREADS.columns["opener"], "login_type": THREADS.columns["opener_type"],
    "state": "CASE l_linestatus WHEN 'F' THEN 'CHANGES_REQUESTED' ELSE 'COMMENTED' END",
    "commit": "CASE WHEN l_partkey % 7 > 0 THEN concat('c', CAST(l_partkey AS STRING)) END",
    "submitted_at": "CASE WHEN l_suppkey % 9 > 0 THEN CAST(l_shipdate AS STRING) END",
}, "l_returnflag <> 'R'")
ANCHORS = Input("lineitem", {**KEY, "commit": "concat('a', CAST(l_suppkey AS STRING))", "created_at": "CAST(l_shipdate AS STRING)"}, "l_partkey % 3 = 0")
COMPARES = Input("lineitem", {
    **KEY, "compare_id": LINE, "base": "concat('c', CAST(l_suppkey % 3 AS STRING))", "direct": "l_quantity > 20", "complete": "l_partkey % 2 = 0",
    "path": "concat('src/f', CAST(l_partkey AS STRING), '.py')",
})
ISSUES = Input("lineitem", {**KEY, "issue_id": LINE, "opened_in": "CASE WHEN l_partkey % 8 > 0 THEN CAST(1 + l_linenumber % 3 AS INT) END", "there": "CAST(1 + l_suppkey % 3 AS INT)"})
RUNS = Input("orders", {"policy": "o_custkey % 25", "split": "o_orderpriority", "run_id": "o_orderkey", "created_at": "CAST(o_orderdate AS STRING)", "complete": "o_orderstatus <> 'P'"})
FILES = Input("lineitem", {
    "pr": "l_orderkey", "changed": "l_linenumber % 2 = 0",
    "path": "concat(CASE l_suppkey % 4 WHEN 0 THEN 'src/core/' WHEN 1 THEN 'tests/' WHEN 2 THEN 'src/core/tests/unit/' ELSE 'web/' END, CASE WHEN l_suppkey % 4 = 1 THEN 'test_' WHEN l_suppkey % 4 = 3 THEN '_' ELSE '' END, "
    "'mod', CAST(l_partkey % 5 AS STRING), CASE WHEN l_suppkey % 4 = 2 THEN '.test.ts' ELSE '.py' END)",
})
RANKED = Input("lineitem", {
    **ROUND, "finding_id": LINE, "head": "concat('h', CAST(l_orderkey AS STRING))", "path": "concat('src/f', CAST(l_partkey % 3 AS STRING), '.py')",
    "start_line": "CAST(l_quantity AS INT)", "end_line": "CAST(l_quantity AS INT) + 2", "category": "CASE l_partkey % 5 WHEN 0 THEN 'security' WHEN 1 THEN 'style' WHEN 2 THEN NULL ELSE 'logic' END",
    "title": "concat('Missing check for value', CAST(l_suppkey % 3 AS STRING))", "body": "concat('The bound of item', CAST(l_partkey % 2 AS STRING), ' is wrong. See line')",
    "severity": "CASE l_returnflag WHEN 'R' THEN 'important' WHEN 'A' THEN 'nit' ELSE 'pre_existing' END",
    "bucket": "CASE l_partkey % 4 WHEN 0 THEN 'act_on' WHEN 1 THEN 'consider' WHEN 2 THEN 'noted' ELSE 'dismissed' END",
    "confidence": "CAST(l_suppkey % 10 AS DOUBLE) / 10", "consensus": "l_partkey % 2 = 0", "evidence_level": "CAST(l_suppkey % 5 AS INT)",
    "posted": "l_partkey % 4 < 2", "anchored": "l_suppkey % 4 > 0", "klass": "CASE WHEN l_partkey % 4 > 1 AND l_suppkey % 3 > 0 THEN CASE WHEN l_suppkey % 3 = 1 THEN 'tp' ELSE 'fp' END END",
    "gold_id": "CASE WHEN l_suppkey % 5 = 0 THEN 'g' END", "duplicate_of": "CASE WHEN l_suppkey % 7 = 0 THEN 'd' END", "valid": "l_suppkey % 2 = 0",
    "lesson": "concat('l', CAST(l_partkey % 6 AS STRING))", "check_id": "concat('l', CAST(l_suppkey % 8 AS STRING))",
})
UNITS = Input("lineitem", {**ROUND, "proposed": "CAST(l_quantity AS BIGINT)", "malformed": "l_suppkey % 4"})
GLOBS = ["src/**/*.py", "web/*", "!**/tests/**", "!src/core/mod?.py"]
RULES = [
    {"id": "r1", "categories": ["style", "security"], "paths": [], "pattern": "value[01]"},
    {"id": "r2", "categories": ["logic", "style"], "paths": ["src/f1.*", "src/*2.py"], "pattern": "item1 is"},
]
LESSONS = ["l0", "l3", "l6", "zz"]


@query(f"""WITH r AS (SELECT r.*, author, {KIND_SQL.replace('opener_type', 'login_type').replace('opener', 'login')} AS kind FROM {REVIEWS.sql} r JOIN {OPEN_PRS.sql} p USING (repo, number)),
f AS (SELECT repo, number, bool_or(kind = 'human' AND login <> author) AS by_human, bool_or(kind = 'ai') AS by_ai, bool_or(kind = 'human' AND login <> author AND state = 'CHANGES_REQUESTED') AS changes_requested FROM r GROUP BY ALL)
SELECT repo, number, coalesce(by_human, FALSE) AS by_human, coalesce(by_ai, FALSE) AS by_ai, coalesce(changes_requested, FALSE) AS changes_requested FROM {OPEN_PRS.sql} LEFT JOIN f USING (repo, number)""")
def f7_review_flags(spark, sf_dir):
    return reviews.review_flags(OPEN_PRS.df(spark, sf_dir), REVIEWS.df(spark, sf_dir)).select("repo", "number", "by_human", "by_ai", "changes_requested")


@query(f"""WITH r AS (SELECT r.*, author, {KIND_SQL.replace('opener_type', 'login_type').replace('opener', 'login')} AS kind FROM {REVIEWS.sql} r JOIN {OPEN_PRS.sql} p USING (repo, number) WHERE commit IS NOT NULL AND submitted_at IS NOT NULL),
o AS (SELECT repo, number, commit, row_number() OVER (PARTITION BY repo, number ORDER BY pool, stamp, commit) AS turn FROM (
  SELECT repo, number, commit, submitted_at AS stamp, CASE WHEN kind = 'human' AND login <> author THEN 1 ELSE 2 END AS pool FROM r UNION ALL
  SELECT repo, number, commit, created_at, 3 FROM {ANCHORS.sql} UNION ALL SELECT repo, number, head, '', 4 FROM {OPEN_PRS.sql}) JOIN (SELECT repo, number FROM {OPEN_PRS.sql}) USING (repo, number))
SELECT repo, number, commit FROM o WHERE turn = 1""")
def f10_reviewed_commits(spark, sf_dir):
    return reviews.reviewed_commits(OPEN_PRS.df(spark, sf_dir), REVIEWS.df(spark, sf_dir), ANCHORS.df(spark, sf_dir))


@query(rf"""SELECT path, (regexp_matches(path, '^src/(.*/)?[^/]*\.py$') OR regexp_matches(path, '^web/[^/]*$')) AND NOT regexp_matches(path, '^(.*/)?tests/.*$') AND NOT regexp_matches(path, '^src/core/mod[^/]\.py$') AS in_scope, count(*) AS files FROM {FILES.sql} GROUP BY ALL""")
def f11_paths_in_scope(spark, sf_dir):
    return FILES.df(spark, sf_dir).groupBy("path").agg(F.count("*").alias("files")).withColumn("in_scope", paths.in_scope(F.col("path"), GLOBS))


@query(rf"""SELECT path, regexp_matches(path, '(^|/)tests/') OR regexp_matches(path, '/test_[^/]+$') OR regexp_matches(path, '\.test\.ts$') AS is_test, regexp_extract(path, 'mod[0-9]+') AS stem,
count(*) AS files FROM {FILES.sql} GROUP BY ALL""")
def f12_test_files(spark, sf_dir):
    files = FILES.df(spark, sf_dir).groupBy("path").agg(F.count("*").alias("files"))
    return files.select("path", paths.is_test(F.col("path")).alias("is_test"), paths.stem(F.col("path")).alias("stem"), "files")


@query(f"""WITH f AS (SELECT *, regexp_extract(path, 'mod[0-9]+') AS stem, path LIKE '%test%' AS test, CASE WHEN path LIKE 'src/core/tests/%' THEN 'src/core/tests/unit' WHEN path LIKE 'src/%' THEN 'src/core' WHEN path LIKE 'tests/%' THEN 'tests' ELSE 'web' END AS dir FROM {FILES.sql}),
p AS (SELECT DISTINCT t.pr, t.path, s.path AS subject, CASE WHEN t.dir = 'tests' AND s.dir = 'src/core' THEN 3 WHEN t.dir = 'tests' THEN 2 WHEN s.dir = 'src/core' THEN 2 ELSE 5 END AS distance
  FROM f t JOIN f s ON t.pr = s.pr AND t.stem = s.stem WHERE t.test AND NOT s.test AND s.changed AND NOT EXISTS (SELECT 1 FROM f c WHERE c.pr = t.pr AND c.path = t.path AND c.changed)),
b AS (SELECT pr, path, subject, distance, row_number() OVER (PARTITION BY pr, path ORDER BY distance, subject) AS turn FROM p WHERE distance <= 4)
SELECT pr, path, subject, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY pr ORDER BY distance, path) AS rank FROM b WHERE turn = 1) WHERE rank <= 2""")
def c3_near_tests(spark, sf_dir):
    files = FILES.df(spark, sf_dir)
    return paths.near_tests(files.filter("changed").select("pr", "path"), files.select("pr", "path"), 2)


@query(f"""WITH o AS (SELECT t.repo, t.number, t.thread_id, min((CASE WHEN c.direct AND f.path IS NOT NULL THEN 1 WHEN c.direct AND c.complete THEN 2 ELSE 3 END, c.compare_id)) AS best FROM {THREADS.sql} t
  JOIN {COMPARES.sql} c ON t.repo = c.repo AND t.number = c.number AND t.anchor = c.base LEFT JOIN {COMPARES.sql} f ON f.repo = c.repo AND f.number = c.number AND f.compare_id = c.compare_id AND f.path = t.path GROUP BY ALL)
SELECT t.repo, t.number, t.thread_id, best[2] AS compare_id FROM {THREADS.sql} t LEFT JOIN o USING (repo, number, thread_id)""")
def o4_deciding_compares(spark, sf_dir):
    compares = COMPARES.df(spark, sf_dir)
    decided = reviews.deciding_compares(THREADS.df(spark, sf_dir), compares, compares.select("repo", "number", "compare_id", "path"))
    return decided.select("repo", "number", "thread_id", "compare_id")


@query(f"""WITH i AS (SELECT DISTINCT repo, number, issue_id, coalesce(opened_in, 1) AS opened_in FROM {ISSUES.sql}), p AS (SELECT DISTINCT repo, number, issue_id, there FROM {ISSUES.sql} WHERE there <> 2)
SELECT i.repo, i.number, i.issue_id, i.opened_in, coalesce(max(there), 0) AS target_round FROM i LEFT JOIN p ON p.repo = i.repo AND p.number = i.number AND p.issue_id = i.issue_id AND there <= i.opened_in GROUP BY ALL""")
def j3_target_rounds(spark, sf_dir):
    rows = ISSUES.df(spark, sf_dir)
    issues = rows.select("repo", "number", "issue_id", "opened_in").withColumn("opened_in", F.coalesce("opened_in", F.lit(1))).distinct()
    replayed = rows.filter("there <> 2").select("repo", "number", F.col("there").alias("round"))
    found = reviews.target_rounds(issues, replayed, rows.select("repo", "number", "issue_id", F.col("there").alias("round")))
    return found.fillna(0, ["target_round"])


@query(f"""SELECT repo, number, base AS head, coalesce(min(compare_id) FILTER (direct), min(compare_id) FILTER (NOT direct)) AS diff FROM {COMPARES.sql} GROUP BY ALL""")
def j8_round_diffs(spark, sf_dir):
    rows = COMPARES.df(spark, sf_dir).select("repo", "number", F.col("base").alias("head"), F.col("compare_id").alias("diff"), "direct")
    return reviews.round_diffs(rows.filter("direct").drop("direct"), rows.filter("NOT direct").drop("direct"))


@query(f"SELECT policy, split, arg_max(run_id, (created_at, run_id)) AS run_id, max(created_at) AS created_at FROM {RUNS.sql} WHERE complete GROUP BY policy, split")
def j9_latest_runs(spark, sf_dir):
    return reviews.latest_runs(RUNS.df(spark, sf_dir), ["policy", "split"])


@query(f"""SELECT repo, number, round, finding_id, CASE WHEN gold_id IS NOT NULL THEN 'tp' WHEN posted AND duplicate_of IS NOT NULL THEN 'dup' WHEN posted AND valid THEN 'vu' ELSE 'fp' END AS klass, gold_id,
CASE WHEN gold_id IS NULL AND posted AND duplicate_of IS NULL AND valid THEN severity END AS judged_severity FROM {RANKED.sql} QUALIFY count(*) OVER (PARTITION BY repo, number, round, finding_id) = 1""")
def o17_fold_verdicts(spark, sf_dir):
    rows = RANKED.df(spark, sf_dir)
    keys = [*ranking.ROUND, "finding_id"]
    once = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in ("posted", "gold_id", "duplicate_of", "valid", "severity"))).filter("_n = 1")
    matched = once.filter("gold_id IS NOT NULL OR duplicate_of IS NOT NULL").select(*keys, "gold_id", "duplicate_of")
    return ranking.fold_verdicts(once.select(*keys, "posted"), matched, once.select(*keys, "valid", "severity"))


@query(f"""WITH f AS (SELECT *, CASE WHEN category IN ('style', 'security') AND regexp_matches(title || chr(10) || body, 'value[01]') THEN 'r1' WHEN category IN ('logic', 'style') AND regexp_matches(path, '^src/(f1\\.[^/]*|[^/]*2\\.py)$')
AND regexp_matches(title || chr(10) || body, 'item1 is') THEN 'r2' END AS l FROM {RANKED.sql}), g AS (SELECT *, CASE WHEN category IS NULL OR category <> 'security' THEN l END AS hit FROM f)
SELECT hit AS lesson, CASE WHEN hit IS NOT NULL THEN 'dismissed' ELSE bucket END AS bucket, category, count(*) AS findings FROM g GROUP BY ALL""")
def o15_suppressed(spark, sf_dir):
    return ranking.suppressed(RANKED.df(spark, sf_dir), RULES, ["security"]).groupBy("lesson", "bucket", "category").agg(F.count("*").alias("findings"))


@query(f"""WITH f AS (SELECT repo, number, round, path, finding_id, start_line, end_line, CASE WHEN title LIKE '%value0' THEN 1 WHEN title LIKE '%value1' THEN 2 ELSE 3 END AS v, CASE WHEN body LIKE '%item0%' THEN 0 ELSE 1 END AS b FROM {RANKED.sql})
SELECT x.repo, x.number, x.round, x.finding_id AS a, y.finding_id AS b, round((5.0 - (CASE WHEN x.v <> y.v THEN 1 ELSE 0 END) - (CASE WHEN x.b <> y.b THEN 1 ELSE 0 END) + 1) / (6.0 + (CASE WHEN x.v <> y.v THEN 1 ELSE 0 END) + (CASE WHEN x.b <> y.b THEN 1 ELSE 0 END)), 6) AS overlap
FROM f x JOIN f y ON x.repo = y.repo AND x.number = y.number AND x.round = y.round AND x.path = y.path AND x.finding_id < y.finding_id AND x.start_line - 5 <= y.end_line AND y.start_line - 5 <= x.end_line""")
def r1_similar_pairs(spark, sf_dir):
    return rounded(ranking.similar_pairs(RANKED.df(spark, sf_dir), 5))


SEVERITY_SQL = "CASE WHEN category = 'style' THEN 'nit' ELSE severity END"


@query(f"""WITH a AS (SELECT *, {SEVERITY_SQL} AS s, CASE WHEN bucket = 'act_on' AND {SEVERITY_SQL} = 'nit' THEN 'consider' ELSE bucket END AS b FROM {RANKED.sql} QUALIFY count(*) OVER (PARTITION BY repo, number, round, finding_id) = 1),
c AS (SELECT *, CASE WHEN b = 'consider' THEN 'nit' ELSE s END AS fs, CASE WHEN b IN ('act_on', 'consider') AND confidence < 0.5 THEN 'noted' ELSE b END AS cb FROM a),
d AS (SELECT *, CASE WHEN cb = 'consider' AND row_number() OVER (PARTITION BY repo, number, round, cb ORDER BY confidence DESC, consensus DESC, evidence_level DESC, finding_id) > 3 THEN 'noted' ELSE cb END AS fb,
  'f' || substr(sha1(head || chr(0) || path || chr(0) || CAST(start_line AS STRING) || chr(0) || title), 1, 10) AS sid FROM c)
SELECT repo, number, round, finding_id, fs AS severity, fb AS bucket, sid || repeat('x', row_number() OVER (PARTITION BY repo, number, round, sid ORDER BY finding_id) - 1) AS stable_id,
row_number() OVER (PARTITION BY repo, number, round ORDER BY list_position(['act_on', 'consider', 'noted', 'dismissed'], fb), list_position(['important', 'pre_existing', 'nit'], fs), confidence DESC, path, start_line, finding_id) AS rank FROM d""")
def r3_rank_findings(spark, sf_dir):
    rows = RANKED.df(spark, sf_dir)
    keys = [*ranking.ROUND, "finding_id"]
    once = rows.join(rows.groupBy(*keys).count().filter("count = 1").drop("count"), keys)
    return ranking.rank_findings(once, ranking.RankRules()).select(*keys, "severity", "bucket", "stable_id", "rank")


@query(f"""WITH f AS (SELECT * FROM {RANKED.sql} QUALIFY count(*) OVER (PARTITION BY repo, number, round, finding_id) = 1), c AS (SELECT count(*) AS proposed, count(*) FILTER (bucket = 'dismissed') AS dismissed, count(*) FILTER (bucket = 'dismissed' AND klass IS NOT NULL) AS dismissed_judged,
count(*) FILTER (bucket = 'dismissed' AND klass = 'tp') AS false_dismissals, count(*) FILTER (bucket = 'noted' AND klass IS NOT NULL) AS noted_judged, count(*) FILTER (bucket = 'noted' AND klass = 'tp') AS noted_matching_gold FROM f)
SELECT *, round(dismissed / proposed, 6) AS rejection_rate, round(false_dismissals / dismissed_judged, 6) AS false_dismissal_rate FROM c""")
def d4_verifier_report(spark, sf_dir):
    rows = RANKED.df(spark, sf_dir)
    keys = [*ranking.ROUND, "finding_id"]
    once = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.first("bucket").alias("bucket"), F.first("klass").alias("klass")).filter("_n = 1")
    return rounded(ranking.verifier_report(once.drop("klass"), once.filter("klass IS NOT NULL").select(*keys, "klass"), keys))


@query(f"""SELECT count(*) AS rounds, round(avg(n), 6) AS per_round, max(n) AS most, count(*) FILTER (n > 1) AS over_flag FROM (SELECT count(*) FILTER (bucket = 'act_on') AS n FROM {RANKED.sql} GROUP BY repo, number, round)""")
def d5_act_on_load(spark, sf_dir):
    return rounded(ranking.act_on_load(RANKED.df(spark, sf_dir), 1))


@query(f"""SELECT *, round(parsed / (parsed + malformed), 6) AS parse_rate, round(anchored / anchorable, 6) AS anchor_rate FROM (SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS parsed, CAST(sum(l_suppkey % 4) AS BIGINT) AS malformed,
CAST(count(*) FILTER (l_returnflag IN ('R', 'A')) AS BIGINT) AS anchorable, CAST(count(*) FILTER (l_returnflag IN ('R', 'A') AND l_suppkey % 4 > 0) AS BIGINT) AS anchored FROM lineitem)""")
def e11_well_formed(spark, sf_dir):
    return rounded(ranking.well_formed(UNITS.df(spark, sf_dir), RANKED.df(spark, sf_dir)))


@query(f"""WITH u AS (SELECT DISTINCT repo, number, round, l FROM (SELECT repo, number, round, lesson AS l FROM {RANKED.sql} UNION ALL SELECT repo, number, round, check_id FROM {RANKED.sql} WHERE posted))
SELECT lesson, count(l) AS fired FROM (VALUES ('l0'), ('l3'), ('l6'), ('zz')) v(lesson) LEFT JOIN u ON l = lesson GROUP BY lesson""")
def e12_lesson_exposure(spark, sf_dir):
    rows = RANKED.df(spark, sf_dir).withColumn("lessons_cited", F.array("lesson"))
    raised = F.when(F.col("posted"), F.array(F.lit("reader"), F.concat(F.lit("check:"), F.col("check_id")))).otherwise(F.array(F.lit("reader")))
    return ranking.lesson_exposure(rows.withColumn("raised_by", raised), LESSONS)


@query(f"""{SCORED}, u AS (SELECT *, category AS source FROM scored UNION ALL SELECT *, 'reader' FROM scored)
SELECT source, count(*) AS raised, count(*) FILTER (bucket = 'act_on') AS posted, count(DISTINCT (repo, number, round)) AS rounds, round(sum(CASE WHEN bucket = 'act_on' AND credit IN ('tp', 'vu') THEN weight ELSE 0 END)
/ nullif(sum(CASE WHEN bucket = 'act_on' AND credit IN ('tp', 'vu', 'fp') THEN weight ELSE 0 END), 0), 6) AS precision FROM u GROUP BY source""")
def d9_precision_by_source(spark, sf_dir):
    rows = scored_of(spark, sf_dir).withColumn("sources", F.array(F.col("category"), F.lit("reader"))).withColumn("posted", F.col("bucket") == "act_on")
    return rounded(ranking.precision_by_source(rows, "sources"))


KNOWN = f"""{JUDGED}, k AS (SELECT repo, number, thread_id, CASE WHEN outcome = 'thumbs_down' THEN 'thumbs_down' WHEN outcome = 'fixed' AND applied THEN 'applied_suggestion' WHEN outcome = 'fixed' AND addressed = 'addressed' THEN 'addressed_fix' END AS how
  FROM j WHERE author_kind IN ('human', 'ai'))"""


@query(f"{KNOWN} SELECT repo, number, thread_id, how, how <> 'thumbs_down' AS truth FROM k WHERE how IS NOT NULL")
def a7_known_answers(spark, sf_dir):
    return ranking.known_answers(judged_of(spark, sf_dir)).select("repo", "number", "thread_id", "how", "truth")


@query(f"""{KNOWN} SELECT id, truth FROM (SELECT DISTINCT CAST(number AS STRING) || '/' || thread_id AS id, how <> 'thumbs_down' AS truth FROM k WHERE how IS NOT NULL)
ORDER BY truth, sha256(id), id LIMIT 200""")
def p14_audit_items(spark, sf_dir):
    known = ranking.known_answers(judged_of(spark, sf_dir))
    return ranking.audit_items(known.select(F.concat_ws("/", "number", "thread_id").alias("id"), "truth").distinct(), 200)
