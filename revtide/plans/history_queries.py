"""Queries of code over time, suggestions, diffs and checks, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, patches, suggestions
from .diff_queries import PATCH, S, T, case
from .inputs import Input
from .queries import query
from .review_queries import KEY, LINE

# ------------------------------------------------------------------------------------------ O12, line mapping

#: Versions of a file: line `d` went, two lines came after `e`, line `r` changed.
FILES = Input("part", {"path": "concat('src/p', CAST(p_partkey AS STRING), '.py')", "n": "60 + p_size", "d": "CAST(3 + p_partkey % 10 AS INT)"})
E, R = 15, 18
RANGES = Input("lineitem", {
    **KEY, "path": "concat('src/p', CAST(l_partkey AS STRING), '.py')", "old_commit": "'old'", "new_commit": "'new'", "start_line": "CAST(l_quantity AS INT)",
    "end_line": "CAST(l_quantity AS INT) + CAST(l_linenumber % 4 AS INT)",
})
TO_NEW = lambda k: f"({k} - CASE WHEN {k} > d THEN 1 ELSE 0 END + CASE WHEN {k} > {E} THEN 2 ELSE 0 END)"
TO_OLD = lambda k: f"({k} + CASE WHEN {k} < d THEN 0 WHEN {k} < {E} THEN 1 ELSE -1 END)"
NEW_LINES = " AND ".join(f"NOT {n} BETWEEN start_line AND end_line" for n in (E, E + 1, R + 1))


@query(f"""SELECT repo, number, path, start_line, end_line, CASE WHEN start_line = d AND end_line = d THEN d ELSE {TO_NEW('CASE WHEN start_line = d THEN d + 1 ELSE start_line END')} END AS new_start,
CASE WHEN start_line = d AND end_line = d THEN d - 1 ELSE {TO_NEW('CASE WHEN end_line = d THEN d - 1 ELSE end_line END')} END AS new_end,
CASE WHEN {NEW_LINES} THEN {TO_OLD('start_line')} END AS old_start, CASE WHEN {NEW_LINES} THEN {TO_OLD('end_line')} END AS old_end FROM {RANGES.sql} JOIN {FILES.sql} USING (path)""")
def o12_mapped_ranges(spark, sf_dir):
    files = FILES.df(spark, sf_dir)
    line = lambda k: F.concat(F.lit("line "), k.cast("string"))
    every = F.sequence(F.lit(1), "n")
    changed = F.transform(every, lambda k: F.when(k == F.col("d"), F.array().cast("array<string>")).when(k == E, F.array(line(k), F.lit("new a"), F.lit("new b"))).when(k == R, F.array(F.lit("changed"))).otherwise(F.array(line(k))))
    version = lambda name, lines: files.select("path", F.lit(name).alias("commit"), F.array_join(lines, "\n").alias("text"))
    versions = version("old", F.transform(every, line)).unionByName(version("new", F.flatten(changed)))
    found = history.mapped_ranges(RANGES.df(spark, sf_dir), versions, [])
    return found.select("repo", "number", "path", "start_line", "end_line", F.col("forward.start").alias("new_start"), F.col("forward.end").alias("new_end"), F.col("back.start").alias("old_start"), F.col("back.end").alias("old_end"))


# ------------------------------------------------------------------------------------------ O13, escaped defects

RULES = history.DefectRules(window_end="1998-06-30", after_days=365, max_files=3)
MERGED = Input("orders", {
    "repo": KEY["repo"].replace("l_", "o_"), "number": "o_orderkey", "title": case("o_custkey % 4", ["Fix the crash", "Add docs", "Prefix sums", "Correct the wrong offset"]),
    "label": "CASE o_custkey % 5 WHEN 0 THEN 'Type: Bug' ELSE 'chore' END", "created_at": "CAST(o_orderdate AS STRING)", "merge_commit": "CASE WHEN o_orderkey % 17 > 0 THEN concat('m', CAST(o_orderkey AS STRING)) END",
})
FIX_FILES = Input("lineitem", {
    **KEY, "path": f"concat(CASE l_suppkey % 6 WHEN 0 THEN 'tests/f' ELSE 'src/f' END, {LINE}, CASE l_suppkey % 6 WHEN 1 THEN '.md' ELSE '.py' END)",
    "status": "CASE l_partkey % 7 WHEN 0 THEN 'added' ELSE 'modified' END", "patch": f"CASE WHEN l_partkey % 13 > 0 THEN {PATCH} END", "s": f"CAST({S} AS INT)", "p": "l_partkey", "k": "l_suppkey",
})
CORPUS = Input("orders", {
    "repo": MERGED.columns["repo"], "number": "o_orderkey", "corpus": "CASE o_orderstatus WHEN 'O' THEN 'human' WHEN 'F' THEN 'approval_only' ELSE 'ai_feedback' END",
    "head_oid": "concat('c', CAST(o_custkey % 97 AS STRING))", "reviewed_commit": "concat('r', CAST(o_orderkey % 11 AS STRING))", "oid": "concat('c', CAST(50 + o_custkey % 53 AS STRING))",
})
#: Of the six lines from the one before a fixed range, by their number j: who wrote it, its text, and whether history ends there.
BLAMED = {"sha": "concat('c', CAST((p + CASE WHEN p % 3 > 0 THEN CAST(floor((j + 1) / 2) AS INT) ELSE 0 END) % 200 AS STRING))", "text": "concat(' v', CAST((k + j) % 5 AS STRING))", "boundary": "j = 1 AND k % 9 = 0"}
SAID = "CASE WHEN sha LIKE '%7' THEN concat('Merge pull request #', n, ' from x') ELSE concat('Work (#', n, ')') END"

FIXED_SQL = rf"""WITH f AS (SELECT DISTINCT * FROM {FIX_FILES.sql}), c AS (SELECT * FROM {CORPUS.sql} WHERE corpus IN ('human', 'approval_only')),
x AS (SELECT repo, number, title, merge_commit FROM {MERGED.sql} WHERE substr(created_at, 1, 10) BETWEEN '1998-07-01' AND '1999-06-30' AND (title IN ('Fix the crash', 'Correct the wrong offset') OR label = 'Type: Bug')
  AND repo IN (SELECT repo FROM c)),
src AS (SELECT f.* FROM f JOIN x USING (repo, number) WHERE merge_commit IS NOT NULL AND status = 'modified' AND patch IS NOT NULL AND path LIKE 'src/%.py'),
n AS (SELECT repo, number, count(*) AS files FROM src GROUP BY ALL),
b AS (SELECT repo, number, path, p, k, j, {BLAMED['sha']} AS sha FROM src JOIN n USING (repo, number), (SELECT unnest([1, 2, 3]) AS j) WHERE files <= 3 AND NOT ({BLAMED['boundary']})),
-- a range has the lines j = 1 to 3; those of one commit are neighbours
blocks AS (SELECT repo, number AS fix, path, sha, any_value(p) AS p, any_value(k) AS k, min(j) AS j, count(*) AS size FROM b GROUP BY repo, number, path, sha),
o AS (SELECT repo, sha, coalesce(arg_max(number, (kind, number)) FILTER (kind > 0), max(number) FILTER (kind = 0)) AS number FROM (
  SELECT repo, head_oid AS sha, number, 2 AS kind FROM c UNION ALL SELECT repo, oid, number, 1 FROM c
  UNION ALL SELECT c.repo, 'c' || i, number, 0 FROM c JOIN (SELECT unnest(range(200)) AS i) ON number = 7 * i) GROUP BY ALL),
l AS (SELECT blocks.*, o.number, CASE WHEN p % 4 > 0 AND p % 6 < 5 THEN 1 + ((k + j - p - 1) % 5 + 5) % 5 END AS start_line FROM blocks JOIN o USING (repo, sha))"""


def escaped(spark, sf_dir):
    files = FIX_FILES.df(spark, sf_dir).distinct()
    lines = FIX_FILES.df(spark, sf_dir).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(5))))
    # a path names its part and supplier, so lines are told apart by what they hold
    blame = lines.select("repo", "number", "path", (F.col("s") - 1 + F.col("j")).alias("line"), *(F.expr(e).alias(c) for c, e in BLAMED.items())).distinct()
    corpus = CORPUS.df(spark, sf_dir)
    shas = lines.select("repo", F.expr(BLAMED["sha"]).alias("sha")).distinct().withColumn("n", (7 * F.substring("sha", 2, 9).cast("int")).cast("string"))
    text = F.when(F.col("p") % 4 == 0, F.lit("nothing")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), (7 + F.col("p") % 5).cast("int")), lambda i: F.concat(F.lit("  v"), ((i + F.col("p")) % 5).cast("string"))), "\n"))
    versions = files.filter("p % 6 < 5").select("repo", F.concat(F.lit("r"), (F.col("number") % 11).cast("string")).alias("commit"), "path", text.alias("text"))
    merged = MERGED.df(spark, sf_dir).withColumn("labels", F.array("label"))
    return history.escaped_defects(merged, files, blame, shas.select("repo", "sha", F.expr(SAID).alias("message")), corpus, corpus.select("repo", "number", "oid"), versions, RULES)


@query(f"{FIXED_SQL} SELECT repo, number, fix, sha, path, CAST(start_line AS INT) AS start_line, CAST(start_line + size - 1 AS INT) AS end_line, repo || '#' || number || ':fix' || fix || ':' || path || ':' || start_line AS issue_id FROM l WHERE start_line IS NOT NULL")
def o13_escaped_defects(spark, sf_dir):
    return escaped(spark, sf_dir)[0].select("repo", "number", "fix", "sha", "path", "start_line", "end_line", "issue_id")


@query(f"""{FIXED_SQL} SELECT repo, reason, count(*) AS n FROM (SELECT repo, CASE WHEN merge_commit IS NULL THEN 'no merge commit' WHEN files IS NULL THEN 'no source file rewritten' WHEN files > 3 THEN 'too many files' END AS reason
FROM x LEFT JOIN n USING (repo, number) UNION ALL SELECT repo, 'lines not found at the reviewed commit' FROM l WHERE start_line IS NULL) WHERE reason IS NOT NULL GROUP BY ALL""")
def o13_skipped_fixes(spark, sf_dir):
    return escaped(spark, sf_dir)[1]


# ------------------------------------------------------------------------------------------ O7, suggestions

FENCE = "chr(10), '{f} suggestion', chr(10), '{text}', chr(10), '{f}', chr(10)"
block = lambda text, fence="```": FENCE.format(f=fence, text=text)
BODY = (
    f"CASE l_partkey % 7 WHEN 0 THEN 'no block' WHEN 1 THEN concat('use this', {block('  new ')}) WHEN 2 THEN concat('two', {block('other text')}, 'or', {block('more')}, 'end') "
    f"WHEN 3 THEN concat('tilde', {block('missing text', '~~~')}, {block('new')}) WHEN 4 THEN concat('gone', {block('')}) WHEN 5 THEN concat('short', {block('b')}) "
    f"ELSE concat('open', chr(10), '```` suggestion', chr(10), 'new', chr(10), '```', chr(10), 'more', chr(10), '````') END"
)
SUGGESTED = Input("lineitem", {
    **KEY, "thread_id": LINE, "body": BODY, "form": "l_partkey % 7", "reviewer": case("l_suppkey % 3", ["amy", "joe"]), "opened_at": "CASE WHEN l_suppkey % 11 > 0 THEN CAST(l_shipdate AS STRING) END",
    "diff_side": "CASE WHEN l_partkey % 13 = 0 THEN 'LEFT' ELSE 'RIGHT' END", "start_line": f"CAST({S} + l_linenumber % 3 AS INT)", "end_line": f"CASE WHEN l_suppkey % 8 > 0 THEN CAST({S} + l_linenumber % 3 + 1 AS INT) END",
    "lines_changed": "CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey % 4 > 0 END", "patch": f"CASE WHEN l_partkey % 5 > 0 THEN {PATCH} END", "near": "l_linenumber % 3 < 2",
})
HEADLINES = ["Apply suggestions from code review", "apply suggestion from @amy and more", " Apply suggestions from @joe", "Reapply suggestions from code review"]
PUSHED = Input("orders", {"repo": MERGED.columns["repo"], "number": "o_orderkey", "headline": case("o_custkey % 5", HEADLINES), "committed_at": "CAST(o_orderdate AS STRING)"}, "o_custkey % 5 < 4")


@query(f"""WITH s AS (SELECT DISTINCT * FROM {SUGGESTED.sql}), h AS (SELECT s.*, coalesce(lines_changed, FALSE) AS changed,
  coalesce(near AND diff_side = 'RIGHT' AND end_line IS NOT NULL AND patch IS NOT NULL AND form IN (1, 2, 3), FALSE) AS in_patch,
  EXISTS (SELECT 1 FROM {PUSHED.sql} p WHERE p.repo = s.repo AND p.number = s.number AND committed_at >= coalesce(opened_at, '') AND (headline LIKE 'Apply suggestions from code%' OR headline LIKE 'apply%' AND reviewer = 'amy' OR headline LIKE ' Apply%' AND reviewer = 'joe')) AS by_commit FROM s)
SELECT repo, number, thread_id, CASE WHEN form = 0 THEN 'none' WHEN changed AND (in_patch OR by_commit) THEN 'applied' ELSE 'not_applied' END AS suggestion,
CASE WHEN form = 0 THEN '' WHEN NOT changed THEN '{suggestions.UNCHANGED}' WHEN in_patch THEN '{suggestions.IN_PATCH}' WHEN by_commit THEN '{suggestions.BY_COMMIT}' ELSE '{suggestions.NOT_FOUND}' END AS reason FROM h""")
def o7_suggestions(spark, sf_dir):
    found = suggestions.suggestion_states(SUGGESTED.df(spark, sf_dir).distinct(), PUSHED.df(spark, sf_dir))
    return found.select("repo", "number", "thread_id", "suggestion", "reason")


# ------------------------------------------------------------------------------------------ O3, split diffs; O14, checks

NL = "chr(10)"
A_FILE = "CAST(l_suppkey AS STRING)"
DIFF = ", ".join([
    "'header of no file'", NL, f"'diff --git a/src/a', {A_FILE}, '.py b/src/a', {A_FILE}, '.py'", NL, "'new file mode 100644'", NL, "'--- /dev/null'", NL, f"'+++ b/src/a', {A_FILE}, '.py'", NL, "'@@ -0,0 +1,2 @@'", NL, "'+one'", NL, "'+++ two'", NL,
    f"'diff --git a/old b/dir', {A_FILE}, '/new'", NL, "'similarity index 90%'", NL, "'rename from old'", NL, f"'rename to dir', {A_FILE}, '/new'", NL, f"'diff --git a/gone', {A_FILE}, ' b/gone', {A_FILE}", NL, "'deleted file mode 100644'", NL, "'index 1..0'", NL,
    f"'--- a/gone', {A_FILE}", NL, "'+++ /dev/null'", NL, "'@@ -1 +0,0 @@'", NL, "'-x'", NL, "chr(92), ' No newline at end of file'", NL, "'diff --git a/m.c b/m.c'", NL, "'--- a/m.c'", NL, "'+++ b/m.c'", NL, "'@@ -1 +1 @@ f'", NL, "'-x'", NL, "'+y'", NL, "' z'", NL,
    "'diff --git a/img.png b/img.png'", NL, "'Binary files differ'", NL,
])
DIFFS = Input("lineitem", {**KEY, "thread_id": LINE, "k": "CAST(l_suppkey AS STRING)", "diff": f"CASE l_partkey % 3 WHEN 0 THEN concat('--- a/p', {A_FILE}, {NL}, '+++ b/p', {A_FILE}, {NL}, '@@ -1 +1 @@', {NL}, '-a', {NL}, '+b', {NL}) WHEN 1 THEN concat({DIFF}) END", "form": "l_partkey % 3"})


@query(f"""WITH d AS (SELECT * FROM {DIFFS.sql}), e AS (SELECT repo, number, thread_id, unnest([
  {{'path': 'src/a' || k || '.py', 'status': 'added', 'patch': '@@ -0,0 +1,2 @@' || chr(10) || '+one' || chr(10) || '+++ two', 'previous_path': NULL}}, {{'path': 'dir' || k || '/new', 'status': 'renamed', 'patch': NULL, 'previous_path': 'old'}},
  {{'path': 'gone' || k, 'status': 'removed', 'patch': '@@ -1 +0,0 @@' || chr(10) || '-x' || chr(10) || chr(92) || ' No newline at end of file', 'previous_path': NULL}},
  {{'path': 'm.c', 'status': 'modified', 'patch': '@@ -1 +1 @@ f' || chr(10) || '-x' || chr(10) || '+y' || chr(10) || ' z', 'previous_path': NULL}}, {{'path': 'img.png', 'status': 'modified', 'patch': NULL, 'previous_path': NULL}}]) AS f FROM d WHERE form = 1)
SELECT repo, number, thread_id, f.path AS path, f.status AS status, f.patch AS patch, f.previous_path AS previous_path FROM e
UNION ALL SELECT repo, number, thread_id, 'p' || k, 'modified', '@@ -1 +1 @@' || chr(10) || '-a' || chr(10) || '+b', NULL FROM d WHERE form = 0""")
def o3_split_diffs(spark, sf_dir):
    return patches.split_diff(DIFFS.df(spark, sf_dir), "diff", ["repo", "number", "thread_id"]).drop("ord")


CHECKED = Input("lineitem", {
    **KEY, "path": f"concat('src/', CASE WHEN l_partkey % 4 = 0 THEN 'gen/' ELSE '' END, {LINE}, '.py')", "language": case("l_partkey % 3", ["python", "go"]), "status": "CASE l_suppkey % 7 WHEN 0 THEN 'removed' ELSE 'modified' END",
    "patch": f"CASE WHEN l_partkey % 5 > 0 THEN {PATCH} END", "before": "CASE WHEN l_suppkey % 5 > 0 THEN CAST(l_quantity AS INT) END", "after": "CASE WHEN l_suppkey % 6 > 0 THEN CAST(l_quantity AS INT) + 20 END", "s": f"CAST({S} AS INT)", "t": f"CAST({T} AS INT)",
    "scoped": "l_partkey % 4 > 0",
})
CHECKS = [
    patches.Check("no-o", patches.REGEX, pattern="o", exclude="^put"), patches.Check("no-n", patches.REGEX, pattern="(?i)N", paths=("src/**", "!src/gen/**"), category="naming"),
    patches.Check("weak", patches.STRUCTURAL, select="^(new|more)$", pattern="e", languages=("python",), severity="important"), patches.Check("never", patches.STRUCTURAL, select=".", pattern="o"),
    patches.Check("long", patches.THRESHOLD, threshold=50, category="size"),
]


@query(f"""WITH c AS (SELECT * FROM {CHECKED.sql} WHERE status <> 'removed'), p AS (SELECT * FROM c WHERE patch IS NOT NULL), b AS (SELECT *, coalesce(before, 0) AS was FROM c)
SELECT repo, number, path, 'no-o' AS rule, 'nit' AS severity, 'style' AS category, CAST(s + 2 AS INT) AS line, '(Line ' || (s + 2) || ': `more`.)' AS detail FROM p
UNION ALL SELECT repo, number, path, 'no-n', 'nit', 'naming', CAST(s + 1 AS INT), '(Line ' || (s + 1) || ': `new` and 1 more added lines.)' FROM p WHERE scoped
UNION ALL SELECT repo, number, path, 'weak', 'important', 'style', CAST(s + 1 AS INT), '(2 added assertion lines, first at line ' || (s + 1) || '.)' FROM p WHERE language = 'python'
UNION ALL SELECT repo, number, path, 'long', 'nit', 'size', CAST(CASE WHEN patch IS NULL THEN after ELSE t + 2 END AS INT), '(' || was || ' lines before this change, ' || after || ' after.)' FROM b WHERE was < 50 AND after >= 50""")
def o14_checks(spark, sf_dir):
    return patches.run_checks(CHECKED.df(spark, sf_dir), CHECKS, ["repo", "number"])
