"""Prose of review comments and lessons: writing rules, and what a proposed lesson has to meet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import stripped
from .diffs import hunk_lines

#: Fixed patterns of each writing rule.
RULES = {
    "hedging": r"(?i)\b(might|may potentially|could potentially|possibly|perhaps|maybe|it seems|seems to|arguably|somewhat|I think|I believe|probably)\b",
    "filler": r"(?i)\b(in order to|it is (important|worth) (to note|noting)|note that|basically|simply|just to|due to the fact that|at the end of the day)\b",
    "praise": r"(?i)\b(great (job|work|catch)|nice (work|job|catch)|well done|looks good|good job|thanks for|thank you|kudos|awesome|excellent)\b",
    "chatbot": r"(?i)\b(I hope this helps|let me know|feel free|happy to help|certainly|of course|as an AI|I'd be happy)\b",
    "ai_vocabulary": (
        r"(?i)\b(delve|crucial|pivotal|leverag(e|es|ed|ing)|utiliz(e|es|ed|ing)|seamless(ly)?|robust(ness)?|comprehensive|showcas(e|es|ing)|underscor(e|es|ing)|"
        r"tapestry|testament|intricate|enhance[sd]?|facilitat(e|es|ing))\b"
    ),
    "em_dash": "—|–| -- ",
    "passive_voice": (
        r"(?i)\b(is|are|was|were|be|been|being)\s+(\w+ly\s+)?(\w{3,}ed|thrown|written|taken|given|done|made|shown|known|seen|broken|hidden)\b(?!\s+(to|by the time))"
    ),
}
TITLE_RULES = {"title_period": r"\.\s*\z", "title_sentences": r"[.!?]\s+[A-Z]"}
#: Fixed participles that are adjectives.
ADJECTIVES = "needed required expected supported allowed intended used based related unused unrelated unexpected undefined unhandled unchecked".split()
CODE = r"(?s)```.*?```|`[^`]*`"
#: The group of a passive's participle.
PARTICIPLE = 3


def named_by(rule: str):
    return lambda hit: F.struct(F.lit(rule).alias("rule"), hit.alias("excerpt"))


def violations(text: Column, title: bool = False) -> Column:
    """array of struct(rule, excerpt): each place where a text breaks a writing rule, by rule; code in backticks aside."""
    prose = F.regexp_replace(F.coalesce(text, F.lit("")), CODE, "`code`")
    found = []
    for rule, pattern in RULES.items():
        hits = F.regexp_extract_all(prose, F.lit(f"(?U){pattern}"), F.lit(0))
        named = F.transform(hits, named_by(rule))
        if rule == "passive_voice":
            words = F.regexp_extract_all(prose, F.lit(f"(?U){pattern}"), F.lit(PARTICIPLE))
            kept = F.filter(F.arrays_zip(named.alias("hit"), words.alias("word")), lambda x: ~F.lower(x["word"]).isin(ADJECTIVES))
            named = F.transform(kept, lambda x: x["hit"])
        found.append(named)
    for rule, pattern in TITLE_RULES.items() if title else ():
        one = F.array(F.struct(F.lit(rule).alias("rule"), F.right(stripped(F.coalesce(text, F.lit(""))), F.lit(40)).alias("excerpt")))
        found.append(F.when(prose.rlike(f"(?U){pattern}"), one).otherwise(F.slice(one, 1, 0)))
    return F.concat(*found)


def lint(findings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, part, ord, rule, excerpt) of the posted findings (keys, title, body, posted): a row a violation, title first."""
    posted = findings.filter("posted")
    parts = F.array(
        F.struct(F.lit("title").alias("part"), violations(F.col("title"), True).alias("found")), F.struct(F.lit("body").alias("part"), violations(F.col("body")).alias("found"))
    )
    rows = posted.select(*keys, F.explode(parts).alias("p"))
    return rows.select(*keys, "p.part", F.posexplode("p.found").alias("ord", "v")).select(*keys, "part", "ord", "v.rule", "v.excerpt")


def lint_counts(violated: DataFrame) -> DataFrame:
    return violated.groupBy("rule").agg(F.count("*").alias("violations"))


def headlines(commits: DataFrame, rounds: DataFrame) -> DataFrame:
    """(repo, number, round, ord, headline): what a reviewer of a round could read of the pull request's commits.

    commits (repo, number, ord, oid, committed_at, headline), rounds (repo, number, round, commit, started_at): those up to
    the round's commit, if it is one of them (its first place); else those committed by the round's start; else none.
    Commits without a headline are left out.
    """
    pr = ["repo", "number"]
    place = commits.groupBy(*pr, F.col("oid").alias("commit")).agg(F.min("ord").alias("_last"))
    known = rounds.join(place, [*pr, "commit"], "left")
    upto = F.when(F.col("_last").isNotNull(), F.col("ord") <= F.col("_last")).otherwise(F.col("committed_at") <= F.col("started_at"))
    return commits.join(known.drop("commit"), pr).filter(upto & (F.col("headline") != "")).select(*pr, "round", "ord", "headline")


#: Fixed patterns of a cited pull request and of what makes a lesson's text short-lived.
CITED = r"(?U)\b([\w.-]+/[\w.-]+)#([0-9]+)\b"
SHORT_LIVED = {
    "a commit hash": r"\b(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{7,40}\b", "a version number": r"\bv?[0-9]+\.[0-9]+(?:\.[0-9]+)+\b|\bv[0-9]+\.[0-9]+\b",
    "a file path": r"(?U)(?<![\w*])(?:[\w.-]+/)+[\w-]+\.\w{1,6}\b",
}


@dataclass(frozen=True)
class LessonRules:
    min_prs: int = 3
    min_authors: int = 2
    covered: float = 0.5


def cited(lessons: DataFrame) -> DataFrame:
    """(lesson, repo, number), distinct: the pull requests that lessons (lesson, evidence) name."""
    said = lessons.select("lesson", F.explode("evidence").alias("_e"))
    each = said.select("lesson", F.explode(F.regexp_extract_all("_e", F.lit(CITED), F.lit(0))).alias("_c"))
    return each.select("lesson", F.regexp_extract("_c", CITED, 1).alias("repo"), F.regexp_extract("_c", CITED, 2).try_cast("long").alias("number")).distinct()


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{3,}"), F.lit(0)))


def lesson_problems(lessons: DataFrame, feed: DataFrame, files: DataFrame, known: DataFrame, rules: LessonRules) -> DataFrame:
    """(lesson, problem): why a proposed lesson isn't accepted; none for those that are.

    lessons (lesson, kind: prompt or check, change: add or change, text, applies_when, why_not_check, evidence, engine, pattern,
    exclude, select, paths), feed (repo, number, author), files (repo, number, path, patch) of the feed, known (lesson, text):
    the lessons in use, which are few. A flag check by regex or structure has to match an added line, in its paths, of a pull
    request that it cites; other checks are left to the evaluation.
    """
    cites = cited(lessons)
    inside = cites.join(feed, ["repo", "number"])
    evidence = inside.groupBy("lesson").agg(F.count_distinct("repo", "number").alias("_prs"), F.count_distinct("author").alias("_authors"))
    outside = cites.join(feed.select("repo", "number"), ["repo", "number"], "left_anti").groupBy("lesson").agg(F.count("*").alias("_outside"))
    added = lessons.filter("change = 'add'").select("lesson", F.explode(words(F.col("text"))).alias("_w"), F.size(words(F.col("text"))).alias("_n"))
    others = known.select(F.col("lesson").alias("_other"), F.explode(words(F.col("text"))).alias("_w"), F.size(words(F.col("text"))).alias("_m"))
    shared = added.join(others, "_w").groupBy("lesson", "_other", "_n", "_m").agg(F.count("*").alias("_s"))
    score = F.col("_s") / (F.col("_n") + F.col("_m") - F.col("_s"))
    close = shared.withColumn("_score", score).filter(F.col("_score") >= rules.covered).groupBy("lesson").agg(F.max(F.struct("_score", "_other"))["_other"].alias("_near"))
    flags = lessons.filter("kind = 'check' AND engine IN ('added_lines_regex', 'structural_pattern')").select("lesson", "pattern", "exclude", "select", "paths")
    patched = files.join(inside.select("repo", "number").distinct(), ["repo", "number"], "left_semi").withColumn("_h", hunk_lines("patch"))
    texts = F.transform(F.filter(F.flatten(F.transform("_h", lambda h: h["lines"])), lambda x: x["tag"] == "+"), lambda x: x["text"])
    lines = patched.select("repo", "number", "path", F.explode(texts).alias("_line")).join(inside, ["repo", "number"]).join(flags, "lesson")
    told = F.rlike("_line", F.col("pattern")) & ~F.coalesce(F.rlike("_line", F.nullif("exclude", F.lit(""))), F.lit(False)) & F.coalesce(F.rlike("_line", F.nullif("select", F.lit(""))), F.lit(True))
    fires = lines.filter(told & scoped(F.col("path"), F.col("paths"))).select("lesson").distinct().withColumn("_fires", F.lit(True))
    rows = lessons.join(evidence, "lesson", "left").join(outside, "lesson", "left").join(close, "lesson", "left").join(fires, "lesson", "left")
    prs, authors = F.coalesce("_prs", F.lit(0)), F.coalesce("_authors", F.lit(0))
    checked = (F.col("kind") == "check") & F.col("engine").isin("added_lines_regex", "structural_pattern")
    empty = lambda c: stripped(F.coalesce(c, F.lit(""))) == ""
    prompt = F.col("kind") == "prompt"
    problems = [
        *(F.when(F.col("text").rlike(p), F.concat(F.lit(f"not durable: names {what} ("), F.regexp_extract("text", p, 0), F.lit(")"))) for what, p in SHORT_LIVED.items()),
        F.when(prompt & empty("applies_when"), "not specific: it does not say when it applies"),
        F.when(F.col("_outside") > 0, F.concat(F.lit("cites pull requests outside the feed: "), "_outside")),
        F.when((prs < rules.min_prs) | (authors < rules.min_authors), F.concat(F.lit("evidence of "), prs, F.lit(" pull requests by "), authors, F.lit(" authors"))),
        F.when(F.col("_near").isNotNull(), F.concat(F.lit("already covered by "), "_near")), F.when(prompt & (F.col("change") == "add") & empty("why_not_check"), "does not say why no check can express it"),
        F.when(checked & (prs > 0) & F.col("_fires").isNull(), "the check fires on none of the pull requests it cites"),
    ]
    return rows.select("lesson", F.explode(F.filter(F.array(*problems), lambda p: p.isNotNull())).alias("problem"))


def scoped(path: Column, globs: Column) -> Column:
    """Whether a path is in the scope of an array of globs; those of a row, not of all rows as in paths.in_scope."""
    one = lambda g: F.rlike(path, F.concat(F.lit("^"), glob_regex(F.regexp_replace(g, "^!", "")), F.lit(r"\z")))
    wanted, unwanted = F.filter(globs, lambda g: ~g.startswith("!")), F.filter(globs, lambda g: g.startswith("!"))
    none = F.coalesce(F.size(wanted), F.lit(0)) <= 0
    return (none | F.coalesce(F.exists(wanted, one), F.lit(False))) & ~F.coalesce(F.exists(unwanted, one), F.lit(False))


def glob_regex(glob: Column) -> Column:
    """The regular expression of a column of globs."""
    quoted = F.regexp_replace(glob, r"([.\\+^$()\[\]{}|])", r"\\$1")
    marked = F.replace(F.replace(F.replace(quoted, F.lit("**/"), F.lit("\x01")), F.lit("**"), F.lit("\x02")), F.lit("*"), F.lit("[^/]*"))
    return F.replace(F.replace(F.replace(marked, F.lit("?"), F.lit("[^/]")), F.lit("\x01"), F.lit("(?:.*/)?")), F.lit("\x02"), F.lit(".*"))
