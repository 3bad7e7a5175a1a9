"""What a replayed review round may see, and facts of pull requests and threads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import author_kind

PR = ["repo", "number"]
#: Fixed patterns of bot status lines, HTML comments and runs of blank lines.
STATUS = r"(?im)^[ \t>]*(?:✅|☑️|✔️)[ \t]*(?:\*\*)?(?:resolved|addressed|confirmed as addressed|fixed)\b[^\n]*(?:\n|\z)"
HTML_COMMENT = r"(?s)<!--.*?-->"
BLANK_RUNS = r"\n[ \t]*\n(?:[ \t]*\n)+"


def earlier_threads(rounds: DataFrame, threads: DataFrame, comments: DataFrame) -> DataFrame:
    """(repo, number, round, thread_id, path, shown) of the threads opened before a round, bots' threads left out.

    shown counts the thread's comments (repo, number, thread_id, at) made before the round. A round without a time
    sees nothing.
    """
    starts = rounds.filter("started_at <> ''").select(*PR, "round", "started_at")
    opened = threads.filter(author_kind(F.col("opener"), F.col("opener_type")) != "bot").select(*PR, "thread_id", "path", "created_at").distinct()
    seen = starts.join(opened, PR).filter("created_at < started_at").drop("created_at")
    made = comments.groupBy(*PR, "thread_id", "at").agg(F.count("*").alias("_n"))
    shown = F.sum(F.when(F.col("at") < F.col("started_at"), F.col("_n")).otherwise(0)).alias("shown")
    return seen.join(made, [*PR, "thread_id"], "left").groupBy(*PR, "round", "thread_id", "path").agg(shown)


def pr_facts(prs: DataFrame, threads: DataFrame, keys: list[str]) -> DataFrame:
    """prs with their number of threads."""
    counts = threads.groupBy(*keys).agg(F.count("*").alias("threads"))
    return prs.join(counts, keys, "left").fillna(0, ["threads"])


def thread_facts(threads: DataFrame, prs: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """threads with columns of their pull request."""
    return threads.join(prs.select(*keys, *columns), keys)


def blind_comment(text: Column) -> Column:
    """text without bot status lines and HTML comments; unchanged if it has neither."""
    out = F.regexp_replace(F.regexp_replace(text, STATUS, ""), HTML_COMMENT, "")
    space = re.escape(" \t\n\r\f\v")
    tidy = F.regexp_replace(F.regexp_replace(out, BLANK_RUNS, "\n\n"), rf"\A[{space}]+|[{space}]+\z", "")
    return F.when(out == text, text).otherwise(tidy)


def slices(first: Column, last: Column, day: Column, n: int) -> Column:
    """Which of n consecutive slices of the dates from first to last holds day, from 0; null outside.

    Slice i begins floor(i * days / n) days after first; there are never more slices than days.
    """
    days, at = F.datediff(last, first) + 1, F.datediff(day, first)
    return F.when((at >= 0) & (at < days), F.floor(((at + 1) * F.least(F.lit(n), days) - 1) / days))
