"""Paths: globs in scope, tests and what they are named after, steps between folders."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed patterns of test folders, test file names, and the affixes that make a test's name from its subject's.
TEST_FOLDER = r"(?i)(^|/)(tests?|__tests__|specs?|testing|testdata|unittests?|e2e)(/|$)"
TEST_FILE = r"^(test_.+|.+_tests?|.+[._-](test|spec)s?|tests?|.+Tests?)\.[^/]+$"
AFFIXES = r"^(test_)|(_tests?|[._-](test|spec)s?|Tests?)$"
#: What a glob's wildcards stand for.
WILDCARDS = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def glob_pattern(glob: str) -> str:
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    return "^" + "".join(WILDCARDS.get(part, re.escape(part)) for part in parts) + r"\z"


def in_scope(path: Column, globs: list[str]) -> Column:
    """Whether path matches one of the globs (any path if there are none) and none of those after a `!`."""
    patterns = [(glob.startswith("!"), path.rlike(glob_pattern(glob.removeprefix("!")))) for glob in globs]
    wanted, unwanted = [p for no, p in patterns if not no], [p for no, p in patterns if no]
    either = lambda found, none: reduce(Column.__or__, found) if found else F.lit(none)
    return either(wanted, True) & ~either(unwanted, False)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_test(path: Column) -> Column:
    return path.rlike(TEST_FOLDER) | file_name(path).rlike(TEST_FILE)


def stem(path: Column) -> Column:
    """The name that a test and its subject share."""
    bare = F.regexp_replace(F.substring_index(file_name(path), ".", 1), AFFIXES, "")
    return F.lower(F.regexp_replace(bare, "^_+", ""))


def folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda part: part != "")


def distance(a: Column, b: Column) -> Column:
    """Steps between the folders of two paths."""
    left, right = folders(a), folders(b)
    alike = F.zip_with(left, right, lambda x, y: x.eqNullSafe(y))
    apart = F.array_position(alike, False)
    common = F.when(apart > 0, apart - 1).otherwise(F.size(alike))
    return (F.size(left) + F.size(right) - 2 * common).cast("int")


def near_tests(changed: DataFrame, tree: DataFrame, limit: int, steps: int = 4) -> DataFrame:
    """(pr, path, subject, distance, rank): tests of the tree named after a changed file of the same pr, closest first.

    changed (pr, path), tree (pr, path). At most `limit` a pr, which is the feature; equal distances go by path.
    """
    subjects = changed.filter(~is_test(F.col("path"))).select("pr", F.col("path").alias("subject"), stem(F.col("path")).alias("_stem")).filter("_stem <> ''")
    tests = tree.filter(is_test(F.col("path"))).select("pr", "path", stem(F.col("path")).alias("_stem")).distinct().join(changed.select("pr", "path"), ["pr", "path"], "left_anti")
    pairs = tests.join(subjects.distinct(), ["pr", "_stem"]).withColumn("distance", distance(F.col("path"), F.col("subject"))).filter(F.col("distance") <= steps)
    best = pairs.groupBy("pr", "path").agg(F.min(F.struct("distance", "subject")).alias("_b")).select("pr", "path", "_b.subject", "_b.distance")
    order = Window.partitionBy("pr").orderBy("distance", "path")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
