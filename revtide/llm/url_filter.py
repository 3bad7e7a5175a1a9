"""URL filters: pattern rules indexed by their rarest literal token.

A url is judged by its host and path. Rules are patterns over host and path together, written as ad-block lists write
them: `||` at the front stands for the start of the host or of one of its labels, `|` for the start or the end, `^` for
a place that isn't inside a run of letters and digits, `*` for anything; the rest stands for itself. A literal run of
letters and digits with a boundary on either side has to occur in a url as a whole token, so each rule is filed under
the one of its tokens that the fewest different urls have, as counted over all of them. A url fetches the rules filed
under its tokens, and only those run their regular expression. A rule without such a token is tried on every url.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, free_name, salt, table


@dataclass(frozen=True)
class Rule:
    """A pattern and its verdict. Site rules (a host and a path, as `example.org/en/`) come before all others."""

    pattern: str
    verdict: str
    site: str | None = None


def site_rule(verdict: str, site: str) -> Rule:
    """A host with all its subdomains, and all paths that start with the given one."""
    return Rule(f"||{site}", verdict, site)


#: Fixed site rules of the contract.
SITES = [
    site_rule("allow", "org/"), site_rule("block", "example.org/es/"), site_rule("block", "example.org/en/1"),
    site_rule("allow", "com/fr/"), site_rule("block", "com/de/"),
]
#: What a text corpus doesn't want of any site: advertising, spam, gambling and adult hosts, forms, shops, downloads.
PATTERNS = [
    Rule(pattern, "block")
    for pattern in (
        "^ads^", "^adserver^", "^track^", "^tracker^", "^spam^", "^phishing^", "^malware^", "^casino^", "^bets^", "^pills^", "^porn^", "^adult^",
        "^xxx^", "/login^", "/signin^", "/signup^", "/wp-admin^", "/cart^", "/checkout^", "/cgi-bin/", ".exe|", ".apk|", ".zip|", ".rss|",
    )
]
RULES = SITES + PATTERNS
#: So many rules (or tokens of rules) are broadcast; more are joined, with the urls of a token dealt over SPREAD salts.
BROADCAST_RULES, SPREAD = 100_000, 16
DEFAULT = "allow"


def pieces(pattern: str) -> list[str]:
    return re.findall(r"\|\||[|^*]|[A-Za-z0-9]+|.", pattern, re.S)


def regex_of(pattern: str) -> str:
    """The Java regular expression of a pattern. No host has a slash, so `||` never reaches into the path."""
    signs = {"||": r"^(?:[^/]*\.)?", "^": "(?:(?<![A-Za-z0-9])|(?![A-Za-z0-9]))", "*": ".*"}
    parts = [("^" if i == 0 else r"\z") if part == "|" else signs.get(part) or re.escape(part) for i, part in enumerate(pieces(pattern))]
    return "(?s)" + "".join(parts)


def tokens_of(pattern: str) -> list[str]:
    """The tokens, in lower case, that every url has which the pattern fits."""
    parts = ["*", *pieces(pattern), "*"]
    inner = zip(parts, parts[1:], parts[2:])
    return [part.lower() for before, part, after in inner if part.isascii() and part.isalnum() and "*" not in (before, after)]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path (up to ?, # or the end); empty without a ://."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def tokens(place: Column) -> Column:
    """The distinct tokens of a host and path; the empty token, which all have, leads to rules without a token."""
    return F.array_distinct(F.concat(F.split(F.lower(place), "[^a-z0-9]+"), F.array(F.lit(""))))


def by_token(places: DataFrame, filed: DataFrame, size: int) -> DataFrame:
    """places (_place, token) with what is filed under their tokens; `filed` has `size` rows."""
    if size <= BROADCAST_RULES:
        return places.join(F.broadcast(filed), "token")
    every = filed.withColumn("_spread", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return places.withColumn("_spread", salt("_place", salts=SPREAD)).join(every, ["token", "_spread"]).drop("_spread")


def rule_index(places: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(token, regex, site, verdict, site_first, length, pattern) of every rule, filed under its rarest token.

    The counts cover all places (_place, one row each) and come back as one row per token of a rule.
    """
    spark = places.sparkSession
    literal = sorted({t for r in rules for t in tokens_of(r.pattern)})
    wanted = spark.createDataFrame([(t,) for t in literal], "token string")
    found = by_token(places.withColumn("token", F.explode(tokens(F.col("_place")))), wanted, len(literal))
    counts = dict(found.groupBy("token").count().collect())
    rows = []
    for r in rules:
        own = sorted(tokens_of(r.pattern), key=lambda t: (counts.get(t, 0), t))
        rows.append(((own or [""])[0], regex_of(r.pattern), r.site, r.verdict, r.site is not None, len(r.pattern), r.pattern))
    return spark.createDataFrame(rows, "token string, regex string, site string, verdict string, site_first boolean, length int, pattern string")


def judge(
    urls: DataFrame, rules: Sequence[Rule] = tuple(RULES), url_col: str = "url", default: str = DEFAULT, columns: list[str] | None = None
) -> DataFrame:
    """The columns (all, if not given) of urls with host, path, rule, verdict and pattern.

    Of the rules that fit, a site rule comes first, then the longest pattern, then block, then the smaller pattern. rule
    is the site of a site rule and else null; pattern is that of the winning rule. If none fits, the verdict is the
    default and pattern null. A null url and one without :// have an empty host and path; such rows are judged alike.
    Query and fragment aren't looked at. Rows with equal urls are each kept; they count once in the index. An empty table
    or rule list is fine. Columns of urls named like the five are replaced; other names are free.

    Each host and path is judged once. Rows of one url, however many, spread over salts.
    """
    new = ("host", "path", "rule", "verdict", "pattern")
    columns = [c for c in columns or urls.columns if c.lower() not in new]
    host, path = host_and_path(F.col(f"`{url_col}`"))
    row = F.struct(*(F.col(f"`{c}`") for c in columns), F.col(f"`{url_col}`").alias(free_name(urls, "_url")))
    rows = urls.select(row.alias("_row"), host.alias("host"), path.alias("path"))
    rows = rows.select("*", F.concat("host", "path").alias("_place"), salt("_row").alias("_salt"))
    places = rows.select("_place").distinct()
    fetched = by_token(places.withColumn("token", F.explode(tokens(F.col("_place")))), rule_index(places, rules), len(rules))
    order = F.struct("site_first", "length", F.col("verdict") == "block", "pattern", "verdict", "site")
    best = fetched.filter("rlike(_place, regex)").groupBy("_place").agg(F.max(order).alias("_best"))
    spread = rows.select("_place", "_salt").distinct().join(best, "_place", "left")
    won = F.col("_best")
    found = (won["site"].alias("rule"), F.coalesce(won["verdict"], F.lit(default)).alias("verdict"), won["pattern"].alias("pattern"))
    return rows.join(spread, ["_place", "_salt"]).select(*(F.col(f"_row.`{c}`") for c in columns), "host", "path", *found)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), columns=["page_id"]).drop("pattern")


SQL = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
s AS (SELECT *, host = 'org' OR ends_with(host, '.org') AS org, host = 'com' OR ends_with(host, '.com') AS com,
  host = 'example.org' OR ends_with(host, '.example.org') AS own FROM u),
r AS (SELECT page_id, host, path, CASE WHEN own AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN own AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN com AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN com AND starts_with(path, '/de/') THEN 'com/de/' WHEN org AND starts_with(path, '/') THEN 'org/' END AS rule FROM s)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host || path, '(^|[^A-Za-z0-9])(ads|adserver|track|tracker|spam|phishing|malware|casino|bets|pills|porn|adult|xxx)([^A-Za-z0-9]|$)')
    OR regexp_matches(host || path, '/(login|signin|signup|wp-admin|cart|checkout)([^A-Za-z0-9]|$)') OR contains(host || path, '/cgi-bin/')
    OR regexp_matches(host || path, '\.(exe|apk|zip|rss)$') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
