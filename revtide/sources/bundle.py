"""Bundles: compressed JSON Lines, a manifest first, then records tagged by their kind; read into a table for each kind."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The newest schema that this code reads.
BUNDLE_SCHEMA = 3
PR = "repo STRING, number BIGINT"
QUOTE = "STRUCT<id: STRING, author: STRING, url: STRING, text_sha256: STRING, redacted: ARRAY<STRING>, stripped: BOOLEAN>"
ISSUE = (
    "STRUCT<id: STRING, path: STRING, start_line: INT, end_line: INT, severity: STRING, category: STRING, provenance: STRING, conf: DOUBLE, "
    "description: STRING, source_threads: ARRAY<STRING>>"
)
#: Fixed kinds of records, and the columns of each kind's table.
KINDS = {
    "pr": f"{PR}, title STRING, body STRING, author STRING, created_at STRING, landed_at STRING, base_ref STRING, head_oid STRING, language STRING, corpus STRING, "
    f"source STRING, reviewed_commit STRING, patched ARRAY<STRING>, comments ARRAY<{QUOTE}>, description {QUOTE}, "
    "threads ARRAY<STRUCT<id: STRING, path: STRING, line: INT, comments: ARRAY<STRUCT<id: STRING, author: STRING, body: STRING, created_at: STRING>>>>",
    "judgment": f"{PR}, thread_id STRING, judgment STRING, value STRING, reason STRING, category STRING, model STRING",
    "judged_labels": f"{PR}, labels ARRAY<STRUCT<thread_id: STRING, author_kind: STRING, outcome: STRING, polarity: STRING, strength: STRING>>",
    "gold": f"{PR}, reviewed_commit STRING, issues ARRAY<{ISSUE}>",
    "round_gold": f"{PR}, reviewed_commit STRING, rounds INT, issues ARRAY<{ISSUE}>",
    "escaped_defect": f"{PR}, fix BIGINT, fix_title STRING, fix_commit STRING, introduced_by STRING, issue {ISSUE}",
    "decision": "at STRING, hypothesis STRING, change STRING, before STRING, after STRING, delta STRING, gate STRING, verdict STRING",
    "policy_version": "hash STRING, created_at STRING, parent STRING, note STRING",
    "split": f"{PR}, split STRING",
    "round_diff": f"{PR}, base STRING, head STRING, status STRING, paths ARRAY<STRING>, patched ARRAY<STRING>",
    "benchmark": f"{PR}, benchmark STRING, url STRING, comments ARRAY<STRUCT<text: STRING, severity: STRING, category: STRING, path: STRING, valid: BOOLEAN>>",
    "cached_answer": "key STRING, model STRING, stage STRING, text STRING, input_tokens BIGINT, output_tokens BIGINT, cost_usd DOUBLE",
}
MANIFEST = "bundle_schema INT, created_at STRING, generator STRING, note STRING, counts MAP<STRING, BIGINT>"
#: The columns that tell a kind's records apart, and what importing one does to a stored record of the same key.
KEYS = {
    "pr": ["repo", "number"], "judgment": ["repo", "number", "thread_id", "judgment"], "judged_labels": ["repo", "number"], "gold": ["repo", "number"],
    "round_gold": ["repo", "number", "reviewed_commit"], "escaped_defect": ["repo", "number", "fix"], "decision": ["at", "hypothesis", "change", "delta", "verdict"],
    "policy_version": ["hash"], "split": ["repo", "number"], "round_diff": ["repo", "number", "head"], "benchmark": ["repo", "number", "benchmark"], "cached_answer": ["key"],
}
#: A kind that lies in more folders than this is looked for in all files.
MOST_FOLDERS = 64
#: A sign that isn't a space, as texts.stripped has them.
NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"
KEEPS = ("pr", "decision", "round_diff", "cached_answer")


class BundleError(ValueError):
    """A bundle that isn't one, or that this code must not read or write."""


def table_schema(kind: str) -> StructType:
    return StructType.fromDDL(KINDS[kind])


def write_bundle(tables: Mapping[str, DataFrame], path: str, manifest: Mapping[str, object] | None = None) -> dict[str, int]:
    """Writes tables by kind as a folder of gzip files, a folder for each kind and one for the manifest; returns the counts.

    Columns of a table that its kind doesn't have are left out, missing ones are null. Nulls aren't written. The manifest
    is written last, so a folder without one is a bundle that wasn't finished. An existing folder is an error.
    """
    unknown = sorted(set(tables) - set(KINDS))
    if unknown:
        raise BundleError(f"unknown kinds of records: {', '.join(unknown)}")
    if not tables:
        raise BundleError("a bundle needs a table")
    parts = []
    for kind, df in tables.items():
        has = {c.lower() for c in df.columns}
        columns = [(F.col(f"`{f.name}`") if f.name.lower() in has else F.lit(None)).cast(f.dataType).alias(f.name) for f in table_schema(kind)]
        parts.append(df.select(F.lit(kind).alias("folder"), F.to_json(F.struct(F.lit(kind).alias("kind"), *columns)).alias("value")))
    records = parts[0]
    for part in parts[1:]:
        records = records.unionByName(part)
    spark = records.sparkSession
    records.write.partitionBy("folder").option("compression", "gzip").text(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), "/folder=([^/]*)/[^/]*$", 1)
    found = dict(spark.read.option("recursiveFileLookup", "true").text(path).groupBy(folder).count().collect())  # a row a kind
    counts = {kind: found.get(kind, 0) for kind in tables}
    line = json.dumps({"kind": "manifest", "bundle_schema": BUNDLE_SCHEMA, **(manifest or {}), "counts": counts}, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.option("compression", "gzip").text(f"{path}/folder=!manifest")
    return counts


def read_bundle(spark: SparkSession, path: str) -> tuple[dict[str, object], dict[str, DataFrame]]:
    """The manifest, and a table for every kind, of a bundle folder or of one compressed JSON Lines file.

    Refused are: no manifest or several, one of a newer schema, lines that aren't JSON objects, unknown kinds, and counts
    that differ from the manifest's where it has any. Blank lines don't count. A kind without records is an empty table.
    """
    kind, folder = F.get_json_object("value", "$.kind"), F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    lines = spark.read.option("recursiveFileLookup", "true").text(path).filter(F.col("value").rlike(NOT_BLANK))
    by_folder = lines.groupBy(kind.alias("kind"), folder.alias("folder")).count().withColumn("_kinds", F.count("*").over(Window.partitionBy("folder")))
    told = by_folder.groupBy("kind").agg(F.sum("count").alias("count"), F.count("*").alias("folders"), (F.max("_kinds") == 1).alias("alone"), F.slice(F.collect_set("folder"), 1, MOST_FOLDERS).alias("some"))
    found = {r["kind"]: r for r in told.limit(len(KINDS) + 100).collect()}
    counts = {k: r["count"] for k, r in found.items()}
    if counts.get("manifest") != 1:
        raise BundleError(f"{path}: a bundle has one manifest, this has {counts.get('manifest', 0)}")

    def of(k: str) -> DataFrame:
        """The lines of a kind: none if none were counted, else those in the folders that hold some; a folder of one kind is taken whole."""
        if k not in found:
            return lines.filter(F.lit(False))
        if found[k]["folders"] > MOST_FOLDERS:
            return lines.filter(kind == k)
        some = lines.filter(folder.isin(found[k]["some"]))
        return some if found[k]["alone"] else some.filter(kind == k)

    head = of("manifest").select(F.from_json("value", MANIFEST).alias("m")).select("m.*").first()
    if head["bundle_schema"] is None or head["bundle_schema"] > BUNDLE_SCHEMA:
        raise BundleError(f"{path}: bundle schema {head['bundle_schema']} is newer than this code reads ({BUNDLE_SCHEMA})")
    unknown = sorted(str(k) for k in counts if k != "manifest" and k not in KINDS)
    if unknown:
        raise BundleError(f"{path}: unknown kinds of records: {', '.join(unknown)}")
    stated = head["counts"] or {}
    wrong = [f"{k}: {counts.get(k, 0)} of {n}" for k, n in sorted(stated.items()) if counts.get(k, 0) != n]
    if wrong:
        raise BundleError(f"{path}: records are missing or too many ({', '.join(wrong)})")
    tables = {k: of(k).select(F.from_json("value", table_schema(k)).alias("r")).select("r.*") for k in KINDS}
    return head.asDict(recursive=True), tables


def import_bundle(stored: Mapping[str, DataFrame], incoming: Mapping[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables after importing incoming records, and (kind, added, kept): what changed the store and what didn't.

    Stored pull requests, decisions, round diffs and cached answers stay; records of the other kinds replace those of
    their key. A split is only taken for a pull request that is stored or comes along. Of incoming records with one key
    the first in the order of all their columns counts as added and the others as kept (of kinds that replace: as added
    too, the last one stays). A policy version that is known counts as kept and is replaced all the same.
    """
    tables, reports = dict(stored), []
    empty = lambda kind: next(iter(incoming.values())).sparkSession.createDataFrame([], table_schema(kind))
    known = stored.get("pr", empty("pr")).select(*KEYS["pr"]).unionByName(incoming.get("pr", empty("pr")).select(*KEYS["pr"])).distinct()
    for kind, new in incoming.items():
        keys, old = KEYS[kind], stored.get(kind, empty(kind))
        names = [f.name for f in table_schema(kind)]
        row = F.struct(*(F.col(c) if c not in ("labels", "threads", "comments", "issues", "issue", "description") else F.to_json(c).alias(c) for c in names))
        fits = F.lit(True)
        if kind == "split":
            new, fits = new.join(known.withColumn("_known", F.lit(True)), keys, "left"), F.coalesce("_known", F.lit(False))
        usable = new.filter(fits)
        pick = (F.min_by if kind in KEEPS else F.max_by)(F.struct(*names), row)
        one = usable.groupBy(*keys).agg(pick.alias("_r"), F.count("*").alias("_n")).select("_r.*", "_n")
        held = old.select(*keys).distinct().withColumn("_held", F.lit(True))
        told = one.join(held, keys, "left")
        is_held = F.coalesce("_held", F.lit(False))
        if kind in KEEPS:
            added, fresh = F.when(is_held, 0).otherwise(1), told.filter(~is_held)
            tables[kind] = old.unionByName(fresh.select(*names))
        else:
            added = F.when(is_held, 0).otherwise(1) if kind == "policy_version" else F.col("_n")
            tables[kind] = old.join(one.select(*keys), keys, "left_anti").select(*names).unionByName(one.select(*names))
        total = new.agg(F.count("*").alias("_all"))
        sums = told.agg(F.coalesce(F.sum(added), F.lit(0)).alias("added"))
        reports.append(sums.crossJoin(F.broadcast(total)).select(F.lit(kind).alias("kind"), F.col("added").cast("long").alias("added"), (F.col("_all") - F.col("added")).cast("long").alias("kept")))
    out = reports[0]
    for report in reports[1:]:
        out = out.unionByName(report)
    return tables, out
