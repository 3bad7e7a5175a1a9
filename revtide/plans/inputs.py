"""Domain tables derived from the given tables, by expressions that Spark and other SQL engines read alike."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Input:
    table: str
    columns: dict[str, str]
    where: str = "TRUE"

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{self.table}.parquet").where(self.where)
        return rows.selectExpr(*(f"{expression} AS `{name}`" for name, expression in self.columns.items()))

    @property
    def sql(self) -> str:
        columns = ", ".join(f'{expression} AS "{name}"' for name, expression in self.columns.items())
        return f"(SELECT {columns} FROM {self.table} WHERE {self.where})"


LANGUAGE = "CASE l_orderkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'go' ELSE 'rust' END"
ROUND = {
    "repo": "concat('repo', CAST(l_orderkey % 11 AS STRING))", "number": "l_orderkey",
    "round": "CAST(1 + l_linenumber % 2 AS INT)", "language": LANGUAGE,
}
FINDING_ID = (
    "concat(CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', "
    "CAST(CAST(l_quantity AS INT) AS STRING), '-', substr(CAST(l_shipdate AS STRING), 1, 10))"
)


def findings(klass: str, where: str = "TRUE") -> Input:
    return Input("lineitem", {
        **ROUND, "finding_id": FINDING_ID,
        "severity": "CASE l_returnflag WHEN 'R' THEN 'important' WHEN 'A' THEN 'nit' ELSE 'pre_existing' END",
        "klass": klass, "gold_id": f"CASE WHEN {klass} = 'tp' THEN concat('g', CAST(l_suppkey % 3 AS STRING)) END",
        "judged_severity": "CASE l_partkey % 3 WHEN 0 THEN 'important' WHEN 1 THEN 'nit' END",
        "evidence_level": "CAST(l_suppkey % 5 AS INT)", "category": "concat('cat', CAST(l_partkey % 6 AS STRING))",
        "bucket": "CASE WHEN l_linestatus = 'F' THEN 'act_on' ELSE 'consider' END",
    }, where)


FINDINGS = findings("CASE l_partkey % 4 WHEN 0 THEN 'tp' WHEN 1 THEN 'vu' ELSE 'fp' END")
CANDIDATE = findings("CASE l_partkey % 5 WHEN 0 THEN 'tp' WHEN 1 THEN 'tp' WHEN 2 THEN 'vu' ELSE 'fp' END", "l_discount < 0.09")
GOLD = Input("lineitem", {
    **ROUND, "gold_id": "concat('g', CAST(l_suppkey % 3 AS STRING))",
    "severity": "CASE l_suppkey % 3 WHEN 0 THEN 'important' WHEN 1 THEN 'nit' ELSE 'pre_existing' END",
    "conf": "CASE l_suppkey % 3 WHEN 0 THEN 1.0E0 WHEN 1 THEN 0.75E0 ELSE 0.5E0 END",
}, "l_quantity >= 10")
PRS = Input("orders", {
    "repo": "concat('repo', CAST(o_custkey % 7 AS STRING))", "number": "o_orderkey", "language": "o_orderpriority",
    "created_at": "CAST(o_orderdate AS STRING)", "author": "concat('user', CAST(o_custkey % 40 AS STRING))",
    "corpus": "CASE o_orderstatus WHEN 'O' THEN 'human' WHEN 'F' THEN 'approval_only' ELSE 'ai_feedback' END",
    "title": "concat('Fix ', CAST(o_custkey % 90 AS STRING), ' (#', CAST(o_orderkey AS STRING), ')')",
    "base_ref": "CASE o_orderkey % 3 WHEN 0 THEN 'release-1' ELSE 'main' END",
    "source": "CASE WHEN o_orderkey % 13 = 0 THEN 'benchmark' ELSE 'corpus' END",
    "size": "CAST(1 + o_custkey % 5 AS INT)", "flagged": "o_orderkey % 17 = 0",
})
THREADS = Input("lineitem", {
    "repo": "concat('repo', CAST(l_orderkey % 11 AS STRING))", "number": "l_orderkey", "thread_id": FINDING_ID,
    "path": "concat('src/f', CAST(l_partkey AS STRING), '.py')", "created_at": "CAST(l_shipdate AS STRING)",
    "anchor": "CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE concat('c', CAST(l_suppkey % 3 AS STRING)) END",
    "opener": "CASE l_suppkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'codecov-x' WHEN 2 THEN 'claude' WHEN 3 THEN 'amy' WHEN 4 THEN 'deploy-bot' WHEN 5 THEN 'coderabbitai[bot]' "
    "WHEN 6 THEN 'github-actions' WHEN 7 THEN 'Copilot-reviewer' WHEN 8 THEN 'geminifan' ELSE 'Bo' END",
    "opener_type": "CASE WHEN l_partkey % 10 = 0 THEN 'Bot' ELSE 'User' END", "pr_author": "CASE WHEN l_orderkey % 2 = 0 THEN 'amy' ELSE 'joe' END",
    "author_kind": "CASE l_suppkey % 4 WHEN 0 THEN 'ai' WHEN 1 THEN 'bot' ELSE 'human' END",
    "thumbs_down": "l_partkey % 23 = 0", "by_compare": "CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_partkey % 3 = 0 END",
    "is_outdated": "l_suppkey % 2 = 0", "resolved": "l_linenumber % 3 = 0", "replied": "l_partkey % 2 = 1",
    "applied": "l_partkey % 8 = 1", "classified": "l_suppkey % 5 > 0", "grp": "CAST(l_partkey % 2 AS INT)",
    "addressed": "CASE l_partkey % 4 WHEN 0 THEN 'addressed' WHEN 1 THEN 'partially' WHEN 2 THEN 'not_addressed' END",
    "stance": "CASE l_suppkey % 4 WHEN 0 THEN 'agree' WHEN 1 THEN 'disagree' WHEN 2 THEN 'fixed_elsewhere' END",
    "category": "CASE l_partkey % 5 WHEN 0 THEN 'security' WHEN 1 THEN 'style' END",
})
COMMENTS = Input("conversations", {
    "thread_id": "conv_id", "ord": "turn", "author": "CASE WHEN conv_id % 9 = 0 AND turn > 1 THEN NULL ELSE role END",
    "is_bot": "role = 'system'", "body": "text",
})
LEDGER = Input("events", {
    "run_id": "user_id % 20", "at": "ts", "stage": "event_type", "cached": "event_id % 3 = 0", "ok": "event_id % 11 > 0",
    "tokens": "event_id % 1000", "cost": "value", "seconds": "value / 10",
})
RATERS = Input("labels", {"item": "doc_id", "truth": "quality", "verdict": "toxic", "grp": "doc_id % 3"})
TEXTS = Input("documents", {"item": "doc_id", "text": "text", "split": "CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END"})
