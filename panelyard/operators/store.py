"""A store of papers, hypotheses, factors and proposals as append-only tables.

Inserts that must not repeat are anti-joins on the key, appended in one write; every proposal is kept, also of a
factor that is known already. Keys are content hashes, so appending twice changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions import grammar
from panelyard.operators import originality, scan

TABLES = {
    "papers": "key string, title string, url string, citation string, source string",
    "hypotheses": "id string, paper_key string, kind string, statement string, model string, prompt_version string",
    "factors": "id string, expression string, structural_key string, nodes int, parameters int, fields array<string>, created_at bigint",
    "proposals": "id string, factor_id string, hypothesis_id string, parent_factor_id string, edge_type string, expression string, status string, reason string, rationale string, zoo_similarity int, nearest string",
    "usage": "paper_key string, model string, calls bigint, input_tokens bigint, output_tokens bigint",
}


class Store:
    """The tables under one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        schema = TABLES[name]
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def append(self, name: str, rows: Sequence[dict], *, once: str | None = None) -> int:
        """Rows appended: all, or with ``once`` those whose key isn't there yet."""
        names = self.spark.createDataFrame([], TABLES[name]).columns
        df = self.spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], TABLES[name])
        if once:
            df = df.dropDuplicates([once]).join(self.table(name).select(once), once, "left_anti").select(*names)
        n = df.count()
        if n:
            df.write.mode("append").parquet(f"{self.path}/{name}")
        return n

    def add_hypothesis(self, paper_key: str, kind: str, statement: str, *, model: str = "", prompt_version: str = "") -> str:
        ident = hashlib.sha256(json.dumps([paper_key, kind, statement]).encode()).hexdigest()[:16]
        self.append("hypotheses", [{"id": ident, "paper_key": paper_key, "kind": kind, "statement": statement, "model": model, "prompt_version": prompt_version}], once="id")
        return ident

    def add_factor(self, expression: str, hypothesis_id: str, *, parent: str | None = None, edge: str = "proposed", rationale: str = "", zoo: tuple[int, str] = (0, "")) -> tuple[str, bool]:
        """(id, whether it was new); the proposal is kept in either case."""
        e = grammar.parse(expression)
        ident = grammar.factor_id(e)
        order = time.time_ns()
        fresh = self.append("factors", [{"id": ident, "expression": str(e), "structural_key": grammar.structural_key(e), "nodes": e.nodes, "parameters": e.parameters, "fields": sorted(e.fields), "created_at": order}], once="id")
        self._propose(ident, hypothesis_id, expression, "accepted" if fresh else "duplicate", "", parent, edge, rationale, zoo)
        return ident, bool(fresh)

    def reject(self, hypothesis_id: str, expression: str, reason: str, *, parent: str | None = None, edge: str = "proposed", rationale: str = "", zoo: tuple[int, str] = (0, "")) -> None:
        self._propose(None, hypothesis_id, expression, "rejected", reason, parent, edge, rationale, zoo)

    def _propose(self, factor_id, hypothesis_id, expression, status, reason, parent, edge, rationale, zoo) -> None:
        ident = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        self.append("proposals", [{"id": ident, "factor_id": factor_id, "hypothesis_id": hypothesis_id, "parent_factor_id": parent, "edge_type": edge, "expression": expression, "status": status, "reason": reason, "rationale": rationale, "zoo_similarity": zoo[0], "nearest": zoo[1]}])

    def lineage(self, factor_id: str) -> DataFrame:
        """Where a factor came from: its proposals with their hypotheses and papers, in order."""
        p = self.table("proposals").where(F.col("factor_id") == factor_id).withColumnRenamed("id", "proposal_id")
        h = self.table("hypotheses").select(F.col("id").alias("hypothesis_id"), "paper_key", "kind", "statement")
        return p.join(h, "hypothesis_id").join(self.table("papers").withColumnRenamed("key", "paper_key"), "paper_key").orderBy("proposal_id")

    def formulas(self) -> DataFrame:
        """The stored factors as parsed formulas with their ids as owners, in the order in which they came."""
        rows = self.table("factors").select(F.col("created_at").alias("pos"), "expression", F.col("id").alias("owner"))
        return originality.parsed(rows).join(rows.select("pos", "owner"), "pos")

    def nearest(self, expression: str) -> DataFrame:
        """(id, nodes): the stored factors by the largest subtree shape they share with an expression, most first."""
        mine = self.spark.createDataFrame(list(grammar.shapes(grammar.parse(expression)).items()), "shape string, nodes int")
        met = originality.subtree_index(self.formulas()).join(F.broadcast(mine), "shape")
        return met.groupBy(F.col("owner").alias("id")).agg(F.max("nodes").alias("nodes")).orderBy(F.desc("nodes"), "id")

    def propose(self, expressions: Sequence[str], hypothesis_id: str, *, limits: originality.Limits | None = None, zoo: list[tuple[str, str]] | None = None) -> DataFrame:
        """Judge formulas against the zoo and the store and keep every outcome: new factors, and a proposal for each."""
        rows = self.spark.createDataFrame(list(enumerate(expressions)), "pos bigint, expression string")
        judged = scan.kept(originality.judge(rows, originality.zoo_index(self.spark, zoo), self.formulas(), limits))
        for r in judged.orderBy("pos").collect():
            near = (r["zoo_nodes"] or 0, r["nearest_zoo"])
            if r["status"] in ("stored", "duplicate"):
                self.add_factor(r["expression"], hypothesis_id, zoo=near)
            else:
                self.reject(hypothesis_id, r["expression"], r["reason"], zoo=near)
        return judged

    def stats(self) -> DataFrame:
        """(what, group, n): proposals by status and hypotheses by kind."""
        a = self.table("proposals").groupBy(F.col("status").alias("group")).count().select(F.lit("proposals").alias("what"), "group", F.col("count").alias("n"))
        b = self.table("hypotheses").groupBy(F.col("kind").alias("group")).count().select(F.lit("hypotheses").alias("what"), "group", F.col("count").alias("n"))
        return a.unionByName(b).orderBy("what", "group")
