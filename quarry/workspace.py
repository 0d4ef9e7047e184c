"""Several repositories as one: an index file of the children, their saved graphs, and a search over all of them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.engine import Engine
from quarry.functions.text import asks_for_tests
from quarry.operators import build as B
from quarry.operators import search as S
from quarry.operators.retrieval import WEAK_BROAD, WEAK_STRONG
from quarry.plans.cuts import cut, exists

VERSION = 1


def child_name(name: str) -> str:
    """A child is one folder below the workspace."""
    if not name or name in (".", "..") or "/" in name or "\\" in name:
        raise ValueError(f"not a child's name: {name!r}")
    return name


def write_index(spark: SparkSession, path: str, children: list[str]) -> None:
    row = json.dumps({"version": VERSION, "children": sorted(map(child_name, set(children)))})
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/workspace")


def read_index(spark: SparkSession, path: str) -> list[str]:
    """The children's names; none if there is no index, or one of another version."""
    if not exists(spark, f"{path}/workspace"):
        return []
    found = json.loads(spark.read.text(f"{path}/workspace").first()[0])
    return found["children"] if found["version"] == VERSION else []


def probe(spark: SparkSession, path: str) -> DataFrame:
    """``child, nodes, edges``: sizes of the children's graphs, from the files' footers."""
    rows = []
    for child in read_index(spark, path):
        at = f"{path}/{child}/v{B.VERSION}"
        if exists(spark, f"{at}/nodes"):
            rows.append((child, spark.read.parquet(f"{at}/nodes").count(), spark.read.parquet(f"{at}/edges").count()))
    return spark.createDataFrame(rows, "child string, nodes long, edges long")


class Workspace:
    """Children by name, each an engine over its saved graph below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.children = {c: Engine.load(spark, f"{path}/{c}") for c in read_index(spark, path) if exists(spark, f"{path}/{c}/v{B.VERSION}/nodes")}

    def nodes(self) -> DataFrame:
        return self._all("nodes")

    def edges(self) -> DataFrame:
        return self._all("edges")

    def _all(self, name: str) -> DataFrame:
        out = None
        for child, engine in self.children.items():
            rows = getattr(engine.graph, name).withColumn("repo", F.lit(child))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise ValueError("the workspace has no child that was built")
        return out

    def search(self, query: str, n: int = 8, prefix: str = "") -> DataFrame:
        """``repo, id, file, score``: each child's hits (4 ``n``, 20 at least) take part if its best ones are no weak match; they are
        fused by rank over children, and children's files are answered in turn. ``prefix``: a child, and a path in it."""
        only, _, inner = prefix.strip("/").partition("/")
        if only and only not in self.children:
            raise ValueError(f"no child {only}; there are {', '.join(sorted(self.children))}")
        hits = None
        for child, engine in self.children.items():
            if only in ("", child):
                found = engine.search(query, max(4 * n, 20), inner, graph_rank=False)
                best = S.scored(engine.graph.searched(), query, asks_for_tests(query, inner)).agg(F.max("strong").alias("s"), F.max("coverage").alias("c")).first()
                if only or (best["s"] or 0) >= WEAK_STRONG or (best["c"] or 0) >= WEAK_BROAD:
                    rows = found.withColumn("scope", F.lit(child))
                    hits = rows if hits is None else hits.unionByName(rows)
        if hits is None:
            return self.spark.createDataFrame([], "repo string, id string, file string, score double")
        hits = cut(hits.withColumnRenamed("id", "own_id").withColumn("id", F.concat_ws("\x00", "scope", "own_id")), "workspace_hits")
        fused = S.reciprocal(hits.select("id", "scope", "score"))
        out = hits.drop("score").join(fused.select(F.col("id").alias("f_id"), F.col("fused").alias("score")), F.col("id") == F.col("f_id")).withColumn("place", F.concat_ws("/", "scope", "file"))
        picked = S.round_robin(out.select("id", F.col("place").alias("file"), "score"), "file", n).select(F.col("id").alias("p_id"), "pos")
        rows = out.join(picked, F.col("id") == F.col("p_id"))
        return rows.orderBy("pos", F.desc("score"), "id").select(F.col("scope").alias("repo"), F.col("own_id").alias("id"), "file", "score")
