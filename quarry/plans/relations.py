"""The six base relations, derived from the given tables, as DataFrames and, for comparison, as SQL.

The tables hold no source code, so the property graph is one of regions, nations, customers, suppliers, parts and orders
whose paths are directories; the search corpus is ``documents``; change history is ``events``; and the two states that
drift and checks compare are the documents before and after cleaning by their labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import search as S
from quarry.plans.cuts import exists, new_path

_INDEXES: dict[tuple[str, str], str] = {}


class Relations:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def places(self) -> DataFrame:
        n, r = self.table("nation"), self.table("region")
        # 25 nations and 5 regions at any scale
        return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_regionkey", "r_name", F.concat_ws("/", "r_name", "n_name").alias("place"))

    def nodes(self) -> DataFrame:
        """``id, name, kind, path, start_line``."""
        row = lambda df, *c: df.select(*[x.alias(n) for x, n in zip(c, ("id", "name", "kind", "path"))])
        mark = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
        p = F.broadcast(self.places())
        parts = [
            row(self.table("region"), mark("r", "r_regionkey"), F.col("r_name"), F.lit("module"), F.col("r_name")),
            row(self.places(), mark("n", "n_nationkey"), F.col("n_name"), F.lit("module"), F.col("place")),
            row(self.table("customer").join(p, F.col("c_nationkey") == F.col("n_nationkey")), mark("c", "c_custkey"), F.col("c_name"), F.lit("class"), F.concat_ws("/", "place", "c_mktsegment")),
            row(self.table("supplier").join(p, F.col("s_nationkey") == F.col("n_nationkey")), mark("s", "s_suppkey"), F.col("s_name"), F.lit("interface"), F.concat_ws("/", "place", F.lit("suppliers"))),
            row(self.table("part"), mark("p", "p_partkey"), F.col("p_name"), F.lit("function"), F.concat_ws("/", F.lit("parts"), "p_brand")),
            row(self.table("orders"), mark("o", "o_orderkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.lit("method"), F.concat_ws("/", F.lit("orders"), "o_orderpriority")),
        ]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def edges(self) -> DataFrame:
        """``source, target, relation, line, ord``; a multigraph, ``ord`` is the stored order."""
        mark = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
        li = self.table("lineitem")
        order = F.col("l_orderkey") * 8 + F.col("l_linenumber")
        line = F.col("l_linenumber").cast("long")
        row = lambda df, s, t, rel, ln, o: df.select(s.alias("source"), t.alias("target"), F.lit(rel).alias("relation"), ln.cast("long").alias("line"), o.cast("long").alias("ord"))
        zero = F.lit(0)
        return (
            row(self.table("nation"), mark("r", "n_regionkey"), mark("n", "n_nationkey"), "contains", zero, F.col("n_nationkey"))
            .unionByName(row(self.table("customer"), mark("n", "c_nationkey"), mark("c", "c_custkey"), "contains", zero, F.col("c_custkey")))
            .unionByName(row(self.table("supplier"), mark("n", "s_nationkey"), mark("s", "s_suppkey"), "contains", zero, F.col("s_suppkey")))
            .unionByName(row(li, mark("s", "l_suppkey"), mark("p", "l_partkey"), "calls", line, order))
            .unionByName(row(li, mark("p", "l_partkey"), mark("o", "l_orderkey"), "calls", line, order))
            .unionByName(row(self.table("orders"), mark("o", "o_orderkey"), mark("c", "o_custkey"), "references", zero, F.col("o_orderkey")))
        )

    def trade(self) -> DataFrame:
        """``source, target, n``: nation -> nation, for pairs that trade over a tenth more than the supplier's mean."""
        li, o = self.table("lineitem"), self.table("orders")
        s, c = self.table("supplier"), self.table("customer")
        pairs = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
        pairs = pairs.groupBy(F.col("s_nationkey").alias("source"), F.col("c_nationkey").alias("target")).agg(F.count(F.lit(1)).alias("n"))
        total = Window.partitionBy("source")  # 25 rows each
        return pairs.withColumn("all_n", F.sum("n").over(total)).withColumn("k", F.count(F.lit(1)).over(total)).filter(F.col("n") * F.col("k") * 10 > F.col("all_n") * 11).select(F.concat(F.lit("n"), F.col("source")).alias("source"), F.concat(F.lit("n"), F.col("target")).alias("target"), "n")

    def follows(self) -> DataFrame:
        """``source, target``: from each customer to those whose orders come right after its first, its last and its dearest
        one. It grows with the tables, and has cycles."""
        o = self.table("orders")
        own = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"), F.max(F.struct("o_totalprice", "o_orderkey"))["o_orderkey"].alias("c"))
        asked = own.select("o_custkey", F.explode(F.array(*[F.col(c) + 1 for c in "abc"])).alias("next"))
        after = o.select(F.col("o_orderkey").alias("next"), F.col("o_custkey").alias("then"))
        mark = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
        return asked.join(after, "next").select(mark("o_custkey").alias("source"), mark("then").alias("target")).distinct()

    def docs(self) -> DataFrame:
        """``id, name, path, body, scope, file, copy``: the search corpus; labelled toxic documents play the copies."""
        toxic = self.table("labels").groupBy("doc_id").agg((F.max("toxic") == 1).alias("copy")).filter("copy").withColumnRenamed("doc_id", "t_id")
        d = self.table("documents")
        return d.join(toxic, d.doc_id == F.col("t_id"), "left").select(
            F.col("doc_id").alias("id"), F.col("source").alias("name"), F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"),
            F.col("text").alias("body"), F.col("lang").alias("scope"), F.col("source").alias("file"), F.coalesce("copy", F.lit(False)).alias("copy"),
        )

    def index(self) -> S.Index:
        """The search index of ``docs``, written once for an application and table folder, then read."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if not exists(self.spark, _INDEXES.get(key)):
            _INDEXES[key] = new_path(self.spark, "index")
            S.write_index(self.docs(), _INDEXES[key])
        return S.read_index(self.spark, _INDEXES[key])

    def lines(self) -> DataFrame:
        """``id, file, line, text``: one row a line, numbered from 1."""
        return self.docs().select("id", "file", F.posexplode(F.split("body", "\n")).alias("n", "text")).select("id", "file", (F.col("n") + 1).cast("long").alias("line"), "text")

    def commits(self) -> DataFrame:
        """``hash, person, at_ms, path``: events as history."""
        return self.table("events").select(F.col("event_id").alias("hash"), F.col("user_id").alias("person"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.col("event_type").alias("path"))

    def before(self) -> DataFrame:
        """``path, body_hash, size``: documents as they are."""
        return self.table("documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("body_hash"), F.octet_length("text").cast("long").alias("size"))

    def after(self) -> DataFrame:
        """The same after cleaning: poor documents are gone, toxic ones rewritten, benchmark items added."""
        lab = self.table("labels").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).withColumnRenamed("doc_id", "l_id")
        d = self.table("documents").join(lab, F.col("doc_id") == F.col("l_id"), "left").filter("coalesce(q, 1) = 1")
        text = F.when(F.col("t") == 1, F.upper("text")).otherwise(F.col("text"))
        kept = d.select(F.col("doc_id").alias("path"), text.alias("text"))
        new = self.table("benchmark").select((-1 - F.col("item_id")).alias("path"), "text")
        return kept.unionByName(new).select("path", F.sha2("text", 256).alias("body_hash"), F.octet_length("text").cast("long").alias("size"))


SQL = {
    "places": "SELECT n_nationkey, n_name, r_regionkey, r_name, r_name || '/' || n_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey",
    "nodes": """
      SELECT 'r' || r_regionkey AS id, r_name AS name, 'module' AS kind, r_name AS path FROM region
      UNION ALL SELECT 'n' || n_nationkey, n_name, 'module', place FROM places
      UNION ALL SELECT 'c' || c_custkey, c_name, 'class', place || '/' || c_mktsegment FROM customer JOIN places ON c_nationkey = n_nationkey
      UNION ALL SELECT 's' || s_suppkey, s_name, 'interface', place || '/suppliers' FROM supplier JOIN places ON s_nationkey = n_nationkey
      UNION ALL SELECT 'p' || p_partkey, p_name, 'function', 'parts/' || p_brand FROM part
      UNION ALL SELECT 'o' || o_orderkey, 'order ' || o_orderkey, 'method', 'orders/' || o_orderpriority FROM orders""",
    "edges": """
      SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target, 'contains' AS relation, 0::BIGINT AS line, n_nationkey::BIGINT AS ord FROM nation
      UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'contains', 0, c_custkey FROM customer
      UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'contains', 0, s_suppkey FROM supplier
      UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey, 'calls', l_linenumber, l_orderkey * 8 + l_linenumber FROM lineitem
      UNION ALL SELECT 'p' || l_partkey, 'o' || l_orderkey, 'calls', l_linenumber, l_orderkey * 8 + l_linenumber FROM lineitem
      UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'references', 0, o_orderkey FROM orders""",
    "trade": """
      SELECT 'n' || source AS source, 'n' || target AS target, n FROM (
        SELECT *, sum(n) OVER (PARTITION BY source) AS all_n, count(*) OVER (PARTITION BY source) AS k FROM (
          SELECT s_nationkey AS source, c_nationkey AS target, count(*) AS n
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL))
      WHERE n * k * 10 > all_n * 11""",
    "follows": """
      SELECT DISTINCT 'c' || k AS source, 'c' || o_custkey AS target FROM (
        SELECT o_custkey AS k, unnest([min(o_orderkey), max(o_orderkey), arg_max(o_orderkey, struct_pack(p := o_totalprice, k := o_orderkey))]) + 1 AS next FROM orders GROUP BY o_custkey) JOIN orders ON o_orderkey = next""",
    "docs": """
      SELECT d.doc_id AS id, source AS name, concat_ws('/', lang, source, d.doc_id::VARCHAR) AS path, text AS body, lang AS scope, source AS file,
             EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AS copy FROM documents d""",
    "lines": "SELECT id, file, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS line, unnest(string_split(body, chr(10))) AS text FROM docs",
    "commits": "SELECT event_id AS hash, user_id AS person, epoch_us(ts) // 1000 AS at_ms, event_type AS path FROM events",
    "before": "SELECT doc_id AS path, sha256(text) AS body_hash, strlen(text)::BIGINT AS size FROM documents",
    "after": """
      SELECT path, sha256(text) AS body_hash, strlen(text)::BIGINT AS size FROM (
        SELECT d.doc_id AS path, CASE WHEN t = 1 THEN upper(text) ELSE text END AS text
        FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id) l USING (doc_id) WHERE coalesce(q, 1) = 1
        UNION ALL SELECT -1 - item_id, text FROM benchmark)""",
}
NEEDS = {"nodes": ["places"], "lines": ["docs"]}


def with_relations(query: str, *names: str) -> str:
    """``query`` behind the definitions of the relations it names. A query that begins with WITH goes on in the same list."""
    if not names:
        return query
    order: list[str] = []
    for n in names:
        for x in [*NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    head = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    body = query.strip()
    recursive = "WITH RECURSIVE " if "RECURSIVE" in body.upper()[:16] else "WITH "
    if body.upper().startswith("WITH"):
        return f"{recursive}{head},\n{body.split(None, 2)[2] if recursive != 'WITH ' else body.split(None, 1)[1]}"
    return f"WITH {head}\n{body}"
