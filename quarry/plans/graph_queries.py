"""Graph operators over the derived graph, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import directory
from quarry.operators import graph as G

from .registry import Registry
from .relations import Relations, with_relations

R = Registry()
W = "relation <> 'contains'"


@R.query(with_relations(f"SELECT target AS id, count(*) AS in_degree FROM edges WHERE {W} GROUP BY 1", "edges"))
def graph_in_degree(r: Relations):
    return G.in_degree(r.edges())


def region_customers(r: Relations):
    return r.nodes().filter((F.col("kind") == "class") & F.col("path").startswith("AFRICA/"))


@R.query(with_relations(f"""
  SELECT target AS seed, source AS other, relation, line, name, kind, path FROM edges LEFT JOIN nodes ON source = id
  WHERE {W} AND target IN (SELECT id FROM nodes WHERE kind = 'class' AND starts_with(path, 'AFRICA/'))""", "nodes", "edges"))
def graph_callers(r: Relations):
    return G.neighbours(r.edges(), r.nodes(), region_customers(r), incoming=True)


@R.query(with_relations(f"""
  SELECT source AS seed, target AS other, relation, line, name, kind, path FROM edges LEFT JOIN nodes ON target = id
  WHERE {W} AND source IN (SELECT id FROM nodes WHERE kind = 'interface')""", "nodes", "edges"))
def graph_callees(r: Relations):
    return G.neighbours(r.edges(), r.nodes(), r.nodes().filter("kind = 'interface'"), incoming=False)


def impact_sql(seed: str, depth: int) -> str:
    """A level after another: each node not seen before, by the first edge of the first node that reaches it."""
    levels = "".join(f""",
l{d} AS (SELECT source AS id, {d}::BIGINT AS depth, target AS via, relation FROM walk WHERE target IN (SELECT id FROM {"seed" if d == 1 else f"l{d - 1}"})
  AND source NOT IN (SELECT id FROM seed{"".join(f" UNION ALL SELECT id FROM l{k}" for k in range(1, d))}) QUALIFY row_number() OVER (PARTITION BY source ORDER BY target, ord, relation) = 1)""" for d in range(1, depth + 1))
    return f"WITH walk AS (SELECT * FROM edges WHERE {W}), seed AS (SELECT id FROM nodes WHERE {seed}){levels}\n" + " UNION ALL ".join(f"SELECT id, depth, via, relation FROM l{d}" for d in range(1, depth + 1))


@R.query(with_relations(impact_sql("path = 'AMERICA/NATION_1/BUILDING'", 3), "nodes", "edges"))
def graph_impact(r: Relations):
    """Callers of callers of one file's symbols, three levels up, each with the edge that reaches it first."""
    return G.impact(r.edges(), G.file_seeds(r.nodes(), "AMERICA/NATION_1/BUILDING"), 3)


@R.query(with_relations(impact_sql("kind = 'class'", 2), "nodes", "edges"))
def graph_impact_wide(r: Relations):
    """Two levels up from every customer: a frontier of the whole graph."""
    return G.impact(r.edges(), r.nodes().filter("kind = 'class'").select("id"), 2)


@R.query(with_relations("""
WITH RECURSIVE step AS (SELECT DISTINCT source, target FROM edges WHERE relation IN ('calls', 'references', 'imports')),
seed AS (SELECT id FROM nodes WHERE path = 'ASIA/NATION_2/suppliers'),
reach AS (SELECT id, 0::BIGINT AS depth FROM seed UNION SELECT step.target, depth + 1 FROM reach JOIN step ON step.source = reach.id WHERE depth < 10)
SELECT id, min(depth) AS depth FROM reach GROUP BY id""", "nodes", "edges"))
def graph_distances(r: Relations):
    return G.distances(r.edges(), G.file_seeds(r.nodes(), "ASIA/NATION_2/suppliers")).select("id", "depth")


@R.query(with_relations("""
WITH RECURSIVE reach AS (SELECT source, target FROM trade UNION SELECT reach.source, trade.target FROM reach JOIN trade ON trade.source = reach.target),
same AS (SELECT a.source AS id, a.target AS peer FROM reach a JOIN reach b ON a.source = b.target AND a.target = b.source),
named AS (SELECT id, min(least(id, peer)) AS component FROM same WHERE id <> peer GROUP BY id)
SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM named""".replace("trade", "follows"), "follows"))
def graph_scc(r: Relations):
    """Over a graph of all customers that order, cyclic, with components of all sizes."""
    return G.components_of(r.follows())


@R.query(with_relations("""
WITH RECURSIVE reach AS (SELECT source, target FROM trade UNION SELECT reach.source, trade.target FROM reach JOIN trade ON trade.source = reach.target)
SELECT source, target FROM reach""", "trade"))
def graph_closure(r: Relations):
    return G.closure(r.trade())


DIRS = """
SELECT a.path AS source, b.path AS target, min(ord) AS evidence FROM edges JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target
WHERE relation <> 'contains' AND a.path <> b.path GROUP BY 1, 2"""


@R.query(with_relations(DIRS, "nodes", "edges"))
def graph_dir_dependencies(r: Relations):
    return G.directory_edges(r.edges(), r.nodes(), F.col("path"))


@R.query(with_relations("""
WITH top AS (SELECT id, split_part(path, '/', 1) AS dir FROM nodes),
dep AS (SELECT DISTINCT a.dir AS s, b.dir AS t FROM edges JOIN top a ON a.id = source JOIN top b ON b.id = target WHERE relation <> 'contains' AND a.dir <> b.dir)
SELECT x.s AS a, x.t AS b, EXISTS (SELECT 1 FROM dep y WHERE y.s = x.t AND y.t = x.s) AS mutual FROM dep x""", "nodes", "edges"))
def graph_mutual_dirs(r: Relations):
    dep = G.directory_edges(r.edges(), r.nodes(), F.element_at(F.split("path", "/"), 1)).select(F.col("source").alias("a"), F.col("target").alias("b"))
    back = dep.select(F.col("b").alias("x"), F.col("a").alias("y"), F.lit(True).alias("m"))
    return dep.join(back, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left").select("a", "b", F.coalesce("m", F.lit(False)).alias("mutual"))


ROUNDS = 25
_PPR = """
WITH pair AS (SELECT source AS a, target AS b FROM edges WHERE relation <> 'contains' UNION ALL SELECT target, source FROM edges WHERE relation <> 'contains'),
link AS MATERIALIZED (SELECT a, b, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY a) AS share FROM pair GROUP BY a, b),
seed AS MATERIALIZED (SELECT id, 1.0::DOUBLE / count(*) OVER () AS r FROM nodes WHERE kind = 'interface'),
lone AS MATERIALIZED (SELECT id FROM seed WHERE id NOT IN (SELECT a FROM link)),
m0 AS MATERIALIZED (SELECT id, r AS m FROM seed)""" + "".join(f""",
m{k + 1} AS MATERIALIZED (SELECT id, sum(m) AS m FROM (
  SELECT b AS id, 0.75::DOUBLE * m * share AS m FROM m{k} JOIN link ON id = a
  UNION ALL SELECT id, r * (0.25::DOUBLE + 0.75::DOUBLE * coalesce((SELECT sum(m) FROM m{k} WHERE id IN (SELECT id FROM lone)), 0)) FROM seed) GROUP BY id)""" for k in range(ROUNDS)) + f"""
SELECT id, round(m / max(m) OVER (), 6) AS rank FROM m{ROUNDS}"""


@R.query(with_relations(_PPR, "nodes", "edges"))
def graph_pagerank(r: Relations):
    """Personalised PageRank from all suppliers."""
    seeds = r.nodes().filter("kind = 'interface'").select("id", F.lit(1.0).alias("weight"))
    return G.pagerank(G.walkable(r.edges()), seeds, ROUNDS).select("id", F.round("rank", 6).alias("rank"))


@R.query(with_relations("""
SELECT target AS id, count(*) FILTER (relation = 'calls') AS n_calls, count(DISTINCT source) FILTER (relation = 'calls') AS n_callers,
       count(*) FILTER (relation = 'references') AS n_references, count(*) FILTER (relation = 'references') = 0 AS exact
FROM edges WHERE relation IN ('calls', 'references') GROUP BY 1""", "edges"))
def graph_caller_bound(r: Relations):
    return G.caller_bound(r.edges())


@R.query(with_relations("""
WITH t AS (SELECT *, CASE WHEN lower(name) = 'red widget' OR ends_with(lower(id), '#red widget') OR ends_with(lower(id), '.red widget') THEN 1
  WHEN lower(path) = 'red widget' OR ends_with(lower(path), '/red widget') THEN 3 END::BIGINT AS tier FROM nodes)
SELECT id, name, kind, path, tier FROM t WHERE tier = (SELECT min(tier) FROM t)""", "nodes"))
def graph_resolve_symbol(r: Relations):
    return G.resolve_symbol(r.nodes(), "Red Widget")


@R.query(with_relations("""
SELECT source, target, relation, line, ord FROM (
  SELECT *, row_number() OVER (PARTITION BY source, target, relation ORDER BY ord, line) AS k FROM edges) WHERE k = 1""", "edges"))
def graph_dedup_edges(r: Relations):
    return G.dedup_edges(r.edges())


@R.query(with_relations("""
WITH n AS (SELECT path || '#' || name AS base, id AS old_id, row_number() OVER (PARTITION BY path, name ORDER BY id) AS k FROM nodes)
SELECT base, old_id, CASE WHEN k = 1 THEN base ELSE base || '~' || k END AS id FROM n""", "nodes"))
def graph_mint_ids(r: Relations):
    rows = r.nodes().select(F.concat_ws("#", "path", "name").alias("base"), F.col("id").alias("old_id"))
    return G.mint_ids(rows, "base", ["old_id"])


HUBS = """
SELECT id, name, kind, path, count(*) AS degree FROM (SELECT unnest([source, target]) AS e FROM edges WHERE relation <> 'contains') JOIN nodes ON id = e
GROUP BY ALL ORDER BY degree DESC, name, path, id LIMIT 12"""


@R.query(with_relations(HUBS, "nodes", "edges"))
def map_hubs(r: Relations):
    return G.hubs(r.edges(), r.nodes())


@R.query(with_relations("""
WITH step AS (SELECT DISTINCT source, target FROM follows WHERE source <> target),
a AS (SELECT s.source AS x, s.target AS y FROM step s)
SELECT x AS a, y AS b, step.target AS c, step.target = x AS cycle FROM a JOIN step ON step.source = y""", "follows"))
def graph_call_tree(r: Relations):
    """Chains of two steps from every customer that orders, with those that come back marked."""
    t = r.follows().filter("source <> target").withColumn("relation", F.lit("calls"))
    tree = G.call_tree(t, t.select(F.col("source").alias("id")).distinct(), 2).filter("depth = 2")
    return tree.select(F.col("trail")[0].alias("a"), F.col("trail")[1].alias("b"), F.col("trail")[2].alias("c"), "cycle")


@R.query(with_relations("""
WITH d AS (SELECT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir, kind, id FROM nodes)
SELECT dir, count(*) AS symbols, count(DISTINCT kind) AS kinds FROM d GROUP BY dir""", "nodes"))
def map_dirs(r: Relations):
    return r.nodes().select(directory(F.col("path")).alias("dir"), "kind").groupBy("dir").agg(F.count(F.lit(1)).alias("symbols"), F.count_distinct("kind").alias("kinds"))


@R.query(with_relations("""
SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT path) FROM nodes) AS files, (SELECT count(*) FROM edges) AS edges,
       (SELECT count(*) FROM edges WHERE relation <> 'contains') AS walkable""", "nodes", "edges"))
def map_totals(r: Relations):
    a = r.nodes().agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("path").alias("files"))
    b = r.edges().agg(F.count(F.lit(1)).alias("edges"), F.count(F.when(F.col("relation") != "contains", 1)).alias("walkable"))
    return a.join(F.broadcast(b))


@R.query(with_relations("""
WITH inside AS (SELECT id FROM nodes WHERE path = 'AMERICA/NATION_1/BUILDING'), e AS (SELECT *, count(*) OVER () AS n FROM edges WHERE target IN (FROM inside) AND source NOT IN (FROM inside))
SELECT source, relation, target, greatest(0, n - 8)::BIGINT AS left FROM e ORDER BY ord, source, relation LIMIT 8""", "nodes", "edges"))
def graph_file_blast(r: Relations):
    return G.file_blast(r.edges(), r.nodes(), "/data/AMERICA/NATION_1/BUILDING")


@R.query(with_relations("""
WITH RECURSIVE walk AS (SELECT DISTINCT source, target FROM edges WHERE relation <> 'contains'), seed AS (SELECT id, path AS origin FROM nodes WHERE path IN ('EUROPE/NATION_3/BUILDING', 'ASIA/NATION_2/MACHINERY')),
reach AS (SELECT id, origin, 0::BIGINT AS depth FROM seed UNION SELECT walk.source, origin, depth + 1 FROM reach JOIN walk ON walk.target = reach.id WHERE depth < 2),
own AS (SELECT id, origin, min(depth) AS depth FROM reach WHERE (id, origin) NOT IN (SELECT (id, origin) FROM seed) GROUP BY id, origin)
SELECT id, min(depth) AS depth, string_agg(origin, ',' ORDER BY origin) AS origins FROM own GROUP BY id""", "nodes", "edges"))
def graph_impact_by_origin(r: Relations):
    """What two changed files reach, merged."""
    seeds = r.nodes().filter(F.col("path").isin("EUROPE/NATION_3/BUILDING", "ASIA/NATION_2/MACHINERY")).select("id", F.col("path").alias("origin"))
    out = G.impact_by_origin(r.edges(), seeds, 2)
    return out.select("id", "depth", F.array_join("origins", ",").alias("origins"))


@R.query(with_relations("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT path) FROM nodes) AS files, (SELECT string_agg(DISTINCT kind, ',' ORDER BY kind) FROM nodes) AS kinds, (SELECT count(*) FROM edges) AS edges", "nodes", "edges"))
def map_stats(r: Relations):
    from quarry.operators import analysis as A

    return A.graph_stats(r.nodes(), r.edges())


@R.query(with_relations(f"WITH h AS ({HUBS.strip()}) SELECT h.name AS title, h.path AS pointer, n.id FROM h LEFT JOIN nodes n ON n.name = h.name AND n.path = h.path", "nodes", "edges"))
def join_hit_nodes(r: Relations):
    """The hubs' nodes, found again by title and place."""
    from quarry.operators import joins as J

    hits = G.hubs(r.edges(), r.nodes()).select(F.col("name").alias("title"), F.col("path").alias("pointer"))
    return J.hit_nodes(hits, r.nodes())
