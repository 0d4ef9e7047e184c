"""Interval, prefix and resolution joins over derived relations, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import joins as J

from .registry import Registry
from .relations import Relations, with_relations

R = Registry()

# Spans: in each person's time line, the stretch from each event to the second one after it, in seconds; they nest and overlap.
SPANS = """spans AS (
  SELECT user_id, event_id AS span_id, epoch_us(ts) // 1000000 AS start, coalesce(epoch_us(lead(ts, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000000, epoch_us(ts) // 1000000) AS "end"
  FROM events)"""


def spans(r: Relations):
    from pyspark.sql.window import Window

    t = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1000)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return r.table("events").select("user_id", F.col("event_id").alias("span_id"), t.alias("start"), F.coalesce(F.lead(t, 2).over(w), t).alias("end"))


def points(r: Relations):
    e = r.table("events").filter("event_type = 'error'")
    return e.select("user_id", F.col("event_id").alias("point"), (F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1000) + 60).alias("at"))


POINTS = "points AS (SELECT user_id, event_id AS point, epoch_us(ts) // 1000000 + 60 AS pos FROM events WHERE event_type = 'error')"
WIDTH = 3600


@R.query(f"""WITH {SPANS}, {POINTS}
SELECT point, span_id FROM (SELECT point, span_id, row_number() OVER (PARTITION BY point ORDER BY start DESC, "end", span_id) AS k
  FROM points LEFT JOIN spans ON spans.user_id = points.user_id AND pos BETWEEN start AND "end") WHERE k = 1""")
def join_enclosing_span(r: Relations):
    """Each error, a minute on, with the innermost stretch of its person around it."""
    return J.enclosing(points(r), spans(r), "user_id", "at", WIDTH).select("point", "span_id")


RANGES = "ranges AS (SELECT user_id, event_id AS range_id, epoch_us(ts) // 1000000 AS start, epoch_us(ts) // 1000000 + 1800 AS \"end\" FROM events WHERE event_type = 'purchase')"


def ranges(r: Relations):
    t = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1000)
    return r.table("events").filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("range_id"), t.alias("start"), (t + 1800).alias("end"))


@R.query(f"""WITH {SPANS}, {RANGES}
SELECT range_id, span_id FROM ranges r JOIN spans s ON r.user_id = s.user_id AND r.start <= s."end" AND s.start <= r."end" """)
def join_span_overlap(r: Relations):
    return J.overlapping(ranges(r), spans(r), "user_id", WIDTH).select("range_id", "span_id")


@R.query(f"""WITH {SPANS}, {RANGES}, hit AS (
  SELECT range_id, span_id, s.start AS a, s."end" AS b FROM ranges r JOIN spans s ON r.user_id = s.user_id AND r.start <= s."end" AND s.start <= r."end")
SELECT range_id, span_id FROM hit x WHERE NOT EXISTS (SELECT 1 FROM hit y WHERE y.range_id = x.range_id AND y.span_id <> x.span_id
  AND x.a <= y.a AND y.b <= x.b AND (x.b - x.a > y.b - y.a OR x.span_id < y.span_id))""")
def join_innermost_overlap(r: Relations):
    return J.innermost(J.overlapping(ranges(r), spans(r), "user_id", WIDTH))


@R.query(f"""WITH {SPANS}, {POINTS} SELECT point FROM points WHERE NOT EXISTS (
  SELECT 1 FROM spans WHERE spans.user_id = points.user_id AND pos BETWEEN start AND "end")""")
def join_residual(r: Relations):
    return J.residual(points(r), spans(r), "user_id", "at", WIDTH).select("point")


@R.query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS pos, value, event_type FROM events)
SELECT event_id, b.value AS paid FROM e ASOF LEFT JOIN (SELECT user_id, pos, max(value) AS value FROM e WHERE event_type = 'purchase' GROUP BY ALL) b
  ON e.user_id = b.user_id AND e.pos >= b.pos WHERE e.event_type = 'view'""")
def join_as_of(r: Relations):
    """Each view with what its person last paid."""
    e = r.table("events").select("user_id", "event_id", "event_type", "value", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1000).alias("at"))
    paid = e.filter("event_type = 'purchase'").groupBy("user_id", "at").agg(F.max("value").alias("value"))
    views = e.filter("event_type = 'view'").select("user_id", "event_id", "at")
    return J.as_of(views, paid, "user_id", "at", "value", 86400).select("event_id", F.col("value_as_of").alias("paid"))


@R.query(with_relations("""
WITH known AS (SELECT DISTINCT path AS p FROM nodes WHERE kind = 'module'),
m AS (SELECT path, p, row_number() OVER (PARTITION BY path ORDER BY length(p) DESC) AS k FROM (SELECT DISTINCT path FROM nodes) LEFT JOIN known ON path = p OR starts_with(path, p || '/'))
SELECT id, p AS owner FROM nodes JOIN m USING (path) WHERE k = 1""", "nodes"))
def join_longest_prefix(r: Relations):
    """Every node with the module that holds its path most closely."""
    n = r.nodes()
    return J.longest_prefix(n.select("id", "path"), "path", n.filter("kind = 'module'").select(F.col("path").alias("p")), "p").select("id", "owner")


@R.query(with_relations("""
WITH parts AS (SELECT DISTINCT path, string_split(path, '/') AS ps FROM nodes),
ends AS (SELECT path, array_to_string(ps[i:], '/') AS tail FROM (SELECT path, ps, unnest(range(1, len(ps) + 1)) AS i FROM parts)),
one AS (SELECT tail, min(path) AS file FROM ends GROUP BY tail HAVING count(*) = 1)
SELECT want, file FROM (SELECT DISTINCT n_name || '/' || c_mktsegment AS want FROM nation, customer UNION SELECT DISTINCT c_mktsegment FROM customer) LEFT JOIN one ON want = tail""", "nodes"))
def join_unique_suffix(r: Relations):
    seg = r.table("customer").select("c_mktsegment").distinct()
    n = r.table("nation").select("n_name")
    # a handful of segments for each of 25 nations
    want = seg.join(F.broadcast(n)).select(F.concat_ws("/", "n_name", "c_mktsegment").alias("want")).unionByName(seg.select(F.col("c_mktsegment").alias("want")))
    return J.unique_suffix(want, "want", r.nodes().select("path").distinct(), "path")


@R.query(with_relations("""
WITH files AS (SELECT DISTINCT path FROM nodes),
cand AS (SELECT s_suppkey, c, k FROM (SELECT s_suppkey, unnest([place || '/index', place || '/' || 'BUILDING', place || '/suppliers', place]) AS c, unnest([0, 1, 2, 3]) AS k
         FROM supplier JOIN places ON s_nationkey = n_nationkey) WHERE c IN (FROM files))
SELECT s_suppkey, arg_min(c, k) AS file FROM cand GROUP BY s_suppkey""", "nodes"))
def join_first_candidate(r: Relations):
    p = F.broadcast(r.places())
    want = r.table("supplier").join(p, F.col("s_nationkey") == F.col("n_nationkey"))
    tries = F.array(*[F.concat("place", F.lit(x)) for x in ("/index", "/BUILDING", "/suppliers", "")])
    return J.first_candidate(want.select("s_suppkey", tries.alias("c")), "s_suppkey", "c", r.nodes().select("path"), "path")


@R.query("""
WITH intent AS (SELECT p_partkey AS intent, p_name AS name, p_brand AS file, CASE WHEN p_size > 25 THEN p_type END AS family FROM part),
node AS (SELECT p_partkey AS id, p_name AS name, p_brand AS file, CASE WHEN p_size < 45 THEN p_type END AS family FROM part),
local AS (SELECT name, file, count(*) AS n, min(id) AS id FROM node GROUP BY ALL),
far AS (SELECT intent, count(*) AS n, min(id) AS id FROM intent JOIN node ON intent.name = node.name AND (intent.family IS NULL OR node.family IS NULL OR intent.family = node.family) GROUP BY intent),
own AS (SELECT intent, min(id) FILTER (node.family = intent.family) AS id FROM intent JOIN node ON intent.name = node.name GROUP BY intent)
SELECT i.intent, CASE WHEN l.n = 1 THEN 'extracted' WHEN far.n = 1 THEN 'inferred' WHEN far.n > 1 THEN 'ambiguous' ELSE 'missing' END AS outcome,
       CASE WHEN l.n = 1 THEN l.id WHEN far.n = 1 THEN far.id END AS target
FROM intent i LEFT JOIN local l ON l.name = i.name AND l.file = i.file LEFT JOIN far USING (intent) LEFT JOIN own USING (intent)""")
def resolve_names(r: Relations):
    """Parts' names bound to parts: unique in the brand, else unique among reachable families."""
    p = r.table("part")
    intents = p.select(F.col("p_partkey").alias("intent"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("family"))
    nodes = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.when(F.col("p_size") < 45, F.col("p_type")).alias("family"))
    return J.resolve_names(intents, nodes).select("intent", "outcome", "target")


@R.query("""
WITH RECURSIVE intent AS (SELECT o_orderkey AS intent, o_custkey % 50 AS type, o_orderpriority AS method, (o_orderkey % 4)::BIGINT AS args FROM orders),
member AS (SELECT p_partkey AS id, (p_partkey % 60)::BIGINT AS type, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][p_size % 5 + 1] AS method, CASE WHEN p_size > 5 THEN p_size % 4 END::BIGINT AS arity FROM part),
parent AS (SELECT t AS type, (t * 7 + 11) % 50 AS parent FROM range(50) x(t) UNION ALL SELECT t, (t * 3 + 5) % 50 FROM range(0, 50, 5) x(t)),
try AS (SELECT DISTINCT intent, method, args, type AS pos, 0::BIGINT AS level FROM intent UNION SELECT intent, method, args, parent, level + 1 FROM try JOIN parent ON pos = parent.type WHERE level < 3),
hit AS (SELECT intent, level, id, arity IS NULL OR arity = args AS fits FROM try JOIN member ON pos = member.type AND try.method = member.method),
best AS (SELECT intent, level, CASE WHEN count(*) FILTER (fits) > 0 THEN count(*) FILTER (fits) ELSE count(*) END AS n, CASE WHEN count(*) FILTER (fits) > 0 THEN min(id) FILTER (fits) ELSE min(id) END AS one FROM hit GROUP BY ALL),
near AS (SELECT intent, min(level) AS level FROM best GROUP BY intent)
SELECT intent, CASE WHEN n = 1 THEN one END AS target, level, CASE WHEN n = 1 THEN 'bound' ELSE 'ambiguous' END AS outcome FROM near JOIN best USING (intent, level)""")
def resolve_typed_members(r: Relations):
    """Calls on a typed receiver, looked for in the type and three levels of its supertypes, by arity where known."""
    o, p = r.table("orders"), r.table("part")
    intents = o.select(F.col("o_orderkey").alias("intent"), (F.col("o_custkey") % 50).alias("type"), F.col("o_orderpriority").alias("method"), (F.col("o_orderkey") % 4).cast("long").alias("args"))
    names = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    members = p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 60).alias("type"), F.element_at(names, (F.col("p_size") % 5 + 1)).alias("method"), F.when(F.col("p_size") > 5, F.col("p_size") % 4).cast("long").alias("arity"))
    t = r.spark.range(50)
    parents = t.select(F.col("id").alias("type"), ((F.col("id") * 7 + 11) % 50).alias("parent")).unionByName(r.spark.range(0, 50, 5).select(F.col("id").alias("type"), ((F.col("id") * 3 + 5) % 50).alias("parent")))
    return J.typed_members(intents, members, parents)


@R.query("""
WITH have AS (SELECT DISTINCT l_suppkey, l_returnflag || l_linestatus || l_linenumber AS m FROM lineitem),
need AS (SELECT DISTINCT c_mktsegment AS g, o_orderstatus AS s FROM customer JOIN orders ON c_custkey = o_custkey),
want AS (SELECT DISTINCT g, l_returnflag || l_linestatus || l_linenumber AS m FROM need JOIN orders ON o_orderstatus = s JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey AND c_mktsegment = g WHERE o_orderpriority = '1-URGENT')
SELECT l_suppkey, g FROM have JOIN want USING (m) GROUP BY l_suppkey, g HAVING count(*) = max((SELECT count(*) FROM want w WHERE w.g = want.g))""")
def join_division(r: Relations):
    """Suppliers that have shipped in every manner in which some segment's urgent orders were shipped."""
    li, o, c = r.table("lineitem"), r.table("orders"), r.table("customer")
    manner = F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    have = li.select("l_suppkey", manner.alias("m")).distinct()
    need = li.join(o.filter("o_orderpriority = '1-URGENT'"), li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).select(F.col("c_mktsegment").alias("g"), manner.alias("m")).distinct()
    return J.division(have, "l_suppkey", need, "g", ["m"])


_LOOK = """{n}_try AS (SELECT DISTINCT intent, want, type AS pos, 0 AS level FROM {n} UNION SELECT intent, want, parent, level + 1 FROM {n}_try JOIN parent ON pos = parent.type WHERE level < 3),
{n}_hit AS (SELECT intent, level, count(*) AS n, min(id) AS one FROM {n}_try JOIN {m} ON pos = {m}.type AND want = {m}.name GROUP BY intent, level),
{n}_got AS (SELECT intent, arg_min(n, level) AS n, arg_min(one, level) AS one FROM {n}_hit GROUP BY intent)"""


@R.query(f"""
WITH RECURSIVE intent AS (SELECT o_orderkey AS intent, o_custkey % 50 AS type, o_orderstatus AS field, o_orderpriority AS method FROM orders),
field AS (SELECT s_suppkey % 50 AS type, ['F', 'O', 'P'][(s_suppkey % 3 + 1)::INT] AS name, s_suppkey % 60 AS id FROM supplier WHERE s_acctbal > 2000),
member AS (SELECT p_partkey % 60 AS type, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][p_size % 5 + 1] AS name, p_partkey AS id FROM part WHERE p_retailprice > 1300),
parent AS (SELECT t AS type, (t * 7 + 11) % 50 AS parent FROM range(50) x(t)),
a AS (SELECT intent, type, field AS want FROM intent), {_LOOK.format(n="a", m="field")},
b AS (SELECT intent, one AS type, method AS want FROM a_got JOIN intent USING (intent) WHERE n = 1), {_LOOK.format(n="b", m="member")}
SELECT intent, CASE WHEN n = 1 THEN one END AS target, CASE WHEN n = 1 THEN 'bound' ELSE 'ambiguous' END AS outcome FROM b_got""")
def resolve_member_chains(r: Relations):
    """Calls through one field each, fields and methods promoted from embedded types."""
    o, p, s = r.table("orders"), r.table("part"), r.table("supplier")
    intents = o.select(F.col("o_orderkey").alias("intent"), (F.col("o_custkey") % 50).alias("type"), F.array("o_orderstatus").alias("chain"), F.col("o_orderpriority").alias("method"), F.lit(None).cast("long").alias("args"))
    pick = lambda items, k: F.element_at(F.array(*map(F.lit, items)), (k + 1).cast("int"))
    fields = s.filter("s_acctbal > 2000").select((F.col("s_suppkey") % 50).alias("type"), pick("FOP", F.col("s_suppkey") % 3).alias("field"), (F.col("s_suppkey") % 60).alias("to"))
    members = p.filter("p_retailprice > 1300").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 60).alias("type"), pick(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), F.col("p_size") % 5).alias("method"), F.lit(None).cast("long").alias("arity"))
    embeds = r.spark.range(50).select(F.col("id").alias("type"), ((F.col("id") * 7 + 11) % 50).alias("parent"))
    return J.chained_members(intents, fields, members, embeds)


@R.query("""
WITH d AS (SELECT p_partkey AS id, p_brand AS dir, p_name AS name, p_size > 40 AS in_test FROM part), i AS (SELECT p_partkey AS intent, p_brand AS dir, p_name AS name, p_size % 2 = 0 AS by_test FROM part),
k AS (SELECT intent, count(id) AS n, min(id) AS one FROM i LEFT JOIN d ON d.dir = i.dir AND d.name = i.name AND (by_test OR NOT in_test) GROUP BY intent)
SELECT intent, CASE WHEN n = 1 THEN one END AS target, CASE WHEN n = 1 THEN 'bound' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS outcome FROM k""")
def resolve_packages(r: Relations):
    """Names of a package's folder, with what its tests declare seen by tests only."""
    p = r.table("part")
    declared = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("dir"), F.col("p_name").alias("name"), (F.col("p_size") > 40).alias("in_test"))
    return J.package_members(p.select(F.col("p_partkey").alias("intent"), F.col("p_brand").alias("dir"), F.col("p_name").alias("name"), (F.col("p_size") % 2 == 0).alias("by_test")), declared)
