"""Analyses over derived relations, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import analysis as A
from quarry.operators import graph as G

from .registry import Registry
from .relations import Relations, with_relations

R = Registry()



def complexity(r: Relations):
    """Per person and kind of event: distinct kinds of payload, in the place of decision points."""
    e = r.table("events")
    return e.groupBy(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("path")).agg(F.count_distinct("props").alias("complexity"))


def churned(r: Relations):
    e = r.table("events")
    return A.churn(e.select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("hash")))


HOT = """
WITH k AS (SELECT event_type || '/' || user_id AS path, count(DISTINCT event_id) AS commits, count(DISTINCT props) AS complexity FROM events GROUP BY 1)
SELECT path, commits, complexity, round(100.0::DOUBLE * (commits / max(commits) OVER ()) * (complexity / max(complexity) OVER ()))::BIGINT AS score FROM k"""


@R.query("SELECT event_type || '/' || user_id AS path, count(DISTINCT event_id) AS commits FROM events GROUP BY 1")
def analysis_churn(r: Relations):
    return churned(r)


@R.query(HOT)
def analysis_hotspots(r: Relations):
    return A.hotspots(churned(r), complexity(r))


@R.query(f"SELECT * FROM ({HOT}) ORDER BY score DESC, commits DESC, path LIMIT 15")
def analysis_hotspots_top(r: Relations):
    return A.top_hotspots(A.hotspots(churned(r), complexity(r)))


@R.query("""
WITH k AS (SELECT event_type || '/' || user_id AS path, count(DISTINCT props) AS complexity FROM events GROUP BY 1)
SELECT count(*) AS n, sum(complexity)::BIGINT AS total, round(avg(complexity), 6) AS mean, count(*) FILTER (complexity > 20) AS above FROM k""")
def analysis_complexity_gate(r: Relations):
    return complexity(r).agg(F.count(F.lit(1)).alias("n"), F.sum("complexity").alias("total"), F.round(F.avg("complexity"), 6).alias("mean"), F.count(F.when(F.col("complexity") > A.COMPLEX, 1)).alias("above"))


@R.query("""
WITH k AS (SELECT event_type || '/' || user_id AS path, count(DISTINCT props) AS complexity FROM events GROUP BY 1)
SELECT path, complexity FROM k ORDER BY complexity DESC, path LIMIT 20""")
def analysis_complexity_top(r: Relations):
    return complexity(r).orderBy(F.desc("complexity"), "path").limit(20)


OWN = """
WITH c AS (SELECT path AS area, person, hash, max(at_ms) AS at_ms FROM commits GROUP BY ALL), now AS (SELECT max(at_ms) AS now FROM commits),
o AS (SELECT area, person, sum(pow(0.5::DOUBLE, greatest(0, now - at_ms) / 10368000000.0::DOUBLE)) AS score, count(*) AS commits, max(at_ms) AS last_ms FROM c, now GROUP BY ALL)"""


def scores(r: Relations):
    c = r.commits().withColumnRenamed("path", "area")
    now = c.agg(F.max("at_ms").alias("now"))
    return A.ownership(c, now.first()[0] or 0)


@R.query(with_relations(OWN + " SELECT area, person, round(score, 6) AS score, commits, last_ms FROM o", "commits"))
def analysis_ownership(r: Relations):
    return scores(r).withColumn("score", F.round("score", 6))


@R.query(with_relations(OWN + """, s AS (SELECT *, score / sum(score) OVER (PARTITION BY area) AS share FROM o),
p AS (SELECT area, person, share, row_number() OVER (PARTITION BY area ORDER BY score DESC, commits DESC, person) AS place FROM s WHERE share >= 0.15)
SELECT area, person, round(share, 6) AS share, place FROM p WHERE place <= 2""", "commits"))
def analysis_owners(r: Relations):
    return A.owners(scores(r)).withColumn("share", F.round("share", 6))


@R.query(with_relations(OWN + """ SELECT person, round(sum(score * CASE WHEN area = 'purchase' THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END), 6) AS weight
FROM o WHERE area IN ('purchase', 'signup', 'error') GROUP BY person ORDER BY sum(score * CASE WHEN area = 'purchase' THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END) DESC, person LIMIT 3""", "commits"))
def analysis_reviewers(r: Relations):
    area = r.commits().select(F.col("path").alias("area")).distinct()
    return A.reviewers(scores(r), area.filter("area = 'purchase'"), area.filter("area IN ('signup', 'error')")).withColumn("weight", F.round("weight", 6))


def symbols(r: Relations):
    n = r.nodes()
    return n.select("id", "name", "kind", "path", F.lit(False).alias("generated"), F.col("path").startswith("AFRICA/").alias("copy"), (F.col("kind") == "method").alias("exported"), F.col("path").contains("MACHINERY").alias("decorated"))


DEAD = f"""
WITH used AS (SELECT target AS id FROM edges WHERE relation IN ('calls', 'references', 'writes', 'imports') UNION SELECT source FROM edges WHERE relation = 'implements'),
s AS (SELECT id, name, kind, path, starts_with(path, 'AFRICA/') AS copy, kind = 'method' AS exported, contains(path, 'MACHINERY') AS decorated,
  CASE WHEN starts_with(path, 'AFRICA/') THEN 'copy' WHEN name IN ('main', 'constructor') THEN 'entry point' WHEN name IN ({', '.join(f"'{x}'" for x in A.RUNTIME_NAMES)}) THEN 'runtime' WHEN kind = 'interface' THEN 'interface' END AS why FROM nodes),
twin AS (SELECT DISTINCT name FROM s WHERE id IN (FROM used)), men AS (SELECT n_name AS name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1)"""


@R.query(with_relations(DEAD + """, k AS (SELECT id, name, CASE WHEN name IN (FROM twin) THEN 'twin' WHEN decorated THEN 'decorated' WHEN coalesce(men.n, 0) > 1 THEN 'mentioned' WHEN exported THEN 'exported' ELSE 'unused' END AS rule
  FROM s LEFT JOIN men USING (name) WHERE why IS NULL AND id NOT IN (FROM used))
SELECT id, name, CASE rule WHEN 'unused' THEN 'high' WHEN 'exported' THEN 'medium' ELSE 'low' END AS confidence, rule FROM k""", "nodes", "edges"))
def analysis_dead(r: Relations):
    men = r.table("nation").join(r.table("customer"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    none = r.nodes().filter("false").select("name")
    return A.dead_symbols(symbols(r), r.edges(), none, men)


@R.query(with_relations(DEAD + " SELECT why AS reason, count(*) AS n FROM s WHERE why IS NOT NULL GROUP BY 1", "nodes", "edges"))
def analysis_dead_exclusions(r: Relations):
    return A.dead_exclusions(symbols(r))


@R.query(with_relations("""
WITH w AS (SELECT id, line, unnest(regexp_extract_all(text, '[A-Za-z0-9_$\\x{80}-\\x{10FFFF}]+')) AS w FROM lines),
names AS (SELECT unnest(['the', 'loser', 'token', 'secret', 'und']) AS name),
k AS (SELECT w AS name, id, line, count(*) AS k FROM w WHERE w IN (FROM names) GROUP BY ALL)
SELECT name, sum(k)::BIGINT AS n, count(*) AS n_lines FROM k GROUP BY name""", "lines"))
def analysis_mentions(r: Relations):
    names = r.spark.createDataFrame([(x,) for x in ("the", "loser", "token", "secret", "und")], "name string")
    return A.mention_counts(r.lines(), names)


DRIFT = """
WITH s AS (SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' WHEN a.size <> b.size OR a.body_hash <> b.body_hash THEN 'changed' END AS status
  FROM before b FULL JOIN after a ON b.path = a.path)"""


@R.query(with_relations(DRIFT + " SELECT path, status FROM s WHERE status IS NOT NULL", "before", "after"))
def history_drift(r: Relations):
    return A.drift(r.before(), r.after())


@R.query(with_relations(DRIFT + " SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'changed') AS changed, count(status) = 0 AS ok FROM s", "before", "after"))
def history_check(r: Relations):
    return A.check_summary(A.drift(r.before(), r.after()))


CARRY = """
WITH kept AS (SELECT path FROM before JOIN after USING (path, body_hash)),
e AS (SELECT doc_id AS source, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS target, 'references' AS relation FROM documents)
SELECT source, target, relation FROM e WHERE source IN (FROM kept) AND target IN (FROM kept)"""


def chain(r: Relations):
    d = r.table("documents")
    w = Window.partitionBy("source").orderBy("doc_id")
    return d.select(F.col("doc_id").alias("a"), F.lead("doc_id").over(w).alias("target")).select(F.col("a").alias("source"), "target", F.lit("references").alias("relation")).filter("target IS NOT NULL")


@R.query(with_relations(CARRY, "before", "after"))
def history_carry_over(r: Relations):
    """Edges between documents that still hold after cleaning."""
    files = r.before().select(F.col("path").alias("id"), "path")
    return A.carry_over(chain(r), r.before(), r.after(), files)


BLAST = """
WITH RECURSIVE walk AS (SELECT DISTINCT source, target FROM edges WHERE relation <> 'contains'), seed AS (SELECT id FROM nodes WHERE path = 'EUROPE/NATION_3/BUILDING'),
reach AS (SELECT id, 0::BIGINT AS depth FROM seed UNION SELECT walk.source, depth + 1 FROM reach JOIN walk ON walk.target = reach.id WHERE depth < 3),
least AS (SELECT id, min(depth) AS depth FROM reach WHERE id NOT IN (FROM seed) GROUP BY id)
SELECT path AS dir, count(*) AS dependents, min(depth) AS nearest FROM least JOIN nodes USING (id) GROUP BY 1"""


@R.query(with_relations(BLAST, "nodes", "edges"))
def analysis_blast_modules(r: Relations):
    reach = G.impact(r.edges(), G.file_seeds(r.nodes(), "EUROPE/NATION_3/BUILDING"), 3)
    return A.blast_modules(reach, r.nodes(), F.col("path"))


@R.query(with_relations("""
WITH tests AS (SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'P'), hit AS (SELECT DISTINCT target AS id FROM edges WHERE source IN (FROM tests)),
k AS (SELECT id, path AS area, kind <> 'module' AS callable, contains(name, '99') AS t, id IN (FROM hit) AS reached FROM nodes)
SELECT area, count(*) AS symbols, count(*) FILTER (reached) AS reached, CASE WHEN NOT max(callable) THEN 'na' WHEN max(t) THEN 'changed' WHEN count(*) FILTER (reached) > 0 THEN 'stale' ELSE 'none' END AS signal FROM k GROUP BY area""", "nodes", "edges"))
def analysis_area_signal(r: Relations):
    changed = r.nodes().select("id", F.col("path").alias("area"), (F.col("kind") != "module").alias("callable"), F.col("name").contains("99").alias("changed_test"))
    tests = r.table("orders").filter("o_orderstatus = 'P'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"))
    return A.area_signal(changed, r.edges(), tests)


@R.query(with_relations("""
WITH actual AS (SELECT source, relation, target, count(*) - 1 AS extra FROM edges WHERE relation = 'calls' OR line = 0 GROUP BY ALL),
expected AS (SELECT DISTINCT source, relation, target FROM edges WHERE line <> 1),
x AS (SELECT coalesce(a.relation, e.relation) AS relation, a.source IS NOT NULL AS ins, e.source IS NOT NULL AS exp, coalesce(extra, 0) AS extra FROM actual a FULL JOIN expected e ON a.source = e.source AND a.relation = e.relation AND a.target = e.target),
k AS (SELECT relation, count(*) FILTER (ins AND exp) AS tp, count(*) FILTER (ins AND NOT exp) AS fp, count(*) FILTER (exp AND NOT ins) AS fn, sum(extra)::BIGINT AS duplicates FROM x GROUP BY 1)
SELECT relation, tp, fp, fn, duplicates, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM k""", "edges"))
def quality_oracle(r: Relations):
    e = r.edges()
    return A.score_facts(e.filter("relation = 'calls' OR line = 0"), e.filter("line <> 1"))


@R.query(with_relations("""
WITH touched AS (SELECT source AS id FROM edges WHERE relation <> 'contains' UNION SELECT target FROM edges WHERE relation <> 'contains')
SELECT kind, count(*) AS n, count(*) FILTER (touched.id IS NULL) AS orphans, (100 * count(*) FILTER (touched.id IS NULL) + count(*) // 2) // count(*) AS percent
FROM nodes LEFT JOIN touched ON nodes.id = touched.id GROUP BY kind""", "nodes", "edges"))
def quality_counts(r: Relations):
    return A.quality_counts(r.nodes(), r.edges())


KINDS = ["module", "class", "function", "method", "interface"]


@R.query(with_relations("""
SELECT 'duplicate id' AS rule, id FROM nodes GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'empty name', id FROM nodes WHERE coalesce(name, '') = ''
UNION ALL SELECT 'bad kind', id FROM nodes WHERE kind NOT IN ('module', 'class', 'function', 'method') UNION ALL SELECT 'bad relation', source FROM edges WHERE relation NOT IN ('calls', 'contains', 'references')
UNION ALL SELECT 'self loop', source FROM edges WHERE source = target AND relation <> 'calls'
UNION ALL SELECT 'dangling source', source FROM edges WHERE source NOT IN (SELECT id FROM nodes) UNION ALL SELECT 'dangling target', target FROM edges WHERE relation <> 'references' AND target NOT IN (SELECT id FROM nodes)""", "nodes", "edges"))
def quality_violations(r: Relations):
    """Against a stricter list of kinds, so that there is something to find."""
    return A.violations(r.nodes(), r.edges(), KINDS[:4], ["calls", "contains", "references"], ["references"])


@R.query("""
SELECT conv_id, turn, used FROM (SELECT conv_id, turn, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM conversations) WHERE used <= 2000""")
def budget_prefix(r: Relations):
    """The turns of each conversation that fit a budget, from the first on."""
    c = r.table("conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("size"))
    return A.budget_prefix(c, "conv_id", ["turn"], "size", 2000).select("conv_id", "turn", "used")


@R.query("SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT ts::DATE) AS days, round(sum(value), 4) AS value FROM events GROUP BY 1")
def session_stats(r: Relations):
    return A.session_mix(r.table("events"))


@R.query("""
SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS route FROM pages""")
def routes_links(r: Relations):
    """Routes that pages refer to."""
    return r.table("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("route"))


@R.query("SELECT l_returnflag, l_linestatus, sum(l_linenumber)::BIGINT AS n, count(*) AS k FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(r: Relations):
    return r.table("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_linenumber").alias("n"), F.count(F.lit(1)).alias("k"))


@R.query("SELECT l_returnflag, l_linestatus, max(l_quantity) AS q, count(DISTINCT l_suppkey) AS k FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(r: Relations):
    return r.table("lineitem").cube("l_returnflag", "l_linestatus").agg(F.max("l_quantity").alias("q"), F.count_distinct("l_suppkey").alias("k"))


@R.query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_except(r: Relations):
    return r.table("documents").select("doc_id").exceptAll(r.table("labels").select("doc_id")).distinct()


@R.query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set_intersect(r: Relations):
    return r.table("documents").select("doc_id").intersect(r.table("labels").select("doc_id"))


@R.query("SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL")
def window_daily(r: Relations):
    e = r.table("events")
    return e.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v")).withColumn("day", F.col("day").cast("timestamp_ntz"))


@R.query("""
WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, k::BIGINT AS session, count(*) AS n FROM s GROUP BY ALL""")
def window_sessions(r: Relations):
    """Gaps and islands: a person's events no more than half an hour apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = r.table("events").select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    new = F.when(F.col("us") - F.lag("us").over(w) <= 1_800_000_000, 0).otherwise(1)
    return e.withColumn("new", new).withColumn("session", F.sum("new").over(w)).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"))


@R.query(with_relations("""
SELECT repo, count(*) AS nodes, count(DISTINCT kind) AS kinds FROM (SELECT split_part(path, '/', 1) AS repo, kind FROM nodes) GROUP BY repo""", "nodes"))
def workspace_union(r: Relations):
    """Counts over a federation in which each top folder is a repository of its own."""
    n = r.nodes().withColumn("repo", F.element_at(F.split("path", "/"), 1))
    return n.groupBy("repo").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("kind").alias("kinds"))


@R.query(with_relations("""
WITH actual AS (SELECT DISTINCT source, relation, target FROM edges WHERE relation = 'calls' OR line = 0), expected AS (SELECT DISTINCT source, relation, target FROM edges WHERE line <> 1),
x AS (SELECT coalesce(a.relation, e.relation) AS relation, a.source IS NOT NULL AS ins, e.source IS NOT NULL AS exp FROM actual a FULL JOIN expected e ON a.source = e.source AND a.relation = e.relation AND a.target = e.target),
k AS (SELECT relation, count(*) FILTER (ins AND exp) AS tp, count(*) FILTER (ins) AS found, count(*) FILTER (exp) AS want FROM x GROUP BY 1)
SELECT 'rule: bad kind' AS reason, count(*) AS n FROM nodes WHERE kind NOT IN ('module', 'class', 'function', 'method') HAVING count(*) > 0
UNION ALL SELECT 'score: ' || relation, 1 FROM k WHERE coalesce(tp / nullif(found, 0), 0) < 0.9 OR coalesce(tp / nullif(want, 0), 0) < 0.9""", "nodes", "edges"))
def quality_gate(r: Relations):
    """What keeps the graph from passing a strict gate, by a stricter list of kinds and expected facts that lack first lines."""
    e = r.edges()
    broken = A.violations(r.nodes(), e, KINDS[:4], ["calls", "contains", "references"], ["references"])
    return A.strict_gate(broken, A.score_facts(e.filter("relation = 'calls' OR line = 0"), e.filter("line <> 1")))
