"""Sources, text functions and the build over sources that are made from the tables, each with SQL for the same rows.

The tables hold no source code, so code is written from them: a Python module for each brand and size of parts, with a class and a
function for each part that calls another part's; log records and patches from events and line items; paths from parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import distance as D
from quarry.functions import text as X
from quarry.operators import build as B
from quarry.operators import joins as J
from quarry.operators import routes as H
from quarry.sources import extract as E
from quarry.sources import files as FS
from quarry.sources import git as V

from .registry import Registry
from .relations import Relations

R = Registry()

FOLDERS = ("src", "node_modules", ".git", "tests", "a/vendor", "lib/build", "web/testdata", "out/x", "pkg/outer", "")
ENDS = (".py", ".go", ".tsx", ".sql", ".md", "_test.go", ".H", ".spec.js", ".pb.go", ".PY")


def sql_list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


PATHS = f"paths AS (SELECT p_partkey AS id, ltrim({sql_list(FOLDERS)}[p_partkey % 10 + 1] || '/' || replace(p_name, ' ', '_') || {sql_list(ENDS)}[p_size % 10 + 1], '/') AS path FROM part)"


def paths(r: Relations) -> DataFrame:
    pick = lambda items, k: F.element_at(F.array(*map(F.lit, items)), (k + 1).cast("int"))
    path = F.concat(pick(FOLDERS, F.col("p_partkey") % 10), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), pick(ENDS, F.col("p_size") % 10))
    return r.table("part").select(F.col("p_partkey").alias("id"), F.ltrim(path, F.lit("/")).alias("path"))


_CASE = lambda k: "CASE " + " ".join(f"WHEN ends_with(lower(path), '{x[0]}') THEN '{x[k]}'" for x in FS.LANGUAGES) + " END"


@R.query(f"""WITH {PATHS}, f AS (SELECT *, string_split(path, '/') AS ps FROM paths)
SELECT id, path, len(list_filter(ps[1:len(ps) - 1], lambda x: starts_with(x, '.') OR x IN ({', '.join(f"'{x}'" for x in FS.SKIPPED if x != 'out')}))) = 0 AS listed, {_CASE(1)} AS language, {_CASE(2)} AS family,
       regexp_matches(path, '{X.COPY_PATH}') AS copy, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir FROM f""")
def source_listed(r: Relations):
    """Which paths a walk lists (``out`` is asked for), their language and family, whether they are copies, their folder."""
    c = F.col("path")
    return paths(r).select("id", "path", FS.listed(c, ("out",)).alias("listed"), FS.language_of(c).alias("language"), FS.family_of(c).alias("family"), X.is_copy(c).alias("copy"), X.directory(c).alias("dir"))


@R.query("SELECT doc_id AS id, CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN NULL ELSE sha256(text) END AS hash, CASE WHEN lang IN ('en', 'fr', 'de') THEN length(text) END AS chars FROM documents")
def source_decoded(r: Relations):
    """Documents as bytes: as they are, with a mark, as UTF-16 of either order; decoded again and hashed."""
    d = r.table("documents")
    marked = lambda mark, body: F.concat(F.unhex(F.lit(mark)), body)
    raw = (
        F.when(F.col("lang") == "en", F.encode("text", "UTF-8")).when(F.col("lang") == "fr", marked("EFBBBF", F.encode("text", "UTF-8")))
        .when(F.col("lang") == "de", marked("FFFE", F.encode("text", "UTF-16LE"))).otherwise(marked("FEFF", F.encode("text", "UTF-16BE")))
    )
    text = FS.decoded(raw)
    return d.select(F.col("doc_id").alias("id"), F.sha2(text, 256).alias("hash"), F.length(text).cast("long").alias("chars"))


@R.query("""
WITH b AS (SELECT doc_id AS path, strlen(text)::BIGINT AS size, sha256(text) AS hash FROM documents),
a AS (SELECT doc_id AS path, strlen(text) + coalesce(toxic, 0)::BIGINT AS size, CASE WHEN toxic = 1 THEN 'x' ELSE sha256(text) END AS hash
      FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id) WHERE coalesce(quality, 1) = 1
      UNION ALL SELECT -1 - item_id, strlen(text), sha256(text) FROM benchmark)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.path = b.path WHERE a.hash IS DISTINCT FROM b.hash""")
def source_changed(r: Relations):
    """Fingerprints of the documents before and after cleaning."""
    lab = r.table("labels").groupBy(F.col("doc_id").alias("l_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d, size = r.table("documents"), F.octet_length("text").cast("long")
    before = d.select(F.col("doc_id").alias("path"), size.alias("size"), F.lit(0).cast("long").alias("mtime_ms"), F.sha2("text", 256).alias("hash"))
    kept = d.join(lab, F.col("doc_id") == F.col("l_id"), "left").filter("coalesce(quality, 1) = 1")
    after = kept.select(F.col("doc_id").alias("path"), (size + F.coalesce("toxic", F.lit(0))).alias("size"), F.coalesce("toxic", F.lit(0)).cast("long").alias("mtime_ms"), F.when(F.col("toxic") == 1, "x").otherwise(F.sha2("text", 256)).alias("hash"))
    new = r.table("benchmark").select((-1 - F.col("item_id")).alias("path"), size.alias("size"), F.lit(0).cast("long").alias("mtime_ms"), F.sha2("text", 256).alias("hash"))
    return FS.changed_since(after.unionByName(new), before)


@R.query("SELECT p_partkey AS id FROM part WHERE 'parts/' || p_brand = 'parts/Brand#11' OR starts_with('parts/' || p_brand, 'parts/Brand#11/') UNION ALL SELECT o_orderkey FROM orders WHERE 'orders/' || o_orderpriority = 'orders/1-URGENT'")
def source_prefix(r: Relations):
    """Rows below a path, whole segments only."""
    p = r.table("part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("parts/"), "p_brand").alias("path"))
    o = r.table("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("orders/"), "o_orderpriority").alias("path"))
    return p.filter(X.under(F.col("path"), "parts/Brand#11")).unionByName(o.filter(X.under(F.col("path"), "/orders/1-URGENT/"))).select("id")


_SPAN = "CASE l_linenumber WHEN 7 THEN 'L' || l_partkey WHEN 6 THEN l_partkey || '-' || l_suppkey ELSE 'L' || l_partkey || '-L' || l_partkey + l_suppkey END"


@R.query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, {_SPAN} AS span FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(span, '^L\\d+-L\\d+$') THEN regexp_extract(span, '^L(\\d+)-', 1)::INT END AS a, CASE WHEN regexp_matches(span, '^L\\d+-L\\d+$') THEN regexp_extract(span, '-L(\\d+)$', 1)::INT END AS b FROM s""")
def text_spans(r: Relations):
    li = r.table("lineitem")
    a, b = F.col("l_partkey").cast("string"), (F.col("l_partkey") + F.col("l_suppkey")).cast("string")
    span = F.when(F.col("l_linenumber") == 7, F.concat(F.lit("L"), a)).when(F.col("l_linenumber") == 6, F.concat_ws("-", a, F.col("l_suppkey").cast("string"))).otherwise(F.concat(F.lit("L"), a, F.lit("-L"), b))
    lo, hi = X.span_bounds(span)
    return li.select("l_orderkey", "l_linenumber", lo.alias("a"), hi.alias("b"))


@R.query("""
WITH n AS (SELECT path || '#' || name AS base, id, row_number() OVER (PARTITION BY path, name ORDER BY id) AS k FROM (
  SELECT p_partkey AS id, 'parts/' || p_brand AS path, p_name AS name FROM part))
SELECT id, base || '.in' AS bare FROM n""")
def text_strip_ordinals(r: Relations):
    """Minted ids of members without what tells duplicates apart."""
    from quarry.operators import graph as G

    p = r.table("part").select(F.concat(F.lit("parts/"), "p_brand", F.lit("#"), "p_name").alias("base"), F.col("p_partkey").alias("id0"))
    return G.mint_ids(p, "base", ["id0"]).select(F.col("id0").alias("id"), X.strip_ordinals(F.concat("id", F.lit(".in"))).alias("bare"))


_SIG = "p_type || chr(10) || '   ' || p_name || '(' || p_size || ')' || [' {', ' =>', ':', ' = {', ''][p_size % 5 + 1]"


@R.query(f"SELECT p_partkey AS id, regexp_replace(trim(regexp_replace({_SIG}, '\\s+', ' ', 'g')), '\\s*(=>|\\{{|:|=)+\\s*$', '') AS signature FROM part")
def text_signatures(r: Relations):
    tail = F.element_at(F.array(*map(F.lit, (" {", " =>", ":", " = {", ""))), (F.col("p_size") % 5 + 1).cast("int"))
    raw = F.concat("p_type", F.lit("\n   "), "p_name", F.lit("("), F.col("p_size").cast("string"), F.lit(")"), tail)
    return r.table("part").select(F.col("p_partkey").alias("id"), X.clean_signature(raw).alias("signature"))


WORDS = "words AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part) WHERE length(w) > 2)"


def words(r: Relations) -> DataFrame:
    return r.table("part").select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("w")).filter(F.length("w") > 2).distinct()


@R.query(f"WITH {WORDS} SELECT a.w AS a, b.w AS b, least(4, damerau_levenshtein(a.w, b.w))::INT AS far FROM words a JOIN words b ON left(a.w, 1) = left(b.w, 1)")
def text_distances(r: Relations):
    """Edits between words of one first letter, 4 standing for more than 3."""
    w = words(r)
    b = w.select(F.col("w").alias("b"))
    return w.join(b, F.substring("w", 1, 1) == F.substring("b", 1, 1)).select(F.col("w").alias("a"), "b", D.osa_distance("w", "b").alias("far"))


@R.query(f"""WITH {WORDS}, d AS (SELECT w AS name, damerau_levenshtein(w, 'wigdet') AS far FROM words WHERE abs(length(w) - 6) <= 3),
ok AS (SELECT * FROM d WHERE far <= 3 AND 1 - far::DOUBLE / greatest(length(name), 6) > 0.4)
SELECT name, far::INT AS far FROM ok WHERE far = (SELECT min(far) FROM ok) ORDER BY name LIMIT 8""")
def text_suggestions(r: Relations):
    return D.suggestions(words(r).withColumnRenamed("w", "name"), "wigdet")


@R.query("""
WITH t AS (SELECT p_partkey AS id, string_split(lower(p_name), ' ') AS ws FROM part)
SELECT id, w, list_contains(ws, w) OR list_contains(ws, w || 's') OR (ends_with(w, 's') AND list_contains(ws, left(w, -1))) AS hit FROM t, (SELECT unnest(['widget', 'widgets', 'reds', 'blue']) AS w)""")
def text_plural(r: Relations):
    """Terms that a list of words holds, a plural aside."""
    t = r.table("part").select(F.col("p_partkey").alias("id"), F.split(F.lower("p_name"), " ").alias("ws"))
    return t.withColumn("w", F.explode(F.array(*map(F.lit, ("widget", "widgets", "reds", "blue"))))).select("id", "w", X.plural_match(F.col("ws"), F.col("w")).alias("hit"))


_MAIL = "CASE c_nationkey % 4 WHEN 0 THEN c_custkey || '+user-' || c_custkey || '@users.noreply.github.com' WHEN 1 THEN 'c' || c_custkey || '@users.noreply.github.com' WHEN 2 THEN 'c_' || c_custkey || '@users.noreply.github.com' ELSE 'c@x.org' END"
_BOT = "c_mktsegment = 'BUILDING'"


@R.query(f"""SELECT c_custkey AS id, nullif(regexp_extract({_MAIL}, '{V.NOREPLY}', 1), '') AS handle, {_BOT} AS bot FROM customer""")
def history_handles(r: Relations):
    """Handles in no-reply addresses; names of bots (a segment's customers play them)."""
    from quarry.operators.analysis import is_bot

    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey") % 4
    mail = F.when(n == 0, F.concat(k, F.lit("+user-"), k, F.lit("@users.noreply.github.com"))).when(n == 1, F.concat(F.lit("c"), k, F.lit("@users.noreply.github.com"))).when(n == 2, F.concat(F.lit("c_"), k, F.lit("@users.noreply.github.com"))).otherwise("c@x.org")
    name = F.when(F.col("c_mktsegment") == "BUILDING", "renovate[bot]").otherwise(F.col("c_name"))
    return r.table("customer").select(F.col("c_custkey").alias("id"), V.handle(mail).alias("handle"), is_bot(name, mail).alias("bot"))


@R.query("""
WITH e AS (SELECT event_id, floor((max(epoch_ms(ts)) OVER () - epoch_ms(ts)) / 86400000.0)::BIGINT AS d FROM events)
SELECT event_id, CASE WHEN d < 1 THEN 'today' WHEN d < 2 THEN 'yesterday' WHEN d < 30 THEN d || 'd ago' WHEN d < 365 THEN d // 30 || 'mo ago' ELSE d // 365 || 'y ago' END AS since FROM e""")
def history_since(r: Relations):
    e = r.table("events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    now = e.agg(F.max("at_ms")).first()[0] or 0
    return e.select("event_id", V.since_label(F.col("at_ms"), now).alias("since"))


LOG = "log AS (SELECT 'h' || user_id || '-' || date_part('epoch', date_trunc('day', ts))::BIGINT AS hash, user_id, date_trunc('day', ts) AS day, event_type FROM events)"


@R.query(f"WITH {LOG} SELECT DISTINCT hash, epoch_ms(day) AS at_ms, 'user ' || user_id AS name, user_id || '@x.org' AS email, event_type AS path FROM log")
def history_log(r: Relations):
    """Commits, a person's day each, written as a log prints them and parsed again."""
    e = r.table("events").withColumn("day", F.date_trunc("day", F.col("ts").cast("timestamp")))
    c = e.groupBy("user_id", "day").agg(F.array_sort(F.collect_set("event_type")).alias("paths"))
    user = F.col("user_id").cast("string")
    head = F.concat_ws("\x1f", F.concat(F.lit("h"), user, F.lit("-"), F.unix_seconds("day").cast("string")), F.date_format("day", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.concat(F.lit("user "), user), F.concat(user, F.lit("@x.org")))
    return V.parse_log(c.select(F.concat(head, F.lit("\n\n"), F.array_join("paths", "\n")).alias("record")))


@R.query("""
WITH h AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS a, (l_quantity::BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS k FROM lineitem)
SELECT 'o/é ' || o AS path, CASE WHEN min(n) OVER (PARTITION BY o) = 2 THEN 'added' ELSE 'modified' END AS status, k AS range_id, a AS start, a + greatest(q, 1) - 1 AS "end", least(q, 24, greatest(0, 200 - coalesce(sum(q + 1) OVER (PARTITION BY o ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::INT AS kept FROM h""")
def diff_ranges(r: Relations):
    """Patches, an order each, its items as hunks of so many added lines; parsed again."""
    li = r.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q"))
    lines = F.when(F.col("q") > 0, F.concat(F.lit("\n"), F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("q"), F.lit(1))), lambda i: F.concat(F.lit("+line "), i.cast("string"))), "\n"))).otherwise("")
    hunk = F.concat(F.lit("@@ -0,0 +"), F.col("l_partkey").cast("string"), F.lit(","), F.col("q").cast("string"), F.lit(" @@"), lines, F.lit("\n-old"))
    orders = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "q", hunk.alias("h")))).alias("hs"), F.min("l_linenumber").alias("first"))
    name = F.concat(F.lit('"b/o/\\303\\251 '), F.col("l_orderkey").cast("string"), F.lit('"'))
    old = F.when(F.col("first") == 2, "/dev/null").otherwise(F.replace(name, F.lit('"b/'), F.lit('"a/')))
    text = F.concat(F.lit("diff --git x y\n--- "), old, F.lit("\n+++ "), name, F.lit("\n"), F.array_join(F.transform("hs", lambda x: x["h"]), "\n"))
    return V.patches(orders.select(text.alias("patch"))).select("path", "status", "range_id", "start", "end", F.size("added").alias("kept"))


def modules(r: Relations) -> DataFrame:
    """``path, text, hash``: a module for each brand and size of parts."""
    p = r.table("part")
    k = F.col("p_partkey").cast("string")
    called = F.concat(F.lit("part_"), (F.col("p_partkey") * 7 + 3).cast("string"))
    body = F.when(F.col("p_retailprice") > 1000, F.concat(called, F.lit("(a) if a else b"))).otherwise(F.concat(called, F.lit("(a)")))
    text = F.concat(F.lit("# makes "), "p_name", F.lit("\ndef part_"), k, F.lit("(a, b=0):\n    return "), body, F.lit("\n\n\n"))
    own = p.groupBy("p_brand", "p_size").agg(F.array_sort(F.collect_list(F.struct("p_partkey", text.alias("t")))).alias("x"))
    stem = F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("_"), F.col("p_size").cast("string"))
    head = F.concat(F.lit("class Shelf_"), stem, F.lit("(Shelf):\n    def own(self, a):\n        return self.own(a)\n\n\n"))
    whole = F.concat(head, F.array_join(F.transform("x", lambda s: s["t"]), ""))
    return own.select(F.concat(F.lit("src/"), stem, F.lit(".py")).alias("path"), whole.alias("text")).withColumn("hash", F.sha2("text", 256))


MODULES = """fn AS (SELECT *, lower(replace(p_brand, '#', '_')) || '_' || p_size AS stem, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS i FROM part),
file AS (SELECT stem, 'src/' || stem || '.py' AS path, count(*) AS n FROM fn GROUP BY stem),
node AS (
  SELECT path AS id, stem || '.py' AS name, 'file' AS kind, path, 1 AS start_line, 6 + 5 * n AS end_line, NULL::VARCHAR AS signature, NULL::INT AS arity, NULL::INT AS complexity, NULL::VARCHAR AS doc, NULL::VARCHAR AS owner FROM file
  UNION ALL SELECT path || '#Shelf_' || stem, 'Shelf_' || stem, 'class', path, 1, 3, 'class Shelf_' || stem || '(Shelf)', NULL, NULL, NULL, NULL FROM file
  UNION ALL SELECT path || '#Shelf_' || stem || '.own', 'own', 'method', path, 2, 3, 'def own(self, a)', 1, 1, NULL, 'Shelf_' || stem FROM file
  UNION ALL SELECT 'src/' || stem || '.py#part_' || p_partkey, 'part_' || p_partkey, 'function', 'src/' || stem || '.py', (2 + 5 * i)::INT, (3 + 5 * i)::INT, 'def part_' || p_partkey || '(a, b=0)', 2, 1 + (p_retailprice > 1000)::INT, 'makes ' || p_name, NULL FROM fn)"""


def built(r: Relations) -> tuple[DataFrame, DataFrame]:
    records = B.cut(E.extract(modules(r)), "made_records")
    return records, B.cut(B.nodes_of(records), "made_nodes")


@R.query(f"WITH {MODULES} SELECT id, name, kind, path, start_line, end_line, signature, arity, complexity, doc, owner FROM node")
def build_nodes(r: Relations):
    """Definitions extracted from the modules, with their ids, lines, signatures, arities, branches and comments."""
    return built(r)[1].select("id", "name", "kind", "path", "start_line", "end_line", "signature", "arity", "complexity", "doc", "owner")


@R.query(f"""WITH {MODULES}
SELECT path AS source, path || '#Shelf_' || stem AS target, 'contains' AS relation, 'extracted' AS confidence FROM file
UNION ALL SELECT path || '#Shelf_' || stem, path || '#Shelf_' || stem || '.own', 'contains', 'extracted' FROM file
UNION ALL SELECT 'src/' || stem || '.py', 'src/' || stem || '.py#part_' || p_partkey, 'contains', 'extracted' FROM fn
UNION ALL SELECT path || '#Shelf_' || stem, 'Shelf', 'extends', 'missing' FROM file
UNION ALL SELECT path || '#Shelf_' || stem || '.own', path || '#Shelf_' || stem || '.own', 'calls', 'inferred' FROM file
UNION ALL SELECT 'src/' || a.stem || '.py#part_' || a.p_partkey, 'src/' || b.stem || '.py#part_' || b.p_partkey, 'calls', CASE WHEN a.stem = b.stem THEN 'extracted' ELSE 'inferred' END FROM fn a JOIN fn b ON b.p_partkey = a.p_partkey * 7 + 3""")
def build_edges(r: Relations):
    """Edges resolved: containment, a supertype outside, calls on the own object, calls by name within and across modules."""
    records, nodes = built(r)
    return B.edges_of(records, nodes)[0].select("source", "target", "relation", "confidence")


@R.query(f"WITH {MODULES} SELECT 'part_' || p_partkey * 7 + 3 AS name, 'name_not_in_graph' AS reason, count(*) AS n FROM fn WHERE p_partkey * 7 + 3 NOT IN (SELECT p_partkey FROM part) GROUP BY ALL".replace("p_partkey * 7 + 3 AS name", "(p_partkey * 7 + 3) AS name"))
def build_unresolved(r: Relations):
    """Calls that bind to nothing, by name and reason."""
    records, nodes = built(r)
    return B.edges_of(records, nodes)[1]


@R.query(f"""WITH {MODULES}, l AS (SELECT path, start_line, '- `' || coalesce(signature, name) || '` L' || start_line AS l FROM node WHERE kind <> 'file')
SELECT path, '# ' || path || chr(10) || chr(10) || string_agg(l, chr(10) ORDER BY start_line) || chr(10) AS card FROM l GROUP BY path""")
def build_cards(r: Relations):
    return B.cards(built(r)[1])


@R.query(f"WITH {MODULES} SELECT owner AS type, path, count(*) AS methods, min(id) AS first FROM node WHERE owner IS NOT NULL GROUP BY owner, path")
def join_type_methods(r: Relations):
    """Types with their methods, within a file."""
    return J.type_methods(built(r)[1])


VERBS = ("get", "post", "put", "delete")


@R.query(f"""WITH f AS (SELECT *, 'web/' || replace(lower(p_brand), '#', '_') || '_' || p_size || '.py' AS file, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS i FROM part)
SELECT CASE WHEN p_partkey % 5 = 4 THEN 'ANY' ELSE upper({sql_list(VERBS)}[p_partkey % 5 + 1]) END AS method, '/shop/parts/' || p_partkey AS path, file, (2 + 4 * (i - 1))::INT AS line, file || '#show_' || p_partkey AS handler FROM f""")
def routes_declared(r: Relations):
    """Routes that decorators declare below a router's prefix, a module for each brand and size, with the functions below them."""
    p, k = r.table("part"), F.col("p_partkey").cast("string")
    verb = F.when(F.col("p_partkey") % 5 == 4, "route").otherwise(F.element_at(F.array(*map(F.lit, VERBS)), (F.col("p_partkey") % 5 + 1).cast("int")))
    text = F.concat(F.lit("@app."), verb, F.lit("('parts//"), k, F.lit("')\ndef show_"), k, F.lit("():\n    return 1\n\n"))
    own = p.groupBy("p_brand", "p_size").agg(F.array_sort(F.collect_list(F.struct("p_partkey", text.alias("t")))).alias("x"))
    path = F.concat(F.lit("web/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")), F.lit("_"), F.col("p_size").cast("string"), F.lit(".py"))
    files = B.cut(own.select(path.alias("path"), F.concat(F.lit("app = APIRouter(tags=[], prefix='/shop')\n"), F.array_join(F.transform("x", lambda s: s["t"]), "")).alias("text"), F.lit("python").alias("family")), "web")
    return H.routes(files, B.cut(B.nodes_of(E.extract(files)), "web_nodes")).select("method", "path", "file", F.col("line").cast("int").alias("line"), "handler")


@R.query("""
WITH c AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer)
SELECT c_nationkey AS nation, list_distinct(['a', 'b'] || list(c_mktsegment ORDER BY c_mktsegment)) AS names FROM customer GROUP BY c_nationkey""".replace("list_distinct(['a', 'b'] || list(c_mktsegment ORDER BY c_mktsegment)) AS names", "array_to_string(list_sort(list_distinct(['a', 'BUILDING'] || list(c_mktsegment))), ',') AS names"))
def set_append_unique(r: Relations):
    """A list with what it lacks of another put behind it."""
    c = r.table("customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.collect_set("c_mktsegment").alias("more"))
    return c.select("nation", F.array_join(F.array_sort(X.append_unique(F.array(F.lit("a"), F.lit("BUILDING")), F.col("more"))), ",").alias("names"))


@R.query("SELECT id, array_to_string([array_to_string(ps[1:len(ps) - i], '/') for i in range(0, len(ps) + 1)], '|') AS prefixes, array_to_string([array_to_string(ps[i:], '/') for i in range(1, len(ps) + 1)], '|') AS suffixes FROM (SELECT id, string_split(path, '/') AS ps FROM paths)".join((f"WITH {PATHS} ", "")))
def text_path_parts(r: Relations):
    """A path and the folders above it; its ends."""
    return paths(r).select("id", F.array_join(J.path_prefixes(F.col("path")), "|").alias("prefixes"), F.array_join(J.path_suffixes(F.col("path")), "|").alias("suffixes"))


@R.query(f"""WITH {PATHS}, t AS (SELECT id, path, [p_size % 2, p_size % 3, 0][p_size % 3 + 1] AS up, p_name FROM paths JOIN part ON id = p_partkey),
d AS (SELECT *, string_split(CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END, '/') AS ps FROM t), f AS (SELECT *, list_filter(ps, lambda x: x <> '') AS fs FROM d)
SELECT id, array_to_string(fs[1:greatest(0, len(fs) - up)] || ['x', 'y.py'], '/') AS place FROM f""")
def text_located(r: Relations):
    """Places seen from a file's folder: steps up, steps that stay, doubled slashes."""
    p = r.table("part").select(F.col("p_partkey").alias("k"), "p_size")
    up = F.element_at(F.array(F.col("p_size") % 2, F.col("p_size") % 3, F.lit(0)), (F.col("p_size") % 3 + 1).cast("int"))
    spec = F.concat(F.expr("repeat('../', 0)"), F.repeat(F.lit("../"), up.cast("int")), F.lit("./x//y.py"))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    return paths(r).join(p, F.col("id") == F.col("k")).select("id", B.located(folder, spec).alias("place"))


MARKED = f"marked AS (SELECT p_partkey AS id, ltrim({sql_list(('', 'app', 'app/web', 'lib/core', 'lib/core/deep', 'svc'))}[p_partkey % 6 + 1] || '/' || {sql_list(('package.json', 'go.mod', 'readme.md', 'setup.py', 'x.py'))}[p_size % 5 + 1], '/') AS path FROM part)"


@R.query(f"""WITH {MARKED}, m AS (SELECT DISTINCT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS prefix, regexp_extract(path, '([^/]+)$', 1) AS mark FROM marked),
k AS (SELECT prefix, string_agg(mark, ',' ORDER BY list_position(['package.json', 'go.mod', 'setup.py'], mark)) AS markers FROM m WHERE mark IN ('package.json', 'go.mod', 'setup.py') AND len(string_split(prefix, '/')) <= 2 GROUP BY prefix)
SELECT prefix, markers FROM k WHERE NOT contains(prefix, '/') OR split_part(prefix, '/', 1) NOT IN (SELECT prefix FROM k)""")
def source_scopes(r: Relations):
    """Sub-projects by their marks, at most two folders deep, none below another."""
    from quarry.sources import scopes

    pick = lambda items, k: F.element_at(F.array(*map(F.lit, items)), (k + 1).cast("int"))
    path = F.concat(pick(("", "app", "app/web", "lib/core", "lib/core/deep", "svc"), F.col("p_partkey") % 6), F.lit("/"), pick(("package.json", "go.mod", "readme.md", "setup.py", "x.py"), F.col("p_size") % 5))
    files = r.table("part").select(F.ltrim(path, F.lit("/")).alias("path"))
    return scopes.discover(files).select("prefix", F.array_join("markers", ",").alias("markers"))


@R.query(f"WITH {PATHS} SELECT id, regexp_matches(path, '{X.TEST_PATH}') AS test, lower(regexp_extract(replace(p_name, ' ', '.'), '([^.]*)$', 1)) IN ('widget', 'find', 'the', 'gadget', 'x') AS named FROM paths JOIN part ON id = p_partkey")
def text_test_paths(r: Relations):
    """Paths of tests, by the rule for changes; names that a question names."""
    p = r.table("part").select(F.col("p_partkey").alias("k"), F.replace("p_name", F.lit(" "), F.lit(".")).alias("name"))
    return paths(r).join(p, F.col("id") == F.col("k")).select("id", X.is_test(F.col("path")).alias("test"), X.names_hit(F.col("name"), "find the Widget, gadget-x").alias("named"))


@R.query(f"""WITH {MODULES}, e AS (SELECT a.stem, a.p_partkey AS k, a.i, b.p_partkey AS b, b.stem AS bs, a.p_retailprice FROM fn a JOIN fn b ON b.p_partkey = a.p_partkey * 7 + 3)
SELECT 'src/' || stem || '.py#part_' || k AS source, 'src/' || bs || '.py#part_' || b AS target, 'calls' AS relation, (3 + 5 * i)::BIGINT AS at, '    return part_' || b || CASE WHEN p_retailprice > 1000 THEN '(a) if a else b' ELSE '(a)' END AS quote FROM e""")
def build_quotes(r: Relations):
    """The line behind each call by name: of every second edge's own line, of the others the first in the span that has the name."""
    from quarry.operators import flows

    records, nodes = built(r)
    edges = B.edges_of(records, nodes)[0].filter("relation = 'calls'").join(nodes.filter("kind = 'function'").select(F.col("id").alias("f_id")).hint("merge"), F.col("target") == F.col("f_id"), "left_semi")
    edges = edges.withColumn("line", F.when(F.col("line") % 2 == 0, F.col("line")).otherwise(0))
    lines = modules(r).select("path", F.posexplode(F.split("text", "\n")).alias("k", "text")).select("path", (F.col("k") + 1).alias("line"), "text")
    return flows.quote_lines(edges, nodes, lines)


@R.query(f"""WITH {MODULES}, c AS (SELECT a.p_partkey * 7 + 3 AS b FROM fn a)
SELECT 'src/' || stem || '.py#part_' || p_partkey AS id, n AS n_calls, n AS n_callers, 0::BIGINT AS n_references, 0::BIGINT AS untyped, 0::BIGINT AS ambiguous, true AS exact
FROM (SELECT *, (SELECT count(*) FROM c WHERE b = p_partkey) AS n FROM fn)
UNION ALL SELECT path || '#Shelf_' || stem || '.own', 1, 1, 0, 0, 0, true FROM file""")
def build_caller_bounds(r: Relations):
    """How sure each callable's list of callers is."""
    from quarry.operators import graph as G

    records, nodes = built(r)
    edges, misses = B.edges_of(records, nodes)
    return G.caller_bound(edges, nodes, misses)
