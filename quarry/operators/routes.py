"""HTTP routes declared in source text: Go muxes, Python decorators and Django paths, Express, Nest and Spring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.joins import around

#: A cheap test for files that may declare routes, and the methods that names of calls, decorators and annotations stand for
#: (fixed values).
CANDIDATE = r"(?i)(get|post|put|patch|delete|head|options|connect|trace|all|any|add|route|handle(func)?|method(func)?|mapping|path)\s*\("
VERBS = "get post put patch delete head options connect trace"
#: language families -> patterns of (method, path, handler)
SHAPES = {
    "go": r"""\.(Get|Post|Put|Patch|Delete|Head|Options|Connect|Trace|GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|Handle|HandleFunc|Any|All)\(\s*["`]([^"`]*)["`]\s*,\s*([\w.]+)?""",
    "python": r"""(?:@\w+(?:\.\w+)*\.(get|post|put|patch|delete|head|options|route)|\b(path|re_path))\(\s*r?["']([^"']*)["']\s*(?:,\s*([\w.]+))?""",
    "js": r"""(?:\b(?:app|router|server|api)\.(get|post|put|patch|delete|head|options|all)|@(Get|Post|Put|Patch|Delete|Head|Options|All))\(\s*(?:["'`]([^"'`]*)["'`])?\s*(?:,\s*([\w.]+))?""",
    "java": r"""@(Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*"([^"]*)"()""",
}


#: What gives a router or a group of routes its own prefix, by family: (pattern, group of its name, group of the prefix, of its parent).
PREFIXES = {
    "python": (r"""(\w+)\s*=\s*(?:\w+\.)*(?:APIRouter|Blueprint|Router)\(.*?prefix\s*=\s*["']([^"']*)["']()""", 1, 2, 3),
    "go": (r"""(\w+)\s*:?=\s*(\w+)\.(?:Group|Route|PathPrefix)\(\s*"([^"]*)\"""", 1, 3, 2),
    "js": (r"""\.use\(\s*["'`]([^"'`]*)["'`]\s*,\s*(\w+)()""", 2, 1, 3),
}
#: Groups within groups are followed so deep.
NESTED = 3


def prefixes(lines: DataFrame) -> DataFrame:
    """``p_file, p_name, prefix``: what routers and groups of ``lines (file, family, t)`` put before their routes."""
    out = None
    for family, (pattern, name, prefix, parent) in PREFIXES.items():
        own = lines.filter((F.col("family") == family) & F.col("t").rlike(pattern))
        got = lambda k, p=pattern: F.regexp_extract("t", p, k)
        rows = own.select(F.col("file").alias("p_file"), got(name).alias("p_name"), got(prefix).alias("prefix"), got(parent).alias("parent"))
        out = rows if out is None else out.unionByName(rows)
    out = out.groupBy("p_file", "p_name").agg(F.min(F.struct("prefix", "parent")).alias("b")).select("p_file", "p_name", "b.*")
    up = out.select(F.col("p_file").alias("u_file"), F.col("p_name").alias("u_name"), F.col("prefix").alias("u_prefix"), F.col("parent").alias("u_parent"))
    for _ in range(NESTED - 1):
        out = out.join(up, (F.col("p_file") == F.col("u_file")) & (F.col("parent") == F.col("u_name")) & (F.col("parent") != F.col("p_name")), "left")
        out = out.select("p_file", "p_name", F.concat_ws("/", "u_prefix", "prefix").alias("prefix"), F.coalesce("u_parent", F.lit("")).alias("parent"))
    return out.drop("parent")


def joined(*parts):
    """One path with single slashes."""
    return F.regexp_replace(F.concat(F.lit("/"), F.concat_ws("/", *parts)), "/+", "/")


def routes(files: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``method, path, file, line, handler_text, handler`` of ``files (path, text, family)``; the handler is the one function or
    method of the name in the route's folder of ``nodes (id, name, kind, path)``, else the next symbol below a decorator."""
    may = files.filter(F.col("text").rlike(CANDIDATE))  # files without a route have no use for a prefix
    lines = may.select(F.col("path").alias("file"), "family", F.posexplode(F.split("text", "\n")).alias("k", "t")).withColumn("line", F.col("k") + 1)
    out = None
    for family, pattern in SHAPES.items():
        own = lines.filter((F.col("family") == family) & F.col("t").rlike(pattern))
        get = lambda *i, p=pattern: F.coalesce(*[F.nullif(F.regexp_extract("t", p, n), F.lit("")) for n in i])
        if family == "go":
            word, path, handler = get(1), get(2), get(3)
        elif family == "java":
            word, path, handler = get(1), get(2), F.lit(None).cast("string")
        else:
            word, path, handler = get(1, 2), F.regexp_extract("t", pattern, 3), get(4)
        rows = own.select(F.lower(word).alias("word"), F.coalesce(path, F.lit("")).alias("raw"), handler.alias("handler_text"), "file", "line", F.col("t").contains("@").alias("above"), F.regexp_extract("t", r"(\w+)\.\w+\(", 1).alias("router"))
        out = rows if out is None else out.unionByName(rows)
    # a mux pattern may hold its method: "GET /items"
    held = F.upper(F.regexp_extract("raw", r"^([A-Z]+)\s+/", 1))
    method = F.when(held != "", held).when(F.col("word").isin(*VERBS.split()), F.upper("word")).otherwise("ANY")
    before = prefixes(lines)
    out = out.join(before, (F.col("file") == F.col("p_file")) & (F.col("router") == F.col("p_name")), "left")
    found = out.select(method.alias("method"), joined("prefix", F.regexp_replace("raw", r"^[A-Z]+\s+", "")).alias("path"), "file", "line", "handler_text", "above")
    if nodes is None:
        return found.drop("above")
    folder = lambda c: F.regexp_replace(c, "[^/]*$", "")
    callables = nodes.filter(F.col("kind").isin("function", "method"))
    names = callables.groupBy(folder(F.col("path")).alias("dir"), F.col("name").alias("n")).agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("one")).filter("k = 1")
    found = found.join(names, (folder(F.col("file")) == F.col("dir")) & (F.element_at(F.split("handler_text", r"\."), -1) == F.col("n")), "left")
    # a decorator's handler is the symbol whose span holds its line, the innermost
    spans = callables.select(F.col("path").alias("file"), F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.col("id").alias("span_id"))
    below = around(found.filter("above").select("file", "line").distinct(), spans, "file", "line", 64)
    below = below.groupBy(F.col("file").alias("b_file"), F.col("line").alias("b_line")).agg(F.max(F.struct("s_start", "span_id")).alias("b"))
    found = found.join(below, (F.col("file") == F.col("b_file")) & (F.col("line") == F.col("b_line")), "left")
    return found.select("method", "path", "file", "line", "handler_text", F.coalesce("b.span_id", "one").alias("handler"))
