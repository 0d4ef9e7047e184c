"""From source files to a resolved graph: ids, bindings, first-wins edges; kept as Parquet and rebuilt by what changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import is_copy
from quarry.operators import graph as G
from quarry.operators import joins as J
from quarry.operators import retrieval as R
from quarry.operators import search as S
from quarry.plans.cuts import cut, delete, exists, new_path
from quarry.sources.extract import extract
from quarry.sources.files import family_of

#: The layout of what is kept; another version is treated as absent.
VERSION = 2
TABLES = ("nodes", "edges", "unresolved", "records", "files")
NODE = ["id", "name", "kind", "path", "start_line", "end_line", "signature", "exported", "owner", "arity", "variadic", "results", "complexity", "generated", "copy", "doc", "body", "body_hash", "family", "ord"]


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    unresolved: DataFrame  # name, reason, n
    records: DataFrame  # what files gave, to be used again
    files: DataFrame
    index: S.Index | None = None

    def searched(self) -> S.Index:
        """The search index, made if it isn't there."""
        if self.index is None:
            spark, docs = self.nodes.sparkSession, search_docs(self.nodes)
            path = new_path(spark, "index")
            S.write_index(docs, path, S.signature_of(docs))
            self.index = S.read_index(spark, path)
        return self.index


def nodes_of(records: DataFrame) -> DataFrame:
    """Node rows with minted ids; a repeat of a name in a scope gets ``~2``, in source order."""
    rows = records.filter("record = 'node'").withColumn("ord", F.struct("path", "start_line", "end_line"))
    rows = G.mint_ids(rows, "base", ["path", "start_line", "end_line"])
    rows = rows.withColumn("copy", is_copy(F.col("path")) | F.coalesce("generated", F.lit(False)))
    rows = rows.withColumn("body_hash", F.sha2(F.concat_ws("\n", "signature", "body"), 256)).withColumn("family", family_of(F.col("path")))
    return rows.withColumn("ord", F.xxhash64("path").bitwiseAND(F.lit((1 << 40) - 1)) * 1_000_000 + F.col("start_line")).select(*NODE)


def located(folder: Column, spec: Column) -> Column:
    """A path like ``../a/b`` seen from a folder, in plain form."""
    start = F.filter(F.split(folder, "/"), lambda x: ~x.isin("", "."))
    step = lambda at, x: F.when(x == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).when(x.isin("", "."), at).otherwise(F.concat(at, F.array(x)))
    return F.array_join(F.aggregate(F.split(spec, "/"), start, step), "/")


JS_ENDS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def import_candidates() -> Column:
    """What files an import (``path``, the importing file; ``wanted``) may mean, the likeliest first; for families whose imports name
    places. Python: dots go up from the file's folder; scripts: ./ and ../; C: next to the file."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    dots = F.length(F.regexp_extract("wanted", r"^(\.*)", 1))
    up = F.expr("array_join(array_repeat('..', greatest(0, length(regexp_extract(wanted, '^([.]*)', 1)) - 1)), '/')")
    module = F.translate(F.regexp_replace("wanted", r"^\.+", ""), ".", "/")
    python = located(folder, F.concat_ws("/", up, module))
    script = located(folder, F.regexp_replace("wanted", r"\.(tsx?|jsx?|mjs|cjs)$", ""))
    beside = lambda at, ends: F.array(*[F.concat(at, F.lit(e)) for e in ends])
    none = F.array().cast("array<string>")
    return (
        F.when(F.col("path").rlike(r"\.pyi?$") & (dots > 0), beside(python, (".py", "/__init__.py", ".pyi")))
        .when((family_of(F.col("path")) == "js") & F.col("wanted").startswith("."), F.concat(F.array(located(folder, F.col("wanted"))), beside(script, JS_ENDS)))
        .when(family_of(F.col("path")) == "c", F.array(located(folder, F.col("wanted"))))
        .otherwise(none)
    )


def imports_of(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """``intent, file``: the file each import means: the first candidate that is there; a Go import's folder, by the longest end of its
    path that is one, and the smallest file in it; else the only file whose path ends as the import's name does."""
    files = nodes.filter("kind = 'file'").select("path").distinct()
    near = J.first_candidate(imports.select("intent", import_candidates().alias("c")), "intent", "c", files, "path")
    folders = files.filter(F.col("path").endswith(".go")).groupBy(F.regexp_replace("path", "/?[^/]*$", "").alias("dir")).agg(F.min("path").alias("one"))
    go = J.first_candidate(imports.filter(F.col("path").endswith(".go")).select("intent", J.path_suffixes(F.col("wanted")).alias("c")), "intent", "c", folders, "dir")
    go = go.join(folders, F.col("file") == F.col("dir")).select("intent", F.col("one").alias("file"))
    placed = near.unionByName(go)
    rest = imports.join(placed.select(F.col("intent").alias("p")), F.col("intent") == F.col("p"), "left_anti").filter(~F.col("path").endswith(".go") & ~F.col("wanted").startswith("."))
    dotted = F.col("path").rlike(r"\.(py|pyi|java|rs)$")
    tail = F.when(dotted, F.regexp_replace("wanted", r"\.|::", "/")).otherwise(F.regexp_replace("wanted", r"\.(tsx?|jsx?|mjs|cjs|h|hpp)$", ""))
    stems = files.select(F.col("path").alias("file"), F.regexp_replace(F.regexp_replace("path", r"\.\w+$", ""), r"/(__init__|index|mod)$", "").alias("stem"))
    one = stems.groupBy(F.col("stem").alias("s")).agg(F.min("file").alias("f"))
    far = J.unique_suffix(rest.select("intent", tail.alias("tail")), "tail", stems.select("stem").distinct(), "stem")
    far = far.join(one, F.col("file") == F.col("s")).select("intent", F.col("f").alias("file"))
    return placed.unionByName(far)


#: What a call may bind to by its name alone, by family.
CALLABLE = {"python": ("function", "class"), "js": ("function", "class"), "go": ("function",), "java": ("class", "struct", "enum", "interface"), "rust": ("function", "method"), "c": ("function", "method")}
#: Relations that bind by name, what they may bind to, and whether they keep the raw name of what lies outside.
NAMED = {"references": (("function", "class", "type", "method"), True), "extends": (("class", "interface", "struct"), True), "implements": (("interface", "class"), True), "writes": (("field", "variable"), False)}


def calls_of(calls: DataFrame, nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """``intent, name, target, confidence, reason`` of ``calls``: by the receiver's type and its supertypes where the type is known;
    by the package where the receiver is one; by name where there is no receiver, or the method's own object hasn't it. ``reason``
    is why a call is bound to nothing: receiver_unknown, member_ambiguous, member_not_in_graph, name_ambiguous, name_not_in_graph,
    external_package."""
    rows = calls.select("intent", "path", F.col("wanted").alias("name"), "receiver", "recv_type", "via", "args")
    typed = rows.filter("via IN ('member', 'self') AND recv_type IS NOT NULL")
    members = nodes.filter("owner IS NOT NULL AND kind IN ('method', 'function')").select("id", F.col("owner").alias("type"), F.col("name").alias("method"), F.when(~F.coalesce("variadic", F.lit(False)), F.col("arity")).cast("long").alias("arity"))
    asks = typed.select("intent", F.col("recv_type").alias("type"), F.col("name").alias("method"), F.col("args").cast("long").alias("args"))
    bound = cut(J.typed_members(asks, members, parents).select(F.col("intent").alias("b_intent"), "target", "outcome"), "typed")
    both = typed.join(bound, F.col("intent") == F.col("b_intent"), "left").drop("b_intent")
    member = both.filter("outcome IS NOT NULL OR via = 'member'")
    reason = F.when(F.col("outcome") == "ambiguous", "member_ambiguous").when(F.col("outcome").isNull(), "member_not_in_graph")
    out = member.select("intent", "name", "target", F.lit("inferred").alias("confidence"), reason.alias("reason"))
    unknown = rows.filter("via = 'member' AND recv_type IS NULL")
    none = F.lit(None).cast("string")
    out = out.unionByName(unknown.select("intent", "name", none.alias("target"), none.alias("confidence"), F.lit("receiver_unknown").alias("reason")))
    folder = F.element_at(F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/"), -1)
    family = family_of(F.col("path"))
    # a package's functions: of the folder of its name (Go), or of any file of its name
    homes = nodes.filter("kind IN ('function', 'class')").select(F.explode(F.array(folder, F.regexp_extract("path", r"([^/]+?)\.\w+$", 1))).alias("home"), F.col("name").alias("h_name"), "id").distinct()
    homes = homes.groupBy("home", "h_name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    packed = rows.filter("via = 'package'").join(homes, (F.col("receiver") == F.col("home")) & (F.col("name") == F.col("h_name")), "left")
    reason = F.when(F.col("n") > 1, "name_ambiguous").when(F.col("n").isNull(), "external_package")
    out = out.unionByName(packed.select("intent", "name", F.when(F.col("n") == 1, F.col("id")).alias("target"), F.lit("inferred").alias("confidence"), reason.alias("reason")))
    bare = rows.filter("via IS NULL OR via = 'self' AND recv_type IS NULL").unionByName(both.filter("outcome IS NULL AND via = 'self'").select(*rows.columns))
    for names, kinds in ((("go",), ("function",)), (("python", "js"), ("function", "class")), (("java",), CALLABLE["java"]), (("rust", "c"), ("function", "method"))):
        asked = bare.filter(family.isin(*names)).select("intent", "name", F.col("path").alias("file"), family.alias("family"))
        among = nodes.filter(F.col("kind").isin(*kinds)).select("id", "name", F.col("path").alias("file"), "family")
        found = J.resolve_names(asked, among)
        reason = F.when(F.col("outcome") == "ambiguous", "name_ambiguous").when(F.col("outcome") == "missing", "name_not_in_graph")
        out = out.unionByName(found.select("intent", "name", "target", F.col("outcome").alias("confidence"), reason.alias("reason")))
    return out


def implied(nodes: DataFrame) -> DataFrame:
    """``source, target, line``: Go types and the interfaces whose every method they have, and those methods, pair by pair."""
    go = nodes.filter(F.col("family") == "go")
    of = go.filter("kind = 'method'").select("owner", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), F.col("name").alias("method"), "arity", F.coalesce("variadic", F.lit(False)).alias("variadic"), "results", "exported", "id", "start_line")
    faces = go.filter("kind = 'interface'").select(F.col("name").alias("face"), F.col("id").alias("face_id"))
    asks, have = of.join(faces, F.col("owner") == F.col("face"), "left_semi"), of.join(faces, F.col("owner") == F.col("face"), "left_anti")
    pairs = cut(R.satisfied(have.drop("id", "start_line"), asks.drop("id", "start_line")), "satisfied")
    types = go.filter("kind IN ('struct', 'type')").select(F.col("name").alias("t_name"), F.col("id").alias("t_id"), "start_line")
    whole = pairs.join(types, F.col("type") == F.col("t_name")).join(faces, F.col("interface") == F.col("face")).select(F.col("t_id").alias("source"), F.col("face_id").alias("target"), F.col("start_line").alias("line"))
    own = have.select(F.col("owner").alias("type"), "method", F.col("id").alias("source"), F.col("start_line").alias("line"))
    asked = asks.select(F.col("owner").alias("interface"), "method", F.col("id").alias("target"))
    return whole.unionByName(pairs.join(own, "type").join(asked, ["interface", "method"]).select("source", "target", "line"))


def edges_of(records: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges ``source, target, relation, confidence, line, ord``; unresolved ``name, reason, n``)."""
    order = F.xxhash64("path").bitwiseAND(F.lit((1 << 40) - 1)) * 1_000_000 + F.coalesce("line", F.lit(0))
    intents = records.filter("record = 'intent'").select("path", F.col("base").alias("source"), "relation", F.col("target").alias("wanted"), "receiver", "recv_type", "via", "args", "line", order.alias("ord"))
    intents = cut(intents.withColumn("intent", F.xxhash64("source", "relation", "wanted", F.coalesce("receiver", F.lit("")), F.coalesce("args", F.lit(-1)), "line")).dropDuplicates(["intent"]), "intents")
    columns = ["source", "target", "relation", "confidence", "line", "ord"]
    edges = intents.filter("relation = 'contains'").select("source", F.col("wanted").alias("target"), "relation", F.lit("extracted").alias("confidence"), "line", "ord")
    imports = intents.filter("relation = 'imports'")
    found = imports_of(imports, nodes).select(F.col("intent").alias("i"), "file")
    imported = imports.join(found, F.col("intent") == F.col("i"), "left").withColumn("target", F.coalesce("file", "wanted")).withColumn("confidence", F.when(F.col("file").isNull(), "extracted").otherwise("inferred"))
    edges = edges.unionByName(imported.select(*columns))
    short = lambda c: F.regexp_extract(c, r"([^.#:/]+)$", 1)
    parents = intents.filter("relation IN ('extends', 'implements')").select(short(F.col("source")).alias("type"), short(F.col("wanted")).alias("parent")).distinct()
    calls = intents.filter("relation = 'calls'")
    bound = cut(calls_of(calls, nodes, parents).withColumnsRenamed({"intent": "i", "target": "t"}), "bound")
    edges = edges.unionByName(calls.join(bound.filter("t IS NOT NULL").hint("merge"), F.col("intent") == F.col("i")).select("source", F.col("t").alias("target"), "relation", "confidence", "line", "ord"))
    misses = bound.filter("t IS NULL").groupBy("name", "reason").agg(F.count(F.lit(1)).alias("n"))
    for relation, (allowed, loose) in NAMED.items():
        own = intents.filter(F.col("relation") == relation)
        asked = own.select("intent", F.element_at(F.split("wanted", r"\."), -1).alias("name"), F.col("path").alias("file"), family_of(F.col("path")).alias("family"))
        among = nodes.filter(F.col("kind").isin(*allowed)).select("id", "name", F.col("path").alias("file"), "family")
        named = J.resolve_names(asked, among).select(F.col("intent").alias("i"), "outcome", F.col("target").alias("t"))
        target = F.coalesce("t", "wanted") if loose else F.col("t")
        rows = own.join(named.hint("merge"), F.col("intent") == F.col("i"))
        edges = edges.unionByName(rows.select("source", target.alias("target"), "relation", F.col("outcome").alias("confidence"), "line", "ord").filter("target IS NOT NULL"))
    edges = edges.unionByName(implied(nodes).select("source", "target", F.lit("implements").alias("relation"), F.lit("inferred").alias("confidence"), "line", F.xxhash64("source").alias("ord")))
    return G.first_of(edges.filter("source <> target OR relation = 'calls'"), ["source", "target", "relation"], ["ord", "line"]), misses


def build(files: DataFrame, earlier: DataFrame | None = None) -> Graph:
    """The graph of ``files`` (of quarry.sources.files.scan). ``earlier``: records of a build before, with their ``hash``; files
    whose path and hash are in it are not read again."""
    keys = files.select("path", "hash")
    if earlier is not None:
        again = earlier.join(keys.withColumnsRenamed({"path": "p", "hash": "h"}), (F.col("path") == F.col("p")) & (F.col("hash") == F.col("h")), "left_semi")
        fresh = files.join(again.select("path").distinct(), "path", "left_anti")
    else:
        again, fresh = None, files
    new = extract(fresh).join(keys, "path")
    records = cut(new if again is None else new.unionByName(again.select(*new.columns)), "records")
    nodes = cut(nodes_of(records), "nodes")
    edges, misses = edges_of(records, nodes)
    return Graph(nodes, cut(edges, "edges"), cut(misses, "unresolved"), records, files)


def search_docs(nodes: DataFrame) -> DataFrame:
    """The nodes as search documents; fields, constants and variables are not ranked."""
    body = F.concat_ws("\n", "signature", "doc", "body")
    return nodes.filter(~F.col("kind").isin("field", "constant", "variable")).select("id", "name", "path", body.alias("body"), F.element_at(F.split("path", "/"), 1).alias("scope"), F.col("path").alias("file"), "copy")


def save(graph: Graph, path: str) -> None:
    """Tables below ``path/v<VERSION>``: the graph, the files with their texts, and the search index; a new build replaces an old one."""
    for name in TABLES:
        getattr(graph, name).write.mode("overwrite").parquet(f"{path}/v{VERSION}/{name}")
    docs = search_docs(graph.nodes)
    delete(graph.nodes.sparkSession, [f"{path}/v{VERSION}/index"])
    S.write_index(docs, f"{path}/v{VERSION}/index", S.signature_of(docs))


def load(spark: SparkSession, path: str) -> Graph:
    get = lambda n: spark.read.parquet(f"{path}/v{VERSION}/{n}")
    graph = Graph(*map(get, TABLES))
    # an index of other nodes, or of another version, is made anew at the first search
    graph.index = S.read_index(spark, f"{path}/v{VERSION}/index", S.signature_of(search_docs(graph.nodes))) if exists(spark, f"{path}/v{VERSION}/index/corpus") else None
    return graph


def export_json(graph: Graph, path: str) -> None:
    """One JSON document a line, nodes then edges, in their persisted order."""
    graph.nodes.drop("body").orderBy(F.expr("id COLLATE en")).write.mode("overwrite").json(f"{path}/nodes")
    graph.edges.orderBy("source", "relation", "target").write.mode("overwrite").json(f"{path}/edges")


def cards(nodes: DataFrame) -> DataFrame:
    """``path, card``: a markdown card of each file's symbols, in source order."""
    line = F.concat(F.lit("- `"), F.coalesce("signature", "name"), F.lit("` L"), F.col("start_line").cast("string"))
    rows = nodes.filter("kind <> 'file'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", line.alias("l")))).alias("x"))
    return rows.select("path", F.concat(F.lit("# "), "path", F.lit("\n\n"), F.array_join(F.transform("x", lambda s: s["l"]), "\n"), F.lit("\n")).alias("card"))
