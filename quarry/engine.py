"""The engine's methods over a built graph: one for each command of the survey's API table."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.distance import suggestions
from quarry.functions.text import asks_for_tests, directory, query_terms, under
from quarry.operators import analysis as A
from quarry.operators import build as B
from quarry.operators import graph as G
from quarry.operators import joins as J
from quarry.operators import retrieval as T
from quarry.operators import routes as H
from quarry.operators import search as S
from quarry.plans.cuts import cut
from quarry.sources import files as FS


#: What asks for uses of a symbol, what for the things it uses, the relations that either answers with, and what
#: parts a question's words.
INCOMING = r"\b(caller|callers|calls?\s+into|who\s+calls|what\s+calls|called\s+by|used\s+by|uses)\b"
OUTGOING = r"\b(callee|callees|what\s+does\s+\w+\s+call|calls\s+what|imports?|depends\s+on)\b"
ANSWERS = ("calls", "references", "implements", "extends")
SEPARATOR = r"[^A-Za-z0-9_.]+"
#: Candidates that an ambiguous selector lists, and lines of a definition that is shown whole.
LISTED, WHOLE_LINES = 8, 220


def subject_words(query: str) -> list[str]:
    """The distinct words of a question that may name its subject, longest first."""
    return sorted(dict.fromkeys(w for w in re.split(SEPARATOR, query) if w), key=lambda w: -len(w))


class Engine:
    def __init__(self, spark: SparkSession, graph: B.Graph):
        self.spark, self.graph = spark, graph

    @classmethod
    def build(cls, spark: SparkSession, root: str, **options) -> Engine:
        return cls(spark, B.build(FS.scan(spark, root, **options)))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Engine:
        return cls(spark, B.load(spark, path))

    def refresh(self, root: str, **options) -> Engine:
        """Build again; only files whose text changed are read."""
        return Engine(self.spark, B.build(FS.scan(self.spark, root, **options), self.graph.records))

    def below(self, prefix: str = "") -> DataFrame:
        """The nodes under a path; a prefix that holds none is an error."""
        nodes = self.graph.nodes.filter(under(F.col("path"), prefix))
        if prefix and nodes.isEmpty():
            raise ValueError(f"nothing is indexed under {prefix}")
        return nodes

    def save(self, path: str) -> None:
        B.save(self.graph, path)

    def ask(self, query: str, n: int = 8, prefix: str = "", graph_rank: bool = True) -> DataFrame:
        """``id, file, score``. A question for the uses of a symbol, or for what it uses, is answered by its edges, ``score`` 1; any
        other, or one whose subject isn't found, by ranked search."""
        if re.search(INCOMING, query) or re.search(OUTGOING, query):
            found = self.edges_about(query, n, prefix)
            if found is not None:
                return found
        return self.search(query, n, prefix, graph_rank)

    def edges_about(self, query: str, n: int, prefix: str = "") -> DataFrame | None:
        """The other ends of the subject's edges, by place; None if no word of the question names a symbol that has any."""
        nodes, incoming = self.below(prefix), bool(re.search(INCOMING, query))
        relations = ANSWERS if incoming else (*ANSWERS, "imports")
        for word in subject_words(query):  # a question's few words
            seeds = cut(G.resolve_symbol(nodes, word).select("id"), "subject")
            if not seeds.isEmpty():
                near = G.neighbours(self.graph.edges.filter(F.col("relation").isin(*relations)), self.graph.nodes, seeds, incoming)
                rows = near.groupBy(F.col("other").alias("id"), "relation").agg(F.min("path").alias("file"))
                out = rows.select("id", "file", F.lit(1.0).alias("score"), "relation").orderBy(F.expr("coalesce(file, id) COLLATE en"), "id", "relation").limit(n)
                return None if out.isEmpty() else out
        return None

    def search(self, query: str, n: int = 8, prefix: str = "", graph_rank: bool = True) -> DataFrame:
        """Lexical scores of scopes that take part, blended with personalised PageRank seeded by them; a file's hits are pooled into
        its anchor, and of the files' queues each choice decays the next: at most ``n``. Edges that write, or use a type only,
        carry no rank."""
        index = self.graph.searched()
        lexical = S.scored(index, query, asks_for_tests(query, prefix))
        if prefix:
            lexical = lexical.join(self.below(prefix).select(F.col("id").alias("b_id")), F.col("id") == F.col("b_id"), "left_semi")
        lexical = cut(lexical, "ask_lexical")
        gate = S.scope_gate(lexical.select("scope", F.col("lexical").alias("score"))).filter("takes_part").select("scope")
        lexical = lexical.join(F.broadcast(gate), "scope", "left_semi")  # a row a scope
        rank = self.spark.createDataFrame([], "id string, rank double")
        if graph_rank and not lexical.isEmpty():
            rank = G.pagerank(G.ranking_edges(self.graph.edges, self.graph.nodes), lexical.select("id", F.col("lexical").alias("weight")))
            rank = rank.join(index.docs.select(F.col("id").alias("d_id")), F.col("id") == F.col("d_id"), "left_semi")
        hits = cut(S.blended(lexical.select("id", "lexical"), rank, index.docs.select("id", "copy")).join(index.docs.select("id", "file"), "id"), "ask_hits")
        idf = self.spark.createDataFrame(list(S.idf_of(index, query_terms(query)).items()), "term string, idf double")
        top = lexical.agg(F.max("lexical").alias("top"))
        mine = lexical.join(F.broadcast(top)).select("id", "file", (F.col("lexical") / F.col("top")).alias("lex"), "coverage", "copy").join(rank, "id", "left")
        pooled = T.pooled_files(mine, S.postings_of(index, query_terms(query)).select("id", "term"), idf).select(F.col("id").alias("p_id"), "pooled")
        hits = hits.join(pooled, F.col("id") == F.col("p_id"), "left").select("id", "file", F.greatest("score", F.coalesce("pooled", F.lit(0.0))).alias("score"))
        return S.decayed(hits, n).orderBy("place").select("id", "file", "score")

    def resolve(self, symbol: str) -> DataFrame:
        found = G.resolve_symbol(self.graph.nodes, symbol)
        if found.isEmpty():
            near = [r["name"] for r in suggestions(self.graph.nodes, symbol).collect()]  # a handful of names
            raise ValueError(f"no symbol {symbol}" + (f"; did you mean {', '.join(near)}?" if near else ""))
        return found

    def walk(self, symbol: str, direction: str = "in", depth: int = 1) -> DataFrame:
        seeds = self.resolve(symbol).select("id")
        if depth <= 1:
            return G.neighbours(self.graph.edges, self.graph.nodes, seeds, direction == "in")
        return G.impact(self.graph.edges, seeds, depth, direction == "in")

    def path(self, a: str, b: str, depth: int = 10) -> list[str]:
        return G.shortest_path(self.graph.edges, self.resolve(a).select("id"), self.resolve(b).select("id"), depth)

    def select(self, selector: str) -> DataFrame:
        """The definition that an id, a name, a dotted name, or ``path::`` before one of these names. Of several one is taken if it is
        the only one that is no copy, or the one with the most uses; else the error lists the first ``LISTED``."""
        own = self.graph.nodes.filter("kind <> 'file'").withColumn("dotted", F.substring_index("id", "#", -1))
        names = lambda x: (F.col("id") == x) | (F.col("name") == x) | (F.col("dotted") == x) | (F.concat_ws("::", "path", "name") == x) | (F.concat_ws("::", "path", "dotted") == x)
        found = own.filter(names(selector))
        if "::" in selector and found.isEmpty():  # the path doesn't hold it: by name
            found = own.filter(names(selector.rpartition("::")[2]))
        used = G.in_degree(self.graph.edges).select(F.col("id").alias("d_id"), "in_degree")
        ranked = found.join(used, F.col("id") == F.col("d_id"), "left").select("id", "copy", F.coalesce("in_degree", F.lit(0)).alias("uses")).orderBy("copy", F.desc("uses"), "id")
        best = ranked.limit(LISTED + 1).collect()
        if not best:
            near = [r["name"] for r in suggestions(self.graph.nodes, selector.rpartition("::")[2]).collect()]
            raise ValueError(f"no definition {selector}" + (f"; did you mean {', '.join(near)}?" if near else ""))
        main = [r for r in best if not r["copy"]] or best
        if len(best) > 1 and len(main) > 1 and (main is best and best[0]["copy"] or main[0]["uses"] == main[1]["uses"]):
            raise ValueError(f"{selector} is ambiguous: " + ", ".join(sorted(r["id"] for r in best[:LISTED])))
        return own.filter(F.col("id") == main[0]["id"]).drop("dotted")

    def read(self, selector: str, now: DataFrame | None = None, lines: int = WHOLE_LINES) -> DataFrame:
        """``id, path, start_line, end_line, code`` of what ``selector`` selects. ``now (path, hash)``: the files as they are, say of a
        new scan; a file that has changed since the build, or is gone, is an error. A definition of more than ``lines`` lines gives
        those, with the members' signatures in the place of the rest."""
        own = cut(self.select(selector).select("id", "path", "start_line", "end_line"), "selected")
        files = self.graph.files.join(F.broadcast(own.select(F.col("path").alias("o_path"))), F.col("path") == F.col("o_path"), "left_semi")
        if now is not None:
            same = files.join(now.select(F.col("path").alias("n_path"), F.col("hash").alias("n_hash")), (F.col("path") == F.col("n_path")) & (F.col("hash") == F.col("n_hash")), "left_semi")
            if same.isEmpty():
                raise ValueError(f"the file of {selector} has changed since it was indexed")
        text = files.select(F.col("path").alias("f_path"), F.split("text", "\n").alias("lines"))
        shown = F.least(F.col("end_line") - F.col("start_line") + 1, F.lit(lines))
        rows = own.join(text, F.col("path") == F.col("f_path")).withColumn("code", F.array_join(F.slice("lines", F.col("start_line"), shown), "\n"))
        inside = self.graph.nodes.select(F.col("path").alias("m_path"), F.col("start_line").alias("m_line"), "signature").join(F.broadcast(own), (F.col("m_path") == F.col("path")) & (F.col("m_line") >= F.col("start_line") + lines) & (F.col("m_line") <= F.col("end_line")))
        outline = inside.groupBy(F.col("id").alias("m_id")).agg(F.array_sort(F.collect_list(F.struct("m_line", "signature"))).alias("x"))
        rest = F.transform(F.coalesce("x", F.array().cast("array<struct<m_line:int,signature:string>>")), lambda x: F.concat(F.lit("L"), x["m_line"].cast("string"), F.lit(" "), F.coalesce(x["signature"], F.lit(""))))
        gap = F.concat(F.lit("... "), (F.col("end_line") - F.col("start_line") + 1 - lines).cast("string"), F.lit(" more lines"))
        rows = rows.join(outline, F.col("id") == F.col("m_id"), "left")
        code = F.when(F.col("end_line") - F.col("start_line") + 1 > lines, F.array_join(F.concat(F.array("code", gap), rest), "\n")).otherwise(F.col("code"))
        return rows.select("id", "path", "start_line", "end_line", code.alias("code"))

    def file(self, name: str) -> str:
        """The path that ``name`` is, or the only one that ends in it."""
        paths = self.graph.nodes.filter("kind = 'file'").select("path").distinct()
        hit = paths.filter(F.col("path") == name).limit(1).collect() or paths.filter(F.col("path").endswith("/" + name)).orderBy("path").limit(LISTED).collect()
        if len(hit) != 1:
            raise ValueError(f"{name} is no file" if not hit else f"{name} is ambiguous: " + ", ".join(r["path"] for r in hit))
        return hit[0]["path"]

    def skeleton(self, file: str) -> DataFrame:
        """A file's signatures in order; the file by its path or the end of it, if only one ends so."""
        own = self.graph.nodes.filter((F.col("path") == self.file(file)) & (F.col("kind") != "file"))
        return own.select("path", "id", "kind", "signature", "start_line", "end_line").orderBy("start_line", "end_line", "id")

    def grep(self, pattern: str, prefix: str = "", ignore_case: bool = False, fixed: bool = False) -> DataFrame:
        """Matching lines with the innermost symbol around each."""
        files = self.graph.files.filter(under(F.col("path"), prefix))
        lines = files.select(F.col("path").alias("id"), F.col("path").alias("file"), F.posexplode(F.split("text", "\n")).alias("k", "text")).select("id", "file", (F.col("k") + 1).alias("line"), "text")
        hits = S.grep(lines, pattern, ignore_case, fixed)
        spans = self.graph.nodes.filter("kind NOT IN ('file', 'field')").select(F.col("path").alias("file"), F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.col("id").alias("span_id"))
        return J.enclosing(hits, spans, "file", "line")

    def repo_map(self) -> tuple[DataFrame, DataFrame]:
        """(folders with their files, symbols and languages; hubs)."""
        d = self.graph.nodes.select(directory(F.col("path")).alias("dir"), "path", "kind", "family")
        dirs = d.groupBy("dir").agg(F.count_distinct("path").alias("files"), F.count(F.when(F.col("kind") != "file", 1)).alias("symbols"), F.array_sort(F.collect_set("family")).alias("languages"))
        return dirs, G.hubs(self.graph.edges, self.graph.nodes)

    def dead_code(self, prefix: str = "") -> DataFrame:
        """``id, name, confidence, rule, path, start_line``, the surest first, then by place. A file that can't be read lists nothing."""
        texts = self.graph.files.filter("text IS NOT NULL").select(F.col("path").alias("id"), F.posexplode(F.split("text", "\n")).alias("k", "text"))
        lines = texts.select("id", (F.col("k") + 1).alias("line"), "text")
        readable = self.graph.files.filter("text IS NOT NULL").select(F.col("path").alias("r_path"))
        nodes = self.below(prefix).filter("kind IN ('function', 'method')").join(readable, F.col("path") == F.col("r_path"), "left_semi")
        # a decorator stands on the definition's first line, or an annotation on the one above
        first = lines.filter(F.trim("text").rlike(r"^[@#]\[?\w")).select(F.col("id").alias("d_path"), F.explode(F.array("line", F.col("line") + 1)).alias("d_line")).distinct()
        nodes = nodes.join(first.withColumn("decorated", F.lit(True)), (F.col("path") == F.col("d_path")) & (F.col("start_line") == F.col("d_line")), "left").withColumn("decorated", F.coalesce("decorated", F.lit(False)))
        above = self.graph.edges.filter("relation = 'contains'").select(F.col("target").alias("c_id"), F.col("source").alias("holder"))
        kin = self.graph.edges.filter("relation IN ('extends', 'implements')").select(F.col("source").alias("k_id")).distinct().withColumn("kin", F.lit(True))
        over = above.join(kin, F.col("holder") == F.col("k_id")).select("c_id", "kin").distinct()
        nodes = nodes.join(over, F.col("id") == F.col("c_id"), "left").withColumn("overriding", F.coalesce("kin", F.lit(False)) & (F.col("kind") == "method") & (F.col("family") != "go"))
        faces = above.join(self.graph.nodes.filter("kind = 'interface'").select(F.col("id").alias("i_id")), F.col("holder") == F.col("i_id"), "left_semi").select(F.col("c_id").alias("asked"))
        nodes = nodes.join(faces, F.col("id") == F.col("asked"), "left_anti")
        # what Go keeps within the module: internal packages, and those of commands
        folder = F.regexp_replace("path", "/?[^/]*$", "")
        commands = self.graph.nodes.filter("kind = 'function' AND name = 'main' AND family = 'go'").select(folder.alias("m_dir")).distinct().withColumn("command", F.lit(True))
        inside = (F.col("family") == "go") & (F.col("path").rlike("(^|/)internal/") | F.coalesce("command", F.lit(False)))
        nodes = nodes.join(commands, folder == F.col("m_dir"), "left").withColumn("exported", F.col("exported") & ~F.coalesce(inside, F.lit(False)))
        nodes = cut(nodes.drop("m_dir", "command"), "dead_nodes")
        unseen = self.graph.unresolved.filter("reason IN ('receiver_unknown', 'member_ambiguous', 'name_ambiguous')").select("name")
        dead = A.dead_symbols(nodes, self.graph.edges, unseen, A.mention_counts(lines, nodes.select("name")))
        rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
        return dead.join(nodes.select("id", "path", "start_line"), "id").orderBy(rank, "path", "start_line", "id")

    def complexity(self, n: int = A.COMPLEX) -> DataFrame:
        return self.graph.nodes.filter("complexity IS NOT NULL").orderBy(F.desc("complexity"), "path", "start_line").limit(n).select("id", "complexity", "path", "start_line")

    def hotspots(self, commits: DataFrame, n: int = A.HOTSPOTS) -> DataFrame:
        worst = self.graph.nodes.groupBy("path").agg(F.max("complexity").alias("complexity")).filter("complexity > 0")
        return A.top_hotspots(A.hotspots(A.churn(commits), worst), n)

    def cycles(self, level: str = "dir") -> DataFrame:
        """``component, size, members, loop``: cycles of folders (any walk relation) or files (imports), copies left out, the largest
        first; ``loop`` is a shortest way round from the first member, with the stored order of the edge behind each step."""
        nodes = self.graph.nodes.filter(~F.col("copy"))
        edges = self.graph.edges if level == "dir" else self.graph.edges.filter("relation = 'imports'")
        between = cut(G.directory_edges(edges, nodes, directory(F.col("path")) if level == "dir" else F.col("path")), "between")
        return G.loops(between, G.components_of(between))

    def routes(self) -> DataFrame:
        return H.routes(self.graph.files, self.graph.nodes).orderBy("path", "method", "file", "line")

    def blast(self, changes: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(seeds ``id, path``; what they reach, with every changed file it is reached from; its folders, those of most dependents
        first) of ``changes (path, range_id, start, end)``. A file that isn't indexed has no seed; a changed range outside any
        symbol stands for its file."""
        spans = self.graph.nodes.filter("kind <> 'file'").select("path", F.col("id").alias("span_id"), F.col("start_line").alias("start"), F.col("end_line").alias("end"))
        known = self.graph.nodes.filter("kind = 'file'").select(F.col("path").alias("k_path"))
        keyed = changes.join(known, F.col("path") == F.col("k_path"), "left_semi").withColumn("range_id", F.concat_ws("@", "path", F.col("range_id").cast("string")))
        seeds = A.blast_seeds(keyed, spans, "path").join(keyed.select(F.col("range_id").alias("r"), "path"), F.col("range_id") == F.col("r"))
        seeds = cut(seeds.select(F.coalesce("span_id", "path").alias("id"), "path").distinct(), "blast_seeds")
        reach = G.impact_by_origin(self.graph.edges, seeds.select("id", F.col("path").alias("origin")), depth)
        return seeds, reach, A.blast_modules(reach, self.graph.nodes, directory(F.col("path"))).orderBy(F.desc("dependents"), "dir")

    def unindexed(self, changes: DataFrame) -> DataFrame:
        """Changed paths that the graph has no file for."""
        known = self.graph.nodes.filter("kind = 'file'").select(F.col("path").alias("k_path"))
        return changes.select("path").distinct().join(known, F.col("path") == F.col("k_path"), "left_anti").orderBy("path")

    def callers_known(self, symbol: str) -> DataFrame:
        """How sure the list of a symbol's callers is."""
        found = self.resolve(symbol).select(F.col("id").alias("r_id"))
        return G.caller_bound(self.graph.edges, self.graph.nodes, self.graph.unresolved).join(found, F.col("id") == F.col("r_id"), "left_semi")

    def check(self, before: DataFrame) -> DataFrame:
        """Drift of nodes against an earlier build's ``(path, body_hash, size)``, path standing for a node's id."""
        now = self.graph.nodes.select(F.col("id").alias("path"), "body_hash", F.length("body").alias("size"))
        return A.drift(before, now)

    def quality(self) -> DataFrame:
        return A.quality_counts(self.graph.nodes, self.graph.edges)

    def card_texts(self) -> DataFrame:
        return B.cards(self.graph.nodes)


class Live:
    """An engine that is held and kept up: each use compares the tree with what was built and builds again what changed."""

    def __init__(self, spark: SparkSession, root: str, **options):
        self.spark, self.root, self.options = spark, root, options
        self.engine = Engine.build(spark, root, **options)
        self.before = cut(FS.fingerprint(self.engine.graph.files), "fingerprint")

    def get(self) -> Engine:
        files = FS.scan(self.spark, self.root, **self.options)
        if not FS.changed_since(files, self.before).isEmpty():
            self.engine = self.engine.refresh(self.root, **self.options)
            self.before = cut(FS.fingerprint(files), "fingerprint")
        return self.engine


def markdown(seeds: DataFrame, modules: DataFrame, most: int = 20) -> str:
    """A blast report as markdown: changed symbols and the folders that depend on them, the first ``most`` of each."""
    mark = lambda s: s.replace("|", "\\|").replace("`", "'")
    head = [f"- `{mark(r['id'])}`" for r in seeds.orderBy("id").limit(most).collect()]
    rows = [f"| {mark(r['dir'])} | {r['dependents']} | {r['nearest']} |" for r in modules.orderBy(F.desc("dependents"), "dir").limit(most).collect()]
    return "\n".join(["## Changed", *head, "", "## Dependents", "| folder | symbols | nearest |", "| --- | --- | --- |", *rows, ""])


def plain(seeds: DataFrame, modules: DataFrame, most: int = 20) -> str:
    """The same as text."""
    head = [f"  {r['id']}" for r in seeds.orderBy("id").limit(most).collect()]
    rows = [f"  {r['dir']}: {r['dependents']} within {r['nearest']} steps or more" for r in modules.orderBy(F.desc("dependents"), "dir").limit(most).collect()]
    return "\n".join(["changed:", *head, "dependents:", *rows, ""])


def mermaid(steps: list[str]) -> str:
    """A chain of ids as a flow chart."""
    names = [f'  n{k}["{s.rsplit("#", 1)[-1].replace(chr(34), chr(39))}"]' for k, s in enumerate(steps)]
    return "\n".join(["graph LR", *names, *(f"  n{k} --> n{k + 1}" for k in range(len(steps) - 1)), ""])


def as_json(rows: DataFrame, most: int = 1000) -> str:
    """A report's rows as JSON, the first ``most``."""
    return json.dumps([json.loads(r["j"]) for r in rows.limit(most).select(F.to_json(F.struct("*")).alias("j")).collect()], ensure_ascii=False)
