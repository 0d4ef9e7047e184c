"""Extraction, history and diffs on small texts; a build on a small tree."""

import pytest
from pyspark.sql import functions as F

from quarry.engine import Engine, markdown, mermaid, plain
from quarry.operators import analysis as A
from quarry.operators import joins as J
from quarry.operators import search as S
from quarry.sources import extract as X
from quarry.sources import files as FS
from quarry.sources import git as V


def names(path, text, record="node"):
    return [(r.get("name"), r.get("kind")) if record == "node" else (r["base"].split("#")[-1], r["relation"], r["target"]) for r in X.rows_of(path, text) if r["record"] == record][record == "node" :]


def test_python():
    text = "import os\n# says hi\ndef f(a, *b):\n    if a and b:\n        return g(a)\nclass C(B):\n    def m(self, x):\n        self.y = f(x)\n"
    assert names("p/a.py", text) == [("f", "function"), ("C", "class"), ("m", "method")]
    intents = names("p/a.py", text, "intent")
    assert ("f", "calls", "g") in intents and ("C", "extends", "B") in intents and ("C.m", "writes", "y") in intents and ("p/a.py", "imports", "os") in intents
    f = next(r for r in X.rows_of("p/a.py", text) if r.get("name") == "f")
    assert (f["arity"], f["variadic"], f["complexity"], f["doc"]) == (1, True, 3, "says hi")


def test_broken_file_is_a_row():
    rows = X.rows_of("a.py", "def (")
    assert len(rows) == 1 and rows[0]["error"]
    assert len(X.rows_of("a.py", None)) == 1


def test_other_languages():
    assert ("Say", "method") in names("m.go", "package m\nfunc (s *Foo) Say(x int) int {\n return bar(x)\n}\n")
    assert names("A.java", "public class A {\n  private int go(int a, int b) {\n    return b;\n  }\n}\n") == [("A", "class"), ("go", "method")]
    assert ("f", "calls", "run") in names("a.ts", "const f = (a) => {\n  x.run(a);\n};\n", "intent")
    assert ("main", "function") in names("m.rs", "fn main() {\n    go();\n}\n")
    assert names("q.sql", "CREATE VIEW v AS SELECT * FROM a.t; -- FROM z\n") == [("v", "class")]
    assert ("v", "references", "a.t") in names("q.sql", "CREATE VIEW v AS SELECT * FROM a.t; -- FROM z\n", "intent")


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("def top():\n    return low()\n")
    (tmp_path / "src/b.py").write_text("from a import top\ndef low():\n    return 1\n")
    (tmp_path / "src/c.py").write_bytes(b"\xff\xfe" + "x = 1\n".encode("utf-16-le"))
    (tmp_path / "node_modules/z.js").write_text("function no() {}")
    files = FS.scan(spark, str(tmp_path))
    got = {r.path: r.text for r in files.collect()}
    assert set(got) == {"src/a.py", "src/b.py", "src/c.py"} and got["src/c.py"] == "x = 1\n"
    e = Engine.build(spark, str(tmp_path))
    assert e.path("top", "low") == ["src/a.py#top", "src/b.py#low"]
    assert {r.other for r in e.walk("low").collect()} == {"src/a.py#top"}
    assert [r.id for r in e.ask("top function", 2, graph_rank=False).collect()][0] == "src/a.py#top"
    assert "n0 --> n1" in mermaid(e.path("top", "low"))
    before = spark.createDataFrame(FS.fingerprint(files).collect(), "path string, size long, mtime_ms long, hash string")
    (tmp_path / "src/b.py").write_text("def low():\n    return 22\n")
    (tmp_path / "src/d.py").write_text("y = 2\n")
    assert {(r.path, r.status) for r in FS.changed_since(FS.scan(spark, str(tmp_path)), before).collect()} == {("src/b.py", "changed"), ("src/d.py", "added")}
    again = e.refresh(str(tmp_path))
    whole = Engine.build(spark, str(tmp_path))
    assert sorted(again.graph.edges.collect()) == sorted(whole.graph.edges.collect())
    changes = spark.createDataFrame([("src/b.py", 0, 1, 2), ("src/d.py", 0, 1, 1)], "path string, range_id long, start long, end long")
    seeds, reach, modules = whole.blast(changes)
    assert {r.id for r in seeds.collect()} == {"src/b.py#low", "src/d.py"} and {r.id for r in reach.collect()} == {"src/a.py#top"}
    assert "| src | 1 | 1 |" in markdown(seeds, modules)
    with pytest.raises(ValueError, match="did you mean"):
        whole.resolve("tpo")


def test_history(spark):
    log = spark.createDataFrame([("h1\x1f2024-03-01T10:00:00+00:00\x1fAda\x1f1+ada@users.noreply.github.com\n\na.py\nb.py",), ("h2\x1f2024-03-02T10:00:00+00:00\x1fdependabot[bot]\x1fx@y\na.py",)], "record string")
    rows = V.parse_log(log)
    assert rows.count() == 3
    kept = V.people(rows, 1_709_500_000_000)
    assert {r.h for r in kept.select(V.handle(F.col("email")).alias("h")).collect()} == {"ada"}
    assert [(r.path, r.commits) for r in A.churn(rows).orderBy("path").collect()] == [("a.py", 2), ("b.py", 1)]


def test_patch():
    text = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1,2 @@\n-a\n+b\n+c\n@@ -9,2 +10,0 @@\n-d\n-e\ndiff --git a/old b/new\nrename from old\nrename to new\n"
    got = [(r["path"], r["status"], r["start"], r["end"]) for r in V.parse_patch(text)]
    assert got == [("x.py", "modified", 1, 2), ("x.py", "modified", 10, 10), ("new", "renamed", None, None)]
    assert V.unquoted('"a\\303\\251\\tb"') == "aé\tb"


def test_spans(spark):
    spans = spark.createDataFrame([("f", 1, 20, "a"), ("f", 3, 8, "b"), ("f", 5, 6, "c")], "path string, start long, end long, span_id string")
    at = spark.createDataFrame([("f", k) for k in (1, 4, 5, 9, 30)], "path string, line long")
    assert {r.line: r.span_id for r in J.enclosing(at, spans, "path", "line", 4).collect()} == {1: "a", 4: "b", 5: "c", 9: "a", 30: None}
    changes = spark.createDataFrame([("f", "r1", 5, 5), ("f", "r2", 15, 16), ("g", "r3", 1, 1)], "path string, range_id string, start long, end long")
    assert {(r.range_id, r.span_id) for r in A.blast_seeds(changes, spans, "path").collect()} == {("r1", "c"), ("r2", "a"), ("r3", None)}


def test_ambiguous_names(spark):
    n = spark.createDataFrame([("a#f", "f", "a", "py"), ("a#f~2", "f", "a", "py"), ("b#g", "g", "b", "py"), ("c#g", "g", "c", "go"), ("d#h", "h", "d", None)], "id string, name string, file string, family string")
    i = spark.createDataFrame([(1, "f", "a", "py"), (2, "g", "b", "py"), (3, "g", "x", "go"), (4, "g", "x", None), (5, "h", "x", "py"), (6, "zz", "x", "py")], "intent long, name string, file string, family string")
    got = {r.intent: (r.outcome, r.target) for r in J.resolve_names(i, n).collect()}
    assert got == {1: ("ambiguous", None), 2: ("extracted", "b#g"), 3: ("inferred", "c#g"), 4: ("ambiguous", None), 5: ("inferred", "d#h"), 6: ("missing", None)}


def test_owners(spark):
    day = 86_400_000
    c = spark.createDataFrame([("x", "old", "h1", 0), ("x", "old", "h1", 0), ("x", "new", "h2", 120 * day)], "area string, person string, hash string, at_ms long")
    got = {r.person: (r.score, r.commits) for r in A.ownership(c, 120 * day).collect()}
    assert got == {"old": (0.5, 1), "new": (1.0, 1)}


def test_drift(spark):
    b = spark.createDataFrame([("same", 1, "x"), ("changed", 1, "x"), ("removed", 1, "x"), ("unreadable", 1, "x")], "path string, size long, body_hash string")
    a = spark.createDataFrame([("same", 1, "x"), ("changed", 1, "y"), ("added", 1, "x"), ("unreadable", 1, None)], "path string, size long, body_hash string")
    got = {r.path: r.status for r in A.drift(b, a).collect()}
    assert got == {"changed": "changed", "removed": "removed", "added": "added", "unreadable": "changed"}


def test_decay(spark):
    rows = [(f"{f}{k}", f, s) for f, ss in {"a": (10.0, 9.5, 9.4), "b": (9.0,), "c": (8.0, 1.0)}.items() for k, s in enumerate(ss)]
    got = S.decayed(spark.createDataFrame(rows, "id string, file string, score double"), 5).orderBy("place").collect()
    assert [g["id"] for g in got] == ["a0", "b0", "a1", "c0", "a2"]


def test_grep_refuses(spark):
    with pytest.raises(ValueError):
        S.grep(spark.createDataFrame([], "id long, file string, line long, text string"), r"(?=a)b")


def test_as_of(spark):
    left = spark.createDataFrame([("k", 5), ("k", 50), ("k", 1), ("z", 9)], "key string, at long")
    right = spark.createDataFrame([("k", 2, "a"), ("k", 5, "b"), ("k", 9, "c")], "key string, at long, v string")
    got = {(r.key, r.at): r.v_as_of for r in J.as_of(left, right, "key", "at", "v", 4).collect()}
    assert got == {("k", 5): "b", ("k", 50): "c", ("k", 1): None, ("z", 9): None}


def test_report_steps():
    from quarry.operators import retrieval as T

    assert T.coarsened({"a/b/c": 1, "a/b/d": 2, "a/e": 3, "f": 4}, 2) in ({"a": 6, "f": 4}, {"a/b": 3, "a": 3, "f": 4}) and sum(T.coarsened({"a/b": 1, "c/d": 2, "e": 3}, 1).values()) == 6
    assert [T.limited([1, 2, 3], x) for x in (float("nan"), 1.9, -1, float("inf"), 0)] == [[], [1], [1, 2], [1, 2, 3], []]
    hits = [{"id": "a", "code": "x" * 4000, "doc": None}, {"id": "b", "code": "y" * 4000, "doc": "z"}]
    out = T.cut_to_budget(hits, 700)
    assert out[0]["id"] == "a" and sum(len(h.get("code") or "") for h in out) <= 2800
    assert T.relevant(["cache", "it"], ["cache", "server"], False) and not T.relevant(["it"], ["it"], False)


def test_interfaces(spark):
    from quarry.operators import retrieval as T

    cols = "owner string, dir string, method string, arity int, variadic boolean, results int, exported boolean"
    types = spark.createDataFrame([("A", "p", "Save", 1, False, 1, True), ("A", "p", "hid", 0, False, None, False), ("B", "q", "Save", 1, False, 2, True), ("B", "q", "hid", 0, False, 0, False)], cols)
    asks = spark.createDataFrame([("Saver", "p", "Save", 1, False, 1, True), ("Hider", "p", "hid", 0, False, 0, False), ("Vague", "p", "x", None, False, None, True)], cols)
    assert {(r.type, r.interface) for r in T.satisfied(types, asks).collect()} == {("A", "Saver"), ("A", "Hider")}


GO = """package m
import "fmt"
type Saver interface {
	Save(x int) error
}
type A struct{}
func (a *A) Save(x int) error { return nil }
type B struct{}
func (b B) Save(x int) error { fmt.Println(x); return nil }
func Direct(a *A) { a.Save(1) }
func Loose(a any) { a.Save(1) }
func Recur() { Recur() }
func Left() { Right() }
func Right() { Left() }
"""


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in {
        "m/m.go": GO,
        "pkg/__init__.py": "# pkg\n",
        "pkg/base.py": "class Base:\n    def run(self):\n        return self.step()\n\n    def step(self):\n        return 1\n",
        "pkg/sub/deep.py": "from ..base import Base\nfrom . import peer\nimport os\n\n\nclass Deep(Base):\n    def go(self):\n        self.run()\n        peer.help_out(1)\n        os.getcwd()\n        x = Base()\n        x.step()\n        unknown.thing()\n",
        "pkg/sub/peer.py": "from .deep import Deep\n\n\ndef help_out(n):\n    d: Deep = make()\n    return d.go()\n\n\ndef help_out_twice(n):\n    return 2\n",
        "pkg/sub/__init__.py": "# sub\n",
        "tests/test_peer.py": "def help_out(n):\n    return n\n",
        "web/app.py": "@app.get('/items')\ndef items():\n    return 1\n\n\n@app.route('/about')\ndef about():\n    return 2\n",
        "web/x.py": "def same():\n    pass\n",
        "pkg/y.py": "def same():\n    pass\n",
        "web/a.ts": "import { b } from './b';\nexport function a() { return b(); }\n",
        "web/b.ts": "import { a } from '../web/a';\nexport function b() { return a(); }\n",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


def test_resolution(spark, tree):
    e = Engine.build(spark, str(tree))
    got = {(r.source, r.relation, r.target) for r in e.graph.edges.collect()}
    go = {(a.split("#")[-1], r, b.split("#")[-1]) for a, r, b in got if a.startswith("m/m.go#")}
    assert {("Direct", "calls", "A.Save"), ("Recur", "calls", "Recur"), ("Left", "calls", "Right"), ("Right", "calls", "Left")} == {x for x in go if x[1] == "calls"}
    assert {("A", "implements", "Saver"), ("A.Save", "implements", "Saver.Save"), ("B", "implements", "Saver"), ("B.Save", "implements", "Saver.Save")} == {x for x in go if x[1] == "implements"}
    assert {t for s, r, t in got if r == "imports" and s == "pkg/sub/deep.py"} == {"pkg/base.py", "pkg/sub/__init__.py", "os"}
    assert ("web/a.ts", "imports", "web/b.ts") in got and ("web/b.ts", "imports", "web/a.ts") in got
    calls = {(a, b) for a, r, b in got if r == "calls"}
    deep = "pkg/sub/deep.py#Deep.go"
    assert {b for a, b in calls if a == deep} == {"pkg/base.py#Base.run", "pkg/base.py#Base", "pkg/base.py#Base.step", "pkg/sub/peer.py#help_out"}
    assert ("pkg/sub/peer.py#help_out", deep) in calls and ("pkg/base.py#Base.run", "pkg/base.py#Base.step") in calls
    missing = {(r.name, r.reason): r.n for r in e.graph.unresolved.collect()}
    assert missing[("thing", "receiver_unknown")] == 1 and missing[("Save", "receiver_unknown")] == 1 and missing[("getcwd", "external_package")] == 1 and missing[("Println", "external_package")] == 1 and missing[("make", "name_not_in_graph")] == 1


def test_every_method_after_save_and_load(spark, tree, tmp_path):
    built = Engine.build(spark, str(tree))
    built.save(str(tmp_path / "kept"))
    e = Engine.load(spark, str(tmp_path / "kept"))
    assert e.graph.index is not None
    assert e.ask("help out", 2).first().id == "pkg/sub/peer.py#help_out"
    assert {r.id for r in e.ask("who calls step").collect()} == {"pkg/base.py#Base.run", "pkg/sub/deep.py#Deep.go"}
    assert {r.id for r in e.ask("what does run call").collect()} == {"pkg/base.py#Base.step"}
    assert e.read("Base.step").first().code == "    def step(self):\n        return 1"
    assert e.read("nowhere::help_out").first().id == "pkg/sub/peer.py#help_out"  # the other one is a copy
    assert e.read("pkg/base.py::Base", lines=2).first().code.endswith("... 4 more lines\nL5 def step(self)")
    assert e.select("Save").first().id == "m/m.go#Saver.Save"  # the most used
    with pytest.raises(ValueError, match="ambiguous"):
        e.select("same")
    with pytest.raises(ValueError, match="changed"):
        e.read("Base.step", now=spark.createDataFrame([("pkg/base.py", "other")], "path string, hash string"))
    assert e.read("Base.step", now=FS.scan(spark, str(tree))).count() == 1
    assert [r.id for r in e.skeleton("peer.py").collect()] == ["pkg/sub/peer.py#help_out", "pkg/sub/peer.py#help_out_twice"]
    with pytest.raises(ValueError, match="ambiguous"):
        e.file("__init__.py")
    assert {(r.file, r.line, r.span_id) for r in e.grep("return 1").collect()} == {("pkg/base.py", 6, "pkg/base.py#Base.step"), ("web/app.py", 3, "web/app.py#items")}
    dead = [(r.name, r.confidence, r.rule) for r in e.dead_code().collect()]
    assert ("help_out_twice", "medium", "exported") in dead and ("items", "low", "decorated") in dead and ("Direct", "medium", "exported") in dead
    assert [x[1] for x in dead] == sorted((x[1] for x in dead), key=["high", "medium", "low"].index)
    loops = e.cycles("file").collect()
    assert [(r.size, r.members, [(h["from"], h["to"]) for h in r.loop]) for r in loops] == [(2, ["web/a.ts", "web/b.ts"], [("web/a.ts", "web/b.ts"), ("web/b.ts", "web/a.ts")])] or len(loops) == 2
    assert [(r.method, r.path, r.handler) for r in e.routes().collect()] == [("ANY", "/about", "web/app.py#about"), ("GET", "/items", "web/app.py#items")]
    bound = {r.id: (r.untyped, r.ambiguous, r.exact) for r in e.callers_known("Save").collect()}
    assert bound["m/m.go#A.Save"] == (1, 0, False) and e.callers_known("Recur").first().exact
    touched = spark.createDataFrame([("pkg/base.py", 0, 5, 6), ("pkg/sub/peer.py", 0, 4, 6), ("no.py", 0, 1, 1)], "path string, range_id long, start long, end long")
    seeds, reach, modules = e.blast(touched)
    assert {r.id for r in seeds.collect()} == {"pkg/base.py#Base.step", "pkg/sub/peer.py#help_out"} and [r.path for r in e.unindexed(touched).collect()] == ["no.py"]
    assert {r.id: r.origins for r in reach.collect()}["pkg/sub/deep.py#Deep.go"] == ["pkg/base.py", "pkg/sub/peer.py"] and "dependents:" in plain(seeds, modules)
    assert e.path("go", "step")[-1] == "pkg/base.py#Base.step" and e.walk("step").count() == 2
    assert e.complexity(3).count() == 3 and e.quality().count() > 2 and e.card_texts().count() > 3 and e.repo_map()[0].count() == 4 + 1
    again = e.refresh(str(tree))
    assert sorted(again.graph.edges.collect()) == sorted(built.graph.edges.collect())


def test_live(spark, tmp_path):
    from quarry.engine import Live

    (tmp_path / "a.py").write_text("def one():\n    pass\n")
    live = Live(spark, str(tmp_path))
    first = live.get()
    assert live.get() is first
    (tmp_path / "b.py").write_text("def two():\n    one()\n")
    assert live.get() is not first and live.get().graph.edges.filter("relation = 'calls'").count() == 1


def test_go_results():
    rows = {r.get("name"): r.get("results") for r in X.rows_of("m.go", "package m\nfunc a(x int) {\n}\nfunc b() error {\n}\nfunc c(x func(int) int) (int, error) {\n}\ntype S interface {\n\tRun(x int) (a, b int)\n\tStop()\n}\n")}
    assert (rows["a"], rows["b"], rows["Run"], rows["Stop"]) == (0, 1, 2, 0)
