"""Small state, oracles and call chains."""

import hashlib
import json

import pytest

from quarry.operators import analysis as A
from quarry.operators import flows
from quarry.sources import scopes
from quarry.sources import state as S


def test_ledger_sessions_options(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    assert S.drain(spark, ledger) == 0
    for n in (5, 7, 0, -3):
        S.record(spark, ledger, n)
    assert S.drain(spark, ledger) == 12 and S.drain(spark, ledger) == 0
    folder = tmp_path / "sessions"
    assert S.latest_session(spark, str(folder)) is None
    folder.mkdir()
    (folder / "a.json").write_text('{"n": 1}')
    (folder / "b.json").write_text('{"n": 2}')
    import os

    os.utime(folder / "a.json", (2_000_000_000, 2_000_000_000))
    assert S.latest_session(spark, str(folder)) == ("a", {"n": 1})
    assert S.load_options(spark, str(tmp_path / "o")) == {}
    S.save_options(spark, str(tmp_path / "o"), {"include": ["vendor"]})
    assert S.load_options(spark, str(tmp_path / "o")) == {"include": ["vendor"]}


def test_oracle(spark, tmp_path):
    text = "def f():\n    return g()\n"
    manifest = {"version": 1, "sources": [{"path": "a.py", "sha256": hashlib.sha256(text.encode()).hexdigest()}], "build": {"extensions": [".py"]}, "partitions": [{"name": "calls", "language": "python", "relation": "calls", "files": ["a.py"], "expected": [{"source": "a.py#f", "relation": "calls", "target": "a.py#g"}]}]}
    (tmp_path / "o.json").write_text(json.dumps(manifest, indent=1))
    sources, facts, build = S.oracle(spark, str(tmp_path / "o.json"))
    files = spark.createDataFrame([("a.py", hashlib.sha256(text.encode()).hexdigest())], "path string, hash string")
    assert S.unpinned(sources, files).count() == 0 and S.unpinned(sources, files.limit(0)).count() == 1 and build == {"extensions": [".py"]}
    found = spark.createDataFrame([("a.py#f", "calls", "a.py#g"), ("a.py#f", "calls", "a.py#h")], "source string, relation string, target string")
    row = A.score_facts(found, facts.drop("partition")).first()
    assert (row.tp, row.fp, row.fn, row.recall) == (1, 1, 0, 1.0)
    for broken in ({**manifest, "version": 2}, {**manifest, "sources": [{"path": "../x", "sha256": ""}]}):
        (tmp_path / "bad.json").write_text(json.dumps(broken))
        with pytest.raises(ValueError):
            S.oracle(spark, str(tmp_path / "bad.json"))


def test_call_chain(spark):
    nodes = spark.createDataFrame([(x, "function") for x in "abcdxy"] + [("i", "method"), ("m", "method"), ("K", "class")], "id string, kind string")
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "x", "calls"), ("x", "c", "calls"), ("c", "i", "calls"), ("m", "i", "implements"), ("d", "a", "references"), ("a", "a", "calls"), ("K", "a", "calls")], "source string, target string, relation string")
    assert flows.call_chain(edges, nodes, ["c", "a", "b", "K", "m", "gone"]) == ["a", "b", "x", "c", "i", "m"]
    assert flows.call_chain(edges, nodes, ["a", "b"]) == [] and flows.call_chain(edges, nodes, ["d"]) == []


def test_scopes(spark):
    files = spark.createDataFrame([("go.mod", "module x.org/m // c\n"), ("a/b/c/go.mod", "module deep\n"), ("a/package.json", "{}"), ("a/b/setup.py", ""), ("b/c/pom.xml", "")], "path string, text string")
    assert {(r.prefix, *r.markers) for r in scopes.discover(files).collect()} == {("", "go.mod"), ("a", "package.json"), ("b/c", "pom.xml")}
    assert [(r.prefix, r.markers) for r in scopes.discover(files.limit(0)).collect()] == [("", [])]
    assert {(r.dir, r.module) for r in scopes.go_modules(files).collect()} == {("", "x.org/m"), ("a/b/c", "deep")}
