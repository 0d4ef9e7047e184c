"""A workspace of two small repositories; git as a source."""

import subprocess

import pytest

from quarry.engine import Engine
from quarry.sources import git as V
from quarry.workspace import Workspace, probe, read_index, write_index


def test_workspace(spark, tmp_path):
    for child, text in (("one", "def parse_header(x):\n    return x\n\n\ndef parse_body(x):\n    return parse_header(x)\n"), ("two", "def parse_header_line(x):\n    return x\n"), ("three", "def unrelated(x):\n    return x\n")):
        (tmp_path / "src" / child).mkdir(parents=True)
        (tmp_path / "src" / child / "m.py").write_text(text)
        Engine.build(spark, str(tmp_path / "src" / child)).save(str(tmp_path / "ws" / child))
    ws = str(tmp_path / "ws")
    assert read_index(spark, ws) == []
    write_index(spark, ws, ["two", "one", "three", "gone"])
    assert read_index(spark, ws) == ["gone", "one", "three", "two"]
    assert {(r.child, r.nodes, r.edges) for r in probe(spark, ws).collect()} == {("one", 3, 3), ("two", 2, 1), ("three", 2, 1)}
    w = Workspace(spark, ws)
    assert sorted(w.children) == ["one", "three", "two"] and w.nodes().count() == 7 and {r.repo for r in w.edges().collect()} == set(w.children)
    got = [(r.repo, r.id) for r in w.search("parse header", 4).collect()]
    assert got[0][1].endswith(("#parse_header", "#parse_header_line")) and {r for r, _ in got} == {"one", "two"}
    assert {r.repo for r in w.search("parse header", 4, "one").collect()} == {"one"}
    with pytest.raises(ValueError, match="no child"):
        w.search("x", 1, "nine/a")
    with pytest.raises(ValueError, match="child"):
        write_index(spark, ws, ["../x"])


def test_git(spark, tmp_path):
    root = str(tmp_path)
    run = lambda *a: subprocess.run(["git", "-c", "user.name=Ada", "-c", "user.email=ada@x.org", "-C", root, *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (tmp_path / "a.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "é b.py").write_text("z = 1\n")
    (tmp_path / ".gitignore").write_text("*.log\n")
    run("add", ".")
    run("commit", "-q", "-m", "one")
    (tmp_path / "a.py").write_text("x = 1\ny = 3\nw = 4\n")
    (tmp_path / "new.py").write_text("n = 1\n")
    (tmp_path / "x.log").write_text("no")
    run("mv", "é b.py", "c.py")
    assert {r.path for r in V.visible(spark, root).collect()} == {"a.py", "c.py", "new.py", ".gitignore"}
    run("add", ".")
    run("commit", "-q", "-m", "two\n\nCo-authored-by: Bob B <bob@x.org>")
    log = V.history(spark, root)
    assert {(r.path, r.name) for r in log.collect()} >= {("a.py", "Ada"), ("new.py", "Ada")} and log.filter("path = 'a.py'").count() == 2
    names, ranges = V.changes(spark, root, "HEAD~1", "HEAD")
    assert {(r.path, r.status, r.old_path) for r in names.collect()} == {("a.py", "modified", None), ("new.py", "added", None), ("c.py", "renamed", "é b.py")}
    assert ("a.py", 2, 3) in {(r.path, r.start, r.end) for r in ranges.collect()}
    assert {(r.name, r.email) for r in V.authors(spark, root, "HEAD~1").collect()} == {("Ada", "ada@x.org"), ("Bob B", "bob@x.org")}
    for bad in ("-x", "", "nowhere"):
        with pytest.raises(ValueError):
            V.changes(spark, root, bad)


def test_command_line(spark, tmp_path, capsys):
    from quarry.__main__ import main

    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.py").write_text("def one():\n    return two()\n\n\ndef two():\n    return 2\n")
    saved = str(tmp_path / "s")
    run = lambda *a: (main([*a], spark), capsys.readouterr())
    assert run("build", str(tmp_path / "t"), saved)[0] == 0
    assert run("walk", saved, "two")[1].out.startswith("a.py#two\ta.py#one\tcalls\t2")
    assert "n0 --> n1" in run("path", saved, "one", "two")[1].out
    assert '"id":"a.py#two"' in run("--json", "ask", saved, "what does one call")[1].out.replace(" ", "")
    assert run("read", saved, "gone")[0] == 1 and run("check", saved, str(tmp_path / "t"))[1].out.strip() == ""
