"""Symbols and edge intents out of source text, file by file, on executors.

Python files are read by the standard syntax tree; SQL files by a small lexer; Go, Java, TypeScript, JavaScript, Rust and C
by patterns of their declarations over text whose strings and comments are blanked, with bodies found by their brackets
(best effort: no grammar package is at hand). All give the same two record kinds, a definition or an intent.

A call through a receiver carries what the receiver is known to be: ``via`` is ``self`` for the object a method is of (also where
the language leaves it out), ``package`` for an imported package or module, ``member`` for anything else, and ``recv_type`` the
type that an annotation, a parameter, a declaration or a construction in the same definition gives it, if any does.

A file that can't be parsed gives its own row with ``error`` set and no symbols. A null text gives the file's row only.
"""

from __future__ import annotations

import ast
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIELDS = "path string, record string, base string, name string, kind string, owner string, start_line int, end_line int, signature string, exported boolean, arity int, variadic boolean, results int, complexity int, doc string, body string, relation string, target string, receiver string, recv_type string, via string, args int, line int, generated boolean, error string"
ARROW = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in FIELDS.split(", "))])
GENERATED = re.compile(r"(?im)^\W*(code generated .* do not edit|@generated\b|this file (is|was) (auto-?)?generated)")
DOC_CHARS, BODY_CHARS = 2_000, 5_000
DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case, ast.Assert)


def rows_of(path: str, text: str | None) -> list[dict]:
    generated = bool(GENERATED.search(text[:8192])) if text else False
    lines = (text or "").split("\n")
    file = {"record": "node", "base": path, "name": path.rsplit("/", 1)[-1], "kind": "file", "start_line": 1, "end_line": len(lines), "exported": True}
    try:
        found = [] if text is None else (python_rows(path, text) if re.search(r"\.pyi?$", path) else sql_rows(path, text) if path.endswith(".sql") else generic_rows(path, text))
    except (SyntaxError, ValueError, RecursionError) as e:
        found, file["error"] = [], str(e)[:200]
    covered = {k for r in found if r["record"] == "node" for k in range(r["start_line"], r["end_line"] + 1)}
    file["body"] = "\n".join(x for k, x in enumerate(lines, 1) if k not in covered)[:16_000]
    for r in found:
        if r["record"] == "node":
            r["doc"] = leading_doc(lines, r["start_line"])
            r["body"] = " ".join("\n".join(lines[r["start_line"] - 1 : r["end_line"]]).split())[:BODY_CHARS]
    return [x | {"path": path, "generated": generated} for x in [file, *found]]


def leading_doc(lines: list[str], start: int) -> str | None:
    """The comment lines right above a definition; decorators are passed over, licences and directives are not documentation."""
    out, k = [], start - 2
    while k >= 0 and re.match(r"\s*(@\w|#\[)", lines[k]):
        k -= 1
    while k >= 0 and (m := re.match(r"\s*(//+|#+(?!!)|--+|/\*+|\*+/?)\s?(.*?)(\*/)?\s*$", lines[k])):
        out.append(m[2])
        k -= 1
    text = "\n".join(x for x in reversed(out) if x and not re.match(r"(?i)(go:|nolint|eslint|type:|noqa|pragma|copyright|spdx|license)", x.strip()))
    return text[:DOC_CHARS] or None


LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+")
SIGNATURE_CHARS = 400


def signature_of(lines: list[str], node) -> str:
    """A definition's source up to the colon that ends a line, blanks joined. ``lines``, with their ends, are split once for a file, and
    no more of them is looked at than is shown; offsets count bytes of UTF-8."""
    shown, first, last = "", node.lineno - 1, node.end_lineno - 1
    for k in range(first, last + 1):
        raw = lines[k].encode()
        part = raw[node.col_offset if k == first else 0 : node.end_col_offset if k == last else len(raw)].decode()
        head, colon, _ = part.partition(":\n")
        shown += head
        if colon or len(" ".join(shown.split())) > SIGNATURE_CHARS:
            break
    return " ".join(shown.split())[:SIGNATURE_CHARS]


def python_rows(path: str, text: str) -> list[dict]:
    out: list[dict] = []
    lines = LINE.findall(text)

    def intent(relation, target, line, source, **more):
        out.append({"record": "intent", "base": source, "relation": relation, "target": target, "line": line} | more)

    def name_of(node) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            return node.attr
        return None

    def type_of(node) -> str | None:
        """What an annotation or a construction names; an optional's or a string's inner name."""
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            return re.sub(r"\W.*", "", node.value.rpartition(".")[2]) or None
        if isinstance(node, ast.Call):
            n = name_of(node.func)
            return n if n and n[:1].isupper() else None
        if isinstance(node, ast.BinOp):  # X | None
            return type_of(node.left)
        if isinstance(node, ast.Subscript):
            return type_of(node.slice) if name_of(node.value) == "Optional" else name_of(node.value)
        return name_of(node)

    tree = ast.parse(text)
    modules = {(a.asname or a.name).split(".")[0] for x in ast.walk(tree) if isinstance(x, (ast.Import, ast.ImportFrom)) for a in x.names if isinstance(x, ast.Import) or not a.name[:1].isupper()}

    def walk(node, scope: list[str], owner: str | None, env: dict[str, str], me: str | None):
        own = path + ("#" + ".".join(scope) if scope else "")
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                base = path + "#" + ".".join([*scope, child.name])
                is_class = isinstance(child, ast.ClassDef)
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                row = {"record": "node", "base": base, "name": child.name, "kind": "class" if is_class else "method" if owner else "function", "owner": owner, "start_line": first, "end_line": child.end_lineno, "exported": not child.name.startswith("_") or child.name.startswith("__"), "signature": signature_of(lines, child)}
                if not is_class:
                    a = child.args
                    row |= {"arity": len(a.posonlyargs) + len(a.args) - (1 if owner and a.args and a.args[0].arg in ("self", "cls") else 0), "variadic": a.vararg is not None, "complexity": 1 + sum(isinstance(x, DECISIONS) or (isinstance(x, ast.BoolOp) and len(x.values) > 1) for x in ast.walk(child))}
                out.append(row)
                intent("contains", base, first, own)
                for b in child.bases if is_class else ():
                    if n := name_of(b):
                        intent("extends", n, child.lineno, base)
                for d in child.decorator_list:
                    if n := name_of(d.func if isinstance(d, ast.Call) else d):
                        intent("references", n, d.lineno, base)
                inner = {}
                if not is_class:
                    a = child.args
                    inner = env | {x.arg: t for x in [*a.posonlyargs, *a.args, *a.kwonlyargs] if x.annotation and (t := type_of(x.annotation))}
                walk(child, [*scope, child.name], child.name if is_class else None, inner, child.name if is_class else owner or me)
                continue
            if isinstance(child, ast.Import):
                for x in child.names:
                    intent("imports", x.name, child.lineno, path)
            elif isinstance(child, ast.ImportFrom):
                intent("imports", "." * child.level + (child.module or ""), child.lineno, path)
            elif isinstance(child, ast.Call) and (n := name_of(child.func)):
                through = child.func.value if isinstance(child.func, ast.Attribute) else None
                receiver = name_of(through) if through is not None else None
                if through is None:
                    via, known = None, None
                elif receiver in ("self", "cls") and isinstance(through, ast.Name) and me:
                    via, known = "self", me
                elif isinstance(through, ast.Name) and receiver in modules and receiver not in env:
                    via, known = "package", None
                else:
                    plain = env.get(receiver) or (receiver if receiver[:1].isupper() else None) if isinstance(through, ast.Name) else None
                    via, known = "member", plain or (type_of(through) if isinstance(through, ast.Call) else None)
                intent("calls", n, child.lineno, own, receiver=receiver, via=via, recv_type=known, args=len(child.args))
            elif isinstance(child, ast.Attribute) and isinstance(child.ctx, ast.Store):
                intent("writes", child.attr, child.lineno, own, receiver=name_of(child.value))
            if isinstance(child, ast.Assign) and len(child.targets) == 1 and isinstance(child.targets[0], ast.Name) and isinstance(child.value, ast.Call) and (t := type_of(child.value)):
                env[child.targets[0].id] = t
            elif isinstance(child, ast.AnnAssign) and isinstance(child.target, ast.Name) and (t := type_of(child.annotation)):
                env[child.target.id] = t
            walk(child, scope, owner if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) else None, env, me)

    walk(tree, [], None, {}, None)
    return out


def blanked(text: str, line_mark: str, nested: bool = False, quotes: str = "\"'`") -> str:
    """``text`` with strings and comments turned to blanks, length and lines kept."""
    out, k, n = list(text), 0, len(text)

    def clear(a, b):
        for i in range(a, min(b, n)):
            if out[i] != "\n":
                out[i] = " "

    while k < n:
        if text.startswith(line_mark, k):
            end = text.find("\n", k)
            end = n if end < 0 else end
            clear(k, end)
            k = end
        elif text.startswith("/*", k):
            depth, i = 1, k + 2
            while i < n and depth:
                if nested and text.startswith("/*", i):
                    depth, i = depth + 1, i + 2
                elif text.startswith("*/", i):
                    depth, i = depth - 1, i + 2
                else:
                    i += 1
            clear(k, i)
            k = i
        elif line_mark == "--" and (m := re.compile(r"\$\w*\$").match(text, k)):
            end = text.find(m[0], m.end())
            k = (n if end < 0 else end + len(m[0])) if clear(m.end(), n if end < 0 else end) is None else k
        elif text[k] in quotes:
            q, i = text[k], k + 1
            while i < n and text[i] != q and not (text[i] == "\n" and q != "`" and line_mark != "--"):
                i += 2 if text[i] == "\\" else 1
            if not (q == '"' and line_mark == "--"):  # quoted names of SQL stay
                clear(k + 1, i)
            k = i + 1
        else:
            k += 1
    return "".join(out)


CREATE = re.compile(r"(?is)\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+|materialized\s+|unique\s+)*(table|view|function|procedure|index|type|trigger)\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)")
USES = re.compile(r"(?i)\b(from|join|into|update|references)\s+([A-Za-z_\"][\w.\"]*)")


def sql_rows(path: str, text: str) -> list[dict]:
    out, clean = [], blanked(text, "--", nested=True, quotes="'\"")
    line = lambda k: clean.count("\n", 0, k) + 1
    for statement in re.finditer(r"[^;]*;?", clean):
        body = statement[0]
        m = CREATE.search(body)
        source = path
        if m:
            name = m[2].replace('"', "")
            source = f"{path}#{name}"
            kind = {"function": "function", "procedure": "function", "type": "type"}.get(m[1].lower(), "class")
            out.append({"record": "node", "base": source, "name": name.rsplit(".", 1)[-1], "kind": kind, "start_line": line(statement.start() + m.start()), "end_line": line(max(statement.start(), statement.end() - 1)), "exported": True, "signature": " ".join(body[m.start() : m.end()].split())})
            out.append({"record": "intent", "base": path, "relation": "contains", "target": source, "line": line(statement.start() + m.start())})
        with_names = {x.lower() for x in re.findall(r"(?i)(?:\bwith\b(?:\s+recursive)?|,)\s*(\w+)\s+as\s*\(", body)}
        for u in USES.finditer(body):
            target = u[2].replace('"', "")
            if target.lower() not in with_names and target.lower() not in ("select", "only", "lateral", "set"):
                out.append({"record": "intent", "base": source, "relation": "references", "target": target, "line": line(statement.start() + u.start())})
    return out


#: How declarations look: (pattern, kind); group 1 is the name, a group ``owner`` its receiver. By file suffix.
SHAPES = {
    "go": [(r"^func\s+(?:\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\((?P<args>[^)]*)\)", "function"), (r"^type\s+(\w+)\s+(?=interface)", "interface"), (r"^type\s+(\w+)\s+(?=struct)", "struct"), (r"^type\s+(\w+)\s+(?!interface|struct)", "type")],
    "java": [(r"\b(?:class|record)\s+(\w+)", "class"), (r"\binterface\s+(\w+)", "interface"), (r"\benum\s+(\w+)", "enum"), (r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)+[\w<>\[\], ?]+\s+(\w+)\s*\((?P<args>[^)]*)\)\s*(?:throws[\w\s,.]+)?(?=[{;])", "method")],
    "js": [(r"\bclass\s+(\w+)", "class"), (r"\binterface\s+(\w+)", "interface"), (r"\benum\s+(\w+)", "enum"), (r"\bfunction\s*\*?\s+(\w+)\s*(?:<[^>]*>)?\((?P<args>[^)]*)\)", "function"), (r"\b(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\((?P<args>[^)]*)\)|\w+)\s*(?::[^=]+)?=>", "function"), (r"^\s+(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(\w+)\s*\((?P<args>[^)]*)\)\s*(?::\s*[\w<>\[\]|., ]+)?\s*(?=\{)", "method")],
    "rust": [(r"\bfn\s+(\w+)\s*(?:<[^>]*>)?\((?P<args>[^)]*)\)", "function"), (r"\bstruct\s+(\w+)", "struct"), (r"\benum\s+(\w+)", "enum"), (r"\btrait\s+(\w+)", "interface"), (r"\bmod\s+(\w+)(?=\s*\{)", "module")],
    "c": [(r"\b(?:class|struct)\s+(\w+)(?=[^;(]*\{)", "struct"), (r"^[\w*&:<>,\s]+?\b(\w+)\s*\((?P<args>[^;{}()]*)\)\s*(?:const\s*)?(?=\{)", "function")],
}
FAMILY = {"go": "go", "java": "java", "rs": "rust", "c": "c", "h": "c", "cc": "c", "cpp": "c", "hpp": "c"}
IMPORTS = {"go": r'"([\w./-]+)"', "java": r"^\s*import\s+(?:static\s+)?([\w.]+)", "js": r"""(?:from|import|require\()\s*['"]([^'"]+)['"]""", "rust": r"^\s*use\s+([\w:]+)", "c": r'#include\s*[<"]([^>"]+)[>"]'}
#: How a parameter or a local names its type: (pattern, group of the name, group of the type).
TYPED = {
    "go": [(r"(\w+)\s+\*?(?:\w+\.)?([A-Z]\w*)(?=\s*[,)])", 1, 2), (r"\bvar\s+(\w+)\s+\*?(?:\w+\.)?([A-Z]\w*)", 1, 2), (r"(\w+)\s*:=\s*&?(?:\w+\.)?([A-Z]\w*)\s*\{", 1, 2)],
    "java": [(r"\b([A-Z]\w*)(?:<[^<>]*>)?\s+(\w+)\s*(?=[,)=;:])", 2, 1)],
    "js": [(r"\b(\w+)\??\s*:\s*([A-Z]\w*)", 1, 2), (r"\b(\w+)\s*=\s*new\s+([A-Z]\w*)", 1, 2)],
    "rust": [(r"\b(\w+)\s*:\s*&?(?:mut\s+)?([A-Z]\w*)", 1, 2), (r"\blet\s+(?:mut\s+)?(\w+)\s*=\s*([A-Z]\w*)\s*(?:::|\{)", 1, 2)],
    "c": [(r"\b([A-Z]\w*)\s*[*&]?\s+[*&]?(\w+)\s*(?=[,)=;])", 2, 1)],
}
#: Methods that an interface asks for, in Go's own form.
ASKED = re.compile(r"^[ \t]*([A-Za-z_]\w*)[ \t]*\(([^()]*)\)[^\n{]*$", re.M)
CALL = re.compile(r"(?:(\w+)\s*(?:\.|->|::)\s*)?(\w+)\s*\(")
WORDS = set("import package if for while switch catch return function func fn sizeof new else match loop and or not in class struct def typeof await defer go select case throw yield super".split())
BRANCH = re.compile(r"\b(?:if|for|while|case|catch|match)\b|&&|\|\||\?(?![.:?])")


BRACKETS = re.compile(r"[()\[\]{},]")


def arguments(clean: str, at: int) -> int | None:
    """How many arguments stand between an open bracket that ends before ``at`` and its close; None if that isn't there."""
    depth, n = 1, 0
    for b in BRACKETS.finditer(clean, at):
        if b[0] == ",":
            n += depth == 1
        else:
            depth += 1 if b[0] in "([{" else -1
        if not depth:
            return n + 1 if n or clean[at : b.start()].strip() else 0
    return None


def result_count(tail: str) -> int:
    """How many results a Go signature gives, by what stands behind its parameters."""
    tail = tail.strip()
    if not tail.startswith("("):
        return int(bool(tail))
    return arguments(tail, 1) or 0


def generic_rows(path: str, text: str) -> list[dict]:
    fam = FAMILY.get(path.rsplit(".", 1)[-1], "js")
    clean = blanked(text, "//", nested=fam == "rust", quotes='"' if fam in ("rust", "c", "java") else "\"'`")
    breaks = [m.start() for m in re.finditer("\n", clean)]
    from bisect import bisect_left, bisect_right

    line = lambda k: bisect_left(breaks, k) + 1
    reserved = WORDS if fam == "go" else WORDS - {"go", "defer", "select", "func", "fn", "package"}
    defs = []
    for pattern, kind in SHAPES[fam]:
        for m in re.finditer(pattern, clean, re.M):
            name = next(g for k, g in enumerate(m.groups(), 1) if g and m.re.groupindex.get("owner") != k and m.re.groupindex.get("args") != k)
            group = m.groupdict()
            if name in reserved:
                continue
            end = clean.find("{", m.end())
            stop = clean.find("\n", m.end())
            if end < 0 or (stop >= 0 and end > stop and clean[m.end() : end].strip()):
                end = len(clean) if stop < 0 else stop
            else:
                depth = 0
                for b in re.compile(r"[{}]").finditer(clean, end):
                    depth += 1 if b[0] == "{" else -1
                    if not depth:
                        end = b.end()
                        break
            args = [a for a in (group.get("args") or "").split(",") if a.strip() and a.strip() not in ("self", "&self", "&mut self")]
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            defs.append([start, end, name, "method" if group.get("owner") else kind, group.get("owner"), args, m[0]])
    defs.sort(key=lambda d: (d[0], -d[1]))
    out, stack, named, asking = [], [], [], []
    packages = {m[1].rsplit('/', 1)[-1] for m in re.finditer(IMPORTS[fam], text, re.M)} if fam == "go" else set()
    for d in defs:
        while stack and stack[-1][1] <= d[0]:
            stack.pop()
        scope = [s[2] for s in stack]
        owner = d[4] or (stack[-1][2] if stack and stack[-1][3] in ("class", "struct", "interface", "enum") else None)
        base = path + "#" + ".".join(([d[4]] if d[4] else scope) + [d[2]])
        callable_ = d[3] in ("function", "method")
        shown = d[2][:1].isupper() if fam == "go" else not re.search(r"\bprivate\b", d[6]) if fam in ("java", "js") else "pub" in text[max(0, d[0] - 12) : d[0]] or fam == "c"
        out.append({"record": "node", "base": base, "name": d[2], "kind": "method" if callable_ and owner else d[3], "owner": owner, "start_line": line(d[0]), "end_line": line(max(d[0], d[1] - 1)), "signature": " ".join(text[d[0] : d[0] + len(d[6].lstrip())].split())[:400], "exported": shown} | ({"arity": len(d[5]), "variadic": any("..." in a for a in d[5]), "complexity": 1 + len(BRANCH.findall(clean, d[0], d[1]))} if callable_ else {}) | ({"results": result_count(clean[d[0] + len(d[6].lstrip()) : clean.find("{", d[0])])} if callable_ and fam == "go" and "{" in clean[d[0] :] else {}))
        out.append({"record": "intent", "base": path + ("#" + ".".join(scope) if scope else ""), "relation": "contains", "target": base, "line": line(d[0])})
        if fam == "go" and d[3] == "interface":
            for m in ASKED.finditer(clean, clean.find("{", d[0]) + 1, d[1]):
                asked = [a for a in m[2].split(",") if a.strip()]
                at = m.start(1)
                out.append({"record": "node", "base": f"{base}.{m[1]}", "name": m[1], "kind": "method", "owner": d[2], "start_line": line(at), "end_line": line(at), "signature": " ".join(m[0].split())[:400], "exported": m[1][:1].isupper(), "arity": len(asked), "variadic": "..." in m[2], "results": result_count(m[0][m[0].rindex(m[2] + ")") + len(m[2]) + 1 :])})
                out.append({"record": "intent", "base": base, "relation": "contains", "target": f"{base}.{m[1]}", "line": line(at)})
                asking.append((at, m.end()))
        if m := re.search(r"\b(extends|implements)\s+([\w, ]+)", clean[d[0] : clean.find("{", d[0]) if clean.find("{", d[0]) > 0 else d[1]]):
            out += [{"record": "intent", "base": base, "relation": m[1], "target": x.strip(), "line": line(d[0])} for x in m[2].split(",") if x.strip()]
        stack.append(d)
        env = {}
        if callable_:
            if fam == "go" and (m := re.match(r"\s*func\s+\(\s*(\w+)\s+\*?(\w+)", d[6])):
                env[m[1]] = m[2]
            for pattern, who, what in TYPED[fam]:
                env |= {m[who]: m[what] for m in re.finditer(pattern, clean[d[0] : d[1]])}
        named.append((d[0], d[1], base, d[0] + len(d[6].lstrip()), env, owner))
    starts = [x[0] for x in named]
    for m in CALL.finditer(clean):
        if m[2] in reserved:
            continue
        k = bisect_right(starts, m.start(2)) - 1
        if k >= 0 and named[k][0] <= m.start(2) < named[k][3]:
            continue  # a declaration's own name
        if any(a <= m.start(2) < b for a, b in asking):
            continue
        while k >= 0 and named[k][1] <= m.start(2):
            k -= 1
        env, owner = (named[k][4], named[k][5]) if k >= 0 else ({}, None)
        if m[1] in ("this", "self", "Self") or fam == "java" and not m[1] and owner and not re.search(r"\bnew\s+$", clean[max(0, m.start() - 8) : m.start()]):
            via, known = "self", owner
        elif m[1] and m[1] in packages and m[1] not in env:
            via, known = "package", None
        elif m[1]:
            via, known = "member", env.get(m[1]) or (m[1] if m[1][:1].isupper() else None)
        else:
            via, known = "member" if clean[m.start(2) - 1 : m.start(2)] == "." else None, None
        out.append({"record": "intent", "base": named[k][2] if k >= 0 else path, "relation": "calls", "target": m[2], "receiver": m[1], "via": via, "recv_type": known, "args": arguments(clean, m.end()), "line": line(m.start(2))})
    for m in re.finditer(IMPORTS[fam], text, re.M):
        if fam != "go" or re.search(r"import\s*(\([^)]*)?$|^\s*(\w+\s+)?$", text[text.rfind("\n", 0, m.start()) + 1 : m.start()]):
            out.append({"record": "intent", "base": path, "relation": "imports", "target": m[1], "line": line(m.start())})
    return out


def _extracted(batches):
    for batch in batches:
        for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
            rows = rows_of(path, text)
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in ARROW.names} for r in rows], schema=ARROW)


def extract(files: DataFrame) -> DataFrame:
    """Definitions and intents of ``files (path, text)``; one file at a time is parsed. Files are dealt over as many tasks as shuffles have,
    since few bytes of text, which adaptive execution would leave to a few tasks, are much work."""
    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return files.select("path", "text").repartition(tasks, "path").mapInArrow(_extracted, FIELDS)
