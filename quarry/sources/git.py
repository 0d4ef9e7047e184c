"""Change history and diffs, as text that a version control prints, parsed on executors."""

from __future__ import annotations

import re
import subprocess
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.analysis import is_bot

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What a history reads, what a file of a diff keeps, and the form of a no-reply address.
MONTHS, COMMITS, HUNK_LINES, FILE_LINES = 36, 400, 24, 200
NOREPLY = r"(?i)^(?:\d+\+)?([A-Za-z0-9](?:-?[A-Za-z0-9]){0,38})@users\.noreply\.github\.com$"


def parse_log(records: DataFrame) -> DataFrame:
    """``hash, at_ms, name, email, path`` of ``records (record)``: ``hash\\x1fISO time\\x1fname\\x1femail`` and a line for each path."""
    head = F.split(F.element_at(F.split("record", "\n"), 1), "\x1f")
    paths = F.filter(F.slice(F.split("record", "\n"), 2, 1_000_000), lambda x: x != "")
    rows = records.select(head[0].alias("hash"), F.unix_millis(F.to_timestamp(head[1])).alias("at_ms"), head[2].alias("name"), head[3].alias("email"), F.explode(paths).alias("path"))
    return rows


def people(commits: DataFrame, now_ms: int) -> DataFrame:
    """History that counts for ownership: no bots, the last 36 months."""
    start = F.unix_millis(F.add_months(F.timestamp_millis(F.lit(now_ms)), -MONTHS).cast("timestamp"))
    return commits.filter(~is_bot(F.col("name"), F.col("email")) & (F.col("at_ms") >= start))


def handle(email: Column) -> Column:
    """The handle in a no-reply address, else null."""
    got = F.regexp_extract(F.trim(email), NOREPLY, 1)
    return F.when(got != "", got)


def since_label(at_ms: Column, now_ms: int) -> Column:
    days = F.floor((F.lit(now_ms) - at_ms) / 86_400_000)
    return (
        F.when(days < 1, "today").when(days < 2, "yesterday").when(days < 30, F.concat(days.cast("string"), F.lit("d ago")))
        .when(days < 365, F.concat(F.floor(days / 30).cast("string"), F.lit("mo ago"))).otherwise(F.concat(F.floor(days / 365).cast("string"), F.lit("y ago")))
    )


HUNK = re.compile(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")
#: Rows, and letters of patches, of a batch that is handed on.
PATCH_ROWS, PATCH_CHARS = 5_000, 4 << 20
ADDED, REMOVED = re.compile(r"\n\+(.*)"), re.compile(r"\n-(.*)")
PATCH = "path string, old_path string, status string, range_id long, start long, end long, added array<string>, removed array<string>"


def unquoted(name: str) -> str:
    """A path as it is on disk; names with odd bytes come in double quotes with octal escapes."""
    if not (name.startswith('"') and name.endswith('"')):
        return name
    known = {"n": b"\n", "t": b"\t", "r": b"\r", "a": b"\a", "b": b"\b", "f": b"\f", "v": b"\v"}
    raw = b"".join(bytes([int(m[1], 8)]) if m[1] else known.get(m[2], m[2].encode()) if m[2] else m[3].encode() for m in re.finditer(r"\\([0-7]{3})|\\(.)|([^\\]+)", name[1:-1]))
    return raw.decode("utf-8", "replace")


def parse_patch(text: str) -> list[dict]:
    out: list[dict] = []
    blocks = ("\n" + text).split("\ndiff --git ")[1:]
    for block in [b + "\n" for b in blocks[:-1]] + blocks[-1:]:
        # a pattern that may begin at any line tries every letter: the head is searched first
        head = block[: block.find("\n@@ ") + 1] or block
        new, old = (re.search(x, head) or re.search(x, block) for x in (r"(?m)^\+\+\+ (?:b/)?(.+)$", r"(?m)^--- (?:a/)?(.+)$"))
        moved = re.search(r"(?m)^rename from (.+)\nrename to (.+)$", block) if "rename from " in block else None
        path = unquoted(moved[2] if moved else new[1].rstrip("\t") if new and new[1] != "/dev/null" else old[1].rstrip("\t") if old else "").removeprefix("b/")
        status = "deleted" if new and new[1] == "/dev/null" else "added" if old and old[1] == "/dev/null" else "renamed" if moved else "modified"
        kept, hunks = 0, list(HUNK.finditer(block))
        for k, m in enumerate(hunks):
            stop = block.find("\n@@ ", m.end())
            body = block[m.end() : None if stop < 0 else stop]
            n = int(m[2]) if m[2] else 1
            room = max(0, min(HUNK_LINES, FILE_LINES - kept))
            kept += body.count("\n")
            out.append({"path": path, "old_path": unquoted(moved[1]) if moved else None, "status": status, "range_id": k, "start": int(m[1]), "end": int(m[1]) + max(n, 1) - 1, "added": ADDED.findall(body)[:room], "removed": REMOVED.findall(body)[:room]})
        if not hunks:
            out.append({"path": path, "old_path": unquoted(moved[1]) if moved else None, "status": status, "range_id": 0, "start": None, "end": None, "added": [], "removed": []})
    return out


def patches(texts: DataFrame) -> DataFrame:
    """Changed ranges of ``texts (patch)``, patches with no lines of context; handed on when their rows or letters are many."""
    schema = pa.schema([("path", pa.string()), ("old_path", pa.string()), ("status", pa.string()), ("range_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.list_(pa.string())), ("removed", pa.list_(pa.string()))])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for text in batch.column("patch").to_pylist():
                rows += parse_patch(text or "")
                size += len(text or "")
                if len(rows) >= PATCH_ROWS or size >= PATCH_CHARS:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return texts.select("patch").mapInArrow(run, PATCH)


# Reading a repository: the driver runs git where the repository lies, and what it prints becomes rows. History is bounded by the
# numbers above; listings and patches are as long as the repository's.


def git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-c", "core.quotePath=false", "-c", "safe.directory=*", "-C", root, *args], capture_output=True, check=False)
    if done.returncode:
        raise ValueError(f"git {args[0]}: {done.stderr.decode('utf-8', 'replace').strip()}")
    return done.stdout.decode("utf-8", "replace")


def safe_ref(ref: str) -> str:
    """A revision's name; one that git would take for an option is refused."""
    if not ref or ref.startswith("-"):
        raise ValueError(f"not a revision: {ref!r}")
    return ref


def visible(spark: SparkSession, root: str, submodules: bool = False, nested: bool = False) -> DataFrame:
    """``path`` of what git shows: tracked, and untracked but not ignored; files of submodules, and of other repositories inside, only
    if asked for."""
    staged = [x.split("\t", 1) for x in git(root, "ls-files", "-s", "-z").split("\0") if x]
    inner = sorted({p for mode, p in staged if mode.startswith("160000")})
    own = {p for mode, p in staged if not mode.startswith("160000")}
    loose = {p for p in git(root, "ls-files", "-z", "--others", "--exclude-standard").split("\0") if p}
    own |= {p for p in loose if not p.endswith("/")}
    below = ([p for p in inner] if submodules else []) + ([p.rstrip("/") for p in sorted(loose) if p.endswith("/")] if nested else [])
    for folder in below:
        try:
            own |= {f"{folder}/{r['path']}" for r in visible(spark, f"{root}/{folder}", submodules, nested).collect()}
        except ValueError:  # a submodule that isn't checked out shows nothing
            continue
    return spark.createDataFrame([(p,) for p in sorted(own)], "path string")


def history(spark: SparkSession, root: str, commits: int = COMMITS, months: int = MONTHS, paths: tuple[str, ...] = ()) -> DataFrame:
    """The last commits that are no merges, as parse_log gives them."""
    out = git(root, "log", f"-n{commits}", "--no-merges", f"--since={months} months ago", "--name-only", "--format=%x1e%H%x1f%cI%x1f%an%x1f%ae", "--", *paths)
    return parse_log(spark.createDataFrame([(x.strip("\n"),) for x in out.split("\x1e") if x.strip()], "record string"))


STATUS = {"A": "added", "D": "deleted", "M": "modified", "T": "modified", "R": "renamed", "C": "added"}


def name_status(text: str) -> list[tuple[str, str, str | None]]:
    """(path, status, old path) of NUL-separated fields; a rename has two paths."""
    fields, out = [x for x in text.split("\0") if x], []
    while fields:
        kind = fields.pop(0)[0]
        old = fields.pop(0) if kind in "RC" else None
        if fields:
            out.append((fields.pop(0), STATUS.get(kind, "modified"), old if kind == "R" else None))
    return out


def changes(spark: SparkSession, root: str, base: str, head: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(``path, status, old_path``; changed ranges as patches gives them) between ``base`` and ``head``, or what is on disk."""
    refs = [safe_ref(base)] + ([safe_ref(head)] if head else [])
    names = name_status(git(root, "diff", "-z", "--name-status", "-M", *refs, "--"))
    patch = git(root, "diff", "-M", "--unified=0", "--no-color", *refs, "--")
    return spark.createDataFrame(names, "path string, status string, old_path string"), patches(spark.createDataFrame([(patch,)], "patch string"))


def authors(spark: SparkSession, root: str, base: str, head: str = "HEAD") -> DataFrame:
    """``name, email`` of those who wrote what ``head`` has and ``base`` lacks, named as authors or in co-author trailers."""
    span = f"{safe_ref(base)}..{safe_ref(head)}"
    out = git(root, "log", span, "--format=%an%x1f%ae%x1f%(trailers:key=Co-authored-by,valueonly,separator=%x1e)%x00")
    rows = set()
    for entry in out.split("\0"):
        parts = entry.strip("\n").split("\x1f")
        if len(parts) == 3:
            rows.add((parts[0], parts[1]))
            rows |= {(m[1].strip(), m[2]) for x in parts[2].split("\x1e") if (m := re.match(r"(.*)<([^<>]+)>\s*$", x.strip()))}
    return spark.createDataFrame(sorted(rows), "name string, email string")
