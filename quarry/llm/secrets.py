"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Candidates are found by pattern in whole texts: the base kinds assign, access and hex, and bare tokens (long runs that mix
upper case, lower case and digits) outside every base span. Their SHA-256 digests are aggregated over the corpus by
distinct repositories and owners: a value that ``EXAMPLE_OWNERS`` owners or ``EXAMPLE_REPOS`` repositories have is a widely
copied example, any other is its owner's and looks live. Base spans always stay; a bare token is only taken for a secret (kind
``owned``) if it looks live.

Places come from the text itself: each match is wrapped in marks by one regular-expression pass, and lengths between marks
are summed. Marks that a text already holds are masked by another control character first, which no pattern reads.

Nulls: a null text is empty; a null owner or id counts as one owner or repository more. Texts with the same id are told
apart by a hash; rows that repeat give equal rows and count once. Empty tables give no rows. Spans are in code points,
end exclusive. A value in a third of all documents is pre-aggregated by owner and repository before it is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_hash

#: Base kinds in the order that breaks ties, and what they look like (fixed values): prefix, value, least length of the value.
KINDS = ("assign", "access", "hex", "owned")
PATTERNS = (
    (r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 6),
    (r"()(AKIA[A-Z0-9]+)", 20),
    (r"()([0-9a-f]+)", 24),
)
BARE = r"()([A-Za-z0-9+/_=-]{20,})"
#: From how many distinct owners, or repositories whoever owns them, a value is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 25
OPEN, MID, CLOSE, MASK = "\u0001", "\u0002", "\u0003", "\u0004"
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def wrapped(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, f"{OPEN}$1{MID}$2{CLOSE}")


def spans(marked: Column, kind: int, least: int) -> Column:
    """The matches in a marked text whose value has ``least`` characters or more: (start, kind, end, value)."""
    pieces = F.split(marked, OPEN)
    start = F.struct(F.length(pieces[0]).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc, piece):
        mid, close = F.instr(piece, MID), F.instr(piece, CLOSE)
        end = acc["at"] + close - 2
        found = F.struct(acc["at"].alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.substring(piece, mid + 1, close - mid - 1).alias("value"))
        out = F.when(close - mid - 1 >= least, F.concat(acc["out"], F.array(found))).otherwise(acc["out"])
        return F.struct((end + F.length(piece) - close).alias("at"), out.cast(SPAN).alias("out"))

    found = F.aggregate(F.slice(pieces, 2, F.size(pieces)), start, step, lambda acc: acc["out"])
    return F.when(F.instr(marked, OPEN) > 0, found).otherwise(F.array().cast(SPAN))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None) -> DataFrame:
    """Per row: ``doc_id, th, owner, repo, base`` (sorted base spans) and ``bare`` (bare tokens outside them), values digested."""
    t = F.coalesce(F.col(text), F.lit(""))
    repo = F.col(repository or doc_id).cast("string")
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_hash(F.col(text)).alias("th"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(repo, F.lit("")).alias("repo"), t.alias("t"))
    marked = F.col("t").contains(OPEN) | F.col("t").contains(MID) | F.col("t").contains(CLOSE)
    rows = rows.withColumn("t", F.when(marked, F.regexp_replace("t", f"[{OPEN}{MID}{CLOSE}]", MASK)).otherwise(F.col("t")))
    # a run must be long enough before it is wrapped where that can't change what a later match sees
    quick = [PATTERNS[0][0], r"()(AKIA[A-Z0-9]{16,})", r"()([0-9a-f]{24,})", BARE]
    rows = rows.select("doc_id", "th", "owner", "repo", *[wrapped(F.col("t"), p).alias(f"m{k}") for k, p in enumerate(quick)])
    found = [spans(F.col(f"m{k}"), k, least) for k, (_, least) in enumerate(PATTERNS)]
    mixed = F.filter(spans(F.col("m3"), 3, 20), lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[a-z]"))
    rows = rows.select("doc_id", "th", "owner", "repo", F.array_sort(F.concat(*found)).alias("base"), mixed.alias("bare"))
    apart = F.filter("bare", lambda x: ~F.exists("base", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    digest = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.unhex(F.sha2(x["value"], 256)).alias("digest")))
    return rows.select("doc_id", "th", "owner", "repo", digest(F.col("base")).alias("base"), digest(apart).alias("bare"))


def ownership(found: DataFrame) -> DataFrame:
    """``found (digest, owner, repo)`` -> ``digest, n_owners, n_repos``, exact."""
    each = found.groupBy("digest", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = each.groupBy("digest", "owner").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count(F.lit(1)).alias("n_owners"))
    by_repo = each.groupBy("digest", "repo").agg(F.lit(1).alias("one")).groupBy(F.col("digest").alias("r_digest")).agg(F.count(F.lit(1)).alias("n_repos"))
    return by_owner.join(by_repo, F.col("digest") == F.col("r_digest")).drop("r_digest")


def listed(c: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(c, lambda x: F.concat(F.element_at(kinds, x["kind"] + 1), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, **names: str) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_example``, and
    ``most_repos``, the most repositories that any of its values is in."""
    rows = cut(scan(docs, **names), "secrets")
    each = rows.select("doc_id", "th", "owner", "repo", F.explode(F.concat("base", "bare")).alias("x")).select("doc_id", "th", "owner", "repo", "x.*")
    each = cut(each, "candidates")
    counts = ownership(each.select("digest", "owner", "repo"))
    judged = each.select("doc_id", "th", "start", "kind", "end", F.col("digest").alias("d")).distinct().join(counts, F.col("d") == F.col("digest"))
    wide = (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repos") >= EXAMPLE_REPOS)
    judged = judged.filter((F.col("kind") < 3) | ~wide)
    per_doc = judged.groupBy(F.col("doc_id").alias("j_id"), F.col("th").alias("j_th")).agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"),
        F.count(F.when(F.col("kind") == 3, 1)).alias("n_owned"),
        F.count(F.when(~wide, 1)).alias("n_live"),
        F.count(F.when(wide, 1)).alias("n_example"),
        F.max("n_repos").alias("most_repos"),
    )
    both = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("j_id")) & (F.col("th") == F.col("j_th")), "left")
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return both.select(
        "doc_id",
        *[number(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        F.coalesce(listed(F.col("all")), F.lit("")).alias("spans"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_owned", "n_live", "n_example", "most_repos")],
    )


def redact(docs: DataFrame, mark: str = "[secret]", **names: str) -> DataFrame:
    """``docs`` with the text of every base span's match replaced by ``mark``; columns unchanged."""
    text = names.get("text", "text")
    t = F.col(text)
    for (pattern, least), value in zip(PATTERNS, ("[A-Za-z0-9+/_.=-]", "[A-Z0-9]", "[0-9a-f]")):
        last = pattern.rindex("(")
        body = pattern[:last] + ("(AKIA" if "AKIA" in pattern else "(") + value + "{%d,})" % (least - 4 * ("AKIA" in pattern))
        t = F.regexp_replace(t, body, "$1" + mark)
    return docs.withColumn(text, t)
