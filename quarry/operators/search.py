"""Ranked search over documents ``(id, name, path, body, scope, file, copy)``.

Documents are tokenised once, into an index kept as Parquet: a row for each term and document with its counts by field, dealt
over folders by the term's hash and sorted, so that a query reads its own terms' rows only; what it needs to know of the
documents (length, scope, file, copy); and the corpus's totals. An index of another version, or over other documents, is absent.
"""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.functions.text import count_terms, query_terms, raw_terms, terms_among
from quarry.plans.cuts import cut, discard

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed values of the score: field weights, BM25, the penalty of copies, the graph's weight, floors and ratios.
NAME, PATH, BODY = 3.0, 2.0, 1.0
K1, B = 1.2, 0.75
COPY_PENALTY, GRAPH_WEIGHT, RESCUE_FLOOR, PARTICIPATION, FILE_DECAY, RRF = 0.35, 0.5, 0.15, 0.25, 0.9, 60
FIELDS = ("name", "path", "body")
INDEX_VERSION, BUCKETS = 3, 32
#: Rows of terms that a task hands on at once.
BATCH_ROWS = 50_000


@dataclass
class Index:
    postings: DataFrame  # term, id, n_name, n_path, n_body, bucket
    docs: DataFrame  # id, body_len, scope, file, copy
    n_docs: int
    avg_len: float


def bucket_of(term):
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


def signature_of(docs: DataFrame) -> str:
    """What an index was made of: the documents' number and a sum over their contents."""
    n, total = docs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("id", *FIELDS, "scope", "file", "copy").cast("decimal(38,0)"))).first()
    return f"{INDEX_VERSION}:{n}:{total}"


def write_index(docs: DataFrame, path: str, signature: str = "") -> None:
    # one pass over the texts: a row for each term of a document, and one without term, with its body's length
    counted = docs.select("id", *FIELDS, "scope", "file", "copy")
    kinds = {f.name: f for f in counted.schema}
    schema = T.StructType([kinds["id"], T.StructField("term", T.StringType()), *[T.StructField(f"n_{f}", T.LongType()) for f in FIELDS], *[T.StructField(c, kinds[c].dataType) for c in ("scope", "file", "copy")]])
    rows = cut(counted.mapInArrow(_counted, schema), "terms")
    counts = rows.filter("term IS NOT NULL").groupBy("term", "id").agg(*[F.sum(f"n_{f}").alias(f"n_{f}") for f in FIELDS]).withColumn("bucket", bucket_of(F.col("term")))
    counts.repartitionByRange("bucket", "term", "id").sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{path}/postings")
    own = rows.filter("term IS NULL").select("id", F.col("n_body").alias("body_len"), "scope", "file", "copy")
    own.write.parquet(f"{path}/docs")
    discard(rows)
    spark = docs.sparkSession
    spark.read.parquet(f"{path}/docs").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("body_len"), F.lit(0.0)).alias("avg_len")).withColumns({"version": F.lit(INDEX_VERSION), "signature": F.lit(signature)}).write.json(f"{path}/corpus")


def _counted(batches):
    folded: dict[str, str | None] = {}
    for batch in batches:
        at, rows = [], []
        for k, texts in enumerate(zip(*(batch.column(f).to_pylist() for f in FIELDS))):
            name, path, body = (count_terms(t, folded) for t in texts)
            rows.append((None, 0, 0, sum(body.values())))
            rows += [(t, name.get(t, 0), path.get(t, 0), body.get(t, 0)) for t in name | path | body]
            at += [k] * (len(rows) - len(at))
            if len(rows) >= BATCH_ROWS:
                yield _rows_of(batch, at, rows)
                at, rows = [], []
        if rows:
            yield _rows_of(batch, at, rows)


def _rows_of(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
    own, documents = pa.array(at, pa.int64()), pa.array([r[0] is None for r in rows])
    counts = [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3)]
    facts = [pc.if_else(documents, x, pa.scalar(None, x.type)) for x in (batch.column(c).take(own) for c in ("scope", "file", "copy"))]
    return pa.RecordBatch.from_arrays([batch.column("id").take(own), pa.array([r[0] for r in rows], pa.string()), *counts, *facts], names=["id", "term", *[f"n_{f}" for f in FIELDS], "scope", "file", "copy"])


def read_index(spark: SparkSession, path: str, signature: str | None = None) -> Index | None:
    """None if what is at ``path`` is of another version or, where a signature is given, of other documents."""
    meta = json.loads(spark.read.text(f"{path}/corpus").first()[0])  # one line
    if meta["version"] != INDEX_VERSION or signature is not None and meta["signature"] != signature:
        return None
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs"), meta["n_docs"], meta["avg_len"])


def postings_of(index: Index, q: list[str]) -> DataFrame:
    """The rows of the query's terms; other folders, and other terms' row groups, are not read."""
    buckets = [r[0] for r in index.postings.sparkSession.range(1).select(F.explode(F.array(*[bucket_of(F.lit(w)) for w in q])) if q else F.lit(-1)).collect()]
    return index.postings.filter(F.col("bucket").isin(buckets) & F.col("term").isin(q)).drop("bucket")


def index_terms(index: Index) -> DataFrame:
    """The inverted index, long: ``id, field, term, tf``."""
    x = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n_{f}").alias("tf")) for f in FIELDS]))
    return index.postings.select("id", "term", x.alias("x")).select("id", "x.field", "term", "x.tf").filter("tf > 0")


def document_frequency(index: Index) -> DataFrame:
    """``term, df``: in how many documents, in any field. A term's rows lie together."""
    return index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def matches(index: Index, query: str) -> tuple[DataFrame, list[str]]:
    """Per document with a term of the query: ``id, body_len, scope, file, copy`` and the counts in each field, as arrays in order
    of the terms."""
    q = query_terms(query)
    count = lambda f: F.array(*[F.coalesce(F.sum(F.when(F.col("term") == w, F.col(f"n_{f}"))), F.lit(0)).cast("long") for w in q]) if q else F.array().cast("array<bigint>")
    few = postings_of(index, q).groupBy(F.col("id").alias("p_id")).agg(*[count(f).alias(f"n_{f}") for f in FIELDS])
    return index.docs.join(few, F.col("id") == F.col("p_id")).drop("p_id"), q


def idf_of(index: Index, q: list[str]) -> dict[str, float]:
    """The query's terms (a handful) and their idf, in order."""
    import math

    df = {r["term"]: r["df"] for r in postings_of(index, q).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    return {w: math.log(1 + index.n_docs / (1 + df.get(w, 0))) for w in q}


def scored(index: Index, query: str, wants_copies: bool = False) -> DataFrame:
    """Per document with a term of the query: ``id, scope, file, copy, s_name, s_path, s_body, lexical, coverage, strong``.

    ``lexical`` = (3 name + 2 path + BM25 body), times the penalty for copies; coverage is the share of the query's idf that
    the document matches in any field, strong in its name."""
    rows, q = matches(index, query)
    weights = [F.lit(x) for x in idf_of(index, q).values()]
    total = lambda parts: sum(parts[1:], parts[0]) if parts else F.lit(0.0)
    flat = lambda f: total([F.col(f"n_{f}")[k] * w for k, w in enumerate(weights)])
    norm = K1 * (1 - B + B * F.col("body_len") / F.lit(index.avg_len or 1.0))
    bm25 = total([w * F.col("n_body")[k] * (K1 + 1) / (F.col("n_body")[k] + norm) for k, w in enumerate(weights)])
    all_idf = total(weights)
    cover = lambda *fs: total([F.when(sum((F.col(f"n_{f}")[k] for f in fs), F.lit(0)) > 0, w).otherwise(0.0) for k, w in enumerate(weights)]) / all_idf
    copy = F.lit(False) if wants_copies else F.coalesce("copy", F.lit(False))
    out = rows.select("id", "scope", "file", copy.alias("copy"), flat("name").alias("s_name"), flat("path").alias("s_path"), F.coalesce(bm25, F.lit(0.0)).alias("s_body"), cover(*FIELDS).alias("coverage"), cover("name").alias("strong"))
    penalty = F.when(F.col("copy"), COPY_PENALTY).otherwise(1.0)
    return out.withColumn("lexical", (NAME * F.col("s_name") + PATH * F.col("s_path") + BODY * F.col("s_body")) * penalty)


def distinctive(index: Index, query: str) -> tuple[str, float] | None:
    """The query's rarest term (the first of equals) and its idf."""
    idf = idf_of(index, query_terms(query))
    return max(idf.items(), key=lambda x: x[1]) if idf else None


def blended(lexical: DataFrame, rank: DataFrame, penalty: DataFrame) -> DataFrame:
    """(lexical / max + half the graph's rank), times the penalty once more; graph hits of RESCUE_FLOOR or more come in on
    their own. ``lexical (id, lexical)``, ``rank (id, rank)``, ``penalty (id, copy)``."""
    top = lexical.agg(F.max("lexical").alias("top"))
    share = lexical.join(F.broadcast(top)).select("id", (F.col("lexical") / F.col("top")).alias("lex"))
    rescued = rank.filter(F.col("rank") >= RESCUE_FLOOR).select("id")
    ids = share.select("id").unionByName(rescued).distinct()
    rows = ids.join(share, "id", "left").join(rank.select("id", "rank"), "id", "left").join(penalty, "id", "left")
    value = (F.coalesce("lex", F.lit(0.0)) + GRAPH_WEIGHT * F.coalesce("rank", F.lit(0.0))) * F.when(F.col("copy"), COPY_PENALTY).otherwise(1.0)
    return rows.select("id", value.alias("score")).filter("score > 0")


def file_best(hits: DataFrame) -> DataFrame:
    """The best hit of each file: ``hits (id, file, score)``."""
    return hits.groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("neg"), "id")).alias("b")).select("file", F.col("b.id").alias("id"), (-F.col("b.neg")).alias("score"))


def scope_gate(hits: DataFrame) -> DataFrame:
    """``scope, best, takes_part``: scopes whose best hit has a quarter of the best overall. ``hits (id, scope, score)``."""
    best = hits.groupBy("scope").agg(F.max("score").alias("best"))
    top = best.agg(F.max("best").alias("top"))
    return best.join(F.broadcast(top)).select("scope", "best", (F.col("best") >= PARTICIPATION * F.col("top")).alias("takes_part"))


def ranks(hits: DataFrame, by: str, top: int) -> DataFrame:
    """``hits`` with ``pos`` (from 1) within ``by``, the first ``top`` of each: cut in each task before they are dealt."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    return hits.withColumn("pos", F.row_number().over(w).cast("long")).filter(F.col("pos") <= top)


def all_ranks(hits: DataFrame, by: str) -> DataFrame:
    """``hits`` with ``pos`` (from 1) within ``by``, all of them: dealt by range and numbered range by range, so that a group
    with most of the rows isn't one task's."""
    order = [F.desc("score"), F.asc("id")]
    dealt = cut(hits.repartitionByRange(F.col(by), *order).withColumn("range_no", F.spark_partition_id()), "ranges")
    # one row a range and group: at most as many as shuffle partitions and groups together
    ahead = Window.partitionBy("r_by").orderBy("r_no").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy(F.col(by).alias("r_by"), F.col("range_no").alias("r_no")).agg(F.count(F.lit(1)).alias("n"))
    ranges = ranges.select("r_by", "r_no", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("r_n"))
    within = Window.partitionBy(by, "range_no").orderBy(*order)
    out = dealt.withColumn("k", F.row_number().over(within)).join(ranges, F.col(by).eqNullSafe(F.col("r_by")) & (F.col("range_no") == F.col("r_no")))
    return out.withColumn("pos", (F.col("k") + F.col("r_n")).cast("long")).drop("range_no", "r_by", "r_no", "r_n", "k")


def reciprocal(hits: DataFrame, top: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion over scopes that take part: sum of 1 / (60 + position), over the largest sum. All positive hits
    are fused, or with ``top`` the first ``top`` of each scope."""
    hits = hits.filter("score > 0")
    open_ = scope_gate(hits).filter("takes_part").select("scope")
    own = hits.join(open_, "scope", "left_semi")
    own = ranks(own, "scope", top) if top else all_ranks(own, "scope")
    fused = own.groupBy("id").agg(F.sum(1.0 / (RRF + F.col("pos"))).alias("s"), F.min("pos").alias("pos"))
    return fused.join(F.broadcast(fused.agg(F.max("s").alias("m")))).select("id", "pos", (F.col("s") / F.col("m")).alias("fused"))


def max_fusion(hits: DataFrame) -> DataFrame:
    """The largest score of each id over scopes that take part, over the largest of all."""
    open_ = scope_gate(hits).filter("takes_part").select("scope")
    own = hits.join(open_, "scope", "left_semi").groupBy("id").agg(F.max("score").alias("s"))
    return own.join(F.broadcast(own.agg(F.max("s").alias("m")))).select("id", (F.col("s") / F.col("m")).alias("fused"))


def round_robin(hits: DataFrame, by: str, n: int) -> DataFrame:
    """The first ``n`` hits, one from each group in turn, groups in order of their best hit."""
    own = ranks(hits, by, n)
    head = own.filter("pos = 1").select(F.col(by).alias("g"), F.col("score").alias("g_score"), F.col("id").alias("g_id"))
    rows = own.join(head, F.col(by) == F.col("g"))
    return rows.orderBy("pos", F.desc("g_score"), "g_id").limit(n).select("id", by, "pos")


def decayed(hits: DataFrame, n: int, decay: float = FILE_DECAY) -> DataFrame:
    """``place, id, file, score``: ``n`` hits, each the head of a file's queue with the largest score times decay**(taken of that file),
    ties to the file met first. As a queue's decayed scores only fall, taking heads one by one is the order of all of them."""
    heads = file_best(hits).select(F.col("file").alias("h_file"), F.col("score").alias("h_score"), F.col("id").alias("h_id"))
    own = ranks(hits, "file", n).join(heads, F.col("file") == F.col("h_file"))
    order = [F.desc("score"), F.desc("h_score"), F.asc("h_id"), F.asc("pos")]
    first = own.withColumn("score", F.col("score") * F.pow(F.lit(decay), F.col("pos") - 1)).orderBy(*order).limit(n)
    place = F.row_number().over(Window.orderBy(*order)).cast("int")  # over n rows
    return first.select(place.alias("place"), "id", "file", "score")


def best_window(lines: DataFrame, query: str, size: int = 7) -> DataFrame:
    """Per document the run of ``size`` lines that holds the most of the query's terms, the first of equals: ``id, start,
    hits``. ``lines (id, line, text)``."""
    q = query_terms(query)
    n = lines.select("id", "line", F.size(F.array_distinct(terms_among(raw_terms(F.col("text")), q))).cast("long").alias("k"))
    # a line of k terms lends them to the windows that begin up to size - 1 lines before it
    lent = n.filter("k > 0").select("id", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("line") - (size - 1)), F.col("line"))).alias("start"), "k")
    sums = lent.groupBy("id", "start").agg(F.sum("k").alias("hits"))
    return sums.groupBy("id").agg(F.min(F.struct((-F.col("hits")).alias("neg"), "start")).alias("b")).select("id", F.col("b.start").alias("start"), (-F.col("b.neg")).alias("hits"))


def grep(lines: DataFrame, pattern: str, ignore_case: bool = False, fixed: bool = False) -> DataFrame:
    """Lines that match: ``id, file, line, text`` (160 UTF-16 units at most). ``fixed``: a plain string. Patterns with look-around
    or back-references are refused, as a linear-time engine has none."""
    import re

    from quarry.functions.text import utf16_left

    if not fixed and re.search(r"\(\?[=!<]|\\[1-9]", pattern):
        raise ValueError("look-around and back-references aren't supported")
    text = F.regexp_replace("text", "\r$", "")
    if fixed:
        hit = F.lower(text).contains(pattern.lower()) if ignore_case else text.contains(pattern)
    else:
        hit = text.rlike(("(?i)" if ignore_case else "") + pattern)
    return lines.filter(hit).select("id", "file", "line", utf16_left(F.trim(text), 160).alias("text"))


def grep_groups(hits: DataFrame, cap: int = 300) -> tuple[DataFrame, DataFrame]:
    """(hits by file: ``file, n, first_line, hits`` of the first ``cap`` hits in scan order; one row: total and left out)."""
    first = hits.orderBy("file", "id", "line").limit(cap)
    groups = first.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("id", "line", "text"))).alias("hits"))
    total = hits.agg(F.count(F.lit(1)).alias("total")).select("total", F.greatest(F.lit(0), F.col("total") - cap).cast("long").alias("truncated"))
    return groups, total
