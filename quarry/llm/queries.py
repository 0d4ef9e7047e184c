"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontamination, mixing, near_dedup, quality, secrets, sharding, substring_dedup, toxicity, warc
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document held against all items: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality: ``doc_id, held_out, score, predicted``; labels of fold 1 of 3 are never learned from."""
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("th")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard: ``doc_id, bytes, shard, shard_depth, shard_bytes``."""
    return sharding.shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity: ``doc_id, held_out, score, predicted``; labels of fold 0 of 5 are never learned from."""
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("th")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near-duplicates: ``doc_id, n_shingles, component_id, kept``."""
    return near_dedup.classes(table(spark, sf_dir, "documents")).drop("th")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences that it repeats: ``doc_id, n_sentences, n_repeated, n_removed, clean_sha256``."""
    out = substring_dedup.strip(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", "n_repeated", "n_removed", "clean_sha256")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share of the mix: ``doc_id, size, source_size, target, taken``."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts by kind, digest of the base spans, all spans, and how they are judged."""
    return secrets.report(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    return warc.roundtrip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of each query: ``query_id, rank, vec_id, score``."""
    return ann.search_table(table(spark, sf_dir, "embeddings"))


WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {WORDS} AS w FROM benchmark),
iw AS (SELECT item, w, least(len(w), {decontamination.WINDOW})::INT AS n FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, unnest([array_to_string(w[p:p + n - 1], ' ') for p in range(1, len(w) - n + 2)]) AS wtext FROM iw),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos,
                 unnest([array_to_string(w[p:p + n - 1], ' ') for p in range(1, len(w) - n + 2)]) AS wtext
          FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT doc_id, pos, n, item FROM grams JOIN win USING (n, wtext)),
words AS (SELECT doc_id, count(*) AS n_hit FROM (
            SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS p FROM (SELECT DISTINCT doc_id, pos, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= {decontamination.MIN_ITEMS} AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP3_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS key
  FROM documents
), b AS (
  SELECT depth, key >> (60 - depth)::INT AS prefix, sum(bytes)::BIGINT AS shard_bytes
  FROM d, (SELECT unnest(range(61)) AS depth) GROUP BY ALL
), leaf AS (
  SELECT x.* FROM b x LEFT JOIN b p ON p.depth = x.depth - 1 AND p.prefix = x.prefix >> 1
  WHERE (x.shard_bytes <= {sharding.LIMIT} OR x.depth = 60) AND (x.depth = 0 OR p.shard_bytes > {sharding.LIMIT})
)
SELECT doc_id, bytes,
       CASE WHEN depth = 0 THEN '' ELSE right(repeat('0', 60) || bin(prefix), depth::INT) END
       || CASE WHEN shard_bytes > {sharding.LIMIT} THEN '-0' ELSE '' END AS shard,
       depth::BIGINT AS shard_depth, shard_bytes
FROM d JOIN leaf ON leaf.prefix = d.key >> (60 - leaf.depth)::INT
"""

OP5_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {near_dedup.WORDS} THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + {near_dedup.WORDS - 1}], ' ') for i in range(1, len(w) - {near_dedup.WORDS - 2})] END)) AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {near_dedup.PERCENT} * (x.n + y.n - k)),
ways AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT ways.b, root FROM reach JOIN ways ON ways.a = reach.doc_id WHERE root < ways.b),
lowest AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN lowest USING (doc_id)
"""

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_BLANK = r"\x20\x09-\x0D"
OP6_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
whole AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM (
            SELECT doc_id, string_split(regexp_replace(t, '([.!?]+[{_BLANK}]+|\n[{_BLANK}]*)', '\1' || chr(1), 'g'), chr(1)) AS ps FROM d)),
listed AS (SELECT doc_id, i, p, regexp_extract_all(p, '[{_BLANK}]*[^{_BLANK}]+[{_BLANK}]*') AS ws FROM whole),
long AS (SELECT doc_id, i, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS w FROM listed WHERE len(ws) > {substring_dedup.BOUND}),
ends AS (SELECT *, (('0x' || substr(md5(trim(w, {_SPACE})), 1, 2))::INT < {substring_dedup.CUT})::INT AS cut FROM long),
own AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM ends),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, part) AS k, p FROM (
        SELECT doc_id, i, 0 AS part, p FROM listed WHERE len(ws) <= {substring_dedup.BOUND}
        UNION ALL SELECT doc_id, i, part, string_agg(w, '' ORDER BY j) FROM own GROUP BY doc_id, i, part)),
s AS (SELECT doc_id, k, row_number() OVER o AS n, s, sum(length(s)) OVER o AS upto, sum(length(s)) OVER o - length(s) AS ahead
      FROM (SELECT doc_id, k, trim(p, {_SPACE}) AS s FROM p WHERE trim(p, {_SPACE}) <> '') WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
fore AS (SELECT a.doc_id, a.n AS lo, greatest(b.n, a.n + {substring_dedup.RUN - 1}) AS hi
         FROM s a ASOF JOIN s b ON a.doc_id = b.doc_id AND a.ahead + {substring_dedup.LEAST} <= b.upto),
back AS (SELECT a.doc_id, least(b.n, a.n - {substring_dedup.RUN - 1}) AS lo, a.n AS hi
         FROM s a ASOF JOIN s b ON a.doc_id = b.doc_id AND a.upto - {substring_dedup.LEAST} >= b.ahead),
span AS (SELECT f.doc_id, lo, hi FROM (SELECT * FROM fore UNION SELECT * FROM back) f JOIN (SELECT doc_id, max(n) AS most FROM s GROUP BY doc_id) m ON f.doc_id = m.doc_id AND lo >= 1 AND hi <= most),
r AS (SELECT span.doc_id, lo, hi, string_agg(s.s, chr(31) ORDER BY s.n) AS run FROM span JOIN s ON s.doc_id = span.doc_id AND s.n BETWEEN lo AND hi GROUP BY span.doc_id, lo, hi),
c AS (SELECT *, min(doc_id) OVER (PARTITION BY run) AS first, max(doc_id) OVER (PARTITION BY run) AS last, min(lo) OVER (PARTITION BY run, doc_id) AS lo0 FROM r),
gone AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS n FROM c WHERE doc_id > first OR lo > lo0),
again AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS n FROM c WHERE first <> last OR lo > lo0),
n AS (SELECT doc_id, count(*) AS n_sentences FROM s GROUP BY doc_id), g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id), a AS (SELECT doc_id, count(*) AS n FROM again GROUP BY doc_id),
shut AS (SELECT doc_id, unnest(range(min_k, max_k + 1)) AS k FROM (SELECT c.doc_id, x.k AS min_k, y.k AS max_k FROM c JOIN s x ON x.doc_id = c.doc_id AND x.n = lo JOIN s y ON y.doc_id = c.doc_id AND y.n = hi WHERE c.doc_id > first OR lo > lo0)),
clean AS (SELECT p.doc_id, string_agg(p.p, '' ORDER BY p.k) AS t FROM p ANTI JOIN shut USING (doc_id, k) GROUP BY p.doc_id)
SELECT doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(a.n, 0) AS n_repeated, coalesce(g.n, 0) AS n_removed, sha256(coalesce(clean.t, '')) AS clean_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN clean USING (doc_id)
"""

OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source
), k AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         lead(2.0::DOUBLE * source_size / w) OVER o AS next_ratio,
         sum(2.0::DOUBLE * source_size) OVER o AS held, sum(w) OVER o AS held_w,
         sum(source_size) OVER () * 1.5::DOUBLE AS want, sum(w) OVER () AS all_w
  FROM s WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), level AS (
  SELECT min(held) AS held, min((want - held) / (all_w - held_w)) AS level FROM (
    SELECT want, 0.0::DOUBLE AS held, 0.0::DOUBLE AS held_w, all_w, (SELECT min(cap / w) FROM k) AS next_ratio FROM (SELECT DISTINCT want, all_w FROM k)
    UNION ALL SELECT want, held, held_w, all_w, next_ratio FROM k WHERE next_ratio IS NOT NULL)
  WHERE next_ratio > (want - held) / (all_w - held_w)
  GROUP BY held_w ORDER BY held_w LIMIT 1
), t AS (
  SELECT source, source_size, least(cap, w * (SELECT level FROM level)) AS target,
         round(least(cap, w * (SELECT level FROM level)))::BIGINT AS goal FROM k
), line AS (
  SELECT doc_id, size, t.*,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ('0x' || substr(md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || size::VARCHAR), 1, 15))::BIGINT, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(a + size, goal) - a) + greatest(0, least(source_size + a + size, goal) - source_size - a))::BIGINT AS taken
FROM line
"""

def _op8_kind(kind: int, pattern: str, least: int, also: str = "") -> str:
    return f"""
  SELECT doc_id, {kind} AS kind, a AS start, a + instr(p, chr(3)) - 2 AS stop,
         substr(p, instr(p, chr(2)) + 1, instr(p, chr(3)) - instr(p, chr(2)) - 1) AS value
  FROM (SELECT *, (sum(length(p) - 2 * (i > 1)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT AS a
        FROM (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p
              FROM (SELECT doc_id, string_split(regexp_replace(t, {pattern}, chr(1) || '\\1' || chr(2) || '\\2' || chr(3), 'g'), chr(1)) AS ps FROM d)))
  WHERE i > 1 AND instr(p, chr(3)) - instr(p, chr(2)) - 1 >= {least}{also}"""


OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS owner, translate(coalesce(text, ''), chr(1) || chr(2) || chr(3), chr(4) || chr(4) || chr(4)) AS t FROM documents
), base AS ({_op8_kind(0, "'((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?[ ]*[:=][ ]*[\"'']?)([A-Za-z0-9+/_.=-]+)'", 6)}
  UNION ALL {_op8_kind(1, "'()(AKIA[A-Z0-9]+)'", 20)}
  UNION ALL {_op8_kind(2, "'()([0-9a-f]+)'", 24)}
), bare AS (
  SELECT * FROM ({_op8_kind(3, "'()([A-Za-z0-9+/_=-]{20,})'", 20)}) b
  WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')
    AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = b.doc_id AND b.start < base.stop AND base.start < b.stop)
), every AS (SELECT * FROM base UNION ALL SELECT * FROM bare),
owners AS (SELECT value, count(DISTINCT doc_id) AS n_repos, count(DISTINCT owner) >= {secrets.EXAMPLE_OWNERS} OR count(DISTINCT doc_id) >= {secrets.EXAMPLE_REPOS} AS wide FROM every JOIN d USING (doc_id) GROUP BY value),
judged AS (SELECT *, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop AS item FROM every JOIN owners USING (value) WHERE kind < 3 OR NOT wide),
per_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(item, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(item, ',' ORDER BY start, kind) AS spans,
         count(*) FILTER (kind = 3) AS n_owned, count(*) FILTER (NOT wide) AS n_live,
         count(*) FILTER (wide) AS n_example, max(n_repos) AS most_repos
  FROM judged GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_owned, 0) AS n_owned, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(most_repos, 0) AS most_repos
FROM d LEFT JOIN per_doc USING (doc_id)
"""

#: Base32 of a SHA-1 in SQL: five hexadecimal digits make four letters.
_B32 = " || ".join(
    f"substr('{warc.ALPHABET}', ((('0x' || substr(code, {i + 1}, 5))::INT >> {s}) & 31) + 1, 1)" for i in range(0, 40, 5) for s in (15, 10, 5, 0)
)
OP9_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS code FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM m
"""

#: The exact answer; the search gives it wherever its beam reaches most of a shard, as on small tables.
OP10_SQL = f"""
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, v.vec_id, max(list_reduce(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * v.v[i]), lambda a, b: a + b)) AS score
          FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.v) = len(v.v) GROUP BY 1, 2)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs) WHERE rank <= {ann.K}
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality": op2_quality,
    "op3_sharding": op3_sharding,
    "op4_toxicity": op4_toxicity,
    "op5_near_dedup": op5_near_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_mixing": op7_mixing,
    "op8_secrets": op8_secrets,
    "op9_warc": op9_warc,
    "op10_ann": op10_ann,
}
ORACLES: dict[str, str] = {"op1_decontamination": OP1_SQL, "op3_sharding": OP3_SQL, "op5_near_dedup": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op7_mixing": OP7_SQL, "op8_secrets": OP8_SQL, "op9_warc": OP9_SQL, "op10_ann": OP10_SQL}
