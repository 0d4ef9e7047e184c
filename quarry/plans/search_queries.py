"""Text and search operators over the documents, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import search as S

from .registry import Registry
from .relations import Relations, with_relations

R = Registry()
QUERY = "entre worthless was idiots from"


def fold_sql(t: str) -> str:
    """The folding of a term, in SQL."""
    a = f"CASE WHEN length({t}) >= 5 AND {t} LIKE '%ies' THEN left({t}, -3) || 'y' WHEN length({t}) >= 5 AND regexp_matches({t}, '(s|x|z|ch|sh)es$') THEN left({t}, -2) WHEN length({t}) >= 4 AND {t} LIKE '%s' AND NOT regexp_matches({t}, '(ss|us|is)$') THEN left({t}, -1) ELSE {t} END"
    return a


def stem_sql(t: str) -> str:
    return f"CASE WHEN length({t}) >= 6 AND {t} LIKE '%ing' THEN left({t}, -3) WHEN length({t}) >= 5 AND {t} LIKE '%ed' THEN left({t}, -2) ELSE {t} END"


def undouble_sql(t: str, s: str) -> str:
    return f"CASE WHEN {s} <> {t} AND length({s}) >= 4 AND right({s}, 1) = substr({s}, -2, 1) AND contains('{X.DOUBLED}', right({s}, 1)) THEN left({s}, -1) ELSE {s} END"


STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def folded_ctes(source: str) -> str:
    """CTE ``terms``: the columns of ``source (id, field, t)`` with t a text, exploded to folded terms."""
    return f"""
raw AS (SELECT id, field, unnest(regexp_split_to_array(lower(regexp_replace(regexp_replace(t, '([A-Z]+)([A-Z][a-z]{{2}})', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+')) AS w FROM {source}),
f0 AS (SELECT id, field, w FROM raw WHERE length(w) > 1 AND w NOT IN ({STOP})),
f1 AS (SELECT id, field, {fold_sql('w')} AS w FROM f0),
f2 AS (SELECT id, field, w, {stem_sql('w')} AS s FROM f1),
f3 AS (SELECT id, field, {undouble_sql('w', 's')} AS w FROM f2),
terms AS (SELECT id, field, CASE WHEN length(w) >= 4 AND w LIKE '%e' THEN left(w, -1) ELSE w END AS term FROM f3)"""


FIELDS = "fields AS (SELECT id, 'name' AS field, name AS t FROM docs UNION ALL SELECT id, 'path', path FROM docs UNION ALL SELECT id, 'body', body FROM docs)"


@R.query(with_relations(f"WITH {FIELDS}, {folded_ctes('fields')}, tf AS (SELECT DISTINCT id, term FROM terms) SELECT term, count(*) AS df FROM tf GROUP BY term", "docs"))
def text_document_frequency(r: Relations):
    return S.document_frequency(r.index())


@R.query(with_relations(f"WITH {FIELDS}, {folded_ctes('fields')} SELECT id, field, term, count(*) AS tf FROM terms GROUP BY ALL", "docs"))
def text_index(r: Relations):
    return S.index_terms(r.index())


@R.query(with_relations(f"WITH words AS (SELECT DISTINCT 0 AS id, p_name || ' ' || p_type AS field, p_name || ' ' || p_type AS t FROM part), {folded_ctes('words')} SELECT field AS text, list(term ORDER BY term) AS terms FROM terms GROUP BY field").replace("list(term ORDER BY term)", "string_agg(term, ' ' ORDER BY term)"))
def text_terms(r: Relations):
    t = r.table("part").select(F.concat_ws(" ", "p_name", "p_type").alias("text")).distinct()
    return t.select("text", F.array_join(F.array_sort(X.terms(F.col("text"))), " ").alias("terms"))


Q = X.query_terms(QUERY)
_Q = ", ".join(f"'{w}'" for w in Q)
LEX = f"""
WITH {FIELDS}, {folded_ctes('fields')},
len AS (SELECT docs.id, copy, scope, file, coalesce(n, 0) AS n FROM docs LEFT JOIN (SELECT id, count(*) AS n FROM terms WHERE field = 'body' GROUP BY id) USING (id)),
st AS (SELECT count(*) AS n_docs, avg(n) AS avg_len FROM len),
tf AS (SELECT id, field, term, count(*) AS f FROM terms WHERE term IN ({_Q}) GROUP BY ALL),
df AS (SELECT term, count(DISTINCT id) AS df FROM tf GROUP BY term),
q AS (SELECT term, k, ln(1 + n_docs / (1 + coalesce(df, 0))) AS idf FROM (SELECT unnest([{_Q}]) AS term, unnest(range({len(Q)})) AS k) LEFT JOIN df USING (term), st),
hit AS (
  SELECT id, copy, scope, file,
    coalesce(sum(f * idf) FILTER (field = 'name'), 0) AS s_name, coalesce(sum(f * idf) FILTER (field = 'path'), 0) AS s_path,
    coalesce(sum(idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / avg_len))) FILTER (field = 'body'), 0) AS s_body
  FROM tf JOIN q USING (term) JOIN len USING (id), st GROUP BY ALL),
cov AS (SELECT id, sum(idf) / (SELECT sum(idf) FROM q) AS coverage FROM (SELECT DISTINCT id, term FROM tf) JOIN q USING (term) GROUP BY id),
lex AS (SELECT *, (3 * s_name + 2 * s_path + s_body) * CASE WHEN copy THEN 0.35::DOUBLE ELSE 1 END AS score FROM hit JOIN cov USING (id))"""


@R.query(with_relations(LEX + " SELECT id, round(s_name, 6) AS s_name, round(s_path, 6) AS s_path, round(s_body, 6) AS s_body, round(coverage, 6) AS coverage, copy, round(score, 6) AS lexical FROM lex", "docs"))
def search_lexical(r: Relations):
    """Every document that holds a term of the query, scored: fields, BM25, coverage, penalty."""
    out = S.scored(r.index(), QUERY)
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("s_name", "s_path", "s_body", "coverage", "lexical")], "copy")


def hits(r: Relations):
    return S.scored(r.index(), QUERY).select("id", F.round("lexical", 6).alias("score"), "scope", "file")


HITS = LEX + ", hits AS (SELECT id, scope, file, round(score, 6) AS score FROM lex)"


@R.query(with_relations(LEX + " SELECT term, round(idf, 6) AS idf FROM q ORDER BY idf DESC, k LIMIT 1", "docs"))
def search_distinctive(r: Relations):
    term, idf = S.distinctive(r.index(), QUERY)
    return r.spark.createDataFrame([(term, round(idf, 6))], "term string, idf double")


@R.query(with_relations(HITS + " SELECT file, id, score FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, id) AS k FROM hits) WHERE k = 1", "docs"))
def search_file_best(r: Relations):
    return S.file_best(hits(r))


@R.query(with_relations(HITS + " SELECT scope, max(score) AS best, max(score) >= 0.25::DOUBLE * (SELECT max(score) FROM hits) AS takes_part FROM hits GROUP BY scope", "docs"))
def search_scope_gate(r: Relations):
    return S.scope_gate(hits(r))


GATE = HITS + ", open AS (SELECT scope FROM hits GROUP BY scope HAVING max(score) >= 0.25::DOUBLE * (SELECT max(score) FROM hits))"


@R.query(with_relations(GATE + """, ranked AS (SELECT id, row_number() OVER (PARTITION BY scope ORDER BY score DESC, id) AS pos FROM hits WHERE scope IN (FROM open) AND score > 0),
  f AS (SELECT id, min(pos) AS pos, sum(1.0::DOUBLE / (60 + pos)) AS s FROM ranked GROUP BY id) SELECT id, pos, round(s / max(s) OVER (), 6) AS fused FROM f""", "docs"))
def search_rrf(r: Relations):
    """All positive hits of the scopes that take part, fused."""
    return S.reciprocal(hits(r)).select("id", "pos", F.round("fused", 6).alias("fused"))


@R.query(with_relations(GATE + " SELECT id, round(score / max(score) OVER (), 6) AS fused FROM hits WHERE scope IN (FROM open)", "docs"))
def search_max_fusion(r: Relations):
    return S.max_fusion(hits(r)).select("id", F.round("fused", 6).alias("fused"))


@R.query(with_relations(HITS + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, id) AS pos FROM hits),
  head AS (SELECT file, score AS g, id AS g_id FROM ranked WHERE pos = 1)
  SELECT id, file, pos FROM ranked JOIN head USING (file) ORDER BY pos, g DESC, g_id LIMIT 30""", "docs"))
def search_round_robin(r: Relations):
    return S.round_robin(hits(r), "file", 30)


@R.query(with_relations(HITS + """, seed AS (SELECT file, sum(score) AS weight FROM hits GROUP BY file),
  rank AS (SELECT id, weight / max(weight) OVER () AS rank FROM docs JOIN seed USING (file)),
  share AS (SELECT id, score / max(score) OVER () AS lex FROM hits)
  SELECT id, round((coalesce(lex, 0) + 0.5::DOUBLE * coalesce(rank, 0)) * CASE WHEN copy THEN 0.35::DOUBLE ELSE 1 END, 6) AS score
  FROM docs LEFT JOIN share USING (id) LEFT JOIN rank USING (id) WHERE lex IS NOT NULL OR rank >= 0.15""", "docs"))
def search_blend(r: Relations):
    """Lexical scores blended with a rank of files by their hits, and documents of good files rescued."""
    h = hits(r)
    seed = h.groupBy("file").agg(F.sum("score").alias("weight"))
    top = seed.agg(F.max("weight").alias("top"))
    docs = r.index().docs
    rank = docs.select("id", "file").join(seed, "file").join(F.broadcast(top)).select("id", (F.col("weight") / F.col("top")).alias("rank"))
    out = S.blended(h.select("id", F.col("score").alias("lexical")), rank, docs.select("id", "copy"))
    return out.select("id", F.round("score", 6).alias("score"))


@R.query(with_relations(HITS + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, id) AS pos FROM hits),
  head AS (SELECT file, score AS g, id AS g_id FROM ranked WHERE pos = 1),
  d AS (SELECT id, file, score * pow(0.9::DOUBLE, pos - 1) AS s, row_number() OVER (ORDER BY score * pow(0.9::DOUBLE, pos - 1) DESC, g DESC, g_id, pos)::INT AS place FROM ranked JOIN head USING (file))
  SELECT place, id, file, round(s, 6) AS score FROM d WHERE place <= 40""", "docs"))
def search_decay(r: Relations):
    """The choice over files, each hit of a file decaying the next."""
    return S.decayed(hits(r), 40).withColumn("score", F.round("score", 6))


@R.query(with_relations("SELECT id, file, line, left(trim(text), 160) AS text FROM lines WHERE regexp_matches(text, '\\b(token|secret)\\s*=')", "lines"))
def grep_regex(r: Relations):
    return S.grep(r.lines(), r"\b(token|secret)\s*=")


@R.query(with_relations("SELECT id, file, line, left(trim(text), 160) AS text FROM lines WHERE contains(lower(text), 'mail1.example')", "lines"))
def grep_fixed(r: Relations):
    return S.grep(r.lines(), "MAIL1.example", ignore_case=True, fixed=True)


@R.query(with_relations("""
WITH hit AS (SELECT id, file, line FROM lines WHERE regexp_matches(text, '(?i)worthless|loser'))
SELECT file, count(*) AS n, count(*) OVER () AS files, (SELECT greatest(0, count(*) - 300) FROM hit) AS truncated
FROM (SELECT * FROM hit ORDER BY file, id, line LIMIT 300) GROUP BY file""", "lines"))
def grep_grouped(r: Relations):
    """Hits by file, of the first 300 in scan order (the report's cap), with the number left out."""
    groups, total = S.grep_groups(S.grep(r.lines(), "worthless|loser", ignore_case=True))
    files = groups.agg(F.count(F.lit(1)).alias("files"))
    return groups.select("file", "n").join(F.broadcast(files)).join(F.broadcast(total.select("truncated")))


@R.query(with_relations(f"""
WITH raw0 AS (SELECT id * 1000000 + line AS id, 'x' AS field, text AS t FROM lines), {folded_ctes('raw0')},
n AS (SELECT id // 1000000 AS id, id % 1000000 AS line, count(DISTINCT term) AS k FROM terms WHERE term IN ({_Q}) GROUP BY 1, 2),
w AS (SELECT id, unnest(range(greatest(1, line - 6), line + 1)) AS start, k FROM n), s AS (SELECT id, start, sum(k) AS hits FROM w GROUP BY ALL)
SELECT id, start, hits::BIGINT AS hits FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, start) AS p FROM s) WHERE p = 1""", "lines"))
def search_best_window(r: Relations):
    return S.best_window(r.lines(), QUERY)


@R.query("SELECT doc_id AS id, floor((length(text) + length(regexp_replace(text, '[^\U00010000-\U0010FFFF]', '', 'g'))) / 4 + 0.5::DOUBLE)::BIGINT AS tokens, substr(sha256(text), 1, 24) AS ref FROM documents")
def text_content_refs(r: Relations):
    """Token estimates (UTF-16 units over four, half up) and content references."""
    d = r.table("documents")
    return d.select(F.col("doc_id").alias("id"), X.tokens_estimate(F.col("text")).alias("tokens"), F.substring(F.sha2("text", 256), 1, 24).alias("ref"))
