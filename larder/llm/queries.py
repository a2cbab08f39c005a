"""Registered queries of the training-data operators and their SQL, where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import caps, codebooks, language, minhash, mixture, nearest, pieces, repeats, secrets, token_counts, toxicity, warc, whitening
from larder.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@_query("op1_minhash_near_dedup", """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM words),
sizes AS (SELECT doc_id, len(g)::BIGINT AS n FROM grams),
posts AS (SELECT doc_id, unnest(g) AS s FROM grams),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM posts a JOIN posts b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS comp FROM sizes UNION SELECT e.b, r.comp FROM reach r JOIN both_ways e ON e.a = r.node)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN (SELECT node, min(comp) AS component_id FROM reach GROUP BY 1) ON node = doc_id
""")
def op1(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, d, "documents"), width=3, percent=85)


@_query("op2_token_counts")
def op2(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.histogram(table(spark, d, "documents")))


@_query("op3_toxicity")
def op3(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return toxicity.score_all(documents, toxicity.learn(documents, table(spark, d, "labels")))


@_query("op4_embedding_near_dedup", """
WITH RECURSIVE whole AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v,
         label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
         AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM whole a JOIN whole b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.ok AND b.ok AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS node, vec_id AS comp FROM whole UNION SELECT e.b, r.comp FROM reach r JOIN links e ON e.a = r.node),
counts AS (SELECT a, count(*) AS c FROM links GROUP BY 1),
comps AS (SELECT node, min(comp) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, coalesce(c, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM whole JOIN comps ON node = vec_id LEFT JOIN counts ON a = vec_id
""")
def op4(spark: SparkSession, d: str) -> DataFrame:
    return caps.near_duplicates(table(spark, d, "embeddings"), least=0.98)


@_query("op5_sentencepiece")
def op5(spark: SparkSession, d: str) -> DataFrame:
    return pieces.encode_decode(table(spark, d, "documents"))


@_query("op6_nearest_neighbours", """
WITH whole AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v) AS score
  FROM whole q JOIN whole r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id AND len(q.v) = len(r.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""")
def op6(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return nearest.nearest(rows, rows.where("vec_id % 20 = 0"), k=20)


def _positions(kind: str) -> str:
    pattern, group, least = (secrets.STRONG | secrets.WEAK)[kind]
    pattern = pattern.replace("'", "''")
    measured = f", regexp_extract_all(t, '{pattern}', {group}) AS g"
    return f"""
{kind}_hits AS (
  SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS h, string_split_regex(t, '{pattern}') AS p{measured} FROM texts),
{kind}_steps AS (SELECT doc_id, generate_subscripts(h, 1) AS i, unnest(h) AS h, unnest(p[1:len(h)]) AS p, unnest(g) AS g FROM {kind}_hits WHERE len(h) > 0),
{kind}_ends AS (
  SELECT doc_id, length(h) AS size, length(g) AS measured, sum(length(h) + length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM {kind}_steps),
{kind}_spans AS (
  SELECT doc_id, {secrets.KINDS.index(kind)} AS kind, '{kind}' AS name, (stop - size)::INTEGER AS start, stop::INTEGER AS stop
  FROM {kind}_ends WHERE measured >= {least})"""


def _near(kinds: tuple[str, ...]) -> str:
    numbers = ", ".join(str(secrets.KINDS.index(k)) for k in kinds)
    return f"""EXISTS (SELECT 1 FROM parts o WHERE o.doc_id = w.doc_id AND o.kind IN ({numbers})
      AND (w.start - o.stop BETWEEN 0 AND {secrets.SCOPE} OR o.start - w.stop BETWEEN 0 AND {secrets.SCOPE}))"""


@_query("op7_secret_scan", f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{",".join(_positions(k) for k in secrets.KINDS)},
parts AS ({" UNION ALL ".join(f"SELECT * FROM {k}_spans" for k in secrets.KINDS)}),
linked AS (
  SELECT w.* FROM parts w WHERE w.kind >= {len(secrets.STRONG)}
  AND NOT EXISTS (SELECT 1 FROM parts s WHERE s.doc_id = w.doc_id AND s.kind < {len(secrets.STRONG)} AND s.start < w.stop AND w.start < s.stop)
  AND CASE w.name WHEN 'account' THEN {_near(secrets.SECRETS)}
      WHEN 'opaque' THEN {_near(secrets.IDENTIFIERS)} OR {_near(secrets.ADDRESSES)}
      ELSE {_near(secrets.IDENTIFIERS)} AND {_near(secrets.SECRETS)} END),
strong AS (
  SELECT doc_id, count(*) FILTER (name = 'assign') AS n_assign, count(*) FILTER (name = 'access') AS n_access, count(*) FILTER (name = 'hex') AS n_hex,
         string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) AS base
  FROM parts WHERE kind < {len(secrets.STRONG)} GROUP BY 1),
every AS (
  SELECT doc_id, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) AS spans
  FROM (SELECT * FROM parts WHERE kind < {len(secrets.STRONG)} UNION ALL SELECT * FROM linked) GROUP BY 1)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN strong USING (doc_id) LEFT JOIN every USING (doc_id)
""")
def op7(spark: SparkSession, d: str) -> DataFrame:
    return secrets.scan(table(spark, d, "documents"))


@_query("op8_source_mixture", f"""
WITH RECURSIVE sizes AS (SELECT source, sum(length(coalesce(text, '')))::BIGINT AS n_chars FROM documents GROUP BY 1),
weighed AS (SELECT source, n_chars, pow(n_chars::DOUBLE, 0.5) AS w FROM sizes),
rates AS (
  SELECT source, CASE WHEN n_chars > 0 THEN w / (SELECT sum(w) FROM weighed) * (SELECT sum(n_chars) FROM weighed)::DOUBLE / n_chars ELSE 1.0 END AS rate
  FROM weighed),
cdf AS (
  SELECT source, rate, 0 AS k, -rate AS log_p, exp(-rate) AS total FROM rates WHERE rate > 0
  UNION ALL
  SELECT source, rate, k + 1, log_p + ln(rate) - ln((k + 1)::DOUBLE), total + exp(log_p + ln(rate) - ln((k + 1)::DOUBLE))
  FROM cdf WHERE k + 1 <= ceil(rate + 12 * sqrt(rate) + 30)),
lists AS (SELECT source, list(total) AS totals FROM cdf GROUP BY 1),
drawn AS (
  SELECT doc_id, d.source, ('0x' || md5('{mixture.SEED}|' || coalesce(doc_id::VARCHAR, 'null'))[1:13])::BIGINT::DOUBLE / {2**52} AS u, totals
  FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source),
counted AS (SELECT doc_id, source, len(list_filter(totals, lambda x: x <= u))::INTEGER AS copies FROM drawn),
each AS (SELECT doc_id, source, copies, unnest(range(1, copies + 1))::INTEGER AS copy FROM counted WHERE copies > 0)
SELECT doc_id, source, copies, copy, md5('{mixture.SEED}/order|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy) AS shuffle_key FROM each
""")
def op8(spark: SparkSession, d: str) -> DataFrame:
    mixed = mixture.mix(table(spark, d, "documents").select("doc_id", "text", "source"), keep_text=False)
    return mixed.select("doc_id", "source", F.col("_copies").alias("copies"), F.col("_copy").alias("copy"), F.col("_order").alias("shuffle_key"))


@_query("op9_warc_round_trip", """
WITH alphabet AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a),
payloads AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
hashed AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex FROM payloads),
named AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k:
      a[((('0x' || hex[(k // 4) * 5 + 1:(k // 4) * 5 + 5])::BIGINT >> (15 - 5 * (k % 4))) & 31) + 1]), '') AS payload_digest
  FROM hashed, alphabet),
firsts AS (SELECT payload_digest, payload_bytes, min(page_id) AS first_id FROM named GROUP BY 1, 2)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM named JOIN firsts USING (payload_digest, payload_bytes)
""")
def op9(spark: SparkSession, d: str) -> DataFrame:
    return warc.round_trip(table(spark, d, "pages"))


@_query("op10_language")
def op10(spark: SparkSession, d: str) -> DataFrame:
    return language.identify(table(spark, d, "documents"))


def _codebook_rounds(rounds: int) -> str:
    """Assignment and the entries that follow from it, round by round; the last assignment has no successor."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
near_{k} AS MATERIALIZED (
  SELECT row, part, min(struct_pack(d := d, e := entry)) AS best
  FROM (SELECT row, part, entry, sum((c.x - b.x) * (c.x - b.x)) AS d FROM comps c JOIN book_{k} b USING (part, i) GROUP BY 1, 2, 3) GROUP BY 1, 2)""")
        if k < rounds:
            steps.append(f"""
sums_{k} AS (SELECT part, best.e AS entry, i, sum(x) AS s, count(*) AS c FROM comps JOIN near_{k} USING (row, part) GROUP BY 1, 2, 3),
book_{k + 1} AS MATERIALIZED (
  SELECT part, entry, i, CASE WHEN c IS NULL THEN x ELSE (s - ((s % c) + c) % c) // c END::BIGINT AS x FROM book_{k} LEFT JOIN sums_{k} USING (part, entry, i))""")
    return ",".join(steps)


@_query("op11_vector_codes", f"""
WITH whole AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
places AS (SELECT row, vec_id, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS c, len(v) AS dim FROM whole),
comps AS MATERIALIZED (SELECT row, vec_id, ((i - 1) * {codebooks.PARTS}) // dim AS part, i, floor({codebooks.SCALE} * c)::BIGINT AS x FROM places),
first_ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT DISTINCT vec_id FROM whole ORDER BY 1 LIMIT {codebooks.ENTRIES})),
book_0 AS MATERIALIZED (SELECT part, entry, i, min(x) AS x FROM comps JOIN first_ids USING (vec_id) GROUP BY 1, 2, 3),
{_codebook_rounds(codebooks.ROUNDS)},
named AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM book_{codebooks.ROUNDS}),
coded AS (SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near_{codebooks.ROUNDS} GROUP BY 1),
each AS (SELECT vec_id, label, code, error FROM whole JOIN coded USING (row)),
labels AS (SELECT label, sum(error)::BIGINT AS label_error FROM each GROUP BY 1)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM whole JOIN coded USING (row) JOIN labels l ON whole.label IS NOT DISTINCT FROM l.label, named
""")
def op11(spark: SparkSession, d: str) -> DataFrame:
    return codebooks.compress(table(spark, d, "embeddings"))


@_query("op12_whitening")
def op12(spark: SparkSession, d: str) -> DataFrame:
    white = whitening.whiten(table(spark, d, "embeddings"))
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))


@_query("op13_substring_dedup", f"""
WITH texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
words AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, len(w) AS n FROM texts),
windows AS MATERIALIZED (
  SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {repeats.WINDOW - 1} FOLLOWING) AS s, n FROM words),
least AS (SELECT s, min(doc_id) AS low FROM windows WHERE i + {repeats.WINDOW - 1} <= n GROUP BY 1),
found AS (
  SELECT doc_id, i, word, coalesce(low < doc_id AND i + {repeats.WINDOW - 1} <= n, false) AS hit
  FROM words JOIN windows USING (doc_id, i, n) LEFT JOIN least USING (s)),
covered AS MATERIALIZED (
  SELECT doc_id, i, word, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {repeats.WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM found),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS left_over FROM covered GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
""")
def op13(spark: SparkSession, d: str) -> DataFrame:
    return repeats.digests(table(spark, d, "documents"))


@_query("pipeline")
def pipeline(spark: SparkSession, d: str) -> DataFrame:
    return corpus_pipeline.run(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
