"""The registered queries opN_<name> and the SQL that DuckDB holds against them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import ctph, media, minhash, mixing, packing, suffixes, superkmers, tokenfile, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query
def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second replica has decayed where the first byte of the url's MD5 is 0 (payload reversed) or 1 (a space added), and lost records where it is 2."""
    mark = F.substring(F.md5(F.coalesce(F.col("url"), F.lit("")).cast("binary")), 1, 2)
    decayed = F.when(mark == "00", F.reverse("html")).when(mark == "01", F.concat("html", F.lit(" "))).otherwise(F.col("html"))
    return warc.audited_pages(_read(spark, sf_dir, "pages"), decayed, mark == "02")


@query
def op2_media_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.to_media(_read(spark, sf_dir, "documents")))


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_apart(_read(spark, sf_dir, "documents"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@query
def op5_superkmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.cut_digests(_read(spark, sf_dir, "documents"))


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).drop("copies")


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.count_document_tokens(_read(spark, sf_dir, "documents"))


@query
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_components(_read(spark, sf_dir, "documents"), 3, 85)


@query
def op9_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.fingerprint_documents(_read(spark, sf_dir, "documents"))


@query
def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.cut_digests(_read(spark, sf_dir, "documents"))


# DuckDB SQL over the same tables. Words: runs of other than the six ASCII white-space bytes.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL["op1_merkle_fixity"] = """
WITH slots AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, substr(md5(coalesce(url, '')), 1, 2) AS mark,
         row_number() OVER (ORDER BY page_id NULLS LAST, url NULLS FIRST, sha256(coalesce(html, ''))) - 1 AS position
  FROM pages
), records AS (
  SELECT *, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Record-ID: <urn:md5:', md5(url || chr(10) || html), '>', chr(13), chr(10),
                   'WARC-Target-URI: ', url, chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', strlen(html), chr(13), chr(10), chr(13), chr(10),
                   html, chr(13), chr(10), chr(13), chr(10)) AS record
  FROM slots
)
SELECT page_id, position, position // 4096 AS warc_file,
       cast(coalesce(sum(strlen(record)) OVER (PARTITION BY position // 4096 ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset,
       cast(strlen(record) AS BIGINT) AS record_bytes, sha256(record) AS record_sha256,
       CASE WHEN mark = '02' THEN 'missing' WHEN mark = '01' OR (mark = '00' AND reverse(html) <> html) THEN 'corrupt' ELSE 'intact' END AS status
FROM records
"""

ORACLE_SQL["op5_superkmers"] = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
windows AS (
  SELECT doc_id, i, list_aggregate(words[i:i + 12], 'string_agg', ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM docs)
),
firsts AS (SELECT win, min(doc_id) AS least FROM windows GROUP BY win),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i
  FROM windows JOIN firsts USING (win) WHERE least < doc_id
),
kept AS (
  SELECT d.doc_id, string_agg(d.word, ' ' ORDER BY d.i) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM docs) d
  ANTI JOIN covered c ON d.doc_id = c.doc_id AND d.i = c.i GROUP BY d.doc_id
)
SELECT docs.doc_id, cast(len(words) AS BIGINT) AS n_words, cast(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept ON docs.doc_id = kept.doc_id
"""

ORACLE_SQL["op8_minhash"] = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, list_aggregate(words[i:i + 2], 'string_agg', ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM docs)
    UNION ALL SELECT doc_id, list_aggregate(words, 'string_agg', ' ') FROM docs WHERE len(words) IN (1, 2)
  )
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
  ) p JOIN sizes m ON m.doc_id = p.a JOIN sizes n ON n.doc_id = p.b
  WHERE 100 * shared >= 85 * (m.n + n.n - shared)
), edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM docs
  UNION
  SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.other = edges.a
)
SELECT r.doc_id, cast(coalesce(any_value(s.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id, r.doc_id = min(r.other) AS kept
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""

ORACLE_SQL["op6_mixing"] = f"""
WITH sized AS (
  SELECT doc_id, source, cast(len({_WORDS}) AS BIGINT) AS size,
         cast('0x' || substr(md5(concat('{mixing.SEED}', '|', coalesce(cast(doc_id AS VARCHAR), ''), '|', coalesce(text, ''))), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS chance
  FROM documents
), sources AS (
  SELECT source, cast(sum(size) AS BIGINT) AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS point FROM sources
), prefixed AS (
  SELECT *, row_number() OVER w AS rank,
         (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM ranked WINDOW w AS (ORDER BY point, place)
), bar AS (SELECT min(rank) AS rank, arg_min(level, rank) AS level FROM prefixed WHERE level < point),
goals AS (
  SELECT source, source_size, CASE WHEN bar.rank IS NULL OR prefixed.rank < bar.rank THEN cap ELSE weight * bar.level END AS target
  FROM prefixed CROSS JOIN bar
)
SELECT doc_id, size, source_size, target,
       cast(size * (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM (
  SELECT doc_id, size, source_size, target, chance, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
  FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source
)
"""

ORACLE_SQL["op10_suffixes"] = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
strings AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM docs)
),
firsts AS (SELECT s, min({'doc_id': doc_id, 'i': i}) AS least FROM strings GROUP BY s HAVING count(*) > 1),
later AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before
  FROM strings JOIN firsts USING (s) WHERE {'doc_id': doc_id, 'i': i} > least
),
spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (
    SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM later
  ) GROUP BY doc_id, run
),
edges AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans
),
heads AS (
  SELECT e.doc_id, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept, max(b) AS last, cast(sum(b - a) AS BIGINT) AS removed, count(*) AS n_spans
  FROM edges e JOIN docs ON docs.doc_id = e.doc_id GROUP BY e.doc_id
)
SELECT docs.doc_id, cast(n AS BIGINT) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN heads ON docs.doc_id = heads.doc_id
"""
