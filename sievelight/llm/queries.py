"""The registered queries of the pipeline operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import search
from .hard_negatives import mine
from .language_id import identify
from .lm_scoring import score_documents
from .mixing import mix
from .near_dedup import near_duplicates
from .packing import digests, pack
from .quality_classifier import classify
from .quality_rules import judge
from .sentencepiece_sampling import encode_documents
from .substring_dedup import remove_repeats
from .url_filter import judge_urls
from .whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed URLs are those of the pages whose label says toxic (page_id is the doc_id of a label)."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = pages.select("page_id", "url").join(labels.where("toxic = 1").select(F.col("doc_id").alias("page_id")), "page_id", "left_semi")
    return judge_urls(pages, bad)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), min_docs=20, share=0.05, keep=0.5)


def op5_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op6_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), block=16, period=1000)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), alpha=1.0, seed=8)


def op9_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), size=20)


def op11_kronecker_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), moved)


def op12_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents")))


def op13_jacobi_davidson_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_kneser_ney_quality, op2_url_filter, op3_minhash_near_dedup, op4_line_quality, op5_gru_scores, op6_pfair_mixing, op7_language_id, op8_sentencepiece, op9_hilbert_neighbours, op10_substring_dedup,
        op11_kronecker_hard_negatives, op12_bin_slack_packing, op13_jacobi_davidson_whitening,
    )
}
URL_SQL = r"""
WITH listed_pages AS (SELECT p.url FROM pages p WHERE p.page_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
every AS (SELECT page_id, url, 0 AS bad FROM pages UNION ALL SELECT NULL, url, 1 FROM listed_pages),
rest AS (SELECT page_id, bad, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS r FROM every),
parts AS (
  SELECT page_id, bad,
    coalesce(translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rest),
keyed AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || rtrim(path, '/') END AS canonical FROM parts),
bad AS (SELECT DISTINCT canonical FROM keyed WHERE bad = 1 AND canonical IS NOT NULL),
ruled AS (
  SELECT page_id, host, path, canonical, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule
  FROM keyed WHERE bad = 0)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bad.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  bad.canonical IS NOT NULL AS listed
FROM ruled LEFT JOIN bad ON ruled.canonical = bad.canonical
"""

NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(ws[k:k + 4], ' ')) AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS k FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, far) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.far = e.a),
low AS (SELECT doc_id, min(far) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN low USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

SUBSTRING_SQL = r"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, k, array_to_string(ws[k:k + 19], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS k FROM w WHERE len(ws) >= 20)),
again AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY run ORDER BY doc_id, k) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS k FROM again),
each AS (SELECT doc_id, ws[k] AS word, k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM w)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS words, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

NEGATIVE_SQL = r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

MIX_SQL = r"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n, pow(count(*), 0.5) AS weight FROM documents GROUP BY source),
share AS (SELECT source, weight / sum(weight) OVER () * (1000 - count(*) OVER ()) AS share FROM sizes),
cut AS (SELECT source, CAST(floor(share) AS BIGINT) + 1 AS base, share - floor(share) AS rest FROM share),
quota AS (
  SELECT source, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, source NULLS FIRST) <= 1000 - sum(base) OVER () THEN 1 ELSE 0 END AS quota,
    row_number() OVER (ORDER BY coalesce('s' || source, 'n')) AS i
  FROM cut),
lists AS (SELECT list(CAST(quota AS BIGINT) ORDER BY i) AS q, count(*) AS k FROM quota),
turn(t, done, pick) AS (
  SELECT -1, list_transform(q, lambda x: CAST(0 AS BIGINT)), CAST(NULL AS BIGINT) FROM lists
  UNION ALL
  SELECT t + 1, list_transform(range(1, k + 1), lambda i: done[i] + CASE WHEN i = p THEN 1 ELSE 0 END), p
  FROM (
    SELECT t, done, k, list_min(list_transform(
      list_filter(range(1, k + 1), lambda i: done[i] < q[i] AND done[i] * 1000 // q[i] <= t + 1),
      lambda i: ((done[i] + 1) * 1000 + q[i] - 1) // q[i] * 1000000 + i)) % 1000000 AS p
    FROM turn, lists WHERE t < 999)),
plan AS (
  SELECT source, quota, row_number() OVER (PARTITION BY source ORDER BY t) - 1 AS job, t AS slot
  FROM turn JOIN quota ON turn.pick = quota.i WHERE t >= 0),
placed AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY coalesce(md5(CAST(doc_id AS VARCHAR)), ''), doc_id) - 1 AS n FROM documents),
blocks AS (SELECT doc_id, source, n // 16 AS block, n % 16 AS place FROM placed)
SELECT doc_id, b.source, block, place, block // quota * 1000 + slot AS slot,
  block // quota * 1000 + job * 1000 // quota AS release,
  block // quota * 1000 + ((job + 1) * 1000 + quota - 1) // quota AS deadline,
  (block // quota * 1000 + slot) * 16 + place AS mix_pos
FROM blocks b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source AND b.block % p.quota = p.job
"""

LINE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
t AS (SELECT rid, i, w, lead(w, 1) OVER p AS b, lead(w, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM t WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, w, b, c) > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY rid),
sizes AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY rid),
cut AS (SELECT rid, doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (
  SELECT rid, doc_id, source, text, line, len(ws) AS n, array_to_string(ws, ' ') AS norm
  FROM (SELECT *, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM cut)
  WHERE len(ws) > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid),
hosts AS (SELECT source, count(DISTINCT {'d': doc_id, 't': text}) AS all_docs FROM d GROUP BY source),
common AS (
  SELECT l.source, norm FROM (SELECT source, norm, count(DISTINCT {'d': doc_id, 't': text}) AS n FROM lines GROUP BY source, norm) l
  JOIN hosts h ON h.source IS NOT DISTINCT FROM l.source WHERE n > 20 AND n > 0.05 * all_docs),
gone AS (SELECT rid, sum(n) AS n FROM lines l JOIN common c ON c.source IS NOT DISTINCT FROM l.source AND c.norm = l.norm GROUP BY rid),
all_of AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS gone
  FROM d LEFT JOIN sizes USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - gone >= 0.5 * n_words) AS kept, CAST(gone AS BIGINT) AS n_line_words_removed
FROM all_of
"""

ORACLE_SQL: dict[str, str] = {"op2_url_filter": URL_SQL, "op4_line_quality": LINE_SQL, "op6_pfair_mixing": MIX_SQL, "op11_kronecker_hard_negatives": NEGATIVE_SQL, "op3_minhash_near_dedup": NEAR_SQL, "op10_substring_dedup": SUBSTRING_SQL}
