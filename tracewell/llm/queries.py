"""The opN_ queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.runtime import read_table


def _small_batches(spark: SparkSession) -> None:
    """Few rows in an Arrow batch, as texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.llm.simhash import near_duplicates

    _small_batches(spark)
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.llm.url_filter import judge

    return judge(read_table(spark, sf_dir, "pages"))


def op3_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.llm.cap_filters import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.llm.topk import top_k

    return top_k(read_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.llm.language_id import held_out
    from tracewell.llm.quality import learn, score

    _small_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.llm.mixing import draws

    taken = draws(read_table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).cast("long").alias("taken"))


def op7_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.llm.private_data import spans_of

    return spans_of(read_table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.llm.masked_lm import learn, score, tokenised

    _small_batches(spark)
    tokens = tokenised(read_table(spark, sf_dir, "documents"))
    return score(tokens, learn(tokens))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tracewell.llm.byte_bpe import digest_documents

    _small_batches(spark)
    return digest_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.llm.language_id import held_out, identify, learn

    _small_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    judged = identify(docs.select("doc_id", "text"), learn(docs))
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 takes from rules alone, for which there is SQL."""
    from tracewell.llm.url_filter import RULES, host_and_path, rule_of

    host, path = host_and_path(F.col("url"))
    rows = read_table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), RULES)
    return rows.select("page_id", "host", "path", rule.alias("rule"), says.alias("says"))


QUERIES = {f.__name__: f for f in (url_rules, op1_simhash, op2_url_filter, op3_cap_filters, op4_topk, op5_quality, op6_mixing, op7_private_data, op8_lm_score, op9_byte_bpe, op10_language_id)}
_RULES = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) r(rh, rp, says)),
f AS (SELECT page_id, arg_max({'rule': rh || rp, 'says': says}, length(rh || rp)) AS x FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT h.page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, x.rule AS rule, x.says AS says FROM h LEFT JOIN f ON f.page_id = h.page_id
"""
#: Classes of equal vectors are not needed here: all pairs of a label are compared.
_OP3 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x,
         coalesce(len(embedding) > 0
                  AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
                  AND len(list_filter(embedding, lambda e: e <> 0)) > 0, false) AND label IS NOT NULL AS ok
  FROM embeddings),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.ok AND b.ok AND len(a.x) = len(b.x)
    AND list_inner_product(a.x, b.x) / sqrt(list_inner_product(a.x, a.x) * list_inner_product(b.x, b.x)) >= 0.93),
reach AS (SELECT vec_id AS n, vec_id AS m FROM v UNION SELECT r.n, l.b FROM reach r JOIN link l ON l.a = r.m),
comp AS (SELECT n, min(m) AS component_id FROM reach GROUP BY n),
cnt AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT v.vec_id, coalesce(cnt.n_links, 0)::BIGINT AS n_links, comp.component_id, v.vec_id = comp.component_id AS kept
FROM v JOIN comp ON comp.n = v.vec_id LEFT JOIN cnt ON cnt.a = v.vec_id
"""
_OP4 = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.row <> c.row AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
_FILL = """,
f{i} AS (
  SELECT d.s, max_by(d.h, {{'a': d.size, 'b': -d.h}}) AS h, max(d.size) AS w
  FROM d JOIN l{p} l ON l.s IS NOT DISTINCT FROM d.s
  WHERE d.size > 0 AND d.size <= l.spare AND d.h > l.cut AND NOT list_contains(l.extra, d.h) GROUP BY d.s),
l{i} AS (
  SELECT l.s, l.cut, l.spare - coalesce(f.w, 0) AS spare, CASE WHEN f.h IS NULL THEN l.extra ELSE list_append(l.extra, f.h) END AS extra
  FROM l{p} l LEFT JOIN f{i} f ON f.s IS NOT DISTINCT FROM l.s)"""
_OP6 = (
    """
WITH d AS (
  SELECT doc_id, source AS s, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
src AS (
  SELECT s, size, [5, 2, 1][1 + (row_number() OVER (ORDER BY s NULLS LAST) - 1) % 3] AS w
  FROM (SELECT s, sum(size)::BIGINT AS size FROM d GROUP BY s)),
ord AS (
  SELECT *, 1.5::DOUBLE * sum(size) OVER () - coalesce(sum(2 * size) OVER o, 0) AS spare, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rest
  FROM src WINDOW o AS (ORDER BY 2.0::DOUBLE * size / w, s NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT s, size, CASE WHEN spare::DOUBLE / rest * w <= 2 * size THEN w * (SELECT arg_min(spare::DOUBLE / rest, 2.0::DOUBLE * size / w) FROM ord WHERE spare::DOUBLE / rest * w <= 2 * size) ELSE 2.0 * size END::DOUBLE AS target
  FROM ord),
q AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE least(2, floor(target / size)) END::BIGINT AS passes FROM goal),
cum AS (
  SELECT d.s, d.h, d.size, q.target - q.passes * q.size AS quota,
         sum(d.size) OVER (PARTITION BY d.s ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS upto
  FROM d JOIN q ON q.s IS NOT DISTINCT FROM d.s),
l0 AS (
  SELECT s, coalesce(max(h) FILTER (upto <= quota), -1) AS cut, any_value(quota) - coalesce(max(upto) FILTER (upto <= quota), 0) AS spare, []::BIGINT[] AS extra
  FROM cum GROUP BY s)"""
    + "".join(_FILL.format(i=i, p=i - 1) for i in (1, 2, 3))
    + """
SELECT d.doc_id, d.size, q.size AS source_size, q.target,
       (d.size * least(2, q.passes + CASE WHEN d.h <= l3.cut OR list_contains(l3.extra, d.h) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN q ON q.s IS NOT DISTINCT FROM d.s JOIN l3 ON l3.s IS NOT DISTINCT FROM d.s
"""
)
ORACLE: dict[str, str] = {"url_rules": _RULES, "op6_mixing": _OP6, "op3_cap_filters": _OP3, "op4_topk": _OP4}
