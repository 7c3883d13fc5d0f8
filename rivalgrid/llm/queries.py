"""The registered queries of this package, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivalgrid.llm import alignment, bpe, chat, decontaminate, exact_dedup, mixture, ngram_join, pii, quality, secret_scan, token_counts, topk_search, whitening
from rivalgrid.llm.common import read_table, without_blanks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def _listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: number of tokens, digests of its ids and of its bytes."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded, codec = bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.col("token_ids")
    return encoded.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(codec.decode(ids), 256).alias("decoded_sha256"))


@query("op2_mixture", r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 2) AS part
  FROM documents),
t AS (SELECT source, CAST(sum(size) AS DOUBLE) AS total FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM t),
c AS (SELECT *, total * 3 AS cap, total * 3 / weight AS per FROM w),
b AS (
  SELECT *, (sum(total) OVER () - coalesce(sum(cap) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
  FROM c WINDOW f AS (ORDER BY per, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT level FROM b WHERE level <= per ORDER BY per LIMIT 1),
g AS (
  SELECT source, total, least(cap, coalesce(l.level * weight, cap)) AS target,
         CAST(('0x' || substr(md5('7:' || coalesce('=' || source, 'null')), 1, 8)) AS UBIGINT) / 4294967296.0 AS u
  FROM b LEFT JOIN l ON true),
p AS (
  SELECT d.doc_id, d.size, g.total, g.target, g.u, coalesce(least(g.target / nullif(g.total, 0), 3.0), 0.0) AS each,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.part, d.doc_id NULLS LAST) AS pos
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(total AS BIGINT) AS source_size, round(target, 4) AS target,
       CAST((floor(each * pos + u) - floor(each * (pos - 1) + u)) * size AS BIGINT) AS taken
FROM p""")
def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes from it."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixture.mix(docs, keep_text=False)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


@query("op3_secrets")
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the secrets in it."""
    found = secret_scan.scan(read_table(spark, sf_dir, "documents"))
    order = F.concat("base", "random")
    return found.select(
        "doc_id", *[_count("base", k).alias(f"n_{k}") for k in secret_scan.KINDS], F.size("random").cast("long").alias("n_random"),
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.array_sort(order, secret_scan.by_start)).alias("spans"))


@query("op4_ngram_join", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
  FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 90 * (na + nb - c)),
r AS (SELECT doc_id, doc_id AS reach FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.component_id
FROM s JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) AS m USING (doc_id)""")
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of near copies."""
    return ngram_join.components(read_table(spark, sf_dir, "documents"), words=3, percent=90)


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_exact_dedup", r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents),
r AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) = 1 AS kept
  FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, kept, text_sha256 FROM r""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays for it."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.sha2(without_blanks(F.col("text")).cast("binary"), 256)
    marked = exact_dedup.mark_copies(docs.withColumn("text_sha256", digest), keep_text=False)
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op7_topk", r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every vector whose id is divisible by 20."""
    return topk_search.top_k(read_table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


@query("op8_chat", r"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS pos
  FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
h AS (
  SELECT t.conv_id, p.perspective, pos // 256 AS part, pos, t.role = p.perspective AS own, text,
         '<|im_start|>' || CASE WHEN t.role = p.perspective THEN 'assistant' WHEN t.role = 'system' THEN 'system' ELSE 'user name=' || t.role END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS piece,
         coalesce(sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, perspective, part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begins
  FROM h)
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, count(*) AS n_turns, string_agg(piece, '' ORDER BY pos) AS rendered,
       coalesce(string_agg(CAST(CAST(begins AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(begins + length(text) AS BIGINT) AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE own), '') AS mask
FROM o GROUP BY conv_id, perspective, part""")
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation rendered for each of its participants."""
    return chat.rotate(read_table(spark, sf_dir, "conversations"))


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score."""
    return quality.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the personal data in it."""
    found = pii.find(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[_count("base", k).alias(f"n_{k}") for k in pii.BASE_KINDS], F.size("added").cast("long").alias("n_added"),
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.concat("base", "added")).alias("spans"))


@query("op11_decontaminate", r"""
WITH i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
w AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS size, array_to_string(ws[pos:pos + 9], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS pos FROM i WHERE len(ws) > 0)),
d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
p AS (
  SELECT r, size, pos, array_to_string(ws[pos:pos + size - 1], ' ') AS phrase
  FROM (SELECT r, ws, size, unnest(range(1, len(ws) - size + 2)) AS pos FROM d CROSS JOIN (SELECT DISTINCT size FROM w))),
h AS (SELECT p.r, p.pos, p.size, w.item_id FROM p JOIN w USING (size, phrase)),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(pos, pos + size)) AS x FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)""")
def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words and items of the benchmark in it."""
    judged = decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=10)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return judged.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on the 16 largest components, scaled to unit variance."""
    out = whitening.whiten(read_table(spark, sf_dir, "embeddings"), components=16)
    return out.withColumn("deviation", F.col("deviation").cast("long"))


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the links between its tokens under two vocabularies."""
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align(read_table(spark, sf_dir, "documents"), *paths)[0]


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    return corpus_pipeline.run(spark, sf_dir)
