"""The registered queries of this package: each operator with its production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import backoff, bpe, infill, langid, nndescent, packing, quality, ranked, sharding, simhash, suffixes, topk, toxicity
from tessera.llm.rows import remainder
from tessera.session import table


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held(df: DataFrame, by: int, rest: int) -> DataFrame:
    """``df`` with held_out; a row without an id is never learnt from and counts as held out."""
    return df.withColumn("held_out", F.coalesce(remainder("doc_id", by) == rest, F.lit(True)))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(held(docs, 5, 0), model, keep_text=False)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "segments")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.predict(held(docs.select("doc_id", "text"), 3, 1), langid.fit(docs), keep_text=False)
    return out.select("doc_id", "held_out", "lang_pred", "score", "margin", "accepted")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    out = quality.score(held(docs, 4, 2), model, keep_text=False)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_passages", "attention")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(table(spark, sf_dir, "embeddings")).drop("recall")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backoff.score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_tokens", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 4).alias("mean_log_score"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_bytes=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_toxicity, op2_exact_topk, op3_bpe, op4_language, op5_packing, op6_sharding, op7_quality, op8_simhash, op9_embedding_dedup, op10_lm_scores, op11_fill_in_middle, op12_suffix_dedup, op13_ranked_search, pipeline)
    return {f.__name__: f for f in named}


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), walk AS (
  SELECT a AS start, a AS node FROM l
  UNION
  SELECT walk.start, l.b FROM walk JOIN l ON walk.node = l.a
), c AS (SELECT start, min(node) AS component FROM walk GROUP BY start)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links,
  coalesce(c.component, e.vec_id) AS component_id, coalesce(c.component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.start = e.vec_id
"""

OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents), t AS (
  SELECT r, list_filter(regexp_split_to_array(text, '[\\x09-\\x0D ]+'), lambda x: x <> '') AS w FROM d
), p AS (
  SELECT r, i, w[i] AS cur, w[i - 1] AS prev FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM t)
), c1 AS (SELECT cur AS word, count(*) AS c FROM p GROUP BY 1),
c2 AS (SELECT prev, cur, count(*) AS c FROM p WHERE i > 1 GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM p),
s AS (
  SELECT p.r, CASE WHEN i = 1 THEN ln(w.c / n.n) WHEN c2.c >= 2 THEN ln(c2.c / u.c)
    ELSE ln(0.4 * w.c / n.n) END AS s
  FROM p CROSS JOIN n JOIN c1 w ON w.word = p.cur LEFT JOIN c1 u ON u.word = p.prev
  LEFT JOIN c2 ON c2.prev = p.prev AND c2.cur = p.cur
), g AS (SELECT r, count(*) AS n_tokens, sum(s) AS s FROM s GROUP BY r)
SELECT d.doc_id, coalesce(n_tokens, 0) AS n_tokens, round(coalesce(s, 0), 3) AS log_score,
  CASE WHEN n_tokens > 0 THEN round(s / n_tokens, 4) END AS mean_log_score
FROM d LEFT JOIN g ON g.r = d.r
"""

OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d
), k AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
    greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u
), s AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
    coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix FROM k
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
    ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM s
"""

OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT DISTINCT item_id, text,
    unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM benchmark WHERE item_id IS NOT NULL
), g AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d WHERE len(w) > 0),
t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM i) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
s AS (
  SELECT i.item_id, i.text, t.r, t.doc_id,
    sum(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
      * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * t.n * n_docs) // n_terms))))::BIGINT AS score
  FROM i JOIN t USING (term) JOIN f USING (term) CROSS JOIN g WHERE t.doc_id IS NOT NULL GROUP BY ALL
), o AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": OP2_SQL, "op9_embedding_dedup": OP9_SQL, "op10_lm_scores": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op13_ranked_search": OP13_SQL}
