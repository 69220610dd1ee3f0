"""The queries opN_<name> over the synthetic tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import bpe, decontam, kdshard, lm, packing, secrets, semdedup, simhash, substring, toxicity

#: Where rank files of public tokenizers are looked for.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int):
    """The rows that no label or count is learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 2


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    trie = lm.train(docs.where(~held_out(7)))
    out = lm.score(docs, trie).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out(7).alias("held_out"), "n_tokens", "n_known", F.lit(trie.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    docs = _table(spark, sf_dir, "documents")
    return packing.pack(docs, public.path(VOCABULARY), public.PATTERN, end_id=50256, length=2048)


def op4_kdtree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kdshard.shard(_table(spark, sf_dir, "documents"), ["lang", "source", "n_chars"], shards=16)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    out = bpe.digests(_table(spark, sf_dir, "documents"), public.path(VOCABULARY), public.PATTERN)
    return out.withColumnRenamed("id", "doc_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.groups(_table(spark, sf_dir, "documents"), shingle=3)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semdedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.95).withColumnRenamed("id", "vec_id")


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.drop_repeats(_table(spark, sf_dir, "documents"), window=50, texts=False)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held_out(4))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_secrets": op2_secrets,
    "op3_packing": op3_packing,
    "op4_kdtree_sharding": op4_kdtree_sharding,
    "op5_bpe": op5_bpe,
    "op6_simhash": op6_simhash,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_substring": op8_substring,
    "op9_toxicity": op9_toxicity,
    "op10_decontamination": op10_decontamination,
    "pipeline": pipeline,
}

#: Scores, tests of randomness, trees, BPE, SimHash and classifiers are beyond SQL; tests/llm holds them against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op7_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, e FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
 WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 link AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
 reach(u, w) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.w FROM reach r JOIN link l ON l.u = r.w)
 SELECT u AS vec_id, (SELECT count(*) FROM link WHERE link.u = reach.u) AS n_links, min(w) AS component_id, min(w) = u AS kept FROM reach GROUP BY u""",
    "op8_substring": r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
 first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
 gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM win JOIN first USING (k) WHERE m < doc_id),
 kept AS (SELECT w.doc_id, x.p, x.word FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) x JOIN w ON w.doc_id = x.doc_id ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p),
 k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM kept GROUP BY doc_id)
 SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id""",
}
