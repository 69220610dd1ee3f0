"""A training-data pipeline over documents: stages of operators, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import bpe, decontam, secrets, simhash, toxicity
from tidegrid.llm.queries import VOCABULARY, held_out
from tidegrid.llm.store import cut, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.3. It learns from the table's texts and labels, as query op9 does."""
    small_batches(spark)
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(texts, labels, ~held_out(4))
    return toxicity.score(docs.select(COLUMNS), model).where("score < 0.3").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id. Groups are those of query op6 (SimHash, multi-index
    hashing), joined where texts of them have a similarity of 0.8 or more by shingles of five words."""
    small_batches(spark)
    return simhash.drop_near_copies(docs.select(COLUMNS), "doc_id", "text", shingle=5, similarity=0.8, fp_shingle=3)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    small_batches(spark)
    probes = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontam.overlaps(docs.select("doc_id", "text"), probes).select(F.col("id").alias("doc_id")).distinct()
    return docs.select(COLUMNS).join(found, "doc_id", "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked; n_chars follows the text."""
    masked = secrets.redact(docs.select(COLUMNS), "text")
    return masked.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, with digests of them and of what they decode to."""
    import public_tokenizers as public

    small_batches(spark)
    out = bpe.encode(docs.select("doc_id", "text"), public.path(VOCABULARY), public.PATTERN)
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

#: The classifier, SimHash components and BPE are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
