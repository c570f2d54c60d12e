"""The operators applied to the given tables: one query each, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recapspark.llm import (
    bpe,
    decontaminate,
    hnsw,
    merkle,
    mixing,
    quality,
    secrets,
    sharding,
    simhash,
    suffixes,
    toxicity,
    warc,
    whitening,
)
from recapspark.llm.oracle import ORACLE_SQL  # noqa: F401

#: Rows per Arrow batch: texts can be long, and a worker holds a batch of them at a time.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_vocabulary() -> str:
    import public_tokenizers

    return bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.fit(docs))
    spans = F.col("_spans")
    return found.select(
        "doc_id",
        *[secrets.number(spans, kind).alias(f"n_{kind}") for kind in secrets.KINDS],
        F.sha2(secrets.listed(secrets.base_only(spans)), 256).alias("base_sha256"),
        secrets.listed(spans).alias("spans"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), word_vocabulary())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good")
    )
    judged = quality.judge(table(spark, sf_dir, "documents"), labels)
    return judged.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc32").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"),
        "n_links",
        F.col("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_times") * F.col("_size")).alias("taken"),
    )


def toxicity_model(docs: DataFrame, sf_dir: str) -> toxicity.Model:
    labels = table(docs.sparkSession, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), "toxic"
    )
    return toxicity.fit(docs, labels)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(docs, sf_dir))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    n_hit = F.size("hits").cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.documents_manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_bpe": op2_bpe,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc": op4_warc,
    "op5_suffix_array": op5_suffix_array,
    "op6_sharding": op6_sharding,
    "op7_hnsw": op7_hnsw,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
    "op11_decontamination": op11_decontamination,
    "op12_whitening": op12_whitening,
    "op13_manifest": op13_manifest,
}
