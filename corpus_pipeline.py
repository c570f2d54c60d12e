"""From raw documents to token ids: the stages of a corpus, each over what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recapspark.llm import bpe, mixing, queries, secrets, simhash, toxicity
from recapspark.operators.storage import stored


#: Columns that the stages work on; all others travel in one struct, so no name can clash.
CORE = ("doc_id", "text", "source")


def packed(docs: DataFrame) -> DataFrame:
    others = [F.col(f"`{c}`") for c in docs.columns if c not in CORE]
    return docs.select(*CORE, F.struct(*others).alias("others"))


def unpacked(df: DataFrame, columns: list[str], **changed) -> DataFrame:
    """The documents again; ``changed`` gives new values of some columns."""
    return df.select(
        *[
            changed[c].alias(c)
            if c in changed
            else F.col(c)
            if c in CORE
            else F.col("others").getField(c).alias(c)
            for c in columns
        ]
    )


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    model = queries.toxicity_model(docs.select("doc_id", "text"), sf_dir)
    scored = toxicity.score(packed(docs), model)
    return unpacked(scored.filter(F.col("_score") < toxicity.THRESHOLD), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of every group of close fingerprints.

    Of rows of a group that share the smallest id one stays. A document without id goes if
    its group has one with an id; groups without any id stay as they are.
    """
    found = simhash.near_duplicates(docs.select("doc_id", "text"))
    nameless = F.col("id").isNull() & F.col("component").isNull()
    stay = (
        found.filter((F.col("id") == F.col("component")) | nameless)
        .groupBy("id", F.when(nameless, F.col("hash")).otherwise(F.col("root")).alias("_own"))
        .agg(F.min("hash").alias("_keep"))
        .select(F.col("id").alias("_id"), "_keep")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_keep"))
    hashed = packed(docs).withColumn("_hash", simhash.text_hash(F.col("text")))
    kept = hashed.join(stay, same, "left_semi")
    named = kept.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "_hash"])
    return unpacked(named.unionByName(kept.filter(F.col("doc_id").isNull())), docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark; ``n_chars`` follows the text."""
    scanned = secrets.scan(packed(docs), secrets.fit(docs.select("doc_id", "text")))
    text = secrets.redact(F.col("text"), F.col("_spans"))
    cleaned = scanned.withColumn("_clean", text)
    changed = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        given = F.col("others").getField("n_chars")
        changed["n_chars"] = (
            F.when(F.size("_spans") > 0, F.length("_clean")).otherwise(given).cast("long")
        )
    return unpacked(cleaned, docs.columns, **changed)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: left out, once, or twice."""
    mixed = mixing.mix(packed(docs)).filter(F.col("_times") > 0)
    copies = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return unpacked(copies, docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number and digest of its token ids and the digest of their decoding."""
    return bpe.digests(docs, queries.word_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("bpe", tokenize),
]

#: Trained models and token ids are beyond SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
