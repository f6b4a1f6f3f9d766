"""The corpus pipeline: from ``documents`` to packed training sequences.

Stages, in order: language id (documents without a recognisable language go), exact dedup (one
document of each text stays), SimHash near-dedup (one document of each component stays), mixing
of sources by a curriculum (documents not taken go, those taken twice come twice, in training
order), packing (token pieces of the sequences). Each stage works on all rows its predecessor kept.

Every stage takes rows with any nulls, repeated ids, empty tables and extra columns: rows travel as
one struct beside a key, so no column can clash, and all columns come out unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veerline.llm import exact_dedup, language_id, mixing, packing, simhash
from veerline.llm.common import id_bucket, id_key, row_key, written
from veerline.sources.tables import read_table


def _key():
    return row_key(F.col("doc_id"), F.col("text").cast("string"))


def _rows_with(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of ``docs`` for each of ``keys`` (column ``key``): of rows that repeat id and text, one stays."""
    rows = docs.select(F.struct("*").alias("doc"), _key().alias("key"))
    return rows.join(keys.select("key"), "key", "left_semi").dropDuplicates(["key"]).select("doc.*")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8. Rejects null texts and texts without a letter; when there is no language to learn
    from, nothing else is rejected either. Learns from rows with a language, crc32(id) mod 5 not 0."""
    text = F.col("text").cast("string")
    model = language_id.learn_languages(docs.where(id_bucket(F.col("doc_id"), 5) != 0))
    if not model.langs:
        return docs.where(text.rlike(r"\p{L}"))
    return docs.where(language_id.language_column(spark, model)(text)["lang_pred"] != "und")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1. Of equal texts the row with the largest id stays (without any id: one of them)."""
    kept = exact_dedup.exact_dedup(docs).where("kept")
    return _rows_with(docs, kept.select(F.concat(id_key(F.col("doc_id")), F.lit("|"), "text_sha256").alias("key")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6. Of each component the row with the smallest id stays (ties: the smallest text digest)."""
    members = simhash.near_duplicates(docs, carry=[_key().alias("key")])
    first = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "key")).alias("m"))
    return _rows_with(docs, first.select("m.key"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10. One row per pass of each document the mix takes, in training order."""
    return mixing.training_order(mixing.curriculum_positions(docs)).select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7. One row per piece with its token ids; a document that comes twice is packed twice."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Context trees, components of fingerprints and tokenisers are beyond SQL: tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
