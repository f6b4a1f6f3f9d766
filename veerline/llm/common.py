"""Shared helpers of the training-data operators.

Cases that hold for every operator here: a null text counts as empty (unless the operator says
otherwise); operators read the columns they name and return their own columns, so extra or
clashing columns of the input never get in the way; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veerline.session import ensure_checkpoint_dir

# Words are runs of anything but these: blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder (``spark.checkpoint.dir``) and read it
    back: cuts the lineage, is shared by several readers, and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) with null texts as empty ones."""
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def id_bucket(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the fixed split into learning and held-out rows."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def id_key(id_col: Column) -> Column:
    """An id as a non-null string: ``=`` and its text, empty for null (no id looks like null)."""
    return F.coalesce(F.concat(F.lit("="), id_col.cast("string")), F.lit(""))


def row_key(id_col: Column, text: Column) -> Column:
    """A non-null key of a row: its id and the SHA-256 of its text (null-safe in joins)."""
    return F.concat(id_key(id_col), F.lit("|"), F.sha2(F.coalesce(text, F.lit("")), 256))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
