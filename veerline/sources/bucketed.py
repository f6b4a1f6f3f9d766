"""Bucketed hand-off between stages (S5, J1, J2): a feature table stored by account, so that semi and anti
joins with account lists, sums per account and joins of two such tables read it without an exchange.

The table is external, under the shared folder, and known to the session's catalog by name. Each bucket is one file:
rows are dealt to as many partitions as there are buckets by the hash that names the bucket. One account cannot
be cut over buckets, so the largest bucket's rows are counted while writing: a table with a bucket of more than
``rows_per_task`` rows is read by its path, as plain files, and joins of it shuffle and let adaptive execution split
the hot account."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veerline.operators.timeline import DEFAULT_ROWS_PER_TASK
from veerline.sources.io import scratch_dir


@dataclass(frozen=True)
class HandOff:
    """A written table: its catalog name, folder, bucket columns, number of buckets and rows of the largest one."""
    table: str
    path: str
    keys: tuple[str, ...]
    buckets: int
    largest: int


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int | None = None, path: str | None = None) -> HandOff:
    """Writes ``df`` by buckets of ``keys`` (rows with null keys too), sorted by them. ``buckets``: unless given,
    ``spark.sql.shuffle.partitions``, so that a join's other side is dealt the same way. An existing table of that
    name is replaced; without ``path`` the files go to a fresh folder under ``spark.checkpoint.dir``."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or scratch_dir(spark, name)
    (df.repartition(buckets, *keys).write.format("parquet").mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", path).saveAsTable(name))
    sizes = spark.table(name).groupBy(F.pmod(F.hash(*keys), F.lit(buckets)).alias("bucket")).count()
    return HandOff(name, path, tuple(keys), buckets, sizes.agg(F.max("count")).first()[0] or 0)


def read_bucketed(spark: SparkSession, stored: HandOff, rows_per_task: int = DEFAULT_ROWS_PER_TASK) -> DataFrame:
    """The table by its buckets, or as plain files when one bucket is too large for a task."""
    if stored.largest <= rows_per_task:
        return spark.table(stored.table)
    return spark.read.schema(spark.table(stored.table).schema).parquet(stored.path)
