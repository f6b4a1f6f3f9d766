"""Readers and writers: per-account timeline CSVs, feature JSON, account lists, fold metrics,
outcome slices, importance tables.

File order is the timeline order: CSVs are read with ``multiLine`` (a file is never split), so
``monotonically_increasing_id`` grows with the row's position inside its file; it is a valid
``pos`` column without a shuffle (ids are not dense, only ordered)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veerline.functions.text import account_from_path
from veerline.session import ensure_checkpoint_dir

CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"'}
_ESCAPED = frozenset("\"#%'*/:=?\\\x7f{[]^")     # in folder names


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/io/{name}-{uuid.uuid4().hex[:12]}"


def read_timelines(spark: SparkSession, path: str | Sequence[str], schema: StructType | str,
                   account_col: str | None = None) -> DataFrame:
    """S1 + S2: every per-account CSV as one DataFrame with ``account`` and ``pos``.

    ``account`` is the file's base name up to its first dot, or ``account_col`` when given (e.g.
    a partition column of the folder layout)."""
    df = spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)
    df = df.withColumn("pos", F.monotonically_increasing_id())
    if account_col is None:
        df = df.withColumn("account", account_from_path(
            F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))))  # the name is URI-escaped
    else:
        df = df.withColumn("account", F.col(account_col))
    return df


def _partition_folder(column: str, value: str | None) -> str:
    """The folder name that ``partitionBy`` gives to a value."""
    if not value:
        return f"{column}=__HIVE_DEFAULT_PARTITION__"
    return f"{column}=" + "".join(f"%{ord(c):02X}" if c < " " or c in _ESCAPED else c for c in value)


def _account_files(folder: str, column: str, header: str):
    """(account, line) in order of the accounts -> one file for each, put in place when it is whole."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, account, out, made = 0, None, None, ""
        for batch in batches:
            accounts, lines = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cuts = [0, *(i for i in range(1, len(lines)) if accounts[i] != accounts[i - 1]), len(lines)] if lines else []
            for i, j in zip(cuts, cuts[1:], strict=False):
                if out is None or accounts[i] != account:
                    if out is not None:
                        out.close()
                        os.replace(out.name, made)
                    account, files = accounts[i], files + 1
                    own = os.path.join(folder, _partition_folder(column, account))
                    os.makedirs(own, exist_ok=True)
                    made = os.path.join(own, "part-00000.csv")
                    out = open(os.path.join(own, f"_{uuid.uuid4().hex}"), "w", encoding="utf-8", newline="")
                    out.write(header)
                out.write("".join(f"{x}\n" for x in lines[i:j]))
        if out is not None:
            out.close()
            os.replace(out.name, made)
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])
    return write


def write_timelines(df: DataFrame, path: str, account: str, order: str) -> None:
    """One CSV folder per account (``account=<key>``), rows in ``order`` inside each file.

    This is the interchange layout of per-account timelines: one file per account, so one task
    writes each account. For very large accounts keep Parquet with an explicit order column
    instead (readers then need no file order).

    On a shared folder of the local file system the tasks write Spark's CSV lines to the files themselves: there
    Hadoop starts a ``chmod`` process for each folder, file and checksum, which costs far more than the rows."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))     # given, or few bytes would come to few tasks
    local = urlsplit(path)
    if local.scheme not in ("", "file") or not local.path.startswith("/"):
        (df.repartition(tasks, account).sortWithinPartitions(account, order)
         .write.mode("overwrite").options(**CSV_OPTIONS).partitionBy(account).csv(path))
        return
    df.limit(0).write.mode("overwrite").options(**CSV_OPTIONS).partitionBy(account).csv(path)     # an empty folder
    columns = [c for c in df.columns if c != account]
    heads = df.sparkSession.range(1).select(F.to_csv(F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(columns)]), CSV_OPTIONS))
    line = F.to_csv(F.struct(*[F.col(c) for c in columns]), CSV_OPTIONS)
    name = F.nullif(F.col(account).cast("string"), F.lit(""))      # both have one folder
    rows = df.select(name.alias("account"), F.col(order).alias("at"), line.alias("line")).repartition(tasks, "account")
    files = rows.sortWithinPartitions("account", "at").select("account", "line").mapInArrow(
        _account_files(path.removeprefix("file:") if local.scheme else path, account, heads.first()[0] + "\n"), "files bigint")
    files.agg(F.sum("files")).collect()


def read_feature_json(spark: SparkSession, path: str, schema: StructType | str | None = None,
                      multiline: bool = False) -> DataFrame:
    """S3: feature records; ``multiline=True`` reads files that hold one JSON array of objects."""
    reader = spark.read.option("multiLine", str(multiline).lower())
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def write_features(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet between stages, JSON lines for export."""
    writer = df.write.mode("overwrite")
    if fmt == "json":
        writer.json(path)
    else:
        writer.parquet(path)


def nest_ids(df: DataFrame, *columns: str) -> DataFrame:
    """Id lists wrapped in one more list, as a tokenizer's batch output is stored (null stays null; P10 unwraps)."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.array(F.col(c))) for c in columns})


def read_account_list(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Account lists from CSV files with an ``account_name`` header, concatenated."""
    return spark.read.options(**CSV_OPTIONS).schema("account_name string").csv(list(paths))


def append_fold_metrics(metrics: DataFrame, path: str, run: str) -> None:
    """Long (run, fold, metric, value) rows appended to a CSV folder."""
    (metrics.select(F.lit(run).alias("run"), "fold", "metric", F.col("value").cast("double"))
     .write.mode("append").options(**CSV_OPTIONS).csv(path))


def replace_run(rows: DataFrame, path: str, run: str) -> None:
    """The rows of one run as a partition of a table of runs. Writing a run again replaces its partition as
    a whole and leaves the other runs alone (dynamic partition overwrite), so a repeated run never doubles its rows."""
    (rows.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run").parquet(path))


def read_fold_metrics(spark: SparkSession, path: str, n_folds: int) -> DataFrame:
    """S6 wide form: one row per (run, metric), one column per fold."""
    long = spark.read.options(**CSV_OPTIONS).schema("run string, fold int, metric string, value double").csv(path)
    return long.groupBy("run", "metric").pivot("fold", list(range(n_folds))).agg(F.first("value"))


def write_outcome_slices(df: DataFrame, path: str, columns: Sequence[str], outcome: str = "outcome") -> None:
    """One CSV folder per outcome (tp / fp / fn / tn or t<k> / f<k>) with the chosen columns."""
    df.select(*columns, outcome).write.mode("overwrite").options(**CSV_OPTIONS).partitionBy(outcome).csv(path)


def write_importance(df: DataFrame, path: str) -> None:
    """The per-feature importance table (one row per feature) as CSV with a header."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
