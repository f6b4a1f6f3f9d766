"""The stateless steps (count parsing, text cleaning, promotion filter, own/other split) on a
streaming DataFrame.

Nothing in the feature build needs cross-batch state except the per-account flag lookup, which
is a batch job over the finished timelines; these steps are pure column expressions and run
unchanged under Structured Streaming. Checkpoints go to the shared ``spark.checkpoint.dir``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veerline.functions import text as T
from veerline.session import ensure_checkpoint_dir


def clean_posts(stream: DataFrame, text: str = "text", lexicon: Sequence[str] = (),
                promotions: Sequence[str] = (), count_cols: Sequence[str] = ()) -> DataFrame:
    """C10 + P3 + P1 on a (streaming or batch) DataFrame: cleaned text, promotions dropped,
    abbreviated counts parsed."""
    out = stream.withColumn(text, T.clean_text(text, lexicon))
    if promotions:
        out = out.where(~T.matches_any_regex(text, promotions))
    for c in count_cols:
        out = out.withColumn(c, T.parse_abbrev_count(c))
    return out


def start_cleaning(spark: SparkSession, source_dir: str, schema: str, out_dir: str, name: str,
                   text: str = "text", lexicon: Sequence[str] = (), promotions: Sequence[str] = (),
                   count_cols: Sequence[str] = (), fmt: str = "parquet") -> StreamingQuery:
    """Read new files of ``source_dir`` as they arrive, clean them, append to ``out_dir``
    (exactly-once file sink; progress kept under the shared checkpoint folder)."""
    stream = spark.readStream.format(fmt).schema(schema).load(source_dir)
    cleaned = clean_posts(stream, text, lexicon, promotions, count_cols)
    checkpoint = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    return (cleaned.writeStream.format("parquet").option("checkpointLocation", checkpoint)
            .outputMode("append").start(out_dir))


def cleaned_counts_by_batch(stream: DataFrame, text: str = "text") -> DataFrame:
    """A running aggregate over the cleaned stream: rows and characters kept (complete mode)."""
    return stream.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length(text)).alias("n_chars"))
