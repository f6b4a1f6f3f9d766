"""Vector operators: cosine distance, ranking by similarity, widening to columns, text embedding
as a batch job, dimension reduction.

Vectors are ``array<float>`` / ``array<double>`` columns; ML stages get a ``VectorUDT`` column
through ``array_to_vector``. Cosine distance is a higher-order expression (JVM-side)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veerline.operators.docs import tokenize
from veerline.operators.timeline import DEFAULT_ROWS_PER_TASK, rank_within_groups


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """V6: 1 - a.b / (|a| |b|); null when either vector is all zeros."""
    den = norm(a) * norm(b)
    return F.when(den != 0, F.lit(1.0) - dot(a, b) / den)


def rank_by_similarity(df: DataFrame, vec: str, query_vec: str, group: Sequence[str], pos: str,
                       k: int | None = None, digits: int | None = None,
                       rows_per_task: int = DEFAULT_ROWS_PER_TASK) -> DataFrame:
    """T4: order the rows of each group by cosine distance to the group's query vector (ties by
    ``pos``); adds ``distance`` (rounded to ``digits`` when given, so float noise never reorders
    near-ties) and 1-based ``sim_rank``; optional top ``k`` per group.

    A full ranking splits groups of more than ``rows_per_task`` rows over ranges of the distance; a
    top ``k`` is cut to k rows a task before the shuffle (Spark's window group limit)."""
    dist = cosine_distance(vec, query_vec)
    if digits is not None:
        dist = F.round(dist, digits)
    scored = df.withColumn("distance", dist)
    if k is None:
        ranked = rank_within_groups(scored, list(group), "distance", "sim_rank", rows_per_task, tiebreak=[pos])
        return ranked.withColumn("sim_rank", F.col("sim_rank").cast("int"))
    w = Window.partitionBy(*group).orderBy(F.asc_nulls_last("distance"), pos)
    return scored.withColumn("sim_rank", F.row_number().over(w)).where(F.col("sim_rank") <= k)


def letter_counts(text: Column | str, letters: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """A transparent stand-in embedder: how often each letter occurs (array<double>)."""
    t = F.coalesce(_c(text), F.lit(""))
    return F.array(*[(F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit("")))).cast("double") for ch in letters])


def embedding_to_columns(vec: Column | str, prefix: str, dim: int) -> list[Column]:
    """Array -> prefix_1 .. prefix_dim (one select, for export only)."""
    v = _c(vec)
    return [F.get(v, i).cast("double").alias(f"{prefix}_{i + 1}") for i in range(dim)]


def hashed_embedding(df: DataFrame, text: str, out: str = "embedding", dim: int = 256, idf: bool = False,
                     pca_k: int | None = None) -> DataFrame:
    """V7 default without a model: hashed token counts (``HashingTF``), optionally weighted by
    inverse document frequency (``IDF``, fitted on ``df``), L2-normalised, optionally reduced to
    ``pca_k`` principal components. Every stage is a Spark ML job (fits are distributed
    aggregates); the vector is returned as array<float>."""
    toks = df.withColumn("_tokens", tokenize(text))
    vec = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dim).transform(toks)
    col = "_tf"
    if idf:
        vec = IDF(inputCol="_tf", outputCol="_idf").fit(vec).transform(vec)
        col = "_idf"
    vec = Normalizer(inputCol=col, outputCol="_n", p=2.0).transform(vec)
    col = "_n"
    if pca_k is not None:
        vec = PCA(k=pca_k, inputCol="_n", outputCol="_p").fit(vec).transform(vec)
        col = "_p"
    return (vec.withColumn(out, vector_to_array(col, "float32"))
            .drop("_tokens", "_tf", "_idf", "_n", "_p"))


def embed_text(df: DataFrame, text: str, encode: Callable[[list[str]], np.ndarray] | None = None, dim: int = 0,
               out: str = "embedding", batch_size: int = 64,
               encode_factory: Callable[[], Callable[[list[str]], np.ndarray]] | None = None) -> DataFrame:
    """V7: text -> vector with a user's model, as a batch job.

    ``encode(list_of_texts) -> (n, dim) array`` is called on batches of ``batch_size`` inside
    ``mapInPandas``. For a heavy model pass ``encode_factory`` instead: it is called once per
    task (partition), never per batch or row; a factory cached in the user's own module (e.g.
    ``functools.cache``) loads the model once per Python worker, since workers are reused."""
    if (encode is None) == (encode_factory is None):
        raise ValueError("give exactly one of encode / encode_factory")
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches):
        fn = encode if encode is not None else encode_factory()
        for pdf in batches:
            texts = pdf[text].fillna("").tolist()
            vecs = [np.asarray(fn(texts[i:i + batch_size]), dtype=np.float32)
                    for i in range(0, len(texts), batch_size)]
            mat = np.vstack(vecs) if vecs else np.zeros((0, dim), dtype=np.float32)
            yield pdf.assign(**{out: pd.Series(list(mat), index=pdf.index)})

    return df.mapInPandas(run, schema)


def reduce_embeddings(df: DataFrame, vec: str, k: int, out: str = "reduced") -> DataFrame:
    """V8: principal components of the vectors (Spark ML PCA; fit is a distributed job)."""
    v = df.withColumn("_v", array_to_vector(vec))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v)
    return model.transform(v).withColumn(out, vector_to_array("_p")).drop("_v", "_p")
