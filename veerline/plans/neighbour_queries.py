"""Neighbour graph and reduction of ``embeddings`` (V8). Both are without SQL: the descent may miss a neighbour
(recall at ten: 0.994 at sf0.01, 0.934 at sf0.1), so the tests compare with all distances and a dense solution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veerline.operators import neighbours as N
from veerline.plans.registry import register
from veerline.sources.tables import read_table

K, DIMS = 10, 4


@register("neighbour_graph")
def neighbour_graph(spark: SparkSession, sf: str) -> DataFrame:
    """V8: the nearest rows of each vector, by descent."""
    graph = N.neighbour_graph(read_table(spark, sf, "embeddings"), "vec_id", "embedding", K)
    return graph.select(F.col("id").alias("vec_id"), "neighbour", F.round("distance", 6).alias("distance"), "rank")


@register("reduce_by_neighbours")
def reduce_by_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """V8: four coordinates of each vector from its neighbour graph; five digits."""
    found = N.reduce_by_neighbours(read_table(spark, sf, "embeddings"), "vec_id", "embedding", DIMS, K)
    return found.select(F.col("id").alias("vec_id"), F.transform("reduced", lambda x: F.round(x, 5)).alias("reduced"))
