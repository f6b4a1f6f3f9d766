"""Small fixtures and plain brute-force statements for the training-data operators."""

import duckdb
import pandas as pd
from pyspark.sql import types as T

from veerline.sources.tables import TABLES
from tests.conftest import SF_SMALL

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])


def docs(spark, rows):
    """Rows (doc_id, text[, lang[, source]]) as a documents table."""
    return spark.createDataFrame([tuple(r) + (None,) * (4 - len(r)) for r in rows], DOCS)


def clashing(df):
    """The same table with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F
    names = ["fp", "name", "h", "th", "i", "n", "a", "b", "size", "target", "doc", "key", "_b", "_k", "score", "block", "lh",
             "component_id", "keep_id", "sha", "level", "turn_no", "w", "line", "first", "root", "position", "positions"]
    return df.select("*", *[F.lit(1).alias(n) for n in names if n not in df.columns])


def documents(sf=SF_SMALL):
    return pd.read_parquet(f"{sf}/documents.parquet")


def duck(sql, sf=SF_SMALL):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con.sql(sql).df()


def same_rows(a, b, columns):
    """Both frames hold the same rows (as multisets) in ``columns``."""
    key = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))
    return key(a) == key(b)


class Union:
    """Union-find over any values; the class of a value is its smallest member."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
