"""Quality by pairwise ranking (Bradley-Terry).

Labels are read as preferences: a row labelled 1 is preferred to a row labelled 0. The chance that a
is preferred to b is the logistic function of s(a) - s(b) with s(x) = w . features(x), so w comes from
the logistic loss on feature differences of preference pairs (Newton steps, a small ridge). The
threshold is a quantile of the learned scores: the share of rows labelled 0. Scores are mapped to
[0, 1] by a logistic curve that has ``accept`` at that quantile.

Features are shares and ratios of the whole text's bytes and words (no language, source or id).

Scale: learning reads every labelled row. Each row of the larger class meets rows of the smaller one at the
next ranks of a hashed order, so that every labelled row is in pairs; the number of pairs grows with the rows
(all pairs of a small table). Moments, Newton sums and ranks are added up in the tasks and by Spark; the driver
holds sums of ``N_FEATURES`` rows and columns and counts by digit. The features of every text are taken in one
narrow pass and written: no text is shuffled, and scoring is one narrow pass over them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from veerline.llm.common import id_bucket, written
from veerline.operators.sampling import global_rank

PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]
_KIND = np.zeros(256, dtype=np.int8)            # 0 other, 1 white space, 2 punctuation, 3 upper, 4 lower, 5 digit
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[PUNCTUATION] = 2
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 3, 4, 5
N_FEATURES = 16 + len(PUNCTUATION)


def features(text: bytes) -> np.ndarray:
    """Feature vector of one UTF-8 text; finite for any text, zero shares for an empty one."""
    n = len(text)
    raw = np.frombuffer(text, dtype=np.uint8)
    hist = np.bincount(raw, minlength=256)
    kind = _KIND[raw]
    per = np.bincount(kind, minlength=6)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    m, share = max(1, len(words)), 1 / max(1, n)
    letters = max(1, per[3] + per[4] + per[0])
    p = hist[hist > 0] * share
    ends = int(((kind[:-1] == 2) & (kind[1:] == 1)).sum()) if n > 1 else 0
    twins = int(((kind[:-1] == 2) & (kind[1:] == 2)).sum()) if n > 1 else 0
    alone = int(((kind[1:-1] == 2) & (kind[:-2] == 1) & (kind[2:] == 1)).sum()) if n > 2 else 0
    distinct = len(set(words))
    head = [math.log1p(n) / 10, per[3] / letters, per[5] * share, per[1] * share, per[0] * share, per[2] * share,
            hist[10] * share * 10, (n / m) / 20 if n else 0.0, distinct / m, len(set(lines)) / max(1, len(lines)),
            math.log1p(n / max(1, len(lines))) / 10, float(-(p * np.log2(p)).sum()) / 8 if n else 0.0,
            ends / m, twins / m, alone / m, math.log1p(m / max(1, distinct))]
    return np.concatenate((np.minimum(head, 20.0), np.sqrt(hist[PUNCTUATION] * share)))


@F.arrow_udf(ArrayType(DoubleType()))
def feature_column(texts: pa.Array) -> pa.Array:
    return pa.array([features(t.as_py() or b"") for t in texts.cast(pa.large_binary())], type=pa.list_(pa.float64()))


@dataclass
class Ranking:
    """Scores s(x) = w . (x - mean) / scale, and the curve that maps them to [0, 1]."""
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    threshold: float
    slope: float
    accept: float

    def rank(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.rank(x) - self.threshold) + math.log(self.accept / (1 - self.accept))
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def newton_sums(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Curvature and slope of the pair loss at ``w``, summed over the feature differences ``d``."""
    q = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))             # chance that the pair is the other way round
    return (d * (q * (1 - q))[:, None]).T @ d, d.T @ q


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], pairs: int, ridge: float) -> np.ndarray:
    """The weights that minimise the mean pair loss with a small ridge."""
    w = np.zeros(N_FEATURES)
    for _ in range(12):
        curvature, slope = sums(w)
        step = np.linalg.solve(curvature / pairs + ridge * np.eye(N_FEATURES), slope / pairs - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_ranking(x: np.ndarray, y: np.ndarray, pairs: int, accept: float, ridge: float = 1e-3, seed: int = 7) -> Ranking:
    """Bradley-Terry fit on rows ``x`` labelled ``y`` (0 / 1) in memory, with ``pairs`` drawn pairs. One class only:
    every score is ``accept``."""
    mean, scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    model = Ranking(mean, scale, np.zeros(N_FEATURES), 0.0, 0.0, accept)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return model
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    model.w = newton(lambda w: newton_sums(d, w), pairs, ridge)
    s = np.sort(z @ model.w)
    at = len(bad)                                              # the quantile of the rows labelled 0
    model.threshold = float((s[at - 1] + s[min(at, len(s) - 1)]) / 2)
    spread = np.median(s[at:]) - np.median(s[:at]) if at < len(s) else 1.0
    model.slope = float(8 / max(spread, 1e-6))
    return model


def _rows(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), N_FEATURES)


def _added(rows: DataFrame, total: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """``total`` of all batches, ``size`` numbers, added up in the tasks and then by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size)
        for batch in batches:
            sums += total(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(sums)], ["i", "v"])

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def _ordered(bits: np.ndarray) -> np.ndarray:
    """Bits of doubles as integers of the same order, and back."""
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def order_statistics(keys: DataFrame, positions: Sequence[int]) -> list[float]:
    """The values at 0-based positions of the sorted doubles whose ordered bits are in ``key``: 16 bits a pass, from
    the counts of the digits that follow the prefixes found so far."""
    found = {p: (0, p) for p in positions}                     # prefix, position among the keys that have it
    for shift in (48, 32, 16, 0):
        prefix = F.shiftright("key", shift + 16) if shift < 48 else F.lit(0)
        rows = keys.where(prefix.isin([x for x, _ in found.values()]))
        at = F.shiftright("key", shift)
        counts = sorted(rows.groupBy(prefix.cast("bigint").alias("prefix"), at.alias("at")).count().collect())
        for p, (x, left) in found.items():
            for before, digit, n in counts:
                if before == x:
                    if left < n:
                        found[p] = digit, left
                        break
                    left -= n
    return _ordered(np.array([found[p][0] for p in positions], np.int64)).view(np.float64).tolist()


def preference_pairs(rows: DataFrame, large: int, n_large: int, n_small: int, pairs: int, per_row: int) -> DataFrame:
    """(more, less): features of a row labelled 1 and one labelled 0. Each row of the class ``large`` meets the rows of
    the other class at the next ranks, at least ``per_row`` and about ``pairs`` in all, or all of them if they are fewer."""
    partners = min(n_small, max(per_row, -(-pairs // n_large)))
    ranked = global_rank(rows, F.md5(F.col("_id").cast("string")), ["x"], partition_by=["y"], few_groups=True)
    ahead = F.explode(F.sequence(F.lit(0), F.lit(partners - 1)))
    first = ranked.where(F.col("y") == large).select("x", "rank", ahead.alias("ahead")).select(
        F.col("x").alias("a"), F.pmod(F.col("rank") - 1 + F.col("ahead"), F.lit(n_small)).alias("at"))
    second = ranked.where(F.col("y") == 1 - large).select(F.col("x").alias("b"), (F.col("rank") - 1).alias("at"))
    return first.join(second, "at").select(F.col("a" if large else "b").alias("more"), F.col("b" if large else "a").alias("less"))


def learn_ranking(rows: DataFrame, pairs: int, accept: float, per_row: int = 3, ridge: float = 1e-3) -> Ranking:
    """Bradley-Terry fit on all rows (``_id``, ``x``, ``y``), as Spark jobs. One class only: every score is ``accept``."""
    moments = _added(rows, lambda b: np.r_[len(b), np.sum(b.column("y").to_numpy()), _rows(b.column("x")).sum(axis=0)], N_FEATURES + 2)
    n, good = int(moments[0]), int(moments[1])
    bad = n - good
    mean = moments[2:] / max(1, n)
    spreads = _added(rows, lambda b: ((_rows(b.column("x")) - mean) ** 2).sum(axis=0), N_FEATURES)
    scale = np.maximum(np.sqrt(spreads / n), 1e-6) if n else np.ones(N_FEATURES)
    model = Ranking(mean, scale, np.zeros(N_FEATURES), 0.0, 0.0, accept)
    if not good or not bad:
        return model
    met = written(preference_pairs(rows, int(good >= bad), max(good, bad), min(good, bad), pairs, per_row), "preference_pairs")

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def total(batch: pa.RecordBatch) -> np.ndarray:
            more, less = (np.clip((_rows(batch.column(c)) - mean) / scale, -8, 8) for c in ("more", "less"))
            curvature, slope = newton_sums(more - less, w)
            return np.r_[curvature.ravel(), slope]

        out = _added(met, total, N_FEATURES * (N_FEATURES + 1))
        return out[:-N_FEATURES].reshape(N_FEATURES, N_FEATURES), out[-N_FEATURES:]

    model.w = newton(sums, met.count(), ridge)

    @F.arrow_udf("bigint")
    def key(x: pa.Array) -> pa.Array:
        return pa.array(_ordered((model.rank(_rows(x)) + 0.0).view(np.int64)))

    middle = lambda a, b: [a + (b - a - 1) // 2, a + (b - a) // 2]
    ranks = written(rows.select(key("x").alias("key")), "label_ranks")
    s = order_statistics(ranks, [bad - 1, bad, *middle(0, bad), *middle(bad, n)])     # the quantile of the rows labelled 0
    model.threshold = (s[0] + s[1]) / 2
    model.slope = 8 / max((s[4] + s[5] - s[2] - s[3]) / 2, 1e-6)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", folds: int = 5, accept: float = 0.3, pairs: int = 60_000) -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (score >= accept).

    Learns from all labelled rows whose crc32(id as text) mod ``folds`` is not 0, by at least ``pairs`` preference
    pairs if there are as many. Null text: scored as empty. Null labels and null ids are not learned from; a null id is
    not held out. Repeated rows are scored each. With no rows of one class every score is ``accept``."""
    known = labels.where(F.col(label_col).isNotNull() & (id_bucket(F.col(id_col), folds) != 0)).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    found = written(docs.select(F.col(id_col).alias("doc_id"), feature_column(F.col(text_col).cast("string")).alias("x")), "features")
    rows = known.where("_y in (0, 1)").join(found.withColumnRenamed("doc_id", "_id"), "_id").select("_id", "x", F.col("_y").alias("y"))
    model = learn_ranking(written(rows, "label_features"), pairs, accept)

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        return pa.array(model.score(_rows(x)), type=pa.float64())

    out = found.select("doc_id", F.coalesce(id_bucket(F.col("doc_id"), folds) == 0, F.lit(False)).alias("held_out"), score("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= accept).cast("int"))
