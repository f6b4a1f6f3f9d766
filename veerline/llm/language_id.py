"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of variable order (contexts of up to three bytes). A byte's
code length in a language comes from the longest context in which the language has seen it; each
step to a shorter context pays the escape probability of the longer one (method C: escapes weigh
as many as the context has different successors), and below order 0 all 256 bytes are alike. The
statistics are frozen after learning, so the code length of a text is a sum over its bytes, and the
language with the shortest code wins.

Frozen statistics allow a table: a byte with its three predecessors is two byte pairs, and the
code lengths of all (pair, pair) of the learned pairs are computed once per language. Scoring is two
look-ups and a segmented sum over the Arrow buffer, without a Python step per document. Pairs that
learning has not kept share one entry.

Scale: learning counts four-byte strings over a bounded sample of labelled rows (``sample_docs``
whole texts per language, chosen by hash) inside Spark tasks; the driver gets counts only. Scoring
is one narrow pass, with no shuffle; the table is at most ``table_mb``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veerline.llm.common import id_bucket

STEP = 1 << 20      # bytes scored at once: bounds memory for any length of text


def _folded() -> np.ndarray:
    """Byte map: A-Z to a-z, digits to 0; other bytes stay."""
    m = np.arange(256, dtype=np.uint8)
    m[65:91] += 32
    m[48:58] = 48
    return m


FOLD = _folded()


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array, without copying; null texts have no bytes."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, off


def _padded(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with three line feeds before each text, and each text's end in them."""
    n = len(off) - 1
    lens = np.diff(off)
    out = np.full(int(lens.sum()) + 3 * n, 10, dtype=np.uint8)
    ends = np.cumsum(lens + 3)
    for i in range(n):
        out[ends[i] - lens[i]:ends[i]] = raw[off[i]:off[i + 1]]
    return FOLD[out], ends


def count_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Four-byte strings (as integers) of all texts, three line feeds before each, with their counts."""
    raw, off = _buffers(texts)
    b, ends = _padded(raw, off)
    if not len(b):
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    w = b.astype(np.uint32)
    grams = (w[:-3] << 24) | (w[1:-2] << 16) | (w[2:-1] << 8) | w[3:]
    own = np.ones(len(b), dtype=bool)                       # positions of text bytes, not of padding
    starts = np.concatenate(([0], ends[:-1]))
    for k in range(3):
        own[np.minimum(starts + k, len(b) - 1)] = False
    return np.unique(grams[own[3:]], return_counts=True)


class Ppm:
    """Frozen code lengths (bits) of every (pair, pair) in every language."""

    def __init__(self, langs: list[str], grams: list[tuple[np.ndarray, np.ndarray]], table_mb: int):
        self.langs = langs
        size = max(16, int((table_mb * 2 ** 20 / 4 / max(1, len(langs))) ** 0.5))
        seen = np.zeros(65536, dtype=np.int64)
        for g, n in grams:
            np.add.at(seen, (g & 0xFFFF).astype(np.int64), n)
        pairs = np.argsort(-seen, kind="stable")[:size - 1]
        pairs = np.sort(pairs[seen[pairs] > 0])
        self.pair_id = np.zeros(65536, dtype=np.int32)        # 0: a pair that learning has not kept
        self.pair_id[pairs] = np.arange(1, len(pairs) + 1)
        self.width = len(pairs) + 1
        self.bits = np.empty((self.width ** 2, len(langs)), dtype=np.float32)
        for k, (g, n) in enumerate(grams):
            self.bits[:, k] = self._code_lengths(g.astype(np.int64), n, pairs).ravel()

    def _code_lengths(self, g: np.ndarray, n: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        def order(mask: int) -> tuple[np.ndarray, ...]:
            """Strings under ``mask`` with counts; their contexts with totals and kinds of successors."""
            keys, at = np.unique(g & mask, return_inverse=True)
            counts = np.bincount(at, weights=n, minlength=len(keys))
            ctx, at = np.unique(keys >> 8, return_inverse=True)
            return keys, counts, ctx, np.bincount(at, weights=counts), np.bincount(at)

        def find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where(keys[at] == wanted, values[at], 0)

        last = np.concatenate(([0], pairs)).astype(np.int64)
        if not len(g):
            return np.full((self.width, self.width), 8.0)
        # orders 0 to 2: one byte before the last pair decides
        s = (np.arange(256, dtype=np.int64)[:, None] << 16) | last[None, :]
        p = np.full(s.shape, 1 / 256)
        for o, mask in enumerate((0xFF, 0xFFFF, 0xFFFFFF)):
            keys, counts, ctx, totals, kinds = order(mask)
            own = s & mask
            c, t, d = find(keys, counts, own), find(ctx, totals, own >> 8), find(ctx, kinds, own >> 8)
            p = np.where(c > 0, c / np.maximum(t + d, 1), np.where(t > 0, d / np.maximum(t + d, 1), 1.0) * p)
        # order 3: escapes by (first pair, next byte), then the strings that were seen
        keys, counts, ctx, totals, kinds = order(0xFFFFFFFF)
        whole = (last[:, None] << 8) | np.arange(256, dtype=np.int64)[None, :]
        t, d = find(ctx, totals, whole), find(ctx, kinds, whole)
        escape = np.where(t > 0, d / np.maximum(t + d, 1), 1.0)
        out = p[last & 255] * escape[:, last >> 8]
        i, j = self.pair_id[keys >> 16], self.pair_id[keys & 0xFFFF]
        both = (i > 0) & (j > 0)
        i, j, c, k = i[both], j[both], counts[both], keys[both] >> 8
        out[i, j] = c / (find(ctx, totals, k) + find(ctx, kinds, k))
        out = -np.log2(out)
        out[:, 0] = 12.0                                       # a last pair that is not kept: alike in all languages
        return out

    def code_lengths(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits of every text in every language, and the texts' lengths in bytes."""
        raw, off = _buffers(texts)
        n = len(off) - 1
        total = np.zeros((n, len(self.langs)))
        lens = np.diff(off)
        # texts are taken in runs of about STEP bytes; a longer one in pieces with three bytes of context
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + STEP, side="right")) - 1)
            if j - i > 1 or lens[i] <= STEP:
                b, ends = _padded(raw, off[i:j + 1])
                self._add(total[i:j], b, ends)
            else:
                before = np.full(3, 10, dtype=np.uint8)
                for at in range(int(off[i]), int(off[i + 1]), STEP):
                    piece = FOLD[raw[at:min(at + STEP, int(off[i + 1]))]]
                    b = np.concatenate((before, piece))
                    self._add(total[i:i + 1], b, np.array([len(b)]))
                    before = b[-3:]
            i = j
        return total, lens

    def _add(self, total: np.ndarray, b: np.ndarray, ends: np.ndarray) -> None:
        if len(b) <= 3:
            return
        pid = self.pair_id[(b[:-1].astype(np.int32) << 8) | b[1:]]      # pid[i]: bytes i, i + 1
        idx = pid[:-2] * np.int32(self.width) + pid[2:]                  # bytes i .. i + 3
        starts = np.concatenate(([0], ends[:-1]))
        # text k's bytes are b[starts[k] + 3 : ends[k]]; byte x has entry x - 3 of idx
        filled = np.flatnonzero(ends - starts > 3)
        if not len(filled):
            return
        cuts = np.empty(2 * len(filled), dtype=np.int64)
        cuts[0::2], cuts[1::2] = starts[filled], ends[filled] - 3
        bits = self.bits[idx]
        if cuts[-1] == len(idx):
            cuts = cuts[:-1]
        total[filled] += np.add.reduceat(bits, cuts, axis=0, dtype=np.float64)[0::2]


def learn_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    sample_docs: int = 1000, table_mb: int = 32) -> Ppm:
    """Learn from the rows given (non-null text and language): a bounded sample of about
    ``sample_docs`` whole texts per language, those of the smallest id hashes."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
        F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Ppm([], [], table_mb)
    langs = sorted(sizes)
    limits = F.create_map(*[F.lit(x) for k in langs for x in (k, -(-sample_docs * (1 << 20) // sizes[k]))])
    sample = rows.where(F.col("h") < F.element_at(limits, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                grams, n = count_grams(batch.column(1).filter(pc.equal(batch.column(0), lang)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), type=pa.string()), pa.array(grams.astype(np.int64)),
                     pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counts = (sample.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow())
    lang_of, gram, n = (np.asarray(counts.column(c).to_numpy(zero_copy_only=False)) for c in ("lang", "gram", "n"))
    grams = []
    for k in langs:
        at = np.flatnonzero(lang_of == k)
        at = at[np.argsort(gram[at], kind="stable")]
        grams.append((gram[at], n[at]))
    return Ppm(langs, grams, table_mb)


def language_column(spark, model: Ppm):
    """A column function (text, has_letter) -> struct<lang_pred, score>: ``und`` with score 0 for a
    null text or one without a letter; else the language of the shortest code, and the share of its
    likelihood among all learned languages."""
    shared = spark.sparkContext.broadcast((model.langs, model.pair_id, model.width, model.bits))

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pa.Array, letters: pa.Array) -> pa.Array:
        ppm = object.__new__(Ppm)
        ppm.langs, ppm.pair_id, ppm.width, ppm.bits = shared.value
        sure = letters.fill_null(False).to_numpy(zero_copy_only=False).astype(bool) & bool(ppm.langs)
        if not len(sure) or not ppm.langs:
            best, share = np.zeros(len(sure), dtype=np.int64), np.zeros(len(sure))
        else:
            bits, _ = ppm.code_lengths(texts.fill_null(""))
            best = bits.argmin(axis=1)
            share = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
        names = [ppm.langs[b] if s else "und" for b, s in zip(best, sure, strict=True)]
        return pa.StructArray.from_arrays([pa.array(names, type=pa.string()), pa.array(np.where(sure, share, 0.0))],
                                          ["lang_pred", "score"])

    return lambda text: predict(text, text.rlike(r"\p{L}"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             folds: int = 5, **learning) -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``lang_pred``, ``score``. Learns from rows whose
    crc32(id as text) mod ``folds`` is not 0. Null or letterless text: ``und``, score 0 (also for
    every text when no row can be learned from). A null id counts as not held out and is not learned
    from. Repeated rows are scored each."""
    learned = docs.where(id_bucket(F.col(id_col), folds) != 0)
    predict = language_column(docs.sparkSession, learn_languages(learned, id_col, text_col, lang_col, **learning))
    out = docs.select(F.col(id_col).alias("doc_id"),
                      F.coalesce(id_bucket(F.col(id_col), folds) == 0, F.lit(False)).alias("held_out"),
                      predict(F.col(text_col).cast("string")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
