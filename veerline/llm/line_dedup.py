"""Line dedup by a deletion-neighbourhood join.

Two lines within one edit (a character inserted, deleted or replaced) share a variant with at most
one deletion: a replaced character leaves equal variants at the same place, and an inserted one
leaves the other line itself. Every line emits all its variants as hashed keys (with the place,
for replacements); lines that share a key are joined and their edit distance is verified. A line
goes when the same line, or one within the bound, occurs earlier; the earliest stays.

A star per key is enough: lines that share (variant, place) are all within one edit of each other,
so each is paired with the earliest one only; lines that share a full line are paired with that
line. So pairs grow with the lines, not with the square of a group.

Scale: before variants are emitted, lines that cannot have a partner are set aside exactly. With
one edit, either a first or a last part of half the shorter length is untouched, so partners share
a hashed part (part lengths are rounded down to a few, so that lengths next to each other agree);
then, among those that do, all but one of ``PIECES`` pieces. Only lines that are left emit variants.
Lines travel as 128-bit hashes; full texts are shuffled once, with the documents whose lines go.
The few lines with a shared part are broadcast up to ``broadcast_rows`` hashes (counted), and are a
plain join side beyond. A key's group holds at most one line per character (or one per character
and place), so the window over it is bounded; hot lines meet in plain joins, which adaptive
execution splits.

A bound k of two or more (``near_lines_within``): of k // 2 + 1 pieces of the shorter line, one holds at
most one edit, so that piece and the same stretch of the other line share a variant with at most one
deletion. Lines emit the variants of their pieces, the first counted from the line's start, the last
from its end, those between also moved by the edits before them. Before that, what cannot have a partner
is set aside exactly: k edits leave one of k + 1 pieces untouched, so partners share a hashed stretch
(``_coded``, hashed once and written with the lines' places); lines that share one are compared by their
lengths and parities (below), but for stretches that more than ``CROWD`` lines share, whose lines are all
kept; texts are read again for the lines left only. Of these, pieces within one edit of each other share all but one of ``PARTS`` parts, and only
pieces that share them with an unlike piece emit variants (equal ones meet as they are). A line is compared with the earliest line of each of its variants; only a line without a partner
there is compared with the others, in a semi join whose condition is the edit distance, so that no
pairs come out: rows grow with the lines. What the condition compares still grows with the square of a
variant's group; lengths and parities of character and character-pair counts (each edit flips at most
two of the first, four of the second) go before the edit distance. Adaptive execution splits a hot one."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veerline.llm.common import let, plain, written
from veerline.operators.docs import sized_side

MIN_CHARS = 16          # shorter lines are compared exactly only
PIECES = 16
PARTS = 8               # of a piece, for bounds above one
CROWD = 64              # lines that share a stretch: up to so many are compared by their signatures
CODES = {"n": "int", "chars": "bigint", "grams": "bigint", "keys": "array<bigint>"}


class VariantHashes:
    """128-bit hashes of a line and of its one-deletion variants, in linear time (two polynomials mod 2^64)."""

    BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self):
        self.powers = [np.ones(1, dtype=np.uint64) for _ in self.BASES]

    def _prefixes(self, line: str) -> tuple[np.ndarray, np.ndarray]:
        c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        pre = np.zeros((2, len(c) + 1), dtype=np.uint64)
        for k, base in enumerate(self.BASES):
            if len(self.powers[k]) < len(c):
                self.powers[k] = np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(2 * len(c), base, dtype=np.uint64))),
                                            dtype=np.uint64)
            pre[k, 1:] = np.cumsum(c * self.powers[k][:len(c)], dtype=np.uint64)
        return c, pre

    def of(self, line: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of the line [2], hashes of its variants [2, n], starts of runs of equal characters [n])."""
        c, pre = self._prefixes(line)
        inverse = np.array([[pow(b, -1, 1 << 64)] for b in self.BASES], dtype=np.uint64)
        variants = pre[:, :-1] + (pre[:, -1:] - pre[:, 1:]) * inverse
        starts = np.concatenate(([True], c[1:] != c[:-1])) if len(c) else np.zeros(0, dtype=bool)
        return pre[:, -1], variants, starts

    def without_pieces(self, line: str, pieces: int = PIECES) -> np.ndarray:
        """Keys [2, n]: for the line's length and one less (the shorter of two partners), the line without
        one of ``pieces`` pieces, the piece's end counted from the line's end."""
        c, pre = self._prefixes(line)
        n, keys = len(c), []
        for length in {n, max(n - 1, 0)}:
            cut = np.array([length * q // pieces for q in range(pieces + 1)])
            tail = n - (length - cut[1:])                          # where the untouched last part starts
            for k, base in enumerate(self.BASES):
                inverse = pow(base, -1, 1 << 64)
                back = np.array([pow(inverse, int(t), 1 << 64) for t in tail], dtype=np.uint64)
                keys.append(pre[k, cut[:-1]] * np.uint64(31) + (pre[k, -1] - pre[k, tail]) * back * np.uint64(1_000_003)
                            + np.arange(pieces, dtype=np.uint64) * np.uint64(0x9E37) + np.uint64(length * 0x85EB))
        return np.stack((np.concatenate(keys[0::2]), np.concatenate(keys[1::2])))


def _emitter(what: str):
    """(lid, line) -> rows of keys (a, b): ``pieces``: lines without a piece; ``variants``: (place, full) with
    place >= 0: the variant without that character; -1: a full line, or a variant that may be one."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = VariantHashes()
        held: list[tuple] = []

        def rows() -> pa.RecordBatch:
            ids = np.repeat([x[0] for x in held], [x[1].shape[1] for x in held])
            keys = np.concatenate([x[1] for x in held], axis=1).view(np.int64)
            columns, names = [pa.array(ids.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1])], ["lid", "a", "b"]
            if what == "variants":
                place = np.concatenate([x[2] for x in held]).astype(np.int32)
                full = np.zeros(len(place), dtype=bool)
                full[np.cumsum([x[1].shape[1] for x in held]) - 1] = True
                columns, names = [*columns, pa.array(place), pa.array(full)], [*names, "place", "full"]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        size = 0
        for batch in batches:
            for lid, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if what == "pieces":
                    held.append((lid, hashes.without_pieces(line)))
                else:
                    whole, variants, starts = hashes.of(line)
                    held.append((lid, np.concatenate((variants, variants[:, starts], whole[:, None]), axis=1),
                                 np.concatenate((np.arange(len(starts)), np.full(int(starts.sum()) + 1, -1)))))
                size += held[-1][1].shape[1]
                if size > 200_000:
                    yield rows()
                    size = 0
        if held:
            yield rows()

    return emit


def near_lines(lines: DataFrame) -> DataFrame:
    """Verified pairs (lid, other) of lines within one edit. ``lines``: (lid, line), distinct lines, numbered
    from the earliest. Of the lines with a replaced character at one place, each is paired with the
    earliest; a line is paired with every line that has one character more."""
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = lines.select("lid", "line").repartition(tasks, "lid")
    pieces = spread.mapInArrow(_emitter("pieces"), "lid bigint, a bigint, b bigint")
    shared = (pieces.groupBy("a", "b").agg(F.min("lid").alias("x"), F.max("lid").alias("y")).where("x < y").select("a", "b"))
    likely = spread.join(pieces.join(shared, ["a", "b"], "left_semi").select("lid").distinct(), "lid", "left_semi")
    emitted = likely.mapInArrow(_emitter("variants"), "lid bigint, a bigint, b bigint, place int, full boolean")
    head = F.min(F.when((F.col("place") >= 0) | F.col("full"), F.col("lid"))).over(Window.partitionBy("a", "b", "place"))
    pairs = emitted.select("lid", head.alias("other")).where("lid <> other").distinct()
    text = lines.select(F.col("lid").alias("_lid"), F.col("line").alias("_line"))
    pairs = (pairs.join(lines.select("lid", "line"), "lid").join(text, F.col("other") == F.col("_lid"))
             .where(F.levenshtein("line", "_line", 1) == 1))
    return pairs.select("lid", "other")


def _coded(max_edits: int, min_chars: int):
    """Rows whose last column is ``line`` -> the other columns, ``n`` (length), bit sets of the parities of the counts
    of characters (``chars``) and of neighbouring pairs (``grams``, the end counts as a character), in 64 buckets, and
    ``keys``: hashes of stretches, one of which a partner's equals (none for lines under ``min_chars``).

    Of ``max_edits`` + 1 pieces of the shorter line, some piece p is untouched, with at most p edits before and
    ``max_edits`` - p after it. Pieces of the first half are counted from the line's start, the others from its end, so a
    partner has them up to min(p, ``max_edits`` - p) places off. Both lines emit the same few stretches of each piece,
    moved by ``_moves``. Lengths are rounded down, so that most partners cut the same pieces."""
    base, mix, one = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(1)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, back = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)
        for whole in batches:
            lines = whole.column(whole.num_columns - 1).to_pylist()
            ends = np.cumsum([len(x) for x in lines])
            cuts = [0, *(np.flatnonzero(np.diff(ends // 1_000_000)) + 1).tolist(), len(lines)] if lines else [0]
            for i, j in zip(cuts, cuts[1:], strict=False):
                batch, part = whole.slice(i, j - i), lines[i:j]
                c = np.frombuffer("".join(x + "\0" for x in part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                c = c.astype(np.uint64) + one
                if len(powers) < len(c) + 1:
                    powers, back = (np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(2 * len(c), x, dtype=np.uint64))),
                                               dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64)))
                sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(c * powers[:len(c)], dtype=np.uint64)))
                n = np.array([len(x) for x in part])
                at = np.concatenate(([0], np.cumsum(n + 1)[:-1]))
                pair = c * np.uint64(1_000_003) + np.append(c[1:], one)
                bounds = np.stack((at, at + n), axis=1).ravel()
                chars, grams = (np.bitwise_xor.reduceat(one << ((x + one) * mix >> np.uint64(58)), bounds)[::2] for x in (c, pair))
                rows, keys = [], []
                for less in range(max_edits + 1):
                    length = _rounded(np.maximum(n - less, 0))
                    new = (n >= min_chars) & (n > less) & ((length != _rounded(n - less + 1)) if less else True)
                    row = np.flatnonzero(new)
                    length = length[row]
                    for p in range(max_edits + 1):
                        start, end = length * p // (max_edits + 1), length * (p + 1) // (max_edits + 1)
                        moves = _moves(min(p, max_edits - p))
                        size = np.maximum(end - start - moves[-1], 0)
                        first = at[row] + start + (n[row] - length if 2 * p > max_edits else 0)
                        salt = (length * (max_edits + 1) + p + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                        for s in moves:
                            a = np.where(size > 0, first + s, first)
                            h = ((sums[a + size] - sums[a]) * back[a] ^ salt) * mix
                            h = (h ^ (h >> np.uint64(29))) * mix
                            rows.append(row)
                            keys.append(h ^ (h >> np.uint64(32)))
                row, h = np.concatenate(rows), np.concatenate(keys)
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                once = np.concatenate((np.ones(min(1, len(h)), dtype=bool), (row[1:] != row[:-1]) | (h[1:] != h[:-1])))
                offsets = np.concatenate(([0], np.cumsum(np.bincount(row[once], minlength=len(part)))))
                found = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h[once].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n.astype(np.int32)), pa.array(chars.view(np.int64)),
                                                  pa.array(grams.view(np.int64)), found], [*batch.schema.names[:-1], *CODES])

    return emit


def _moves(most: int) -> list[int]:
    """Places whose differences take every value up to ``most``, ascending from 0."""
    step = math.isqrt(most) or 1
    return sorted({*range(step), *range(0, most + step, step)})


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lid, line) -> also ``n`` (length) and bit sets of the parities of the counts of characters (``chars``)
    and of neighbouring pairs (``grams``, the end counts as a character), in 64 buckets."""
    mix, one = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(1)
    for batch in batches:
        found = []
        for line in batch.column(1).to_pylist():
            c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + one
            pair = c * np.uint64(1_000_003) + np.append(c[1:], one)
            found.append((len(c), *(np.bitwise_xor.reduce(one << ((x + one) * mix >> np.uint64(58))) for x in (c, pair))))
        n, chars, grams = (np.array([x[k] for x in found], dtype=np.uint64).view(np.int64) for k in range(3))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n.astype(np.int32)), pa.array(chars), pa.array(grams)],
                                         ["lid", "line", "n", "chars", "grams"])


def _rounded(length: np.ndarray) -> np.ndarray:
    """Lengths rounded down to eighths of their power of two, so that most lengths next to each other agree."""
    bits = np.frexp(length.astype(np.float64))[1]
    return length - length % (1 << np.maximum(0, bits - 4).astype(np.int64))


class PieceVariants:
    """Keys of the pieces of lines (polynomials mod 2^64): whole ones, those without a part, one-deletion variants.

    Keys come as (line's number, key, hash of the stretch that it comes from (a whole one: itself), stretch's number)."""

    BASE, MIX, SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, max_edits: int):
        self.edits, self.pieces = max_edits, max_edits // 2 + 1
        self.powers = self.back = np.ones(1, dtype=np.uint64)
        self.inverse = np.uint64(pow(self.BASE, -1, 1 << 64))

    def _sums(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        n = len(c) + 2
        if len(self.powers) < n:
            self.powers, self.back = (np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(2 * n, x, dtype=np.uint64))),
                                                 dtype=np.uint64) for x in (np.uint64(self.BASE), self.inverse))
        return c, np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(c * self.powers[:len(c)], dtype=np.uint64)))

    def _mixed(self, h: np.ndarray, number: np.ndarray) -> np.ndarray:
        h = (h ^ number.astype(np.uint64) * self.SPREAD) * self.MIX
        h = (h ^ (h >> np.uint64(29))) * self.MIX
        return h ^ (h >> np.uint64(32))

    def _stretches(self, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
        """(lines, stretch's number, 1 / 0 / -1: characters more than the piece, start, end): each piece as the shorter
        line has it, wherever it may lie in these lines of ``n`` characters, and one character longer or shorter."""
        last = self.pieces - 1
        for less in range(self.edits + 1):
            length = _rounded(np.maximum(n - less, 0))
            new = (n > less) & ((length != _rounded(n - less + 1)) if less else True)
            lines = np.flatnonzero(new)
            length = length[lines]
            for p in range(self.pieces):
                start, end = length * p // self.pieces, length * (p + 1) // self.pieces
                moves = range(-self.edits, self.edits + 1) if 0 < p < last else [n[lines] - length if p == last else 0]
                for s in moves:
                    for more in (-1, 0, 1):     # the last piece is counted from the line's end
                        a, b = (start + s - more, end + s) if p == last else (start + s, end + s + more)
                        ok = (a >= 0) & (a <= b) & (b <= n[lines])
                        yield lines[ok], (length * self.pieces + p)[ok], more, a[ok], b[ok]

    def of(self, lines: list[str], chosen: list | None = None) -> list[np.ndarray]:
        """Keys of stretches without a part, or (``chosen``: the numbers of stretches or null, by line) of whole
        stretches and the one-deletion variants of the chosen ones."""
        n = np.array([len(x) for x in lines], dtype=np.int64)
        at = np.concatenate(([0], np.cumsum(n)[:-1]))
        c, sums = self._sums("".join(lines))
        runs = np.concatenate(([True], c[1:] != c[:-1]))
        pairs = np.array([i << 32 | x for i, some in enumerate(chosen or ()) for x in some or ()], dtype=np.int64)
        out, variants = [], []
        for line, number, more, a, b in self._stretches(n):
            size, a, b = b - a, at[line] + a, at[line] + b
            whole = self._mixed((sums[b] - sums[a]) * self.back[a], number)
            if chosen is None:
                # unlike pieces within one edit: the shorter has ``base`` characters, the other one more or as many
                for base in ([size] if more < 1 else []) + ([size - 1] if more > -1 else []):
                    ok = base >= 0
                    cut = np.arange(PARTS + 1) * base[ok, None] // PARTS
                    head, tail = a[ok, None] + cut[:, :-1], b[ok, None] - (base[ok, None] - cut[:, 1:])
                    h = ((sums[head] - sums[a[ok], None]) * self.back[a[ok], None] * np.uint64(31)
                         + (sums[b[ok], None] - sums[tail]) * self.back[tail] * np.uint64(1_000_003)
                         + np.arange(1, PARTS + 1, dtype=np.uint64) * self.SPREAD + base[ok, None].astype(np.uint64) * self.MIX)
                    out.append((np.repeat(line[ok], PARTS), self._mixed(h, number[ok, None]).ravel(),
                                np.repeat(whole[ok], PARTS), np.repeat(number[ok], PARTS)))
                continue
            if more < 1:
                out.append((line, whole, whole, number))
            if more > -1:
                for i in np.flatnonzero((size > 0) & np.isin(line << 32 | number, pairs)):
                    x, y = int(a[i]), int(b[i])
                    gone = x + np.flatnonzero(runs[x:y] | (np.arange(x, y) == x))
                    h = (sums[gone] - sums[x] + (sums[y] - sums[gone + 1]) * self.inverse) * self.back[x]
                    variants.append([self._mixed(h, number[i:i + 1]) if v is None else np.repeat(v[i], len(h)) for v in (line, None, whole, number)])
        out = [np.concatenate(x) for x in zip(*out, *variants, strict=True)]
        # a line's key once, from its shortest stretch (lines whose shortest ones are equal meet there), or a whole one
        order = np.lexsort((out[1], out[0]))
        line, h = out[0][order], out[1][order]
        order = order[np.concatenate((np.ones(min(1, len(h)), dtype=bool), (line[1:] != line[:-1]) | (h[1:] != h[:-1])))]
        return [x[order] for x in out]

    def emit(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lid, line) -> (lid, h, w, number): stretches without a part; with a third column, the numbers of
        the chosen stretches (or null): whole stretches and the variants of the chosen ones."""
        with np.errstate(over="ignore"):
            for batch in batches:
                lids, lines = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
                chosen = batch.column(2).to_pylist() if batch.num_columns > 2 else None
                blocks = np.cumsum([len(x) + 200 for x in lines]) // 200_000
                for block in np.unique(blocks):
                    i, j = np.searchsorted(blocks, [block, block + 1])
                    row, h, w, number = self.of(lines[i:j], None if chosen is None else chosen[i:j])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (lids[i:j][row], h.view(np.int64), w.view(np.int64), number)],
                                                     ["lid", "h", "w", "number"])


def near_lines_within(lines: DataFrame, max_edits: int) -> DataFrame:
    """``lid`` of the lines within ``max_edits`` (two or more) of an earlier one. ``lines``: (lid, line),
    distinct lines, numbered from the earliest."""
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = lines.select("lid", "line").repartition(tasks, "lid")
    signed = written(spread.mapInArrow(_signatures, "lid bigint, line string, n int, chars bigint, grams bigint"), "signed")
    emit, row = PieceVariants(max_edits).emit, "lid bigint, h bigint, w bigint, number bigint"

    cuts = signed.select("lid", "line").mapInArrow(emit, row)
    unlike = cuts.groupBy("h").agg(F.min("w").alias("w1"), F.max("w").alias("w2")).where("w1 <> w2").select("h")
    met = cuts.select("h", "lid", "number").join(written(unlike, "parts"), "h", "left_semi")
    chosen = written(met.groupBy("lid").agg(F.collect_set("number").alias("chosen")), "chosen")
    variants = written(signed.select("lid", "line").join(chosen, "lid", "left"), "stretches").mapInArrow(emit, row)
    # a variant that only equal stretches share links nothing that the stretch itself does not link
    shared = (variants.groupBy("h").agg(F.min("lid").alias("head"), F.max("lid").alias("y"), F.min("w").alias("w1"), F.max("w").alias("w2"),
                                        F.count(F.lit(1)).alias("members"))
              .where((F.col("head") < F.col("y")) & ((F.col("w1") != F.col("w2")) | (F.col("w1") == F.col("h"))))
              .select("h", "head", "members"))
    keyed = written(variants.select("h", "lid").join(written(shared, "variants"), "h"), "keyed")

    columns = ["lid", "line", "n", "chars", "grams"]
    earlier = signed.select([F.col(c).alias(f"_{c}") for c in columns])

    near = (F.col("lid") > F.col("_lid")) & _near_signatures(max_edits) & (F.levenshtein("line", "_line", max_edits) >= 0)
    pairs = keyed.where("lid <> head").select("lid", F.col("head").alias("_lid")).distinct()
    first = written(pairs.join(signed, "lid").join(earlier, "_lid").where(near).select("lid").distinct(), "settled")
    rest = written(keyed.where("members > 2 and lid <> head").join(first, "lid", "left_anti").select("lid", "h"), "rest")
    others = keyed.where("members > 2").select("h", F.col("lid").alias("_lid")).join(rest.select("h"), "h", "left_semi")
    second = rest.join(signed, "lid").join(others.join(earlier, "_lid").withColumnRenamed("h", "_h"), (F.col("h") == F.col("_h")) & near, "left_semi")
    return first.unionByName(second.select("lid").distinct())


def _part_length(length: Column) -> Column:
    """Half the length, rounded down to a geometric series (eighths), so that most lengths next to each other agree."""
    half = F.floor(length / 2)
    step = F.floor(F.log(half / 8) / math.log(1.125))
    return F.least(F.floor(F.lit(8) * F.pow(F.lit(1.125), step)), half).cast("int")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1,
               min_chars: int = MIN_CHARS, broadcast_rows: int = 500_000) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_lines``, ``kept_lines`` and ``text``, the lines that stay.

    Lines are what line feeds separate, compared as they are; blank ones always stay. A line is
    dropped when an equal line, or (both of ``min_chars`` or more) one within ``max_edits`` edits,
    occurs earlier, in order of document id (null ids last), then text hash, then line number.
    ``max_edits`` = 0 compares exactly only; ``min_chars`` = 0 holds lines of every length to the bound. A line goes even if the earlier one goes too (each is near
    an earlier one). Null text: empty, one blank line. Rows that repeat id and text are one
    document and get the same result."""
    if max_edits < 0:
        raise ValueError("max_edits is 0 or more")
    base = plain(docs, id_col, text_col)
    own = base.select("doc_id", F.xxhash64("text").alias("th"), "text")
    cut = own.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    cut = cut.where(F.when(F.ascii("line") > 32, F.lit(True)).otherwise(F.trim(F.col("line"), F.lit(" \t\x0b\x0c\r")) != ""))
    # 128 bits of a line: two hashes with different seeds
    cut = cut.select(F.xxhash64("line").alias("l1"), F.xxhash64(F.lit("line"), F.col("line")).alias("l2"),
                     F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th", "no").alias("at"), "line")
    if max_edits > 1:
        schema = cut.select("l1", "l2", "at", *[F.lit(None).cast(t).alias(c) for c, t in CODES.items()]).schema
        occurrences = written(cut.select("l1", "l2", "at", "line").mapInArrow(_coded(max_edits, min_chars), schema), "lines")
        late = _late_lines_within(own, occurrences, max_edits, broadcast_rows)
    else:
        late = _late_lines(cut, min_chars, broadcast_rows) if max_edits else None
        occurrences = written(cut.select("l1", "l2", "at"), "lines")
    classes = occurrences.groupBy("l1", "l2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    if late is None:
        repeated = classes.where("n > 1").withColumn("late", F.lit(False))
    else:
        repeated = classes.join(late, ["l1", "l2"], "left").where("n > 1 or late")
    repeated = written(repeated.select("l1", "l2", "first", "late"), "repeated")     # apart, so that a hot line's occurrences can be split
    gone = (occurrences.join(repeated, ["l1", "l2"]).where(F.coalesce("late", F.lit(False)) | (F.col("at") != F.col("first")))
            .select("at.doc_id", "at.th", "at.no").distinct()
            .groupBy("doc_id", "th").agg(F.collect_list("no").alias("gone"))
            .select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "gone"))
    joined = own.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    rest = let(F.split("text", "\n"), lambda x: F.when(F.col("gone").isNull(), x).otherwise(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i))))
    return (joined.select("doc_id", F.size(F.split("text", "\n")).alias("n_lines"), rest.alias("rest"))
            .select("doc_id", "n_lines", F.size("rest").alias("kept_lines"), F.array_join("rest", "\n").alias("text")))


def _near_signatures(max_edits: int) -> Column:
    """Whether the signatures (``n``, ``chars``, ``grams`` and the same with ``_``) may be of lines within ``max_edits``:
    an edit flips at most two parities of characters and four of pairs."""
    def flips(c: str) -> Column:
        return F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}")))

    return (F.abs(F.col("n") - F.col("_n")) <= max_edits) & (flips("chars") <= 2 * max_edits) & (flips("grams") <= 4 * max_edits)


def _late_lines_within(own: DataFrame, coded: DataFrame, max_edits: int, broadcast_rows: int) -> DataFrame:
    """(l1, l2, late = true) of the lines within ``max_edits`` (two or more) of an earlier one. ``own``: (doc_id, th, text);
    ``coded``: (l1, l2, at, n, chars, grams, keys). Lines that share no stretch, or only with lines of other
    signatures, are set aside; those of a stretch that more than ``CROWD`` lines share are all kept."""
    keys = coded.select("l1", F.explode("keys").alias("h"))
    shared = written(keys.groupBy("h").agg(F.min("l1").alias("x"), F.max("l1").alias("y")).where("x <> y").select("h"), "shared")
    met = written(keys.join(sized_side(shared, broadcast_rows), "h", "left_semi").distinct(), "met")     # narrow rows first
    signed = coded.select("l1", "l2", "n", "chars", "grams").join(sized_side(met, broadcast_rows), "l1").distinct()
    sizes = met.groupBy("h").agg(F.count(F.lit(1)).alias("members"))
    signed = written(signed.join(sizes, "h"), "signed")
    few = signed.where(F.col("members") <= CROWD).drop("members")
    other = few.select([F.col(c).alias(f"_{c}") for c in few.columns])
    pairs = few.join(other, (F.col("h") == F.col("_h")) & (F.struct("l1", "l2") < F.struct("_l1", "_l2")) & _near_signatures(max_edits))
    likely = pairs.select(F.explode(F.array(F.struct("l1", "l2"), F.struct(F.col("_l1").alias("l1"), F.col("_l2").alias("l2")))).alias("x")).select("x.*")
    likely = written(likely.unionByName(signed.where(F.col("members") > CROWD).select("l1", "l2")).distinct(), "likely")
    lines = (coded.select("l1", "l2", "at").join(sized_side(likely, broadcast_rows), ["l1", "l2"]).groupBy("l1", "l2").agg(F.min("at").alias("first"))
             .orderBy("first").withColumn("lid", F.monotonically_increasing_id()))
    lines = written(lines, "numbered")
    places = sized_side(lines.select("lid", F.col("first.doc_id").alias("_id"), F.col("first.th").alias("_th"), F.col("first.no").alias("no")), broadcast_rows)
    texts = own.join(places, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    texts = texts.select("lid", F.get(F.split("text", "\n"), F.col("no")).alias("line")).groupBy("lid").agg(F.first("line").alias("line"))
    late = near_lines_within(written(texts, "texts"), max_edits)
    return written(lines.join(late, "lid", "left_semi").select("l1", "l2", F.lit(True).alias("late")), "late")


def _late_lines(cut: DataFrame, min_chars: int, broadcast_rows: int) -> DataFrame:
    """(l1, l2, late = true) of the lines within one edit of an earlier one."""
    n = F.char_length("line")
    eligible = cut.where(n >= min_chars)

    def parts() -> Column:
        def part(size: Column) -> list[Column]:
            return [F.xxhash64(F.substring(F.col("line"), F.lit(1), size), F.lit(0)),
                    F.xxhash64(F.substring(F.col("line"), n - size + 1, size), F.lit(1))]
        own, less = _part_length(n), _part_length(n - 1)
        return F.when(own == less, F.array(*part(own))).otherwise(F.array(*part(own), *part(less)))

    keys = eligible.select("l1", "l2", F.explode(parts()).alias("h"))
    shared = written(keys.groupBy("h").agg(F.min("l1").alias("x"), F.max("l1").alias("y")).where("x <> y").select("h"), "shared")
    if shared.count() <= broadcast_rows:
        hit = eligible.select("l1", "l2", "at", "line", F.explode(parts()).alias("h")).join(F.broadcast(shared), "h", "left_semi")
    else:  # narrow rows first, then the texts of the lines that are left
        ids = keys.join(sized_side(shared, broadcast_rows), "h", "left_semi").select("l1", "l2").distinct()
        hit = eligible.join(sized_side(written(ids, "likely"), broadcast_rows), ["l1", "l2"], "left_semi")
    lines = (hit.groupBy("l1", "l2").agg(F.min("at").alias("first"), F.first("line").alias("line"))
             .orderBy("first").withColumn("lid", F.monotonically_increasing_id()).select("lid", "l1", "l2", "line"))
    lines = written(lines, "numbered")
    late = near_lines(lines).select(F.greatest("lid", "other").alias("lid")).distinct()
    return written(lines.select("lid", "l1", "l2").join(late, "lid", "left_semi")
                   .select("l1", "l2", F.lit(True).alias("late")), "late")
