"""Packing documents into windows by the sum-of-squares rule.

A document is its token ids and an end id. Whole windows are cut off it first; the rest (fewer ids
than a window) is placed online: among the fill levels h that leave room, the one whose use
minimises the sum over all levels of (number of open windows at that level)^2. A level array holds
those numbers, so a placement is one vector expression over the levels. At the end of a partition
the windows that are still open are closed: the emptiest give their pieces to the fullest (pieces
are cut freely), and what is left is cut into windows whose lengths are powers of two, which need
no padding.

Scale: every partition packs its own documents in the pass that tokenises them: no shuffle, no
text or ids leave the task, and memory holds only one Arrow batch and the open windows (at most a
few thousand windows of ``window`` ids). Sequence ids carry the partition number. A lost task runs
again as a whole, over the same file split."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
END_ID = 1
PIECES = ("doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "`offset` bigint")


def byte_bpe(name: str = "byte_bpe_50k") -> Callable[[str], list[int]]:
    """Encoder of the public byte-level BPE vocabulary ``name``: the ids of its JSON file, taken through its rank
    file by the other library (three times as fast). Tokens that the JSON file adds (special strings) are one id
    each wherever they stand in a text, as that file has it."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: library.encode(text, allowed_special="all")


class LevelPacker:
    """Sum-of-squares packer of one partition. A piece is (doc, start, ids, doc_tokens)."""

    def __init__(self, window: int, emit: Callable):
        self.window, self.emit, self.next = window, emit, 0
        self.count = np.zeros(window + 1, dtype=np.int64)      # the level array: open windows by fill
        self.open: list[list] = [[] for _ in range(window)]     # level -> windows (lists of pieces)

    def close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.emit(doc, start, ids, total, self.next, at)
            at += len(ids)
        self.next += 1

    def level_for(self, size: int) -> int:
        """The level to place ``size`` ids at; 0 opens a window. Using level h changes the sum of
        squares by 2 * (N[h + size] - N[h]) + 2, with a full window (and level 0) counted as none."""
        top = self.window - size
        rise = self.count[size:self.window + 1].astype(np.int64)  # N[h + size] for h = 0..top
        rise[-1] = 0                                               # a full window is closed at once
        change = 2 * (rise - self.count[:top + 1]) + 2
        change[0] = 2 * self.count[size] + 1
        change[-1] = -2 * self.count[top] + 1
        change[1:][self.count[1:top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))                  # ties: the fullest

    def place(self, piece: tuple) -> None:
        size = len(piece[2])
        h = self.level_for(size) if size < self.window else 0
        if h:
            bin_ = self.open[h].pop()
            self.count[h] -= 1
        else:
            bin_ = []
        bin_.append(piece)
        if h + size == self.window:
            self.close(bin_)
        else:
            self.open[h + size].append(bin_)
            self.count[h + size] += 1

    def add(self, doc, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        for start in range(0, n - n % w, w):
            self.close([(doc, start, ids[start:start + w], n)])
        if n % w:
            self.place((doc, n - n % w, ids[n - n % w:], n))

    def finish(self) -> None:
        """Close what is open: the emptiest windows' pieces fill the fullest; the rest by powers of two."""
        left = [b for level in self.open for b in level]           # from the emptiest to the fullest
        fill = lambda b: sum(len(p[2]) for p in b)                  # noqa: E731
        lo = 0
        stock: list = []                                            # pieces taken out of the emptiest windows
        while len(left) > lo:
            bin_ = left.pop()
            room = self.window - fill(bin_)
            while room:
                if not stock:
                    if lo >= len(left):
                        break
                    stock = left[lo][::-1]
                    lo += 1
                doc, start, ids, total = stock.pop()
                if len(ids) > room:
                    stock.append((doc, start + room, ids[room:], total))
                    ids = ids[:room]
                bin_.append((doc, start, ids, total))
                room -= len(ids)
            if room:
                stock = bin_[::-1]
            else:
                self.close(bin_)
        rest = sum(len(p[2]) for p in stock)
        while rest:
            size = 1 << (rest.bit_length() - 1)
            size = min(size, self.window)
            bin_, room = [], size
            while room:
                doc, start, ids, total = stock.pop()
                if len(ids) > room:
                    stock.append((doc, start + room, ids[room:], total))
                    ids = ids[:room]
                bin_.append((doc, start, ids, total))
                room -= len(ids)
            self.close(bin_)
            rest -= size
        self.open = [[] for _ in range(self.window)]
        self.count[:] = 0


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   end_id: int = END_ID, encoder: Callable[[], Callable[[str], list[int]]] = byte_bpe,
                   with_ids: bool = True, batch_rows: int = 2000) -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` (ids of its document before it), ``length``,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` (place in its sequence) and, with
    ``with_ids``, the ``ids`` themselves.

    Every id of every row lies in exactly one piece; a null or empty text is the end id alone.
    Repeated rows are packed as often as they occur; null ids stay null. Sequences are gapless from
    offset 0; all have ``window`` ids, but for a few per partition whose length is a power of two."""
    id_type = docs.schema[id_col].dataType
    schema = PIECES.format(id=id_type.simpleString()) + (", ids array<int>" if with_ids else "")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(), TaskContext.get().partitionId()
        rows: list[list] = [[] for _ in names]
        id_kind = None

        def emit(doc, start, ids, total, seq, offset):
            values = [doc, start, len(ids), zlib.crc32(ids.tobytes()), total, (part << 33) + seq, offset]
            for column, v in zip(rows, values + [ids] * with_ids, strict=True):
                column.append(v)

        def flush():
            arrays = [pa.array(c, type=id_kind if i == 0 else pa.int64() if i < 7 else pa.list_(pa.int32()))
                      for i, c in enumerate(rows)]
            for c in rows:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        packer = LevelPacker(window, emit)
        for batch in batches:
            id_kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, batch_rows):
                part_of = batch.slice(at, batch_rows)
                for doc, text in zip(part_of.column(0).to_pylist(), part_of.column(1).to_pylist(), strict=True):
                    packer.add(doc, np.array(encode(text or "") + [end_id], dtype="<i4"))
                if rows[0]:
                    yield flush()
        packer.finish()
        if rows[0]:
            yield flush()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(pack, schema)
