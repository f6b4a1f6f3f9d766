"""Token counts of whole texts under a byte-pair model with byte fallback, by rank-synchronous merging.

A text is normalised by the tokenizer library and cut where no piece of the vocabulary holds the two
characters beside the cut: no merge can ever cross such a place, so the pieces between the cuts
(pre-tokens) are merged apart, exactly. The distinct new pre-tokens of a batch lie in one ragged array
(symbols, and the sequence each belongs to). A step finds the lowest rank of every sequence and
applies the leftmost pair of that rank in all sequences at once; a sequence without a mergeable pair
leaves the arrays. What counts is what survives: one token a piece, and one a UTF-8 byte for a character
without a piece. A pre-token of over ``LONG`` characters (a run without any cut) is merged in the same
order through a priority queue instead, so that its cost is not quadratic.

Scale: one pass over the rows without a shuffle; per task one model and a bounded memory of counted
pre-tokens. Nothing depends on other rows."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veerline.llm.common import plain

LONG = 2048               # characters of a pre-token from which the priority queue takes over
BATCH_CHARS = 4_000_000   # characters merged together
REMEMBERED = 500_000      # pre-tokens a task remembers before it starts anew
NONE = np.iinfo(np.int32).max


class PieceCounter:
    """Counts the tokens of texts as the library does for a BPE ``.model`` file with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece
        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        special = (lib.is_control, lib.is_unknown, lib.is_byte, lib.is_unused)
        if not any(map(lib.is_byte, range(lib.get_piece_size()))):
            raise ValueError("the model has no byte pieces: characters without a piece would be one token a run")
        ids = [i for i in range(lib.get_piece_size()) if not any(f(i) for f in special)]
        piece_id = {lib.id_to_piece(i): n for n, i in enumerate(ids)}
        score = np.array([lib.get_score(i) for i in ids])
        rank = np.unique(-score, return_inverse=True)[1]             # equal scores: equal ranks, the leftmost first

        letters = sorted({c for p in piece_id for c in p})
        symbol = dict(piece_id)                                      # single characters without a piece come after
        for c in letters:
            symbol.setdefault(c, len(symbol))
        self.n_pieces, self.unknown = len(piece_id), len(symbol)
        self.base = self.unknown + 1
        self.symbol_of = np.full(0x110000, self.unknown, np.int32)
        self.symbol_of[[ord(c) for c in letters]] = [symbol[c] for c in letters]

        pairs = {}
        for p, n in piece_id.items():
            for i in range(1, len(p)):
                if p[:i] in symbol and p[i:] in symbol:
                    pairs[symbol[p[:i]] * self.base + symbol[p[i:]]] = n
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_piece = np.array([pairs[k] for k in self.pair_key.tolist()], np.int32)
        self.pair_rank = rank[self.pair_piece].astype(np.int32)

        # joined[class of a, class of b]: some piece holds the characters a, b side by side
        self.class_of = np.zeros(0x110000, np.int32)
        self.class_of[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.n_classes = len(letters) + 1
        self.joined = np.zeros(self.n_classes * self.n_classes, bool)
        beside = {(a, b) for p in piece_id for a, b in zip(p, p[1:], strict=False)}
        if beside:
            a, b = (self.class_of[[ord(x[i]) for x in beside]] for i in (0, 1))
            self.joined[a * self.n_classes + b] = True
        self.seen: dict[str, int] = {}

    def pretokens(self, text: str) -> list[str]:
        """The normalised text, cut where no piece crosses."""
        text = self.lib.normalize(text)
        if not text:
            return []
        at = self.class_of[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        cuts = np.flatnonzero(~self.joined[at[:-1] * self.n_classes + at[1:]]) + 1
        bounds = [0, *cuts.tolist(), len(text)]
        return [text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        cut = [self.pretokens(t) for t in texts]
        if len(self.seen) > REMEMBERED:
            self.seen = {}
        new = list({p for pieces in cut for p in pieces if p not in self.seen})
        short = [p for p in new if len(p) <= LONG]
        self.seen.update(zip(short, self.merged(short), strict=True))
        self.seen.update((p, self.merged_long(p)) for p in new if len(p) > LONG)
        counts = [sum(map(self.seen.__getitem__, pieces)) for pieces in cut]
        for p in new:
            if len(p) > 64:                                          # long ones are not worth remembering
                del self.seen[p]
        return counts

    def start(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First symbols of a text's characters, and the tokens each stands for when it survives."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.symbol_of[code]
        n_bytes = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        return sym, np.where(sym < self.n_pieces, 1, n_bytes).astype(np.int32)

    def looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of each pair; rank NONE where the pair makes no piece."""
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        found = self.pair_key[at] == key
        return np.where(found, self.pair_rank[at], NONE), self.pair_piece[at]

    def merged(self, pretokens: list[str]) -> list[int]:
        """Surviving symbols of each pre-token; all are merged in step."""
        counts = np.zeros(len(pretokens), np.int64)
        if not pretokens:
            return []
        sym, weight = self.start("".join(pretokens))
        seq = np.repeat(np.arange(len(pretokens)), np.fromiter(map(len, pretokens), np.int64))
        rank, piece = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int32)
        inner = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inner], piece[inner] = self.looked_up(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            if (over := lowest == NONE).any():                       # sequences that are finished leave
                counts[seq[starts[over]]] = np.add.reduceat(weight, starts)[over]
                stay = np.repeat(~over, sizes)
                sym, weight, seq, rank, piece = (x[stay] for x in (sym, weight, seq, rank, piece))
                continue
            at = np.flatnonzero(rank == np.repeat(lowest, sizes))
            at = at[np.r_[True, seq[at[1:]] != seq[at[:-1]]]]        # the leftmost of each sequence
            sym[at], weight[at] = piece[at], 1
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, weight, seq, rank, piece = (x[stay] for x in (sym, weight, seq, rank, piece))
            at = at - np.arange(len(at))                             # each merge before it took one place
            changed = np.union1d(at, at[at > 0] - 1)
            rank[changed] = NONE
            changed = changed[changed + 1 < len(sym)]
            changed = changed[seq[changed] == seq[changed + 1]]
            rank[changed], piece[changed] = self.looked_up(sym[changed], sym[changed + 1])
        return counts.tolist()

    def merged_long(self, pretoken: str) -> int:
        """The same for one long pre-token: pairs leave a queue by rank, then from the left."""
        sym, weight = (x.tolist() for x in self.start(pretoken))
        table = dict(zip(self.pair_key.tolist(), zip(self.pair_rank.tolist(), self.pair_piece.tolist(), strict=True), strict=True))
        n, base = len(sym), self.base
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(table[k][0], i, k) for i in range(n - 1) if (k := sym[i] * base + sym[i + 1]) in table]
        heapq.heapify(queue)
        while queue:
            _, i, key = heapq.heappop(queue)
            j = after[i] if sym[i] >= 0 else n
            if j >= n or sym[i] * base + sym[j] != key:              # one of the two is gone or changed
                continue
            sym[i], weight[i], sym[j], weight[j] = table[key][1], 1, -1, 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (k := sym[a] * base + sym[b]) in table:
                    heapq.heappush(queue, (table[k][0], a, k))
        return sum(weight)


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def _count_batches(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(path)
        for batch in batches:
            counts, texts, chars = [], [], 0
            for text in batch.column("text"):
                texts.append(text.as_py())
                chars += len(texts[-1])
                if chars >= BATCH_CHARS:
                    counts += model.count(texts)
                    texts, chars = [], 0
            counts = pa.array(counts + model.count(texts), pa.int64())
            over = pa.array([n > limit for n in counts.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), counts, over],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return run


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit``).

    Null and empty texts have 0 bytes and 0 tokens. Special strings in a text are ordinary text. Repeated rows
    come out as often as they go in; ids may be null or of any type. No rows: no rows. ``model_path`` names a
    file that every worker can read."""
    rows = plain(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_count_batches(model_path, limit), f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
