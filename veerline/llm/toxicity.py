"""Toxicity of deobfuscated text, by a noisy channel.

Channel: a writer hides a word by look-alike signs (1d10t), by one to three signs or blanks between
its letters (i d i o t, i//d//i//o//t) or by repeating letters (idiooot). Each hidden span is a
lattice: a sign may stand for one of a few letters or for itself, a gap between single letters for
nothing or a blank, a run of three or more equal letters for one or two. A word that only ends in
signs (covid19, a$$) may well be meant as it stands: its reading in letters alone counts beside the word. A character language model (the three characters before, smoothed
over shorter contexts, counted over the whole corpus) scores the paths, and Viterbi search takes
the best one. The restored text is then scored by the words and word beginnings that mark rows
labelled toxic.

Scale: the character counts are combined per task (at most 29^4 cells) and then by sum. Words are
counted over a bounded sample of labelled rows (``sample_rows``, by id hash) inside Spark; the
driver gets the marking words only. Scoring is one narrow pass without a shuffle."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veerline.llm.common import id_bucket
from veerline.llm.language_id import _buffers

# Characters of the language model: 0 white space, 1 to 26 a to z, 27 other letters (bytes over 127), 28 the rest.
SYMBOLS, LETTER, OTHER = 29, 27, 28
_CODE = np.full(256, OTHER, dtype=np.int32)
_CODE[128:] = LETTER
_CODE[[9, 10, 11, 12, 13, 32]] = 0
_CODE[65:91] = _CODE[97:123] = np.arange(1, 27)
STEP = 1 << 20

# What a sign may stand for, besides itself.
LOOKALIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
             "!": "il", "|": "il", "+": "t", "€": "e", "*": "aeiou"}
_SIGN = r"0-9@$!|+*€"
_GAP = rf"(?:[^\w{_SIGN}]|_){{1,3}}"
SUSPECT = re.compile(
    rf"(?<![^\W_])(?:[a-z{_SIGN}]{_GAP}){{2,}}[a-z{_SIGN}](?![^\W_])"               # single letters, other signs between
    r"|(?<![^\W_])[a-z0-9]([@$!|+*€])\1{0,2}[a-z0-9](?:\1{1,3}[a-z0-9])+(?![^\W_])"  # single letters, one of these between
    rf"|(?<![^\W_])(?:[a-z{_SIGN}][ .\-_*]){{3,}}[a-z{_SIGN}](?![^\W_])"            # both kinds between
    rf"|(?<![\w{_SIGN}])(?=[{_SIGN}]*[a-z])(?=[a-z]*[{_SIGN}]+[a-z])[a-z{_SIGN}]{{3,}}(?![\w])"  # look-alikes before letters
    r"|(?<![^\W_])(?=[a-z]*([a-z])\2\2)[a-z]{4,}(?![^\W_])")                        # a letter three times or more
SPACED = re.compile(rf".(?:{_GAP}.)+|.(?:([@$!|+*€])\1{{0,2}}.)+|(?:.[ .\-_*])+.", re.DOTALL)
TAILED = re.compile(rf"(?<![\w{_SIGN}])(?=\S{{3}})[a-z]+[0-9@$€]+(?!\w)")
# What any match needs, quickly found: three single letters in a row, a letter after a look-alike, a letter three times; a sign after a letter.
HINTS = [re.compile(rf"[\W_][a-z{_SIGN}][\W_]{{1,3}}[a-z{_SIGN}][\W_]{{1,3}}[a-z{_SIGN}](?![^\W_])"),
         re.compile(rf"[{_SIGN}][a-z]"), re.compile(r"([a-z])\1\1")]
TAIL_HINT = re.compile(r"[a-z][0-9@$€]")
WORDS = re.compile(r"[^\W\d_]+")


def count_characters(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of all four-character strings of every text, as a [29, 29, 29, 29] array; none crosses two texts."""
    size = SYMBOLS ** 4

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            raw, off = _buffers(batch.column(0))
            end = int(off[-1]) if len(off) else 0
            c, text = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
            for at in range(int(off[0]) if len(off) else 0, end, STEP):
                stop = min(at + STEP, end)
                c = np.concatenate((c[-3:], _CODE[raw[at:stop]]))                  # three characters of the step before
                text = np.concatenate((text[-3:], np.searchsorted(off, np.arange(at, stop), side="right")))
                keep = np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0) | (text[1:] != text[:-1])))
                c, text = c[keep], text[keep]                                      # white space counts once
                if len(c) > 3:
                    grams = ((c[:-3] * SYMBOLS + c[1:-2]) * SYMBOLS + c[2:-1]) * SYMBOLS + c[3:]
                    total += np.bincount(grams[text[:-3] == text[3:]], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])

    rows = (docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, "gram int, n bigint")
            .groupBy("gram").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(size, dtype=np.int64)
    out[np.asarray(rows.column("gram"))] = np.asarray(rows.column("n"))
    return out.reshape((SYMBOLS,) * 4)


def character_model(counts: np.ndarray, weight: float = 4.0) -> np.ndarray:
    """log P(character | three before), each order smoothed by the next shorter one (``weight`` counts)."""
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for axes in ((0, 1, 2), (0, 1), (0,), ()):
        n = counts.sum(axis=axes)
        p = (n + weight * p) / (n.sum(axis=-1, keepdims=True) + weight)
    return np.log(p).astype(np.float32)


def _code(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 0 if ch == " " else LETTER if ch > "\x7f" else OTHER


def lattice(span: str) -> list[list[str]]:
    """The choices of each step of a hidden span (already in lower case)."""
    if SPACED.fullmatch(span):
        return _spaced_lattice(span)
    steps: list[list[str]] = []
    i = 0
    while i < len(span):
        ch = span[i]
        j = i
        while j < len(span) and span[j] == ch:
            j += 1
        letters = _letters(ch)
        if j - i >= 3:
            steps.append([x for c in letters for x in (c, c * 2)])
            i = j
        else:
            steps.append(letters)
            i += 1
    return steps


def _letters(ch: str) -> list[str]:
    return [ch] if ch.isalpha() else [*LOOKALIKE.get(ch, ""), ch]


def _spaced_lattice(span: str) -> list[list[str]]:
    """Single letters and gaps in turn; a gap that is a single look-alike sign may also be a letter."""
    steps: list[list[str]] = []
    i = 0
    while i < len(span):
        if not steps or len(steps) % 2 == 0:
            steps.append(_letters(span[i]))
            i += 1
            continue
        j = i + 1                                       # the gap: up to the next letter or look-alike sign
        if span[i] in LOOKALIKE:
            while j < len(span) - 1 and span[j] == span[i]:
                j += 1
        else:
            while j < len(span) - 1 and span[j] not in LOOKALIKE and not "a" <= span[j] <= "z" and not span[j].isdigit():
                j += 1
        steps.append(["", " ", *(LOOKALIKE.get(span[i], "") if j == i + 1 else "")])
        i = j
    return steps


def decode(span: str, model: np.ndarray, steps: list[list[str]] | None = None) -> str:
    """The most likely reading of a hidden span (or of the given steps), between blanks."""
    best: dict = {(0, 0, 0): (0.0, None)}              # last three characters -> (log probability, (path before, choice))
    for choices in [*(lattice(span) if steps is None else steps), [" "]]:
        after: dict = {}
        for (a, b, c), (score, path) in best.items():
            for choice in choices:
                s, x, y, z = score, a, b, c
                for ch in choice:
                    k = _code(ch)
                    s += float(model[x, y, z, k])
                    x, y, z = y, z, k
                old = after.get((x, y, z))
                if old is None or s > old[0]:
                    after[(x, y, z)] = (s, (path, choice))
        best = after
    path = max(best.values(), key=lambda found: found[0])[1]
    out = []
    while path is not None:
        path, choice = path
        out.append(choice)
    return "".join(reversed(out))[:-1]


class Restorer:
    """Restores texts; readings of spans are remembered (at most ``memory`` of them)."""

    def __init__(self, model: np.ndarray, memory: int = 100_000):
        self.model, self.memory, self.known = model, memory, {}

    def _read(self, m: re.Match) -> str:
        span = m.group(0)
        got = self.known.get(span)
        if got is None:
            if len(self.known) >= self.memory:
                self.known.clear()
            got = self.known[span] = decode(span, self.model)
        return got

    def _read_tail(self, m: re.Match) -> str:
        """A word that ends in signs, with each of them a letter where it can stand for one."""
        steps = [[x for x in choices if x.isalpha()] or choices for choices in lattice(m.group(0))]
        return decode("", self.model, steps)

    def restore(self, text: str) -> str:
        text = text.lower()
        return SUSPECT.sub(self._read, text) if any(hint.search(" " + text) for hint in HINTS) else text

    def marks(self, text: str) -> set[str]:
        """The marks of the restored text and of the readings of words that end in signs."""
        restored = self.restore(text)
        if not TAIL_HINT.search(restored):
            return marks(restored)
        return marks(" ".join([restored, *(self._read_tail(m) for m in TAILED.finditer(restored))]))


def marks(restored: str) -> set[str]:
    """The distinct words of a text, and their first three and four letters (as '^abc', '^abcd')."""
    words = set(WORDS.findall(restored))
    return words | {"^" + w[:3] for w in words} | {"^" + w[:4] for w in words}


def learn_marks(sample: DataFrame, restorer: Restorer, alpha: float = 0.05, max_marks: int = 20_000) -> dict[str, float]:
    """Log odds of the marks of toxic rows. ``sample``: (text, toxic 0 / 1), distinct texts.

    A mark counts when its rows are toxic more often than chance allows: rows x relative entropy
    against the toxic share exceeds ln(tested marks / alpha) (Chernoff bound, all tests together)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n.update((m, y) for m in restorer.marks(text or ""))
                n["", y] += 1
            keys = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], type=pa.string()), pa.array([n[k] if k[1] else 0 for k in keys], type=pa.int64()),
                 pa.array([n[k] for k in keys], type=pa.int64())], ["mark", "toxic", "rows"])

    counts = (sample.mapInArrow(count, "mark string, toxic bigint, `rows` bigint")
              .groupBy("mark").agg(F.sum("toxic").alias("toxic"), F.sum("rows").alias("rows")).where("rows >= 3"))
    counts = counts.persist()
    total = counts.where("mark = ''").first()
    if total is None or total["toxic"] == 0 or total["toxic"] == total["rows"]:
        counts.unpersist()
        return {}
    t, n, tested = total["toxic"], total["rows"], counts.count()
    base, rate = t / n, F.col("toxic") / F.col("rows")
    entropy = rate * F.log(rate / base) + F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - base))).otherwise(0.0)
    strong = (counts.where((F.col("mark") != "") & (rate > base) & (F.col("rows") * entropy >= math.log(tested / alpha)))
              .withColumn("odds", F.log((F.col("toxic") + 0.5) / (t + 1)) - F.log((F.col("rows") - F.col("toxic") + 0.5) / (n - t + 1)))
              .where("odds >= 1.5").orderBy(F.desc("odds"), "mark").limit(max_marks))
    out = {r["mark"]: r["odds"] for r in strong.collect()}
    counts.unpersist()
    return out


def evidence(found: set[str], odds: dict[str, float], share: float = 0.25, fade: float = 0.875) -> float:
    """The strongest mark of a text, and a ``share`` of each further one, less by ``fade`` from one to the next:
    every mark counts, all further ones together at most ``share / (1 - fade)`` times the second."""
    ranked = sorted((odds[m] for m in found & odds.keys()), reverse=True)
    return ranked[0] + share * sum(x * fade ** i for i, x in enumerate(ranked[1:])) if ranked else 0.0


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Logistic curve (slope, level) of the evidence; a flat one at the toxic share for one class only."""
    if not len(y) or y.min() == y.max():
        return 0.0, -3.0
    a, b = 0.0, math.log(y.mean() / (1 - y.mean()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * x * x).mean() + ridge / 10, (q * x).mean()], [(q * x).mean(), q.mean() + ridge / 100]])
        step = np.linalg.solve(h, [((y - p) * x).mean() - ridge / 10 * a, (y - p).mean() - ridge / 100 * b])
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", folds: int = 3, held: int = 1, accept: float = 0.7,
                    sample_rows: int = 20_000) -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (score >= accept).

    Learns labels from labelled rows whose crc32(id as text) mod ``folds`` is not ``held``, a bounded
    sample of about ``sample_rows`` (equal texts once). Null text: scored as empty. Null labels and
    ids are not learned from; a null id is not held out. Repeated rows are scored each. With no toxic
    rows to learn from, no row is predicted toxic."""
    spark = docs.sparkSession
    model = character_model(count_characters(docs, text_col))
    known = labels.where(F.col(label_col).isNotNull() & (id_bucket(F.col(id_col), folds) != held)).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    n = known.count()
    cut = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1 << 30)) < F.lit(-(-sample_rows * (1 << 30) // max(1, n)))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    sample = known.where(cut).join(texts, "_id").dropDuplicates(["_text", "_y"]).select("_text", "_y").persist()
    restorer = Restorer(model)
    odds = learn_marks(sample, restorer)
    shared = spark.sparkContext.broadcast((model, odds))

    @F.arrow_udf("double")
    def found(part: pa.Array) -> pa.Array:
        model, odds = shared.value
        r = Restorer(model)
        return pa.array([evidence(r.marks(t or ""), odds) for t in part.to_pylist()], type=pa.float64())

    learned = sample.select(found("_text").alias("x"), "_y").toArrow()
    sample.unpersist()
    x, y = (np.asarray(learned.column(c).to_numpy(zero_copy_only=False), dtype=float) for c in ("x", "_y"))
    order = np.lexsort((x, y))
    slope, level = fit_curve(x[order], y[order])
    z = F.col("evidence") * slope + level
    return (docs.select(F.col(id_col).alias("doc_id"),
                        F.coalesce(id_bucket(F.col(id_col), folds) == held, F.lit(False)).alias("held_out"),
                        found(F.col(text_col).cast("string")).alias("evidence"))
            .select("doc_id", "held_out", (1 / (1 + F.exp(-z))).alias("score"))
            .withColumn("predicted", (F.col("score") >= accept).cast("int")))
