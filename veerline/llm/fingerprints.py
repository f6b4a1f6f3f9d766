"""Document fingerprints: threshold-scaled sketches of word shingles.

Every shingle of ``shingle_words`` words (lower case) is hashed to 64 bits; the sketch keeps the
distinct hashes below ``1 / scale`` of the hash range, so it grows with the document and the sketch
of a union is the union of the sketches. Shares of common hashes estimate containment and Jaccard
likeness even between a paragraph and a book. A document whose hashes all lie above the threshold
keeps its smallest one (merging keeps the rule: drop a hash above the threshold unless it is the
only one), a text with fewer words than a shingle has one shingle, one without words none.

All built-in column expressions: no Python in the plan. Scale: hashes come from the words' hashes,
without building shingle strings, in one pass over the text. Pairing each document with its
neighbour in id order needs no global sort: ids are cut into ranges at sampled ids, each range is
a window of its own, and the first row of a range is copied into the range before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veerline.llm.common import let, plain

SHINGLE_WORDS, SCALE = 5, 4
BLANKS = " \t\n\x0b\x0c\r"


def sketch(text: Column, shingle_words: int = SHINGLE_WORDS, scale: int = SCALE) -> Column:
    """Sorted array of the kept hashes (signed 64-bit integers) of a non-null text."""
    words = F.split(F.trim(F.lower(text), F.lit(BLANKS)), r"[\x20\x09-\x0D]+")
    hashes = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        return (F.when(n == 0, F.array().cast("array<bigint>"))
                .when(n <= shingle_words, F.array(F.aggregate(h, F.lit(0).cast("bigint"), lambda a, x: F.xxhash64(a, x))))
                .otherwise(F.transform(F.sequence(F.lit(0), n - shingle_words),
                                       lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(shingle_words)]))))

    def kept(s: Column) -> Column:
        low = F.filter(s, lambda x: x <= F.lit(-(2 ** 63) + 2 ** 64 // scale - 1))
        return let(F.array_sort(F.array_distinct(low)),
                   lambda k: F.when((F.size(k) == 0) & (F.size(s) > 0), F.array(F.array_min(s))).otherwise(k))

    return let(hashes, lambda h: let(shingles(h), kept))


def jaccard(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two sketches; two empty ones are alike (1), an empty and another not (0)."""
    both = F.size(F.array_intersect(a, b))
    return let(both, lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0))
               .otherwise(n / (F.size(a) + F.size(b) - n)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; an empty sketch is contained in any."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Sketch of the union of two documents' shingles."""
    return let(F.array_sort(F.array_union(a, b)),
               lambda u: let(F.filter(u, lambda x: x <= F.lit(-(2 ** 63) + 2 ** 64 // scale - 1)),
                             lambda k: F.when(F.size(k) == 0, F.slice(u, 1, 1)).otherwise(k)))


def printed(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), " ")


def with_next(rows: DataFrame, columns: dict[str, Callable[[Column], Column]], rows_per_range: int = 2_000,
              max_ranges: int = 4096) -> DataFrame:
    """(doc_id, text) rows with ``columns`` (of the text), and ``next_text`` and ``next_<column>`` of the
    next row in descending id order (after the last row: the first).

    Rows that tie in id are ordered by their text; null ids come last. Ids are of any type that has an order. At most
    ``max_ranges`` cut ids (and some 20 sampled ids for each) pass the driver; a range is sorted with spilling, never collected."""
    n, top = rows.agg(F.count(F.lit(1)), F.max("doc_id")).first()
    ranges = max(1, min(max_ranges, -(-n // rows_per_range)))
    cuts = [] if top is None else [top]
    kind = rows.schema["doc_id"].dataType
    if ranges > 1 and top is not None and isinstance(kind, T.NumericType):
        at = [k / ranges for k in range(1, ranges)]
        cuts = sorted({top, *rows.agg(F.percentile_approx("doc_id", at, 20 * ranges)).first()[0]}, reverse=True)
    elif ranges > 1 and top is not None:      # ids without quantiles: even steps through about 20 ids a range, chosen by their hash
        one_of = F.lit(max(1, n // (20 * ranges)))
        some = rows.select("doc_id").where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), one_of) == 0)).distinct()
        ids = sorted(r["doc_id"] for r in some.collect())
        cuts = sorted({top, *ids[::max(1, len(ids) // ranges)]}, reverse=True)
    m = max(1, len(cuts))
    if cuts:
        ids = F.array(*[F.lit(c).cast(kind) for c in cuts])
        powers = F.array(*[F.lit(2 ** k) for k in reversed(range(m.bit_length()))])
        # how many cuts are at or above the id (binary search; cuts descend)
        above = F.aggregate(powers, F.lit(0), lambda a, p: F.when(
            (a + p <= m) & (F.get(ids, F.least(a + p, F.lit(m)) - 1) >= F.col("doc_id")), a + p).otherwise(a))
        own = F.when(F.col("doc_id").isNull(), F.lit(m - 1)).otherwise(above - 1)
        first = F.get(ids, F.col("_own")).eqNullSafe(F.col("doc_id"))
        places = F.when(first, F.array(F.struct(F.col("_own").alias("r"), F.lit(0).alias("g")),
                                       F.struct(F.pmod(F.col("_own") - 1, F.lit(m)).alias("r"), F.lit(1).alias("g"))))
        places = places.otherwise(F.array(F.struct(F.col("_own").alias("r"), F.lit(0).alias("g"))))
        rows = rows.withColumn("_own", own).select("doc_id", "text", F.explode(places).alias("_p"))
        rows = rows.select("doc_id", "text", F.col("_p.r").alias("_r"), F.col("_p.g").alias("_g"))
    else:
        rows = rows.select("doc_id", "text", F.lit(0).alias("_r"), F.lit(0).alias("_g"))
    rows = rows.repartition(F.col("_r")).select("*", *[make(F.col("text")).alias(c) for c, make in columns.items()])
    order = Window.partitionBy("_r").orderBy("_g", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    follow = [F.coalesce(F.lead(c).over(order), F.first(c).over(order)).alias(f"next_{c}") for c in ("text", *columns)]
    return rows.select("doc_id", "text", *columns, "_g", *follow).where("_g = 0").drop("_g")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          shingle_words: int = SHINGLE_WORDS, scale: int = SCALE) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next`` (Jaccard likeness to the edited text and
    to the next document), ``in_edited`` and ``in_next`` (containment of the document in them).

    The edited text has the last third of its code points replaced by the first as many of the next
    document in descending id order. Null text: empty. Repeated rows: one row each, neighbours of
    each other. A single row is its own neighbour. No rows: no rows."""
    make = lambda text: sketch(text, shingle_words, scale)
    rows = with_next(plain(docs, id_col, text_col), {"fp": make})
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.select("doc_id", "fp", "next_fp", n.cast("bigint").alias("n_chars"), edited.alias("edited"))
    rows = rows.select("doc_id", "fp", "next_fp", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       make(F.col("edited")).alias("efp"))
    fp, efp, nfp = F.col("fp"), F.col("efp"), F.col("next_fp")
    return rows.select("doc_id", "n_chars", "edited_sha256", printed(fp).alias("fingerprint"),
                       printed(efp).alias("edited_fingerprint"), jaccard(fp, efp).alias("near_edited"),
                       jaccard(fp, nfp).alias("near_next"), containment(fp, efp).alias("in_edited"),
                       containment(fp, nfp).alias("in_next"))
