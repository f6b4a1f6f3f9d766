"""Elements of an array column looked up in a table, block by block.

Looked up one by one, every element is shuffled twice: to the table and back to its row. A block is some rows
of one task, about ``BLOCK`` elements: its distinct elements once, and its rows as numbers of them, packed. Only
the distinct elements of the blocks meet the table (a frequent one once per block); what they find comes back to
the block, whose rows are unfolded where they are read.

Blocks are written once to the shared folder (``spark.checkpoint.dir``), since their parts have several readers.
A task holds an Arrow batch and a block at a time. Rows of a repeated key are found by the keys alone; only they
are folded element by element."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veerline.session import ensure_checkpoint_dir

BLOCK = 1 << 20            # elements of a block; a longer row is a block of its own

Batches = Iterator[pa.RecordBatch]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a fresh folder under the shared one."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/blocks/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _packed(codes: np.ndarray, n: int) -> bytes:
    """Codes below ``n`` in as few bytes as hold them, the first bytes of all codes before the second ones, compressed."""
    kind = np.min_scalar_type(max(n - 1, 0))
    planes = codes.astype(kind).view(np.uint8).reshape(len(codes), kind.itemsize).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int, n: int) -> np.ndarray:
    kind = np.min_scalar_type(max(n - 1, 0))
    planes = pa.decompress(data, decompressed_size=size * kind.itemsize, codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(kind.itemsize, size).T.copy().view(kind).ravel()


def _one(values: pa.Array) -> pa.ListArray:
    """One row that holds all ``values``."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packer(size: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            keys, lists = batch.columns
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            ends, at = np.cumsum(sizes, dtype=np.int64), 0
            while at < len(sizes):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
                coded = lists.slice(at, to - at).flatten().dictionary_encode(null_encoding="encode")
                n = len(coded.dictionary)
                codes = pa.array([_packed(coded.indices.to_numpy(), n)], pa.binary())
                yield pa.RecordBatch.from_arrays([_one(keys.slice(at, to - at)), _one(pa.array(sizes[at:to])), pa.array([n], pa.int32()),
                                                  codes, _one(coded.dictionary)], ["keys", "sizes", "n", "codes", "items"])
                at = to
            batch = keys = lists = coded = None                  # before the next batch comes
    return run


def _unpacker(repeated: bool | None) -> Callable[[Batches], Batches]:
    """Rows with what their elements found, all of them (None), or those that are ``again`` in other rows or not. The
    former come with the places of the elements."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                keys, found = (row.column(c).flatten() for c in ("keys", "found"))
                sizes, at = (row.column(c).flatten().to_numpy() for c in ("sizes", "at"))
                n, ends = row.column("n")[0].as_py(), np.cumsum(sizes, dtype=np.int64)
                codes = _unpacked(row.column("codes")[0].as_buffer(), int(sizes.sum()), n)
                places = np.arange(len(codes)) - np.repeat(ends - sizes, sizes) if repeated else None
                till = np.append(0, ends)
                if len(at) > n:                                  # some elements find several rows
                    many = np.bincount(at, minlength=n)
                    times = many[codes]
                    last = np.cumsum(times)
                    codes = np.repeat((np.cumsum(many) - many)[codes] - (last - times), times) + np.arange(times.sum())
                    places = np.repeat(places, times) if repeated else None
                    till = np.append(0, last)[till]
                offsets = pa.array(till, pa.int32())
                out = [keys, pa.ListArray.from_arrays(offsets, found.take(pa.array(codes)))]
                if repeated:
                    out.append(pa.ListArray.from_arrays(offsets, pa.array(places, pa.int32())))
                part = pa.RecordBatch.from_arrays(out, ["key", "found", "places"][:len(out)])
                if repeated is not None:
                    among = np.zeros(len(keys), bool)
                    among[row.column("again").flatten().to_numpy()] = True
                    part = part.filter(pa.array(among if repeated else ~among))
                yield part
    return run


def in_blocks(rows: DataFrame, key: str, items: str, size: int = BLOCK) -> DataFrame:
    """The rows' arrays as written blocks: (block, keys, sizes, n, codes, items), where ``items`` are the ``n`` distinct
    elements (null is one) and ``codes`` the rows' elements as numbers of them. A null array is an empty one."""
    rows = rows.select(key, items)
    of_keys, of_items = (f.dataType for f in rows.schema)
    schema = (T.StructType().add("keys", T.ArrayType(of_keys)).add("sizes", T.ArrayType(T.IntegerType())).add("n", T.IntegerType())
              .add("codes", T.BinaryType()).add("items", of_items))
    packed = rows.mapInArrow(_packer(size), schema)
    return written(packed.withColumn("block", F.monotonically_increasing_id()), "packed")


def look_up(blocks: DataFrame, key: str, table: DataFrame, on: str, value: Column, name: str) -> DataFrame:
    """(key, name): ``value`` of every element's rows in ``table`` (those with the element in ``on``), in the order of
    the elements. ``value`` is not null, also where no row matches.

    Rows of one key are one row: by place in their arrays, then by value."""
    met = blocks.select("block", F.posexplode("items").alias("i", on)).join(table, on, "left").select("block", "i", value.alias("v"))
    values = met.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("m"))
    kind = values.select(F.col("m.v")).schema[0].dataType
    whole = (blocks.drop("items").join(values, "block", "left")
             .withColumns({"at": F.coalesce("m.i", F.array().cast("array<int>")), "found": F.coalesce("m.v", F.array().cast(kind))}).drop("m"))
    places = blocks.select("block", F.posexplode("keys").alias("r", "key"))
    schema = T.StructType().add("key", blocks.schema["keys"].dataType.elementType).add("found", kind)
    repeated = places.groupBy("key").count().where("count > 1").select(F.col("key").alias("k"))
    if repeated.isEmpty():
        return whole.mapInArrow(_unpacker(None), schema).select(F.col("key").alias(key), F.col("found").alias(name))
    again = places.join(repeated, F.col("key").eqNullSafe(F.col("k"))).groupBy("block").agg(F.collect_list("r").alias("again"))
    marked = whole.join(again, "block", "left").withColumn("again", F.coalesce("again", F.array().cast("array<int>")))
    once = marked.mapInArrow(_unpacker(False), schema)
    several = marked.where(F.size("again") > 0).mapInArrow(_unpacker(True), T.StructType([*schema, T.StructField("places", T.ArrayType(T.IntegerType()))]))
    item = F.when(F.col("c").isNotNull(), F.struct("c.places", "c.found"))
    folded = several.select("key", F.explode_outer(F.arrays_zip("places", "found")).alias("c")).groupBy("key").agg(
        F.transform(F.sort_array(F.collect_list(item)), lambda x: x["found"]).alias("found"))
    return once.unionByName(folded).select(F.col("key").alias(key), F.col("found").alias(name))
