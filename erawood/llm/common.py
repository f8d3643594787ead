"""Helpers shared by the text operators: tables, shared scratch space, Arrow slices."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from erawood.scratch import discard, scratch_path, shared_dir, written

#: Bytes of text that one numpy step handles at a time.
CHUNK_BYTES = 4 << 20
#: Session switch that frees the shuffle files of a finished query.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession):
    """Within it, shuffle files go when the query that made them has ended."""
    try:
        before = spark.conf.get(_CLEANUP, None)
        spark.conf.set(_CLEANUP, "true")
    except Exception:  # a release without the switch
        yield
        return
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends there."""
    return stored_at(df, scratch_path(df.sparkSession, name))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    with freed_shuffles(df.sparkSession):
        return written(df, path, "zstd")


def free_names(columns: list[str], *names: str) -> list[str]:
    """``names``, changed where a column has them already (case does not matter to Spark)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def mapped(df: DataFrame, run, schema: StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for columns of any names, dots in them too."""
    own, made = df.columns, schema.fieldNames()
    places = [f"c{i}" for i in range(len(made))]

    def renamed(batches):
        for batch in run(pa.RecordBatch.from_arrays(b.columns, own) for b in batches):
            yield pa.RecordBatch.from_arrays(batch.columns, places)

    plain = StructType([StructField(c, f.dataType, f.nullable) for c, f in zip(places, schema.fields)])
    return df.toDF(*[f"c{i}" for i in range(len(own))]).mapInArrow(renamed, plain).toDF(*made)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for small tables in loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bits of a ``Members`` filter: 8 MB, whatever the input.
MEMBER_BITS = 1 << 26
_PLACES = 3


def _member_places(ids: np.ndarray) -> np.ndarray:
    """The bits of each id, a row for each of the filter's hash functions."""
    h = ids.astype(np.int64).view(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for k in range(_PLACES):
            x = (h + np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0x94D049BB133111EB)
            out.append((x >> np.uint64(38)).astype(np.int64))
    return np.stack(out)


class Members:
    """A filter of fixed size over long ids: it holds all ids it was made of, and few others.

    When it fills up more ids pass it, and none is lost. Tasks set its words, which are combined by
    partial aggregation, so that the words alone reach the driver.
    """

    def __init__(self, df: DataFrame, column: str):
        def words(batches):
            held = np.zeros(MEMBER_BITS // 64, np.uint64)
            for batch in batches:
                at = _member_places(batch.column(0).to_numpy(zero_copy_only=False)).ravel()
                np.bitwise_or.at(held, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
            at = np.flatnonzero(held)
            for lo in range(0, max(len(at), 1), 1 << 16):
                some = at[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[some].view(np.int64))], ["word", "bits"])

        ids = df.select(F.col(column).cast("long").alias("id")).where("id is not null")
        rows = ids.mapInArrow(words, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        held = np.zeros(MEMBER_BITS // 64, np.uint64)
        held[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
        self.shared = df.sparkSession.sparkContext.broadcast(held)

    def test(self, ids: pa.Array) -> np.ndarray:
        """Which ids it may hold; nulls it doesn't."""
        there = ids.is_valid().to_numpy(zero_copy_only=False)
        at = _member_places(ids.fill_null(0).to_numpy(zero_copy_only=False))
        return ((self.shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0) & there

    def maybe(self, column: Column) -> Column:
        """The same as a column. It takes a Python worker of its own, so it stands best where no other one is."""

        def test(ids: pa.Array) -> pa.Array:
            return pa.array(self.test(ids))

        return F.arrow_udf(test, "boolean")(column.cast("long"))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches, column: str = "text", limit: int = CHUNK_BYTES):
    """Cut record batches so that each slice holds about ``limit`` bytes of ``column``, one row at least.

    Workers serve other tasks afterwards, so in the end unused memory goes back to the system.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < n:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(n, max(end, at + 1))
            yield batch.slice(at, end - at)
            at = end
        del batch
    release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and its offsets (nulls are empty), without copying the texts."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(buffers[1], kind, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    if buffers[2] is None:
        return np.zeros(0, np.uint8), offsets * 0
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]
