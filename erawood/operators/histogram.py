"""Gradient histograms by (node, feature, era, bin), and their prefix sums.

The packed form has a row for each (node, feature, era) whose ``cells`` are the counts and the
gradient sums of all bins, as little-endian doubles: one row where the plain form has as many as
there are bins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ("node_id", "feature", "era", "bin")
#: Cells that a task holds before it sends them on, and values that it bins at a time. Some forty bytes
#: a value are held meanwhile, so that a worker's memory is the same at every size of a task.
DENSE_CELLS = 1 << 22
_VALUES = 1 << 19
PACKED = "node_id int, feature int, era int, cells binary"


def histogram(rows: DataFrame, features: list[int] | None = None, max_bins: int | None = None) -> DataFrame:
    """From ``(node_id, era, bins, grad)``: ``(node_id, feature, era, bin, cnt, g)``, in column expressions.

    Only the wanted features are exploded. Bins from ``max_bins`` on are left out.
    """
    cells = F.transform("bins", lambda b, f: F.struct(f.alias("feature"), b.cast("int").alias("bin")))
    if features is not None:
        held = F.array(*[F.lit(f) for f in features])
        cells = F.transform(held, lambda f: F.struct(f.alias("feature"), F.get("bins", f).cast("int").alias("bin")))
    long = rows.select("node_id", "era", "grad", F.explode(cells).alias("c")).select("node_id", "c.feature", "era", "c.bin", "grad")
    if max_bins is not None:
        long = long.where(F.col("bin") < max_bins)
    return long.groupBy(*KEYS).agg(F.count("*").alias("cnt"), F.sum("grad").alias("g"))


def packed_batch(node: np.ndarray, feature: np.ndarray, era: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
    """A batch of the packed form from the cells as a matrix."""
    size = cells.shape[1] * 8
    offsets = np.arange(len(cells) + 1, dtype=np.int32) * size
    blobs = pa.BinaryArray.from_buffers(pa.binary(), len(cells), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(cells, "<f8"))])
    return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in (node, feature, era)), blobs], ["node_id", "feature", "era", "cells"])


def unpacked(column: pa.Array, max_bins: int) -> np.ndarray:
    """The cells of a batch as a matrix: counts, then gradient sums."""
    _, offsets, data = column.buffers()
    start = np.frombuffer(offsets, np.int32, 1, 4 * column.offset)[0] if len(column) else 0
    return np.frombuffer(data, "<f8", len(column) * 2 * max_bins, start).reshape(-1, 2 * max_bins) if len(column) else np.zeros((0, 2 * max_bins))


def _of_rows(batches, wanted: np.ndarray, max_bins: int):
    """Packed cells of the rows of one task."""
    held: dict[tuple[int, int], np.ndarray] = {}
    most = max(1, DENSE_CELLS // max(1, len(wanted) * max_bins))

    def sent():
        for (node, era), cells in held.items():
            some = np.flatnonzero(cells[:, :max_bins].any(1))
            yield packed_batch(np.full(len(some), node), wanted[some], np.full(len(some), era), cells[some])
        held.clear()

    for node, era, grad, bins in _chunks(batches, wanted, max_bins):
        low = int(era.min())
        span = int(era.max()) - low + 1
        groups, which = np.unique(node * span + (era - low), return_inverse=True)
        n, size = len(wanted), len(wanted) * max_bins
        for lo in range(0, len(groups), most):
            at = np.flatnonzero((which >= lo) & (which < lo + most)) if len(groups) > most else slice(None)
            here = min(most, len(groups) - lo)
            key = bins[at] + np.arange(n) * max_bins + (which[at] - lo)[:, None] * size
            weight = np.repeat(grad[at], n)
            flat = key.ravel()
            if (bins[at] < 0).any():  # bins that don't count
                ok = (bins[at] >= 0).ravel()
                flat, weight = flat[ok], weight[ok]
            counts, sums = (np.bincount(flat, x, here * size).reshape(here, n, max_bins) for x in (None, weight))
            for i in range(here):
                k = (int(groups[lo + i]) // span, int(groups[lo + i]) % span + low)
                if k not in held:
                    held[k] = np.zeros((n, 2 * max_bins))
                held[k][:, :max_bins] += counts[i]
                held[k][:, max_bins:] += sums[i]
            if len(held) >= most:
                yield from sent()
    yield from sent()


def _chunks(batches, wanted: np.ndarray, max_bins: int):
    """Node, era, gradient and wanted bins (-1 for those that don't count) of ``_VALUES`` values at most, or of one row.

    Of a batch only what is wanted is kept.
    """
    most = max(1, _VALUES // max(1, len(wanted)))
    rows: list[tuple[np.ndarray, ...]] = []

    def taken(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        column = batch.column("bins")
        bins = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)[:, wanted]
        return (*(np.array(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("node_id", "era", "grad")), bins)

    def joined():
        node, era, grad, bins = (np.concatenate(x) for x in zip(*rows))
        rows.clear()
        bins = bins.astype(np.int64)
        bins[(bins < 0) | (bins >= max_bins)] = -1
        return node.astype(np.int64), era.astype(np.int64), grad, bins

    n = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            some = batch.slice(at, most - n)
            rows.append(taken(some))
            n += some.num_rows
            at += some.num_rows
            if n == most:
                yield joined()
                n = 0
    if rows:
        yield joined()


def _summed(batches, max_bins: int):
    """Sums the cells of rows that are sorted by node, feature and era; the last key may go on in the next batch."""
    held: tuple[np.ndarray, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
        cells = unpacked(batch.column("cells"), max_bins)
        if held is not None:
            keys, cells = np.concatenate([held[0], keys]), np.concatenate([held[1], cells])
        heads = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1])
        sums = np.add.reduceat(cells, heads)
        keys = keys[heads]
        held = (keys[-1:], sums[-1:])
        if len(keys) > 1:
            yield packed_batch(*keys[:-1].T, sums[:-1])
    if held is not None:
        yield packed_batch(*held[0].T, held[1])


def histogram_packed(rows: DataFrame, features: list[int], max_bins: int) -> DataFrame:
    """The histogram of ``(node_id, era, bins, grad)`` in packed form, with numpy.

    Tasks add up their rows; what they send is dealt by node, feature and era, sorted and added up
    as it comes, so that no task holds all cells of a feature.
    """
    wanted = np.array(features, np.int64)
    parts = rows.select("node_id", "era", "bins", "grad").mapInArrow(lambda x: _of_rows(x, wanted, max_bins), PACKED)
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.repartition(width, "node_id", "feature", "era").sortWithinPartitions("node_id", "feature", "era")
    return dealt.mapInArrow(lambda x: _summed(x, max_bins), PACKED)


def histogram_arrow(rows: DataFrame, features: list[int], max_bins: int) -> DataFrame:
    """The same histogram as ``histogram``, by way of the packed form."""

    def plain(batches):
        for batch in batches:
            cells = unpacked(batch.column("cells"), max_bins)
            i, b = np.nonzero(cells[:, :max_bins])
            node, feature, era = (batch.column(c).to_numpy()[i] for c in range(3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node), pa.array(feature), pa.array(era), pa.array(b.astype(np.int32)), pa.array(cells[i, b].astype(np.int64)), pa.array(cells[i, b + max_bins])],
                [*KEYS, "cnt", "g"],
            )

    return histogram_packed(rows, features, max_bins).mapInArrow(plain, "node_id int, feature int, era int, bin int, cnt long, g double")


def densified(hist: DataFrame, max_bins: int) -> DataFrame:
    """The histogram with its empty bins as zeros."""
    grid = hist.select("node_id", "feature", "era").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(max_bins - 1))))
    zero = {"cnt": F.coalesce("cnt", F.lit(0).cast("long")), "g": F.coalesce("g", F.lit(0.0))}
    return grid.join(hist, list(KEYS), "left").withColumns(zero)


def prefix_sums(hist: DataFrame, max_bins: int) -> DataFrame:
    """Rows ``(node_id, feature, era, thr, lc, lg, tc, tg)``: what lies in bins up to ``thr``, and in all."""
    of = Window.partitionBy("node_id", "feature", "era")
    run = of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    out = densified(hist, max_bins).select(
        "node_id", "feature", "era", F.col("bin").alias("thr"),
        F.sum("cnt").over(run).alias("lc"), F.sum("g").over(run).alias("lg"), F.sum("cnt").over(of).alias("tc"), F.sum("g").over(of).alias("tg"),
    )
    return out.where(F.col("thr") < max_bins - 1)


def suffix_sums(hist: DataFrame, max_bins: int) -> DataFrame:
    """Counts and gradients of the bins above each threshold."""
    run = Window.partitionBy("node_id", "feature", "era").orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    out = densified(hist, max_bins)
    return out.select("node_id", "feature", "era", F.col("bin").alias("thr"), F.coalesce(F.sum("cnt").over(run), F.lit(0).cast("long")).alias("rc"), F.coalesce(F.sum("g").over(run), F.lit(0.0)).alias("rg")).where(F.col("thr") < max_bins - 1)


def node_totals(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy("node_id", *by).agg(F.count("*").alias("n"), F.sum("grad").alias("g"))
