"""Quantile binning of feature columns.

Exact quantiles are found by radix selection over the bits of single-precision numbers: three scans
count the upper sixteen, the next eight and the last eight bits, the second and third only where a
wanted rank lies. What tasks send is bounded by features and quantiles, not by rows or by distinct
values, so it is the same at every size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from erawood.functions.columns import as_single, bin_of

#: Columns that one scan handles.
WIDTH = 64
#: Edges of all columns that are searched by compiled conditions; more would make methods that the JVM doesn't compile.
COMPILED_EDGES = 64
_COUNTS = "at long, n long"


def sortable(x: np.ndarray) -> np.ndarray:
    """Single-precision numbers as unsigned integers of the same order; both zeros are equal."""
    bits = (x.astype(np.float32) + np.float32(0)).view(np.uint32)
    return np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))


def unsortable(key: np.ndarray) -> np.ndarray:
    key = key.astype(np.uint32)
    return np.where(key >> np.uint32(31), key ^ np.uint32(1 << 31), ~key).astype(np.uint32).view(np.float32)


def _counted(df: DataFrame, features: list[str], cells: int, place) -> np.ndarray:
    """A row for each column: how many of its values fall into each cell, and last how many are missing.

    ``place(column, keys)`` gives the cells of values, below zero for none.
    """
    wide = cells + 1

    def run(batches):
        total = np.zeros(len(features) * wide, np.int64)
        for batch in batches:
            for i in range(len(features)):
                x = batch.column(i).to_numpy(zero_copy_only=False).astype(np.float32)
                there = ~np.isnan(x)
                at = place(i, sortable(x[there]))
                total[i * wide : i * wide + cells] += np.bincount(at[at >= 0], minlength=cells)
                total[i * wide + cells] += len(x) - int(there.sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    columns = [F.col(c).cast("float").alias(f"c{i}") for i, c in enumerate(features)]
    rows = df.select(*columns).mapInArrow(run, _COUNTS).groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(features) * wide, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(-1, wide)


def order_statistics(df: DataFrame, features: list[str], ranks_of) -> list[tuple[int, int, dict[int, float]]]:
    """Of each column the number of values, of missing ones, and the values of wanted ranks from 0.

    ``ranks_of(n)`` names the ranks that are wanted of ``n`` values.
    """
    top = 1 << 16
    counts = _counted(df, features, top, lambda i, key: (key >> np.uint32(16)).astype(np.int64))
    held = []
    for dense in counts:
        n, missing = int(dense[:top].sum()), int(dense[top])
        ranks = np.array(sorted(ranks_of(n)) if n else [], np.int64)
        upto = np.cumsum(dense[:top])
        cell = np.searchsorted(upto, ranks, "right")
        held.append([n, missing, ranks, cell.astype(np.int64), ranks - np.where(cell, upto[cell - 1], 0)])
    for shift in (8, 0):  # the cells that hold a wanted rank, 256 parts of each
        prefixes = [np.unique(h[3]) for h in held]
        most = max((len(p) for p in prefixes), default=0)
        if not most:
            break

        def place(i, key, prefixes=prefixes, shift=shift):
            upper = (key >> np.uint32(shift + 8)).astype(np.int64)
            at = np.searchsorted(prefixes[i], upper)
            found = at < len(prefixes[i])
            found[found] = prefixes[i][at[found]] == upper[found]
            return np.where(found, at * 256 + ((key >> np.uint32(shift)) & np.uint32(255)).astype(np.int64), -1)

        counts = _counted(df, features, most * 256, place)
        for i, h in enumerate(held):
            upto = np.cumsum(counts[i, :-1].reshape(most, 256), 1)
            row = np.searchsorted(prefixes[i], h[3])
            part = np.array([np.searchsorted(upto[r], k, "right") for r, k in zip(row, h[4])], np.int64)
            h[4] = h[4] - np.array([upto[r, p - 1] if p else 0 for r, p in zip(row, part)], np.int64)
            h[3] = h[3] * 256 + part
    return [(n, missing, dict(zip(ranks.tolist(), unsortable(key).astype(float).tolist()))) for n, missing, ranks, key, _ in held]


def _exact(df: DataFrame, features: list[str], cuts: list[float]) -> list[list[float]]:
    def ranks(n: int) -> set[int]:
        return {k for c in cuts for k in (int(c * (n - 1)), min(int(c * (n - 1)) + 1, n - 1))}

    out = []
    for n, missing, values in order_statistics(df, features, ranks):
        if missing or not n:
            out.append([float("nan") if missing else 0.0] * len(cuts))
            continue
        edges = []
        for c in cuts:
            at = c * (n - 1)
            lo, hi = int(at), min(int(at) + 1, n - 1)
            low, high = values[lo], values[hi]
            edges.append(low if low == high or at == lo else (hi - at) * low + (at - lo) * high)
        out.append(np.array(edges).astype(np.float32).astype(float).tolist())
    return out


def _sketched(df: DataFrame, features: list[str], cuts: list[float], accuracy: int) -> list[list[float]]:
    points = F.array(*[F.lit(c) for c in cuts])
    wanted = [F.percentile_approx(as_single(F.col(c)), points, accuracy).cast("array<float>").alias(f"q{i}") for i, c in enumerate(features)]
    missing = [F.max(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(f"n{i}") for i, c in enumerate(features)]
    row = df.agg(*wanted, *missing).first()
    return [[float("nan")] * len(cuts) if row[f"n{i}"] else row[f"q{i}"] or [0.0] * len(cuts) for i in range(len(features))]


def quantile_edges(df: DataFrame, features: list[str], max_bins: int, approximate: bool = False, accuracy: int = 10_000) -> list[list[float]]:
    """Inner edges of each feature at the linear quantiles i / max_bins, in single precision.

    ``approximate`` takes them from one scan by mergeable sketches. A column with a missing value,
    null or NaN, has NaN edges, as a quantile of it is undefined: fill such columns first. Columns
    of an empty table have zeros.
    """
    cuts = [i / max_bins for i in range(1, max_bins)]
    out: list[list[float]] = []
    for lo in range(0, len(features), WIDTH):
        some = features[lo : lo + WIDTH]
        out += [[] for _ in some] if not cuts else _sketched(df, some, cuts, accuracy) if approximate else _exact(df, some, cuts)
    return out


def edge_table(df: DataFrame, features: list[str], max_bins: int) -> DataFrame:
    """Rows ``(feature, i, edge)`` of ``quantile_edges``."""
    rows = [(f, i, float(e)) for f, edges in enumerate(quantile_edges(df, features, max_bins)) for i, e in enumerate(edges)]
    return df.sparkSession.createDataFrame(rows, "feature int, i int, edge double")


def apply_bins(df: DataFrame, features: list[str], edges: list[list[float]], out: str = "bins") -> DataFrame:
    """``df`` with the bins of its features as an array of tinyint."""
    few = sum(map(len, edges)) <= COMPILED_EDGES
    return df.withColumn(out, F.array(*[bin_of(F.col(c), e, few) for c, e in zip(features, edges)]))


def is_prebinned(df: DataFrame, features: list[str], max_bins: int) -> bool:
    """Whether all features are integers within 0..max_bins-1."""
    if not all(isinstance(df.schema[c].dataType, IntegralType) for c in features) or not features:
        return False
    low, high = df.agg(F.least(F.lit(0), *[F.min(c) for c in features]), F.greatest(F.lit(0), *[F.max(c) for c in features])).first()
    return low >= 0 and high < max_bins and high <= 127


def preprocess(df: DataFrame, features: list[str], max_bins: int, prebinned: bool = False, approximate: bool = False) -> tuple[DataFrame, list[list[float]] | None]:
    """``df`` with ``bins``, and the edges; None if the features are bins already."""
    ready = is_prebinned(df, features, max_bins)
    if prebinned and not ready:
        raise ValueError("prebinned features must be integers within 0..max_bins-1")
    if ready:
        return df.withColumn("bins", F.array(*[F.col(c).cast("tinyint") for c in features])), None
    edges = quantile_edges(df, features, max_bins, approximate)
    return apply_bins(df, features, edges), edges


def bin_new(df: DataFrame, features: list[str], edges: list[list[float]] | None, max_bins: int) -> DataFrame:
    """Bins of new data by the edges of a fit."""
    if edges is not None:
        return apply_bins(df, features, edges)
    if not is_prebinned(df, features, max_bins):
        raise ValueError("the fit had bins as features; new data must have them too")
    return df.withColumn("bins", F.array(*[F.col(c).cast("tinyint") for c in features]))
