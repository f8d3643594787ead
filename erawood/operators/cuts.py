"""Candidate thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _away(x: float) -> int:
    return int(x + 0.5)


def even_cuts(max_bins: int, k: int) -> list[int]:
    """Up to ``k`` thresholds evenly over 0..max_bins-2, halves away from zero; all if k asks for it."""
    top = max_bins - 2
    if top < 0:
        return []
    if k <= 0 or k >= max_bins - 1:
        return list(range(top + 1))
    if k == 1:
        return [0]
    return sorted({_away(top * i / (k - 1)) for i in range(k)})


def mass_cuts_of(counts: list[int], k: int) -> list[int]:
    """Thresholds that part the counts of one feature's bins into about equal masses.

    Short lists are completed by even cuts; the first ``k`` stay.
    """
    max_bins, total = len(counts), sum(counts)
    if k <= 0 or k >= max_bins - 1:
        return list(range(max_bins - 1))
    if k == 1 or not total:
        return even_cuts(max_bins, k)
    found, upto, i = set(), 0, 0
    for b, n in enumerate(counts):
        upto += n
        while i < k and upto >= total * (1 - 1e-12) * i / (k - 1):
            found.add(min(max(b - 1, 0), max_bins - 2))
            i += 1
    if len(found) < k:
        found |= set(even_cuts(max_bins, k))
    return sorted(found)[:k]


def mass_cuts(hist: DataFrame, max_bins: int, k: int) -> dict[int, list[int]]:
    """Thresholds by feature, from counts pooled over nodes and eras; features x bins reach the driver."""
    rows = hist.groupBy("feature", "bin").agg(F.sum("cnt").alias("n")).collect()
    counts: dict[int, list[int]] = {}
    for r in rows:
        counts.setdefault(r["feature"], [0] * max_bins)[r["bin"]] = r["n"]
    return {f: mass_cuts_of(c, k) for f, c in counts.items()}


def mass_cut_table(hist: DataFrame, max_bins: int, k: int) -> DataFrame:
    """``(feature, thr)``: the thresholds of the targets alone, in column expressions."""
    pooled = hist.groupBy("feature", "bin").agg(F.sum("cnt").alias("n"))
    w = Window.partitionBy("feature")
    cdf = pooled.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    goals = cdf.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    hit = goals.where(F.col("upto") >= F.col("total") * (1 - 1e-12) * F.col("i") / (k - 1)).groupBy("feature", "i").agg(F.min("bin").alias("bin"))
    return hit.select("feature", F.least(F.greatest(F.col("bin") - 1, F.lit(0)), F.lit(max_bins - 2)).alias("thr")).distinct()


# The least median of node sizes of a tier, and the most cuts that it tries.
TIERS = ((100_000, None), (20_000, 15), (0, 7))


def adaptive_k(node_rows: list[int], depth: int, k: int, all_cuts: int, decay: float = 1.0) -> int:
    """How many cuts a depth tries: fewer for small nodes, and for deep ones with a ``decay`` below 1.

    The lower median of the nodes' sizes decides the tier. All cuts if ``k`` is 0, one if there is
    no node. The last tier tries three at least, if ``k`` allows them.
    """
    if k == 0:
        return all_cuts
    if not node_rows:
        return min(1, all_cuts)
    middle = sorted(node_rows)[(len(node_rows) - 1) // 2]
    most = next(cap for least, cap in TIERS if middle >= least)
    some = k if most is None else min(k, most)
    if decay != 1.0 and depth:
        some = round(some * decay**depth)
    return max(1, min(some, all_cuts))
