"""Scoring of candidate splits across eras, and the choice of one for each node."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erawood.config import BoostConfig
from erawood.functions.columns import gain, newton
from erawood.operators.cuts import even_cuts, mass_cuts_of
from erawood.operators.eras import era_weight
from erawood.operators.histogram import unpacked

#: Digits of a score that count. Sums have no order, so equal scores come out a little apart; below
#: these digits they are ties, which larger left counts, features and thresholds decide.
DIGITS = 10


def era_gains(pre: DataFrame, config: BoostConfig) -> DataFrame:
    """``pre`` with ``valid``, ``gain``, ``direction`` and ``w``; the first three are null in eras with an empty side."""
    l2 = config.lambda_l2
    rc, rg = F.col("tc") - F.col("lc"), F.col("tg") - F.col("lg")
    valid = (F.col("lc") > 0) & (rc > 0)
    made = gain(F.col("lg"), F.col("lc"), l2) + gain(rg, rc, l2) - gain(F.col("tg"), F.col("tc"), l2)
    way = F.when(newton(F.col("lg"), F.col("lc"), l2) > newton(rg, rc, l2), 1.0).otherwise(-1.0)
    return pre.withColumns({"valid": valid, "gain": F.when(valid, made), "direction": F.when(valid, way), "w": era_weight(F.col("tc"), config.era_alpha)})


def scores(gains: DataFrame, config: BoostConfig) -> DataFrame:
    """``(node_id, feature, thr, mean, std, agreement, score, lc, lg, tc, tg)`` over the eras.

    Mean, spread and agreement are zero where no era is valid; such a candidate stays.
    """
    w = F.when(F.col("valid"), F.col("w"))
    mean = F.coalesce(F.try_divide(F.sum(w * F.col("gain")), F.sum(w)), F.lit(0.0))
    # The weighted variance from the moments about a value near the gains, so that it doesn't cancel.
    second = F.coalesce(F.try_divide(F.sum(w * F.col("gain") * F.col("gain")), F.sum(w)), F.lit(0.0))
    agree = F.coalesce(F.try_divide(F.sum(w * F.col("direction")), F.sum(w)), F.lit(0.0))
    out = gains.groupBy("node_id", "feature", "thr").agg(
        mean.alias("mean"), second.alias("second"), agree.alias("agreement"),
        F.sum("lc").alias("lc"), F.sum("lg").alias("lg"), F.sum("tc").alias("tc"), F.sum("tg").alias("tg"),
    )
    # a spread below the rounding error of the moments is no spread
    square = F.col("second") - F.col("mean") * F.col("mean")
    std = F.when(square > 1e-14 * F.col("second"), F.sqrt(square)).otherwise(F.lit(0.0))
    out = out.withColumn("std", std)
    score = F.col("mean") - config.lambda_dro * F.col("std") + config.direction_weight * F.col("agreement")
    return out.withColumn("score", F.round(score, DIGITS)).drop("second")


def best_splits(scored: DataFrame, config: BoostConfig) -> DataFrame:
    """The best eligible split of each node: by score, then left count, feature and threshold, all larger first."""
    m = config.min_samples_leaf
    fit = scored.where((F.col("lc") >= m) & (F.col("tc") - F.col("lc") >= m) & F.col("score").isNotNull() & ~F.isnan("score"))
    top = F.max(F.struct("score", "lc", "feature", "thr", "lg", "tc", "tg")).alias("b")
    return _decisions(fit.groupBy("node_id").agg(top), config)


def _decisions(tops: DataFrame, config: BoostConfig) -> DataFrame:
    out = tops.select("node_id", "b.*")
    rc, rg = F.col("tc") - F.col("lc"), F.col("tg") - F.col("lg")
    return out.select(
        "node_id", "feature", F.col("thr").alias("threshold"), "score",
        F.col("lg").alias("left_grad"), F.col("lc").cast("double").alias("left_hess"), rg.alias("right_grad"), rc.cast("double").alias("right_hess"),
        F.col("lc").alias("left_count"), rc.alias("right_count"),
        newton(F.col("lg"), F.col("lc"), config.lambda_l2).alias("left_value"), newton(rg, rc, config.lambda_l2).alias("right_value"),
    )


def score_feature(node: np.ndarray, era: np.ndarray, cells: np.ndarray, config: BoostConfig) -> list[tuple]:
    """Of one feature's packed cells, each node's best eligible (node, score, left count, thr, lg, tc, tg)."""
    b, l2 = config.max_bins, config.lambda_l2
    if b < 2 or not len(node):
        return []
    order = np.lexsort((era, node))
    node, cells = node[order], cells[order]
    n, s = cells[:, :b].astype(np.int64), cells[:, b:]
    cuts = even_cuts(b, config.k_cuts) if config.cut_selection == "even" else mass_cuts_of(n.sum(0).tolist(), config.k_cuts)
    tc, tg = n.sum(1)[:, None], s.sum(1)[:, None]
    lc, lg = np.cumsum(n, 1)[:, cuts], np.cumsum(s, 1)[:, cuts]
    rc, rg = tc - lc, tg - lg
    valid = (lc > 0) & (rc > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        left, right = lg / (lc + l2), rg / (rc + l2)
        made = 0.5 * (left * lg + right * rg - tg * tg / (tc + l2))
    weight = np.broadcast_to(tc + config.era_alpha if config.era_alpha > 0 else np.ones_like(tc, float), lc.shape)
    w = np.where(valid, weight, 0.0)
    made = np.where(valid, made, 0.0)
    way = np.where(valid, np.where(left < right, 1.0, -1.0), 0.0)  # values are the negatives
    heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    add = lambda x: np.add.reduceat(x, heads, axis=0)
    total = np.maximum(add(w), 1e-300)
    mean = add(w * made) / total
    place = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(node))))
    std = np.sqrt(add(w * (made - mean[place]) ** 2) / total)
    score = np.round(mean - config.lambda_dro * std + config.direction_weight * add(w * way) / total, DIGITS)
    lc, lg, tc, tg = add(lc), add(lg), add(tc)[:, 0], add(tg)[:, 0]
    m = config.min_samples_leaf
    ok = (lc >= m) & (tc[:, None] - lc >= m) & np.isfinite(score)
    out = []
    for i, v in enumerate(node[heads].tolist()):
        if ok[i].any():
            j = max(np.flatnonzero(ok[i]).tolist(), key=lambda j: (score[i, j], lc[i, j], cuts[j]))
            out.append((v, float(score[i, j]) + 0.0, int(lc[i, j]), cuts[j], float(lg[i, j]), int(tc[i]), float(tg[i])))
    return out


_TOPS = "node_id int, score double, lc long, feature int, thr int, lg double, tc long, tg double"


def best_splits_packed(hist: DataFrame, config: BoostConfig) -> DataFrame:
    """The decisions of a packed histogram, dealt by feature; a feature's rows are bounded by nodes x eras."""

    def run(key, t):
        cells = unpacked(t.column("cells").combine_chunks(), config.max_bins)
        found = score_feature(t.column("node_id").to_numpy(), t.column("era").to_numpy(), cells, config)
        rows = [(v, s, lc, key[0].as_py(), thr, lg, tc, tg) for v, s, lc, thr, lg, tc, tg in found]
        kinds = [pa.int32(), pa.float64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.float64()]
        columns = list(zip(*rows)) or [()] * 8
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in _TOPS.split(", ")])

    width = int(hist.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tops = hist.repartition(width, "feature").groupBy("feature").applyInArrow(run, _TOPS)
    return _decisions(tops.groupBy("node_id").agg(F.max(F.struct("score", "lc", "feature", "thr", "lg", "tc", "tg")).alias("b")), config)


def best_split_of(hist: DataFrame, node: int, config: BoostConfig) -> DataFrame:
    """The decision of one node: a row, or none."""
    return best_splits_packed(hist.where(F.col("node_id") == node), config)


def rescored(rows: DataFrame, decisions: DataFrame, config: BoostConfig) -> DataFrame:
    """``(node_id, score, recomputed)``: the score of each decision, taken again from its node's rows, by eras."""
    bin_of_split = F.get("bins", F.col("feature")).cast("int")
    at = rows.select("node_id", "era", "grad", "bins").join(F.broadcast(decisions.select("node_id", "feature", "threshold", "score")), "node_id")
    left = bin_of_split <= F.col("threshold")
    sides = at.groupBy("node_id", "era", "feature", F.col("threshold").alias("thr")).agg(
        F.count_if(left).alias("lc"), F.coalesce(F.sum(F.when(left, F.col("grad"))), F.lit(0.0)).alias("lg"), F.count("*").alias("tc"), F.sum("grad").alias("tg")
    )
    again = scores(era_gains(sides, config), config).select("node_id", F.col("score").alias("recomputed"))
    return decisions.select("node_id", "score").join(again, "node_id")
