"""Era-wise and return-based metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erawood.functions.columns import correlation, signal
from erawood.operators.eras import last_dates, running_total

TRADING_DAYS = 252


def era_correlations(df: DataFrame, y: str, p: str, era: str = "era") -> DataFrame:
    """``(era, corr)``; null where an era has under two rows or no spread."""
    return df.groupBy(era).agg(correlation(F.col(y).cast("double"), F.col(p).cast("double")).alias("corr"))


def mean_era_correlation(df: DataFrame, y: str, p: str, era: str = "era") -> float:
    got = era_correlations(df, y, p, era).agg(F.avg("corr")).first()[0]
    return float("nan") if got is None else got


def era_metrics(df: DataFrame, y: str, p: str, era: str = "era") -> DataFrame:
    """One row: mean of the eras' correlations, and mean over population std (null for one era)."""
    c = era_correlations(df, y, p, era)
    sd = F.stddev_pop("corr")
    return c.agg(F.avg("corr").alias("mean_corr"), F.when((F.count("corr") > 1) & (sd > 0), F.avg("corr") / sd).alias("corr_sharpe"), F.count("corr").alias("n_eras"))


def annual_sharpe(x: Column) -> Column:
    sd = F.stddev_pop(x)
    return F.when((F.count(x) >= 2) & (sd > 0), F.sqrt(F.lit(float(TRADING_DAYS))) * F.avg(x) / sd)


def penalised_sharpe(df: DataFrame, position: str, forward: str, risk_free: str) -> DataFrame:
    """One row with the Sharpe ratio after penalties for volatility and for a shortfall of return.

    Raises if a position is missing, not finite or outside [0, 2].
    """
    bad = df.where(F.col(position).isNull() | F.isnan(position) | (F.col(position) < 0) | (F.col(position) > 2)).limit(1).count()
    if bad:
        raise ValueError("positions must lie in [0, 2]")
    rf, fr, s = (F.col(c).cast("double") for c in (risk_free, forward, position))
    rows = df.select((rf * (1 - s) + s * fr).alias("r"), rf.alias("rf"), fr.alias("fr"))
    sums = rows.agg(
        F.count("*").alias("n"), F.sum(F.log1p(F.col("r") - F.col("rf"))).alias("ls"), F.sum(F.log1p(F.col("fr") - F.col("rf"))).alias("lm"),
        F.stddev_samp("r").alias("sd"), F.stddev_samp("fr").alias("msd"),
    )
    year = float(TRADING_DAYS)
    mean, market = F.expm1(F.col("ls") / F.col("n")), F.expm1(F.col("lm") / F.col("n"))
    vol, mvol = F.col("sd") * year**0.5 * 100, F.col("msd") * year**0.5 * 100
    excess = F.greatest(F.lit(0.0), F.try_divide(vol, mvol) - 1.2)
    gap = F.greatest(F.lit(0.0), (market - mean) * 100 * year)
    score = F.try_divide(mean * year**0.5, F.col("sd")) / (1 + excess) / (1 + gap * gap / 100)
    usable = (F.col("n") > 1) & (F.col("sd") > 0) & (F.col("msd") > 0)
    return sums.select(F.when(usable, F.least(score, F.lit(1e6))).otherwise(F.lit(0.0)).alias("score"))


def r2(df: DataFrame, y: str, p: str) -> DataFrame:
    yy, pp = F.col(y).cast("double"), F.col(p).cast("double")
    return df.agg((1 - F.try_divide(F.sum((yy - pp) * (yy - pp)), F.var_pop(yy) * F.count(yy))).alias("r2"))


def mse(df: DataFrame, y: str, p: str) -> DataFrame:
    d = F.col(y).cast("double") - F.col(p).cast("double")
    return df.agg(F.avg(d * d).alias("mse"), F.var_pop(F.col(y).cast("double")).alias("variance"))


def rank_pct(df: DataFrame, x: str, out: str = "rank_pct") -> DataFrame:
    """Percentile rank with average ties, from the counts of distinct values, dealt by range; null for null."""
    counts = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count("*").alias("__ties"))
    placed = running_total(counts, [x], F.col("__ties"), "__upto")
    n = df.where(F.col(x).isNotNull()).count()
    ranks = placed.select(x, ((F.col("__upto") - (F.col("__ties") - 1) / 2) / max(n, 1)).alias(out))
    return df.join(ranks, x, "left")


def held_out_scores(df: DataFrame, train: DataFrame, date: str, n: int, prediction: str, multiplier: float, forward: str = "forward_returns", risk_free: str = "risk_free_rate") -> DataFrame:
    """One row of the last ``n`` dates without those of ``train``: Sharpe ratio of the positions'
    excess returns, and the penalised Sharpe ratio; both null if no row is left."""
    rows = last_dates(df, n, date, train).withColumn("__position", signal(F.col(prediction), multiplier))
    excess = F.col("__position") * (F.col(forward) - F.col(risk_free))
    plain = rows.agg(F.count("*").alias("n_rows"), annual_sharpe(excess).alias("last_n_sharpe"))
    hull = penalised_sharpe(rows, "__position", forward, risk_free)
    return plain.crossJoin(hull).select("n_rows", "last_n_sharpe", F.when(F.col("n_rows") > 0, F.col("score")).alias("penalised_sharpe"))
