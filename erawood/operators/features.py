"""Time-series features, filling, target derivation and feature filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window, WindowSpec

from erawood.functions.columns import finite
from erawood.operators.eras import ranked_rows

# Columns that are never features, and targets by preference.
META = (
    "date_id", "era", "row_id", "is_scored", "target", "forward_returns", "risk_free_rate", "market_forward_excess_returns",
    "lagged_forward_returns", "lagged_risk_free_rate", "lagged_market_forward_excess_returns",
)
TARGETS = ("target", "market_forward_excess_returns", "forward_returns")
#: Rows of one series that a task computes together; a window's look back must be shorter.
BLOCK_ROWS = 1 << 20


def ordered(date: str | list[str], by: list[str] | None = None):
    """The window of a series in date order; give ``by`` for more series than one.

    Without ``by`` it is one task's work: use ``over_series`` and ``fill_series`` for one long series.
    """
    dates = [date] if isinstance(date, str) else date
    return (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(*dates)


def inf_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in columns})


def lag1(x: Column, w) -> Column:
    return F.lag(x, 1).over(w)


def rolling_z(x: Column, w, window: int = 21, least: int = 5) -> Column:
    """(x - mean) / std (population) of the last rows; null below ``least`` values or without spread."""
    r = w.rowsBetween(1 - window, 0)
    sd = F.stddev_pop(x).over(r)
    return F.when((F.count(x).over(r) >= least) & (sd > 0), (x - F.avg(x).over(r)) / sd)


def momentum(x: Column, w, window: int = 63, least: int = 10) -> Column:
    r = w.rowsBetween(1 - window, 0)
    return F.when(F.count(x).over(r) >= least, x - F.avg(x).over(r))


def engineer(df: DataFrame, columns: list[str], date: str | list[str], by: list[str] | None = None, limit: int | None = None) -> tuple[DataFrame, list[str]]:
    """Lag, rolling z-score and momentum of columns over one window; the names, old and new."""
    w, made = ordered(date, by), {}
    for c in columns[:limit]:
        made |= {f"{c}_lag1": lag1(F.col(c), w), f"{c}_z21": rolling_z(F.col(c), w), f"{c}_mom63": momentum(F.col(c), w)}
    return df.withColumns(made), [*columns, *made]


def fill(x: Column, w, how: str) -> Column:
    """``ffill``, ``bfill`` or ``ffill_bfill`` of nulls along a window."""
    forward = F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    backward = F.first(x, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    if how == "ffill":
        return forward
    if how == "bfill":
        return backward
    if how == "ffill_bfill":
        return F.coalesce(forward, backward)
    raise ValueError(f"unknown fill {how!r}")


def _blocks(df: DataFrame, order: list[str], block: int) -> DataFrame:
    """``df`` with the place ``__at`` of each row in a total order, from 0, and its ``__block``."""
    at = F.col("row_number") - 1
    return ranked_rows(df, order).withColumn("__at", at).withColumn("__block", F.floor(at / block)).drop("row_number")


def over_series(df: DataFrame, make: Callable[[WindowSpec], dict[str, Column]], order: list[str], lookback: int, block: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with columns over one long series, computed in blocks of rows.

    ``make`` gives the columns for a window in order of the series; they may look back over
    ``lookback`` rows, which each block gets from the one before.
    """
    if not 0 <= lookback < block:
        raise ValueError("a block must be longer than the look back")
    own = df.columns
    rows = _blocks(df, order, block)
    late = F.col("__at") % block >= block - lookback
    homes = F.when(late, F.array("__block", F.col("__block") + 1)).otherwise(F.array("__block"))
    w = Window.partitionBy("__home").orderBy("__at")
    made = rows.withColumn("__home", F.explode(homes)).withColumns(make(w))
    return made.where("__home = __block").drop(*[c for c in ("__at", "__block", "__home") if c not in own])


def fill_series(df: DataFrame, column: str, how: str, order: list[str], out: str = "filled", block: int = BLOCK_ROWS) -> DataFrame:
    """``fill`` along one long series, in blocks: what a block lacks comes from the nearest one that has a value."""
    x = F.col(column)
    rows = _blocks(df, order, block)
    some = x.isNotNull()
    ends = rows.groupBy("__block").agg(F.max_by(F.when(some, x), F.when(some, F.col("__at"))).alias("__last"), F.min_by(F.when(some, x), F.when(some, F.col("__at"))).alias("__first"))
    w = Window.partitionBy().orderBy("__block")  # a row for each block
    near = ends.select(
        "__block",
        F.last("__last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
        F.first("__first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("__after"),
    )
    inside = Window.partitionBy("__block").orderBy("__at")
    forward = F.coalesce(fill(x, inside, "ffill"), F.col("__before"))
    backward = F.coalesce(fill(x, inside, "bfill"), F.col("__after"))
    if how not in ("ffill", "bfill", "ffill_bfill"):
        raise ValueError(f"unknown fill {how!r}")
    filled = {"ffill": forward, "bfill": backward, "ffill_bfill": F.coalesce(forward, backward)}[how]
    return rows.join(near, "__block").withColumn(out, filled).drop("__at", "__block", "__before", "__after")


def infer_columns(df: DataFrame, era: str | None = None, target: str | None = None, prefixes: list[str] | None = None) -> tuple[str, str, list[str]]:
    """Era, target and features of a table by names and types."""
    names = df.columns
    era = era or ("era" if "era" in names else "date_id" if "date_id" in names else None)
    if era is None or era not in names:
        raise ValueError("no era column")
    target = target or next((t for t in TARGETS if t in names), None)
    if target is None:
        raise ValueError("no target column")
    features = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in META and f.name not in (era, target)]
    if prefixes:
        features = [c for c in features if any(c.upper().startswith(p.upper()) for p in prefixes)]
    if not features:
        raise ValueError("no feature column")
    return era, target, features


def excess_target(df: DataFrame, out: str = "target") -> DataFrame:
    """forward_returns - risk_free_rate, unless the table has its target already."""
    return df if out in df.columns else df.withColumn(out, F.col("forward_returns") - F.col("risk_free_rate"))


def long_form(df: DataFrame, features: list[str], *keep: str) -> DataFrame:
    """Rows ``(*keep, feature, x)``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.feature", "p.x")


def directional_agreement(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """How often the sign of a centred feature is that of the target: ``(feature, agreement)``."""
    rows = long_form(df, features, target).where(F.col("x").isNotNull() & ~F.isnan("x"))
    centre = rows.groupBy("feature").agg(F.avg("x").alias("mean"))
    both = rows.where(F.col(target) != 0).join(F.broadcast(centre), "feature")
    same = F.when(F.signum(F.col("x") - F.col("mean")) == F.signum(F.col(target).cast("double")), 1.0).otherwise(0.0)
    return both.groupBy("feature").agg(F.avg(same).alias("agreement"))


def agreeing(df: DataFrame, features: list[str], target: str, threshold: float) -> list[str]:
    """Features that agree often enough; if none does, the 50 most correlated."""
    kept = {r["feature"] for r in directional_agreement(df, features, target).where(F.col("agreement") >= threshold).collect()}
    return [c for c in features if c in kept] or [r["feature"] for r in top_correlated(df, features, target).collect()]


def top_correlated(df: DataFrame, features: list[str], target: str, k: int = 50) -> DataFrame:
    """The ``k`` features of largest absolute correlation; ties by place. ``(feature, place, corr)``."""
    rows = long_form(df, features, target)
    y = F.col(target).cast("double")
    spread = F.stddev_pop("x") * F.stddev_pop(y)
    corr = F.coalesce(F.try_divide(F.covar_pop("x", y), spread), F.lit(0.0))
    place = F.element_at(F.create_map(*[x for i, c in enumerate(features) for x in (F.lit(c), F.lit(i))]), F.col("feature"))
    return rows.groupBy("feature").agg(corr.alias("corr")).withColumn("place", place).orderBy(F.desc(F.abs("corr")), "place").limit(k).select("feature", "place", "corr")
