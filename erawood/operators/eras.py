"""Eras: encoding, buckets, weights, and splits of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from erawood.scratch import scratch_path, written


def distinct_eras(df: DataFrame, era: str = "era") -> DataFrame:
    """Each era with its dense code from 0. Only the distinct eras are ordered, not the rows."""
    return df.select(era).where(F.col(era).isNotNull()).distinct().select(era, (F.row_number().over(Window.orderBy(era)) - 1).alias("era_code"))


def encode_eras(df: DataFrame, era: str = "era") -> DataFrame:
    """``df`` with ``era_code``."""
    return df.join(distinct_eras(df, era), era, "left")


def bucket_eras(df: DataFrame, size: int, era: str = "era", out: str = "era_bucket") -> DataFrame:
    """(era - smallest) // size; the era itself if size is at most 1."""
    if size <= 1:
        return df.withColumn(out, F.col(era).cast("int"))
    least = df.agg(F.min(era).alias("__least"))
    return df.crossJoin(F.broadcast(least)).withColumn(out, F.floor((F.col(era) - F.col("__least")) / size).cast("int")).drop("__least")


def floor_eras(era: Column, size: int) -> Column:
    return F.floor(era / size).cast("int")


def single_era(df: DataFrame, out: str = "era") -> DataFrame:
    return df.withColumn(out, F.lit(0))


def era_index(df: DataFrame, row: str, era: str = "era") -> DataFrame:
    """The sorted rows of each era. Meant for small tables: an era's rows become one array."""
    return df.groupBy(era).agg(F.array_sort(F.collect_list(row)).alias("rows"))


def era_weight(count: Column, alpha: float) -> Column:
    return F.when(count > 0, count + F.lit(float(alpha)) if alpha > 0 else F.lit(1.0)).otherwise(F.lit(0.0))


def holdout_eras(df: DataFrame, holdout: int | None = None, fraction: float | None = None, era: str = "era") -> DataFrame:
    """The last eras, as one column: ``holdout`` of them but at least one stays, or a fraction."""
    eras = distinct_eras(df, era)
    n = F.max("era_code").over(Window.partitionBy()) + 1
    k = F.least(F.lit(holdout), F.greatest(F.lit(1), n - 1)) if holdout is not None else F.greatest(F.lit(1), F.bround(F.lit(float(fraction)) * n).cast("int"))
    return eras.withColumn("first", n - k).where(F.col("era_code") >= F.col("first")).select(era)


def temporal_holdout(df: DataFrame, holdout: int | None = None, fraction: float | None = None, era: str = "era") -> tuple[DataFrame, DataFrame]:
    """(train, test) by eras."""
    last = holdout_eras(df, holdout, fraction, era)
    return df.join(last, era, "left_anti"), df.join(last, era, "left_semi")


def row_holdout(df: DataFrame, fraction: float, order: list[str]) -> DataFrame:
    """``df`` with ``is_test``: the last part of the rows in the order given.

    The boundary is found by range partitioning and counts of the partitions, never in one task.
    """
    ranked = ranked_rows(df, order)
    n = df.count()
    k = max(1, int(round(fraction * n)))
    return ranked.withColumn("is_test", F.col("row_number") > n - k).drop("row_number")


def running_total(df: DataFrame, order: list[str], value: Column, out: str = "running") -> DataFrame:
    """``df`` with the sum of ``value`` over the rows up to each, in a total order.

    Rows are dealt by range and stored, as their bounds would differ when computed again; sums go up
    inside each range, and those of the ranges before are added. One row a range reaches the driver.
    """
    spark = df.sparkSession
    ranges = df.withColumn("__value", value.cast("long")).repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    parts = written(ranges, scratch_path(spark, "ranges"))
    rows, total = [], 0
    for p, n in sorted((r[0], r[1]) for r in parts.groupBy("__part").agg(F.sum("__value")).collect()):
        rows.append((p, total))
        total += n
    offsets = spark.createDataFrame(rows, "__part int, __before long")
    upto = F.sum("__value").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn(out, upto).join(F.broadcast(offsets), "__part").withColumn(out, F.col("__before") + F.col(out)).drop("__part", "__value", "__before")


def ranked_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``row_number`` from 1 in a total order, never in one task."""
    return running_total(df, order, F.lit(1), "row_number")


def count_eras(df: DataFrame, era: str = "era") -> int:
    """How many distinct eras there are; null is none."""
    return df.agg(F.count_distinct(era)).first()[0]


def cv_folds(df: DataFrame, n_splits: int, embargo: int = 0, era: str = "era") -> DataFrame:
    """Rows ``(fold, era, role)`` of an expanding split; the last ``embargo`` train eras go."""
    eras = distinct_eras(df, era).withColumn("n", F.max("era_code").over(Window.partitionBy()) + 1)
    size = F.floor(F.col("n") / (n_splits + 1))
    folds = eras.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    start = F.col("n") - (n_splits - F.col("fold")) * size
    role = F.when((F.col("era_code") >= start) & (F.col("era_code") < start + size), "test").when(F.col("era_code") < start - embargo, "train")
    return folds.withColumn("role", role).where("role is not null").select("fold", era, "role")


def last_dates(df: DataFrame, n: int, date: str, train: DataFrame | None = None) -> DataFrame:
    """Rows of the last ``n`` distinct dates, without dates that ``train`` has."""
    dates = distinct_eras(df, date)
    keep = dates.withColumn("last", F.max("era_code").over(Window.partitionBy())).where(F.col("era_code") > F.col("last") - n).select(date)
    out = df.join(keep, date, "left_semi")
    return out if train is None else out.join(train.select(date).distinct(), date, "left_anti")
