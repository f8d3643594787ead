"""Sources and sinks."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header; without ``schema`` the types are inferred by an extra pass."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.select(*columns) if columns else df


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows in an order: a row cap is only defined with one."""
    return df.orderBy(*order).limit(n)


def read_feature_set(spark: SparkSession, path: str, name: str = "all") -> list[str]:
    """A feature list from a JSON file ``{"feature_sets": {name: [...]}}``."""
    text = spark.read.option("wholetext", True).text(path).first()[0]
    sets = json.loads(text)["feature_sets"]
    if name not in sets:
        raise ValueError(f"no feature set {name!r}")
    return sets[name]


def dataset_path(path: str) -> str:
    """A dataset that must be there already; nothing is downloaded."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    return path


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_log(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def result_table(df: DataFrame, columns: list[tuple[str, int, int | None]]) -> DataFrame:
    """``line``: the columns ``(name, width, digits)`` as text of fixed width; names stand left, n/a for null."""
    cells = []
    for name, width, digits in columns:
        text = F.col(name).cast("string") if digits is None else F.format_string(f"%.{digits}f", F.col(name).cast("double"))
        text = F.when(F.col(name).isNull(), F.lit("n/a")).otherwise(text)
        cells.append(F.rpad(text, width, " ") if digits is None else F.lpad(text, width, " "))
    return df.select(F.concat_ws(" ", *cells).alias("line"))


def synthetic_regression(spark: SparkSession, rows: int, features: int, eras: int = 1, noise: float = 10.0, seed: int = 123) -> tuple[DataFrame, list[str]]:
    """``(row_id, era, f0.., y)``: y is linear in normal features, with noise and an offset by era."""
    import random

    rng = random.Random(seed)
    names = [f"f{i}" for i in range(features)]
    weights = [rng.uniform(0.0, 100.0) for _ in names]
    df = spark.range(rows).withColumnRenamed("id", "row_id").withColumn("era", (F.col("row_id") % eras).cast("int"))
    df = df.select("row_id", "era", *[F.randn(seed + i).cast("float").alias(c) for i, c in enumerate(names)])
    y = sum((F.lit(w) * F.col(c) for w, c in zip(weights, names)), F.lit(0.0)) + F.randn(seed - 1) * noise + F.col("era") * 0.5
    return df.withColumn("y", y.cast("double")), names


def random_split(df: DataFrame, test: float = 0.2, seed: int = 123) -> tuple[DataFrame, DataFrame]:
    train, held = df.randomSplit([1.0 - test, test], seed)
    return train, held


def key_split(df: DataFrame, key: str, test: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of a key, which does not depend on partitions; rows without a key are for training."""
    digits = F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8)
    part = F.coalesce(F.conv(digits, 16, 10).cast("long") % 1000 < int(1000 * test), F.lit(False))
    return df.where(~part), df.where(part)


def scored_counts(df: DataFrame, flag: str = "is_scored") -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.col(flag).cast("long")).alias("n_scored"))
