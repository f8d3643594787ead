"""Queries of the engine by name over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erawood.config import BoostConfig
from erawood.functions.columns import finite, gain, signal
from erawood.operators import binning, bundling, cuts, eras, features, histogram, metrics, splits, trees
from erawood.operators.booster import EraBooster, sampled_features
from erawood.plans import sql as S
from erawood.scratch import scratch_path, written
from erawood.sources import io

FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]
BINS = 16
CONFIG = BoostConfig(pack_size=2, max_depth=2, learning_rate=0.1, lambda_l2=1.0, lambda_dro=0.2, direction_weight=0.05, min_samples_leaf=50, max_bins=BINS)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def training(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as a training set: eras are ship years, the target is a mix of tax, price and discount."""
    y = F.col("l_tax") * 10 - F.col("l_discount") * 2 + F.col("l_quantity") / 100
    return _table(spark, d, "lineitem").select(*FEATURES, "l_tax", F.year("l_shipdate").alias("era"), y.alias("y"))


def _binned(spark: SparkSession, d: str) -> DataFrame:
    ready, _ = binning.preprocess(training(spark, d), FEATURES, BINS)
    return ready.select("era", "y", "bins", F.lit(0).alias("node_id"), (-F.col("y")).alias("grad"))


def _hist(spark: SparkSession, d: str) -> DataFrame:
    return histogram.histogram(_binned(spark, d), [0, 1, 2], BINS)


def _r(c: str, digits: int = 6):
    """A rounded column without a negative zero."""
    return (F.round(c, digits) + F.lit(0.0)).alias(c)


def quantile_edges(spark, d):
    return binning.edge_table(training(spark, d), FEATURES, BINS)


def bin_counts(spark, d):
    ready, _ = binning.preprocess(training(spark, d), FEATURES, BINS)
    return ready.select(F.posexplode("bins").alias("feature", "bin")).groupBy("feature", F.col("bin").cast("int").alias("bin")).agg(F.count("*").alias("n"))


def prebinned_check(spark, d):
    labels = _table(spark, d, "labels")
    answers = [("labels_2", binning.is_prebinned(labels, ["quality", "toxic"], 2)), ("labels_1", binning.is_prebinned(labels, ["quality", "toxic"], 1)), ("part_64", binning.is_prebinned(_table(spark, d, "part"), ["p_size"], 64))]
    return spark.createDataFrame(answers, "name string, prebinned boolean")


def embedding_bins(spark, d):
    names = [f"e{i}" for i in range(S.DIMENSIONS)]
    vectors = _table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].alias(c) for i, c in enumerate(names)])
    ready, _ = binning.preprocess(vectors, names, 8)
    return ready.select("vec_id", *[F.col("bins")[i].cast("int").alias(f"b{i}") for i in range(S.DIMENSIONS)])


def missing_bins(spark, d):
    """Edges of whole columns, applied to a column with nulls and NaN: missing values come last."""
    k = F.col("event_id") % 5
    x = F.when(k == 0, F.lit(float("nan"))).when(k != 1, F.col("value"))
    rows = binning.apply_bins(_table(spark, d, "events").select("event_id", x.alias("x")), ["x"], [S.MISSING_EDGES])
    return rows.select("event_id", F.col("bins")[0].cast("int").alias("bin"))


def missing_edges(spark, d):
    """A column with a null has no quantiles, so all its numbers are in the first bin."""
    rows, _ = binning.preprocess(_table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 1000 != 3, F.col("value")).alias("x"), "value"), ["x", "value"], 4)
    return rows.select("event_id", *[F.col("bins")[i].cast("int").alias(f"b{i}") for i in range(2)])


def era_encode(spark, d):
    return eras.encode_eras(training(spark, d)).groupBy("era", "era_code").agg(F.count("*").alias("n"))


def era_bucket(spark, d):
    days = _table(spark, d, "orders").select(F.datediff("o_orderdate", F.lit("1990-01-01")).alias("date_id"))
    return eras.bucket_eras(days, 180, "date_id").groupBy("era_bucket").agg(F.count("*").alias("n"))


def era_floor(spark, d):
    return _table(spark, d, "orders").select(eras.floor_eras(F.col("o_orderkey"), 512).alias("era")).groupBy("era").agg(F.count("*").alias("n"))


def era_index(spark, d):
    rows = _table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 8).cast("int").alias("era"))
    return eras.era_index(rows, "vec_id").select("era", F.size("rows").cast("long").alias("n"), F.array_join("rows", ",").alias("rows"))


def era_weights(spark, d):
    n = training(spark, d).groupBy("era").agg(F.count("*").alias("n"))
    return n.select("era", eras.era_weight(F.col("n"), 0.0).alias("w0"), eras.era_weight(F.col("n"), 1.5).cast("double").alias("w15"))


def single_era(spark, d):
    return eras.single_era(training(spark, d)).groupBy("era").agg(F.count("*").alias("n"))


def grad_hist(spark, d):
    return _hist(spark, d).select("node_id", "feature", "era", "bin", "cnt", _r("g"))


def grad_hist_arrow(spark, d):
    return histogram.histogram_arrow(_binned(spark, d), [0, 1, 2], BINS).select("node_id", "feature", "era", "bin", "cnt", _r("g"))


def dense_grid(spark, d):
    return histogram.densified(_hist(spark, d), BINS).select("feature", "era", "bin", "cnt", _r("g"))


def prefix_scan(spark, d):
    return histogram.prefix_sums(_hist(spark, d), BINS).select("feature", "era", "thr", "lc", _r("lg"), "tc", _r("tg"))


def reverse_scan(spark, d):
    return histogram.suffix_sums(_hist(spark, d), BINS).select("feature", "era", "thr", "rc", _r("rg"))


def node_totals(spark, d):
    return histogram.node_totals(_binned(spark, d), "era").select("node_id", "era", "n", _r("g"))


def parent_gain(spark, d):
    return histogram.node_totals(_binned(spark, d), "era").select("era", F.round(gain(F.col("g"), F.col("n"), 1.0), 6).alias("gain"))


def even_cuts(spark, d):
    return spark.createDataFrame([(b, k, t) for b, k in ((63, 3), (16, 5), (16, 0), (8, 20)) for t in cuts.even_cuts(b, k)], "bins int, k int, thr int")


def mass_cuts(spark, d):
    found = cuts.mass_cuts(_hist(spark, d), BINS, 5)
    return spark.createDataFrame([(f, t) for f, some in found.items() for t in some], "feature int, thr int")


def adaptive_cuts(spark, d):
    sizes = [r["n"] for r in training(spark, d).groupBy("era").agg(F.count("*").alias("n")).collect()]
    rows = [(k, depth, decay, cuts.adaptive_k(sizes, depth, k, 62, decay)) for k in (0, 2, 5, 30) for depth in (0, 3) for decay in (1.0, 0.7)]
    return spark.createDataFrame(rows, "k int, depth int, decay double, cuts int")


def era_gain(spark, d):
    g = splits.era_gains(histogram.prefix_sums(_hist(spark, d), BINS), CONFIG)
    return g.select("feature", "era", "thr", "valid", _r("gain", 5), "direction", "w")


def des_score(spark, d):
    s = splits.scores(splits.era_gains(histogram.prefix_sums(_hist(spark, d), BINS), CONFIG), CONFIG)
    return s.select("feature", "thr", _r("mean", 5), _r("std", 4), _r("agreement"), _r("score", 4), "lc", "tc")


def des_mean_std(spark, d):
    s = splits.scores(splits.era_gains(histogram.prefix_sums(_hist(spark, d), BINS), CONFIG), CONFIG)
    return s.select("feature", "thr", _r("mean", 5), _r("std", 4))


def direction(spark, d):
    g = splits.era_gains(histogram.prefix_sums(_hist(spark, d), BINS), replace(CONFIG, era_alpha=1.5))
    return splits.scores(g, CONFIG).select("feature", "thr", _r("agreement"))


def _two_nodes(spark, d):
    """The rows of a first split, at nodes 1 and 2."""
    return _binned(spark, d).withColumn("node_id", F.when(F.col("bins")[0] <= 7, 1).otherwise(2))


def best_split_depth1(spark, d):
    return _decision(splits.best_splits_packed(histogram.histogram_packed(_two_nodes(spark, d), [0, 1, 2], BINS), CONFIG))


def best_split_mass(spark, d):
    return _decision(splits.best_splits_packed(histogram.histogram_packed(_two_nodes(spark, d), [0, 1, 2], BINS), replace(CONFIG, k_cuts=5)))


def best_split_node(spark, d):
    return _decision(splits.best_split_of(histogram.histogram_packed(_two_nodes(spark, d), [0, 1, 2], BINS), 2, CONFIG))


def rescored_splits(spark, d):
    rows = written(_two_nodes(spark, d), scratch_path(spark, "nodes"))
    found = splits.best_splits_packed(histogram.histogram_packed(rows, [0, 1, 2], BINS), CONFIG)
    return splits.rescored(rows, found, CONFIG).select("node_id", _r("score", 4), F.round("recomputed", 4).alias("recomputed"))


def leaf_values(spark, d):
    root = _binned(spark, d).groupBy("node_id").agg((-F.sum("grad") / (F.count("*") + CONFIG.lambda_l2)).alias("root_value"))
    return best_split_root(spark, d).select("node_id", "left_value", "right_value").join(root.select("node_id", _r("root_value")), "node_id")


def best_split_root(spark, d):
    s = splits.scores(splits.era_gains(histogram.prefix_sums(_hist(spark, d), BINS), CONFIG), CONFIG)
    return _decision(splits.best_splits(s, CONFIG))


def best_split_arrow(spark, d):
    return _decision(splits.best_splits_packed(histogram.histogram_packed(_binned(spark, d), [0, 1, 2], BINS), CONFIG))


def _decision(b):
    return b.select("node_id", "feature", "threshold", _r("score", 4), "left_count", "right_count", _r("left_value"), _r("right_value"))


def _fit(spark, d, rounds: int, engine: str = "arrow", rows: DataFrame | None = None, log: bool = False, evals=(), **changes) -> tuple[EraBooster, DataFrame]:
    df = written(training(spark, d) if rows is None else rows, scratch_path(spark, "training"))
    held = [(name, df) for name in evals]
    return EraBooster(replace(CONFIG, **changes), engine).fit(df, FEATURES, "y", "era", num_rounds=rounds, log_metrics=log, eval_sets=held), df


def _model(booster, spark):
    return booster.model(spark).where(F.col("tree_id") % CONFIG.pack_size == 0).select("round", "node_id", "feature", "threshold", "left", "right", _r("value", 5), "is_leaf")


def fit_one_round(spark, d):
    return _model(_fit(spark, d, 1)[0], spark)


def fit_two_rounds(spark, d):
    return _model(_fit(spark, d, 2)[0], spark)


def fit_sql_engine(spark, d):
    return _model(_fit(spark, d, 1, "sql")[0], spark)


def fit_depth_three(spark, d):
    return _model(_fit(spark, d, 1, max_depth=3)[0], spark)


def fit_predict(spark, d):
    booster, df = _fit(spark, d, 2)
    return booster.predict(df).groupBy("era", F.round("prediction", 4).alias("prediction")).agg(F.count("*").alias("n"))


def predict_packwise(spark, d):
    booster, df = _fit(spark, d, 2)
    return booster.predict_packwise(df).groupBy("era", F.round("prediction", 4).alias("prediction")).agg(F.count("*").alias("n"))


def fit_mass_cuts(spark, d):
    return _model(_fit(spark, d, 1, k_cuts=5)[0], spark)


def fit_mass_cuts_sql_engine(spark, d):
    return _model(_fit(spark, d, 1, "sql", k_cuts=5)[0], spark)


def fit_even_cuts(spark, d):
    return _model(_fit(spark, d, 1, k_cuts=4, cut_selection="even")[0], spark)


def fit_era_alpha(spark, d):
    return _model(_fit(spark, d, 1, era_alpha=1.5)[0], spark)


def fit_mean_update(spark, d):
    return _model(_fit(spark, d, 2, pack_update="mean")[0], spark)


def fit_single_era(spark, d):
    df = written(training(spark, d), scratch_path(spark, "training"))
    return _model(EraBooster(CONFIG).fit(df, FEATURES, "y", log_metrics=False), spark)


def _with_null_targets(spark, d):
    return training(spark, d).withColumn("y", F.when(F.col("l_quantity").cast("int") % 7 != 0, F.col("y")))


def fit_null_targets(spark, d):
    return _model(_fit(spark, d, 1, rows=_with_null_targets(spark, d))[0], spark)


def fit_null_targets_sql_engine(spark, d):
    return _model(_fit(spark, d, 1, "sql", rows=_with_null_targets(spark, d))[0], spark)


SAMPLED = {"layer_feature_fraction": 0.67, "random_state": 3}


def fit_sampled_features(spark, d):
    return _model(_fit(spark, d, 1, **SAMPLED)[0], spark)


def train_equals_predict(spark, d):
    """Predictions against the sums that training moves rows by, tree after tree."""
    booster, df = _fit(spark, d, 2)
    factor = CONFIG.tree_weight * CONFIG.pack_size
    moved = sum((factor * trees.value_of(t, F.col("bins")) for t in booster.trees[:: CONFIG.pack_size]), F.lit(0.0))
    both = binning.apply_bins(booster.predict(df), FEATURES, booster.edges).withColumn("moved", moved)
    return both.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("moved") - F.col("prediction")) > 1e-9).alias("n_apart"), F.round(F.sum("moved"), 3).alias("total"))


def trees_property(spark, d):
    booster, _ = _fit(spark, d, 2)
    return spark.createDataFrame([(i, len(t), t.depth) for i, t in enumerate(booster.trees)], "tree int, nodes int, depth int")


FIXED = trees.Tree([0, 1, 2, -1, -1, -1, -1], [7, 4, 3, 0, 0, 0, 0], [1, 3, 5, -1, -1, -1, -1], [2, 4, 6, -1, -1, -1, -1], [0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 4.0])


def predict_tree(spark, d):
    return _binned(spark, d).select("era", trees.value_of(FIXED, F.col("bins")).alias("value")).groupBy("era", "value").agg(F.count("*").alias("n"))


def predict_forest(spark, d):
    return _binned(spark, d).select((trees.forest_value([FIXED, trees.Tree(), FIXED], F.col("bins")) * 0.1).alias("v")).groupBy(F.round("v", 6).alias("value")).agg(F.count("*").alias("n"))


def partition_rows(spark, d):
    return _binned(spark, d).select(trees.node_of(FIXED, F.col("bins")).alias("node_id"), "era").groupBy("node_id", "era").agg(F.count("*").alias("n"))


def _predicted(spark, d):
    return training(spark, d).withColumn("p", F.col("l_quantity") / 50 - F.col("l_discount"))


def era_corr(spark, d):
    return metrics.era_correlations(_predicted(spark, d), "y", "p").select("era", _r("corr"))


def era_metrics(spark, d):
    return metrics.era_metrics(_predicted(spark, d), "y", "p").select(_r("mean_corr"), _r("corr_sharpe", 4), "n_eras")


def r2(spark, d):
    return metrics.r2(_predicted(spark, d), "y", "p").select(_r("r2"))


def mse(spark, d):
    return metrics.mse(_predicted(spark, d), "y", "p").select(_r("mse"), _r("variance"))


def _returns(spark, d):
    return _table(spark, d, "events").select("event_id", ((F.col("value") - 50) / 5000).alias("forward_returns"), F.lit(0.0001).alias("risk_free_rate"), (F.col("value") / 100 - 0.5).alias("raw"))


def ann_sharpe(spark, d):
    return _returns(spark, d).agg(F.round(metrics.annual_sharpe(F.col("forward_returns")), 6).alias("sharpe"))


def signal_clip(spark, d):
    return _returns(spark, d).select("event_id", F.round(signal(F.col("raw"), 1.0), 9).alias("position"))


def penalised_sharpe(spark, d):
    df = _returns(spark, d).withColumn("position", signal(F.col("raw"), 1.0))
    return metrics.penalised_sharpe(df, "position", "forward_returns", "risk_free_rate").select(_r("score", 5))


def rank_pct(spark, d):
    return metrics.rank_pct(_table(spark, d, "part").select("p_partkey", "p_size"), "p_size").select("p_partkey", F.round("rank_pct", 9).alias("rank_pct"))


def _series(spark, d):
    return _table(spark, d, "events").select("event_id", "ts", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


SERIES = ["ts", "event_id"]
#: Rows of a block of the series; the tables are small, and the blocks too, so that there are some.
SERIES_BLOCK = 512


def _over(spark, d, make, name, lookback):
    out = features.over_series(_series(spark, d), lambda w: {name: make(F.col("value"), w)}, SERIES, lookback, SERIES_BLOCK)
    return out.select("event_id", F.round(name, 8).alias(name))


def lag1(spark, d):
    return _over(spark, d, features.lag1, "lag1", 1)


def rolling_z(spark, d):
    return _over(spark, d, features.rolling_z, "z", 20)


def momentum(spark, d):
    return _over(spark, d, features.momentum, "momentum", 62)


def _filled(spark, d, how):
    return features.fill_series(_series(spark, d), "value", how, SERIES, block=SERIES_BLOCK).select("event_id", F.round("filled", 8).alias("filled"))


def ffill(spark, d):
    return _filled(spark, d, "ffill")


def bfill(spark, d):
    return _filled(spark, d, "bfill")


def ffill_bfill(spark, d):
    return _filled(spark, d, "ffill_bfill")


def engineer_features(spark, d):
    df, _ = features.engineer(_table(spark, d, "events").select("event_id", "user_id", "ts", "value"), ["value"], ["ts", "event_id"], by=["user_id"])
    return df.select("event_id", *[F.round(c, 8).alias(c) for c in ("value_lag1", "value_z21", "value_mom63")])


def inf_to_null(spark, d):
    x = F.when(F.col("event_id") % 5 == 0, F.lit(float("inf"))).when(F.col("event_id") % 5 == 1, F.lit(float("nan"))).otherwise(F.col("value"))
    return _table(spark, d, "events").select("event_id", finite(x).alias("x"))


def excess_target(spark, d):
    return features.excess_target(_returns(spark, d).drop("raw")).select("event_id", F.round("target", 9).alias("target"))


def null_target_filter(spark, d):
    return _series(spark, d).dropna(subset=["value"]).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def type_casts(spark, d):
    return training(spark, d).select(F.col("l_quantity").cast("short").alias("q")).groupBy("q").agg(F.count("*").alias("n"))


def _market(spark, d):
    """A table of returns by date with lagged columns, features of two groups and a flag."""
    k = F.col("event_id")
    lagged = [F.lit(0.0).alias(f"lagged_{c}") for c in ("forward_returns", "risk_free_rate", "market_forward_excess_returns")]
    fr, rf = (F.col("value") - 50) / 5000, F.lit(0.0001)
    return _table(spark, d, "events").select(
        k.alias("row_id"), (k % 400).cast("int").alias("date_id"), fr.alias("forward_returns"), rf.alias("risk_free_rate"), (fr - rf).alias("market_forward_excess_returns"), *lagged,
        (k % 400 >= 380).cast("int").alias("is_scored"), F.col("value").alias("M1"), (F.col("value") * 2).alias("MOM_2"), (k % 2).cast("int").alias("D1"), F.col("props").alias("note"),
    )


def market_columns(spark, d):
    era, target, names = features.infer_columns(_market(spark, d))
    _, _, some = features.infer_columns(_market(spark, d), prefixes=["mom", "D"])
    return spark.createDataFrame([("era", era), ("target", target), *[("feature", c) for c in names], *[("of_groups", c) for c in some]], "role string, name string")


def last_n_metrics(spark, d):
    df = _market(spark, d).withColumn("prediction", F.col("M1") / 100 - 0.5)
    train = df.where((F.col("date_id") < 390) & (F.col("date_id") != 385))
    return metrics.held_out_scores(df, train, "date_id", 30, "prediction", 1.0).select("n_rows", _r("last_n_sharpe", 5), _r("penalised_sharpe", 5))


def distinct_eras(spark, d):
    df = eras.bucket_eras(_market(spark, d), 30, "date_id")
    return spark.createDataFrame([("raw", eras.count_eras(df, "date_id")), ("bucketed", eras.count_eras(df, "era_bucket"))], "eras string, n long")


def result_table(spark, d):
    rows = era_corr(spark, d).select(F.concat(F.lit("era "), F.col("era")).alias("name"), F.when(F.col("era") != 1995, F.col("corr")).alias("corr"))
    return io.result_table(rows, [("name", 12, None), ("corr", 10, 4)])


def column_inference(spark, d):
    df = training(spark, d).withColumnRenamed("y", "target")
    era, target, names = features.infer_columns(df, prefixes=["l_"])
    return spark.createDataFrame([("era", era), ("target", target), *[("feature", c) for c in names]], "role string, name string")


def dir_agreement(spark, d):
    df = training(spark, d).withColumn("y", F.col("y") - 0.4)
    return features.directional_agreement(df, FEATURES, "y").select("feature", _r("agreement"))


def top_corr(spark, d):
    return features.top_correlated(training(spark, d), [*FEATURES, "l_tax"], "y", 3).select("feature", "place", _r("corr"))


def temporal_holdout(spark, d):
    train, test = eras.temporal_holdout(training(spark, d), holdout=2)
    return train.withColumn("role", F.lit("train")).unionByName(test.withColumn("role", F.lit("test"))).groupBy("role", "era").agg(F.count("*").alias("n"))


def row_holdout(spark, d):
    df = eras.row_holdout(_table(spark, d, "events").select("event_id", "ts"), 0.1, ["ts", "event_id"])
    return df.where("is_test").select("event_id")


def cv_folds(spark, d):
    return eras.cv_folds(training(spark, d), 3, embargo=1)


def last_n(spark, d):
    days = _table(spark, d, "events").select(F.to_date("ts").alias("day"), "event_id")
    return eras.last_dates(days, 5, "day").groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def _sparse(spark, d):
    k = F.col("event_id")
    on = {"a": k % 5 == 0, "b": k % 5 == 1, "c": k % 7 == 0, "e": k % 5 == 2}
    return _table(spark, d, "events").select("event_id", *[F.when(v, F.col("value")).otherwise(0.0).alias(c) for c, v in on.items()])


def conflict_matrix(spark, d):
    return bundling.conflict_matrix(_sparse(spark, d), ["a", "b", "c", "e"])


def bundle_transform(spark, d):
    names = ["a", "b", "c", "e"]
    df = _sparse(spark, d)
    found = bundling.greedy_bundles([(r["f1"], r["f2"], r["n"]) for r in bundling.conflict_matrix(df, names).collect()], 4, 3, 0)
    out, made = bundling.apply_bundles(df, names, found, keep=["event_id"])
    return out.select("event_id", F.array_join(F.array_sort(F.array(*[F.format_string("%.4f", F.col(f"`{c}`")) for c in made])), ",").alias("sums"))


def bundle_prefix(spark, d):
    """Bundles of the columns with a prefix; the others stand alone, before them."""
    df = _sparse(spark, d).withColumnsRenamed({"a": "D_a", "b": "d_b", "c": "X_c", "e": "D_e"})
    names = ["D_a", "d_b", "X_c", "D_e"]
    found = bundling.fit_bundles(df, names, ["d"])
    out, made = bundling.apply_bundles(df, names, found, keep=["event_id"])
    return out.select("event_id", F.lit(len(made)).alias("columns"), F.col("X_c").alias("alone"), F.round(F.col(f"`{made[1]}`"), 6).alias("bundle"))


def key_split(spark, d):
    train, test = io.key_split(_table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def depth_log(spark, d):
    booster, _ = _fit(spark, d, 1)
    logged = spark.createDataFrame([(x["round"], x["depth"], x["nodes_processed"], x["nodes_split"], x["rows"]) for x in booster.depth_log], "round int, depth int, nodes_processed int, nodes_split int, n_rows long")
    return logged.groupBy("round").agg(F.sum("nodes_processed").alias("nodes_processed"), F.sum("nodes_split").alias("nodes_split"), F.max("n_rows").alias("most_rows"))


def round_log(spark, d):
    booster, _ = _fit(spark, d, 2, log=True, evals=["held"])
    return booster.round_log(spark).where(F.col("name").isin("train_corr", "held_corr")).select("round", "name", _r("value", 5))


def json_log(spark, d):
    """The log of the depths, written as JSON lines and read again."""
    booster, _ = _fit(spark, d, 1)
    path = scratch_path(spark, "log")
    io.write_json_log(booster.depth_rows(spark).select(F.from_json("entry", "round int, depth int, nodes_processed int, nodes_split int").alias("e")).select("e.*"), path)
    return spark.read.schema("round int, depth int, nodes_processed long, nodes_split long").json(path)


def feature_sample(spark, d):
    return spark.createDataFrame([(depth, f) for depth in range(3) for f in sampled_features(10, 0.3, 42, 0, depth)], "depth int, feature int")


def csv_roundtrip(spark, d):
    path = scratch_path(spark, "csv")
    io.write_csv(_table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), path)
    return io.read_csv(spark, path, "p_partkey long, p_size int, p_retailprice double", ["p_partkey", "p_size"])


def csv_projection(spark, d):
    path = scratch_path(spark, "csv")
    io.write_csv(_table(spark, d, "part").select("p_partkey", F.col("p_name").alias("p_name"), (F.col("p_size") > 25).cast("int").alias("is_scored")), path)
    return io.scored_counts(io.read_csv(spark, path, columns=["p_partkey", "is_scored"]))


def row_cap(spark, d):
    return io.first_rows(_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 100, ["o_totalprice", "o_orderkey"])


def feature_set(spark, d):
    names = [f.name for f in _table(spark, d, "lineitem").schema if f.dataType.typeName() == "double"]
    path = scratch_path(spark, "features")
    spark.createDataFrame([(json.dumps({"feature_sets": {"all": names, "few": names[:1]}}),)], "value string").coalesce(1).write.text(path)
    return spark.createDataFrame([(c,) for c in io.read_feature_set(spark, path)], "name string")


def parquet_projection(spark, d):
    return io.read_parquet(spark, io.dataset_path(f"{d}/nation.parquet"), ["n_nationkey", "n_regionkey"])


def json_features(spark, d):
    e = _table(spark, d, "events")
    return e.select(F.from_json("props", "k int")["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n"))


def synthetic(spark, d):
    df, names = io.synthetic_regression(spark, 4000, 20)
    train, test = io.random_split(df)
    return train.agg(F.count("*").alias("n")).withColumn("part", F.lit("train")).unionByName(test.agg(F.count("*").alias("n")).withColumn("part", F.lit("test")))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    booster, df = _fit(spark, d, 1)
    return booster.predict(df).select("era", "y", "prediction")


QUERIES = {
    f.__name__: f
    for f in (
        quantile_edges, bin_counts, prebinned_check, embedding_bins, missing_bins, missing_edges, era_encode, era_bucket, era_floor, era_index, era_weights, single_era, distinct_eras,
        grad_hist, grad_hist_arrow, dense_grid, prefix_scan, reverse_scan, node_totals, parent_gain, even_cuts, mass_cuts, adaptive_cuts, era_gain, des_score, des_mean_std, direction,
        best_split_root, best_split_arrow, best_split_depth1, best_split_mass, best_split_node, rescored_splits, leaf_values,
        fit_one_round, fit_two_rounds, fit_sql_engine, fit_depth_three, fit_predict, predict_packwise, fit_mass_cuts, fit_mass_cuts_sql_engine, fit_even_cuts, fit_era_alpha, fit_mean_update,
        fit_single_era, fit_null_targets, fit_null_targets_sql_engine, fit_sampled_features, train_equals_predict, trees_property,
        predict_tree, predict_forest, partition_rows, era_corr, era_metrics, r2, mse, ann_sharpe, signal_clip, penalised_sharpe, last_n_metrics, result_table, rank_pct,
        lag1, rolling_z, momentum, ffill, bfill, ffill_bfill, engineer_features, inf_to_null, excess_target, null_target_filter, type_casts, column_inference, market_columns,
        dir_agreement, top_corr, temporal_holdout, row_holdout, cv_folds, last_n, conflict_matrix, bundle_transform, bundle_prefix,
        depth_log, round_log, json_log, feature_sample, csv_roundtrip, csv_projection, row_cap, feature_set, parquet_projection, json_features, key_split, synthetic,
    )
}
ORACLE_SQL: dict[str, str] = S.ORACLE_SQL
