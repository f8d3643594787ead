"""Era-aware gradient boosting.

A round grows one tree, as all trees of a pack are equal: they start from the same rows, share
the features of a depth and know no chance of their own. Each depth is one job over the binned
rows: histogram, scores, the best split of each node. What comes back is one row for each node.
Rows are never rewritten with a node number: the tree so far is a column expression over their
bins. Predictions are columns too; every ``store_every`` rounds they are stored, and the copy
before is deleted. Rows without a target, null or NaN, take no part.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from erawood.config import BoostConfig
from erawood.operators import binning, cuts, histogram, metrics, splits
from erawood.operators.trees import Tree, forest_value, from_model_table, model_table, node_of, value_of
from erawood.scratch import discard, scratch_path, written


def sampled_features(n: int, fraction: float, seed: int | None, number: int, depth: int) -> list[int]:
    """The features of one depth: round(fraction * n), one at least, by a seeded permutation."""
    k = min(n, max(1, round(fraction * n)))
    order = list(range(n))
    if k < n:
        random.Random(f"{seed}:{number}:{depth}").shuffle(order)
    return sorted(order[:k])


def _complete(df: DataFrame, target: str, era: str | None) -> DataFrame:
    """The rows that a fit can use: with a target, and with an era if there are eras."""
    y = F.col(target).cast("double")
    return df.where(y.isNotNull() & ~F.isnan(y) & (F.col(era).isNotNull() if era else F.lit(True)))


class _Stored:
    """Rows with a growing prediction: a stored copy and the trees that came after it."""

    def __init__(self, df: DataFrame, name: str):
        self.name, self.path, self.pending = name, None, 0
        self._store(df)

    def _store(self, df: DataFrame) -> None:
        before, self.path, self.pending = self.path, scratch_path(df.sparkSession, self.name), 0
        self.rows = written(df, self.path)
        if before is not None:
            discard(df.sparkSession, before)

    def add(self, value: Column, store_every: int) -> None:
        self.rows = self.rows.withColumn("pred", F.col("pred") + value)
        self.pending += 1
        if self.pending >= store_every:
            self._store(self.rows)

    def drop(self) -> None:
        discard(self.rows.sparkSession, self.path)


class EraBooster:
    """``fit`` and ``predict`` over DataFrames; ``trees``, ``history`` and ``depth_log`` afterwards."""

    def __init__(self, config: BoostConfig | None = None, engine: str = "arrow", approximate_edges: bool = False, store_every: int = 8):
        if engine not in ("arrow", "sql"):
            raise ValueError("engine must be 'arrow' or 'sql'")
        self.config = config or BoostConfig()
        self.engine, self.approximate_edges, self.store_every = engine, approximate_edges, max(1, store_every)
        self._trees: list[Tree] | None = None
        self.features: list[str] = []
        self.edges: list[list[float]] | None = None
        self.history: list[dict] = []
        self.depth_log: list[dict] = []

    @property
    def trees(self) -> list[Tree]:
        """All trees, the equal ones of a round one by one."""
        return [t for t in self._trees or [] for _ in range(self.config.pack_size)]

    def fit(
        self,
        df: DataFrame,
        features: list[str],
        target: str,
        era: str | None = None,
        *,
        num_rounds: int = 1,
        eval_sets: list[tuple[str, DataFrame]] = (),
        round_callback: Callable[[int, dict], None] | None = None,
        eval_every: int = 1,
        log_metrics: bool = True,
    ) -> EraBooster:
        """Trains on ``df``; without ``era`` all rows are one era. Eval sets need target and era too.

        Rows with a null or NaN target, or a null era, are left out, of eval sets too. A null
        feature is NaN. ``eval_every`` of 0 or less leaves eval metrics out.
        """
        for c in [*features, target, *([era] if era else [])]:
            if c not in df.columns:
                raise ValueError(f"no column {c!r}")
        if not features:
            raise ValueError("no feature column")
        self.features = list(features)
        df = _complete(df, target, era)
        binned, self.edges = binning.preprocess(df, self.features, self.config.max_bins, self.config.prebinned, self.approximate_edges)
        state = _Stored(self._state(binned, target, era), "rows")
        evals = []
        for name, e in eval_sets:
            if target not in e.columns or (era and era not in e.columns):
                raise ValueError(f"eval set {name!r} lacks its target or era")
            ready = binning.bin_new(_complete(e, target, era), self.features, self.edges, self.config.max_bins)
            evals.append((name, _Stored(self._state(ready, target, era), "eval")))
        self._trees, self.history, self.depth_log = [], [], []
        factor = self.config.tree_weight * self.config.pack_size
        for number in range(num_rounds):
            began = time.perf_counter()
            tree = self._grow(state.rows, number)
            self._trees.append(tree)
            more = number + 1 < num_rounds
            for held in (state, *(e for _, e in evals)):
                held.add(factor * value_of(tree, F.col("bins")), self.store_every if more else num_rounds + 1)
            entry: dict = {"round": number}
            if log_metrics:
                entry["train_corr"] = metrics.mean_era_correlation(state.rows, "y", "pred")
            due = eval_every > 0 and ((number + 1) % eval_every == 0 or number + 1 == num_rounds)
            for name, e in evals if due else []:
                entry[f"{name}_corr"] = metrics.mean_era_correlation(e.rows, "y", "pred")
            seconds = time.perf_counter() - began
            entry |= {"round_seconds": seconds, "trees_per_second": self.config.pack_size / max(seconds, 1e-9)}
            self.history.append(entry)
            if round_callback is not None:
                round_callback(number, dict(entry))
        for held in (state, *(e for _, e in evals)):
            held.drop()
        return self

    @staticmethod
    def _state(binned: DataFrame, target: str, era: str | None) -> DataFrame:
        code = F.col(era).cast("int") if era else F.lit(0)
        return binned.select(code.alias("era"), F.col(target).cast("double").alias("y"), "bins", F.lit(0.0).alias("pred"))

    def _grow(self, state: DataFrame, number: int) -> Tree:
        c = self.config
        rows = state.select("era", "bins", (F.col("pred") - F.col("y")).alias("grad"))
        n, g = rows.agg(F.count("*"), F.sum("grad")).first()
        tree = Tree()
        tree.value[0] = -g / (n + c.lambda_l2) if n else 0.0
        frontier = {0: n}
        for depth in range(c.max_depth):
            active = [v for v, n in frontier.items() if n >= 2 * c.min_samples_leaf]
            if not active or c.max_bins < 2:
                break
            began = time.perf_counter()
            chosen = sampled_features(len(self.features), c.layer_feature_fraction, c.random_state, number, depth)
            at = rows.withColumn("node_id", node_of(tree, F.col("bins")).cast("int"))
            if set(active) != {0}:
                at = at.where(F.col("node_id").isin(active))
            found = self._search(at, chosen).collect()
            frontier = {}
            for r in sorted(found, key=lambda r: r["node_id"]):
                a, b = tree.split(r["node_id"], r["feature"], r["threshold"], r["left_value"], r["right_value"])
                frontier |= {a: r["left_count"], b: r["right_count"]}
            cells = len(active) * len(chosen)
            self.depth_log.append({
                "round": number, "depth": depth, "nodes_processed": len(active), "nodes_split": len(found), "features": len(chosen),
                "histogram_mode": c.histogram_mode, "nodes_subtract_ok": 0 if c.histogram_mode == "rebuild" else len(active), "nodes_rebuild": len(active) if c.histogram_mode == "rebuild" else 0,
                "node_features": cells, "rows": sum(r["left_count"] + r["right_count"] for r in found), "seconds": time.perf_counter() - began,
            })
        return tree

    def _search(self, rows: DataFrame, features: list[int]) -> DataFrame:
        c = self.config
        if self.engine == "arrow":
            return splits.best_splits_packed(histogram.histogram_packed(rows, features, c.max_bins), c)
        hist = histogram.histogram(rows, features, c.max_bins)
        pre = histogram.prefix_sums(hist, c.max_bins)
        if 0 < c.k_cuts < c.max_bins - 1:
            if c.cut_selection == "even":
                pre = pre.where(F.col("thr").isin(cuts.even_cuts(c.max_bins, c.k_cuts)))
            else:
                kept = cuts.mass_cuts(hist, c.max_bins, c.k_cuts)
                table = rows.sparkSession.createDataFrame([(f, t) for f, ts in kept.items() for t in ts], "feature int, thr int")
                pre = pre.join(F.broadcast(table), ["feature", "thr"])
        return splits.best_splits(splits.scores(splits.era_gains(pre, c), c), c)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with the prediction of its rows: no shuffle, and it works on streams too if the fit had edges."""
        if self._trees is None:
            raise RuntimeError("the booster isn't fitted")
        ready = binning.bin_new(df, self.features, self.edges, self.config.max_bins)
        total = forest_value(self._trees, F.col("bins")) * (self.config.tree_weight * self.config.pack_size)
        made = ready.withColumn(out, total)
        return made if "bins" in df.columns else made.drop("bins")

    def predict_packwise(self, df: DataFrame, block_size_trees: int = 8, out: str = "prediction") -> DataFrame:
        if block_size_trees <= 0:
            raise ValueError("block_size_trees must be positive")
        return self.predict(df, out)

    def model(self, spark: SparkSession) -> DataFrame:
        if self._trees is None:
            raise RuntimeError("the booster isn't fitted")
        return model_table(spark, self._trees, self.config.pack_size)

    def save(self, spark: SparkSession, path: str) -> None:
        """The model table, and beside it features and edges as JSON rows."""
        self.model(spark).write.mode("overwrite").parquet(f"{path}/model")
        about = json.dumps({"features": self.features, "edges": self.edges, "config": self.config.__dict__})
        spark.createDataFrame([(about,)], "value string").write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EraBooster:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        out = cls(BoostConfig(**about["config"]))
        out.features, out.edges = about["features"], about["edges"]
        out._trees = from_model_table(spark.read.parquet(f"{path}/model"))
        return out

    def round_log(self, spark: SparkSession) -> DataFrame:
        rows = [(h["round"], k, float(v)) for h in self.history for k, v in h.items() if k != "round"]
        return spark.createDataFrame(rows, "round int, name string, value double")

    def depth_rows(self, spark: SparkSession) -> DataFrame:
        """The depth log as JSON rows."""
        return spark.createDataFrame([(d["round"], d["depth"], json.dumps(d)) for d in self.depth_log], "round int, depth int, entry string")
