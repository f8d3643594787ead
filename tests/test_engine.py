"""The booster against a numpy brute force, and its properties."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from erawood.config import BoostConfig
from erawood.operators import binning, bundling, cuts, histogram, splits
from erawood.operators.booster import EraBooster, sampled_features
from erawood.operators.trees import Tree, forest_value, from_model_table, value_of
from erawood.sources import io

CONFIG = BoostConfig(pack_size=3, max_depth=3, learning_rate=0.2, lambda_l2=0.5, lambda_dro=0.1, direction_weight=0.05, min_samples_leaf=5, max_bins=16)
NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(42)
    x = rng.standard_normal((300, 3)).astype(np.float32)
    y = x @ np.array([1.0, -2.0, 0.5]) + 0.1 * rng.standard_normal(300)
    era = np.arange(300) % 4
    rows = [(i, int(e), *map(float, r), float(v)) for i, (e, r, v) in enumerate(zip(era, x, y))]
    df = spark.createDataFrame(rows, "row_id long, era int, a float, b float, c float, y double").cache()
    return df, x, y, era


def brute_split(bins, grad, era, rows, config):
    best = None
    m, l2 = config.min_samples_leaf, config.lambda_l2
    g2 = lambda g, n: 0.5 * g * g / (n + l2)
    for f in range(bins.shape[1]):
        for t in range(config.max_bins - 1):
            gains, ways, ws, left = [], [], [], 0
            lg_all = 0.0
            for e in np.unique(era[rows]):
                at = rows[era[rows] == e]
                go = bins[at, f] <= t
                lc, rc = go.sum(), (~go).sum()
                left += lc
                lg, rg = grad[at[go]].sum(), grad[at[~go]].sum()
                lg_all += lg
                if lc and rc:
                    gains.append(g2(lg, lc) + g2(rg, rc) - g2(lg + rg, lc + rc))
                    ways.append(1.0 if -lg / (lc + l2) > -rg / (rc + l2) else -1.0)
                    ws.append(len(at) + config.era_alpha if config.era_alpha > 0 else 1.0)
            mean = std = way = 0.0
            if ws:
                mean = np.average(gains, weights=ws)
                std = np.sqrt(np.average((np.array(gains) - mean) ** 2, weights=ws))
                way = np.average(ways, weights=ws)
            if left < m or len(rows) - left < m:
                continue
            score = round(mean - config.lambda_dro * std + config.direction_weight * way, 10)
            key = (score, left, f, t)
            if best is None or key > best[0]:
                best = (key, lg_all)
    return best


def brute_tree(bins, grad, era, config):
    tree, where = Tree(), {0: np.arange(len(grad))}
    tree.value[0] = -grad.sum() / (len(grad) + config.lambda_l2)
    frontier = [0]
    for _ in range(config.max_depth):
        nxt = []
        for v in frontier:
            rows = where[v]
            if len(rows) < 2 * config.min_samples_leaf or (found := brute_split(bins, grad, era, rows, config)) is None:
                continue
            (_, left, f, t), lg = found
            g = grad[rows].sum()
            a, b = tree.split(v, f, t, -lg / (left + config.lambda_l2), -(g - lg) / (len(rows) - left + config.lambda_l2))
            where[a], where[b] = rows[bins[rows, f] <= t], rows[bins[rows, f] > t]
            nxt += [a, b]
        frontier = nxt
    return tree


def numpy_bins(x, max_bins):
    edges = np.quantile(x, np.linspace(0, 1, max_bins + 1)[1:-1], axis=0).astype(np.float32)
    return np.stack([np.clip(np.searchsorted(edges[:, f], x[:, f], "left"), 0, max_bins - 1) for f in range(x.shape[1])], 1)


@pytest.mark.parametrize("alpha", [0.0, 1.5])
@pytest.mark.parametrize("engine", ["arrow", "sql"])
def test_fit_equals_brute_force(spark, data, engine, alpha):
    from dataclasses import replace

    df, x, y, era = data
    config = replace(CONFIG, era_alpha=alpha, max_depth=2 if engine == "sql" else 3)
    booster = EraBooster(config, engine).fit(df, NAMES, "y", "era", num_rounds=2 if engine == "arrow" else 1, log_metrics=False)
    bins, pred = numpy_bins(x, config.max_bins), np.zeros(len(y))
    for got in booster.trees[:: config.pack_size]:
        want = brute_tree(bins, pred - y, era, config)
        assert (got.feature, got.threshold, got.left) == (want.feature, want.threshold, want.left)
        assert np.allclose(got.value, want.value)
        pred += config.learning_rate * config.pack_size * np.array([want.value[want.route(b)] for b in bins])
    out = np.array([r[0] for r in booster.predict(df).orderBy("row_id").select("prediction").collect()])
    assert np.allclose(out, pred)


def test_hand_made_node(spark):
    grad, bins, era = [0.5, -0.2, 0.1, -0.3, 0.4, -0.1], [0, 1, 1, 2, 2, 3], [0, 0, 1, 1, 1, 1]
    rows = spark.createDataFrame([(0, e, [b], g) for e, b, g in zip(era, bins, grad)], "node_id int, era int, bins array<tinyint>, grad double")
    config = BoostConfig(max_bins=4, lambda_l2=0.5, lambda_dro=0.1, direction_weight=0.2, min_samples_leaf=1)
    pre = histogram.prefix_sums(histogram.histogram(rows), 4)
    got = {r["thr"]: r for r in splits.scores(splits.era_gains(pre, config), config).collect()}
    for thr, left, mean, score in ((0, 1, 0.078666667, -0.121333333), (1, 3, 0.002222222, -0.197777778), (2, 5, 0.007936508, -0.192063492)):
        assert got[thr]["lc"] == left and abs(got[thr]["mean"] - mean) < 1e-8 and abs(got[thr]["score"] - score) < 1e-8 and got[thr]["std"] == 0
    best = splits.best_splits_packed(histogram.histogram_packed(rows, [0], 4), config).first()
    assert best["threshold"] == 0 and abs(best["score"] + 0.121333333) < 1e-8


def test_histogram_engines_and_conservation(spark, data):
    df, *_ = data
    ready, _ = binning.preprocess(df, NAMES, 16)
    rows = ready.select("era", "bins", F.lit(0).alias("node_id"), F.col("y").alias("grad"))
    plain = {tuple(r)[:5]: r["g"] for r in histogram.histogram(rows).collect()}
    fast = {tuple(r)[:5]: r["g"] for r in histogram.histogram_arrow(rows, [0, 1, 2], 16).collect()}
    assert plain.keys() == fast.keys() and all(abs(plain[k] - fast[k]) < 1e-9 for k in plain)
    hist = histogram.histogram(rows)
    both = histogram.prefix_sums(hist, 16).join(histogram.suffix_sums(hist, 16), ["node_id", "feature", "era", "thr"])
    assert both.where("lc + rc != tc or abs(lg + rg - tg) > 1e-9").count() == 0 and both.count() == 3 * 4 * 15


@pytest.mark.parametrize("n, width, features", [(1_500_000, 3, [0, 1, 2]), (20_000, 300, [1, 7]), (20_000, 300, list(range(300)))])
def test_a_task_adds_up_its_rows_in_bounded_memory(n, width, features):
    """However many rows a task has, and however wide they are."""
    rng = np.random.default_rng(1)

    def batches(size=10_000):
        for lo in range(0, n, size):
            bins = rng.integers(0, 16, size * width).astype(np.int8)
            held = pa.ListArray.from_arrays(np.arange(size + 1, dtype=np.int32) * width, bins)
            some = np.arange(lo, lo + size)
            node, era = (some % 2 + 1).astype(np.int32), (some % 7 + 1992).astype(np.int32)
            grad = (some % 5).astype(float)
            at = bins.reshape(size, width)
            for i, f in enumerate(features[:2]):
                np.add.at(want[0, i], (node, era - 1992, at[:, f]), 1)
                np.add.at(want[1, i], (node, era - 1992, at[:, f]), grad)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(era), held, pa.array(grad)], ["node_id", "era", "bins", "grad"])

    want, got = np.zeros((2, 2, 3, 7, 16)), np.zeros((2, 2, 3, 7, 16))
    tracemalloc.start()
    try:
        for batch in histogram._of_rows(batches(), np.array(features), 16):
            cells = histogram.unpacked(batch.column("cells"), 16)
            for (node, feature, era), c in zip(zip(*(batch.column(i).to_pylist() for i in range(3))), cells):
                if feature in features[:2]:
                    got[:, features.index(feature), node, era - 1992] += c.reshape(2, 16)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (got == want).all() and want[0].sum() == 2 * n
    assert peak < 64e6, peak


def test_modes_determinism_and_packwise(spark, data):
    from dataclasses import replace

    df, *_ = data
    config = replace(CONFIG, layer_feature_fraction=0.6, random_state=7)
    fits = [EraBooster(replace(config, histogram_mode=m)).fit(df, NAMES, "y", "era", num_rounds=1, log_metrics=False) for m in ("rebuild", "subtract")]
    assert len(fits[0].trees) == len(fits[1].trees) == 3
    for s, t in zip(fits[0].trees, fits[1].trees):  # sums have no order, so values may differ in the last place
        assert (s.feature, s.threshold, s.left) == (t.feature, t.threshold, t.left) and np.allclose(s.value, t.value, rtol=1e-12)
    for d in fits[1].depth_log:
        assert d["nodes_subtract_ok"] + d["nodes_rebuild"] == d["nodes_processed"]
    a, b = fits[0].predict(df), fits[0].predict_packwise(df, 4)
    assert a.exceptAll(b).count() == 0
    with pytest.raises(ValueError):
        fits[0].predict_packwise(df, 0)


def test_learns_reports_and_survives_saving(spark, data, tmp_path):
    from dataclasses import replace

    df, _, y, _ = data
    seen = []
    booster = EraBooster(replace(CONFIG, pack_update="mean"), store_every=2).fit(
        df, NAMES, "y", "era", num_rounds=3, eval_sets=[("held", df)], round_callback=lambda i, m: seen.append((i, m["train_corr"], m["held_corr"]))
    )
    assert [s[0] for s in seen] == [0, 1, 2] and all(abs(t - h) < 1e-9 for _, t, h in seen) and seen[-1][1] > 0.5
    mse = booster.predict(df).agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0]
    assert mse < y.var()
    booster.save(spark, str(tmp_path / "m"))
    again = EraBooster.load(spark, str(tmp_path / "m"))
    assert again.predict(df).exceptAll(booster.predict(df)).count() == 0
    assert from_model_table(booster.model(spark)) == booster.trees[::3]


def test_streams_are_scored(spark, data, tmp_path):
    from erawood.streaming.scoring import score_stream

    df, *_ = data
    booster = EraBooster(CONFIG).fit(df, NAMES, "y", num_rounds=1, log_metrics=False)
    df.write.parquet(str(tmp_path / "in"))
    query = score_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), booster, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(booster.predict(df)).count() == 0


def test_errors(spark, data):
    df, *_ = data
    with pytest.raises(RuntimeError):
        EraBooster(CONFIG).predict(df)
    with pytest.raises(ValueError):
        EraBooster(CONFIG).fit(df, ["nope"], "y")
    with pytest.raises(ValueError):
        EraBooster(CONFIG).fit(df, NAMES, "y", "era", eval_sets=[("e", df.drop("y"))])
    for bad in ({"max_bins": 200}, {"histogram_mode": "x"}, {"cut_selection": "x"}):
        with pytest.raises(ValueError):
            BoostConfig(**bad)
    with pytest.raises(ValueError):
        binning.preprocess(df, NAMES, 16, prebinned=True)
    with pytest.raises(ValueError):
        binning.bin_new(df, NAMES, None, 16)


def test_defaults():
    c = BoostConfig()
    assert (c.pack_size, c.max_depth, c.max_bins, c.k_cuts, c.min_samples_leaf, c.cut_selection) == (8, 6, 63, 0, 20, "mass")
    assert c.tree_weight == 0.1


def test_cuts():
    assert cuts.even_cuts(63, 3) == [0, 31, 61] and cuts.even_cuts(4, 0) == [0, 1, 2] and cuts.even_cuts(1, 3) == []
    assert cuts.mass_cuts_of([100, 0, 0, 0, 0, 0, 0, 1], 4) == [0, 2, 4, 6]
    assert cuts.mass_cuts_of([1] * 16, 0) == list(range(15))
    assert sampled_features(10, 0.3, 1, 0, 0) == sampled_features(10, 0.3, 1, 0, 0) and len(sampled_features(10, 0.01, 1, 0, 0)) == 1


def test_bundles():
    assert bundling.greedy_bundles([(0, 0, 5), (1, 1, 3), (2, 2, 4), (1, 2, 1)], 3, 2, 0) == [[1, 0], [2]]
    assert bundling.greedy_bundles([], 3, 2, 0) is None


def test_routing(spark):
    tree = Tree()
    tree.split(0, 0, 1, 0.5, -0.5)
    tree.split(1, 1, 0, 2.0, 3.0)
    df = spark.createDataFrame([([a, b],) for a in range(3) for b in range(3)], "bins array<tinyint>")
    for r in df.select("bins", value_of(tree, F.col("bins")).alias("v"), forest_value([tree, Tree()], F.col("bins")).alias("w")).collect():
        assert r["v"] == r["w"] == tree.value[tree.route(list(r["bins"]))]


def test_bins_and_small_forests_are_compiled(spark):
    """Few edges and few nodes become conditions without lambdas; they give what counting and walking give."""
    edges = [[-1.5, 0.0, 0.0, 0.1, 2.0, float("inf")], [3.0, 1.0, 2.0], [float("nan")] * 3, [5.0], []]
    single = np.float32(0.1).item()
    xs = [None, float("nan"), float("-inf"), -1.5, -0.0, 0.0, 1e-45, single, np.nextafter(np.float32(0.1), np.float32(1)).item(), 1.0, 1.5, 2.0, 3.0, 5.0, 7.0, float("inf")]
    names = [f"x{i}" for i in range(len(edges))]
    df = spark.createDataFrame([(i, *[x] * len(edges)) for i, x in enumerate(xs)], f"i int, {', '.join(f'{c} double' for c in names)}")
    fast = binning.apply_bins(df, names, edges)

    def below(x, some):
        x = np.float32(np.nan if x is None else x)
        return sum(1 for e in np.array(some, np.float32) if not np.isnan(e) and (np.isnan(x) or e < x))

    for r in fast.collect():
        assert list(r["bins"]) == [below(xs[r["i"]], e) for e in edges]
    scored = binning.apply_bins(df.select("i", "x0", "x3"), ["x0", "x3"], [edges[0], edges[3]])
    routed = Tree()
    a, b = routed.split(0, 0, 2, -0.7, 0.3)
    routed.split(a, 1, 0, 0.1, -0.2)
    scored = scored.withColumn("v", forest_value([routed, Tree([-1], [0], [-1], [-1], [0.25]), routed], F.col("bins")))
    for r in scored.collect():
        one = routed.value[routed.route(list(r["bins"]))]
        assert r["v"] == 0.0 + one + 0.25 + one
    assert "lambda" not in scored._jdf.queryExecution().toString()


def test_empty_and_odd_input(spark):
    empty = spark.createDataFrame([], "era int, a float, y double")
    booster = EraBooster(CONFIG).fit(empty, ["a"], "y", "era", num_rounds=1, log_metrics=False)
    assert booster.predict(empty).count() == 0 and len(booster.trees[0]) == 1
    odd = spark.createDataFrame([(0, float("nan"), 1.0), (0, 1.0, 2.0)], "era int, a float, y double")
    _, edges = binning.preprocess(odd, ["a"], 4)
    assert all(np.isnan(e) for e in edges[0])


def test_sources(spark, tmp_path):
    df, names = io.synthetic_regression(spark, 100, 3, 2)
    assert df.count() == 100 and names == ["f0", "f1", "f2"]
    train, test = io.key_split(df, "row_id")
    assert train.count() + test.count() == 100
    (tmp_path / "f.json").write_text('{"feature_sets": {"all": ["x", "y"]}}')
    assert io.read_feature_set(spark, str(tmp_path / "f.json")) == ["x", "y"]
    io.write_json_log(df.select("row_id"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 100
    assert [r[0] for r in io.first_rows(df, 2, ["row_id"]).select("row_id").collect()] == [0, 1]
    with pytest.raises(FileNotFoundError):
        io.dataset_path(str(tmp_path / "none"))


def test_exact_edges_are_those_of_numpy(spark):
    rng = np.random.default_rng(11)
    x = np.stack([rng.standard_normal(700), rng.integers(-3, 4, 700), np.exp(rng.normal(0, 20, 700)), np.where(rng.random(700) < 0.5, -0.0, 0.0)], 1).astype(np.float32)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a float, b float, c float, d float").repartition(5)
    for bins in (2, 7, 63):
        got = binning.quantile_edges(df, ["a", "b", "c", "d"], bins)
        want = np.quantile(x.astype(float), np.linspace(0, 1, bins + 1)[1:-1], axis=0).T
        assert np.allclose(got, want, rtol=1e-6, atol=0)
    stats = binning.order_statistics(df, ["a", "b"], lambda n: range(n))
    for i, (n, missing, values) in enumerate(stats):
        assert (n, missing) == (700, 0) and [values[k] for k in range(n)] == np.sort(x[:, i]).astype(float).tolist()


@pytest.mark.parametrize("value", [None, float("nan")])
def test_missing_values_are_last_and_leave_no_quantiles(spark, value):
    df = spark.createDataFrame([(1.0,), (2.0,), (value,), (3.0,)], "a float")
    (edges,) = binning.quantile_edges(df, ["a"], 4)
    assert all(np.isnan(e) for e in edges)
    assert [r[0] for r in binning.apply_bins(df, ["a"], [[1.5, 2.5]]).select(F.col("bins")[0]).collect()] == [0, 1, 2, 2]


@pytest.mark.parametrize("engine", ["arrow", "sql"])
def test_rows_without_a_target_take_no_part(spark, data, engine):
    df, *_ = data
    holes = df.withColumn("y", F.when(F.col("row_id") % 9 == 0, F.lit(None)).when(F.col("row_id") % 9 == 1, F.lit(float("nan"))).otherwise(F.col("y")))
    some = df.where(F.col("row_id") % 9 > 1)
    config = BoostConfig(pack_size=1, max_depth=2, max_bins=16, min_samples_leaf=5)
    a, b = (EraBooster(config, engine).fit(x, NAMES, "y", "era", eval_sets=[("e", x)], num_rounds=1) for x in (holes, some))
    assert len(a.trees[0]) == 7 and a.edges == b.edges and a.trees[0].feature == b.trees[0].feature and np.allclose(a.trees[0].value, b.trees[0].value)
    assert abs(a.history[0]["train_corr"] - b.history[0]["train_corr"]) < 1e-12 and abs(a.history[0]["e_corr"] - a.history[0]["train_corr"]) < 1e-12


def test_one_copy_of_the_rows_is_kept(spark, data, tmp_path):
    import os

    df, *_ = data
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    seen = []
    EraBooster(CONFIG, store_every=1).fit(df, NAMES, "y", "era", num_rounds=3, eval_sets=[("held", df)], round_callback=lambda *_: seen.append(len([x for x in set(os.listdir(base)) - before if x.startswith("erawood-")])))
    assert max(seen) == 2 and not [x for x in set(os.listdir(base)) - before if x.startswith("erawood-")]


def test_long_series_in_blocks(spark):
    from erawood.operators import features

    rng = np.random.default_rng(6)
    rows = [(i, int(d), None if rng.random() < 0.6 else float(rng.standard_normal())) for i, d in enumerate(rng.permutation(203))]
    df = spark.createDataFrame(rows, "row_id long, day int, x double").repartition(4)
    w = features.ordered("day")
    plain = {r["day"]: r for r in df.select("day", features.lag1(F.col("x"), w).alias("lag"), features.rolling_z(F.col("x"), w, 9, 2).alias("z"), *[features.fill(F.col("x"), w, h).alias(h) for h in ("ffill", "bfill", "ffill_bfill")]).collect()}
    got = features.over_series(df, lambda w: {"lag": features.lag1(F.col("x"), w), "z": features.rolling_z(F.col("x"), w, 9, 2)}, ["day"], 8, 10).collect()
    assert len(got) == 203 and got[0].__fields__ == ["row_id", "day", "x", "lag", "z"]
    for r in got:
        p = plain[r["day"]]
        assert r["lag"] == p["lag"] and (r["z"] is None) == (p["z"] is None) and (r["z"] is None or abs(r["z"] - p["z"]) < 1e-9)
    for how in ("ffill", "bfill", "ffill_bfill"):
        for r in features.fill_series(df, "x", how, ["day"], block=7).collect():
            assert r["filled"] == plain[r["day"]][how]
    with pytest.raises(ValueError):
        features.over_series(df, lambda w: {}, ["day"], 10, 10)


def test_market_columns(spark):
    from erawood.operators import features

    names = ["date_id", "M1", "D2", "is_scored", "forward_returns", "risk_free_rate", "lagged_forward_returns", "lagged_risk_free_rate", "lagged_market_forward_excess_returns"]
    df = spark.createDataFrame([], ", ".join(f"{c} double" for c in names))
    assert features.infer_columns(df) == ("date_id", "forward_returns", ["M1", "D2"])


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace as N

    from erawood.scratch import shared_dir

    folder = []
    session = lambda master: N(conf=N(get=lambda *_: None), sparkContext=N(master=master, getCheckpointDir=lambda: folder[0] if folder else None, setCheckpointDir=folder.append))
    with pytest.raises(RuntimeError):
        shared_dir(session("spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_dir(session("local-cluster[2,1,1000]"))
    assert shared_dir(session("local[4]")) == shared_dir(session("spark://host:7077"))


def test_adaptive_cuts_and_bundles_by_prefix(spark):
    assert [cuts.adaptive_k([n], 0, 30, 62) for n in (5, 20_000, 100_000)] == [7, 15, 30]
    assert cuts.adaptive_k([], 0, 30, 62) == 1 and cuts.adaptive_k([5], 1, 0, 62) == 62 and cuts.adaptive_k([5], 0, 2, 62) == 2 and cuts.adaptive_k([10**6], 2, 30, 62, 0.7) == 15
    df = spark.createDataFrame([(1.0, 0.0, 5.0, 0.0), (0.0, 2.0, 5.0, None), (0.0, 0.0, 5.0, 3.0)], "d_1 double, x double, other double, D_2 double")
    names = df.columns
    assert bundling.fit_bundles(df, names, ["d"]) == [[0, 3]] and bundling.fit_bundles(df, names, ["x"]) is None
    out, made = bundling.apply_bundles(df, names, [[0, 3]])
    assert made == ["x", "other", "EFB_b0:[d_1,D_2]"] and [r[2] for r in out.collect()] == [1.0, 0.0, 3.0]


def test_the_entry_module_does_without_the_text_operators(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    for gone in ("erawood.llm.queries", "erawood.llm"):
        monkeypatch.delitem(sys.modules, gone, raising=False)

    class Finder:
        @staticmethod
        def find_spec(name, path=None, target=None):
            if name.startswith("erawood.llm") or name == "xxhash_gone":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Finder, *sys.meta_path])
    assert entry._optional("erawood.llm.queries") is None
    with pytest.raises(ModuleNotFoundError):
        entry._optional("xxhash_gone")
    importlib.invalidate_caches()
