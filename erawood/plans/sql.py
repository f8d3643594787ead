"""SQL for the catalogue's queries, written apart from the DataFrame code."""

from __future__ import annotations

import re

from erawood.operators.booster import sampled_features

BINS, L2, DRO, WAY, LEAST, RATE, PACK = 16, 1.0, 0.2, 0.05, 50, 0.1, 2
QS = "[" + ", ".join(repr(i / BINS) for i in range(1, BINS)) + "]"
X = ["l_quantity", "l_extendedprice", "l_discount"]

TRAIN = """t as (select l_quantity, l_extendedprice, l_discount, l_tax, year(l_shipdate)::int era,
                 l_tax * 10 - l_discount * 2 + l_quantity / 100 y from lineitem)"""
EDGES = "ed as (select " + ", ".join(f"list_transform(quantile_cont({c}::float::double, {QS}), lambda q: q::float) e{i}" for i, c in enumerate(X)) + " from t)"
BINNED = "b as (select era, y, [" + ", ".join(f"len(list_filter(e{i}, lambda q: q < {c}::float))" for i, c in enumerate(X)) + "] bins from t, ed)"
BASE = f"with {TRAIN}, {EDGES}, {BINNED}"
LONG = "l as (select 0 node_id, era, -y grad, unnest([0, 1, 2]) feature, unnest(bins) bin from b)"
HIST = "h as (select node_id, feature::int feature, era, bin::int bin, count(*) cnt, sum(grad) g from l group by all)"
GRID = f"d as (select k.node_id, k.feature, k.era, r.bin::int bin, coalesce(cnt, 0) cnt, coalesce(g, 0) g from (select distinct node_id, feature, era from h) k cross join range({BINS}) r(bin) left join h using (node_id, feature, era, bin))"
SCAN = f"""p as (select node_id, feature, era, bin thr, sum(cnt) over w::bigint lc, sum(g) over w lg,
   sum(cnt) over (partition by node_id, feature, era)::bigint tc, sum(g) over (partition by node_id, feature, era) tg
   from d window w as (partition by node_id, feature, era order by bin)
   qualify bin < {BINS - 1})"""
GAIN = f"""s as (select *, lc > 0 and tc > lc valid,
   case when lc > 0 and tc > lc then 0.5 * (lg * lg / (lc + {L2}) + (tg - lg) * (tg - lg) / (tc - lc + {L2}) - tg * tg / (tc + {L2})) end gain,
   case when lc > 0 and tc > lc then case when -lg / (lc + {L2}) > -(tg - lg) / (tc - lc + {L2}) then 1.0::double else -1.0::double end end direction from p)"""
ALPHA = 1.5
SCORE = f"""c as (select node_id, feature, thr, coalesce(avg(gain), 0) mean, coalesce(stddev_pop(gain), 0) std, coalesce(avg(direction), 0) agreement,
   round(coalesce(avg(gain), 0) - {DRO} * coalesce(stddev_pop(gain), 0) + {WAY} * coalesce(avg(direction), 0), 10) score,
   sum(lc)::bigint lc, sum(lg) lg, sum(tc)::bigint tc, sum(tg) tg from s group by all)"""
BEST = f"""best as (select *, tg - lg rg, tc - lc rc from c where lc >= {LEAST} and tc - lc >= {LEAST}
   qualify row_number() over (partition by node_id order by score desc, lc desc, feature desc, thr desc) = 1)"""
#: The same scores with eras weighted by their rows and ALPHA.
WEIGHTED = f"""c as (select node_id, feature, thr, coalesce(sum(w * gain) / sum(w), 0) mean, sqrt(greatest(0, coalesce(sum(w * gain * gain) / sum(w) - (sum(w * gain) / sum(w)) ** 2, 0))) std,
   coalesce(sum(w * direction) / sum(w), 0) agreement, round(mean - {DRO} * std + {WAY} * agreement, 10) score,
   sum(lc)::bigint lc, sum(lg) lg, sum(tc)::bigint tc, sum(tg) tg from (select *, case when valid then tc + {ALPHA} end w from s) group by all)"""


def even(k: int) -> str:
    """Thresholds evenly over all, halves away from zero, as a subquery."""
    return f"(select distinct floor({BINS - 2} * i::double / {k - 1} + 0.5)::int thr from range({k}) x(i))"


def mass(k: int) -> list[str]:
    """CTEs for the thresholds ``kc`` of about equal masses over all nodes and eras; short lists are completed by even ones."""
    return [
        "n as (select feature, bin, sum(cnt)::bigint n from d group by all)",
        "u as (select feature, bin, sum(n) over (partition by feature order by bin) upto, sum(n) over (partition by feature) total from n)",
        f"q as (select distinct feature, least(greatest(min(bin) - 1, 0), {BINS - 2})::int thr from u, range({k}) x(i) where upto >= total * (1 - 1e-12) * i / {k - 1} group by feature, i)",
        "y as (select feature, count(*) held from q group by 1)",
        f"z as (select distinct feature, thr from (select feature, thr from q union all select y.feature, e.thr from y y, {even(k)} e where y.held < {k}))",
        f"kc as (select feature, thr from z qualify row_number() over (partition by feature order by thr) <= {k})",
    ]


def among(score: str, cuts: str) -> str:
    """The scores of the candidates of ``cuts`` alone."""
    return score.replace("from s group by all", f"from s join {cuts} group by all")


TO_HIST = f"{BASE}, {LONG}, {HIST}"
TO_SCAN = f"{TO_HIST}, {GRID}, {SCAN}"
TO_SCORE = f"{TO_SCAN}, {GAIN}, {SCORE}"
ROOT = f"""{TO_SCORE}, {BEST} select node_id, feature, thr threshold, round(score, 4) + 0.0 score, lc left_count, rc right_count,
   round(-lg / (lc + {L2}), 6) + 0.0 left_value, round(-rg / (rc + {L2}), 6) + 0.0 right_value from best"""


def fit_sql(rounds: int, tail: str, depth: int = 2, train: str = TRAIN, score: str = SCORE, extra: list[str] = (), features: list[list[int]] | None = None, rate: float = RATE * PACK) -> str:
    """A chain of CTEs for whole rounds; ``m`` has the nodes and ``f`` the rows with predictions.

    ``extra`` CTEs stand before the scores; ``features`` are those of each depth, all if None.
    """
    ctes = [train, EDGES, BINNED, "f0 as (select era, y, bins, 0.0::double pred from b)"]
    for r in range(rounds):
        ctes.append(f"r{r}d0 as (select *, 0 node, pred - y grad from f{r})")
        nodes = [f"select {r} round, 0 node_id, -sum(grad) / (count(*) + {L2}) v from r{r}d0"]
        for d in range(depth):
            u = f"r{r}d{d}"
            ren = lambda text, u=u: _renamed(text, u)
            ctes.append(f"l_{u} as (select node node_id, era, grad, unnest([0, 1, 2]) feature, unnest(bins) bin from {u} where node in (select node from {u} group by 1 having count(*) >= {2 * LEAST}) and node >= 0)")
            if features is not None:
                ctes[-1] = f"l_{u} as (select * from ({ctes[-1].split(' as ', 1)[1]}) where feature in ({', '.join(map(str, features[d]))}))"
            ctes += [ren(x) for x in (HIST, GRID, *extra, SCAN, GAIN, score, BEST)]
            start = f"(select coalesce(max(n), 0) from ids_{r}_{d - 1})" if d else "0"
            ctes.append(f"k_{u} as materialized (select *, {start} + 2 * row_number() over (order by node_id) - 1 lft from best_{u})")
            ctes.append(f"ids_{r}_{d} as (select coalesce(max(lft + 1), {start}) n from k_{u})")
            ctes.append(f"r{r}d{d + 1} as (select era, y, bins, pred, grad, case when k.lft is null then -1 when bins[k.feature + 1] <= k.thr then k.lft else k.lft + 1 end node from {u} left join k_{u} k on k.node_id = {u}.node)")
            nodes += [f"select {r}, lft, -lg / (lc + {L2}) from k_{u}", f"select {r}, lft + 1, -rg / (rc + {L2}) from k_{u}"]
        ctes.append(f"v{r} as (select round, node_id::int node_id, v from ({' union all '.join(nodes)}))")
        splits = " union all ".join(f"select node_id, feature, thr, lft from k_r{r}d{d}" for d in range(depth))
        ctes.append(f"sp{r} as ({splits})")
        # rows of f{r} routed from the root: a split's node is left as soon as it is met
        step = f"f{r}"
        ctes.append(f"w{r}_0 as (select *, 0 nd from {step})")
        for d in range(depth):
            ctes.append(f"w{r}_{d + 1} as (select w.* exclude (nd), case when s.lft is null then w.nd when bins[s.feature + 1] <= s.thr then s.lft else s.lft + 1 end nd from w{r}_{d} w left join sp{r} s on s.node_id = w.nd)")
        ctes.append(f"f{r + 1} as (select w.era, w.y, w.bins, w.pred + {rate} * v.v pred from w{r}_{depth} w join v{r} v on v.node_id = w.nd)")
    model = " union all ".join(
        f"select v.round::int round, v.node_id, coalesce(s.feature, -1)::int feature, coalesce(s.thr, 0)::int threshold, coalesce(s.lft, -1)::int \"left\", coalesce(s.lft + 1, -1)::int \"right\", round(v.v, 5) + 0.0 \"value\", s.lft is null is_leaf from v{r} v left join sp{r} s on s.node_id = v.node_id"
        for r in range(rounds)
    )
    ctes.append(f"m as ({model})")
    return "with " + ", ".join(ctes) + " " + tail.format(last=rounds)


def _renamed(text: str, u: str) -> str:
    """The CTE chain l, h, d, p, s, c, best under names of one round and depth."""
    name, body = text.split(" as (", 1)
    for old in ("l", "h", "d", "p", "s", "c", "n", "u", "q", "y", "z", "kc"):
        body = re.sub(rf"\b(from|join) {old}\b", rf"\1 {old}_{u}", body)
    return f"{name}_{u} as ({body}"


def _series(expr: str, name: str, digits: int = 8) -> str:
    return f"with e as (select event_id, ts, case when event_id % 7 <> 0 then value end x from events) select event_id, round({expr}, {digits}) {name} from e"


W = "order by ts, event_id"
RETURNS = "r as (select event_id, (value - 50) / 5000 fr, 0.0001::double rf, value / 100 - 0.5 raw from events)"
POS = "q as (select *, greatest(0, least(2, 1 + raw)) pos from r)"
PREDICTED = f"with {TRAIN}, o as (select *, l_quantity / 50 - l_discount p from t)"
CORR = "e as (select era, case when count(*) >= 2 and stddev_pop(y) > 1e-12 and stddev_pop(p) > 1e-12 then covar_pop(y, p) / (stddev_pop(y) * stddev_pop(p)) end corr from o group by era)"
SPARSE = "z as (select event_id, value, [event_id % 5 = 0, event_id % 5 = 1, event_id % 7 = 0, event_id % 5 = 2] on_ from events)"
FIXED = """case when bins[1] <= 7 then case when bins[2] <= 4 then {0} else {1} end else case when bins[3] <= 3 then {2} else {3} end end"""
ERAS = "e as (select era, row_number() over (order by era) - 1 code, count(*) over () n from (select distinct era from t))"

DIMENSIONS = 64
MISSING_EDGES = [10.0, 25.0, 50.0, 75.0]
MODEL = "select * from m"
TWO_NODES = "l as (select case when bins[1] <= 7 then 1 else 2 end node_id, era, -y grad, unnest([0, 1, 2]) feature, unnest(bins) bin from b)"
NODE_SCORE = f"{BASE}, {TWO_NODES}, {HIST}, {GRID}, {SCAN}, {GAIN}, {SCORE}, {BEST}"
DECISION = ROOT.split(f"{BEST} ")[1]
MASS_MODEL = fit_sql(1, MODEL, score=among(SCORE, "kc using (feature, thr)"), extra=mass(5))
NULL_TRAIN = TRAIN.replace("from lineitem", "from lineitem where l_quantity::int % 7 <> 0")
NULL_MODEL = fit_sql(1, MODEL, train=NULL_TRAIN)
MARKET = """mk as (select event_id row_id, (event_id % 400)::int date_id, (value - 50) / 5000 fr, 0.0001::double rf, value m1 from events)"""


def _bin_list(column: str, edges: str) -> str:
    return f"len(list_filter({edges}, lambda q: q < {column}::float))::int"


def _fit_corr(rounds: int) -> str:
    """Mean era correlation of the predictions after each round, by name."""
    each = " union all ".join(
        f"select {r}::int round, avg(c) v from (select case when count(*) >= 2 and stddev_pop(y) > 1e-12 and stddev_pop(pred) > 1e-12 then covar_pop(y, pred) / (stddev_pop(y) * stddev_pop(pred)) end c from f{r + 1} group by era)"
        for r in range(rounds)
    )
    return fit_sql(rounds, f"select round, name, round(v, 5) + 0.0 \"value\" from ({each}) cross join (values ('train_corr'), ('held_corr')) x(name)")


def _depths(tail: str) -> str:
    """Of the depths of one round: nodes that were searched, nodes that were split, rows of these."""
    each = " union all ".join(f"select 0::int round, {d}::int depth, (select count(distinct node_id) from l_r0d{d}) nodes_processed, (select count(*) from k_r0d{d}) nodes_split, (select sum(lc + rc)::bigint from k_r0d{d}) n_rows" for d in range(2))
    return fit_sql(1, tail.replace("DEPTHS", f"({each})"))


ORACLE_SQL = {
    "quantile_edges": f"with {TRAIN}, {EDGES} select feature::int feature, (i - 1)::int i, e[i]::double edge from (select unnest([0, 1, 2]) feature, unnest([e0, e1, e2]) e from ed), range(1, {BINS}) x(i)",
    "bin_counts": f"{BASE}, {LONG} select feature::int feature, bin::int bin, count(*) n from l group by all",
    "prebinned_check": "select 'labels_2' name, true prebinned union all select 'labels_1', false union all select 'part_64', (select max(p_size) < 64 and min(p_size) >= 0 from part)",
    "embedding_bins": "with v as (select vec_id, embedding e from embeddings), q as (select " + ", ".join(f"list_transform(quantile_cont(e[{i + 1}]::double, {[k / 8 for k in range(1, 8)]}), lambda x: x::float) q{i}" for i in range(DIMENSIONS)) + " from v) select vec_id, " + ", ".join(f"len(list_filter(q{i}, lambda x: x < e[{i + 1}]))::int b{i}" for i in range(DIMENSIONS)) + " from v, q",
    "missing_bins": f"select event_id, case when event_id % 5 < 2 then {len(MISSING_EDGES)} else {_bin_list('value', str(MISSING_EDGES) + '::float[]')} end::int bin from events",
    "missing_edges": f"with q as (select list_transform(quantile_cont(value::float::double, [0.25, 0.5, 0.75]), lambda x: x::float) q from events) select event_id, 0::int b0, {_bin_list('value', 'q')} b1 from events, q",
    "distinct_eras": "with e as (select (event_id % 400)::int d from events) select 'raw' eras, count(distinct d) n from e union all select 'bucketed', count(distinct (d - (select min(d) from e)) // 30) from e",
    "era_encode": f"with {TRAIN} select era, (dense_rank() over (order by era) - 1)::int era_code, n from (select era, count(*) n from t group by 1)",
    "era_bucket": "with d as (select date_diff('day', date '1990-01-01', o_orderdate::date) x from orders) select ((x - (select min(x) from d)) // 180)::int era_bucket, count(*) n from d group by 1",
    "era_floor": "select (o_orderkey // 512)::int era, count(*) n from orders group by 1",
    "era_index": "select (vec_id % 8)::int era, count(*) n, string_agg(vec_id::varchar, ',' order by vec_id) \"rows\" from embeddings group by 1",
    "era_weights": f"with {TRAIN} select era, 1.0::double w0, count(*) + 1.5::double w15 from t group by era",
    "single_era": "select 0 era, count(*) n from lineitem",
    "grad_hist": f"{TO_HIST} select node_id, feature, era, bin, cnt, round(g, 6) + 0.0 g from h",
    "grad_hist_arrow": f"{TO_HIST} select node_id, feature, era, bin, cnt, round(g, 6) + 0.0 g from h",
    "dense_grid": f"{TO_HIST}, {GRID} select feature, era, bin, cnt, round(g, 6) + 0.0 g from d",
    "prefix_scan": f"{TO_SCAN} select feature, era, thr, lc, round(lg, 6) + 0.0 lg, tc, round(tg, 6) + 0.0 tg from p",
    "reverse_scan": f"{TO_SCAN} select feature, era, thr, tc - lc rc, round(tg - lg, 6) + 0.0 rg from p",
    "node_totals": f"{BASE} select 0 node_id, era, count(*) n, round(sum(-y), 6) + 0.0 g from b group by era",
    "parent_gain": f"{BASE} select era, round(0.5 * sum(y) * sum(y) / (count(*) + 1.0), 6) gain from b group by era",
    "even_cuts": "with k(bins, k, n) as (values (63, 3, 3), (16, 5, 5), (16, 0, 15), (8, 20, 7)) select distinct bins, k, floor((bins - 2) * i::double / (n - 1) + 0.5)::int thr from k, range(20) x(i) where i < n",
    "mass_cuts": f"{TO_HIST}, {GRID}, {', '.join(mass(5))} select feature, thr from kc",
    "adaptive_cuts": f"""with {TRAIN}, r as (select quantile_disc(n, 0.5) med from (select count(*) n from t group by era)),
        g as (select * from (values (0), (2), (5), (30)) a(k), (values (0), (3)) b(depth), (values (1.0::double), (0.7::double)) c(decay)),
        h as (select g.*, case when med >= 100000 then k when med >= 20000 then least(k, 15) else least(k, 7) end lim from g, r)
        select k::int k, depth::int depth, decay, case when k = 0 then 62 else greatest(1, least(62, case when depth > 0 then round_even(lim * decay ** depth, 0) else lim end)) end::int cuts from h""",
    "era_gain": f"{TO_SCAN}, {GAIN} select feature, era, thr, valid, round(gain, 5) + 0.0 gain, direction, 1.0::double w from s",
    "des_score": f"{TO_SCORE} select feature, thr, round(mean, 5) + 0.0 mean, round(std, 4) + 0.0 std, round(agreement, 6) + 0.0 agreement, round(score, 4) + 0.0 score, lc, tc from c",
    "des_mean_std": f"{TO_SCORE} select feature, thr, round(mean, 5) + 0.0 mean, round(std, 4) + 0.0 std from c",
    "direction": f"{TO_SCAN}, {GAIN}, {WEIGHTED} select feature, thr, round(agreement, 6) + 0.0 agreement from c",
    "best_split_depth1": f"{NODE_SCORE} {DECISION}",
    "best_split_mass": f"{BASE}, {TWO_NODES}, {HIST}, {GRID}, {', '.join(mass(5))}, {SCAN}, {GAIN}, {among(SCORE, 'kc using (feature, thr)')}, {BEST} {DECISION}",
    "best_split_node": f"{NODE_SCORE} {DECISION} where node_id = 2",
    "rescored_splits": f"{NODE_SCORE} select node_id, round(score, 4) + 0.0 score, round(score, 4) + 0.0 recomputed from best",
    "leaf_values": f"{TO_SCORE}, {BEST} select node_id, round(-lg / (lc + {L2}), 6) + 0.0 left_value, round(-rg / (rc + {L2}), 6) + 0.0 right_value, round((select sum(y) / (count(*) + {L2}) from b), 6) + 0.0 root_value from best",
    "best_split_root": ROOT,
    "best_split_arrow": ROOT,
    "fit_one_round": fit_sql(1, MODEL),
    "fit_sql_engine": fit_sql(1, MODEL),
    "fit_two_rounds": fit_sql(2, MODEL),
    "fit_depth_three": fit_sql(1, MODEL, depth=3),
    "fit_mass_cuts": MASS_MODEL,
    "fit_mass_cuts_sql_engine": MASS_MODEL,
    "fit_even_cuts": fit_sql(1, MODEL, score=among(SCORE, f"{even(4)} e using (thr)")),
    "fit_era_alpha": fit_sql(1, MODEL, score=WEIGHTED),
    "fit_mean_update": fit_sql(2, MODEL, rate=RATE),
    "fit_single_era": fit_sql(1, MODEL, train=TRAIN.replace("year(l_shipdate)::int era", "0 era")),
    "fit_null_targets": NULL_MODEL,
    "fit_null_targets_sql_engine": NULL_MODEL,
    "fit_sampled_features": fit_sql(1, MODEL, features=[sampled_features(3, 0.67, 3, 0, d) for d in range(2)]),
    "train_equals_predict": fit_sql(2, "select count(*) n, 0::bigint n_apart, round(sum(pred), 3) total from f{last}"),
    "trees_property": fit_sql(2, f"select (round * {PACK} + i)::int tree, n::int nodes, (case when n = 1 then 0 when n = 3 then 1 else 2 end)::int depth from (select round, count(*) n from m group by 1), range({PACK}) x(i)"),
    "fit_predict": fit_sql(2, "select era, round(pred, 4) prediction, count(*) n from f{last} group by all"),
    "predict_packwise": fit_sql(2, "select era, round(pred, 4) prediction, count(*) n from f{last} group by all"),
    "predict_tree": f"{BASE} select era, {FIXED.format('1.0::double', '2.0::double', '3.0::double', '4.0::double')} \"value\", count(*) n from b group by all",
    "predict_forest": f"{BASE} select round(0.2 * {FIXED.format('1.0::double', '2.0::double', '3.0::double', '4.0::double')}, 6) \"value\", count(*) n from b group by all",
    "partition_rows": f"{BASE} select {FIXED.format(3, 4, 5, 6)} node_id, era, count(*) n from b group by all",
    "era_corr": f"{PREDICTED}, {CORR} select era, round(corr, 6) + 0.0 corr from e",
    "era_metrics": f"{PREDICTED}, {CORR} select round(avg(corr), 6) + 0.0 mean_corr, round(case when count(corr) > 1 and stddev_pop(corr) > 0 then avg(corr) / stddev_pop(corr) end, 4) + 0.0 corr_sharpe, count(corr) n_eras from e",
    "r2": f"{PREDICTED} select round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) + 0.0 r2 from o",
    "mse": f"{PREDICTED} select round(avg((y - p) * (y - p)), 6) + 0.0 mse, round(var_pop(y), 6) + 0.0 variance from o",
    "ann_sharpe": f"with {RETURNS} select round(sqrt(252.0) * avg(fr) / stddev_pop(fr), 6) sharpe from r",
    "signal_clip": f"with {RETURNS}, {POS} select event_id, round(pos, 9) \"position\" from q",
    "penalised_sharpe": f"""with {RETURNS}, {POS}, a as (select count(*) n, sum(ln(1 + (rf * (1 - pos) + pos * fr) - rf)) ls, sum(ln(1 + fr - rf)) lm,
        stddev_samp(rf * (1 - pos) + pos * fr) sd, stddev_samp(fr) msd from q),
        k as (select exp(ls / n) - 1 m, exp(lm / n) - 1 mm, sd, msd from a)
        select round(least(1e6, m / sd * sqrt(252.0) / (1 + greatest(0, sd / msd - 1.2)) / (1 + power(greatest(0, (mm - m) * 25200), 2) / 100)), 5) + 0.0 score from k""",
    "last_n_metrics": f"""with {MARKET}, x as (select *, greatest(0, least(2, 1 + m1 / 100 - 0.5)) pos from mk where date_id in (select distinct date_id from mk order by 1 desc limit 30) and date_id not in (select date_id from mk where date_id < 390 and date_id <> 385)),
        a as (select count(*) n, sqrt(252.0) * avg(pos * (fr - rf)) / stddev_pop(pos * (fr - rf)) sharpe, sum(ln(1 + (rf * (1 - pos) + pos * fr) - rf)) ls, sum(ln(1 + fr - rf)) lm, stddev_samp(rf * (1 - pos) + pos * fr) sd, stddev_samp(fr) msd from x),
        k as (select n, sharpe, exp(ls / n) - 1 m, exp(lm / n) - 1 mm, sd, msd from a)
        select n n_rows, round(sharpe, 5) + 0.0 last_n_sharpe, round(least(1e6, m / sd * sqrt(252.0) / (1 + greatest(0, sd / msd - 1.2)) / (1 + power(greatest(0, (mm - m) * 25200), 2) / 100)), 5) + 0.0 penalised_sharpe from k""",
    "result_table": f"{PREDICTED}, {CORR} select rpad('era ' || era, 12, ' ') || ' ' || lpad(case when era = 1995 then 'n/a' else printf('%.4f', round(corr, 6) + 0.0) end, 10, ' ') line from e",
    "rank_pct": "select p_partkey, round((rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0) / count(*) over (), 9)::double rank_pct from part",
    "lag1": _series(f"lag(x) over ({W})", "lag1"),
    "rolling_z": _series(f"case when count(x) over w >= 5 and stddev_pop(x) over w > 0 then (x - avg(x) over w) / stddev_pop(x) over w end", "z") + f" window w as ({W} rows between 20 preceding and current row)",
    "momentum": _series("case when count(x) over w >= 10 then x - avg(x) over w end", "momentum") + f" window w as ({W} rows between 62 preceding and current row)",
    "ffill": _series(f"last_value(x ignore nulls) over ({W} rows between unbounded preceding and current row)", "filled"),
    "bfill": _series(f"first_value(x ignore nulls) over ({W} rows between current row and unbounded following)", "filled"),
    "ffill_bfill": _series(f"coalesce(last_value(x ignore nulls) over ({W} rows between unbounded preceding and current row), first_value(x ignore nulls) over ({W} rows between current row and unbounded following))", "filled"),
    "engineer_features": f"""select event_id, round(lag(value) over o, 8) value_lag1,
        round(case when count(value) over a >= 5 and stddev_pop(value) over a > 0 then (value - avg(value) over a) / stddev_pop(value) over a end, 8) value_z21,
        round(case when count(value) over b >= 10 then value - avg(value) over b end, 8) value_mom63 from events
        window o as (partition by user_id {W}), a as (partition by user_id {W} rows between 20 preceding and current row), b as (partition by user_id {W} rows between 62 preceding and current row)""",
    "inf_to_null": "select event_id, case when event_id % 5 > 1 then value end x from events",
    "excess_target": f"with {RETURNS} select event_id, round(fr - rf, 9) target from r",
    "null_target_filter": "select count(*) n, round(sum(value), 4) total from events where event_id % 7 <> 0",
    "type_casts": "select l_quantity::smallint q, count(*) n from lineitem group by 1",
    "column_inference": "select * from (values ('era', 'era'), ('target', 'target'), ('feature', 'l_quantity'), ('feature', 'l_extendedprice'), ('feature', 'l_discount'), ('feature', 'l_tax')) x(role, name)",
    "market_columns": "select * from (values ('era', 'date_id'), ('target', 'market_forward_excess_returns'), ('feature', 'M1'), ('feature', 'MOM_2'), ('feature', 'D1'), ('of_groups', 'MOM_2'), ('of_groups', 'D1')) x(role, name)",
    "dir_agreement": f"with {TRAIN}, x as (select y - 0.4 y, unnest(['l_quantity', 'l_extendedprice', 'l_discount']) feature, unnest([l_quantity, l_extendedprice, l_discount]) x from t), a as (select feature, avg(x) m from x group by 1) select feature, round(avg(case when sign(x - m) = sign(y) then 1.0 else 0.0 end), 6) + 0.0 agreement from x join a using (feature) where y <> 0 group by 1",
    "top_corr": f"with {TRAIN}, x as (select y, unnest([0, 1, 2, 3]) place, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) x from t) select feature, place::int place, round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) + 0.0 corr from x group by 1, 2 order by abs(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y))) desc limit 3",
    "temporal_holdout": f"with {TRAIN}, {ERAS} select case when code >= n - least(2, greatest(1, n - 1)) then 'test' else 'train' end role, t.era, count(*) n from t join e using (era) group by all",
    "row_holdout": "select event_id from (select event_id, row_number() over (order by ts, event_id) r, count(*) over () n from events) where r > n - greatest(1, round(0.1 * n))",
    "cv_folds": f"with {TRAIN}, {ERAS}, g as (select era, code, n, f, n - (3 - f) * (n // 4) st, n // 4 sz from e, range(3) x(f)) select f::int fold, era, case when code >= st then 'test' else 'train' end role from g where (code >= st and code < st + sz) or code < st - 1",
    "last_n": "select strftime(ts, '%Y-%m-%d') \"day\", count(*) n from events where ts::date in (select distinct ts::date from events order by 1 desc limit 5) group by 1",
    "conflict_matrix": f"with {SPARSE} select (i - 1)::int f1, (j - 1)::int f2, count(*) n from z, range(1, 5) a(i), range(1, 5) c(j) where i <= j and on_[i] and on_[j] and abs(value) > 1e-8 group by all",
    "bundle_transform": f"with {SPARSE}, v as (select event_id, list_transform(on_, lambda o: case when o then value else 0.0 end) v from z) select event_id, list_aggregate(list_sort([printf('%.4f', v[3]), printf('%.4f', v[1] + v[2] + v[4])]), 'string_agg', ',') sums from v",
    "bundle_prefix": f"with {SPARSE} select event_id, 2::int \"columns\", case when on_[3] then value else 0.0 end alone, round(case when on_[1] or on_[2] or on_[4] then value else 0.0 end, 6) bundle from z",
    "key_split": "select o_orderkey, case when ('0x' || substr(md5(o_orderkey::varchar), 1, 8))::bigint % 1000 < 200 then 'test' else 'train' end part from orders",
    "depth_log": _depths("select round, sum(nodes_processed)::bigint nodes_processed, sum(nodes_split)::bigint nodes_split, max(n_rows) most_rows from DEPTHS group by 1"),
    "json_log": _depths("select round, depth, nodes_processed, nodes_split from DEPTHS"),
    "round_log": _fit_corr(2),
    "csv_projection": "select count(*) n_rows, sum((p_size > 25)::int)::bigint n_scored from part",
    "row_cap": "select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 100",
    "feature_set": "select column_name \"name\" from (describe lineitem) where column_type = 'DOUBLE'",
    "parquet_projection": "select n_nationkey, n_regionkey from nation",
    "json_features": "select (props ->> '$.k')::int k, count(*) n from events group by 1",
    "csv_roundtrip": "select p_partkey, p_size from part",
}
