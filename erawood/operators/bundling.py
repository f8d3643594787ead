"""Exclusive feature bundling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _set(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) > 1e-8), F.lit(False))


def conflict_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows ``(f1, f2, n)``, f1 <= f2, of how many rows have both features not zero.

    Each row lists its non-zero features once and gives their pairs; sums are partial in each
    task. Meant for sparse features: a row with k of them gives k (k + 1) / 2 pairs.
    """
    on = F.filter(F.array(*[F.when(_set(c), F.lit(i)) for i, c in enumerate(features)]), lambda x: x.isNotNull())
    first = df.select(on.alias("on")).select("on", F.explode("on").alias("f1"))
    pairs = first.select("f1", F.explode(F.filter("on", lambda x: x >= F.col("f1"))).alias("f2"))
    return pairs.groupBy("f1", "f2").agg(F.count("*").alias("n"))


def greedy_bundles(conflicts: list[tuple[int, int, int]], n_features: int, max_size: int, max_conflicts: int) -> list[list[int]] | None:
    """Bundles of at most ``max_size`` features whose pairs conflict ``max_conflicts`` times at most.

    Features go from sparse to dense (ties by place) into the first bundle that takes them. None
    if there is at most one feature or none is ever set.
    """
    n = {(a, b): c for a, b, c in conflicts}
    density = [n.get((i, i), 0) for i in range(n_features)]
    if n_features <= 1 or not any(density):
        return None
    bundles: list[list[int]] = []
    for f in sorted(range(n_features), key=lambda i: (density[i], i)):
        home = next((b for b in bundles if len(b) < max_size and all(n.get((min(f, g), max(f, g)), 0) <= max_conflicts for g in b)), None)
        if home is None:
            bundles.append([f])
        else:
            home.append(f)
    return bundles


def prefixed(names: list[str], prefixes: list[str]) -> list[int]:
    """Places of the names that begin with one of the prefixes, in any case."""
    wanted = tuple(p.upper() for p in prefixes)
    return [i for i, name in enumerate(names) if name.upper().startswith(wanted)]


def fit_bundles(df: DataFrame, features: list[str], prefixes: list[str], max_size: int = 8, max_conflicts: int = 0) -> list[list[int]] | None:
    """Bundles, as places in ``features``, of the features with a prefix; None as ``greedy_bundles`` gives it."""
    chosen = prefixed(features, prefixes)
    if len(chosen) <= 1:
        return None
    counted = [(r["f1"], r["f2"], r["n"]) for r in conflict_matrix(df, [features[i] for i in chosen]).collect()]
    found = greedy_bundles(counted, len(chosen), max_size, max_conflicts)
    return None if found is None else [[chosen[i] for i in b] for b in found]


def bundle_name(i: int, names: list[str]) -> str:
    return f"EFB_b{i}:[{','.join(names)}]"


def apply_bundles(df: DataFrame, features: list[str], bundles: list[list[int]], keep: list[str] = ()) -> tuple[DataFrame, list[str]]:
    """``keep`` and a column for each bundle: the sum of its features, nulls and NaN as zero."""
    made = []
    for i, b in enumerate(bundles):
        names = [features[f] for f in b]
        total = sum((F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in names), F.lit(0.0))
        made.append(total.alias(bundle_name(i, names)))
    in_bundle = {f for b in bundles for f in b}
    rest = [c for i, c in enumerate(features) if i not in in_bundle]
    names = rest + [bundle_name(i, [features[f] for f in b]) for i, b in enumerate(bundles)]
    return df.select(*keep, *rest, *made), names
