"""Trees as plain arrays, their model table, and routing as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "round int, tree_id int, node_id int, feature int, threshold int, left int, right int, value double, is_leaf boolean"


@dataclass
class Tree:
    """Nodes by number; node 0 is the root, children come in pairs, -1 is no child."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def __len__(self) -> int:
        return len(self.value)

    def split(self, node: int, feature: int, threshold: int, left_value: float, right_value: float) -> tuple[int, int]:
        at = len(self)
        self.feature[node], self.threshold[node], self.left[node], self.right[node] = feature, threshold, at, at + 1
        for v in (left_value, right_value):
            self.feature.append(-1)
            self.threshold.append(0)
            self.left.append(-1)
            self.right.append(-1)
            self.value.append(v)
        return at, at + 1

    @property
    def depth(self) -> int:
        deep = [0] * len(self)
        for i, (a, b) in enumerate(zip(self.left, self.right)):
            if a >= 0:
                deep[a] = deep[b] = deep[i] + 1
        return max(deep)

    def rows(self, number: int, tree_id: int) -> list[tuple]:
        return [(number, tree_id, i, self.feature[i], self.threshold[i], self.left[i], self.right[i], self.value[i], self.left[i] < 0) for i in range(len(self))]

    def route(self, bins: list[int]) -> int:
        n = 0
        while self.left[n] >= 0:
            n = self.left[n] if bins[self.feature[n]] <= self.threshold[n] else self.right[n]
        return n


def _ints(xs: list[int]) -> Column:
    return F.array(*[F.lit(int(x)) for x in xs])


#: Trees of so many nodes at most are routed by compiled conditions.
SMALL = 255


def _conditions(tree: Tree, bins: Column, leaf) -> Column:
    """Nested conditions, which Spark compiles; ``leaf(node)`` is the result at a node without children."""

    def at(n: int) -> Column:
        if tree.left[n] < 0:
            return leaf(n)
        return F.when(F.get(bins, F.lit(tree.feature[n])) <= tree.threshold[n], at(tree.left[n])).otherwise(at(tree.right[n]))

    return at(0)


def node_of(tree: Tree, bins: Column) -> Column:
    """The leaf that a row's bins reach, without a join; large trees take one step for each level."""
    if len(tree) <= SMALL:
        return _conditions(tree, bins, F.lit)
    feature, threshold, left, right = (_ints(x) for x in (tree.feature, tree.threshold, tree.left, tree.right))

    def step(n, _):
        inner = F.get(left, n) >= 0
        below = F.get(bins, F.get(feature, n)) <= F.get(threshold, n)
        return F.when(inner, F.when(below, F.get(left, n)).otherwise(F.get(right, n))).otherwise(n)

    return F.aggregate(F.sequence(F.lit(1), F.lit(tree.depth)), F.lit(0), step)


def value_of(tree: Tree, bins: Column) -> Column:
    if len(tree) <= SMALL:
        return _conditions(tree, bins, lambda n: F.lit(float(tree.value[n])))
    return F.get(F.array(*[F.lit(float(v)) for v in tree.value]), node_of(tree, bins))


def forest_value(trees: list[Tree], bins: Column) -> Column:
    """The sum of the trees' values: compiled conditions for few nodes, else one expression over a literal array of trees."""
    if not trees:
        return F.lit(0.0)
    if sum(map(len, trees)) <= SMALL:
        return sum((value_of(t, bins) for t in trees), F.lit(0.0))
    deepest = max(t.depth for t in trees)
    held = F.array(*[
        F.struct(_ints(t.feature).alias("f"), _ints(t.threshold).alias("t"), _ints(t.left).alias("l"), _ints(t.right).alias("r"), F.array(*[F.lit(float(v)) for v in t.value]).alias("v"))
        for t in trees
    ])

    def add(total, t):
        def step(n, _):
            below = F.get(bins, F.get(t["f"], n)) <= F.get(t["t"], n)
            return F.when(F.get(t["l"], n) < 0, n).when(below, F.get(t["l"], n)).otherwise(F.get(t["r"], n))

        leaf = F.aggregate(F.sequence(F.lit(1), F.lit(deepest)), F.lit(0), step) if deepest else F.lit(0)
        return total + F.get(t["v"], leaf)

    return F.aggregate(held, F.lit(0.0), add)


def model_table(spark: SparkSession, trees: list[Tree], pack_size: int) -> DataFrame:
    """The model as rows; the equal trees of a round are written ``pack_size`` times."""
    return spark.createDataFrame([r for i, t in enumerate(trees) for b in range(pack_size) for r in t.rows(i, i * pack_size + b)], MODEL)


def from_model_table(model: DataFrame) -> list[Tree]:
    """The first tree of each round of a model table."""
    trees: dict[int, Tree] = {}
    for r in model.orderBy("round", "tree_id", "node_id").collect():
        t = trees.setdefault(r["round"], Tree([], [], [], [], []))
        if len(t) != r["node_id"]:
            continue
        for name, x in zip(("feature", "threshold", "left", "right", "value"), (r["feature"], r["threshold"], r["left"], r["right"], r["value"])):
            getattr(t, name).append(x)
    return [trees[k] for k in sorted(trees)]
