"""Calibration: radii by place and isolation, resolutions by neighbour distances and trees."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from novelspark.functions import metrics
from novelspark.plans import epsjoin
from novelspark.plans.ordered import before, ranged
from novelspark.plans.shared import stored


def poincare_embed(x: Column, specificity: Column, low: float = 0.05, high: float = 0.9) -> Column:
    """The unit direction of x, at a radius between low and high by specificity (0 to 1)."""
    radius = F.lit(low) + F.lit(high - low) * specificity
    return metrics.let(F.sqrt(metrics.squared_norm(x)), lambda norm: F.transform(x, lambda v: F.when(norm > 0, v / norm * radius).otherwise(0.0)))


def radii(z: Column, score: Column, base: float, gamma: float, decay: float, low: float, high: float, margin: Column | None = None, safety: float = 0.5) -> Column:
    """base (1 - |z|^2)^gamma exp(-decay score), kept in [low, high], then at most safety * margin."""
    r = F.lit(base) * F.pow(F.greatest(F.lit(0.0), 1 - metrics.squared_norm(z)), F.lit(gamma)) * F.exp(-F.lit(decay) * score)
    r = F.least(F.greatest(r, F.lit(low)), F.lit(high))
    return r if margin is None else F.least(r, F.lit(safety) * margin)


def frequency_radius(frequency: Column, base: float, gamma: float) -> Column:
    """base (1 + exp(-gamma frequency)): rarer means wider."""
    return F.lit(base) * (1 + F.exp(-F.lit(gamma) * frequency))


def k_distances(points: DataFrame, distance: str, k: int) -> DataFrame:
    """i, distance: to the k-th nearest other point (k at most n - 1)."""
    k = max(1, min(k, points.count() - 1))
    right = points.select(F.col("i").alias("j"), F.col("x").alias("y"))
    return epsjoin.nearest(points, right, distance, k=k, other=True).where(F.col("rank") == k).select("i", F.col("d").alias("distance"))


def knee(curve: DataFrame, value: str) -> DataFrame:
    """epsilon: the value of a sorted curve furthest from its chord, ends left out; the first
    value if the curve is flat or has fewer than three points."""
    stats = curve.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n")).first()
    if not stats["n"] or stats["n"] < 3 or stats["high"] <= stats["low"]:
        return curve.agg(F.min(value).alias("epsilon"))
    # of equal values the first and the last place count, so one row a value is enough
    per = stored(curve.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c")), "curve")
    per = before(ranged(per, "v"), [], ["v"], F.col("c"), "sum", "r").withColumn("r", F.coalesce("r", F.lit(0)))
    ends = per.select("v", F.explode(F.array(F.greatest("r", F.lit(1)), F.least(F.col("r") + F.col("c") - 1, F.lit(stats["n"] - 2)))).alias("p"), "r", "c")
    ends = ends.where((F.col("p") >= F.col("r")) & (F.col("p") < F.col("r") + F.col("c")))
    gap = F.abs((F.col("v") - stats["low"]) / (stats["high"] - stats["low"]) - F.col("p") / (stats["n"] - 1))
    return ends.withColumn("gap", gap).orderBy(F.desc("gap"), "p").limit(1).select(F.col("v").alias("epsilon"))


def specificity(points: DataFrame, k: int = 8) -> DataFrame:
    """i, specificity: the rank (0 to 1) of one minus the mean similarity of the k nearest."""
    right = points.select(F.col("i").alias("j"), F.col("x").alias("y"))
    near = epsjoin.nearest(points, right, "cosine", k=k, other=True).groupBy("i").agg(F.avg("d").alias("far"))
    near = stored(near, "specificity")
    n = near.count()
    rows = before(ranged(near, "far"), [], ["far", "i"], F.lit(1), "count", "r")
    return rows.select("i", (F.coalesce("r", F.lit(0)) / F.lit(float(max(1, n - 1)))).alias("specificity"))


class IsolationForest:
    """Trees of random cuts, as flat arrays; points that few cuts set apart score high.

    A tree's subsample are the rows with the least hashes for that tree, and each tree grows
    in a group of its own; the trees (``trees`` times at most twice ``sample`` nodes) are all that
    comes to the driver.  ``score`` is a pandas UDF over them.
    """

    def __init__(self, trees: int = 64, sample: int = 256, trials: int = 8, seed: int = 0):
        self.n_trees, self.sample, self.trials, self.seed = trees, sample, trials, seed

    @staticmethod
    def mean_path(n: float) -> float:
        if n <= 1:
            return 0.0
        return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0

    def subsamples(self, points: DataFrame, n: int) -> DataFrame:
        """tree, i, x: ``sample`` rows for each tree."""
        # a few times as many rows as a tree takes are ranked by their hashes
        share = min(1.0, (2 * self.sample + 100) / max(n, 1))
        draw = lambda t: F.pmod(F.xxhash64(F.col("i"), t, F.lit(self.seed)), F.lit(1 << 40))
        trees = F.filter(F.sequence(F.lit(0), F.lit(self.n_trees - 1)), lambda t: draw(t) < F.lit(int(share * (1 << 40))))
        rows = points.select("i", metrics.doubles("x").alias("x"), F.explode(trees).alias("tree"))
        place = F.row_number().over(Window.partitionBy("tree").orderBy(draw(F.col("tree")), "i"))
        return rows.withColumn("place", place).where(F.col("place") <= self.sample).drop("place")

    def fit(self, points: DataFrame) -> IsolationForest:
        """Grows the forest over ``points`` (i, x)."""
        n = points.count()
        m = min(self.sample, n)
        self.norm, self.trees = self.mean_path(m), []
        depth, seed, trials, mean_path = max(1, math.ceil(math.log2(max(2, m)))), self.seed, self.trials, self.mean_path

        def grow_tree(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("i")
            tree, x = int(rows["tree"].iloc[0]), np.stack(rows["x"].to_numpy())
            rng = np.random.Generator(np.random.PCG64([seed, tree]))
            nodes: list[list] = []

            def grow(x: np.ndarray, level: int) -> int:
                at = len(nodes)
                nodes.append([-1, 0.0, -1, -1, level + mean_path(len(x))])
                if level >= depth or len(x) <= 1:
                    return at
                for _ in range(trials):
                    k = int(rng.integers(x.shape[1]))
                    low, high = x[:, k].min(), x[:, k].max()
                    if low < high:
                        cut = np.float32(rng.uniform(low, high))
                        goes = x[:, k].astype(np.float32) < cut
                        if goes.any() and not goes.all():
                            nodes[at][:2] = [k, float(cut)]
                            nodes[at][2] = grow(x[goes], level + 1)
                            nodes[at][3] = grow(x[~goes], level + 1)
                        break
                return at

            grow(x, 0)
            return pd.DataFrame({"tree": [tree], **{name: [list(column)] for name, column in zip(("feature", "cut", "near", "far", "length"), zip(*nodes, strict=True), strict=True)}})

        schema = "tree int, feature array<int>, cut array<double>, near array<int>, far array<int>, length array<double>"
        for r in self.subsamples(points, n).groupBy("tree").applyInPandas(grow_tree, schema).orderBy("tree").collect():  # a row a tree
            self.trees.append((np.array(r.feature, np.int32), np.array(r.cut, np.float32), np.array(r.near, np.int32), np.array(r.far, np.int32), np.array(r.length)))
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        narrow = x.astype(np.float32)
        for feature, cut, left, right, length in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                go = narrow[rows, np.maximum(feature[at], 0)] < cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += length[at]
        return np.power(2.0, -total / len(self.trees) / max(self.norm, 1e-12))

    def score(self, x: Column) -> Column:
        @F.pandas_udf("double")
        def of(v: pd.Series) -> pd.Series:
            return pd.Series(self.scores(np.stack(v.to_numpy()))) if len(v) else pd.Series([], dtype=float)

        return of(x)


class RadiusController:
    """Radii by place in the ball, and, with a forest, by how isolated a point is."""

    def __init__(self, base: float, gamma: float, decay: float, low: float, high: float, safety: float = 0.5, forest: IsolationForest | None = None):
        self.policy, self.safety, self.forest = (base, gamma, decay, low, high), safety, forest

    def radius(self, z: Column, margin: Column | None = None) -> Column:
        """The radius of points of the ball; ``margin``: the distance to what must stay apart."""
        score = F.lit(0.0) if self.forest is None else self.forest.score(z)
        return radii(z, score, *self.policy, margin=margin, safety=self.safety)


def knees(curve: DataFrame, group: str, value: str) -> DataFrame:
    """``group``, epsilon: ``knee`` of each group's curve."""
    stats = curve.groupBy(group).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n"))
    per = stored(curve.groupBy(group, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c")), "curve")
    per = before(ranged(per, "v"), [group], ["v"], F.col("c"), "sum", "r").withColumn("r", F.coalesce("r", F.lit(0))).join(stats, group)
    ends = per.withColumn("p", F.explode(F.array(F.greatest("r", F.lit(1)), F.least(F.col("r") + F.col("c") - 1, F.col("n") - 2))))
    ends = ends.where((F.col("p") >= F.col("r")) & (F.col("p") < F.col("r") + F.col("c")) & (F.col("high") > F.col("low")) & (F.col("n") >= 3))
    gap = F.abs((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) - F.col("p") / (F.col("n") - 1))
    best = ends.groupBy(group).agg(F.min(F.struct((-gap).alias("gap"), "p", "v")).alias("m"))
    return stats.join(best, group, "left").select(group, F.coalesce("m.v", "low").alias("epsilon"))


class EpsilonTree:
    """Resolutions by place: cuts at the lower median of the widest axis, as many levels as
    ``depth``; each leaf has the knee of the k-distances of its rows.

    Every row counts: a level takes one pass for the extents of its nodes and one for their
    medians (approximate beyond 10,000 rows a node), the distances inside all leaves are one
    join.  A tree has at most 2 ** depth leaves, and nothing else comes to the driver.
    """

    def __init__(self, min_leaf: int = 8, depth: int = 3, k: int = 3, distance: str = "l2"):
        self.min_leaf, self.depth, self.k, self.distance = min_leaf, depth, k, distance

    def _leaf(self, x: Column, node: dict) -> Column:
        if "leaf" in node:
            return F.lit(node["leaf"])
        return F.when(F.element_at(x, node["axis"] + 1) <= node["cut"], self._leaf(x, node["low"])).otherwise(self._leaf(x, node["high"]))

    def leaf(self, x: Column) -> Column:
        """The number of the leaf that a point is in."""
        return self._leaf(metrics.doubles(x), self.root)

    def fit(self, points: DataFrame) -> EpsilonTree:
        """Grows the tree over ``points`` (i, x)."""
        rows = stored(points.select(F.col("i").cast("bigint").alias("i"), metrics.doubles("x").alias("x")), "points")
        self.root: dict = {"leaf": 0}
        open_, number = [self.root], 1

        def extents(batches):
            for batch in batches:
                if len(batch):
                    for g, own in batch.groupby("g"):
                        x = np.stack(own["x"].to_numpy())
                        yield pd.DataFrame({"g": [g], "n": [len(x)], "low": [x.min(0)], "high": [x.max(0)]})

        for _ in range(self.depth):
            if not open_:
                break
            wanted = [node["leaf"] for node in open_]
            at = rows.withColumn("g", self.leaf(F.col("x"))).where(F.col("g").isin(wanted))
            part = at.select("g", "x").mapInPandas(extents, "g int, n bigint, low array<double>, high array<double>")
            axis = part.select("g", "n", F.posexplode(F.arrays_zip("low", "high")).alias("axis", "e"))
            wide = axis.groupBy("g", "axis").agg(F.sum("n").alias("n"), (F.max("e.high") - F.min("e.low")).alias("width"))
            best = {r.g: r for r in wide.groupBy("g").agg(F.max("n").alias("n"), F.min(F.struct((-F.col("width")).alias("w"), "axis")).alias("m")).collect()}  # a row a node
            split = {g: r.m.axis for g, r in best.items() if r.n >= 2 * self.min_leaf and r.m.w < 0}
            if not split:
                break
            value = F.lit(None).cast("double")
            for g, k in split.items():
                value = F.when(F.col("g") == g, F.element_at("x", k + 1)).otherwise(value)
            cuts = {r.g: r.cut for r in at.where(F.col("g").isin(list(split))).groupBy("g").agg(F.percentile_approx(value, 0.5, 10_000).alias("cut"), F.max(value).alias("high")).where("cut < high").collect()}  # a row a node
            following = []
            for node in open_:
                g = node["leaf"]
                if g in cuts:
                    node.clear()
                    node.update(axis=split[g], cut=cuts[g], low={"leaf": number}, high={"leaf": number + 1})
                    following += [node["low"], node["high"]]
                    number += 2
            open_ = following
        leafed = stored(rows.withColumn("g", self.leaf(F.col("x"))), "leaves")
        sizes = leafed.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        near = epsjoin.nearest(leafed, leafed.select("g", F.col("i").alias("j"), F.col("x").alias("y")), self.distance, k=self.k, other=True)
        curve = near.join(sizes, "g").where(F.col("rank") == F.least(F.lit(self.k), F.col("n") - 1)).select("g", "d")
        known = {r.g: r.epsilon for r in knees(curve, "g", "d").collect()}  # a row a leaf
        counts = {r.g: r.n for r in sizes.collect()}
        self.leaves = {g: (known.get(g, 0.0), n) for g, n in counts.items()}
        return self

    def epsilon(self, x: Column) -> Column:
        """The resolution of the leaf that a point is in."""
        leaf, out = self.leaf(x), F.lit(0.0)
        for g, (epsilon, _) in self.leaves.items():
            out = F.when(leaf == g, F.lit(float(epsilon))).otherwise(out)
        return out
