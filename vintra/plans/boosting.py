"""Gradient boosting on histograms, and explanations of its trees.

Rows are cut into bins once and written in blocks, one column of bytes a feature. A level of a round is one Spark job: tasks walk their
blocks through the trees so far, a node at a time over whole columns, add gradients up by node, feature and bin, and only these sums are
shuffled; splits are chosen from them. Every spec (a grid point, a fold, a refit) has its own trees, and all specs share each job. Gradients are whole numbers of a fixed unit, so sums don't
depend on how rows are dealt to tasks. A model is a few flat arrays, whatever the number of rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

#: Bin of a missing value; others count from 1.
MISSING, BINS = 0, 32
UNIT = 1 << 20
#: Contributions of a tree with so many splits at most are looked up by which of them a row passes.
LOOKED_UP = 8


@dataclass(frozen=True)
class Spec:
    """How one model is fitted, on which rows, and by which it stops: after `patience` rounds without a better loss on `valid`."""

    train: Column
    valid: Column | None = None
    loss: str = "squared"
    classes: int = 1
    depth: int = 3
    rate: float = 0.1
    l2: float = 1.0
    least: int = 5
    rounds: int = 50
    patience: int = 10
    #: feature -> 1 if the output may only rise with it, -1 if it may only fall
    monotone: dict[str, int] = field(default_factory=dict)


class Tree:
    """A complete binary tree in heap order: node k has the children 2k + 1 and 2k + 2. feature is -1 at leaves."""

    def __init__(self, depth: int):
        n = 2 ** (depth + 1) - 1
        self.depth, self.feature, self.cut, self.missing_left = depth, np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.zeros(n, bool)
        self.value, self.cover, self.gain = np.zeros(n), np.zeros(n, np.int64), np.zeros(n)

    def goes_left(self, bins: np.ndarray, node: int) -> np.ndarray:
        b = bins[:, self.feature[node]]
        # bytes wrap around: a missing value, less one, is above every cut
        return b <= self.cut[node] if self.missing_left[node] else b - np.uint8(1) < self.cut[node]

    def leaves_of(self, bins: np.ndarray, node: int = 0) -> np.ndarray:
        """The node at which each row ends, from a node on."""
        kind = np.uint8 if len(self.feature) <= 256 else np.int64
        if self.feature[node] < 0:
            return np.full(len(bins), node, kind)
        left, right = (self.leaves_of(bins, child) for child in (2 * node + 1, 2 * node + 2))
        # right, or with the bits that differ turned over
        return right ^ ((left ^ right) & -self.goes_left(bins, node).astype(kind))


@dataclass
class Booster:
    features: list[str]
    edges: list[np.ndarray]
    loss: str
    rate: float
    base: np.ndarray
    #: one tree a class for each round
    trees: list[list[Tree]]
    #: rounds in use, validation loss of each round (the first one without a tree)
    best: int = 0
    losses: list[float] = field(default_factory=list)

    def bins(self, values: np.ndarray) -> np.ndarray:
        """Bins of rows of values, a feature's side by side in memory."""
        out = np.empty(values.shape, np.uint8, "F")
        for f, e in enumerate(self.edges):
            out[:, f] = np.where(np.isnan(values[:, f]), MISSING, np.searchsorted(e, values[:, f], "left") + 1)
        return out

    def margin(self, bins: np.ndarray, rounds: int | None = None) -> np.ndarray:
        out = np.tile(self.base, (len(bins), 1))
        for trees in self.trees[: self.best if rounds is None else rounds]:
            for k, t in enumerate(trees):
                out[:, k] += (self.rate * t.value).take(t.leaves_of(bins))
        return out

    def gains(self) -> dict[str, float]:
        """Total gain of the splits of each feature."""
        out = dict.fromkeys(self.features, 0.0)
        for trees in self.trees[: self.best]:
            for t in trees:
                for f, g in zip(t.feature, t.gain, strict=True):
                    if f >= 0:
                        out[self.features[f]] += float(g)
        return out


def shares(margin: np.ndarray, loss: str) -> np.ndarray:
    """What a margin predicts: a value, a probability of 1, or probabilities of classes."""
    if loss == "squared":
        return margin
    if loss == "logistic":
        return 1 / (1 + np.exp(-margin))
    e = np.exp(margin - margin.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(loss: str, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient, curvature and loss of each row (and class)."""
    p = shares(margin, loss)
    if loss == "squared":
        return margin - y[:, None], np.ones_like(margin), (margin[:, 0] - y) ** 2
    if loss == "logistic":
        q = np.clip(np.where(y == 1, p[:, 0], 1 - p[:, 0]), 1e-15, 1)
        return p - y[:, None], p * (1 - p), -np.log(q)
    hot = np.arange(margin.shape[1])[None, :] == y[:, None]
    return p - hot, p * (1 - p), -np.log(np.clip(p[np.arange(len(y)), y.astype(int)], 1e-15, 1))


def binned(rows: DataFrame, features: list[str], label: str, specs: list[Spec], scratch) -> tuple[DataFrame, list[np.ndarray], list[np.ndarray], list[float]]:
    """Written blocks of rows (bins, use, y), the edges of the bins (quantiles of each feature, at most BINS - 1), and starts() of the specs.

    bins has a byte a row for each feature in turn, use for each spec: 1 trains, 2 validates. Rows without a label, and rows that no spec uses, aren't written.
    """
    shape = [F.percentile_approx(f, [k / BINS for k in range(1, BINS)], 10_000).alias(f"e{k}") for k, f in enumerate(features)]
    finite = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f) for f in features]
    use = [F.when(F.coalesce(s.train, F.lit(False)), 1).when(F.coalesce(s.valid, F.lit(False)) if s.valid is not None else F.lit(False), 2).otherwise(0).cast("byte").alias(f"_use{k}") for k, s in enumerate(specs)]
    given = rows.select(*finite, F.col(label).cast("double").alias("_y"), *use)
    row = given.agg(*shape, *starts(specs)).first()
    edges = [np.unique(np.array(row[f"e{k}"] if row[f"e{k}"] is not None else [], float)) for k in range(len(features))]
    cutter = Booster(features, edges, "squared", 0.0, np.zeros(1), [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = cutter.bins(matrix(b.columns[: len(features)]))
            use = np.array([c.to_numpy(zero_copy_only=False) for c in b.columns[len(features) + 1 :]], np.uint8)
            block = [bins.tobytes("F"), use.tobytes(), b.column(len(features)).to_numpy(zero_copy_only=False).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in block], names=["bins", "use", "y"])

    used = given.where(F.col("_y").isNotNull() & reduce(Column.__or__, [F.col(f"_use{k}") > 0 for k in range(len(specs))]))
    return scratch.save(used.mapInArrow(run, "bins binary, use binary, y binary"), "binned"), edges, *begun(row, specs)


def matrix(columns: list[pa.Array]) -> np.ndarray:
    """Rows of doubles, a column's side by side in memory; null is NaN."""
    out = np.empty((len(columns[0]), len(columns)), float, "F")
    for k, c in enumerate(columns):
        out[:, k] = c.to_numpy(zero_copy_only=False)
    return out


def histograms(table: DataFrame, specs: list[Spec], models: list[Booster], growing: dict[int, list[Tree]], scale: list[float], level: int, n_features: int) -> pd.DataFrame:
    """Sums over training rows at the nodes of a level: (spec, class, node, feature, bin, g, h, n); at the first level also, as class -1,
    the loss and number of validation rows. One job for all specs."""

    def add(sums: dict, y: np.ndarray, use: np.ndarray, columns: np.ndarray) -> None:
        width = 2**level
        for s, (loss, classes) in specs_of.items():
            mine = use[s] == 1
            if level == 0 and (held := use[s] == 2).any():
                of = gradients(loss, models[s].margin(columns[:, held].T, len(models[s].trees)), y[held])[2]
                x = sums.setdefault((s, -1), np.zeros((1, 1, 3), np.int64))
                x[0, 0] += [np.rint(of / scale[s] ** 2 * UNIT).astype(np.int64).sum(), 0, len(of)]
            if s not in growing or not mine.any():
                continue
            own, label = (columns, y) if mine.all() else (columns[:, mine], y[mine])
            g, h, _ = gradients(loss, models[s].margin(own.T, len(models[s].trees)), label)
            g, h = np.rint(g / scale[s] * UNIT), np.rint(h * UNIT)
            for k in range(classes):
                x = sums.setdefault((s, k), np.zeros((width * n_features, BINS + 1, 3), np.int64))
                gk, hk, start, of = g[:, k], h[:, k], 0, own
                if level:
                    node = growing[s][k].leaves_of(own.T).astype(np.intp) - (width - 1)
                    if (node < 0).any():  # rows that ended above
                        here = node >= 0
                        node, of, gk, hk = node[here], own[:, here], gk[here], hk[here]
                    start = node * (BINS + 1)
                for f in range(n_features):
                    at = of[f].astype(np.intp) + start
                    n = np.bincount(at, minlength=width * (BINS + 1))
                    # curvatures of squares are 1
                    for j, w in enumerate((np.bincount(at, gk, len(n)), n * UNIT if loss == "squared" else np.bincount(at, hk, len(n)), n)):
                        x[f * width : (f + 1) * width, :, j] += w.astype(np.int64).reshape(width, BINS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, width = {}, 2**level
        for batch in batches:
            for bins, use, y in zip(*batch.columns, strict=True):
                y = np.frombuffer(y.as_buffer(), float)
                add(sums, y, np.frombuffer(use.as_buffer(), np.uint8).reshape(-1, len(y)), np.frombuffer(bins.as_buffer(), np.uint8).reshape(-1, len(y)))
        for (s, k), x in sums.items():
            at, b = np.nonzero(x[:, :, 2])
            found = {"spec": np.full(len(at), s, np.int32), "class": np.full(len(at), k, np.int32), "node": (at % width).astype(np.int32), "feature": (at // width).astype(np.int32), "bin": b.astype(np.int32), "g": x[at, b, 0], "h": x[at, b, 1], "n": x[at, b, 2]}
            yield pa.RecordBatch.from_pydict(found)

    specs_of = {s: (x.loss, len(models[s].base)) for s, x in enumerate(specs)}
    keys = ["spec", "class", "node", "feature", "bin"]
    parts = table.mapInArrow(run, "spec int, class int, node int, feature int, bin int, g long, h long, n long")
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")]).toArrow().to_pandas()


def best_split(sums: np.ndarray, l2: float, least: int, signs: np.ndarray, low: float, high: float) -> tuple | None:
    """(gain, feature, cut, missing left, left sums, right sums) of a node from sums (feature, bin, (g, h, n)); None if no split helps."""
    total = sums[0].sum(0)
    found = None
    score = lambda x: x[..., 0] ** 2 / (x[..., 1] + l2)
    value = lambda x: np.clip(-x[..., 0] / (x[..., 1] + l2), low, high)
    for missing_left in (True, False):
        left = sums[:, 1:].cumsum(1)[:, :-1] + (sums[:, :1] if missing_left else 0)
        right = total - left
        gain = score(left) + score(right) - score(total)
        falls = signs[:, None] * (value(right) - value(left)) < 0
        gain = np.where((left[..., 2] < least) | (right[..., 2] < least) | falls, -np.inf, gain)
        f, c = np.unravel_index(gain.argmax(), gain.shape)
        if gain[f, c] > 1e-9 and (found is None or gain[f, c] > found[0]):
            found = (float(gain[f, c]), int(f), int(c) + 1, missing_left, left[f, c], right[f, c])
    return found


def starts(specs: list[Spec]) -> list[Column]:
    """Exact sums over the training rows (_y, _use) of each spec, from which it begins."""
    wide = []
    for s, x in enumerate(specs):
        used = F.col("_y").isNotNull() & (F.col(f"_use{s}") == 1)
        wide.append(F.max(F.when(used, F.abs("_y"))).alias(f"most{s}"))
        if x.loss == "squared":
            wide += [F.sum(F.when(used, F.col("_y").cast("decimal(38,9)"))).cast("double").alias(f"sum{s}"), F.count(F.when(used, 1)).alias(f"n{s}")]
        else:
            wide += [F.count(F.when(used & (F.col("_y") == k), 1)).alias(f"c{s}_{k}") for k in range(max(2, x.classes))]
    return wide


def begun(row: Row, specs: list[Spec]) -> tuple[list[np.ndarray], list[float]]:
    """Base margins (mean, log-odds, log of smoothed class shares) and the units of gradients."""
    base, scale = [], []
    for s, x in enumerate(specs):
        if x.loss == "squared":
            mean = (row[f"sum{s}"] or 0.0) / max(1, row[f"n{s}"])
            base.append(np.array([mean]))
            scale.append(2.0 ** math.ceil(math.log2(max(1e-30, (row[f"most{s}"] or 0.0) + abs(mean)))))
        else:
            c = np.array([row[f"c{s}_{k}"] for k in range(max(2, x.classes))], float)
            p = (c + 1) / (c.sum() + len(c))
            base.append(np.log(p) if x.loss == "softmax" else np.array([math.log(p[1] / p[0])]))
            scale.append(1.0)
    return base, scale


def fit(rows: DataFrame, features: list[str], label: str, specs: list[Spec], scratch) -> list[Booster]:
    """One booster for each spec, over rows (label, features as numbers; null and NaN are missing).

    Missing values go to the side that gains more. A spec that validates uses the round with the least loss there, others all rounds.
    Labels of logistic models are 0 and 1, of softmax models 0 to classes - 1; a class without training rows keeps its small prior. Rows with a null label are
    left out. A spec without training rows, or whose labels agree, is its base value. Ties go to the first feature and cut.
    """
    table, edges, base, scale = binned(rows, features, label, specs, scratch)
    models = [Booster(features, edges, x.loss, x.rate, base[s], []) for s, x in enumerate(specs)]
    open_, n_features = set(range(len(specs))), len(features)
    signs = [np.array([x.monotone.get(f, 0) for f in features]) for x in specs]
    for round_ in range(max(x.rounds for x in specs) + 1):
        growing = {s: [Tree(specs[s].depth) for _ in range(len(base[s]))] for s in open_ if round_ < specs[s].rounds}
        bounds = {(s, k, 0): (-np.inf, np.inf) for s in growing for k in range(len(base[s]))}
        split_any = dict.fromkeys(growing, False)
        for level in range(max([specs[s].depth for s in growing], default=1)):
            deep = {s: t for s, t in growing.items() if level < specs[s].depth}
            if not (deep or (level == 0 and open_)):
                break
            found = histograms(table, specs, models, deep, scale, level, n_features)
            for s, x in found[found["class"] < 0].groupby("spec"):
                if s in open_:
                    loss = int(x["g"].sum()) / UNIT * scale[s] ** 2 / int(x["n"].sum())
                    models[s].losses.append(loss)
                    models[s].best = int(np.argmin(models[s].losses))
                    if len(models[s].losses) - 1 - models[s].best >= specs[s].patience:
                        open_.discard(s)
                        growing.pop(s, None)
            for (s, k, node), x in found[found["class"] >= 0].groupby(["spec", "class", "node"]):
                if s in growing:
                    grow(growing[s][k], specs[s], x, node + 2**level - 1, n_features, scale[s], signs[s], bounds, (s, k), split_any)
        for s, trees in growing.items():
            if split_any[s]:
                models[s].trees.append(trees)
            else:  # no split helps any more
                open_.discard(s)
        open_ = {s for s in open_ if len(models[s].trees) < specs[s].rounds or specs[s].valid is not None and len(models[s].losses) <= len(models[s].trees)}
        if not open_:
            break
    for s, m in enumerate(models):
        if specs[s].valid is None or not m.losses:
            m.best = len(m.trees)
        m.trees = m.trees[: max(m.best, 0)]
    return models


def grow(tree: Tree, spec: Spec, sums: pd.DataFrame, node: int, n_features: int, scale: float, signs: np.ndarray, bounds: dict, key: tuple, split_any: dict) -> None:
    """Sets a node's value and cover, and its split if one helps."""
    x = np.zeros((n_features, BINS + 1, 3))
    x[sums["feature"], sums["bin"]] = np.column_stack([sums["g"] / UNIT * scale, sums["h"] / UNIT, sums["n"]])
    low, high = bounds[*key, node]
    value = lambda t: float(np.clip(-t[0] / (t[1] + spec.l2), low, high))
    total = x[0].sum(0)
    if node == 0:
        tree.value[0], tree.cover[0] = value(total), int(total[2])
    best = best_split(x, spec.l2, spec.least, signs, low, high)
    if best is None:
        return
    gain, tree.feature[node], tree.cut[node], tree.missing_left[node], left, right = best
    tree.gain[node] = gain
    split_any[key[0]] = True
    middle = (value(left) + value(right)) / 2
    sign = signs[tree.feature[node]]
    for child, t, side in ((2 * node + 1, left, 1), (2 * node + 2, right, -1)):
        tree.value[child], tree.cover[child] = value(t), int(t[2])
        # a rising feature's left side stays below the middle, and so do all below it
        bounds[*key, child] = (low, min(high, middle)) if sign * side > 0 else (max(low, middle), high) if sign * side < 0 else (low, high)


def predicted(df: DataFrame, model: Booster, name: str = "prediction") -> DataFrame:
    """df with a column of what the model predicts: a double, or an array of class probabilities."""
    many = model.loss == "softmax"

    @F.arrow_udf("array<double>" if many else "double")
    def run(values: pa.Array) -> pa.Array:
        out = shares(model.margin(model.bins(matrix(values.flatten()))), model.loss)
        return lists(out) if many else pa.array(out[:, 0])

    return df.withColumn(name, run(F.struct(*[F.col(f).cast("double").alias(f) for f in model.features])))


def lists(rows: np.ndarray) -> pa.Array:
    """An Arrow list for each row of numbers."""
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], rows.ravel())


def paths(tree: Tree) -> list[tuple[float, list[tuple[int, float, list[tuple[int, bool]]]]]]:
    """(leaf value, [(feature, share of rows that its splits let pass, [(node, goes left)])]) of each leaf."""
    out, todo = [], [(0, {})]
    while todo:
        node, by = todo.pop()
        if tree.feature[node] < 0:
            out.append((float(tree.value[node]), [(f, *x) for f, x in by.items()]))
            continue
        for child, left in ((2 * node + 1, True), (2 * node + 2, False)):
            f = int(tree.feature[node])
            share, splits = by.get(f, (1.0, []))
            todo.append((child, by | {f: (share * tree.cover[child] / tree.cover[node], [*splits, (node, left)])}))
    return out


def expected(model: Booster, k: int = 0) -> float:
    """The mean margin over training rows, as the trees' covers weigh their leaves."""
    total = float(model.base[k])
    for trees in model.trees[: model.best]:
        total += model.rate * sum(v * math.prod(x[1] for x in of) for v, of in paths(trees[k]))
    return total


def shapley(tree: Tree, left: dict[int, np.ndarray], n_features: int) -> np.ndarray:
    """Shapley values of rows by feature, in the game of path-dependent expectations of a tree; left: whether each row passes each split.

    In the game of one leaf a coalition's worth is its value times a factor a feature: whether the row passes the feature's splits, if
    the feature is in the coalition, else the share of rows that pass them. A feature's Shapley value weighs the coefficients of the
    product of the others' factors by the coalition's size.
    """
    n = len(next(iter(left.values())))
    out = np.zeros((n, n_features))
    for value, of in paths(tree):
        m = len(of)
        passes = [np.logical_and.reduce([left[node] if side else ~left[node] for node, side in splits]).astype(float) for _, _, splits in of]
        weights = [math.factorial(c) * math.factorial(m - 1 - c) / math.factorial(m) for c in range(m)]
        for i, (f, share, _) in enumerate(of):
            sizes = [np.ones(n)]
            for j, (_, z, _) in enumerate(of):
                if j != i:
                    sizes = [(sizes[c] * z if c < len(sizes) else 0) + (sizes[c - 1] * passes[j] if c else 0) for c in range(len(sizes) + 1)]
            out[:, f] += value * (passes[i] - share) * sum(w * c for w, c in zip(weights, sizes, strict=True))
    return out


def passed(tree: Tree) -> np.ndarray | None:
    """shapley() of every set of splits that a row may pass, at the place that has its bits; None if there are too many splits."""
    nodes = np.flatnonzero(tree.feature >= 0)
    if not 0 < len(nodes) <= LOOKED_UP:
        return None
    places = np.arange(2 ** len(nodes))
    return shapley(tree, {int(node): (places >> k & 1).astype(bool) for k, node in enumerate(nodes)}, int(tree.feature.max()) + 1)


def contributions(model: Booster, bins: np.ndarray, k: int = 0, known: list[np.ndarray | None] | None = None) -> np.ndarray:
    """Shapley values of each row's margin, by feature; known: passed() of the trees in use."""
    out = np.zeros((len(bins), len(model.features)))
    trees = [t[k] for t in model.trees[: model.best]]
    for tree, values in zip(trees, [passed(t) for t in trees] if known is None else known, strict=True):
        left = {int(n): tree.goes_left(bins, n) for n in np.flatnonzero(tree.feature >= 0)}
        if values is not None:
            place = np.zeros(len(bins), np.uint8)
            for bit, side in enumerate(left.values()):
                place |= side.view(np.uint8) << np.uint8(bit)
            out[:, : values.shape[1]] += model.rate * values.take(place, 0)
        elif left:
            out += model.rate * shapley(tree, left, out.shape[1])
    return out


def explained(df: DataFrame, model: Booster, k: int = 0) -> DataFrame:
    """df with expected (the mean margin) and contributions (feature -> Shapley value); margin = expected + their sum."""
    known = [passed(t[k]) for t in model.trees[: model.best]]

    @F.arrow_udf("array<double>")
    def run(values: pa.Array) -> pa.Array:
        return lists(contributions(model, model.bins(matrix(values.flatten())), k, known))

    values = run(F.struct(*[F.col(f).cast("double").alias(f) for f in model.features]))
    return df.withColumn("expected", F.lit(expected(model, k))).withColumn("contributions", F.map_from_arrays(F.array(*[F.lit(f) for f in model.features]), values))


def gap_folds(rows: DataFrame, date: str, splits: int, gap: int) -> DataFrame:
    """rows with _fold and _rank: time-ordered folds over distinct dates. Of n dates the last splits * (n // (splits + 1)) are validated, in
    equal runs 0, 1, ...; dates before them have no fold. trains() says which rows a fold learns from. Dates are a calendar: few, ordered in one task.
    """
    dates = rows.select(F.col(date).alias("_date")).where("_date is not null").distinct()
    ranked = dates.withColumn("_rank", F.row_number().over(Window.orderBy("_date")) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))
    size = F.floor(F.col("_n") / (splits + 1))
    first = F.col("_n") - splits * size
    folds = ranked.select("_date", "_rank", F.when((size > 0) & (F.col("_rank") >= first), F.floor((F.col("_rank") - first) / size).cast("int")).alias("_fold"), (first - gap).alias("_least"), size.alias("_size"))
    return rows.join(folds, rows[date].eqNullSafe(F.col("_date")), "left").drop("_date")


def trains(fold: int) -> Column:
    """Whether a row of gap_folds() stands at least the gap before a fold's first date."""
    return F.col("_rank") < F.col("_least") + fold * F.col("_size")


def cross_validated(rows: DataFrame, features: list[str], label: str, date: str, base: Spec, grid: dict[str, list], splits: int, gap: int, scratch, published: str | None = None) -> tuple[Booster, dict, DataFrame]:
    """(final model, its grid point with rounds and loss, out-of-fold rows with prediction).

    published: the day a row's label came out; a fold then learns only from rows whose label was out before its first date.

    All grid points and folds are fitted at once. The point with the least mean validation loss (root mean square, or log loss) is refitted on
    all labelled rows with the mean of its best rounds; out-of-fold rows are predicted by the fold models of that point.
    """
    folded = scratch.save(gap_folds(rows, date, splits, gap), "folds")
    points = [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]
    begins = {r["_fold"]: r["day"] for r in folded.where("_fold is not null").groupBy("_fold").agg(F.min(date).alias("day")).collect()} if published else {}
    out_by = lambda k: F.coalesce(F.col(published) < F.lit(begins[k]), F.lit(False)) if k in begins else F.lit(True)
    specs = [replace(base, train=base.train & trains(k) & out_by(k), valid=base.train & (F.col("_fold") == k), **p) for p in points for k in range(splits)]
    models = fit(folded, features, label, specs, scratch)
    found = []
    for n, p in enumerate(points):
        of = [m for m in models[n * splits : (n + 1) * splits] if m.losses]
        losses = [m.losses[m.best] ** (0.5 if base.loss == "squared" else 1) for m in of]
        found.append((float(np.mean(losses)) if of else math.inf, n, max(1, round(float(np.mean([m.best for m in of])))) if of else base.rounds))
    loss, n, rounds = min(found)
    final = fit(folded, features, label, [replace(base, rounds=rounds, **points[n])], scratch)[0]
    out = None
    for k in range(splits):
        own = predicted(folded.where(base.train & (F.col("_fold") == k) & F.col(label).isNotNull()), models[n * splits + k])
        out = own if out is None else out.unionByName(own)
    return final, points[n] | {"rounds": rounds, "loss": loss}, out
