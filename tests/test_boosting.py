"""Boosting, gap folds and tree explanations against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintra.plans import boosting
from vintra.sources.scratch import Scratch


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    x[rng.random((400, 3)) < 0.1] = np.nan
    a, b = np.nan_to_num(x[:, 0], nan=1.0), np.nan_to_num(x[:, 1])
    y = 2 * a + b * (a > 0) + 0.1 * rng.normal(size=400)
    data = [(k, *(None if math.isnan(v) else float(v) for v in r), float(t), float(t > 1), float(0 if t < -1 else 1 if t < 1 else 2), k // 8) for k, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, y double, up double, kind double, day int").cache()


NAMES = ["a", "b", "c"]


def test_fits_and_does_not_depend_on_partitions(spark, rows):
    specs = [boosting.Spec(F.col("id") % 4 != 0, F.col("id") % 4 == 0, rounds=25, rate=0.3, depth=2), boosting.Spec(F.lit(True), rounds=3, depth=1)]
    one, other = boosting.fit(rows, NAMES, "y", specs, Scratch(spark)), boosting.fit(rows.repartition(7), NAMES, "y", specs, Scratch(spark))
    for p, q in zip(one, other, strict=True):
        assert p.best == q.best and len(p.trees) == len(q.trees)
        for s, t in zip(itertools.chain(*p.trees), itertools.chain(*q.trees), strict=True):
            assert (s.feature == t.feature).all() and (s.cut == t.cut).all() and (s.value == t.value).all() and (s.cover == t.cover).all()
    got = boosting.predicted(rows, one[0]).select("id", "y", "prediction").toPandas()
    held = got[got.id % 4 == 0]
    assert ((held.y - held.prediction) ** 2).mean() < 0.15 * held.y.var()
    assert ((held.y - held.prediction) ** 2).mean() == pytest.approx(one[0].losses[one[0].best], rel=1e-4)
    assert len(one[1].trees) == 3 and one[1].gains()["a"] > one[1].gains()["c"]


def test_first_tree_against_brute_force(spark, rows):
    """The first stump is the best of all cuts at the edges, with missing values on either side."""
    model = boosting.fit(rows, NAMES, "y", [boosting.Spec(F.lit(True), rounds=1, depth=1, rate=1.0, l2=0.0, least=1)], Scratch(spark))[0]
    pdf = rows.toPandas()
    y = pdf.y.to_numpy() - pdf.y.mean()
    best = max((y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum(), f, e) for f, name in enumerate(NAMES) for e in model.edges[f] for missing in (True, False) if 0 < (left := np.where(pdf[name].isna(), missing, pdf[name] <= e)).sum() < len(y))
    tree = model.trees[0][0]
    assert (tree.feature[0], model.edges[best[1]][tree.cut[0] - 1]) == (best[1], best[2]) and tree.gain[0] == pytest.approx(best[0], rel=1e-4)
    assert tree.cover[1] + tree.cover[2] == tree.cover[0] == 400


def test_softmax_with_unseen_class_and_monotone(spark, rows):
    specs = [boosting.Spec(F.lit(True), loss="softmax", classes=4, rounds=15, rate=0.3), boosting.Spec(F.lit(True), loss="logistic", rounds=15, rate=0.3, monotone={"a": -1}), boosting.Spec(F.col("id") < 0, loss="logistic", rounds=5)]
    many, falling, none = boosting.fit(rows, NAMES, "kind", specs[:1], Scratch(spark)) + boosting.fit(rows, NAMES, "up", specs[1:], Scratch(spark))
    got = boosting.predicted(rows, many, "p").select("kind", "p").toPandas()
    p = np.stack(got.p)
    assert np.allclose(p.sum(1), 1) and (p[:, 3] < 0.02).all() and (p[:, 3] > 0).all()
    assert (p.argmax(1) == got.kind).mean() > 0.85
    line = boosting.shares(falling.margin(falling.bins(np.column_stack([np.linspace(-3, 3, 50), np.zeros(50), np.zeros(50)]))), "logistic")[:, 0]
    assert (np.diff(line) <= 1e-12).all()
    assert none.trees == [] and boosting.predicted(rows, none).first()["prediction"] == 0.5


def conditional(tree, bins, coalition, node=0):
    """The path-dependent expectation of a tree when only a coalition's features are known."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    left, right = 2 * node + 1, 2 * node + 2
    if f in coalition:
        return conditional(tree, bins, coalition, left if tree.goes_left(bins, node)[0] else right)
    return sum(tree.cover[c] / tree.cover[node] * conditional(tree, bins, coalition, c) for c in (left, right))


def test_contributions_are_shapley_values(spark, rows):
    model = boosting.fit(rows, NAMES, "y", [boosting.Spec(F.lit(True), rounds=4, depth=4, rate=0.5, least=2)], Scratch(spark))[0]
    out = boosting.explained(boosting.predicted(rows, model), model).toPandas()
    assert np.allclose(out.prediction, out.expected + out.contributions.map(lambda c: sum(c.values())), atol=1e-9)
    some = out.head(20)
    for r, bins in zip(some.itertuples(), model.bins(some[NAMES].to_numpy(float)), strict=True):
        worth = {c: sum(model.rate * conditional(t[0], bins[None, :], c) for t in model.trees) for n in range(4) for c in itertools.combinations(range(3), n)}
        for i, name in enumerate(NAMES):
            others = [j for j in range(3) if j != i]
            want = sum(math.factorial(n) * math.factorial(2 - n) / 6 * (worth[tuple(sorted((*c, i)))] - worth[c]) for n in range(3) for c in itertools.combinations(others, n))
            assert r.contributions[name] == pytest.approx(want, abs=1e-9)


def test_rows_are_written_in_blocks_and_walked_by_columns(spark, rows):
    specs = [boosting.Spec(F.col("id") % 4 == 0, F.col("id") % 4 == 1), boosting.Spec(F.col("id") % 4 == 2)]
    table, edges, base, _ = boosting.binned(rows.repartition(3).unionByName(rows.withColumn("y", F.lit(None).cast("double"))), NAMES, "y", specs, Scratch(spark))
    blocks = table.collect()
    assert len(blocks) <= 3 + rows.rdd.getNumPartitions()  # a block a batch, not a row a row
    pdf = rows.toPandas()
    bins = boosting.Booster(NAMES, edges, "squared", 0.0, base[0], []).bins(pdf[NAMES].to_numpy(float))
    want = sorted((y, *b, 1 * (k % 4 == 0) + 2 * (k % 4 == 1), 1 * (k % 4 == 2)) for k, y, b in zip(pdf.id, pdf.y, bins.tolist(), strict=True) if k % 4 < 3)
    got = []
    for r in blocks:
        y = np.frombuffer(r["y"])
        columns = [np.frombuffer(r[c], np.uint8).reshape(-1, len(y)) for c in ("bins", "use")]
        got += zip(y.tolist(), *columns[0].tolist(), *columns[1].tolist(), strict=True)
    assert sorted(got) == want
    assert [b[0] for b in base] == pytest.approx([pdf.y[pdf.id % 4 == k].mean() for k in (0, 2)], abs=1e-8)


@pytest.mark.parametrize("depth", [2, 3, 7, 9])
def test_walks_and_looked_up_contributions_against_plain_ones(depth):
    rng = np.random.default_rng(depth)
    bins = np.asfortranarray(rng.integers(0, boosting.BINS + 1, (300, 4)).astype(np.uint8))
    tree = boosting.Tree(depth)
    inner = 2**depth - 1
    tree.feature[:inner] = rng.integers(0, 4, inner)
    tree.feature[1:inner][rng.random(inner - 1) < 0.4] = -1
    for node in range(1, len(tree.feature)):
        if tree.feature[(node - 1) // 2] < 0:
            tree.feature[node] = -1
    tree.cut[:], tree.missing_left[:], tree.value[:] = rng.integers(1, boosting.BINS + 1, len(tree.cut)), rng.random(len(tree.cut)) < 0.5, rng.normal(size=len(tree.value))
    tree.cover[0] = 2**20
    for node in range(inner):
        tree.cover[2 * node + 1] = tree.cover[node] // 3
        tree.cover[2 * node + 2] = tree.cover[node] - tree.cover[node] // 3

    def walk(row):
        node = 0
        while (f := tree.feature[node]) >= 0:
            left = tree.missing_left[node] if row[f] == boosting.MISSING else row[f] <= tree.cut[node]
            node = 2 * node + (1 if left else 2)
        return node

    assert tree.leaves_of(bins).tolist() == [walk(r) for r in bins.tolist()]
    model = boosting.Booster(list("abcd"), [np.zeros(0)] * 4, "squared", 0.5, np.zeros(1), [[tree]], 1)
    left = {int(n): tree.goes_left(bins, n) for n in np.flatnonzero(tree.feature >= 0)}
    assert (boosting.passed(tree) is None) == (len(left) > boosting.LOOKED_UP)
    assert np.allclose(boosting.contributions(model, bins), 0.5 * boosting.shapley(tree, left, 4), atol=1e-12)
    assert np.allclose(boosting.expected(model) + boosting.contributions(model, bins).sum(1), model.margin(bins)[:, 0], atol=1e-9)


@pytest.mark.parametrize(("splits", "gap"), [(3, 0), (4, 2), (5, 1)])
def test_no_fold_trains_within_the_gap(rows, splits, gap):
    folded = boosting.gap_folds(rows, "day", splits, gap).select("day", "_fold", *[boosting.trains(k).alias(f"t{k}") for k in range(splits)]).toPandas()
    n, size = 50, 50 // (splits + 1)
    for k in range(splits):
        start = n - splits * size + k * size
        assert set(folded[folded._fold == k].day) == set(range(start, start + size))
        assert set(folded[folded[f"t{k}"]].day) == set(range(start - gap))


def test_cross_validation(spark, rows):
    base = boosting.Spec(F.lit(True), rounds=12, rate=0.3, patience=4)
    model, point, held = boosting.cross_validated(rows, NAMES, "y", "day", base, {"depth": [1, 3]}, 3, 1, Scratch(spark))
    held = held.select("id", "y", "prediction", "_fold").toPandas()
    assert len(held) == 36 * 8 and sorted(held._fold.unique()) == [0, 1, 2]
    by_fold = held.groupby("_fold").apply(lambda x: ((x.y - x.prediction) ** 2).mean() ** 0.5, include_groups=False)
    assert point["loss"] == pytest.approx(by_fold.mean(), rel=1e-4) and point["depth"] == 3 and len(model.trees) == point["rounds"]
