"""Fold-wise calibration and blends: what the SQL doesn't say."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintra.operators import calibration
from vintra.queries import QUERIES
from vintra.queries.base import COMPONENTS
from vintra.queries.scoring import folded, wide


def test_folds_see_no_later_outcome(spark, small):
    """Outcomes published from a fold's start on don't move its maps."""
    rows = folded(spark, small)
    run = lambda df: {r["id"]: r["calibrated"] for r in calibration.fold_isotonic(df, ["model"], "fold", "starts", "published", ["id"]).where("fold = 1995").collect()}
    changed = rows.withColumn("outcome", F.when(F.col("published") >= F.lit("1995-01-01").cast("date"), "P").otherwise(F.col("outcome")))
    assert run(rows) == run(changed) and len(run(rows)) > 50


def test_calibrated_maps_sum_to_one(spark, small):
    got = QUERIES["m19_fold_calibration"](spark, small).toPandas()
    assert np.allclose(got[["F", "O", "P"]].sum(axis=1), 1) and (got[["F", "O", "P"]] >= 0).all().all()
    assert len(got) == folded(spark, small).count()


def test_isotonic_edges(spark):
    train = spark.createDataFrame([("a", 0.2, "no"), ("a", 0.4, "yes"), ("a", 0.5, "no"), ("a", 0.9, "yes"), ("a", 0.9, "yes"), ("b", 0.3, "yes"), ("a", 0.7, None), ("a", None, "yes"), (None, 0.1, "no"), (None, 0.8, "yes")], "k string, p double, outcome string")
    asked = spark.createDataFrame([("a", 0.0), ("a", 0.2), ("a", 0.3), ("a", 0.45), ("a", 0.7), ("a", 1.0), ("b", 0.3), ("c", 0.6), (None, 0.1), ("a", None)], "k string, p double")
    got = {(r["k"], r["p"]): r["calibrated"] for r in calibration.isotonic(train, asked, ["k"]).collect()}
    assert got[("a", 0.0)] == got[("a", 0.2)] == 0 and got[("a", 0.3)] == pytest.approx(0.25) and got[("a", 0.45)] == 0.5 and got[("a", 0.7)] == pytest.approx(0.75) and got[("a", 1.0)] == 1
    assert got[("b", 0.3)] == 0.3 and got[("c", 0.6)] == 0.6 and got[(None, 0.1)] == 0 and got[("a", None)] is None
    assert calibration.isotonic(train.limit(0), asked, ["k"]).count() == 10


def test_platt_and_isotonic_lie_in_range(spark, small):
    got = QUERIES["m19_isotonic_and_platt"](spark, small).toPandas()
    assert set(got.component) == set(COMPONENTS) and got[["isotonic", "platt"]].stack().between(0, 1).all()


@pytest.mark.parametrize("method", ["learned", "inverse_variance", "equal"])
def test_blend_has_no_nested_loop(spark, small, method):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = calibration.walk_forward_blend(wide(spark, small), list(COMPONENTS), "y", "resolved_at", "ask_date", True, method)
        plan = out._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_strict_and_inclusive_history(spark):
    rows = spark.createDataFrame([(1, "2024-01-01", "2024-01-05", 0.5, 1.0), (2, "2024-01-05", "2024-01-09", 0.5, 1.0), (3, "2024-01-06", None, 0.5, None)], "id int, asked string, out string, a double, y double")
    rows = rows.withColumn("asked", F.col("asked").cast("date")).withColumn("out", F.col("out").cast("date"))
    count = lambda strict: {r["id"]: r["n_history"] for r in calibration.walk_forward_blend(rows, ["a"], "y", "out", "asked", strict).collect()}
    assert count(True) == {1: 0, 2: 0, 3: 1} and count(False) == {1: 0, 2: 1, 3: 1}
