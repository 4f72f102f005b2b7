"""Every query against its SQL in DuckDB, on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import numpy as np
import pytest

from vintra.queries import ORACLE, QUERIES


@pytest.fixture(scope="session")
def con(small):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, datetime.datetime):
        v = v.replace(tzinfo=None)
        return str(v.date()) if v.time() == datetime.time() else str(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if v is None or isinstance(v, (bool, str)):
        return v
    try:
        return "nan" if math.isnan(float(v)) else float(f"{float(v):.8g}") + 0.0
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, small, con, name):
    df = QUERIES[name](spark, small)
    cursor = con.execute(ORACLE[name])
    columns = sorted(c[0] for c in cursor.description)
    at = [[c[0] for c in cursor.description].index(c) for c in columns]
    want = sorted((str([plain(r[i]) for i in at]) for r in cursor.fetchall()))
    assert sorted(df.columns) == columns
    assert sorted(str([plain(r[c]) for c in columns]) for r in df.collect()) == want


#: Tested by value in test_model_queries.
VALUED = {"p6_statistical_models", "m19_fold_calibration", "m19_isotonic_and_platt", "p7_boosted_changes", "p8_decision_probabilities", "p9_threshold_probabilities", "p10_explained_prices"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - VALUED))
def test_without_sql(spark, small, name):
    """Rows, no missing keys, and the same ones again."""
    rows = [sorted(str([plain(v) for v in r]) for r in QUERIES[name](spark, small).collect()) for _ in range(2)]
    assert rows[0] and rows[0] == rows[1]


def test_bootstrap_against_plain_draws(spark, small):
    """Ends close to those of other draws of the same clusters, and a group of one cluster has none."""
    from vintra.operators import metrics

    rng = np.random.default_rng(1)
    rows = [("g", f"c{k}", float(v)) for k in range(30) for v in rng.normal(k % 5, 1, 20)] + [("one", "c", 1.0), (None, "a", 1.0), (None, "b", 2.0)]
    got = {r["g"]: (r["low"], r["high"]) for r in metrics.cluster_bootstrap(spark.createDataFrame(rows, "g string, c string, v double"), ["g"], "c", "v").collect()}
    sums = np.array([[sum(v for g, c, v in rows if g == "g" and c == f"c{k}"), 20] for k in range(30)])
    means = [(x := sums[rng.integers(0, 30, 30)].sum(0))[0] / x[1] for _ in range(5000)]
    assert got["one"] == (None, None) and got[None] == (1.0, 2.0)
    assert got["g"] == pytest.approx(np.quantile(means, [0.025, 0.975]), abs=0.06)


def test_student_t():
    from vintra.functions.scalar import student_t_tail
    from vintra.operators.metrics import p_value

    # Table points of Student's t.
    for t, df, tail in ((6.314, 1, 0.05), (2.920, 2, 0.05), (1.812, 10, 0.05), (2.764, 10, 0.01), (1.697, 30, 0.05), (0.0, 7, 0.5)):
        assert student_t_tail(t, df) == pytest.approx(tail, abs=2e-4) and student_t_tail(-t, df) == pytest.approx(1 - tail, abs=2e-4)
    assert p_value(2.228, 11) == pytest.approx(0.05, abs=2e-4) == p_value(-2.228, 11)


def test_lookahead_is_refused(spark):
    from vintra.operators import validate

    rows = spark.createDataFrame([("2024-01-01", "2024-01-01"), ("2024-01-03", "2024-01-02")], "max_as_of_seen string, data_as_of string")
    assert validate.assert_no_lookahead(rows.limit(1)).count() == 1
    with pytest.raises(validate.LookaheadError, match="2024-01-03"):
        validate.assert_no_lookahead(rows)


def frame(spark, name, small):
    return QUERIES[name](spark, small).toPandas()


def test_bootstrap_intervals_hold_the_mean(spark, small):
    got = frame(spark, "m16_cluster_bootstrap", small).dropna(subset=["low", "high"])
    assert len(got) and (got.low <= got.high).all()
