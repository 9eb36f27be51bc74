"""Autoregressive and moving-average forecasts against plain regressions on every row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.plans import arma as A


def arma_series(n, ar, ma, seed):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n + 50)
    d = np.zeros(n + 50)
    for t in range(2, n + 50):
        d[t] = sum(w * d[t - 1 - i] for i, w in enumerate(ar)) + e[t] + sum(w * e[t - 1 - i] for i, w in enumerate(ma))
    return 100 + np.cumsum(d[50:])


def plain(y, horizon, season=0, ar=2, ma=2, long=6):
    """The same two stages on matrices of rows: order, changes ahead, spread."""
    d = np.diff(y)
    w = d[season:] - d[:-season] if season else d
    depth = long + ma
    rows = np.array([w[t - depth : t + 1][::-1] for t in range(depth, len(w))])
    alone = np.linalg.lstsq(rows[:, 1 : long + 1], rows[:, 0], rcond=None)[0]
    e = {k: rows[:, k] - rows[:, k + 1 : k + 1 + long] @ alone for k in range(1, ma + 1)}
    n = len(rows)
    best = (n * np.log(np.mean(rows[:, 0] ** 2)) + 2, 0, 0, np.zeros(0), np.mean(rows[:, 0] ** 2))
    for p in range(ar + 1):
        for q in range(ma + 1):
            if p + q:
                x = np.column_stack([*[rows[:, i] for i in range(1, p + 1)], *[e[k] for k in range(1, q + 1)]])
                beta = np.linalg.lstsq(x, rows[:, 0], rcond=None)[0]
                s2 = np.mean((rows[:, 0] - x @ beta) ** 2)
                aic = n * np.log(s2) + 2 * (p + q + 1)
                inside = lambda v: not len(v) or np.abs(np.roots([1, *-v])).max() < 0.999
                if aic < best[0] and inside(beta[:p]) and inside(-beta[p:]):
                    best = (aic, p, q, beta, s2)
    _, p, q, beta, s2 = best
    shocks = [w[-1 - k] - w[-2 - k : -2 - k - long : -1] @ alone for k in range(q)]
    path, errors, plain_d = list(w), shocks[::-1], list(d)
    for h in range(horizon):
        value = sum(beta[i] * path[-1 - i] for i in range(p)) + sum(beta[p + j] * errors[-1 - j] for j in range(q))
        path.append(value)
        errors.append(0.0)
        plain_d.append(value + (plain_d[len(plain_d) - season] if season else 0.0))
    return p, q, beta, s2, y[-1] + np.cumsum(plain_d[len(d) :])


@pytest.fixture(scope="module")
def planted(spark):
    kinds = {"arma11": ([0.7], [0.5]), "ma1": ([], [0.8]), "ar2": ([0.5, 0.3], []), "noise": ([], [])}
    series = {(k, i): arma_series(600, *v, seed=10 * j + i) for j, (k, v) in enumerate(kinds.items()) for i in range(3)}
    rows = [(k, i, t, float(v)) for (k, i), y in series.items() for t, v in enumerate(y)]
    return series, spark.createDataFrame(rows, "kind string, number int, t int, y double").repartition(5)


def found_of(frame):
    rows = {}
    for r in frame.orderBy("step").collect():
        rows.setdefault((r["kind"], r["number"]), []).append(r)
    return rows


@pytest.mark.parametrize("season,limit", [(0, 10**6), (12, 10**6), (0, 50)])
def test_equals_regressions_on_rows(planted, season, limit):
    series, frame = planted
    found = found_of(A.forecast_arma(frame, ["kind", "number"], ["t"], "y", 30, season, limit=limit))
    assert set(found) == set(series)
    for key, y in series.items():
        p, q, _, s2, values = plain(y, 30, season)
        rows = found[key]
        assert (rows[0]["p"], rows[0]["q"]) == (p, q)
        np.testing.assert_allclose([r["value"] for r in rows], values, atol=2e-3)
        reach = (rows[0]["upper"] - rows[0]["lower"]) / 2
        assert reach == pytest.approx(1.95996 * s2**0.5, rel=1e-3)


def test_planted_terms_are_recovered(planted):
    series, _ = planted
    for i in range(3):
        y = series["arma11", i]
        d = np.diff(y)
        depth = 8
        rows = np.array([d[t - depth : t + 1][::-1] for t in range(depth, len(d))])
        ar, ma, variance, _ = A.fit_orders(rows.T @ rows, len(rows), 6, 1, 1)
        assert ar[0] == pytest.approx(0.7, abs=0.12) and ma[0] == pytest.approx(0.5, abs=0.15)
        assert variance == pytest.approx(1.0, abs=0.15)


def test_orders_follow_the_plant(planted):
    _, frame = planted
    found = found_of(A.forecast_arma(frame, ["kind", "number"], ["t"], "y", 1))
    assert all(found["arma11", i][0]["p"] >= 1 for i in range(3)) and all(found["ma1", i][0]["q"] >= 1 or found["ma1", i][0]["p"] == 2 for i in range(3))


def test_short_constant_null_and_no_series(spark):
    rows = [("one", 1, 5.0), *[("flat", t, 3.0) for t in range(80)], *[(None, t, float(t * t % 7)) for t in range(90)], ("gone", 1, None)]
    df = spark.createDataFrame(rows, "s string, t int, y double")
    found = {}
    for r in A.forecast_arma(df, ["s"], ["t"], "y", 3, season=4).collect():
        found.setdefault(r["s"], []).append(r)
    assert set(found) == {"one", "flat", None}
    assert [(r["value"], r["lower"]) for r in found["one"]] == [(5.0, 5.0)] * 3
    assert [r["value"] for r in found["flat"]] == [3.0] * 3
    assert len(found[None]) == 3 and found[None][0]["lower"] <= found[None][0]["value"]
    alone = A.forecast_arma(df.where("s = 'flat'"), [], ["t"], "y", 2).collect()
    assert [r["value"] for r in alone] == [3.0, 3.0]
    assert A.forecast_arma(df.where("false"), ["s"], ["t"], "y", 2).count() == 0


def test_number_of_jobs_does_not_grow_with_series(spark, planted):
    _, frame = planted
    tag = "arma-jobs"

    def jobs(df):
        spark.sparkContext.setJobGroup(tag, tag)
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))
        A.forecast_arma(df, ["kind", "number"], ["t"], "y", 2, largest=600).collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag)) - before

    assert 0 < jobs(frame) <= jobs(frame.where(F.col("kind") == "ma1")) + 1


def test_query_against_regressions_on_rows(spark, sf_dir):
    from tabloom.catalog import forecasting

    sums = {}
    for r in forecasting.many(spark, sf_dir).orderBy("sort_key").collect():
        sums.setdefault((r["o_orderstatus"], r["o_orderpriority"]), []).append(r["y"])
    found = {}
    for r in forecasting.forecast_arma(spark, sf_dir).orderBy("step").collect():
        found.setdefault((r["o_orderstatus"], r["o_orderpriority"]), []).append(r)
    assert set(found) == set(sums)
    for key, y in sums.items():
        if len(y) > 60:
            p, q, _, _, values = plain(np.array(y), 12)
            assert (found[key][0]["p"], found[key][0]["q"]) == (p, q)
            np.testing.assert_allclose([r["value"] for r in found[key]], values, atol=2e-3)
