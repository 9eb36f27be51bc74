"""Quantiles read digit by digit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import quantiles as Q


def test_doubles_keep_their_order():
    values = np.array([-np.inf, -1e300, -2.5, -5e-324, 0.0, 5e-324, 1.0, 1.0000000000000002, 7.5, np.inf, np.nan])
    places = Q._as_ordered(values)
    assert (np.diff(places.astype(object)) > 0).all()
    assert [Q._as_double(int(p)) for p in places[:-1]] == values[:-1].tolist()
    assert Q._as_ordered(np.array([-0.0])) == Q._as_ordered(np.array([0.0]))


@pytest.mark.parametrize("brackets", [400, 7])
def test_quantiles_without_sketches(spark, monkeypatch, brackets):
    """Many columns and ranks: jobs are as many as digits, and no rank has a sketch of its own."""
    monkeypatch.setattr(Q, "_MOST_BRACKETS", brackets)
    monkeypatch.setattr(Q, "_narrow", lambda *_: pytest.fail("a sketch per rank"))
    rng = np.random.RandomState(1)
    n = 3000
    x, d = rng.randn(n) * 10.0 ** rng.randint(-20, 20, n), rng.randint(-2, 2, n) * 0.5
    rows = [(float(a), float(b), 4.25, None if i % 7 else float(a)) for i, (a, b) in enumerate(zip(x, d, strict=True))]
    df = spark.createDataFrame(rows, "x double, d double, c double, gaps double").repartition(5)
    probs = [i / 10 for i in range(11)]
    found = Q.quantiles(df, {c: F.col(c) for c in df.columns}, probs, limit=100)
    for name, values in (("x", x), ("d", d), ("c", np.full(n, 4.25)), ("gaps", x[::7])):
        np.testing.assert_allclose(found[name], np.quantile(values, probs), rtol=1e-12)
