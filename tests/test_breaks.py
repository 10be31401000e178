"""Quantile breaks and ranks against numpy."""

import numpy as np
import pytest

from parcelwise.operators import profile


def test_breaks_without_a_buffer(spark):
    draw = np.random.default_rng(1)
    cases = {
        "normal": draw.normal(0, 1, 3000),
        "wide": np.concatenate([10.0 ** draw.uniform(-300, 300, 200), [-1e308, 1e308]]),  # many rounds
        "ties": draw.integers(0, 3, 500).astype(float),
        "one": np.array([7.5]),
        "two": np.array([1.0, 2.0]),
    }
    rows = [(k, float(v)) for k, case in cases.items() for v in case]
    odd = [("normal", None), ("ties", float("nan")), ("two", float("inf")), ("none", None)]
    values = spark.createDataFrame(rows + odd, "key string, value double")
    found = {(r["key"], r["class"]): r["break"] for r in profile.class_breaks(values, "quantile", 4).collect()}
    assert len(found) == 3 * len(cases)
    for k, case in cases.items():
        for i in (1, 2, 3):
            assert found[k, i] == pytest.approx(np.quantile(case, i / 4), rel=1e-9)
    ranks = spark.createDataFrame([("normal", r) for r in (0, 17, 2999, 3000, -1)] + [("none", 0)], "key string, rank bigint")
    got = {r["rank"]: r["value"] for r in profile.order_statistics(values, ranks).collect()}
    at = np.sort(cases["normal"])
    assert got == {r: at[r] for r in (0, 17, 2999)}
