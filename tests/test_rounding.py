"""Rounding half-even where a quotient's decimal text lies beside the half that its product hits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.functions import scaling
from kerbside.sources import sinks


def test_tidy_rounds_as_arrays_do(spark):
    cents = np.arange(-60_035, 60_035, 70) * 100 + np.arange(1716) % 100  # many sevenths end near a half
    sevenths = [*(cents / 100 / 7), 6468.35 / 7, -6468.35 / 7, 0.25, 0.35, math.inf, 1.7e308]
    df = spark.createDataFrame([(i, float(v), float(v)) for i, v in enumerate(sevenths)] + [(-1, None, None)], "i int, percent double, ndvi_mean double")
    out = sinks.tidy(df, {"i": "i", "percent": "share", "ndvi_mean": "ndvi"}, {"ndvi": 3})
    got = {r["i"]: (r["share"], r["ndvi"]) for r in out.collect()}
    assert dict(out.dtypes) == {"i": "int", "share": "double", "ndvi": "double"} and got.pop(-1) == (None, None)
    assert got.pop(len(sevenths) - 1) == (1.7e308, 1.7e308)  # too large to be scaled
    for i, v in enumerate(sevenths[:-1]):
        assert got[i] == (np.rint(v * 10) / 10, np.rint(v * 1000) / 1000)
    assert 924.0 in {a for a, _ in got.values()}


def test_floats_and_negative_digits(spark):
    df = spark.createDataFrame([(15.0, 2.5), (25.0, -0.25), (float("nan"), 0.75)], "a double, b float")
    assert [r["r"] for r in df.select(scaling.round_even(F.col("a"), -1).alias("r")).collect()][:2] == [20.0, 20.0]
    assert math.isnan(df.select(scaling.round_even(F.col("a"), 1).alias("r")).collect()[2]["r"])
    out = sinks.tidy(df, {"b": "b"}, {})
    assert out.dtypes == [("b", "float")] and [r["b"] for r in out.collect()] == pytest.approx([2.5, -0.2, 0.8])
