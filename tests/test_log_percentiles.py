import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veridraft.operators import log_percentiles as L

VALUES = st.lists(st.floats(min_value=-1e9, max_value=1e9, allow_nan=False).map(lambda x: 0.0 if abs(x) < 1e-6 else x), min_size=1, max_size=60)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(VALUES.map(lambda v: [abs(x) for x in v]))
def test_bound_holds(spark, values):
    df = spark.createDataFrame([("g", v) for v in values], "k string, v double")
    got = L.percentiles(L.sketch(df, "v", ["k"], error=0.02), ["k"], error=0.02, decimals=None).head()
    assert got["n"] == len(values)
    for q in L.PERCENTILES:
        exact = float(np.percentile(values, q))
        assert abs(got[f"p{q}"] - exact) <= 0.02 * abs(exact) * (1 + 1e-9) + 1e-12


def test_signed_order(spark):
    df = spark.createDataFrame([(float(v),) for v in (-100, -1, 0, 1, 100)], "v double").withColumn("k", F.lit(1))
    s = L.sketch(df, "v", ["k"], keep=F.lit(True))
    got = L.percentiles(s, ["k"], qs=(0, 50, 100), decimals=None).head()
    assert got["p50"] == 0 and abs(got["p0"] + 100) <= 1 and abs(got["p100"] - 100) <= 1


def test_days_join_exactly(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("day"), F.lit("m").alias("model"), (F.rand(3) * 1e4).alias("v"))
    whole = L.sketch(df, "v", ["model"])
    days = [L.sketch(df.where(F.col("day") == d), "v", ["model"]) for d in range(7)]
    assert sorted(map(tuple, L.merge(*days, by=["model"]).collect())) == sorted(map(tuple, whole.collect()))


def test_refused_values_and_null_groups(spark):
    rows = [("a", v) for v in (1.0, -1.0, math.nan, math.inf, None)] + [(None, 5.0)]
    got = {r["k"]: r["n"] for r in L.percentiles(L.sketch(spark.createDataFrame(rows, "k string, v double"), "v", ["k"]), ["k"]).collect()}
    assert got == {"a": 1, None: 1}
    assert L.percentiles(L.sketch(spark.createDataFrame([], "k string, v double"), "v", ["k"]), ["k"]).count() == 0
