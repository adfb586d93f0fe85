"""Quantiles by narrowing against percentile, to the last bit where ranks are hit and to rounding between them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloudloom.operators.quantiles import quantiles


@pytest.mark.parametrize("few", [3, 50, 20_000])
def test_groups_of_any_size_and_shape(spark, few):
    draw = np.random.default_rng(7)
    parts = {"even": draw.random(3000), "heavy": np.concatenate([np.full(2500, 1.5), draw.random(300)]), "far": np.exp(draw.normal(size=900) * 40), "one": np.full(400, -2.0), "few": draw.random(2), "single": [4.0], "twice": np.repeat(draw.random(90), 2)}
    rows = [(None if g == "even" else g, float(v)) for g, vs in parts.items() for v in vs] + [("none", None), ("few", None)]
    table = spark.createDataFrame(rows, "g string, z double").repartition(6)
    ps = (0.0, 0.02, 0.25, 0.5, 0.95, 1.0)
    got = {r.g: r.q for r in quantiles(table, ["g"], "z", ps, few=few).collect()}
    want = {r.g: r.q for r in table.where("z is not null").groupBy("g").agg(F.percentile("z", F.array(*map(F.lit, ps))).alias("q")).collect()}
    assert set(got) == set(want) == {None, *set(parts) - {"even"}}
    for g, q in want.items():
        assert np.allclose(got[g], q, rtol=1e-12, atol=0)
    whole = quantiles(table.where("g is null"), [], "z", ps, few=few).first().q
    assert np.allclose(whole, np.quantile(parts["even"], ps), rtol=1e-12)
    assert quantiles(table.limit(0), [], "z", ps).count() == 0


def test_two_keys(spark):
    rows = spark.createDataFrame(pd.DataFrame({"a": np.arange(400) % 2, "b": np.arange(400) % 3, "z": np.arange(400.0)}))
    got = {(r.a, r.b): r.mid[0] for r in quantiles(rows, ["a", "b"], "z", (0.5,), "mid", few=10).collect()}
    assert got == {(a, b): float(np.median([k for k in range(400) if k % 2 == a and k % 3 == b])) for a in range(2) for b in range(3)}
