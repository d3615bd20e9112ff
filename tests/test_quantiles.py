"""Exact quantiles against numpy, with brackets of several rounds."""

import numpy as np
import pytest

from lumispan.functions import quantiles

SHARES = [0.0, 0.003, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("kind", ["normal", "ties", "tails", "two", "few"])
def test_equal_to_numpy(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "FEW", 40)
    monkeypatch.setattr(quantiles, "ACCURACY", 100)
    rng = np.random.default_rng(1)
    x = {"normal": rng.normal(size=3000), "ties": np.round(rng.normal(size=3000), 1), "tails": rng.standard_cauchy(2000) ** 3, "two": np.repeat([1.5, -2.0], [1000, 1001]), "few": rng.normal(size=7)}[kind]
    d = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double").repartition(5)
    got = quantiles.exact_quantiles(d, "v", SHARES)
    assert np.allclose(got, np.quantile(x, SHARES), rtol=1e-12, atol=0)


def test_ends(spark):
    none = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert quantiles.exact_quantiles(none, "v", [0.5, 1.0]) == [None, None]
    assert quantiles.exact_quantiles(spark.createDataFrame([(4,)], "v int"), "v", [0.0, 0.5]) == [4.0, 4.0]
    with pytest.raises(ValueError, match="between 0 and 1"):
        quantiles.exact_quantiles(none, "v", [1.5])
