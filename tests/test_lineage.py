"""Cut tables know their own size, not that of the plan behind them."""

import re

from lumispan.functions.lineage import cut


def test_sizes_do_not_grow_over_rounds(spark, capsys):
    """Rounds that join what earlier rounds gave: the size that plans count with stays that of three rows."""
    d = cut(spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 5.0)], "k long, v double"))
    for _ in range(6):
        d = cut(d.join(d.select("k", d.v.alias("w")), "k").selectExpr("k", "v + w AS v"))
    assert {tuple(r) for r in d.collect()} == {(1, 128.0), (2, 192.0), (3, 320.0)}
    d.explain(mode="cost")
    size, unit = re.search(r"sizeInBytes=([0-9.E+]+) (\w+)", capsys.readouterr().out).groups()
    assert float(size) < 5000 and unit in ("B", "KiB")


def test_empty_tables_and_arrays(spark):
    d = cut(spark.createDataFrame([], "a array<long>, s struct<x:double>"))
    assert d.count() == 0 and d.columns == ["a", "s"]
    assert cut(spark.createDataFrame([([1, None], (0.5,))], "a array<long>, s struct<x:double>")).first().a == [1, None]
