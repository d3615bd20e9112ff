"""Exact quantiles by distributed selection, with state of bounded size in every task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumispan.functions.lineage import cut

ACCURACY = 2000  # of the sketch that gives brackets: ranks are off by one in so many at most
FEW = 50_000  # distinct values that one reducer may sort


def exact_quantiles(rows: DataFrame, value: Column | str, shares: Sequence[float]) -> list[float | None]:
    """The quantiles of a numeric column at ``shares`` (0 to 1), interpolated between neighbours as quantile_cont does.

    A sketch gives a bracket around each rank; a count of what lies below and inside tells the rank within it, and the bracket
    is narrowed in the same way until it has at most FEW distinct values, whose counts give the answer. Equal values are
    counted, never listed. Null and NaN are left out; without values all quantiles are None.
    """
    if any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares lie between 0 and 1")
    column = F.col(value) if isinstance(value, str) else value
    held = cut(rows.select(column.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")))
    total = held.count()
    if not total:
        return [None] * len(shares)
    known: dict[int, float] = {}
    places = []
    for s in shares:
        at = s * (total - 1)
        low = min(int(at), total - 1)
        places.append((low, min(low + 1, total - 1), at - low))
    for low, high, _ in places:
        if low not in known or high not in known:
            known[low], known[high] = _selected(held, low, high, total)
    return [known[a] + (known[b] - known[a]) * f if f else known[a] for a, b, f in places]


def _selected(held: DataFrame, low: int, high: int, n: int) -> tuple[float, float]:
    """The values of ranks ``low`` and ``high``, neighbours or equal, counted from 0, among ``n``."""
    inside, below = held, 0
    while True:
        if n <= FEW or inside.select("v").distinct().limit(FEW + 1).count() <= FEW:
            found = inside.groupBy("v").agg(F.count("*").alias("n")).orderBy("v").toArrow()  # at most FEW rows
            values, counts = found.column("v").to_pylist(), found.column("n").to_pylist()
            out, seen = [], below
            for v, c in zip(values, counts, strict=True):
                seen += c
                while len(out) < 2 and seen > (low, high)[len(out)]:
                    out.append(v)
            return out[0], out[1]
        margin = 2.0 / ACCURACY
        share = lambda rank, by: min(1.0, max(0.0, (rank - below) / n + by))
        sketch = inside.agg(F.percentile_approx("v", [share(low, -margin), share(high, margin)], ACCURACY)).first()[0]
        a = float("-inf") if share(low, -margin) <= 0 else sketch[0]
        b = float("inf") if share(high, margin) >= 1 else sketch[1]
        counts = inside.agg(F.count_if(F.col("v") < a).alias("less"), F.count_if(F.col("v").between(a, b)).alias("mid")).first()
        if not below + counts.less <= low or not high < below + counts.less + counts.mid:
            raise ArithmeticError("the sketch missed its bracket")
        if a == b:  # copies of one value
            return a, a
        if counts.mid == n:
            # nothing is cut off: halve by value, which ends since doubles are finite in number
            r = inside.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
            middle = r.a / 2 + r.b / 2
            left = inside.where(F.col("v") <= middle).count()
            if below + left > high:
                inside, n = inside.where(F.col("v") <= middle), left
            elif below + left <= low:
                inside, below, n = inside.where(F.col("v") > middle), below + left, n - left
            else:  # the ranks are on both sides
                return inside.where(F.col("v") <= middle).agg(F.max("v")).first()[0], inside.where(F.col("v") > middle).agg(F.min("v")).first()[0]
            continue
        inside, below, n = inside.where(F.col("v").between(a, b)), below + counts.less, counts.mid
