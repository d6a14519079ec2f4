"""Exact quantiles of whole columns without gathering the column anywhere."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Equal cells into which a bracket is counted in one pass.
CELLS = 4096


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) rows of the non-null values, as doubles."""
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column", "value").where("value is not null")


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float] | None]:
    """Linearly interpolated quantiles per column, as numbers on the driver; None for a column without values.

    Null, NaN and infinities are no values. One pass finds the range of every column; each further one counts the
    brackets around all ranks in CELLS cells, and the cell that holds a rank becomes its next bracket, until it holds
    one value only. So every pass moves at most CELLS rows per bracket and task, whatever the data. The columns are kept
    while this lasts, so that what makes them runs once.
    """
    columns, probs = list(dict.fromkeys(columns)), list(probs)
    named = {f"c{i}": c for i, c in enumerate(columns)}
    wide = df.select(*[_finite(F.col(c).cast("double")).alias(n) for n, c in named.items()]).persist()
    try:
        seen = wide.agg(*[f(n).alias(f"{k}_{n}") for n in named for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
        places = {n: [p * (seen[f"n_{n}"] - 1) for p in probs] for n in named if seen[f"n_{n}"]}
        found: dict[tuple[str, int], float] = {}
        # column, low, high, rows below, ranks sought
        todo = [(n, seen[f"lo_{n}"], seen[f"hi_{n}"], 0, sorted({r for x in xs for r in (math.floor(x), math.ceil(x))})) for n, xs in places.items()]
        while todo:
            found.update({(n, r): low for n, low, high, _, ranks in todo if low == high for r in ranks})
            todo = _narrow(wide, [t for t in todo if t[1] < t[2]])
    finally:
        wide.unpersist()

    def at(n: str, x: float) -> float:
        lo, hi = found[n, math.floor(x)], found[n, math.ceil(x)]
        return lo if lo == hi else (math.ceil(x) - x) * lo + (x - math.floor(x)) * hi

    return {c: [at(n, x) for x in places[n]] if n in places else None for n, c in named.items()}


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def _narrow(wide: DataFrame, brackets: list[tuple]) -> list[tuple]:
    """The cells that hold the ranks of the brackets, in one pass."""
    if not brackets:
        return []
    cells = []
    for n in dict.fromkeys(b[0] for b in brackets):
        own, cell = F.lit(None), F.lit(None)
        for i, (_, low, high, _, _) in ((i, b) for i, b in enumerate(brackets) if b[0] == n):
            inside = F.col(n).between(low, high)
            # Halves, so that the width of no range is infinite.
            place = F.width_bucket(F.col(n) / 2, F.lit(low / 2), F.lit(high / 2), F.lit(CELLS)) if low / 2 < high / 2 else (F.col(n) > low).cast("long")
            own, cell = F.when(inside, i).otherwise(own), F.when(inside, place).otherwise(cell)
        cells.append(F.struct(own.alias("b"), cell.alias("k"), F.col(n).alias("v")))
    rows = wide.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("b is not null")
    counts = rows.groupBy("b", "k").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    out = []
    for i, (n, _, _, below, sought) in enumerate(brackets):
        for r in sorted((r for r in counts if r.b == i), key=lambda r: r.lo):
            mine = [s for s in sought if below <= s < below + r.c]
            if mine:
                out.append((n, r.lo, r.hi, below, mine))
            below += r.c
    return out


def iqr_bounds(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> dict[str, tuple[float, float] | None]:
    q = exact_quantiles(df, columns, [0.25, 0.75])
    return {c: None if v is None else (v[0] - k * (v[1] - v[0]), v[1] + k * (v[1] - v[0])) for c, v in q.items()}


def outside(c: str, bounds: tuple[float, float] | None) -> Column:
    """False for missing values and where there are no bounds."""
    if bounds is None:
        return F.lit(False)
    return F.coalesce((F.col(c) < bounds[0]) | (F.col(c) > bounds[1]), F.lit(False))
