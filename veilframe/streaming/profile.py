"""Running profiles of a stream: mergeable aggregates only (counts, sums, extremes), no P-square."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cells import cells_of


@dataclass
class Moments:
    """Count, mean and sum of squared deviations, merged pairwise (Chan et al., 1979)."""

    rows: int = 0
    missing: int = 0
    n: int = 0
    mean: float = 0.0
    m2: float = 0.0
    low: float | None = None
    high: float | None = None

    def merge(self, o: Moments) -> Moments:
        n = self.n + o.n
        gap = o.mean - self.mean
        low = [x for x in (self.low, o.low) if x is not None]
        high = [x for x in (self.high, o.high) if x is not None]
        return Moments(self.rows + o.rows, self.missing + o.missing, n, self.mean + gap * o.n / n if n else 0.0, self.m2 + o.m2 + gap * gap * self.n * o.n / n if n else 0.0, min(low, default=None), max(high, default=None))

    @property
    def std_dev(self) -> float | None:
        return (self.m2 / (self.n - 1)) ** 0.5 if self.n > 1 else None


def batch_moments(df: DataFrame) -> dict[str, Moments]:
    """One row for each task goes over the wire."""
    cells = cells_of(df)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in cells:
        number = c.number if c.number is not None else F.lit(None).cast("double")
        x = F.when(c.filled & ~F.isnan(number), number)
        aggs += [F.count(F.when(c.missing, 1)).alias(f"miss{c.index}"), F.count(x).alias(f"n{c.index}"), F.avg(x).alias(f"mean{c.index}"), F.var_pop(x).alias(f"var{c.index}"), F.min(x).alias(f"low{c.index}"), F.max(x).alias(f"high{c.index}")]
    got = df.agg(*aggs).first()
    return {c.header: Moments(got["rows"], got[f"miss{c.index}"], got[f"n{c.index}"], got[f"mean{c.index}"] or 0.0, (got[f"var{c.index}"] or 0.0) * got[f"n{c.index}"], got[f"low{c.index}"], got[f"high{c.index}"]) for c in cells}


class RunningProfile:
    """For writeStream.foreachBatch: adds each batch once, even if it is delivered again."""

    def __init__(self, then: Callable[[int, dict[str, Moments]], None] | None = None):
        self.columns: dict[str, Moments] = {}
        self.done, self.then = -1, then

    def __call__(self, df: DataFrame, batch: int) -> None:
        if batch <= self.done:
            return
        for name, m in batch_moments(df).items():
            self.columns[name] = self.columns.get(name, Moments()).merge(m)
        self.done = batch
        if self.then:
            self.then(batch, self.columns)


def windowed_counts(events: DataFrame, time: str = "ts", every: str = "1 hour", late: str = "10 minutes", by: str | None = None) -> DataFrame:
    """Rows by time window (and a column), with a watermark that bounds the state."""
    keys = [F.window(time, every), *([F.col(by)] if by else [])]
    return events.withWatermark(time, late).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
