"""Merging of counts, means, variances and third moments of disjoint parts."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Moments:
    n: int
    mean: float
    var: float
    low: float
    high: float
    skew: float = 0.0

    @staticmethod
    def columns(x: Column) -> list[Column]:
        return [
            F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"),
            F.min(x).alias("lo"), F.max(x).alias("hi"), F.skewness(x).alias("skew"),
        ]

    @staticmethod
    def of(row) -> Moments:
        return Moments(row["n"], row["mean"], row["var"], row["lo"], row["hi"], row["skew"] or 0.0)

    @staticmethod
    def merge(parts: list[Moments]) -> Moments:
        """Pairwise update of central moments (Chan, Golub and LeVeque)."""
        parts = [p for p in parts if p.n]
        total = parts[0]
        for p in parts[1:]:
            n, delta = total.n + p.n, p.mean - total.mean
            m2a, m2b = total.var * total.n, p.var * p.n
            m3a = total.skew * total.n * total.var**1.5
            m3b = p.skew * p.n * p.var**1.5
            m2 = m2a + m2b + delta**2 * total.n * p.n / n
            m3 = (
                m3a + m3b
                + delta**3 * total.n * p.n * (total.n - p.n) / n**2
                + 3 * delta * (total.n * m2b - p.n * m2a) / n
            )
            var = m2 / n
            skew = m3 / n / var**1.5 if var > 0 and not math.isnan(m3) else 0.0
            total = Moments(n, total.mean + delta * p.n / n, var, min(total.low, p.low), max(total.high, p.high), skew)
        return total
