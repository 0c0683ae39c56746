"""Exact percentiles of very long columns, per group, without sorting them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096


def exact_percentiles(
    df: DataFrame,
    key: str,
    value: str,
    probs: Sequence[float],
    extra: dict[str, tuple[float, int]] | None = None,
    direct_rows: int = 1_000_000,
) -> dict[str, list[float]]:
    """Linearly interpolated percentiles of ``value`` for each ``key``.

    ``key`` has few values (source or combination names). ``extra`` adds one
    weighted value per key: the value of all pairs that are not stored.

    While the interval around a wanted position holds more than ``direct_rows``
    rows it is counted in equal-width bins and replaced by the bin that holds
    the position. Every pass is one scan, combines before its shuffle and
    returns bin counts only; a hot value ends as an interval of one value.
    """
    spark = df.sparkSession
    rows = df.filter(F.col(value).isNotNull()).select(
        F.col(key).alias("k"), F.col(value).cast("double").alias("v"), F.lit(1).cast("long").alias("w")
    )
    single = [(k, float(v), int(n)) for k, (v, n) in (extra or {}).items() if n > 0]
    if single:
        rows = rows.unionByName(spark.createDataFrame(single, "k string, v double, w long"))

    spans = rows.groupBy("k").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("w").alias("w"), F.count("v").alias("rows")
    ).collect()
    sizes = {r["k"]: r["w"] for r in spans}
    # (key, position) -> lowest value, highest value, rows inside, weight before the interval
    state = {}
    for r in spans:
        for q in probs:
            low = int(q * (r["w"] - 1))
            for p in (low, min(low + 1, r["w"] - 1)):
                state[r["k"], p] = (r["lo"], r["hi"], r["rows"], 0)

    while True:
        wide = {(k, lo, hi, b) for (k, _), (lo, hi, n, b) in state.items() if n > direct_rows and lo < hi}
        if not wide:
            break
        bins: dict = {}
        for r in _count_bins(rows, [(k, lo, hi) for k, lo, hi, _ in wide]):
            bins.setdefault((r["k"], r["lo"], r["hi"]), []).append(r)
        for (k, p), (lo, hi, n, before) in list(state.items()):
            if (k, lo, hi, before) not in wide:
                continue
            for r in sorted(bins[k, lo, hi], key=lambda r: r["bin"]):
                if p < before + r["w"]:
                    state[k, p] = (r["low"], r["high"], r["rows"], before)
                    break
                before += r["w"]

    found = {at: lo for at, (lo, hi, _, _) in state.items() if lo == hi}
    open_ones = [(k, lo, hi, b, p) for (k, p), (lo, hi, _, b) in state.items() if lo < hi]
    if open_ones:
        found.update(_read_positions(rows, open_ones))

    result = {}
    for k, n in sizes.items():
        result[k] = []
        for q in probs:
            low = int(q * (n - 1))
            a, b = found[k, low], found[k, min(low + 1, n - 1)]
            result[k].append(a + (b - a) * (q * (n - 1) - low))
    return result


def _inside(rows: DataFrame, intervals: list[tuple]) -> DataFrame:
    """Rows with the interval they fall in; the list has a few entries per key."""
    table = rows.sparkSession.createDataFrame(sorted(set(intervals)), "k string, lo double, hi double")
    return rows.join(F.broadcast(table), "k").filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))


def _count_bins(rows: DataFrame, intervals: list[tuple]) -> list:
    at = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)
    return (
        _inside(rows, intervals)
        .withColumn("bin", F.least(at, F.lit(BINS - 1)))
        .groupBy("k", "lo", "hi", "bin")
        .agg(F.sum("w").alias("w"), F.count("v").alias("rows"), F.min("v").alias("low"), F.max("v").alias("high"))
        .collect()
    )


def _read_positions(rows: DataFrame, wanted: list[tuple]) -> dict:
    """Values at positions inside intervals of a bounded number of rows."""
    counts = _inside(rows, [w[:3] for w in wanted]).groupBy("k", "lo", "hi", "v").agg(F.sum("w").alias("w"))
    order = Window.partitionBy("k", "lo", "hi").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    through = counts.withColumn("through", F.sum("w").over(order))
    asked = rows.sparkSession.createDataFrame(
        [(k, lo, hi, p - b, p) for k, lo, hi, b, p in wanted], "k string, lo double, hi double, at long, p long"
    )
    hit = through.join(F.broadcast(asked), ["k", "lo", "hi"]).filter(
        (F.col("at") < F.col("through")) & (F.col("at") >= F.col("through") - F.col("w"))
    )
    return {(r["k"], r["p"]): r["v"] for r in hit.select("k", "p", "v").collect()}
