"""Histograms and density curves per source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlattice.runtime import choose


def _spans(rows: DataFrame) -> dict[str, tuple[float, float, int]]:
    """Range and weight per source, one row each."""
    found = rows.groupBy("source").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("w").alias("n")).collect()
    return {r["source"]: (r["lo"], r["hi"], r["n"]) for r in found}


def histogram(rows: DataFrame, bins: int = 50, density: bool = False, use_log: bool = False) -> DataFrame:
    """Counts of ``rows(source, value, w)`` in equal bins of every source's own range.

    Columns ``source, bin, low, high, frequency``, the last a density if asked;
    ``use_log`` bins ``log1p(value)``. A constant source gets a range of 1; one
    without any value keeps its bins, with null edges and frequencies.
    """
    if use_log:
        rows = rows.withColumn("value", F.log1p("value"))
    spans = {s: (lo, hi, n) if lo is None or lo < hi else (lo - 0.5, hi + 0.5, n) for s, (lo, hi, n) in _spans(rows).items()}
    lo = choose({s: v[0] for s, v in spans.items()}, F.col("source"))
    hi = choose({s: v[1] for s, v in spans.items()}, F.col("source"))
    # A value a rounding error below an edge belongs to the bin that starts there.
    at = F.least(F.floor(F.round((F.col("value") - lo) / (hi - lo) * bins, 9)), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy("source", at.alias("bin")).agg(F.sum("w").alias("n"))
    edge = lambda a, z, b: None if a is None else a + (z - a) / bins * b
    edges = [(s, b, edge(a, z, b), edge(a, z, b + 1), n) for s, (a, z, n) in spans.items() for b in range(bins)]
    table = rows.sparkSession.createDataFrame(edges, "source string, bin int, low double, high double, total long")
    n = F.when(F.col("low").isNotNull(), F.coalesce("n", F.lit(0)).cast("double"))
    height = n / (F.col("total") * (F.col("high") - F.col("low"))) if density else n
    return table.join(counts, ["source", "bin"], "left").select("source", "bin", "low", "high", height.alias("frequency"))


def density_curve(rows: DataFrame, points: int = 200, cut: float = 3.0, clip: tuple[float, float] | None = None) -> DataFrame:
    """Gaussian kernel density of ``rows(source, value, w)`` on a grid: ``(source, point, x, density)``.

    Scott's bandwidth ``n^(-1/5)`` times the sample deviation; the grid reaches
    ``cut`` bandwidths beyond the values and stays inside ``clip``. Equal values
    are combined first and every value adds to the grid sums before the shuffle.
    """
    spark = rows.sparkSession
    distinct = rows.groupBy("source", "value").agg(F.sum("w").alias("w"))
    spans = _spans(distinct)
    mean = {
        r["source"]: r["m"] for r in distinct.groupBy("source").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("m")).collect()
    }
    centered = F.col("value") - choose(mean, F.col("source"))
    squares = {r["source"]: r["q"] for r in distinct.groupBy("source").agg(F.sum(centered * centered * F.col("w")).alias("q")).collect()}
    start, step, width = {}, {}, {}
    for s, (lo, hi, n) in spans.items():
        if n < 2 or squares[s] <= 0:
            continue
        width[s] = n ** (-1 / 5) * (squares[s] / (n - 1)) ** 0.5
        a, z = lo - cut * width[s], hi + cut * width[s]
        if clip is not None:
            a, z = max(a, clip[0]), min(z, clip[1])
        start[s], step[s] = a, (z - a) / (points - 1)
    grid = [(s, i, start[s] + i * step[s]) for s in width for i in range(points)]
    table = spark.createDataFrame(grid, "source string, point int, x double")
    key = F.col("source")
    x = choose(start, key) + F.col("point") * choose(step, key)
    z = (x - F.col("value")) / choose(width, key)
    sums = (
        distinct.filter(key.isin(*width)).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .groupBy("source", "point").agg(F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("k"))
    )
    size = choose({s: spans[s][2] * width[s] * (2 * 3.141592653589793) ** 0.5 for s in width}, key)
    return table.join(sums, ["source", "point"]).select("source", "point", "x", (F.col("k") / size).alias("density"))


def joint_distribution(rows: DataFrame, bins: int = 50) -> DataFrame:
    """Histogram per source with the least and greatest value over all sources."""
    spans = _spans(rows).values()
    lo, hi = min(v[0] for v in spans), max(v[1] for v in spans)
    return histogram(rows, bins).select("*", F.lit(lo).alias("global_min"), F.lit(hi).alias("global_max"))
