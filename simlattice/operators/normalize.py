"""Clip, z-score and min-max per source; distances and value statistics."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simlattice.functions.numeric import log_shifted
from simlattice.functions.quantiles import exact_percentiles
from simlattice.operators.align import Aligned
from simlattice.operators.distribution import histogram
from simlattice.operators.moments import Moments
from simlattice.runtime import choose

EDGE = 1e-6


def _absent(aligned: Aligned) -> dict[str, tuple[float, int]]:
    return {s: (aligned.background[s], aligned.absent(s)) for s in aligned.sources if aligned.absent(s) > 0}


def normalize(
    aligned: Aligned,
    use_log: bool = False,
    iqr_multiplier: float = 1.5,
    mapping: Callable[[Column], Column] | None = None,
) -> tuple[Aligned, DataFrame]:
    """Similarities of every source in [0, 1], and the statistics used.

    Values are clipped to the 10th and 90th percentile widened by
    ``iqr_multiplier`` spreads, optionally taken to the logarithm and through
    ``mapping`` (a column function), z-scored with the population deviation
    and stretched from minimum to maximum. Absent pairs count with their value.
    """
    spark = aligned.pairs.sparkSession
    limits = exact_percentiles(aligned.pairs, "source", "similarity", [0.1, 0.9], _absent(aligned))
    low, high = {}, {}
    for s, (q1, q3) in limits.items():
        spread = q3 - q1
        low[s], high[s] = q1 - iqr_multiplier * spread, q3 + iqr_multiplier * spread

    source, value = F.col("source"), F.col("similarity")
    lo, hi = choose(low, source), choose(high, source)

    def shaped(raw: Column) -> Column:
        x = F.least(F.greatest(raw, lo), hi)
        x = log_shifted(x) if use_log else x
        return mapping(x) if mapping is not None else x

    # The background value goes through the same expression as one weighted row per source.
    single = [(s, v, n, True) for s, (v, n) in _absent(aligned).items()]
    explicit = aligned.pairs.select("source", "similarity", F.lit(1).cast("long").alias("w"), F.lit(False).alias("one"))
    rows = explicit
    if single:
        rows = rows.unionByName(spark.createDataFrame(single, "source string, similarity double, w long, one boolean"))
    shapes = rows.select("source", "w", "one", shaped(value).alias("x"), ((value < lo) | (value > hi)).alias("out"))
    stats, background = [], dict(aligned.background)
    mean, std, zmin, zmax = {}, {}, {}, {}
    summary = shapes.groupBy("source", "one").agg(
        F.sum("w").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"),
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum(F.when(F.col("out"), F.col("w")).otherwise(0)).alias("out"),
    )
    found: dict[str, list] = {}
    for r in summary.collect():
        found.setdefault(r["source"], []).append(r)
    for s, parts in found.items():
        m = Moments.merge([Moments(r["n"], r["mean"], r["var"], r["lo"], r["hi"]) for r in parts])
        mean[s], std[s] = m.mean, math.sqrt(m.var)
        zmin[s], zmax[s] = (m.low - m.mean) / (std[s] + EDGE), (m.high - m.mean) / (std[s] + EDGE)
        crop = sum(r["out"] for r in parts) / m.n
        for r in parts:
            if r["one"]:
                background[s] = ((r["mean"] - m.mean) / (std[s] + EDGE) - zmin[s]) / (zmax[s] - zmin[s] + EDGE)
        stats.append((s, m.n, low[s], high[s], mean[s], std[s], zmin[s], zmax[s], crop))
    z = (shaped(value) - choose(mean, source)) / (choose(std, source) + EDGE)
    stretched = (z - choose(zmin, source)) / (choose(zmax, source) - choose(zmin, source) + EDGE)
    pairs = aligned.pairs.select("source", "id1", "id2", stretched.alias("similarity"))
    table = spark.createDataFrame(
        stats,
        "source string, n long, lower double, upper double, mean double, std double, zmin double, zmax double, crop_ratio double",
    )
    return aligned._replace(pairs=pairs, background=background), table


def to_distance(aligned: Aligned) -> Aligned:
    """``1 - similarity``; the diagonal is 0 and not stored. Column ``distance``."""
    pairs = aligned.pairs.select("source", "id1", "id2", (1 - F.col("similarity")).alias("distance"))
    return aligned._replace(pairs=pairs, background={s: 1 - v for s, v in aligned.background.items()})


def with_background(aligned: Aligned, value: str) -> DataFrame:
    """Stored values ``(source, value, w)`` and one weighted row for the absent pairs."""
    rows = aligned.pairs.select("source", F.col(value).alias("value"), F.lit(1).cast("long").alias("w"))
    single = [(s, v, n) for s, (v, n) in _absent(aligned).items()]
    if single:
        table = rows.sparkSession.createDataFrame(single, "source string, value double, w long")
        rows = rows.unionByName(table)
    return rows


def positive_range(aligned: Aligned, value: str = "distance") -> DataFrame:
    """Minimum, maximum and mean of the positive values; null if there are none.

    Both halves of the symmetric matrix hold the same values, so one is read.
    """
    rows = with_background(aligned, value)
    up = F.when(F.col("value") > 0, F.col("value"))
    weight = F.when(F.col("value") > 0, F.col("w"))
    return rows.groupBy("source").agg(
        F.min(up).alias("min_value"), F.max(up).alias("max_value"), (F.sum(up * F.col("w")) / F.sum(weight)).alias("mean_value")
    )


def value_stats(aligned: Aligned, value: str = "similarity") -> DataFrame:
    """Minimum, maximum, mean, population deviation and median of every source."""
    spark = aligned.pairs.sparkSession
    medians = exact_percentiles(aligned.pairs, "source", value, [0.5], _absent(aligned))
    parts: dict[str, list[Moments]] = {}
    for r in aligned.pairs.groupBy("source").agg(*Moments.columns(F.col(value))).collect():
        parts.setdefault(r["source"], []).append(Moments.of(r))
    for s, (v, n) in _absent(aligned).items():
        parts.setdefault(s, []).append(Moments(n, v, 0.0, v, v))
    rows = []
    for s, found in parts.items():
        m = Moments.merge(found)
        rows.append((s, m.low, m.high, m.mean, math.sqrt(m.var), medians[s][0]))
    return spark.createDataFrame(
        rows, "source string, min_value double, max_value double, mean_value double, std_value double, median_value double"
    )


def stage_stats(
    aligned: Aligned,
    use_log: bool = False,
    iqr_multiplier: float = 1.5,
    mapping: Callable[[Column], Column] | None = None,
    bins: int = 10,
) -> DataFrame:
    """``value_stats``, crop ratio and histogram of every source before and after each stage of ``normalize``.

    Stages are ``before``, ``clip``, ``log`` (with ``use_log``), ``zscore`` and
    ``minmax``; the crop ratio belongs to ``clip`` and is null elsewhere.
    ``histogram`` is an array of ``(low, high, frequency)`` in order of bins.
    """
    spark = aligned.pairs.sparkSession
    done, table = normalize(aligned, use_log, iqr_multiplier, mapping)
    used = {r["source"]: r for r in table.collect()}
    source, value = F.col("source"), F.col("similarity")
    lo, hi, mean, std = (choose({s: r[c] for s, r in used.items()}, source) for c in ("lower", "upper", "mean", "std"))
    clipped = F.least(F.greatest(value, lo), hi)
    logged = log_shifted(clipped) if use_log else clipped
    shaped = mapping(logged) if mapping is not None else logged
    columns = {"before": value, "clip": clipped} | ({"log": logged} if use_log else {}) | {"zscore": (shaped - mean) / (std + EDGE)}
    absent = spark.createDataFrame(list(aligned.background.items()), "source string, similarity double")
    moved = {r["source"]: r for r in absent.select("source", *(x.alias(stage) for stage, x in columns.items())).collect()}
    stages = {
        stage: aligned._replace(pairs=aligned.pairs.select("source", "id1", "id2", x.alias("similarity")), background={s: r[stage] for s, r in moved.items()})
        for stage, x in columns.items()
    } | {"minmax": done}
    crop = choose({s: r["crop_ratio"] for s, r in used.items()}, source)
    found = None
    for stage, at in stages.items():
        bars = histogram(with_background(at, "similarity"), bins).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("bin", "low", "high", "frequency"))).alias("bars"))
        bars = bars.select("source", F.transform("bars", lambda b: F.struct(b["low"].alias("low"), b["high"].alias("high"), b["frequency"].alias("frequency"))).alias("histogram"))
        ratio = crop if stage == "clip" else F.lit(None).cast("double")
        rows = value_stats(at).withColumn("stage", F.lit(stage)).withColumn("crop_ratio", ratio).join(bars, "source")
        found = rows if found is None else found.unionByName(rows)
    return found.select("source", "stage", "min_value", "max_value", "mean_value", "std_value", "median_value", "crop_ratio", "histogram")
