"""Vector distances of all source combinations and their threshold ranges."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlattice.functions.numeric import rounded_distance, vector_distance
from simlattice.operators.align import Aligned
from simlattice.operators.matrix import mirrored
from simlattice.operators.moments import Moments
from simlattice.runtime import cut, hot_or_none

DIGITS = 8
# Stored pairs of one entity above which it is a hub.
HUB_ROWS = 200_000


class Combined(NamedTuple):
    """``vectors(combo, id1, id2, dists, d)`` of the pairs stored in a source of the combo.

    ``wide(id1, id2, d0, d1, ...)`` has one row per pair and the lengths in the
    order of ``combos``, null where the combo stores nothing.
    ``alone`` gives the rows of one combination without the others.
    All other pairs lie at ``background[combo]``; ``stats`` covers every pair.
    ``hubs(combo, id)`` are the entities with very many stored pairs, if any.
    """

    vectors: DataFrame
    wide: DataFrame
    ids: DataFrame
    n: int
    combos: dict[str, tuple[str, ...]]
    background: dict[str, float]
    stored: dict[str, int]
    stats: dict[str, Moments]
    hubs: DataFrame | None = None
    alone: dict[str, DataFrame] | None = None

    def vectors_of(self, combo: str) -> DataFrame:
        """``(id1, id2, dists, d)`` of one combination."""
        if self.alone is not None:
            return self.alone[combo]
        return self.vectors.filter(F.col("combo") == combo).drop("combo")

    @property
    def cells(self) -> int:
        return self.n * (self.n - 1) // 2

    def absent(self, combo: str) -> int:
        return self.cells - self.stored[combo]


def source_combinations(sources: Sequence[str], low: int = 1, high: int = 3) -> dict[str, tuple[str, ...]]:
    """All combinations of ``low`` to ``high`` sources by name ``a_b_c``."""
    return {"_".join(c): c for k in range(low, high + 1) for c in combinations(sources, k)}


def combine_distances(
    distances: Aligned,
    combos: dict[str, tuple[str, ...]],
    weights: dict[str, float] | None = None,
    digits: int | None = DIGITS,
    hub_rows: int = HUB_ROWS,
) -> Combined:
    """Vector distance per combination and pair.

    The pairs are brought together once and written with one column per source
    and one per combination; the rows of the combinations are read from there,
    so no table holds a pair once for every combination.
    ``digits`` rounds the length so that threshold comparisons are stable.
    """
    unknown = {s for c in combos.values() for s in c} - set(distances.sources)
    if unknown:
        raise ValueError(f"sources without distances: {sorted(unknown)}")
    used = [s for s in distances.sources if any(s in c for c in combos.values())]
    wide = distances.pairs.filter(F.col("source").isin(used)).groupBy("id1", "id2").agg(
        *[F.max(F.when(F.col("source") == s, F.col("distance"))).alias(f"_{i}") for i, s in enumerate(used)]
    )
    column = {s: F.coalesce(F.col(f"_{i}"), F.lit(distances.background[s])) for i, s in enumerate(used)}
    stored = {s: F.col(f"_{i}").isNotNull() for i, s in enumerate(used)}

    def length(values: list, c: tuple[str, ...]):
        d = vector_distance(values, [weights.get(s, 1.0) for s in c] if weights else None)
        return d if digits is None else rounded_distance(d, digits)

    lengths = []
    for k, c in enumerate(combos.values()):
        any_stored = stored[c[0]]
        for s in c[1:]:
            any_stored = any_stored | stored[s]
        lengths.append(F.when(any_stored, length([column[s] for s in c], c)).alias(f"d{k}"))
    # In the order of their ids the pairs take less disk, here and where they are written again.
    wide = cut(wide.select("id1", "id2", *[f"_{i}" for i in range(len(used))], *lengths).sortWithinPartitions("id1", "id2"))
    dists = F.lit(None).cast("array<double>")
    for name, c in combos.items():
        dists = F.when(F.col("combo") == name, F.array(*[column[s] for s in c])).otherwise(dists)
    vectors = (
        wide.unpivot(["id1", "id2", *[f"_{i}" for i in range(len(used))]], [F.col(f"d{k}").alias(name) for k, name in enumerate(combos)], "combo", "d")
        .filter(F.col("d").isNotNull())
        .select("combo", "id1", "id2", dists.alias("dists"), "d")
    )

    alone = {
        name: wide.filter(F.col(f"d{k}").isNotNull()).select("id1", "id2", F.array(*[column[s] for s in c]).alias("dists"), F.col(f"d{k}").alias("d"))
        for k, (name, c) in enumerate(combos.items())
    }

    background = {}
    for name, c in combos.items():
        values = [distances.background[s] for s in c]
        if len(c) == 1 and not weights:
            d = values[0]
        else:
            d = math.sqrt(sum((weights or {}).get(s, 1.0) * v * v for s, v in zip(c, values)))
        background[name] = d if digits is None else round(d, digits)

    moments, counts = {}, dict.fromkeys(combos, 0)
    cells = distances.cells
    for r in vectors.groupBy("combo").agg(*Moments.columns(F.col("d"))).collect():
        moments[r["combo"]] = [Moments.of(r)]
        counts[r["combo"]] = r["n"]
    stats = {}
    for name in combos:
        b = background[name]
        parts = [*moments.get(name, []), Moments(cells - counts[name], b, 0.0, b, b)]
        if cells:
            stats[name] = Moments.merge(parts)
    hubs = None
    if distances.n > hub_rows:
        degrees = mirrored(vectors, "combo").groupBy("combo", "id").agg(F.count("*").alias("stored"))
        hubs = hot_or_none(degrees, "stored", hub_rows)
    return Combined(vectors, wide.select("id1", "id2", *[f"d{k}" for k in range(len(combos))]), distances.ids, distances.n, dict(combos), background, counts, stats, hubs, alone)


def combo_stats(combined: Combined) -> DataFrame:
    """Minimum, mean and maximum vector length per combination."""
    rows = [(c, m.low, m.mean, m.high) for c, m in combined.stats.items()]
    return combined.vectors.sparkSession.createDataFrame(
        rows, "combo string, min_distance double, mean_distance double, max_distance double"
    )


def threshold_range(combined: Combined, steps: int = 20, digits: int | None = DIGITS) -> dict[str, list[float]]:
    """Evenly spaced thresholds per combination: mean +- 3 deviations inside [min, max]."""
    if steps < 1:
        raise ValueError("steps must be 1 at least")
    ranges = {}
    for c, m in combined.stats.items():
        std = math.sqrt(m.var)
        low, high = max(m.mean - 3 * std, m.low), min(m.mean + 3 * std, m.high)
        values = [low + i * ((high - low) / (steps - 1)) for i in range(steps - 1)] if steps > 1 else []
        values.append(high if steps > 1 else low)
        ranges[c] = values if digits is None else [round(v, digits) for v in values]
    return ranges


def threshold_table(combined: Combined, ranges: dict[str, list[float]]) -> DataFrame:
    """Thresholds as rows, with the skewness of one-source combinations."""
    rows = [
        (c, i, t, combined.stats[c].skew if len(combined.combos[c]) == 1 else None)
        for c, ts in ranges.items()
        for i, t in enumerate(ts)
    ]
    return combined.vectors.sparkSession.createDataFrame(rows, "combo string, step int, t1 double, skewness double")
