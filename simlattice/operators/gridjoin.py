"""Join of points in three dimensions through a grid.

The side of a cell is half the reach, so a point visits the cells whose nearest
corner is within it; of two cells only one visits the other. A cell with very
many points is dealt to blocks.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simlattice.runtime import cut

#: Points of one cell that meet their visitors in one task.
CELL_ROWS = 2000
AXES = "xyz"


def offsets(reach: float, side: float, p: float) -> list[tuple[int, int, int]]:
    """Steps to the cells within ``reach`` under the Minkowski distance of order ``p``, one of every two opposite ones."""
    most = math.ceil(reach / side)
    steps = itertools.product(range(-most, most + 1), repeat=3)
    gap = lambda d: sum((max(abs(k) - 1, 0) * side) ** p for k in d) ** (1 / p)
    return [d for d in steps if d >= (0, 0, 0) and gap(d) <= reach]


def meetings(points: DataFrame, reach: float, p: float, parts: int = 2) -> DataFrame:
    """Pairs of ``points(id, x, y, z)`` in cells within reach, as ``id1, x1, .. id2, x2, ..`` in no order of the ids."""
    side = reach / parts
    partitions = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = [f"c{a}" for a in AXES]
    # Every point becomes dozens of visits, which file sizes do not tell.
    placed = points.select("id", *AXES, *[F.floor(F.col(a) / side).alias(f"c{a}") for a in AXES]).repartition(partitions, "id")
    steps = F.array(*[F.struct(*[F.lit(k).alias(a) for k, a in zip(d, AXES)]) for d in offsets(reach, side, p)])
    visits = placed.withColumn("step", F.explode(steps)).withColumn("home", F.expr("step.x = 0 and step.y = 0 and step.z = 0"))
    visits = visits.select("id", *AXES, "home", *[(F.col(f"c{a}") + F.col(f"step.{a}")).alias(f"c{a}") for a in AXES])
    hot = cut(placed.groupBy(*cells).agg(F.ceil(F.count("id") / CELL_ROWS).cast("int").alias("blocks")).filter("blocks > 1"))
    stored, visits = (rows.join(hot, cells, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))) for rows in (placed, visits))
    stored = stored.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    one = visits.select(*cells, "block", "home", *[F.col(c).alias(f"{c}1") for c in ("id", *AXES)]).repartition(partitions, *cells, "block")
    two = stored.select(*cells, "block", *[F.col(c).alias(f"{c}2") for c in ("id", *AXES)]).repartition(partitions, *cells, "block")
    met = one.hint("merge").join(two, [*cells, "block"]).filter(~F.col("home") | (F.col("id1") < F.col("id2")))
    return met.drop(*cells, "block", "home")


def grid_pairs(points: DataFrame, reach: float, p: float, similarity, min_similarity: float, parts: int = 2) -> DataFrame:
    """``id1, id2, similarity`` of the pairs of ``points(id, x, y, z)`` with ``similarity(first, second)`` of at least ``min_similarity``.

    ``reach`` is the largest distance that such a pair may have; ``similarity``
    takes the three coordinates of either point.
    """
    first, second = ([F.col(f"{a}{i}") for a in AXES] for i in (1, 2))
    value: Column = similarity(first, second)
    pairs = meetings(points, reach, p, parts).select("id1", "id2", value.alias("similarity")).filter(F.col("similarity") >= min_similarity)
    return pairs.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), "similarity")
