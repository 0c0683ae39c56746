"""Similarity matrices as one long table of the pairs that are stored.

``pairs(source, id1, id2, similarity)`` holds the upper triangle, ``id1 < id2``;
a diagonal row appears only where the input gives one. ``ids(source, id)`` is
the universe of every source. A pair without a row has similarity 0.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlattice.functions.numeric import finite


class Matrices(NamedTuple):
    pairs: DataFrame
    ids: DataFrame


def entities_of(pairs: DataFrame) -> DataFrame:
    """Ids of both key columns, once per source."""
    ids = pairs.select("source", F.explode(F.array("id1", "id2")).alias("id"))
    return ids.distinct()


def build_matrices(rows: DataFrame) -> Matrices:
    """Matrices of raw pair rows ``(source, id1, id2, similarity, seq)``.

    Both orders of a pair are one cell and the row with the largest ``seq``
    wins. Rows without a number count for the universe only. Infinite values
    become 0, as missing pairs are.
    """
    number = F.col("similarity").cast("double")
    cells = (
        rows.filter(number.isNotNull() & ~F.isnan(number))
        .groupBy("source", F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"))
        .agg(F.max_by(number, F.col("seq")).alias("similarity"))
        .withColumn("similarity", finite(F.col("similarity")))
    )
    return Matrices(cells, entities_of(rows))


def symmetrize(rows: DataFrame) -> DataFrame:
    """``(M + M^T) / 2`` of cells ``(source, id1, id2, similarity)``; an absent cell is 0."""
    upper = F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")
    half = F.when(F.col("id1") == F.col("id2"), F.col("similarity")).otherwise(F.col("similarity") / 2)
    return rows.groupBy("source", *upper).agg(F.sum(half).alias("similarity"))


def mirrored(pairs: DataFrame, *columns: str) -> DataFrame:
    """Every pair from both ends: ``(*columns, id, nbr)``."""
    ends = F.array(
        F.struct(F.col("id1").alias("id"), F.col("id2").alias("nbr")),
        F.struct(F.col("id2").alias("id"), F.col("id1").alias("nbr")),
    )
    return pairs.select(*columns, F.inline(ends))


def upper_aligned(pairs: DataFrame, a: str, b: str, filter_zeros: bool = False) -> DataFrame:
    """Values of two sources side by side, one row per pair stored in either.

    A pair stored in neither is 0 in both; ``filter_zeros`` keeps the pairs
    that are nonzero in both.
    """
    kept = pairs.filter(F.col("source").isin(a, b) & (F.col("id1") < F.col("id2")))
    wide = kept.groupBy("id1", "id2").agg(
        *[F.coalesce(F.max(F.when(F.col("source") == s, F.col("similarity"))), F.lit(0.0)).alias(n) for s, n in ((a, "a"), (b, "b"))]
    )
    return wide.filter("a != 0 AND b != 0") if filter_zeros else wide
