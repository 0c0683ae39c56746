"""Common entities of several sources and the pairs among them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlattice.operators.matrix import Matrices
from simlattice.runtime import cut, numbered

# Sample size up to which one task may sort the sample.
SMALL_SAMPLE = 10_000


class Aligned(NamedTuple):
    """Sources over the same entities.

    ``background`` is the similarity of the pairs a source does not store and
    ``stored`` the number of those it does.
    """

    pairs: DataFrame
    ids: DataFrame
    n: int
    sources: list[str]
    background: dict[str, float]
    stored: dict[str, int]

    @property
    def cells(self) -> int:
        return self.n * (self.n - 1) // 2

    def absent(self, source: str) -> int:
        return self.cells - self.stored[source]


def common_ids(ids: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Entities that occur in all sources."""
    kept = ids.filter(F.col("source").isin(*sources))
    return kept.groupBy("id").agg(F.count_distinct("source").alias("n")).filter(F.col("n") == len(set(sources))).select("id")


def sample_ids(ids: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """``size`` entities in an order fixed by the seed: the smallest MD5 of id and seed."""
    key = F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}")).cast("binary"))
    keyed = ids.withColumn("_key", key)
    if size <= SMALL_SAMPLE:
        return keyed.orderBy("_key", "id").limit(size).select("id")
    return numbered(keyed, [], ["_key", "id"]).filter(F.col("pos") < size).select("id")


def restrict(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs with both ends among ``ids``."""
    one = ids.select(F.col("id").alias("id1"))
    two = ids.select(F.col("id").alias("id2"))
    return pairs.join(one, "id1", "left_semi").join(two, "id2", "left_semi")


def _aligned(pairs: DataFrame, ids: DataFrame, sources: Sequence[str]) -> Aligned:
    ids = cut(ids)
    upper = pairs.filter(F.col("source").isin(*sources) & (F.col("id1") < F.col("id2")))
    kept = cut(restrict(upper, ids).select("source", "id1", "id2", "similarity"))
    stored = dict.fromkeys(sources, 0)
    stored.update({r["source"]: r["count"] for r in kept.groupBy("source").count().collect()})
    return Aligned(kept, ids, ids.count(), list(sources), dict.fromkeys(sources, 0.0), stored)


def align(data: Matrices, sources: Sequence[str], size: int | None = None, seed: int = 42) -> Aligned:
    """All sources over their common entities, or over ``size`` of them."""
    ids = common_ids(data.ids, sources)
    if size is not None:
        ids = sample_ids(ids, size, seed)
    return _aligned(data.pairs, ids, sources)


def align_to_anchor(
    data: Matrices, sources: Sequence[str], anchor: str, size: int | None = None, seed: int = 42
) -> Aligned:
    """Entities common to all other sources, and all entities of the anchor.

    Pairs a source lacks stay absent, which means 0.
    """
    others = [s for s in sources if s != anchor]
    ids = data.ids.filter(F.col("source") == anchor).select("id")
    if others:
        ids = ids.union(common_ids(data.ids, others))
    ids = ids.distinct()
    if size is not None:
        ids = sample_ids(ids, size, seed)
    return _aligned(data.pairs, ids, sources)


def align_report(data: Matrices, aligned: Aligned) -> DataFrame:
    """Entities of every source, and aligned entities it does not have."""
    found = data.ids.filter(F.col("source").isin(*aligned.sources)).distinct()
    inside = aligned.ids.withColumn("inside", F.lit(1))
    return (
        found.join(inside, "id", "left")
        .groupBy("source")
        .agg(F.count("*").alias("total"), (F.lit(aligned.n) - F.count("inside")).alias("missing"))
    )


def shared_entities(first: DataFrame, *more: DataFrame, labels: DataFrame | None = None, exclude: str | None = None) -> DataFrame:
    """Entities in all tables ``(id)``, optionally without those of one label ``(id, label)``."""
    ids = first.select("id")
    for other in more:
        ids = ids.intersect(other.select("id"))
    if labels is not None and exclude is not None:
        ids = ids.join(labels.filter(F.col("label") == exclude), "id", "left_anti")
    return ids
