"""Blocks of entities whose stored pairs meet the labels of all clusterings in one task.

A pair is moved from both ends with one length per combination. The labels of
an entity are moved once per block that stores a pair with it, not once per
pair, and those of many clusterings go in a few parts, which bounds a task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlattice.operators.combine import Combined
from simlattice.operators.matrix import mirrored
from simlattice.runtime import cut, running_totals

# Stored pairs of a block, counted from both ends, and the number of blocks wanted between these bounds.
LOW_ROWS, HIGH_ROWS, WANTED = 50_000, 1_000_000, 32
# Labels of an entity that are moved at once.
PART_LABELS = 100


class Blocks(NamedTuple):
    """``members(id, block)`` without the entities that are a hub in any combination; ``ends(block, id, own)``
    are the entities a block stores pairs with, and its members."""

    members: DataFrame
    ends: DataFrame
    hubs: DataFrame | None


def split_blocks(combined: Combined) -> Blocks:
    """Contiguous blocks of entities with a bounded number of stored pairs."""
    both = mirrored(combined.wide)
    stored = both.groupBy("id").agg(F.count("*").alias("n"))
    ids, hubs = combined.ids, None
    if combined.hubs is not None:
        hubs = cut(combined.hubs.select("id").distinct())
        ids = ids.join(F.broadcast(hubs), "id", "left_anti")
    weighed = cut(ids.join(stored, "id", "left").select("id", (F.coalesce("n", F.lit(0)) + 1).cast("long").alias("weight")))
    total = weighed.agg(F.sum("weight")).first()[0] or 0
    rows = min(max(total // WANTED, LOW_ROWS), HIGH_ROWS)
    members = cut(running_totals(weighed, [], ["id"], "weight").select("id", F.floor(F.col("before") / rows).cast("int").alias("block")))
    theirs = both.join(members, "id").select("block", F.col("nbr").alias("id"), F.lit(False).alias("own"))
    ends = theirs.unionByName(members.select("block", "id", F.lit(True).alias("own"))).groupBy("block", "id").agg(F.max("own").alias("own"))
    return Blocks(members, cut(ends), hubs)


def parts_of(clusterings: list[tuple]) -> tuple[list[list[tuple]], list[tuple]]:
    """Clusterings ``(combo, ...)`` in parts, and rows ``(*clustering, part, at)`` that say where they are."""
    parts: list[list[tuple]] = []
    for c in clusterings:
        if not parts or len(parts[-1]) == PART_LABELS:
            parts.append([])
        parts[-1].append(c)
    return parts, [(*c, p, k) for p, part in enumerate(parts) for k, c in enumerate(part)]


def packed_labels(clusters: DataFrame, table: DataFrame, keys: list[str], values: list[str], parts: list[list[tuple]]) -> DataFrame:
    """``(part, id, *values)``: arrays with an entry per clustering of the part, null where the entity is in none of its clusters."""
    placed = clusters.join(F.broadcast(table), keys).groupBy("part", "id").agg(F.sort_array(F.collect_list(F.struct("at", *values))).alias("held"))
    n = F.lit(0)
    for p, part in enumerate(parts):
        n = F.when(F.col("part") == p, F.lit(len(part))).otherwise(n)
    by_place = F.map_from_entries(F.transform("held", lambda h: F.struct(h["at"], h)))
    filled = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.element_at(by_place, k))
    held = F.when(F.size("held") == n, F.col("held")).otherwise(filled)
    return cut(placed.withColumn("held", held).select("part", "id", *[F.col(f"held.{v}").alias(v) for v in values]))


def over_blocks(
    combined: Combined, blocks: Blocks, labels: DataFrame, parts: list[list[tuple]], task: Callable, schema: str
) -> DataFrame:
    """Rows of ``task(part)`` over the pairs and the labels of every block and part.

    It gets tables ``(block, id, nbr, d0, ...)`` with the lengths of ``combined``
    and ``(block, id, own, ...)`` with the labels.
    """
    if not parts:
        return labels.sparkSession.createDataFrame([], schema)
    place = {c: k for k, c in enumerate(combined.combos)}
    found = []
    for p, part in enumerate(parts):
        lengths = [f"d{place[c]}" for c in dict.fromkeys(c[0] for c in part)]
        stored = reduce(lambda a, b: a | b, [F.col(d).isNotNull() for d in lengths])
        pairs = mirrored(combined.wide.filter(stored), *lengths).join(blocks.members, "id").select("block", "id", "nbr", *lengths)
        ends = blocks.ends.join(labels.filter(F.col("part") == p).drop("part"), "id")
        found.append(pairs.groupBy("block").cogroup(ends.groupBy("block")).applyInArrow(task(part), schema))
    return reduce(DataFrame.unionByName, found)


class Held(NamedTuple):
    """A block in a task: ``own`` are the places of its members among the ends, ``i`` and ``j`` those of a pair among members and ends."""

    own: np.ndarray
    i: np.ndarray
    j: np.ndarray


def held(pairs: pa.Table, ends: pa.Table) -> Held:
    ids = ends.column("id").combine_chunks()
    own = np.flatnonzero(ends.column("own").to_numpy())
    member = np.full(len(ids), -1, np.int64)
    member[own] = np.arange(len(own))
    i, j = (np.asarray(pc.index_in(pairs.column(c).combine_chunks(), value_set=ids).fill_null(-1), np.int64) for c in ("id", "nbr"))
    known = (i >= 0) & (j >= 0)
    return Held(own, np.where(known, member[i], -1), np.where(known, j, -1))


def lengths_of(pairs: pa.Table, at: Held, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Member, end and length of the pairs a combination stores, by member and length."""
    d = pairs.column(column)
    use = np.flatnonzero(d.is_valid().to_numpy() & (at.i >= 0))
    i, j, d = at.i[use], at.j[use], d.to_numpy()[use]
    order = np.lexsort((d, i))
    return i[order], j[order], d[order]


def matrix_of(ends: pa.Table, column: str, width: int) -> np.ndarray:
    """Array column with ``width`` entries a row; 0 where there is none."""
    values = ends.column(column).combine_chunks()
    return pc.fill_null(values.flatten(), 0).to_numpy(zero_copy_only=False).reshape(len(values), width)
