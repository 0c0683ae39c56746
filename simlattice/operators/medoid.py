"""Medoids of clusters: the member with the least mean distance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlattice.operators.blocks import held, lengths_of, over_blocks, packed_labels, parts_of, split_blocks
from simlattice.operators.combine import Combined
from simlattice.operators.leader import HOT_ROWS
from simlattice.operators.matrix import mirrored
from simlattice.runtime import choose, cut, hot_or_none, lookup

# Tolerances within which two mean distances count as equal (fixed values).
RELATIVE = 1e-5
ABSOLUTE = 1e-8


def medoids(
    combined: Combined, clusters: DataFrame, keys: Sequence[str] = (), relative: float = RELATIVE, absolute: float = ABSOLUTE,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Medoid and size of every cluster: ``(combo, *keys, leader, medoid, size)``.

    ``clusters(combo, *keys, id, leader)`` may hold several clusterings of the
    same entities per combination, told apart by ``keys``; all are measured
    under the distance of ``combo``, block by block. The mean
    includes the distance 0 to itself. Means within the tolerance of the least
    one are equal and the smallest id wins; with tolerances 0 the first minimum.
    """
    keys = list(keys)
    together = _sums(combined, clusters, keys)
    group = ["combo", *keys, "leader"]
    sizes = cut(clusters.groupBy(*group).agg(F.count("*").alias("size")))
    large = hot_or_none(sizes, "size", hot_rows)
    far = choose(combined.background, F.col("combo"))
    absent = F.col("size") - 1 - F.coalesce("stored", F.lit(0))
    members = cut(
        lookup(clusters.join(together, ["combo", *keys, "id"], "left"), sizes, group, large)
        .select(*group, "id", "size", ((F.coalesce("total", F.lit(0.0)) + absent * far) / F.col("size")).alias("mean"))
    )
    least = members.groupBy(*group).agg(F.min("mean").alias("least"))
    return (
        lookup(members, least, group, large)
        .filter(F.col("mean") - F.col("least") <= absolute + relative * F.abs("least"))
        .groupBy(*group)
        .agg(F.min("id").alias("medoid"), F.first("size").alias("size"))
    )


def _sums(combined: Combined, clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Sum and number of the stored lengths from an entity to the other members of its cluster, where there are any:
    ``(combo, *keys, id, total, stored)``."""
    spark = combined.vectors.sparkSession
    found = clusters.select("combo", *keys).distinct().collect()
    parts, places = parts_of(sorted((tuple(r) for r in found), key=lambda c: c[0]))
    kinds = {f.name: f.dataType.simpleString() for f in clusters.schema}
    places = spark.createDataFrame(places, ", ".join(f"`{c}` {kinds[c]}" for c in ("combo", *keys)) + ", part int, at int")
    blocks = split_blocks(combined)
    packed = packed_labels(clusters, places, ["combo", *keys], ["leader"], parts)
    task = _summer({c: f"d{k}" for k, c in enumerate(combined.combos)}, {tuple(part): p for p, part in enumerate(parts)})
    sums = over_blocks(combined, blocks, packed, parts, task, f"part int, at int, id {kinds['id']}, total double, stored long")
    sums = sums.join(F.broadcast(places), ["part", "at"]).select("combo", *keys, "id", "total", "stored")
    return sums if blocks.hubs is None else sums.unionByName(_hub_sums(combined, clusters, keys, blocks.hubs))


def _summer(column: dict[str, str], number: dict[tuple, int]):
    """Tasks that add up the lengths within clusters for the members of a block, for every clustering of a part."""

    def task(part: list[tuple]):
        def add(pairs: pa.Table, ends: pa.Table) -> pa.Table:
            at = held(pairs, ends)
            names = ends.column("id").combine_chunks()
            leaders = ends.column("leader").combine_chunks()
            codes = pc.dictionary_encode(leaders.flatten()).indices
            label = pc.fill_null(codes, -1).to_numpy(zero_copy_only=False).reshape(len(leaders), len(part))
            out = []
            for combo in dict.fromkeys(c[0] for c in part):
                i, j, d = lengths_of(pairs, at, column[combo])
                for k, c in enumerate(part):
                    if c[0] != combo:
                        continue
                    there = label[j, k]
                    same = (there == label[at.own, k][i]) & (there >= 0)
                    stored = np.bincount(i[same], minlength=len(at.own))
                    some = np.flatnonzero(stored)
                    out.append((np.full(len(some), k, np.int32), at.own[some], np.bincount(i[same], d[same], len(at.own))[some], stored[some]))
            place, who, total, stored = (np.concatenate(x) for x in zip(*out))
            return pa.table(
                {
                    "part": pa.array(np.full(len(who), number[tuple(part)], np.int32)), "at": pa.array(place),
                    "id": names.take(pa.array(who)), "total": pa.array(total, pa.float64()), "stored": pa.array(stored, pa.int64()),
                }
            )

        return add

    return task


def _hub_sums(combined: Combined, clusters: DataFrame, keys: list[str], ids: DataFrame) -> DataFrame:
    """The same for the hubs ``ids``, whose pairs stay spread over many tasks."""
    few = F.broadcast(ids)
    combos = F.explode(F.array(*[F.lit(c) for c in combined.combos])).alias("combo")
    packed = clusters.groupBy("combo", "id").agg(F.collect_list(F.struct(*keys, F.col("leader"))).alias("at"))
    own = F.broadcast(packed.join(few, "id", "left_semi").select("combo", "id", F.col("at").alias("own")))
    rows = mirrored(combined.vectors, "combo", "d").join(few, "id", "left_semi").join(own, ["combo", "id"])
    theirs = ids.select(F.col("id").alias("nbr"), combos)
    return (
        lookup(rows, packed.select("combo", F.col("id").alias("nbr"), F.col("at").alias("other")), ["combo", "nbr"], theirs)
        .select("combo", "id", "d", F.explode(F.array_intersect("own", "other")).alias("c"))
        .groupBy("combo", "c", "id")
        .agg(F.sum("d").alias("total"), F.count("d").alias("stored"))
        .select("combo", *[F.col(f"c.{k}").alias(k) for k in keys], "id", "total", "stored")
    )
