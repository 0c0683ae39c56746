"""Overlap of two clusterings through their medoids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlattice.operators.combine import Combined
from simlattice.operators.matrix import mirrored
from simlattice.operators.medoid import medoids
from simlattice.runtime import choose, cut, numbered


def nested_pairs(combos: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    """Ordered pairs of combinations of which one contains the other."""
    return [
        (a, b)
        for a, x in combos.items()
        for b, y in combos.items()
        if a != b and (set(x) <= set(y) or set(y) <= set(x))
    ]


def overlap_mapping(combined: Combined, labels: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Cluster of ``base`` for every cluster of ``other``: ``(base, other, leader_c, leader_a)``.

    Medoids of both clusterings are taken under the distance of ``base`` and
    every medoid of ``other`` goes to the nearest medoid of ``base``; on ties to
    the cluster with the smallest member. Medoids meet through the stored pairs;
    among the medoids no stored pair reaches, only the first one can win.
    """
    spark = labels.sparkSession
    table = F.broadcast(spark.createDataFrame(pairs, "base string, other string"))
    theirs = labels.withColumnRenamed("combo", "other").join(table, "other").select(
        F.col("base").alias("combo"), "other", "id", "leader"
    )
    bases = F.broadcast(spark.createDataFrame(sorted({(b,) for b, _ in pairs}), "combo string"))
    own = labels.join(bases, "combo").select("combo", F.lit(None).cast("string").alias("other"), "id", "leader")
    found = cut(medoids(combined, own.unionByName(theirs).withColumn("other", F.coalesce("other", F.col("combo"))), ["other"]))

    smallest = own.groupBy("combo", "leader").agg(F.min("id").alias("first_id"))
    order = cut(numbered(smallest, ["combo"], ["first_id", "leader"], "ord"))
    base_medoids = cut(
        found.filter("combo = other").join(order, ["combo", "leader"])
        .select("combo", F.col("leader").alias("leader_a"), F.col("medoid").alias("medoid_a"), "ord")
    )
    their_medoids = found.filter("combo != other").select("combo", "other", F.col("leader").alias("leader_c"), F.col("medoid").alias("medoid_c"))

    same = their_medoids.join(base_medoids, (their_medoids["combo"] == base_medoids["combo"]) & (F.col("medoid_c") == F.col("medoid_a"))).select(
        their_medoids["combo"], "other", "leader_c", F.lit(0.0).alias("d"), "ord", "leader_a"
    )
    # A pair is moved once for all combinations, with those that have a medoid at its ends.
    place = {c: k for k, c in enumerate(combined.combos)}
    k = choose(place, F.col("combo"), "int")
    ends = {
        "nbr": base_medoids.groupBy(F.col("medoid_a").alias("nbr")).agg(F.collect_set(k).alias("to")),
        "id": their_medoids.groupBy(F.col("medoid_c").alias("id")).agg(F.collect_set(k).alias("from")),
    }
    lengths = F.array(*[f"d{k}" for k in place.values()])
    between = (
        mirrored(combined.wide, *[f"d{k}" for k in place.values()]).join(ends["nbr"], "nbr").join(ends["id"], "id")
        .select("id", "nbr", lengths.alias("lengths"), F.explode(F.array_intersect("from", "to")).alias("at"))
        .select("id", "nbr", F.get("lengths", F.col("at")).alias("d"), F.get(F.array(*[F.lit(c) for c in place]), F.col("at")).alias("combo"))
        .filter(F.col("d").isNotNull())
    )
    near = (
        between.join(base_medoids.withColumnRenamed("medoid_a", "nbr"), ["combo", "nbr"])
        .join(their_medoids.withColumnRenamed("medoid_c", "id"), ["combo", "id"])
        .select("combo", "other", "leader_c", "d", "ord", "leader_a")
    )
    reached = cut(same.unionByName(near))
    key = ["combo", "other", "leader_c"]
    # Positions 0, 1, ... are all reached up to the first gap: the gap is the first unreached cluster.
    gap = numbered(reached, key, ["ord"], "rank").groupBy(*key).agg(F.count(F.when(F.col("ord") == F.col("rank"), 1)).alias("gap"))
    unreached = (
        their_medoids.select(*key).join(gap, key, "left")
        .select(*key, F.coalesce("gap", F.lit(0).cast("long")).alias("ord"))
        .join(base_medoids.select("combo", "ord", "leader_a"), ["combo", "ord"])
        .select(*key, choose(combined.background, F.col("combo")).alias("d"), "ord", "leader_a")
    )
    nearest = reached.select(*key, "d", "ord", "leader_a").unionByName(unreached).groupBy(*key).agg(
        F.min_by("leader_a", F.struct("d", "ord")).alias("leader_a")
    )
    return nearest.withColumnRenamed("combo", "base")


def overlap_detail(combined: Combined, labels: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Score of every cluster of ``other`` against its cluster of ``base``.

    Columns ``base, other, leader_a, leader_c, shared, size_a, size_c, score``
    with ``score = shared / size_c``.
    """
    spark = labels.sparkSession
    mapping = cut(overlap_mapping(combined, labels, pairs))
    table = F.broadcast(spark.createDataFrame(pairs, "base string, other string"))
    a = labels.select(F.col("combo").alias("base"), "id", F.col("leader").alias("leader_a"))
    c = labels.select(F.col("combo").alias("other"), "id", F.col("leader").alias("leader_c"))
    shared = (
        a.join(table, "base").join(c, ["other", "id"])
        .groupBy("base", "other", "leader_a", "leader_c").agg(F.count("*").alias("shared"))
    )
    size_a = a.groupBy("base", "leader_a").agg(F.count("*").alias("size_a"))
    size_c = c.groupBy("other", "leader_c").agg(F.count("*").alias("size_c"))
    return (
        mapping.join(shared, ["base", "other", "leader_a", "leader_c"], "left")
        .join(size_a, ["base", "leader_a"])
        .join(size_c, ["other", "leader_c"])
        .select(
            "base", "other", "leader_a", "leader_c", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"), "size_a", "size_c",
            (F.coalesce("shared", F.lit(0)) / F.col("size_c")).alias("score"),
        )
    )


def overlap_scores(detail: DataFrame) -> DataFrame:
    """Overall and filtered overlap per ``(base, other)``.

    Overall: mean over the clusters of ``base`` of the mean score of the clusters
    mapped to them. Filtered: flat mean without hits of two single members; 0 if
    nothing is left. Both are snapped to 12 digits, which the order of addition does not reach.
    """
    lone = (F.col("shared") == 1) & (F.col("size_a") == 1) & (F.col("size_c") == 1)
    kept = F.when(~lone, F.col("score"))
    per_cluster = detail.groupBy("base", "other", "leader_a").agg(
        F.avg("score").alias("score"), F.sum(kept).alias("kept_sum"), F.count(kept).alias("kept_n")
    )
    return per_cluster.groupBy("base", "other").agg(
        F.round(F.avg("score"), 12).alias("overlap"),
        F.when(F.sum("kept_n") > 0, F.round(F.sum("kept_sum") / F.sum("kept_n"), 12)).otherwise(0.0).alias("filtered_overlap"),
    )


def overlap_rows(scores: DataFrame, best: DataFrame) -> DataFrame:
    """Result rows: silhouettes and cluster numbers of both sides next to the overlap."""
    b = best.select("combo", "silhouette", "n_clusters")
    base = b.select(F.col("combo").alias("base"), F.col("silhouette").alias("base_silhouette"), F.col("n_clusters").alias("base_cluster_size"))
    other = b.select(
        F.col("combo").alias("other"), F.col("silhouette").alias("compared_with_silhouette"), F.col("n_clusters").alias("compared_cluster_size")
    )
    return scores.join(F.broadcast(base), "base").join(F.broadcast(other), "other").select(
        "base", "base_silhouette", "base_cluster_size", F.col("other").alias("compared_with"),
        "compared_with_silhouette", "compared_cluster_size",
        F.col("overlap").alias("overlap_ratio"), F.col("filtered_overlap").alias("filtered_overlap_ratio"),
    )
