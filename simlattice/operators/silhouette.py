"""Silhouette of clusterings, the best threshold and cluster summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simlattice.operators.blocks import held, lengths_of, matrix_of, over_blocks, packed_labels, parts_of, split_blocks
from simlattice.operators.combine import Combined
from simlattice.operators.leader import cluster_sizes, number_clusters
from simlattice.operators.matrix import mirrored
from simlattice.runtime import choose, cut, lookup, numbered


def cluster_counts(clusters: DataFrame, label: str = "leader") -> DataFrame:
    """Number of clusters and share of clusters with a single member."""
    return cluster_sizes(clusters, label).groupBy("combo", "step").agg(
        F.count("*").alias("n_clusters"), F.avg((F.col("size") == 1).cast("double")).alias("single_point_ratio")
    )


def silhouette(combined: Combined, clusters: DataFrame, singleton: str = "one") -> DataFrame:
    """Average silhouette ``(combo, step, silhouette, n_clusters)`` of at least two clusters.

    Per entity: ``a`` is the mean distance to its own cluster (0 if alone), ``b``
    the least median distance to another cluster, the score ``(b - a) / max``.
    ``singleton="zero"`` scores entities alone in their cluster with 0.

    Only stored pairs are read. The absent ones of a cluster are copies of the
    background distance and enter means and medians as counts. The pairs of a
    block of entities meet the labels of all combinations and thresholds in a few
    tasks; those of a hub are ranked over many tasks instead.
    """
    if singleton not in ("one", "zero"):
        raise ValueError("singleton is 'one' or 'zero'")
    labeled = cut(number_clusters(clusters))
    counts = {(r["combo"], r["step"]): r["n"] for r in labeled.groupBy("combo", "step").agg(F.max("label").alias("n")).collect()}
    scored = {at: n for at, n in counts.items() if n >= 2}
    spark = combined.vectors.sparkSession
    if not scored:
        return spark.createDataFrame([], "combo string, step int, silhouette double, n_clusters long")
    blocks = split_blocks(combined)
    parts, places = parts_of(sorted(scored))
    places = spark.createDataFrame(places, "combo string, step int, part int, at int")
    values = labeled.select("combo", "step", "id", "label", F.col("size").cast("int").alias("size"))
    packed = packed_labels(values, places, ["combo", "step"], ["label", "size"], parts)
    task = _scorer(scored, combined.background, {c: f"d{k}" for k, c in enumerate(combined.combos)}, singleton)
    sums = over_blocks(combined, blocks, packed, parts, task, "combo string, step int, total double, n long")
    if blocks.hubs is not None:
        points = _hub_points(combined, labeled, blocks.hubs, scored)
        top = F.greatest("a", "b")
        s = F.when(top > 0, (F.col("b") - F.col("a")) / top).otherwise(0.0)
        if singleton == "zero":
            s = F.when(F.col("size") == 1, 0.0).otherwise(s)
        sums = sums.unionByName(points.groupBy("combo", "step").agg(F.sum(s).alias("total"), F.count("*").alias("n")))
    table = spark.createDataFrame([(c, t, n) for (c, t), n in scored.items()], "combo string, step int, n_clusters long")
    means = sums.groupBy("combo", "step").agg((F.sum("total") / F.sum("n")).alias("silhouette"))
    return means.join(F.broadcast(table), ["combo", "step"])


def _scorer(scored: dict[tuple[str, int], int], background: dict[str, float], column: dict[str, str], singleton: str):
    """Tasks that sum the scores of the members of a block, for every clustering of a part."""

    def task(part: list[tuple]):
        def score(pairs: pa.Table, ends: pa.Table) -> pa.Table:
            at = held(pairs, ends)
            labels, sizes = (matrix_of(ends, c, len(part)) for c in ("label", "size"))
            out = {"combo": [], "step": [], "total": [], "n": []}
            for combo in dict.fromkeys(c for c, _ in part):
                i, j, d = lengths_of(pairs, at, column[combo])
                for k, (c, step) in enumerate(part):
                    if c != combo:
                        continue
                    mine, size = labels[at.own, k], sizes[at.own, k].astype(np.int64)
                    a, b = _means_and_medians(i, d, labels[j, k], sizes[j, k], mine, size, scored[c, step], background[combo])
                    top = np.maximum(a, b)
                    s = np.divide(b - a, top, out=np.zeros(len(top)), where=top > 0)
                    if singleton == "zero":
                        s[size == 1] = 0.0
                    for name, value in zip(out, (combo, step, float(s.sum()), int((size > 0).sum()))):
                        out[name].append(value)
            return pa.table(
                {
                    "combo": pa.array(out["combo"], pa.string()),
                    "step": pa.array(out["step"], pa.int32()),
                    "total": pa.array(out["total"], pa.float64()),
                    "n": pa.array(out["n"], pa.int64()),
                }
            )

        return score

    return task


def _means_and_medians(
    i: np.ndarray, d: np.ndarray, label: np.ndarray, members: np.ndarray, mine: np.ndarray, size: np.ndarray, clusters: int, far: float
) -> tuple[np.ndarray, np.ndarray]:
    """``a`` and ``b`` of every member of a block from its stored pairs by member ``i`` and length ``d``.

    ``label`` and ``members`` are the cluster at the other end and its size. A
    cluster of one entity is its own median; only the others are sorted.
    """
    n = len(mine)
    same = label == mine[i]
    stored = np.bincount(i[same], minlength=n)
    a = (np.bincount(i[same], d[same], n) + (size - 1 - stored) * far) / np.maximum(size - 1, 1)
    a[size <= 1] = 0.0
    b, seen = np.full(n, np.inf), np.zeros(n, np.int64)
    alone = np.flatnonzero(~same & (members == 1))
    who = i[alone]
    first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else alone
    b[who[first]] = d[alone[first]]
    seen += np.bincount(who, minlength=n)
    rows = np.flatnonzero(~same & (members > 1))
    if len(rows):
        # Sorted by label and place, so by label, member and length.
        rows = np.sort((label[rows].astype(np.int64) << 32) | rows) & 0xFFFFFFFF
        who, at = i[rows], label[rows]
        start = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (at[1:] != at[:-1])])
        who = who[start]
        np.minimum.at(b, who, _medians(d[rows], start, members[rows[start]].astype(np.int64), far))
        seen += np.bincount(who, minlength=n)
    return a, np.where(clusters - 1 > seen, np.minimum(b, far), b)


def _medians(d: np.ndarray, start: np.ndarray, size: np.ndarray, far: float) -> np.ndarray:
    """Median of every run of ascending ``d`` filled up to ``size`` with ``far``."""
    count = np.diff(np.r_[start, len(d)])
    missing = size - count
    below = np.add.reduceat((d <= far).astype(np.int64), start)

    def at(position: np.ndarray) -> np.ndarray:
        absent = (position >= below) & (position < below + missing)
        index = np.where(position < below, position, position - missing)
        return np.where(absent, far, d[start + np.clip(index, 0, count - 1)])

    return (at((size - 1) // 2) + at(size // 2)) / 2


def _hub_points(combined: Combined, labeled: DataFrame, ids: DataFrame, scored: dict) -> DataFrame:
    """The same for the hubs ``ids``, entities with very many stored pairs, whose ranks span tasks."""
    spark = labeled.sparkSession
    combos = sorted({c for c, _ in scored})
    hubs = ids.select("id", F.explode(F.array(*[F.lit(c) for c in combos])).alias("combo")).select("combo", "id")
    entry = F.struct("step", "label", F.col("size").cast("int").alias("size"))
    packed = cut(
        labeled.groupBy("combo", "id").agg(F.sort_array(F.collect_list(entry)).alias("at"))
        .select("combo", "id", F.col("at.step").alias("steps"), F.col("at.label").alias("labels"), F.col("at.size").alias("sizes"))
    )
    pairs = mirrored(combined.vectors, "combo", "d")
    far = choose(combined.background, F.col("combo"))
    table = F.broadcast(spark.createDataFrame([(c, t, n) for (c, t), n in scored.items()], "combo string, step int, n_clusters long"))
    mine = packed.join(F.broadcast(hubs), ["combo", "id"], "left_semi")
    theirs = hubs.withColumnRenamed("id", "nbr")
    stored = pairs.join(F.broadcast(mine.select("combo", "id", F.col("labels").alias("mine"))), ["combo", "id"])
    rows = (
        lookup(stored, packed.withColumnRenamed("id", "nbr"), ["combo", "nbr"], theirs)
        .select("combo", "id", "nbr", "d", F.explode(F.arrays_zip("steps", "mine", "labels", "sizes")).alias("p"))
        .select("combo", "id", "nbr", "d", F.col("p.steps").alias("step"), (F.col("p.mine") == F.col("p.labels")).alias("same"), F.col("p.labels").alias("label"), F.col("p.sizes").alias("size"))
        .join(table.select("combo", "step"), ["combo", "step"])
    )
    key = ["combo", "step", "id"]
    own = rows.filter("same").groupBy(*key).agg(F.sum("d").alias("own_sum"), F.count("d").alias("own_n"))
    others = cut(rows.filter(~F.col("same")).drop("same"))
    per_cluster = others.groupBy(*key, "label").agg(
        F.first("size").cast("long").alias("size"), F.count("d").alias("stored"), F.count(F.when(F.col("d") <= far, 1)).alias("below")
    ).withColumn("missing", F.col("size") - F.col("stored"))
    ranked = numbered(others.drop("size"), [*key, "label"], ["d", "nbr"], "rank").join(per_cluster, [*key, "label"])
    pos = F.when(F.col("d") <= far, F.col("rank")).otherwise(F.col("rank") + F.col("missing"))
    low, high = F.floor((F.col("size") - 1) / 2), F.floor(F.col("size") / 2)
    picked = F.when(pos == low, F.col("d")).otherwise(0.0) + F.when(pos == high, F.col("d")).otherwise(0.0)
    sums = ranked.groupBy(*key, "label").agg(F.sum(picked).alias("picked"))

    def absent_at(position):
        return ((position >= F.col("below")) & (position < F.col("below") + F.col("missing"))).cast("int")

    median = (F.col("picked") + far * (absent_at(low) + absent_at(high))) / 2
    medians = (
        per_cluster.join(sums, [*key, "label"]).select(*key, median.alias("m")).groupBy(*key)
        .agg(F.min("m").alias("median_min"), F.count("m").alias("seen"))
    )
    nodes = mine.select("combo", "id", F.explode(F.arrays_zip("steps", "sizes")).alias("p")).select(
        "combo", "id", F.col("p.steps").alias("step"), F.col("p.sizes").cast("long").alias("size")
    ).join(table, ["combo", "step"])
    zero = F.lit(0)
    a = F.when(
        F.col("size") > 1,
        (F.coalesce("own_sum", F.lit(0.0)) + (F.col("size") - 1 - F.coalesce("own_n", zero)) * far) / (F.col("size") - 1),
    ).otherwise(0.0)
    unseen = F.when(F.col("n_clusters") - 1 - F.coalesce("seen", zero) > 0, far)
    return nodes.join(own, key, "left").join(medians, key, "left").select(
        "combo", "step", "size", a.alias("a"), F.least("median_min", unseen).alias("b")
    )


def sweep(scores: DataFrame, ranges: dict[str, list[float]]) -> DataFrame:
    """Scored thresholds ``(combo, step, t1, silhouette, n_clusters, is_best)``.

    The best step has the largest silhouette above -1, the first one on ties.
    Scores are compared to 10 digits: equal clusterings must not differ by
    the order of an addition. The window sorts at most one row per threshold.
    """
    spark = scores.sparkSession
    table = spark.createDataFrame(
        [(c, i, t) for c, ts in ranges.items() for i, t in enumerate(ts)], "combo string, step int, t1 double"
    )
    level = F.round("silhouette", 10)
    order = Window.partitionBy("combo").orderBy(level.desc(), F.col("step"))
    return scores.join(F.broadcast(table), ["combo", "step"]).select(
        "combo", "step", "t1", "silhouette", "n_clusters",
        ((F.row_number().over(order) == 1) & (level > -1)).alias("is_best"),
    )


def best_clusters(sweep_rows: DataFrame, clusters: DataFrame, combos: list[str]) -> tuple[DataFrame, DataFrame]:
    """Best threshold per combination and its clusters ``(combo, id, leader)``.

    A combination without a usable threshold keeps ``t1 = 0``, silhouette -1,
    one cluster and no leaders.
    """
    spark = sweep_rows.sparkSession
    every = spark.createDataFrame([(c,) for c in combos], "combo string")
    chosen = sweep_rows.filter("is_best").select("combo", "step", "t1", "silhouette", "n_clusters")
    singles = cluster_counts(clusters).select("combo", "step", "single_point_ratio")
    best = F.broadcast(every).join(chosen.join(singles, ["combo", "step"]), "combo", "left").select(
        "combo", "step",
        F.coalesce("t1", F.lit(0.0)).alias("t1"),
        F.coalesce("silhouette", F.lit(-1.0)).alias("silhouette"),
        F.coalesce("n_clusters", F.lit(1)).cast("long").alias("n_clusters"),
        F.coalesce("single_point_ratio", F.lit(0.0)).alias("single_point_ratio"),
    )
    best = cut(best)
    labels = clusters.join(F.broadcast(best.select("combo", "step")), ["combo", "step"]).select("combo", "id", "leader")
    return best, labels
