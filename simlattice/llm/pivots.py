"""Operator 12: near-duplicate embeddings through a pivot-permutation index.

1. Equal vectors are one class. Pivots are fitted on ``SAMPLE`` classes in hash
   order: the centroids of groups of near ones first, then single vectors, no
   two near each other. Their number grows with the square root of the classes
   up to ``PIVOTS``.
2. A vector is described by its ``LENGTH`` nearest pivots in order, with their
   cosines. If it lies within half the link angle of the nearest, it belongs to
   that pivot's ball, and all members of a ball are linked with each other
   (triangle inequality of angles): they are counted, never paired.
3. A vector outside the balls is filed in the inverted lists of its ``POSTED``
   nearest pivots. In a list, vectors that share a second pivot of their
   descriptions meet; a pair with ``SHARED`` or more shared pivots is verified by
   its cosine, in the list of its smallest shared pivot only.
4. A vector outside meets the balls it may reach by the angles to their pivots,
   and balls meet each other likewise: linked as a whole, not at all, or
   verified member by member.
5. Lists and balls are cut into blocks, so a task holds two blocks. Tasks return
   a number of links per vector and a spanning forest, never the pairs.
   Components are made of balls and single vectors.

The index is approximate in step 3 alone: a pair at the limit of 0.9 that shares
too few pivots is missed; links found are links. Memory of the driver: the
sample, the pivots and one row per ball. A dense group that fits no ball (wider
than half the angle around its centroid) is compared pair by pair, in blocks.

Defined cases: a vector that is null, zero, of another length than most, or
holds a null, NaN or infinite component links with nothing; rows are told apart
by their vectors, so repeated ids are rows of their own and equal rows link;
a null id has the component of the smallest id it links to and is never kept;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simlattice.llm.ann import matrix, unit, usable
from simlattice.llm.jaccard import components
from simlattice.runtime import cut

SAMPLE = 8192
PIVOTS = 4096
LENGTH = 8
POSTED = 4
SHARED = 2
BLOCK = 4096
PAIRS = 200_000  # pairs looked at in one step of a task
SLACK = 1e-7  # radians; bounds only admit more candidates


def fit_pivots(sample: np.ndarray, number: int, cosine: float) -> np.ndarray:
    """At most ``number`` pivots of unit rows: centroids of groups of near rows, largest first, then single rows."""
    free = np.ones(len(sample), bool)
    pivots, held = [], []
    for start in range(0, len(sample), 512):
        near = sample[start : start + 512] @ sample.T >= cosine
        for i in np.flatnonzero(free[start : start + 512]):
            if free[start + i]:
                group = near[i] & free
                group[start + i] = True
                free &= ~group
                centre = sample[group].sum(axis=0)
                pivots.append(centre / np.linalg.norm(centre))
                held.append(int(group.sum()))
    return np.array(pivots)[np.argsort(-np.array(held), kind="stable")[:number]]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For ``n`` rows with links ``a, b``: the smallest row that each is connected to."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def shared_pairs(perm: np.ndarray, side: np.ndarray, pivot: int, shared: int, posted: int):
    """Index pairs of the rows of one list that share ``shared`` pivots, in steps.

    Rows are filed under each further pivot of theirs. A pair counts in the
    list of the smallest pivot that both are posted to, and there in the run of
    the smallest further one. ``side``: rows of different blocks pair up only
    across (-1: no such rule).
    """
    n, length = perm.shape
    row, second = np.repeat(np.arange(n), length), perm.ravel()
    row, second = row[second != pivot], second[second != pivot]
    order = np.lexsort((row, second))
    row, second = row[order], second[order]
    end = np.searchsorted(second, second, side="right")
    later = end - np.arange(len(row)) - 1  # partners of an entry: the rest of its run
    done = np.concatenate([[0], np.cumsum(later)])
    at = 0
    while at < len(row):
        stop = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, side="right")) - 1)
        many = later[at:stop]
        first = np.repeat(np.arange(at, stop), many)
        other = first + 1 + np.arange(len(first)) - np.repeat(done[at:stop] - done[at], many)
        i, j, run = row[first], row[other], second[first]
        at = stop
        across = (side[i] != side[j]) | (side[i] < 0)
        i, j, run = i[across], j[across], run[across]
        same = perm[i][:, :, None] == perm[j][:, None, :]
        mine = same.any(axis=2)
        least_second = np.where(mine & (perm[i] != pivot), perm[i], np.iinfo(perm.dtype).max).min(axis=1)
        both_posted = same[:, :posted, :posted].any(axis=2)
        least_list = np.where(both_posted, perm[i][:, :posted], np.iinfo(perm.dtype).max).min(axis=1)
        keep = (mine.sum(axis=1) >= shared) & (least_second == run) & (least_list == pivot)
        yield i[keep], j[keep]


def _report(uid, node, weight, chunks) -> pa.Table:
    """Links per row and a spanning forest of the chunks of linked row pairs."""
    n = len(uid)
    count, low = np.zeros(n, np.int64), np.arange(n)
    for i, j in chunks:
        np.add.at(count, i, weight[j])
        np.add.at(count, j, weight[i])
        low = forest(np.concatenate([i, np.arange(n)]), np.concatenate([j, low]), n)
    linked, tied = np.flatnonzero(count), np.flatnonzero((low != np.arange(n)) & (node[low] != node))
    nothing = pa.nulls(len(tied), pa.int64())
    return pa.table({
        "uid": pa.chunked_array([pa.array(uid[linked]), nothing]), "links": pa.chunked_array([pa.array(count[linked]), nothing]),
        "a": pa.chunked_array([pa.nulls(len(linked), pa.int64()), pa.array(node[tied])]), "b": pa.chunked_array([pa.nulls(len(linked), pa.int64()), pa.array(node[low[tied]])]),
    })


REPORT = "uid long, links long, a long, b long"


def _blocks(rows: DataFrame, group: list[str], block: int) -> DataFrame:
    """Rows of every ``group`` dealt to pairs of blocks ``x <= y`` of about ``block`` rows; ``side``: -1 in a block's pair with itself."""
    sizes = cut(rows.groupBy(*group).agg(F.ceil(F.count("uid") / block).cast("int").alias("blocks")))
    dealt = rows.join(sizes, group).withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))
    return dealt.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other"), "side": side}).drop("blocks", "own", "other")


def _two_sided(rows: DataFrame, block: int) -> DataFrame:
    """Rows ``g, side`` (0 or 1) dealt to tiles ``x, y``, one block of either side each."""
    sizes = cut(rows.groupBy("g").agg(*[F.ceil(F.count(F.when(F.col("side") == s, 1)) / block).cast("int").alias(f"n{s}") for s in (0, 1)]).filter("n0 > 0 and n1 > 0"))
    own = F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1"))
    other = F.when(F.col("side") == 0, F.col("n1")).otherwise(F.col("n0"))
    dealt = rows.join(sizes, "g").withColumn("own", F.pmod(F.xxhash64("uid"), own).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), other - 1)))
    first = F.col("side") == 0
    return dealt.withColumns({"x": F.when(first, F.col("own")).otherwise(F.col("other")), "y": F.when(first, F.col("other")).otherwise(F.col("own"))}).drop("n0", "n1", "own", "other")


def links(classes: DataFrame, dim: int, cosine: float, shared: int = SHARED, block: int = BLOCK, pivots: int | None = None):
    """Balls and links of ``classes(uid, m, v)``: ``(described, report, balls)``.

    ``described``: ``uid, m, ball, node`` (ball -1: outside); ``report``: rows of links and forest edges; ``balls``: per ball
    its pivot, rows and further links that all members have.
    """
    spark = classes.sparkSession
    total = classes.count()
    sample = unit(np.array([r["v"] for r in classes.orderBy(F.xxhash64("v"), "uid").limit(SAMPLE).select("v").collect()], np.float64))
    number = pivots or int(min(PIVOTS, max(64, 2 * math.sqrt(total))))
    points = fit_pivots(sample, number, cosine)
    length, posted = min(LENGTH, len(points)), min(POSTED, len(points))
    theta = math.acos(cosine)

    def describe(batches):
        for batch in (b.slice(i, 4096) for b in batches for i in range(0, len(b), 4096)):
            near = unit(matrix(batch.column("v"), dim)) @ points.T
            perm = np.argsort(-near, axis=1, kind="stable")[:, :length]
            near = np.clip(np.take_along_axis(near, perm, axis=1), -1, 1)
            angle = np.arccos(near)
            ball = np.where(angle[:, 0] <= theta / 2 - SLACK, perm[:, 0], -1).astype(np.int32)
            lists = [pa.ListArray.from_arrays(np.arange(0, length * len(batch) + 1, length, dtype=np.int32), pa.array(c)) for c in (perm.astype(np.int32).ravel(), angle.ravel())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists, pa.array(ball)], ["uid", "m", "v", "perm", "angle", "ball"])

    vectors = f"v {classes.schema['v'].dataType.simpleString()}"
    described = cut(classes.select("uid", "m", "v").mapInArrow(describe, f"uid long, m long, {vectors}, perm array<int>, angle array<double>, ball int"))
    balls = {r["ball"]: r for r in described.filter("ball >= 0").groupBy("ball").agg(F.sum("m").alias("rows"), F.max(F.get("angle", F.lit(0))).alias("radius"), F.min("uid").alias("node")).collect()}
    table = F.broadcast(spark.createDataFrame([(c, r["rows"], r["radius"], r["node"]) for c, r in balls.items()], "ball int, rows long, radius double, ball_node long"))
    described = described.join(table.select("ball", "ball_node"), "ball", "left").withColumn("node", F.coalesce("ball_node", "uid")).drop("ball_node")
    free, inside = described.filter("ball < 0"), described.filter("ball >= 0")

    def in_list(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        uid, node, weight, side = (group.column(c).to_numpy() for c in ("uid", "node", "m", "side"))
        perm = np.asarray(group.column("perm").combine_chunks().flatten()).reshape(-1, length)
        v = unit(matrix(group.column("v").combine_chunks(), dim))

        def verified():
            for i, j in shared_pairs(perm, side, key[0].as_py(), min(shared, length), posted):
                keep = (v[i] * v[j]).sum(axis=1) >= cosine
                yield i[keep], j[keep]

        return _report(uid, node, weight, verified())

    def in_tile(group: pa.Table) -> pa.Table:
        uid, node, weight, side = (group.column(c).to_numpy() for c in ("uid", "node", "m", "side"))
        v = unit(matrix(group.column("v").combine_chunks(), dim))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)

        def verified():
            step = max(1, PAIRS // max(1, len(right)))
            for start in range(0, len(left), step):
                rows = left[start : start + step]
                i, j = np.nonzero(v[rows] @ v[right].T >= cosine)
                yield rows[i], right[j]

        return _report(uid, node, weight, verified())

    columns = ["uid", "node", "m", "v"]
    filed = free.select(*columns, "perm", F.explode(F.slice("perm", 1, posted)).alias("list"))
    report = _blocks(filed, ["list"], block).groupBy("list", "x", "y").applyInArrow(in_list, REPORT)

    # Rows outside the balls against balls.
    reach = free.select(*columns, F.explode(F.arrays_zip(F.col("perm").alias("ball"), F.col("angle").alias("angle"))).alias("to")).select(*columns, "to.*").join(table, "ball")
    reach = cut(reach.filter(F.col("angle") <= theta + F.col("radius") + SLACK).withColumn("sure", F.col("angle") + F.col("radius") <= theta - SLACK))
    report = report.unionByName(reach.filter("sure").select("uid", F.col("rows").alias("links"), F.col("node").alias("a"), F.col("ball_node").alias("b")))
    more = {r["ball"]: r["more"] for r in reach.filter("sure").groupBy("ball").agg(F.sum("m").alias("more")).collect()}
    met = [r["ball"] for r in reach.filter("not sure").select("ball").distinct().collect()]

    # Balls against balls: the angle between their pivots decides, or their members are compared.
    names = np.array(sorted(balls), int)
    doubtful, ties = [], []
    if len(names):
        radius = np.array([balls[c]["radius"] for c in names.tolist()])
        for x in range(len(names)):
            apart = np.arccos(np.clip(points[names[x + 1 :]] @ points[names[x]], -1, 1))
            spread = radius[x] + radius[x + 1 :]
            for y in np.flatnonzero(apart <= theta + spread + SLACK).tolist():
                a, b = int(names[x]), int(names[x + 1 + y])
                if apart[y] + spread[y] <= theta - SLACK:
                    more[a] = more.get(a, 0) + balls[b]["rows"]
                    more[b] = more.get(b, 0) + balls[a]["rows"]
                    ties.append((None, None, balls[a]["node"], balls[b]["node"]))
                else:
                    doubtful.append((a, b))
    if ties:
        report = report.unionByName(spark.createDataFrame(ties, REPORT))
    sides = [(c, c, 1) for c in met] + [(PIVOTS + i, c, s) for i, pair in enumerate(doubtful) for s, c in enumerate(pair)]
    if sides:
        members = inside.select(*columns, "ball").join(spark.createDataFrame(sides, "g int, ball int, side int"), "ball").drop("ball")
        asking = reach.filter("not sure").select(*columns, F.col("ball").alias("g"), F.lit(0).alias("side"))
        report = report.unionByName(_two_sided(members.unionByName(asking), block).groupBy("g", "x", "y").applyInArrow(in_tile, REPORT))
    balls_table = spark.createDataFrame([(c, r["rows"] + more.get(c, 0)) for c, r in balls.items()], "ball int, every long")
    return described.select("uid", "m", "ball", "node"), cut(report), balls_table


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, **options) -> DataFrame:
    """``key, n_links, component_id, kept`` of every row; ``options`` go to ``links``."""
    kind = rows.schema[key].dataType.simpleString()
    every = rows.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    sizes = every.filter(usable(F.col("v"))).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    alone = (F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if sizes is None:
        return _named(every.select("id", *alone), key)
    dim = int(sizes["d"])
    takes_part = usable(F.col("v")) & (F.size("v") == dim)
    mark = [F.xxhash64("v"), F.xxhash64(F.lit(1), F.col("v"))]  # 128 bits name a class
    valid = every.filter(takes_part)
    classes = valid.groupBy(mark[0].alias("h1"), mark[1].alias("h2")).agg(F.count("v").alias("m"), F.min("id").alias("least"), F.first("v").alias("v"))
    classes = cut(classes.withColumn("uid", F.monotonically_increasing_id()))
    described, report, balls = links(classes, dim, cosine, **options)
    counts = report.filter("uid is not null").groupBy("uid").agg(F.sum("links").alias("links"))
    own = described.join(F.broadcast(balls), "ball", "left").join(counts, "uid", "left")
    own = cut(own.select("uid", "node", (F.coalesce("links", F.lit(0)) + F.coalesce("every", "m") - 1).alias("n_links")).join(classes.select("uid", "h1", "h2", "least"), "uid"))
    comp = components(report.filter("a is not null").select("a", "b")).select(F.col("id").alias("node"), "comp")
    nodes = own.groupBy("node").agg(F.min("least").alias("least")).join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = nodes.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "comp").select("node", "component_id")
    result = own.join(named, "node").select("h1", "h2", "n_links", "component_id")
    found = valid.select("id", mark[0].alias("h1"), mark[1].alias("h2")).join(result, ["h1", "h2"]).select("id", "n_links", F.col("component_id").cast(kind).alias("component_id"))
    return _named(found.unionByName(every.filter(~takes_part | takes_part.isNull()).select("id", *alone)), key)


def _named(rows: DataFrame, key: str) -> DataFrame:
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return rows.select(F.col("id").alias(key), "n_links", "component_id", kept.alias("kept"))


def op12_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding with its links of cosine 0.9 or more and its component."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_sql() -> str:
    """All pairs, which is feasible on small tables only."""
    return """
WITH RECURSIVE v AS (
  SELECT vec_id, [x::DOUBLE for x in embedding] AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(id, other) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a
), comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT c.id AS vec_id, (SELECT count(*) FROM links WHERE links.a = c.id) AS n_links, c.component_id, c.id = c.component_id AS kept
FROM comp c
"""
