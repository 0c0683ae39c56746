"""Operator 5: nearest neighbours by an adaptive scan of dimensions.

Vectors are scaled to length 1, where the largest cosine is the smallest
distance, and turned by a random rotation, so that any block of columns tells
about the same of a distance. Centroids fitted on a bounded sample divide all
vectors into lists. A query first scans the lists whose centroids are nearest,
until they hold ``FIRST`` rows. The distance ``r`` of the last of its best goes
with it to the other lists it probes; a list whose members must all be farther
than ``r`` (distance to the centroid less the list's reach) is left out. In a
list the columns are read in blocks, for all queries of the task at once.
After ``d`` of ``D`` columns the partial squared distance ``p`` tests the
hypothesis that the candidate is within the radius: it is given up if

    p * D / d > r ** 2 * (1 + eps / sqrt(d)) ** 2

What survives all blocks is scored exactly, on the original vectors in double
precision.

Equal vectors are one candidate that stands for its smallest ids, so a vector
with very many copies is one row. Lists are cut into parts of ``PART`` rows,
and a query visits all parts. Queries are dealt into chunks of about
``QUERIES`` by a hash of their id, and every part is copied to each chunk, so
a task holds one part and one chunk. Centroids and rotation are broadcast; their
number is bounded by ``LISTS``.

Defined cases: vectors that are null, zero, of another length than most, or
hold a null, NaN or infinite component take no part, nor do null ids; of rows
with one id the smallest vector counts; ties go to the smaller id; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simlattice.runtime import cut

SAMPLE = 8192
LISTS = 1024
FIRST = 256
PART = 4096
QUERIES = 16384
BLOCK = 16
TOGETHER = 256
EPS = 2.1
SEED = 7


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def level(rows: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two, which changes no cosine by a bit, so that their products stay finite."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centroids of the rows of length 1 by Lloyd rounds from a seeded start."""
    rng = np.random.default_rng(SEED)
    centroids = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        near = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 0, sums / np.where(size > 0, size, 1), centroids)
    return centroids


def scan(queries: np.ndarray, rows: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (query, row) that may be among the ``k`` nearest, and the number of components read.

    All are rotated and of length 1. ``bound``: squared distance of every query
    beyond which no row is wanted, infinite if unknown; it shrinks on the way.
    """
    (n, dim), m = rows.shape, len(queries)
    radius, best = bound.astype(np.float64), np.full((m, k), np.inf)
    found, read, start = [], 0, 0
    while start < n:
        stop = min(n, start + (1024 if start else max(4 * k, 64)))
        for c in range(0, dim, BLOCK):
            d = min(dim, c + BLOCK)
            slack = (1 + EPS / np.sqrt(d)) ** 2 if d < dim else 1 + 1e-9
            if c == 0:
                x, y = queries[:, :d], rows[start:stop, :d]
                first = np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T), 0)
                read += first.size * d
                who, at = np.nonzero(first * (dim / d) <= radius[:, None] * slack + 1e-12)
                partial = first[who, at]
                at = at + start
                continue
            read += len(at) * (d - c)
            partial = partial + ((rows[at, c:d] - queries[who, c:d]) ** 2).sum(axis=1)
            stay = partial * (dim / d) <= radius[who] * slack + 1e-12
            who, at, partial = who[stay], at[stay], partial[stay]
        found.append((who, at, partial))
        order = np.lexsort((partial, who))
        place = np.arange(len(order)) - np.searchsorted(who[order], who[order])
        lead, place = order[place < k], place[place < k]
        new = np.full((m, k), np.inf)
        new[who[lead], place] = partial[lead]
        best = np.sort(np.hstack([best, new]), axis=1)[:, :k]
        radius = np.minimum(radius, best[:, -1])
        start = stop
    who, at, distance = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    near = distance <= radius[who] * (1 + 1e-9) + 1e-12
    return who[near], at[near], read


def nearest(rows: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, probe: float = 0.7) -> DataFrame:
    """``query_id, rank, key, score`` of the ``k`` nearest rows found for the rows where ``queries`` holds.

    ``probe``: part of the lists that a query scans.
    """
    spark = rows.sparkSession
    valid = rows.filter(F.col(key).isNotNull() & usable(F.col(vector)))
    one = cut(valid.groupBy(F.col(key).alias("id")).agg(F.min(vector).alias("v")))
    sizes = one.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    kind = rows.schema[key].dataType.simpleString()
    schema = f"query_id {kind}, rank int, `{key}` {kind}, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim = int(sizes["d"])
    one = one.filter(F.size("v") == dim)
    copies = Window.partitionBy("v").orderBy("id")
    placed = one.withColumn("place", F.row_number().over(copies)).filter(F.col("place") <= k + 1)
    classes = cut(placed.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    total = classes.count()
    sample = unit(np.array([r["v"] for r in classes.orderBy(F.xxhash64("v")).limit(SAMPLE).select("v").collect()], np.float64))
    rotation = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))[0]
    lists = int(min(LISTS, max(1, np.sqrt(total)), len(sample)))
    centroids = fit_centroids(sample, lists)

    def assign(batches):
        for batch in batches:
            cosine = unit(matrix(batch.column("v"), dim)) @ centroids.T
            far = np.sqrt(np.maximum(2 - 2 * cosine.max(axis=1), 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.argmax(cosine, axis=1).astype(np.int32)), pa.array(far)], [*batch.schema.names, "list", "far"])

    vectors = f"v {classes.schema['v'].dataType.simpleString()}"
    listed = cut(classes.mapInArrow(assign, f"{vectors}, ids array<{kind}>, list int, far double"))
    held = {r["list"]: r for r in listed.groupBy("list").agg(F.count("list").alias("n"), F.max("far").alias("far")).collect()}  # as many rows as lists
    counts = np.array([held[i]["n"] if i in held else 0 for i in range(lists)])
    reach = np.array([held[i]["far"] if i in held else 0.0 for i in range(lists)])
    parts = np.maximum(1, -(-counts // PART))
    least = max(1, round(probe * lists))

    def plan(batches):
        """The lists that a query scans first, the others it probes, and how near their members can be at best."""
        step = max(1, 65_536 // lists)
        for batch in (whole.slice(i, step) for whole in batches for i in range(0, len(whole), step)):
            cosine = unit(matrix(batch.column("v"), dim)) @ centroids.T
            order = np.argsort(-cosine, axis=1, kind="stable")
            sums = np.cumsum(counts[order], axis=1)
            use = np.maximum(least, (sums < 20 * k).sum(axis=1) + 1)
            first = np.minimum(use, (sums < max(20 * k, FIRST)).sum(axis=1) + 1)
            gap = np.sqrt(np.maximum(2 - 2 * cosine, 0)) - reach - 1e-6
            near = [o[:f][counts[o[:f]] > 0] for o, f in zip(order, first)]
            rest = [o[f:u][counts[o[f:u]] > 0] for o, f, u in zip(order, first, use)]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("v"), pa.array([x.astype(np.int32) for x in near], pa.list_(pa.int32())),
                pa.array([x.astype(np.int32) for x in rest], pa.list_(pa.int32())), pa.array([g[x] for g, x in zip(gap, rest)], pa.list_(pa.float64())),
            ], ["id", "v", "near", "rest", "gap"])

    asking = one.filter(F.expr("true") if queries is None else queries).select("id", "v")
    planned = cut(asking.mapInArrow(plan, f"id {kind}, {vectors}, near array<int>, rest array<int>, gap array<double>"))
    chunks = max(1, -(-planned.count() // QUERIES))
    part_count = F.element_at(F.array(*(F.lit(int(p)) for p in parts)), F.col("list") + 1)
    part_of = F.pmod(F.xxhash64("v"), part_count).cast("int")
    stored = listed.select("ids", "v", "list", part_of.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = right.schema.field("id").type
        done = [pa.table({"query_id": pa.array([], kinds), "id": pa.array([], kinds), "score": pa.array([], pa.float64())})]
        if left.num_rows and right.num_rows:
            original = level(matrix(left.column("v").combine_chunks(), dim))
            rows_turned = unit(original) @ rotation
            norms = np.linalg.norm(original, axis=1)
            names = left.column("ids").combine_chunks()
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(names).to_numpy(zero_copy_only=False))])
            for start in range(0, right.num_rows, TOGETHER):
                some = right.slice(start, TOGETHER)
                asks = level(matrix(some.column("v").combine_chunks(), dim))
                who, at, _ = scan(unit(asks) @ rotation, rows_turned, some.column("bound").to_numpy(), k + 1)
                score = (original[at] * asks[who]).sum(axis=1) / (norms[at] * np.linalg.norm(asks, axis=1)[who])
                many = ends[at + 1] - ends[at]  # a pair for each id of the class
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(ends[at], many)
                who = np.repeat(who, many)
                pairs = pa.table({"who": who, "query_id": some.column("id").take(pa.array(who)), "id": names.flatten().take(pa.array(place)), "score": np.repeat(score, many)})
                pairs = pairs.filter(pc.not_equal(pairs["query_id"], pairs["id"])).sort_by([("who", "ascending"), ("score", "descending"), ("id", "ascending")])
                who = pairs["who"].to_numpy()
                done.append(pairs.filter(pa.array(np.arange(len(who)) - np.searchsorted(who, who) < k)).select(["query_id", "id", "score"]))
        return pa.concat_tables(done)

    def searched(asks: DataFrame) -> DataFrame:
        """Scores found by rows ``id, v, bound, list``, of which every part of the list is visited."""
        visits = asks.withColumn("part", F.explode(F.sequence(F.lit(0), part_count - 1))).withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
        both = stored.groupBy("list", "part", "chunk").cogroup(visits.groupBy("list", "part", "chunk"))
        return both.applyInArrow(search, f"query_id {kind}, id {kind}, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    nothing = F.lit(float("inf"))
    early = cut(ranked(searched(planned.select("id", "v", nothing.alias("bound"), F.explode("near").alias("list")))).drop("rank"))
    bounds = early.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("score") >= k, 2 - 2 * F.min("score")).alias("bound"))
    bounded = planned.join(bounds, "id", "left").withColumn("bound", F.greatest(F.coalesce("bound", nothing), F.lit(0.0)))
    within = F.filter(F.arrays_zip("rest", "gap"), lambda x: (x["gap"] <= 0) | (x["gap"] * x["gap"] <= F.col("bound")))
    late = searched(bounded.select("id", "v", "bound", F.explode(within).alias("at")).select("id", "v", "bound", F.col("at.rest").alias("list")))
    return ranked(early.unionByName(late)).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50, among all others."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)
