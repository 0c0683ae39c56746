"""Operator 13: hard negatives by L2AP-style threshold joins.

Components become the integers ``floor(scale * x)``, a score is the exact inner
product with the anchor. A threshold join finds the rows that score ``t`` or
more (after Anastasiu and Karypis, ICDE 2014):

- columns are ordered by rising energy; a row's leading columns are left out of
  the index as long as their norm times that of the anchor stays below ``t``;
- the index is read from the last columns on, partial scores accumulate, and a
  pair is dropped as soon as the norms of what remains cannot lift it to ``t``;
- what survives is scored exactly.

Both steps lower their thresholds until the windows fill. An anchor first asks
for same-label rows above a score that a bounded sample lets expect more than
enough of; if fewer than the positives wanted come back, it asks again at its
lowest sample score, then without a threshold. Then every positive asks for
different-label rows from 90, 75 and at last ``low`` percent of its score up to
``high`` percent; those with enough leave after each round. A round returns all
rows above its threshold, so what it fills is final.

Rows are dealt to blocks and anchors to chunks by a hash; a task holds a block
and a chunk, and returns no more rows per anchor than can be used. Work is
anchors times rows at most, which is the stated query set.

Defined cases: rows with a null id, label or vector, with a vector of another
length than most, or with a null, NaN or infinite component take no part, nor
do those whose squared norm would not fit a long; of rows with one id the
smallest vector and label count; ties go to the smaller id; a negative positive
score has an empty window; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simlattice.llm.ann import matrix
from simlattice.runtime import cut

SAMPLE = 2048
BLOCK = 8192
CHUNK = 4096
STEPS = (90, 75)  # percent of a positive's score that are tried before the lower end of the window
LEAST = -(2**63)
GROUP = 8  # columns read at a time
TILE = 1024, 256  # rows and anchors of one dense step


def integers(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    return np.floor(scale * matrix(column, dim)).astype(np.int64)


def at_least(rows: np.ndarray, anchors: np.ndarray, least: np.ndarray):
    """Index pairs and exact scores of ``rows[i] . anchors[j] >= least[j]``, all integers; columns come in order of rising energy."""
    dim = rows.shape[1]
    x, q = rows.astype(np.float64), anchors.astype(np.float64)
    grown = 1 + 1e-9  # rounding only admits more candidates
    head_x = np.sqrt(np.pad(np.cumsum(x * x, axis=1), ((0, 0), (1, 0)))) * grown  # norm of the first k columns
    head_q = np.sqrt(np.pad(np.cumsum(q * q, axis=1), ((0, 0), (1, 0))))
    floor = least.astype(np.float64)
    floor = floor - 1e-9 * np.abs(floor) - 1e-6
    omitted = np.zeros(len(x), np.int64)
    if (floor > 0).all():
        omitted = (head_x * (head_q / floor[:, None]).max(axis=0) < 1).sum(axis=1) - 1
        omitted = np.clip(omitted, 0, dim)
    indexed = np.where(np.arange(dim) >= omitted[:, None], x, 0.0)
    partial = np.zeros((len(x), len(q)))
    stop = dim
    while stop > 0:
        start = max(0, stop - GROUP)
        partial += indexed[:, start:stop] @ q[:, start:stop].T
        stop = start
        open_ = np.maximum(start, omitted)
        alive = partial + head_x[np.arange(len(x)), open_][:, None] * head_q[:, open_].T >= floor
        if alive.sum() <= 0.25 * alive.size:
            break
    i, j = np.nonzero(alive)
    partial = partial[i, j]
    while stop > 0 and len(i):
        start = max(0, stop - GROUP)
        partial = partial + (indexed[i, start:stop] * q[j, start:stop]).sum(axis=1)
        stop = start
        open_ = np.maximum(start, omitted[i])
        keep = partial + head_x[i, open_] * head_q[j, open_] >= floor[j]
        i, j, partial = i[keep], j[keep], partial[keep]
    score = (rows[i] * anchors[j]).sum(axis=1)
    keep = score >= least[j]
    return i[keep], j[keep], score[keep]


def all_at_least(rows: np.ndarray, anchors: np.ndarray, least: np.ndarray):
    """``at_least`` in tiles, one array of pairs per tile of anchors and rows."""
    for b in range(0, len(anchors), TILE[1]):
        for a in range(0, len(rows), TILE[0]):
            i, j, score = at_least(rows[a : a + TILE[0]], anchors[b : b + TILE[1]], least[b : b + TILE[1]])
            yield i + a, j + b, score


def best(groups: np.ndarray, score: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` first of every group by falling score and rising rank."""
    order = np.lexsort((rank, -score, groups))
    sorted_ = groups[order]
    place = np.arange(len(order)) - np.searchsorted(sorted_, sorted_, side="left")
    return order[place < k]


class Miner:
    """Blocks of rows, the column order and the sample of one job."""

    def __init__(self, rows: DataFrame, scale: int, wanted: int):
        self.scale, self.wanted, self.spark = scale, wanted, rows.sparkSession
        self.kind, self.tag = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
        squares = F.aggregate(F.col("v"), F.lit(0.0), lambda t, x: t + F.pow(scale * x.cast("double"), F.lit(2.0)))
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        valid = rows.filter("id is not null and label is not null and v is not null").filter(finite).filter((F.size("v") > 0) & (squares < 2.0**61))
        one = cut(valid.groupBy("id").agg(F.min(F.struct("v", "label")).alias("r")).select("id", "r.v", "r.label"))
        most = one.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        self.dim = int(most["d"]) if most else 0
        self.rows = one.filter(F.size("v") == self.dim)
        self.total = int(most["count"]) if most else 0
        if not self.total:
            return
        sample = self.rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
        vectors = np.floor(scale * np.array([r["v"] for r in sample], np.float64)).astype(np.int64)
        self.order = np.argsort((vectors.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        self.sample = [r["id"] for r in sample], [r["label"] for r in sample], vectors
        self.blocks = -(-self.total // BLOCK)

    def first_thresholds(self, anchors: DataFrame) -> DataFrame:
        """``anchors(id, v, label)`` with ``steps``: falling thresholds for their positives, the last without bound."""
        ids, labels, vectors = self.sample
        dim, scale, wanted = self.dim, self.scale, self.wanted
        expected = max(1, min(wanted, int(np.ceil(2.5 * wanted * len(ids) / self.total))))
        position = {name: i for i, name in enumerate(ids)}

        def run(batches):
            own_label = np.array(labels, object)
            for batch in (b.slice(i, 1024) for b in batches for i in range(0, len(b), 1024)):
                scores = integers(batch.column("v"), dim, scale) @ vectors.T
                steps = []
                for name, label, row in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), scores):
                    same = own_label == label
                    if name in position:
                        same[position[name]] = False
                    top = -np.sort(-row[same])[:wanted]
                    known = [int(top[expected - 1])] if len(top) >= expected else []
                    if len(top) == wanted:
                        known.append(int(top[-1]))
                    steps.append([*dict.fromkeys(known), LEAST])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(steps, pa.list_(pa.int64()))], [*batch.schema.names, "steps"])

        vector = self.rows.schema["v"].dataType.simpleString()
        return anchors.select("id", "v", "label").mapInArrow(run, f"id {self.kind}, v {vector}, label {self.tag}, steps array<long>")

    def join(self, asking: DataFrame, columns: list[str], search, schema: str) -> DataFrame:
        """``search(rows table, anchors table)`` over all pairs of a block of rows and a chunk of ``asking(id, v, label, ...)``."""
        chunks = -(-asking.count() // CHUNK)
        deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        rows = self.rows.select("id", "v", "label", deal(self.blocks).alias("x"), every(max(1, chunks)).alias("y"))
        asks = asking.select("id", "v", "label", *columns, every(self.blocks).alias("x"), deal(max(1, chunks)).alias("y"))
        return rows.groupBy("x", "y").cogroup(asks.groupBy("x", "y")).applyInArrow(search, schema)

    def positives(self, anchors: DataFrame) -> DataFrame:
        """``id, other, score, place`` of the first same-label rows of every anchor."""
        dim, scale, wanted, order, kinds = self.dim, self.scale, self.wanted, self.order, (self.kind, self.tag)

        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            if left.num_rows and right.num_rows:
                rows, asks, labels, ask_labels, same_id, rank = prepared(left, right, dim, scale, order)
                for i, j, score in all_at_least(rows, asks, right.column("least").to_numpy()):
                    keep = (labels[i] == ask_labels[j]) & (same_id[j] != i)
                    i, j, score = i[keep], j[keep], score[keep]
                    top = best(j, score, rank[i], wanted)
                    out.append((i[top], j[top], score[top]))
            i, j, score = _joined(out)
            top = best(j, score, rank[i], wanted) if len(i) else i
            return pa.table({"id": right.column("id").take(pa.array(j[top])), "other": left.column("id").take(pa.array(i[top])), "score": pa.array(score[top])})

        todo, found = cut(self.first_thresholds(anchors).withColumn("step", F.lit(0))), []
        first = Window.partitionBy("id").orderBy(F.desc("score"), "other")
        while todo.limit(1).count():
            asking = todo.withColumn("least", F.get("steps", F.col("step")))
            got = self.join(asking, ["least"], search, f"id {kinds[0]}, other {kinds[0]}, score long")
            got = cut(got.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= wanted))
            filled = got.filter(F.col("place") == wanted).select("id")
            short = todo.join(filled, "id", "left_anti").filter(F.col("step") + 1 < F.size("steps"))
            todo = cut(short.withColumn("step", F.col("step") + 1))
            found.append(got.join(todo.select("id"), "id", "left_anti"))
        result = found[0] if found else self.spark.createDataFrame([], f"id {kinds[0]}, other {kinds[0]}, score long, place int")
        for more in found[1:]:
            result = result.unionByName(more)
        return cut(result)

    def negatives(self, anchors: DataFrame, positives: DataFrame, low: int, high: int, count: int) -> DataFrame:
        """``id, place, other, score, rank``: the first different-label rows in the window of every positive."""
        dim, scale, order, kinds = self.dim, self.scale, self.order, (self.kind, self.tag)
        ceiling = lambda percent: F.expr(f"-floor(-cast(score as decimal(38, 0)) * {percent} / 100)").cast("long")
        top = F.expr(f"floor(cast(score as decimal(38, 0)) * {high} / 100)").cast("long")

        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            if left.num_rows and right.num_rows:
                rows, asks, labels, ask_labels, _, rank = prepared(left, right, dim, scale, order)
                windows = right.column("windows").to_pylist()
                least = np.array([min(w["low"] for w in ws) for ws in windows])
                width = max(map(len, windows))
                # Windows of an anchor side by side; the missing ones hold no score.
                bounds = np.array([[(w["low"], w["high"], w["place"]) for w in ws] + [(1, 0, 0)] * (width - len(ws)) for ws in windows])
                for i, j, score in all_at_least(rows, asks, least):
                    other = labels[i] != ask_labels[j]
                    i, j, score = i[other], j[other], score[other]
                    for w in range(width):
                        within = (score >= bounds[j, w, 0]) & (score <= bounds[j, w, 1])
                        a, b, s = i[within], j[within], score[within]
                        keep = best(b, s, rank[a], count)
                        out.append((a[keep], b[keep] * width + w, s[keep]))
            i, slot, score = _joined(out)
            if len(i):
                keep = best(slot, score, rank[i], count)
                i, slot, score = i[keep], slot[keep], score[keep]
            j, w = (slot // width, slot % width) if len(i) else (slot, slot)
            place = bounds[j, w, 2] if len(i) else slot
            return pa.table({"id": right.column("id").take(pa.array(j)), "place": pa.array(place.astype(np.int32)), "other": left.column("id").take(pa.array(i)), "score": pa.array(score)})

        todo, found = cut(positives.select("id", "place", "score").filter("score >= 0")), []
        first = Window.partitionBy("id", "place").orderBy(F.desc("score"), "other")
        for percent in [*(p for p in STEPS if low < p < high), low]:
            if not todo.limit(1).count():
                break
            windows = todo.groupBy("id").agg(F.collect_list(F.struct("place", ceiling(percent).alias("low"), top.alias("high"))).alias("windows"))  # as many as positives
            got = self.join(cut(anchors.select("id", "v", "label").join(windows, "id")), ["windows"], search, f"id {kinds[0]}, place int, other {kinds[0]}, score long")
            got = cut(got.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= count))
            if percent == low:
                found.append(got)
                break
            filled = got.filter(F.col("rank") == count).select("id", "place")
            todo = cut(todo.join(filled, ["id", "place"], "left_anti"))
            found.append(got.join(filled, ["id", "place"], "left_semi"))
        result = found[0] if found else self.spark.createDataFrame([], f"id {kinds[0]}, place int, other {kinds[0]}, score long, rank int")
        for more in found[1:]:
            result = result.unionByName(more)
        return result


def _joined(parts: list) -> list[np.ndarray]:
    empty = np.zeros(0, np.int64)
    return [np.concatenate([p[k] for p in parts]) if parts else empty for k in range(3)]


def prepared(left: pa.Table, right: pa.Table, dim: int, scale: int, order: np.ndarray):
    """Integer rows and anchors in column order, common label codes, the anchor's own row or -1, and the id ranks of the rows."""
    rows, asks = (integers(t.column("v").combine_chunks(), dim, scale)[:, order] for t in (left, right))
    codes: dict = {}
    labels, ask_labels = (np.array([codes.setdefault(x, len(codes)) for x in t.column("label").to_pylist()]) for t in (left, right))
    ids = left.column("id").to_pylist()
    at = {x: i for i, x in enumerate(ids)}
    same_id = np.array([at.get(x, -1) for x in right.column("id").to_pylist()])
    rank = np.empty(len(ids), np.int64)
    rank[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
    return rows, asks, labels, ask_labels, same_id, rank


def hard_negatives(rows: DataFrame, anchors: Column, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``rows(id, v, label)``.

    ``anchors``: which ids ask. A positive is one of the first ``positives``
    other rows of the anchor's label; negatives score from ``low`` to ``high``
    percent of it.
    """
    miner = Miner(rows.select("id", "v", "label"), scale, positives)
    kind = miner.kind
    if not miner.total:
        return rows.sparkSession.createDataFrame([], f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long")
    asking = cut(miner.rows.filter(anchors))
    best_ = miner.positives(asking)
    found = miner.negatives(asking, best_, low, high, negatives)
    pairs = best_.select("id", "place", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(pairs, ["id", "place"]).select(
        F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every embedding whose id is divisible by 50; every seventh label is moved on by one."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), label.alias("label")), F.col("id") % 50 == 0)


def op13_sql() -> str:
    return """
WITH v AS (
  SELECT vec_id AS id, [floor(256 * x::DOUBLE) for x in embedding] AS y,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), scored AS (
  SELECT a.id AS anchor, b.id AS id, a.label = b.label AS same, CAST(list_inner_product(a.y, b.y) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0
), positive AS (
  SELECT anchor, id, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5
), found AS (
  SELECT p.anchor, p.id AS positive, p.score AS ps, n.id AS negative, n.score AS ns,
    row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS place
  FROM positive p JOIN scored n ON p.anchor = n.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(place AS INTEGER) AS rank, negative AS negative_id, ps AS positive_score, ns AS negative_score
FROM found WHERE place <= 3
"""
