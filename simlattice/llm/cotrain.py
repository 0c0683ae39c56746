"""Operator 1: a quality classifier by co-training of two views.

One view sees the text (rates of symbols, capitals, repeats, ... over the
whole text), the other the metadata of the page (source, language, declared
length and its band). Both start from the same labelled rows. In every round
each view labels the unlabelled documents it is sure of and hands them to the
other view. What "sure" means is found on a part of the labelled rows that
neither has learned from: the widest range of scores whose error is at most a
``LIFT``-th of what the class has by chance. Labels on which the views differ
are given to neither. Given rows of a class weigh as much as its labelled rows
together, however many there are. In the end both views are calibrated and
combined by a logistic rule on another part, and all documents are scored.

The labelled rows are a bounded sample, ``SAMPLE`` by a hash of their id. The
unlabelled ones are all documents: their two views are written once as a table
of numbers, and every Newton step of a round is one pass over it that adds
gradients and curvatures per class. Only these sums reach the driver.

Defined cases: a null or empty text has features 0; null metadata is a value
of its own; ids labelled twice count as the smaller label; null ids and labels
are not learned from; without labels of both kinds every document scores 1
and is kept; repeated rows score alike; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import copy
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simlattice.llm.features import hashed, logistic, sigmoid, text_features
from simlattice.llm.words import buffers, chunks
from simlattice.runtime import cut

SAMPLE = 10_000
ROUNDS, STEPS, LIFT = 3, 3, 4
SOURCES, LANGUAGES, BANDS = 32, 8, 16
KEEP = 0.5


def text_view(column: pa.Array) -> np.ndarray:
    """Text features of every row, in chunks of bounded size; squares let a rate be bad at both ends."""
    data, offsets = buffers(column)
    parts = [text_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets)]
    x = np.concatenate(parts) if parts else np.zeros((0, 13))
    return np.hstack([x, np.sqrt(np.maximum(x, 0))])


def meta_view(source: pa.Array, lang: pa.Array, length: pa.Array) -> np.ndarray:
    """One-hot buckets of source, language and band of the declared length, and its logarithm."""
    n = len(source)
    x = np.zeros((n, SOURCES + LANGUAGES + BANDS + 2))
    x[np.arange(n), hashed(source.to_pylist(), SOURCES)] = 1
    x[np.arange(n), SOURCES + hashed(lang.to_pylist(), LANGUAGES)] = 1
    sizes = np.array([-1.0 if v is None else float(v) for v in length.to_pylist()])
    x[:, -2] = np.log1p(np.maximum(sizes, 0))
    x[np.arange(n), SOURCES + LANGUAGES + np.minimum(x[:, -2].astype(np.int64), BANDS - 1)] = 1
    x[:, -1] = sizes < 0
    return x


class View:
    """A logistic model of standardised features with a calibrated output."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> "View":
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.weights = logistic((x - self.mean) / self.scale, y, ridge=3.0)
        self.line = np.array([1.0, 0.0])
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1], -20, 20)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "View":
        """Platt's line on rows the model has not seen."""
        self.line = logistic(self.raw(x)[:, None], y, ridge=0.1)
        self.line[0] = max(self.line[0], 0.0)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.line[0] * self.raw(x) + self.line[1]


def gates(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scores from which up a row is surely 1, and down to which surely 0; infinite if the view is never sure."""
    found = []
    for side in (1, 0):
        order = np.argsort(-raw if side else raw, kind="stable")
        wrong = np.cumsum(y[order] != side)
        error = (wrong + 1) / (np.arange(len(y)) + 3)
        last = np.append(raw[order][1:] != raw[order][:-1], True)  # equal scores are claimed together
        good = np.flatnonzero((error <= (y != side).mean() / LIFT) & last)
        found.append(raw[order[good[-1]]] if len(good) else np.inf if side else -np.inf)
    return float(found[0]), float(found[1])


def claimed(givers: list[View], limits: list[tuple[float, float]], x: list[np.ndarray]) -> list[np.ndarray]:
    """The label 1 or 0 that each view is sure of, else -1; where the views differ, both have -1."""
    said = []
    for view, (high, low), v in zip(givers, limits, x):
        raw = view.raw(v)
        said.append(np.where(raw >= high, 1, np.where(raw <= low, 0, -1)))
    differ = (said[0] >= 0) & (said[1] >= 0) & (said[0] != said[1])
    return [np.where(differ, -1, s) for s in said]


def slopes(view: View, x: np.ndarray, y: float, clip: float = 8) -> np.ndarray:
    """Number of rows, gradient and curvature of the likelihood of ``y`` in one array."""
    z = np.hstack([np.clip((x - view.mean) / view.scale, -clip, clip), np.ones((len(x), 1))])
    p = sigmoid(z @ view.weights)
    return np.concatenate([[len(x)], z.T @ (y - p), ((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z).ravel()])


def given_slopes(free: DataFrame, givers: list[View], limits: list, takers: list[View]) -> dict:
    """``slopes`` per taking view and class over all rows ``one, two`` that the other view is sure of."""

    def run(batches):
        total: dict = {}
        for batch in batches:
            x = [np.asarray(c.flatten(), np.float64).reshape(len(batch), -1) for c in batch.columns]
            if not len(batch):
                continue
            said = claimed(givers, limits, x)
            for taker in (0, 1):
                for side in (0, 1):
                    rows = said[1 - taker] == side
                    if rows.any():
                        total[taker, side] = total.get((taker, side), 0) + slopes(takers[taker], x[taker][rows], side)
        for (taker, side), values in total.items():
            n = len(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, taker, np.int32)), pa.array(np.full(n, side, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(values)], ["taker", "side", "at", "value"])

    sums = free.select("one", "two").mapInArrow(run, "taker int, side int, at int, value double").groupBy("taker", "side", "at").agg(F.sum("value").alias("value")).toPandas()
    return {key: part.sort_values("at")["value"].to_numpy() for key, part in sums.groupby(["taker", "side"])}


def co_train(views: list[np.ndarray], y: np.ndarray, free: DataFrame) -> dict:
    """Two calibrated views, the rule that combines them, and the rows ``given`` per round to each view and class.

    Of the labelled rows three fifths are learned from, one finds how sure a
    view must be, and one calibrates. ``free``: the unlabelled rows ``one, two``.
    """
    fifth = np.arange(len(y)) % 5
    parts = [fifth < 3, fifth == 3, fifth == 4]
    if any(len(np.unique(y[p])) < 2 for p in parts):
        parts = [np.ones(len(y), bool)] * 3
    seen, gate, check = parts
    models = [View().fit(v[seen], y[seen]) for v in views]
    given = []
    for _ in range(ROUNDS):
        givers = [copy.copy(m) for m in models]
        limits = [gates(m.raw(v[gate]), y[gate]) for m, v in zip(givers, views)]
        if not np.isfinite(limits).any():
            break
        for _ in range(STEPS):
            sums = given_slopes(free, givers, limits, models)
            for taker, view in enumerate(models):
                d = len(view.weights)
                total = slopes(view, views[taker][seen][y[seen] == 1], 1) + slopes(view, views[taker][seen][y[seen] == 0], 0)
                for side in (0, 1):
                    if (taker, side) in sums:
                        part = sums[taker, side]
                        total = total + part * min(1.0, (y[seen] == side).sum() / part[0])
                penalty = np.full(d, 3.0)
                penalty[-1] = 1e-6
                step = np.linalg.solve(total[1 + d :].reshape(d, d) + np.diag(penalty), total[1 : 1 + d] - penalty * view.weights)
                view.weights = view.weights + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        given.append({key: int(part[0]) for key, part in sums.items()})
        if not sums:
            break
    for view, v in zip(models, views):
        view.calibrate(v[check], y[check])
    logits = np.stack([m.logit(v[check]) for m, v in zip(models, views)], axis=1)
    return {"views": models, "rule": logistic(np.clip(logits, -8, 8), y[check], ridge=0.5), "given": given}


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", length: str = "n_chars", label: str = "quality") -> dict | None:
    """The fitted views, or None without labels of both kinds."""
    order = F.md5(F.concat(F.lit("co:"), F.col(key).cast("string")))
    marked = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(F.col(label).cast("int")).alias("y"))
    # Ids alone are joined and sorted, never text. Only labels of ``docs`` are drawn.
    ids = docs.select(key).filter(F.col(key).isNotNull()).distinct()
    chosen = cut(marked.join(ids, key, "left_semi").orderBy(order, key).limit(SAMPLE))
    kinds = {r["y"] for r in chosen.select("y").distinct().collect()}
    if len(kinds) < 2:
        warnings.warn(f"{chosen.count()} labelled rows of the documents, not of both kinds: no classifier, every document is kept", stacklevel=2)
        return None

    def run(batches):
        for batch in batches:
            one, two = text_view(batch.column(1)), meta_view(*(batch.column(i) for i in (2, 3, 4)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(v), pa.list_(pa.float64())) for v in (one, two))], ["id", "one", "two"])

    kind = docs.schema[key].dataType.simpleString()
    read = docs.filter(F.col(key).isNotNull()).select(*(F.col(c) for c in (key, text, source, lang, length)))
    table = cut(read.mapInArrow(run, f"id {kind}, one array<double>, two array<double>"))
    known = table.join(F.broadcast(chosen.withColumnRenamed(key, "id")), "id").dropDuplicates(["id"]).toPandas()
    known = known.iloc[np.argsort(hashed(known.id.tolist(), 2**31), kind="stable")]
    free = cut(table.join(marked.select(F.col(key).alias("id")), "id", "left_anti").select("one", "two"))
    return co_train([np.array(known[c].tolist()) for c in ("one", "two")], known.y.to_numpy(float), free)


def score(docs: DataFrame, fitted: dict | None, text: str = "text", source: str = "source", lang: str = "lang", length: str = "n_chars") -> DataFrame:
    """``docs`` with ``text_score, meta_score, score, kept``."""
    docs = docs.drop("text_score", "meta_score", "score", "kept")

    def run(batches):
        for batch in batches:
            if fitted is None:
                found = [np.ones(len(batch))] * 3
            else:
                views = text_view(batch.column(text)), meta_view(*(batch.column(c) for c in (source, lang, length)))
                logits = np.stack([m.logit(v) for m, v in zip(fitted["views"], views)], axis=1)
                found = [*sigmoid(logits).T, sigmoid(np.clip(logits, -8, 8) @ fitted["rule"][:-1] + fitted["rule"][-1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found), pa.array(found[2] >= KEEP)], [*batch.schema.names, "text_score", "meta_score", "score", "kept"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "text_score double, meta_score double, score double, kept boolean"])
    return docs.mapInArrow(run, schema)


def classified(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """All rows of ``docs`` with their scores and verdict."""
    return score(docs, fit(docs, labels, **columns), **{k: v for k, v in columns.items() if k not in ("key", "label")})


def op1_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of both views, combined score and verdict of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classified(docs, labels).select("doc_id", "text_score", "meta_score", "score", "kept")
