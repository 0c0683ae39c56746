"""Whitening, the pivot index and hard negatives against brute force and on odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from simlattice.llm import ann, negatives, pivots, whiten

SF = "/root/testdata/sf0.001"
ROWS = "vec_id long, embedding array<float>, label int, id int, v string, uid long, m long, ball int, n long"


def table(spark, vectors, labels=None, ids=None, schema=ROWS):
    labels = [i % 3 for i in range(len(vectors))] if labels is None else labels
    ids = range(len(vectors)) if ids is None else ids
    extra = (7, "x", 8, 9, 10, 11) if schema == ROWS else ()
    return spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], c, *extra) for i, e, c in zip(ids, vectors, labels)], schema)


def odd_vectors(rng, n=40, dim=6):
    """Plain vectors, then null, empty, short, zero, null, NaN and infinite entries, and two repeated rows."""
    plain = rng.standard_normal((n, dim)).astype(np.float32).tolist()
    return [*plain, None, [], [1.0, 2.0], [0.0] * dim, [None] + [1.0] * (dim - 1), [math.nan] + [1.0] * (dim - 1), [math.inf] + [1.0] * (dim - 1), plain[3], plain[3]]


# Whitening


@pytest.mark.parametrize("spectrum", [
    np.arange(1, 41.0), np.ones(40), np.zeros(40), np.r_[1e6, np.ones(20) + 1e-9 * np.arange(20), np.zeros(19)],
    1 + 1.01e-5 * np.arange(40), 1 + 0.99e-5 * np.arange(40), 10.0 ** -np.arange(40), np.r_[np.ones(20), np.full(20, 1 + 1e-6)],
])
def test_refined_eigenvectors_reach_double_precision(spectrum):
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((40, 40)))[0]
    a = (q * spectrum) @ q.T
    values, vectors = whiten.refined_eigen((a + a.T) / 2)
    size = max(spectrum.max(), 1e-300)
    assert np.abs(values - np.sort(spectrum)[::-1]).max() <= 1e-13 * size
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * size
    assert np.abs(vectors.T @ vectors - np.eye(40)).max() <= 1e-13


def test_refinement_corrects_float32():
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((30, 30)))[0]
    a = (q * np.arange(1, 31.0)) @ q.T
    a = (a + a.T) / 2
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    before = np.abs(a @ x - x * np.einsum("ij,ij->j", x, a @ x)).max()
    values, vectors = whiten.refined_eigen(a)
    assert np.abs(a @ vectors - vectors * values).max() < 1e-6 * before


def brute_whitening(vectors, top=32):
    x = np.floor(64 * np.asarray(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    d = n * x - total
    centred = d / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:top], vectors[:, ::-1][:, :top]
    return n, (d * d).sum(axis=1), centred @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def test_whitening_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    local = sorted((r["vec_id"], r["embedding"]) for r in rows.collect())
    n, deviation, white, explained = brute_whitening([e for _, e in local])
    got = whiten.whitened(rows.repartition(5)).toPandas()
    assert len(got) == n * 32 and set(got["n"]) == {n} and got["identity_error"].max() < 1e-8
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in local]].to_numpy()
    assert np.abs(np.abs(wide) - np.abs(white)).max() < 1e-6
    assert (got[got.component == 1].set_index("vec_id").loc[[i for i, _ in local]]["deviation"].to_numpy() == deviation).all()
    assert np.allclose(got[got.vec_id == local[0][0]].sort_values("component")["explained"], explained, rtol=1e-8)


def test_whitening_of_odd_rows(spark):
    vectors = odd_vectors(np.random.default_rng(3))
    used = [i for i, e in enumerate(vectors) if e and len(e) == 6 and all(x is not None and math.isfinite(x) for x in e)]
    n, deviation, white, _ = brute_whitening([vectors[i] for i in used])
    got = whiten.whitened(table(spark, vectors)).toPandas()
    assert sorted(set(got["vec_id"])) == used and set(got["n"]) == {n} and set(got["component"]) == set(range(1, 7))
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[used].to_numpy()
    assert np.abs(np.abs(wide) - np.abs(white)).max() < 1e-8
    assert (got[got.component == 1].set_index("vec_id").loc[used]["deviation"].to_numpy() == deviation).all()


def test_whitening_without_variance_and_beyond_long(spark):
    flat = whiten.whitened(table(spark, [[1.0, 2.0], [1.0, 2.0], None], ids=[None, 4, 5])).collect()
    assert len(flat) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in flat)
    line = whiten.whitened(table(spark, [[1.0, 2.0], [3.0, 2.0], [8.0, 2.0]])).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True)} and line[0]["identity_error"] < 1e-9
    wide = whiten.whitened(table(spark, [[1e10, 1.0], [-1e10, 2.0], [1e30, 1.0]])).collect()
    assert {r["vec_id"] for r in wide} == {0, 1} and all(r["deviation"] is None for r in wide)
    assert whiten.whitened(table(spark, [])).collect() == [] and whiten.whitened(table(spark, [None])).collect() == []


# Pivot index


def brute_links(ids, vectors, cosine):
    """``id -> (links, smallest id reachable)`` over the vectors of most frequent length."""
    ok = [i for i, e in enumerate(vectors) if e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    dim = max({len(vectors[i]) for i in ok}, key=lambda d: sum(len(vectors[i]) == d for i in ok), default=0)
    ok = [i for i in ok if len(vectors[i]) == dim]
    near = np.zeros((len(vectors), len(vectors)), bool)
    if ok:
        u = np.array([vectors[i] for i in ok], np.float64)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        near[np.ix_(ok, ok)] = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    low = pivots.forest(*np.nonzero(near), len(vectors))
    groups = {}
    for i, g in enumerate(low.tolist()):
        groups.setdefault(g, []).append(ids[i])
    return [(ids[i], int(near[i].sum()), min(groups[g])) for i, g in enumerate(low.tolist())]


def planted(rng, dim=48):
    """Single vectors, pairs over all cosines from 0.85 to 1, a wide dense group, a tight one with a rim, equal copies."""
    def spread(base, cosines):
        noise = rng.standard_normal((len(cosines), dim))
        noise -= np.outer(noise @ base, base)
        noise /= np.linalg.norm(noise, axis=1, keepdims=True)
        return np.outer(cosines, base) + noise * np.sqrt(1 - np.asarray(cosines) ** 2)[:, None]

    def single():
        v = rng.standard_normal(dim)
        return v / np.linalg.norm(v)

    out = [single() for _ in range(500)]
    for c in np.linspace(0.85, 0.999, 150):
        out.append(single())
        out.extend(spread(out[-1], [c]))
    out.extend(spread(single(), np.full(120, 0.95)))
    middle = single()
    out.extend(spread(middle, rng.uniform(0.985, 1, 200)))
    out.extend(spread(middle, rng.uniform(0.88, 0.96, 40)))
    out.extend([out[0]] * 30 + [middle] * 5)
    return [np.asarray(v * rng.uniform(0.5, 2), np.float32).tolist() for v in out]


@pytest.mark.parametrize("block", [60, pivots.BLOCK])
def test_pivot_index_recall(spark, block):
    vectors = planted(np.random.default_rng(4))
    rows = table(spark, vectors, schema="vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in pivots.near_duplicates(rows, block=block).collect()}
    expected = {i: (n, c) for i, n, c in brute_links(range(len(vectors)), vectors, 0.9)}
    links = sum(n for n, _ in expected.values())
    assert all(got[i]["n_links"] <= n for i, (n, _) in expected.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * links
    assert sum(got[i]["component_id"] == c for i, (_, c) in expected.items()) >= 0.97 * len(expected)
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    # Groups and near copies are found whole; only single pairs near the limit may be missed.
    assert all(got[i]["n_links"] == n for i, (n, _) in expected.items() if i >= 800)
    assert all(got[i]["n_links"] == n for i, (n, _) in expected.items() if 750 <= i < 800)


def test_balls_count_without_pairs(spark, monkeypatch):
    """A tight hot group is linked through its ball: no pair of it is looked at."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal(32)
    vectors = [(base + 0.05 * rng.standard_normal(32)).tolist() for _ in range(400)] + rng.standard_normal((200, 32)).tolist()
    classes = table(spark, vectors).select(F.col("vec_id").alias("uid"), F.lit(1).cast("long").alias("m"), F.col("embedding").alias("v"))
    described, report, balls = pivots.links(classes, 32, 0.9)
    assert described.filter("ball >= 0 and uid < 400").select("ball").distinct().count() == 1
    assert max(r["every"] for r in balls.collect()) == 400
    assert report.filter("uid < 400").count() == 0


def test_pivot_index_of_odd_rows(spark):
    vectors = odd_vectors(np.random.default_rng(6))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in pivots.near_duplicates(table(spark, vectors)).collect())
    assert got == [(i, n, c, i == c) for i, n, c in brute_links(range(len(vectors)), vectors, 0.9)]
    names = [f"k{i:03}" for i in range(len(vectors))]
    text = pivots.near_duplicates(table(spark, vectors, ids=names, schema="vec_id string, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in text) == sorted(brute_links(names, vectors, 0.9))


def test_pivot_index_repeated_and_null_ids(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1e200, 1e199, 0.0]
    rows = table(spark, [a, a, b, c, None], ids=[5, None, 5, 9, 2], schema="vec_id long, embedding array<double>, label int")
    got = sorted(((r["vec_id"] is None, r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in pivots.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(False, 5, 2, 5, True), (True, None, 2, 5, False), (False, 5, 0, 5, True), (False, 9, 2, 5, False), (False, 2, 0, 2, True)], key=str)
    assert pivots.near_duplicates(table(spark, [])).collect() == []


# Hard negatives


def brute_negatives(ids, vectors, labels, anchor):
    y = {i: [math.floor(256 * x) for x in e] for i, e in zip(ids, vectors)}
    label = dict(zip(ids, labels))
    out = []
    for a in filter(anchor, ids):
        score = {i: sum(p * q for p, q in zip(y[a], y[i])) for i in ids if i != a}
        first = sorted((-score[i], i) for i in score if label[i] == label[a])[:5]
        for s, p in ((-s, p) for s, p in first):
            window = sorted((-score[i], i) for i in score if label[i] != label[a] and 50 * s <= 100 * score[i] <= 95 * s)[:3]
            out.extend((a, p, r, i, s, -t) for r, (t, i) in enumerate(window, 1))
    return sorted(out)


@pytest.mark.parametrize("block, sample", [(7, 3), (64, 20), (8192, 2048)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, sample):
    """Small blocks and samples lead through all thresholds; equal vectors tie."""
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "CHUNK", 4 if block == 7 else 4096)
    monkeypatch.setattr(negatives, "SAMPLE", sample)
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((6, 10))
    vectors = [(centres[i % 6] + 0.4 * rng.standard_normal(10)).astype(np.float32).tolist() for i in range(150)]
    vectors[20:26] = [vectors[20]] * 6
    labels = [int(c) for c in rng.integers(0, 4, 150)]
    labels[149] = 99
    ids = [int(i) for i in rng.permutation(400)[:150]]
    rows = table(spark, vectors, labels, ids).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    got = sorted(tuple(r) for r in negatives.hard_negatives(rows, F.col("id") % 4 == 0).collect())
    assert got == brute_negatives(ids, vectors, labels, lambda i: i % 4 == 0)


def test_threshold_join_is_exact_and_prunes():
    rng = np.random.default_rng(8)
    x = np.floor(256 * rng.standard_normal((300, 64)) / 8).astype(np.int64)
    x = x[:, np.argsort((x**2).sum(axis=0))]
    q = x[:40] + rng.integers(-3, 4, (40, 64))
    full = x @ q.T
    for least in (np.full(40, 30_000), np.full(40, 10_000), np.zeros(40, int), np.full(40, negatives.LEAST), np.linspace(-5e4, 5e4, 40).astype(int)):
        i, j, score = negatives.at_least(x, q, least)
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*(c.tolist() for c in np.nonzero(full >= least))))
        assert (score == full[i, j]).all()


def test_threshold_join_beyond_double_precision():
    x = np.array([[2**30, 1], [2**30, 0], [2**30, -1]])
    i, j, score = negatives.at_least(x, np.array([[2**30, 1]]), np.array([2**60]))
    assert i.tolist() == [0, 1] and j.tolist() == [0, 0] and score.tolist() == [2**60 + 1, 2**60]


def test_negatives_of_odd_rows(spark):
    vectors = odd_vectors(np.random.default_rng(9))
    labels = [None if i == 5 else i % 2 for i in range(len(vectors))]
    names = list(range(len(vectors) - 1)) + [3]
    rows = table(spark, [*vectors, [1e30] * 6], [*labels, 0], [*names, 60]).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    ok = [i for i, e in enumerate(vectors[:-1]) if e and len(e) == 6 and labels[i] is not None and all(x is not None and math.isfinite(x) for x in e)]
    expected = brute_negatives(ok, [vectors[i] for i in ok], [0 if i == 3 else labels[i] for i in ok], lambda i: i % 3 == 0)
    assert sorted(tuple(r) for r in negatives.hard_negatives(rows, F.col("id") % 3 == 0).collect()) == expected
    text = rows.select(F.format_string("k%03d", "id").alias("id"), "v", F.col("label").cast("string").alias("label"))
    got = sorted(tuple(r) for r in negatives.hard_negatives(text, F.substring("id", 2, 3).cast("int") % 3 == 0).collect())
    assert got == [(f"k{a:03}", f"k{p:03}", r, f"k{i:03}", s, t) for a, p, r, i, s, t in expected]
    assert negatives.hard_negatives(rows.limit(0), F.col("id") % 3 == 0).collect() == []
    assert negatives.hard_negatives(rows, F.lit(False)).collect() == []


def test_nearest_of_very_large_and_small_components(spark):
    vectors = [[1e200, 2e200], [3e200, 1e200], [1e-200, 2e-200], [1.0, -1.0]]
    rows = table(spark, vectors, schema="vec_id long, embedding array<double>, label int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.nearest(rows, F.col("id") < 2, probe=1.0).collect())
    half, cross, far = round(5 / math.sqrt(50), 9), round(-1 / math.sqrt(10), 9), round(2 / math.sqrt(20), 9)
    assert got == [(0, 1, 2, 1.0), (0, 2, 1, half), (0, 3, 3, cross), (1, 1, 0, half), (1, 2, 2, half), (1, 3, 3, far)]
