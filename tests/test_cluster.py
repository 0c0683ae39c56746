import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from simlattice.operators.align import Aligned
from simlattice.operators.combine import combine_distances, combo_stats, source_combinations, threshold_range
from simlattice.operators.embed import distance_planes
from simlattice.operators import leader
from simlattice.operators.leader import leader_clusters, number_clusters
from simlattice.operators.medoid import medoids
from simlattice.operators.overlap import nested_pairs, overlap_detail, overlap_scores
from simlattice.operators.silhouette import best_clusters, cluster_counts, silhouette, sweep


def random_sources(spark, n, share, seed, backgrounds):
    """Distances of sparse random sources and their dense matrices."""
    rng = np.random.default_rng(seed)
    ids = list(range(100, 100 + n))
    rows, dense = [], {}
    for s, far in backgrounds.items():
        dense[s] = {}
        for a, b in itertools.combinations(ids, 2):
            d = far
            if rng.random() < share:
                d = float(np.round(rng.random(), 1 if seed % 2 else 6))
                rows.append((s, a, b, d))
            dense[s][a, b] = dense[s][b, a] = d
    stored = {s: sum(r[0] == s for r in rows) for s in backgrounds}
    aligned = Aligned(
        spark.createDataFrame(rows, "source string, id1 long, id2 long, distance double"),
        spark.createDataFrame([(i,) for i in ids], "id long"), n, list(backgrounds), dict(backgrounds), stored,
    )
    return ids, aligned, dense


def combined_dense(ids, dense, combo):
    out = {}
    for a, b in itertools.permutations(ids, 2):
        v = [dense[s][a, b] for s in combo]
        out[a, b] = round(v[0] if len(v) == 1 else math.sqrt(sum(x * x for x in v)), 8)
    return out


@pytest.mark.parametrize(
    "n, share, seed, far, hub_rows, local",
    [(18, 1.0, 0, 0.9, 10**6, 0), (22, 0.3, 1, 1.0, 7, 0), (20, 0.5, 2, 0.35, 10, 0), (16, 0.6, 3, 0.0, 10**6, 0), (18, 1.0, 0, 0.9, 10**6, 10**6), (20, 0.5, 2, 0.35, 10, 10**6), (20, 0.5, 5, 0.35, 10, 100)],
)
def test_clusters_scores_and_overlap_equal_the_sequential_rules(spark, monkeypatch, n, share, seed, far, hub_rows, local):
    monkeypatch.setattr(leader, "LOCAL_ROWS", local)  # by rounds of joins, in one task, or some combinations each way
    if hub_rows < 100:  # large clusters and hubs take their own way
        monkeypatch.setattr(number_clusters, "__defaults__", (42, 3))
        monkeypatch.setattr(medoids, "__defaults__", (*medoids.__defaults__[:-1], 3))
    ids, aligned, dense = random_sources(spark, n, share, seed, {"p": far, "q": 1.0})
    combined = combine_distances(aligned, source_combinations(["p", "q"], 1, 2), hub_rows=hub_rows)
    assert (combined.hubs is not None) == (hub_rows < 100)
    ranges = threshold_range(combined, 6)
    matrices = {c: combined_dense(ids, dense, s) for c, s in combined.combos.items()}
    for c, m in matrices.items():
        upper = np.array([m[a, b] for a, b in itertools.combinations(ids, 2)])
        low, high = max(upper.mean() - 3 * upper.std(), upper.min()), min(upper.mean() + 3 * upper.std(), upper.max())
        assert ranges[c] == pytest.approx(list(np.linspace(low, high, 6)), abs=1e-7)

    clusters = leader_clusters(combined, ranges)
    found = {}
    for r in clusters.collect():
        found.setdefault((r["combo"], r["step"]), {})[r["id"]] = r["leader"]
    expected = {(c, i): brute.leaders(ids, matrices[c], t) for c, ts in ranges.items() for i, t in enumerate(ts)}
    assert found == expected

    labels = {(r["combo"], r["step"], r["leader"]): r["label"] for r in number_clusters(clusters).collect()}
    for (c, step), taken in expected.items():
        opened = [i for i in brute.order(ids) if taken[i] == i]
        assert [labels[c, step, i] for i in opened] == list(range(1, len(opened) + 1))

    scores = {(r["combo"], r["step"]): r["silhouette"] for r in silhouette(combined, clusters).collect()}
    wanted = {k: brute.silhouette(ids, matrices[k[0]], v) for k, v in expected.items() if len(set(v.values())) > 1}
    assert scores.keys() == wanted.keys()
    for k, v in wanted.items():
        assert scores[k] == pytest.approx(v, abs=1e-9), k

    chosen = {c: min((i for i in range(6) if (c, i) in wanted), key=lambda i: (-round(wanted[c, i], 10), i)) for c in matrices}
    best, members = best_clusters(sweep(silhouette(combined, clusters), ranges), clusters, list(combined.combos))
    assert {r["combo"]: r["step"] for r in best.collect()} == chosen
    sizes = {(r["combo"], r["step"]): r["n_clusters"] for r in cluster_counts(clusters).collect()}
    assert sizes == {k: len(set(v.values())) for k, v in expected.items()}

    for r in medoids(combined, members).collect():
        taken = expected[r["combo"], chosen[r["combo"]]]
        group = [i for i in ids if taken[i] == r["leader"]]
        assert (r["medoid"], r["size"]) == (brute.medoid(group, matrices[r["combo"]]), len(group))

    pairs = nested_pairs(combined.combos)
    got = {(r["base"], r["other"]): (r["overlap"], r["filtered_overlap"]) for r in overlap_scores(overlap_detail(combined, members, pairs)).collect()}
    assert got.keys() == set(pairs)
    for a, b in pairs:
        want = brute.overlap(ids, matrices[a], expected[a, chosen[a]], expected[b, chosen[b]])
        assert got[a, b] == pytest.approx(want), (a, b)


@pytest.mark.parametrize("local", [0, 10**6])
def test_a_hundred_thresholds(spark, monkeypatch, local):
    monkeypatch.setattr(leader, "LOCAL_ROWS", local)
    ids, aligned, dense = random_sources(spark, 14, 0.6, 4, {"p": 0.8})
    combined = combine_distances(aligned, {"p": ("p",)})
    ranges = threshold_range(combined, 100)
    found = {}
    clusters = leader_clusters(combined, ranges).cache()
    for r in clusters.collect():
        found.setdefault(r["step"], {})[r["id"]] = r["leader"]
    m = combined_dense(ids, dense, ("p",))
    expected = {i: brute.leaders(ids, m, t) for i, t in enumerate(ranges["p"])}
    assert len(found) == 100 and found == expected
    scores = {r["step"]: r["silhouette"] for r in silhouette(combined, clusters).collect()}
    assert scores == pytest.approx({i: brute.silhouette(ids, m, v) for i, v in expected.items() if len(set(v.values())) > 1}, abs=1e-9)


def test_one_cluster_only_keeps_the_defaults(spark):
    ids, aligned, _ = random_sources(spark, 5, 0.0, 5, {"p": 0.5})
    combined = combine_distances(aligned, {"p": ("p",)})
    ranges = threshold_range(combined, 3)
    clusters = leader_clusters(combined, ranges)
    assert clusters.select("step", "leader").distinct().count() == 3
    best, members = best_clusters(sweep(silhouette(combined, clusters), ranges), clusters, ["p"])
    row = best.first()
    assert (row["t1"], row["silhouette"], row["n_clusters"], row["single_point_ratio"]) == (0.0, -1.0, 1, 0.0)
    assert members.count() == 0


def test_singletons_can_score_zero(spark):
    ids, aligned, dense = random_sources(spark, 6, 1.0, 0, {"p": 1.0})
    combined = combine_distances(aligned, {"p": ("p",)})
    alone = spark.createDataFrame([("p", 0, i, i) for i in ids], "combo string, step int, id long, leader long")
    assert silhouette(combined, alone).first()["silhouette"] == pytest.approx(1.0)
    assert silhouette(combined, alone, singleton="zero").first()["silhouette"] == 0.0
    with pytest.raises(ValueError):
        silhouette(combined, alone, singleton="two")


def test_combination_checks_and_stats(spark):
    ids, aligned, dense = random_sources(spark, 8, 0.5, 7, {"p": 1.0, "q": 0.8, "r": 0.9, "s": 1.0})
    with pytest.raises(ValueError):
        combine_distances(aligned, {"x": ("x",)})
    combos = source_combinations(aligned.sources, 4, 4)
    stats = combo_stats(combine_distances(aligned, combos)).first()
    m = combined_dense(ids, dense, combos["p_q_r_s"])
    upper = [m[a, b] for a, b in itertools.combinations(ids, 2)]
    assert (stats["min_distance"], stats["mean_distance"], stats["max_distance"]) == pytest.approx((min(upper), np.mean(upper), max(upper)))


@pytest.mark.parametrize("n,widest", [(3, 96), (12, 96), (40, 24)])
def test_distance_planes_equal_the_singular_vectors(spark, monkeypatch, n, widest):
    monkeypatch.setattr("simlattice.operators.embed.WIDEST", widest)
    monkeypatch.setattr("simlattice.operators.embed.KEPT", 12)
    ids, aligned, dense = random_sources(spark, n, 0.7, 9, {"p": 1.0, "q": 0.6})
    combos = {"p": ("p",), "q": ("q",)}
    combined = combine_distances(aligned, combos, digits=None)
    labels = spark.createDataFrame([(c, i, ids[k % 3]) for c in combos for k, i in enumerate(ids)], "combo string, id long, leader long")
    rows = distance_planes(combined, labels).collect()
    assert len(rows) == 2 * n and sum(r["is_medoid"] for r in rows) == 6
    for c in combos:
        m = np.array([[0.0 if a == b else dense[c][a, b] for b in ids] for a in ids])
        _, sizes, axes = np.linalg.svd(m - m.mean(axis=0))
        got = {r["id"]: (r["x"], r["y"]) for r in rows if r["combo"] == c}
        gaps = -np.diff(sizes) / sizes[0]
        for k in range(2):
            if gaps[: k + 1].min() < 1e-6:  # axes of equal size may be turned
                continue
            x, y = np.array([got[i][k] for i in ids]), m @ axes[k]
            assert min(np.abs(x - y).max(), np.abs(x + y).max()) < 1e-6
