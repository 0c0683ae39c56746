"""Rows that are written or moved by the steps several queries share."""

import itertools
import math

import brute
import pytest
from simlattice import sinks
from simlattice.operators import blocks, compare, leader, medoid, neighbors, overlap, silhouette
from simlattice.operators.align import Aligned
from simlattice.operators.combine import combine_distances, source_combinations, threshold_range

VALUES = {"p": 1.0, "q": 0.0, "r": 0.5}


def some_sources(spark, value="distance", n=12):
    """Three sources over ``n`` entities, each with another part of the pairs."""
    rows = [
        (s, a, b, ((a * 7 + b * 3 + k) % 9 + 1) / 10)
        for a, b in itertools.combinations(range(1, n + 1), 2) for k, s in enumerate(VALUES) if (a + b + k) % 4
    ]
    stored = {s: sum(r[0] == s for r in rows) for s in VALUES}
    far = VALUES if value == "distance" else dict.fromkeys(VALUES, 0.0)
    pairs = spark.createDataFrame(rows, f"source string, id1 long, id2 long, {value} double")
    return Aligned(pairs, spark.createDataFrame([(i,) for i in range(1, n + 1)], "id long"), n, list(VALUES), dict(far), stored)


def test_a_pair_is_written_once_for_all_combinations(spark):
    aligned = some_sources(spark)
    combined = combine_distances(aligned, source_combinations(aligned.sources, 1, 3))
    written = spark.read.parquet(*combined.vectors.inputFiles()).count()
    assert written == aligned.pairs.select("id1", "id2").distinct().count() < combined.vectors.count()


def test_combinations_are_saved_one_by_one(spark, tmp_path):
    """No sort of all rows of all combinations; folders of an earlier call are gone."""
    aligned = some_sources(spark)
    combined = combine_distances(aligned, source_combinations(aligned.sources, 1, 3))
    for combo in combined.combos:
        rows = combined.vectors_of(combo)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan and "Exchange" not in plan
        assert sorted(map(tuple, rows.collect())) == sorted(tuple(r)[1:] for r in combined.vectors.filter(f"combo = '{combo}'").collect())
    for used in (combined, combine_distances(aligned, source_combinations(aligned.sources, 1, 1))):
        sinks.save_distances(used, str(tmp_path / "d"))
        saved = spark.read.parquet(str(tmp_path / "d")).select(*used.vectors.columns)
        assert sorted(map(tuple, saved.collect())) == sorted(map(tuple, used.vectors.collect()))
        assert {p.name for p in (tmp_path / "d").iterdir() if p.is_dir()} == {f"combo={c}" for c in used.combos}


def test_a_round_of_clustering_moves_a_pair_once(spark, monkeypatch):
    aligned = some_sources(spark)
    combined = combine_distances(aligned, source_combinations(aligned.sources, 1, 3))
    moved = []

    def looked_up(rows, table, keys, hot):
        moved.append(rows.count())
        return plain(rows, table, keys, hot)

    plain = leader.lookup
    monkeypatch.setattr(leader, "LOCAL_ROWS", 0)
    monkeypatch.setattr(leader, "lookup", looked_up)
    assert leader.leader_clusters(combined, threshold_range(combined, 4)).count() == 7 * 4 * 12
    assert moved and max(moved) <= aligned.pairs.select("id1", "id2").distinct().count()


def test_ranks_are_joined_to_the_row_of_both_values(spark, monkeypatch):
    aligned = some_sources(spark, "similarity")
    rows = compare._nonzero_rows(aligned).count()
    ranked = []

    def joined(values, ranks):
        ranked.append(values.count())
        return plain(values, ranks)

    plain = compare.join_ranks
    monkeypatch.setattr(compare, "join_ranks", joined)
    found = compare._sparse_ranks(aligned).collect()
    assert ranked == [rows, rows] and len(found) == rows
    values = {(r["source1"], r["source2"], r["id1"], r["id2"]): (r["a"], r["b"]) for r in compare._nonzero_rows(aligned).collect()}
    for r in found:
        for side in (0, 1):
            same = [v[side] for k, v in values.items() if k[:2] == (r["source1"], r["source2"])]
            mine = values[r["source1"], r["source2"], r["id1"], r["id2"]][side]
            assert r["ab"[side]] == sum(v < mine for v in same) + (same.count(mine) + 1) / 2


def test_only_entities_that_lack_neighbours_are_filled(spark):
    aligned = some_sources(spark, "similarity")
    near = neighbors.nearest_pairs(aligned.pairs, aligned.ids, 9)
    assert "LeftSemi" in near._jdf.queryExecution().optimizedPlan().toString()
    held = {}
    for r in aligned.pairs.collect():
        for a, b in ((r["id1"], r["id2"]), (r["id2"], r["id1"])):
            held[r["source"], a, b] = r["similarity"]
    found = {(r["source"], r["id"], r["rank"]): r["nbr"] for r in near.collect()}
    for s, i in itertools.product(aligned.sources, range(1, 13)):
        order = sorted((j for j in range(1, 13) if j != i), key=lambda j: (-held.get((s, i, j), 0.0), j))
        assert [found[s, i, k] for k in range(1, 10)] == order[:9]


def lengths(aligned, combo):
    """All lengths of a combination, both ways, from the sources' rows."""
    held = {(r["source"], r["id1"], r["id2"]): r["distance"] for r in aligned.pairs.collect()}
    out = {}
    for a, b in itertools.combinations(range(1, aligned.n + 1), 2):
        out[a, b] = out[b, a] = round(math.sqrt(sum(held.get((s, a, b), VALUES[s]) ** 2 for s in combo)), 8)
    return out


@pytest.mark.parametrize("hub_rows", [10**6, 10])
def test_labels_of_an_entity_are_moved_once_per_block(spark, monkeypatch, hub_rows):
    aligned = some_sources(spark, n=16)
    combined = combine_distances(aligned, source_combinations(aligned.sources, 1, 3), hub_rows=hub_rows)
    clusters = leader.leader_clusters(combined, threshold_range(combined, 4)).cache()
    moved = []

    def counted(combined, split, labels, parts, *rest):
        moved.append((split.members.select("block").distinct().count(), split.ends.join(labels, "id").count(), len(parts)))
        return plain(combined, split, labels, parts, *rest)

    plain = silhouette.over_blocks
    monkeypatch.setattr(silhouette, "over_blocks", counted)
    for limit, value in (("LOW_ROWS", 40), ("HIGH_ROWS", 60), ("PART_LABELS", 9)):
        monkeypatch.setattr(blocks, limit, value)
    scores = {(r["combo"], r["step"]): r["silhouette"] for r in silhouette.silhouette(combined, clusters).collect()}
    ((n, rows, parts),) = moved
    assert parts == math.ceil(len(scores) / 9) > 1 and rows <= n * parts * 16 < 2 * combined.vectors.count()
    taken = {}
    for r in clusters.collect():
        taken.setdefault((r["combo"], r["step"]), {})[r["id"]] = r["leader"]
    wanted = {k: v for k, v in taken.items() if len(set(v.values())) > 1}
    assert scores.keys() == wanted.keys()
    if hub_rows > 100:
        assert n > 1
    for (c, step), v in wanted.items():
        assert scores[c, step] == pytest.approx(brute.silhouette(list(range(1, 17)), lengths(aligned, combined.combos[c]), v), abs=1e-9)


@pytest.mark.parametrize("hub_rows", [10**6, 10])
def test_medoids_and_overlap_move_a_pair_once_for_all_combinations(spark, monkeypatch, hub_rows):
    aligned = some_sources(spark, n=16)
    combined = combine_distances(aligned, source_combinations(aligned.sources, 1, 2), hub_rows=hub_rows)
    ranges = threshold_range(combined, 4)
    labels = leader.leader_clusters(combined, ranges).filter("step = 1").select("combo", "id", "leader").cache()
    moved, parted = [], []

    def once(pairs, *columns):
        moved.append(pairs.count())
        return mirror(pairs, *columns)

    def counted(combined, split, packed, parts, *rest):
        parted.append((split.members.select("block").distinct().count(), split.ends.join(packed, "id").count(), len(parts)))
        return plain(combined, split, packed, parts, *rest)

    mirror, plain = overlap.mirrored, medoid.over_blocks
    monkeypatch.setattr(overlap, "mirrored", once)
    monkeypatch.setattr(medoid, "over_blocks", counted)
    for limit, value in (("LOW_ROWS", 40), ("HIGH_ROWS", 60), ("PART_LABELS", 4)):
        monkeypatch.setattr(blocks, limit, value)
    pairs = overlap.nested_pairs(combined.combos)
    got = {(r["base"], r["other"]): r["overlap"] for r in overlap.overlap_scores(overlap.overlap_detail(combined, labels, pairs)).collect()}
    found = {(r["combo"], r["leader"]): (r["medoid"], r["size"]) for r in medoid.medoids(combined, labels).collect()}
    assert moved == [combined.wide.count()] and len(parted) == 2
    assert all(parts > 1 and rows <= n * parts * 16 for n, rows, parts in parted)
    ids, taken = list(range(1, 17)), {c: {} for c in combined.combos}
    for r in labels.collect():
        taken[r["combo"]][r["id"]] = r["leader"]
    d = {c: lengths(aligned, s) for c, s in combined.combos.items()}
    for c, t in taken.items():
        for leads in set(t.values()):
            group = [i for i in ids if t[i] == leads]
            assert found[c, leads] == (brute.medoid(group, d[c]), len(group))
    for a, b in pairs:
        assert got[a, b] == pytest.approx(brute.overlap(ids, d[a], taken[a], taken[b])[0]), (a, b)
