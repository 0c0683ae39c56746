import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from simlattice import runtime
from simlattice.operators import compare, distribution, permute
from simlattice.operators.align import Aligned, align, align_report, align_to_anchor, sample_ids, shared_entities
from simlattice.operators.matrix import Matrices, build_matrices, mirrored, symmetrize, upper_aligned
from simlattice.operators.normalize import normalize, positive_range, stage_stats, to_distance, value_stats, with_background


def rows(spark, data):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(data)], "source string, id1 string, id2 string, similarity double, seq int")


def cells(df):
    return {(r["source"], r["id1"], r["id2"]): r["similarity"] for r in df.collect()}


def test_build_matrices_last_row_wins(spark):
    data = build_matrices(rows(spark, [
        ("s", "b", "a", 0.1), ("s", "a", "b", 0.2), ("s", "c", "a", math.nan), ("s", "d", "d", 1.0), ("s", "b", "c", math.inf), ("s", "e", "a", None),
    ]))
    assert cells(data.pairs) == {("s", "a", "b"): 0.2, ("s", "d", "d"): 1.0, ("s", "b", "c"): 0.0}
    assert sorted(r["id"] for r in data.ids.collect()) == list("abcde")


def test_symmetrize_and_mirror(spark):
    df = spark.createDataFrame([("s", "a", "b", 1.0), ("s", "b", "a", 0.5), ("s", "c", "a", 1.0), ("s", "c", "c", 2.0)], "source string, id1 string, id2 string, similarity double")
    half = symmetrize(df)
    assert cells(half) == {("s", "a", "b"): 0.75, ("s", "a", "c"): 0.5, ("s", "c", "c"): 2.0}
    assert mirrored(half.filter("id1 < id2"), "similarity").count() == 4


def two_sources(spark, n=30, seed=0, share=0.6, stored_zero=False):
    rng = np.random.default_rng(seed)
    ids = [f"e{i:02d}" for i in range(n)]
    dense, data = {}, []
    for s in ("p", "q", "r"):
        dense[s] = {}
        for a, b in itertools.combinations(ids, 2):
            v = float(np.round(rng.gamma(2.0), 1)) if rng.random() < share else 0.0
            dense[s][a, b] = v
            if v or stored_zero:
                data.append((s, a, b, v))
        data.append((s, ids[0], ids[0], 1.0))
    pairs = spark.createDataFrame(data, "source string, id1 string, id2 string, similarity double")
    universe = spark.createDataFrame([(s, i) for s in ("p", "q", "r") for i in ids], "source string, id string")
    return ids, dense, Matrices(pairs, universe)


def upper(dense, ids, s):
    return np.array([dense[s][a, b] for a, b in itertools.combinations(ids, 2)])


def scaled(x, use_log=False, times=1.5, mapping=None):
    q1, q3 = np.percentile(x, [10, 90])
    x = np.clip(x, q1 - times * (q3 - q1), q3 + times * (q3 - q1))
    x = np.log(x + 1e-6) if use_log else x
    x = mapping(x) if mapping else x
    z = (x - x.mean()) / (x.std() + 1e-6)
    return (z - z.min()) / (z.max() - z.min() + 1e-6)


@pytest.mark.parametrize("stored_zero", [False, True])
def test_normalize_counts_absent_pairs(spark, stored_zero):
    ids, dense, data = two_sources(spark, stored_zero=stored_zero)
    aligned = align(data, ["p", "q", "r"])
    for options, shape in (({}, {}), ({"use_log": True, "iqr_multiplier": 0.5, "mapping": lambda x: x * x}, {"use_log": True, "times": 0.5, "mapping": lambda x: x * x})):
        done, stats = normalize(aligned, **options)
        got = cells(done.pairs)
        for s in ("p", "q", "r"):
            expected = scaled(upper(dense, ids, s), **shape)
            for (a, b), v in zip(itertools.combinations(ids, 2), expected):
                assert got.get((s, a, b), done.background[s]) == pytest.approx(v, abs=1e-9)
        assert stats.count() == 3
    distances = to_distance(normalize(aligned)[0])
    for r in positive_range(distances).collect():
        d = 1 - scaled(upper(dense, ids, r["source"]))
        d = d[d > 0]
        assert (r["min_value"], r["max_value"], r["mean_value"]) == pytest.approx((d.min(), d.max(), d.mean()))
    for r in value_stats(aligned).collect():
        x = upper(dense, ids, r["source"])
        got = r["min_value"], r["max_value"], r["mean_value"], r["std_value"], r["median_value"]
        assert got == pytest.approx((x.min(), x.max(), x.mean(), x.std(), np.median(x)))


@pytest.mark.parametrize("use_log", [False, True])
def test_statistics_of_every_stage(spark, use_log):
    ids, dense, data = two_sources(spark, stored_zero=False)
    got = {(r["source"], r["stage"]): r for r in stage_stats(align(data, ["p", "q", "r"]), use_log=use_log, iqr_multiplier=0.2).collect()}
    for s in ("p", "q", "r"):
        x = upper(dense, ids, s)
        q1, q3 = np.percentile(x, [10, 90])
        low, high = q1 - 0.2 * (q3 - q1), q3 + 0.2 * (q3 - q1)
        stages = {"before": x, "clip": np.clip(x, low, high)}
        if use_log:
            stages["log"] = np.log(stages["clip"] + 1e-6)
        y = stages["log" if use_log else "clip"]
        stages["zscore"] = (y - y.mean()) / (y.std() + 1e-6)
        stages["minmax"] = scaled(x, use_log=use_log, times=0.2)
        assert {stage for source, stage in got if source == s} == set(stages)
        for stage, x_at in stages.items():
            r = got[s, stage]
            assert (r["min_value"], r["max_value"], r["mean_value"], r["std_value"], r["median_value"]) == pytest.approx((x_at.min(), x_at.max(), x_at.mean(), x_at.std(), np.median(x_at)), abs=1e-9)
            assert r["crop_ratio"] == (pytest.approx(np.mean((x < low) | (x > high))) if stage == "clip" else None)
            at = np.minimum(np.floor(np.round((x_at - x_at.min()) / (x_at.max() - x_at.min()) * 10, 9)), 9).astype(int)
            assert [b["frequency"] for b in r["histogram"]] == list(np.bincount(at, minlength=10))
            edges = np.linspace(x_at.min(), x_at.max(), 11)
            assert [b["low"] for b in r["histogram"]] == pytest.approx(list(edges[:-1]), abs=1e-9) and r["histogram"][-1]["high"] == pytest.approx(edges[-1])


def test_positive_range_of_nothing_is_null(spark):
    aligned = Aligned(spark.createDataFrame([("s", "a", "b", 0.0)], "source string, id1 string, id2 string, distance double"), None, 2, ["s"], {"s": 0.0}, {"s": 1})
    assert tuple(positive_range(aligned).first()) == ("s", None, None, None)


def test_alignment(spark):
    data = build_matrices(rows(spark, [("p", "a", "b", 1.0), ("p", "b", "c", 2.0), ("q", "a", "c", 3.0), ("q", "b", "d", 4.0), ("r", "a", "b", 5.0), ("r", "c", "z", 6.0)]))
    both = align(data, ["p", "q"])
    assert both.n == 3 and cells(both.pairs) == {("p", "a", "b"): 1.0, ("p", "b", "c"): 2.0, ("q", "a", "c"): 3.0}
    anchored = align_to_anchor(data, ["p", "q", "r"], "r")
    assert sorted(r["id"] for r in anchored.ids.collect()) == ["a", "b", "c", "z"]
    assert cells(anchored.pairs)["r", "c", "z"] == 6.0
    report = {r["source"]: (r["total"], r["missing"]) for r in align_report(data, anchored).collect()}
    assert report == {"p": (3, 1), "q": (4, 1), "r": (4, 0)}
    ids = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    assert sample_ids(ids, 3).collect() == sample_ids(ids.repartition(3), 3).collect()
    assert align(data, ["p", "q"], size=2).n == 2
    labels = spark.createDataFrame([("a", "demo"), ("b", "com")], "id string, label string")
    assert [r["id"] for r in shared_entities(ids, labels, labels=labels, exclude="demo").collect()] == ["b"]


@pytest.fixture(scope="module")
def sources(spark):
    ids, dense, data = two_sources(spark, n=13, seed=3)
    return ids, dense, align(data, ["p", "q", "r"])


def matrix(dense, ids, s, normal=False):
    x = scaled(upper(dense, ids, s)) if normal else upper(dense, ids, s)
    m = np.zeros((len(ids), len(ids)))
    m[np.triu_indices(len(ids), 1)] = x
    return m + m.T


PAIRS = [("p", "q"), ("p", "r"), ("q", "r")]


def test_spearman_and_norms(sources):
    ids, dense, aligned = sources
    normal = normalize(aligned)[0]
    rho = {(r["source1"], r["source2"]): r["rho"] for r in compare.spearman(normal).collect()}
    sparse = {(r["source1"], r["source2"]): r["rho"] for r in compare.spearman(aligned, sparse=True).collect()}
    norms = {(r["source1"], r["source2"]): (r["frobenius"], r["rmse"]) for r in compare.frobenius(normal).collect()}
    upper_norms = {(r["source1"], r["source2"]): (r["frobenius"], r["rmse"]) for r in compare.frobenius(normal, sparse=True).collect()}
    for a, b in PAIRS:
        x, y = upper(dense, ids, a), upper(dense, ids, b)
        assert rho[a, b] == pytest.approx(pd.Series(x).rank().corr(pd.Series(y).rank()))
        keep = (x != 0) & (y != 0)
        assert sparse[a, b] == pytest.approx(pd.Series(x[keep]).rank().corr(pd.Series(y[keep]).rank()))
        d = matrix(dense, ids, a, True) - matrix(dense, ids, b, True)
        assert norms[a, b] == pytest.approx((np.linalg.norm(d), np.linalg.norm(d) / 13))
        u = scaled(x) - scaled(y)
        assert upper_norms[a, b] == pytest.approx((np.linalg.norm(u), np.linalg.norm(u) / np.sqrt(len(u))))
    with pytest.raises(ValueError):
        compare.spearman(aligned._replace(background={"p": 0.3, "q": 0.3, "r": 0.3}), sparse=True)


def test_frequent_values_are_joined_without_shuffle(spark, sources):
    ids, dense, aligned = sources
    ranks = compare.average_ranks(with_background(aligned, "similarity"))
    data = aligned.pairs.select("source", "id1", "id2", F.col("similarity").alias("value"))
    plain = sorted(map(tuple, compare.join_ranks(data, ranks).select("source", "id1", "id2", "rank").collect()))
    hot = sorted(map(tuple, compare.join_ranks(data, ranks, hot_rows=2).select("source", "id1", "id2", "rank").collect()))
    assert plain == hot and len(plain) == data.count()


@pytest.mark.parametrize("block", [None, 4, 200])
def test_hausdorff(sources, block, monkeypatch):
    monkeypatch.setattr(compare, "SLICE", 3)  # several slices of columns
    ids, dense, aligned = sources
    normal = normalize(aligned)[0]
    got = {(r["source1"], r["source2"]): r["gromov"] for r in compare.hausdorff(normal, block_size=block, tile_rows=5).collect()}
    for a, b in PAIRS:
        x, y = matrix(dense, ids, a, True), matrix(dense, ids, b, True)
        d = np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))
        size = block or len(ids)
        best = max(
            max(t.min(axis=1).max(), t.min(axis=0).max())
            for i in range(0, len(ids), size) for j in range(0, len(ids), size) for t in [d[i : i + size, j : j + size]]
        )
        assert got[a, b] == pytest.approx(best)


@pytest.mark.parametrize("block", [None, 2])
def test_hausdorff_copies_rows_per_part(spark, sources, block, monkeypatch):
    normal = normalize(sources[2])[0]
    expected = sorted(map(tuple, compare.hausdorff(normal, block_size=block, task_cells=10**9).collect()))
    copies, plain = spark.sparkContext.accumulator(0), compare._row_minima

    def counted(*options):
        work = plain(*options)

        def count(key, group):
            copies.add(group.num_rows)
            return work(key, group)

        return count

    monkeypatch.setattr(compare, "_row_minima", counted)
    monkeypatch.setattr(compare, "PARTS", 3)
    got = sorted(map(tuple, compare.hausdorff(normal, block_size=block).collect()))
    n, names = len(sources[0]), len(normal.sources)
    assert copies.value <= (3 + 1) * n * names  # not a copy for every block
    monkeypatch.setattr(compare, "PARTS", 1)
    several = sorted(map(tuple, compare.hausdorff(normal, block_size=block, task_cells=40).collect()))
    for rows in (got, several):
        assert [r[:2] for r in rows] == [r[:2] for r in expected]
        assert [r[2] for r in rows] == pytest.approx([r[2] for r in expected])


def test_hausdorff_of_equal_distances(spark, monkeypatch):
    """Rows that are all equally far do not wait together, and few of them are measured again."""
    n, measured, plain = 60, spark.sparkContext.accumulator(0), compare._between

    def counted(x, a, y, b, *more):
        measured.add(len(a))
        return plain(x, a, y, b, *more)

    monkeypatch.setattr(compare, "_between", counted)
    monkeypatch.setattr(compare, "WAITING", 20)
    monkeypatch.setattr(compare, "PARTS", 1)
    ids = spark.range(n)
    for rows, expected in (([], 0.5 * math.sqrt(n - 1)), ([("p", 3, 7, 0.4)], None)):
        measured.value = 0
        aligned = Aligned(spark.createDataFrame(rows, "source string, id1 long, id2 long, similarity double"), ids, n, ["p", "q"], {"p": 0.0, "q": 0.5}, {"p": len(rows), "q": 0})
        got = compare.hausdorff(aligned, block_size=5, tile_rows=10).first()["gromov"]
        p, q = np.zeros((n, n)), np.full((n, n), 0.5)
        np.fill_diagonal(q, 0)
        for _, i, j, v in rows:
            p[i, j] = p[j, i] = v
        d = np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=2))
        blocks = [d[i : i + 5, j : j + 5] for i in range(0, n, 5) for j in range(0, n, 5)]
        assert got == pytest.approx(max(max(b.min(axis=0).max(), b.min(axis=1).max()) for b in blocks), rel=1e-12)
        assert expected is None or got == pytest.approx(expected, rel=1e-12)
        assert measured.value < n * n / 10  # of 2 * n * n / 5 that are equally far


def test_hausdorff_of_values(sources):
    ids, dense, aligned = sources
    got = {(r["source1"], r["source2"]): r["gromov"] for r in compare.hausdorff_values(aligned).collect()}
    for a, b in PAIRS:
        x, y = upper(dense, ids, a), upper(dense, ids, b)
        keep = (x != 0) & (y != 0)
        d = np.abs(x[keep][:, None] - y[keep][None, :])
        assert got[a, b] == pytest.approx(max(d.min(axis=1).max(), d.min(axis=0).max()))


@pytest.mark.parametrize("n", [2, 3, 4, 5, 12, 13])
def test_cells_are_permuted(n):
    size = n * (n - 1) // 2
    seen = {tuple(permute.moved(np.arange(size), *permute.triangle_grid(n), size, r, 42).tolist()) for r in range(3)}
    assert all(sorted(s) == list(range(size)) for s in seen)
    assert n < 5 or len(seen) == 3


def test_permutation_test(sources):
    ids, dense, aligned = sources
    null = [r["rho"] for r in compare.permutation_null(aligned, 150).filter("source1 = 'p' and source2 = 'q'").collect()]
    assert len(null) == 150 and abs(np.mean(null)) < 0.05 and np.std(null) == pytest.approx(1 / math.sqrt(77), rel=0.25)
    twice = aligned.pairs.filter("source = 'p'")
    same = aligned._replace(
        pairs=twice.unionByName(twice.withColumn("source", F.lit("copy"))), sources=["p", "copy"],
        background={"p": 0.0, "copy": 0.0}, stored={"p": aligned.stored["p"], "copy": aligned.stored["p"]},
    )
    row = compare.permutation_test(same, 99).first()
    assert row["rho"] == pytest.approx(1.0) and row["p_value"] == pytest.approx(2 / 100)


def rank(x):
    order = np.sort(x)
    return (np.searchsorted(order, x, "left") + np.searchsorted(order, x, "right") + 1) / 2


@pytest.mark.parametrize("block, work, span", [(500_000, 20_000_000, 8_000_000), (11, 60, 8_000_000), (11, 60, 3)])
def test_permutations_equal_plain_ones(sources, monkeypatch, block, work, span):
    """All source pairs, dense and nonzero, against the permutation carried out on whole arrays."""
    monkeypatch.setattr(permute, "BLOCK", block)
    monkeypatch.setattr(permute, "WORK", work)
    monkeypatch.setattr(permute, "SPAN", span)
    ids, dense, aligned = sources
    names, n = aligned.sources, len(ids)
    for sparse in (False, True):
        got = {}
        for r in compare.permutation_null(aligned, 7, 5, sparse).collect():
            got.setdefault((r["source1"], r["source2"]), {})[r["resample"]] = r["rho"]
        test = {(r["source1"], r["source2"]): (r["rho"], r["p_value"]) for r in compare.permutation_test(aligned, 7, 5, sparse).collect()}
        for a, b in itertools.combinations(names, 2):
            x, y = upper(dense, ids, a), upper(dense, ids, b)
            if sparse:
                both = (x != 0) & (y != 0)
                x, y = x[both], y[both]
            u, v = rank(x) - (len(x) + 1) / 2, rank(y) - (len(x) + 1) / 2
            size = math.sqrt((u**2).sum() * (v**2).sum())
            sides = permute.grid(len(x)) if sparse else permute.triangle_grid(n)
            expected = [(u * v[permute.moved(np.arange(len(x)), *sides, len(x), r, 5)]).sum() / size for r in range(7)]
            assert [got[a, b][r] for r in range(7)] == pytest.approx(expected)
            rho = (u * v).sum() / size
            tail = min(sum(e <= rho + abs(rho) * 1e-12 for e in expected), sum(e >= rho - abs(rho) * 1e-12 for e in expected))
            assert test[a, b] == (pytest.approx(rho), pytest.approx(min(1, 2 * (tail + 1) / 8)))


def test_permutation_rows_are_not_copied_for_resamples(spark, monkeypatch):
    """A task does all resamples of its rows: as many tasks for 4 as for 1100."""
    tasks, plain = spark.sparkContext.accumulator(0), permute._finder

    def counted(at):
        tasks.add(1)
        return plain(at)

    monkeypatch.setattr(permute, "_finder", counted)
    rows = spark.range(20_000).select(F.lit("all").alias("name"), F.col("id").alias("cell"), F.array(F.lit(1.0)).alias("u"), F.array(F.lit(2.0)).alias("v"))
    for resamples in (4, 1100):
        tasks.value = 0
        got = permute.permuted_products(rows, {"all": (*permute.grid(20_000), 20_000)}, 1, resamples, 42).collect()
        assert len(got) == resamples and all(r["sums"] == [40_000.0] for r in got)
        assert tasks.value == permute.TASKS


@pytest.mark.parametrize("rolls", [10**9, 2_000])
def test_full_grids_are_rolled(spark, monkeypatch, rolls):
    """No cell of a full grid is looked up, and it is copied once for a task; ranks, other numbers and missing cells."""
    looked, plain = spark.sparkContext.accumulator(0), permute._finder

    def counted(at):
        looked.add(1)
        return plain(at)

    monkeypatch.setattr(permute, "_finder", counted)
    monkeypatch.setattr(permute, "ROLLED", 50)
    monkeypatch.setattr(permute, "ROLLS", rolls)
    sizes = {"few": 40, "holes": 731, "grid": 900, "odd": 1300}
    rng = np.random.default_rng(3)
    held = {k: (np.arange(n) - (n - 1) / 2, rng.permutation(n) * 0.5 if k != "odd" else rng.normal(size=n)) for k, n in sizes.items()}
    held["odd"][0][17] = held["odd"][1][17] = 0.0
    rows = [(k, c, [float(u[c])], [float(v[c])]) for k, (u, v) in held.items() for c in range(len(u)) if (k, c) != ("odd", 17)]
    table = spark.createDataFrame(rows, "name string, cell long, u array<double>, v array<double>")
    domains = {k: (*permute.grid(n), n) for k, n in sizes.items()}
    got = {(r["name"], r["resample"]): r["sums"] for r in permute.permuted_products(table, domains, 1, 9, 5, full=True).collect()}
    for k, (u, v) in held.items():
        for r in range(9):
            assert got[k, r] == pytest.approx([(u * v[permute.moved(np.arange(len(u)), *domains[k], r, 5)]).sum()])
    assert len(got) == 36 and looked.value <= permute.TASKS  # the few cells only


def test_slots_have_a_partition_each(spark):
    found = runtime.slots(spark, 37)
    table = spark.createDataFrame([(s,) for s in found], "slot long").repartition(37, "slot")
    assert sorted(r["p"] for r in table.select(F.spark_partition_id().alias("p")).collect()) == list(range(37))


def test_moves_are_permutations():
    for size in (1, 2, 3, 10, 97, 780):
        for a, b in {permute.grid(size)} | ({permute.triangle_grid(40)} if size == 780 else set()):
            assert a * b >= size
            seen = [tuple(permute.moved(np.arange(size), a, b, size, r, 42).tolist()) for r in range(5)]
            assert all(sorted(s) == list(range(size)) for s in seen)
            if size > 90:
                assert len(set(seen)) == 5 and all(sum(i == c for i, c in enumerate(s)) < 10 for s in seen)


def test_distributions(sources):
    ids, dense, aligned = sources
    data = with_background(aligned, "similarity")
    for density in (False, True):
        got = {}
        for r in distribution.histogram(data, 7, density=density).collect():
            got.setdefault(r["source"], {})[r["bin"]] = r["frequency"]
        for s in ("p", "q", "r"):
            x = upper(dense, ids, s)
            at = np.minimum(np.floor(np.round((x - x.min()) / (x.max() - x.min()) * 7, 9)), 6).astype(int)
            counts = np.bincount(at, minlength=7).astype(float)
            expected = counts / (len(x) * (x.max() - x.min()) / 7) if density else counts
            assert [got[s][b] for b in range(7)] == pytest.approx(list(expected))
    curve = distribution.density_curve(data, points=20, clip=(0.0, 3.0)).filter("source = 'p'").orderBy("point").collect()
    x = upper(dense, ids, "p")
    h = len(x) ** -0.2 * x.std(ddof=1)
    grid = np.linspace(max(x.min() - 3 * h, 0), min(x.max() + 3 * h, 3), 20)
    expected = [np.exp(-0.5 * ((g - x) / h) ** 2).sum() / (len(x) * h * math.sqrt(2 * math.pi)) for g in grid]
    assert [r["density"] for r in curve] == pytest.approx(expected)
    joint = distribution.joint_distribution(data, 5).first()
    assert (joint["global_min"], joint["global_max"]) == (0.0, max(upper(dense, ids, s).max() for s in "pqr"))
    assert sum(r["frequency"] for r in distribution.histogram(spark_rows(data), 3).collect()) == 2


def test_histogram_of_a_constant_source(sources):
    """The rho of a pair with a constant source is null; its bins stay, without edges."""
    ids, dense, aligned = sources
    flat = aligned._replace(pairs=aligned.pairs.withColumn("similarity", F.when(F.col("source") == "r", 0.0).otherwise(F.col("similarity"))))
    null = compare.permutation_null(flat, 20).select(F.concat_ws("|", "source1", "source2").alias("source"), F.col("rho").alias("value"), F.lit(1).cast("long").alias("w"))
    for density in (False, True):
        got = {}
        for r in distribution.histogram(null, 4, density=density).collect():
            got.setdefault(r["source"], {})[r["bin"]] = (r["low"], r["high"], r["frequency"])
        assert set(got) == {"p|q", "p|r", "q|r"} and all(sorted(bars) == [0, 1, 2, 3] for bars in got.values())
        assert {b for s in ("p|r", "q|r") for b in got[s].values()} == {(None, None, None)}
        assert sum(f * (z - a if density else 1) for a, z, f in got["p|q"].values()) == pytest.approx(1 if density else 20)


def spark_rows(data):
    return data.sparkSession.createDataFrame([("c", 1.0, 2)], "source string, value double, w long")


def test_upper_aligned(sources):
    ids, dense, aligned = sources
    x, y = upper(dense, ids, "p"), upper(dense, ids, "q")
    assert upper_aligned(aligned.pairs, "p", "q", True).count() == int(((x != 0) & (y != 0)).sum())
    assert upper_aligned(aligned.pairs, "p", "q").count() == int(((x != 0) | (y != 0)).sum())
