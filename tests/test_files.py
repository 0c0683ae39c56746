import math

import pytest
from pyspark.sql import functions as F

from simlattice import sinks
from simlattice.operators.align import Aligned, align
from simlattice.operators.combine import combine_distances
from simlattice.operators.matrix import build_matrices
from simlattice.sources import files


def cells(df):
    return {(r["id1"], r["id2"]): r["similarity"] for r in df.collect()}


def test_pair_files(spark, tmp_path):
    (tmp_path / "own|a.txt").write_text(" o/a \to/b\t0.5\no/a\to/c\tbad\no/a\to/b\n\to/b\to/a\t1e-1 \n")
    (tmp_path / "own__b.txt").write_text("o/c\to/d\tnan\r\no/d\to/e\tinf\r\n")
    (tmp_path / "other.txt").write_text("x\ty\t1\n")
    (tmp_path / "own__c.csv").write_text("x\ty\t1\n")
    rows = files.read_pair_files(spark, str(tmp_path), "s")
    data = build_matrices(rows)
    assert cells(data.pairs) == {("o/a", "o/b"): 0.1, ("o/d", "o/e"): 0.0}
    assert sorted(r["id"] for r in data.ids.collect()) == ["o/a", "o/b", "o/c", "o/d", "o/e"]
    rejects = {(r["file"], r["reason"]): r["count"] for r in files.rejected_lines(spark, str(tmp_path)).collect()}
    assert rejects == {("own|a.txt", "number"): 1, ("own|a.txt", "fields"): 1}


def test_url_pair_files(spark, tmp_path):
    (tmp_path / "o|a.txt").write_text("git://h/o/a.git\tgit://h/o/b.x.git\t0.25\ngit://h/o/c\tz.git\t2\n")
    (tmp_path / "o__b.txt").write_text("git://h/o/q.git\tgit://h/o/r.git\t1\n")
    rows = files.read_pair_files(spark, str(tmp_path), "s", url_keys=True)
    # Without a dot the last character of the key is lost.
    assert sorted((r["id1"], r["id2"], r["similarity"]) for r in rows.collect()) == [("o/", "z", 2.0), ("o/a", "o/b.x", 0.25)]


def test_wide_matrix(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("Repo,o/b,o/a,c.d\no/b,0,0.5,\no/a,0.9,1,inf\nc.d,3,0.7,0\n")
    data = files.read_wide_matrix(spark, str(path), "s")
    assert cells(data.pairs) == {("o/a", "o/b"): 0.5, ("o/a", "o/a"): 1.0}
    assert sorted(r["id"] for r in data.ids.collect()) == ["c.d", "o/a", "o/b"]
    for header in ("Repo,0,1,2", "Repo,a,a,c"):
        path.write_text(f"{header}\na,0,0.5,0.1\nb,9,1,0.2\nc,9,9,0\n")
        assert cells(files.read_wide_matrix(spark, str(path), "s").pairs) == {("a", "b"): 0.5, ("a", "c"): 0.1, ("b", "b"): 1.0, ("b", "c"): 0.2}
    path.write_text("Repo,o/b,o/a,c.d\no/b,0,0.5,\no/a,0.9,1,inf\nc.d,3,0.7,0\n")
    raw = cells(files.read_wide_matrix(spark, str(path), "s", clean=False).pairs)
    assert raw["c.d", "o/b"] is None and math.isinf(raw["c.d", "o/a"])


def test_positional_matrix(spark, tmp_path):
    (tmp_path / "index.txt").write_text("7: o/x\n\n3: o/a\nnoise\n9: o/c: d\n")
    (tmp_path / "result.txt").write_text(
        "head\nBlockRealMatrix{{1.0, 0.2, 0.3, 9.0}}\n\nBlockRealMatrix{{0.4,1.0 bad}}\nBlockRealMatrix{{NaN, 0.6}}\nBlockRealMatrix{{5, 5, 5}}\n"
    )
    data = files.read_positional_matrix(spark, str(tmp_path / "index.txt"), str(tmp_path / "result.txt"), "s")
    assert cells(data.pairs) == {("o/x", "o/x"): 1.0, ("o/a", "o/a"): 1.0, ("o/a", "o/x"): 0.4, ("o/c: d", "o/x"): 0.3, ("o/a", "o/c: d"): 0.6}
    assert data.ids.count() == 3


def test_lists_labels_and_vectors(spark, tmp_path):
    (tmp_path / "names.txt").write_text(" o/a \n\no/b\n   \n")
    assert [r["id"] for r in files.read_entities(spark, str(tmp_path / "names.txt")).collect()] == ["o/a", "o/b"]
    (tmp_path / "labels.csv").write_bytes("﻿\r\nrepo,type,\r\no/a,demo,\r\n\r\no/b,com,\r\no/a,spring,\r\n".encode())
    assert {r["id"]: r["label"] for r in files.read_labels(spark, str(tmp_path / "labels.csv")).collect()} == {"o/a": "spring", "o/b": "com"}
    (tmp_path / "vec.csv").write_text('repo,x,y,z\no/a,1.5,"(1, -2.5e-1, np.float64(3))",\no/b,2,"(0.5,)",4\n')
    got = {r["id"]: r["vector"] for r in files.read_vectors(spark, str(tmp_path / "vec.csv")).collect()}
    assert got["o/b"] == [2.0, 0.5, 4.0]
    assert got["o/a"][:4] == [1.5, 1.0, -0.25, 3.0] and math.isnan(got["o/a"][4])


def test_registry_and_cache(spark, tmp_path):
    frame = spark.createDataFrame([("x", "a", "b", 1.0, 0)], "source string, id1 string, id2 string, similarity double, seq int")
    data = files.load_sources(spark, {"one": lambda s: frame, "two": lambda s: build_matrices(frame)}, ["one", "two"])
    assert sorted(r["source"] for r in data.pairs.collect()) == ["one", "two"]
    with pytest.raises(ValueError):
        files.load_sources(spark, {}, ["one"])
    first = files.cached(spark, str(tmp_path / "c"), lambda: build_matrices(frame))
    again = files.cached(spark, str(tmp_path / "c"), lambda: build_matrices(frame.withColumn("similarity", F.lit(9.0))))
    assert cells(first.pairs) == cells(again.pairs) == {("a", "b"): 1.0}

    def never():
        raise AssertionError("a hit must not build")

    files.cached(spark, str(tmp_path / "c"), never)
    first.pairs.write.parquet(str(tmp_path / "half" / "pairs"))
    assert cells(files.cached(spark, str(tmp_path / "half"), lambda: build_matrices(frame)).pairs) == {("a", "b"): 1.0}


def test_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([("p", "a", "b", 0.5), ("q", "a", "b", 0.25), ("q", "b", "c", 1.0)], "source string, id1 string, id2 string, distance double")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    combined = combine_distances(Aligned(pairs, ids, 3, ["p", "q"], {"p": 1.0, "q": 1.0}, {"p": 1, "q": 2}), {"p": ("p",), "p_q": ("p", "q")})
    sinks.save_distances(combined, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).groupBy("combo").count().count() == 2

    rows = spark.createDataFrame([("b", 2.0), ("a", 1.0)], "name string, v double")
    for _ in range(2):
        sinks.append_results(rows, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 4
    for _ in range(2):
        sinks.save_runs(rows, str(tmp_path / "runs"), ["name"])
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "runs"), header=True).collect())) == [("Run 1", "a", "1.0"), ("Run 2", "b", "2.0")]

    labels = spark.createDataFrame([("p", "a", "a"), ("p", "b", "a")], "combo string, id string, leader string")
    best = spark.createDataFrame([("p", 1, 0.5)], "combo string, step int, t1 double")
    sinks.save_clusters(best, labels, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c" / "labels")).count() == 2
    detail = spark.createDataFrame([("p", "q", "a", "b", 1), ("p", "q", "a", "c", 1)], "base string, other string, leader_a string, leader_c string, shared int")
    sinks.save_overlap(detail, best, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o" / "overlap_mapping")).first()["leaders_c"] == ["b", "c"]
    sizes = labels.groupBy("combo", "leader").agg(F.count("*").alias("size"))
    sinks.save_cluster_info(best, sizes, str(tmp_path / "i"))
    sinks.save_report(labels, str(tmp_path / "rep"))
    sinks.save_similarities(pairs, str(tmp_path / "sim"))
    assert spark.read.csv(str(tmp_path / "sim"), header=True).count() == 3 and spark.read.csv(str(tmp_path / "i" / "sizes"), header=True).first()["size"] == "2"


def test_files_to_aligned_sources(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x__y.txt").write_text("a\tb\t0.5\nb\tc\t0.25\n")
    (tmp_path / "wide.csv").write_text("Repo,a,b,c\na,0,0.1,0.2\nb,0.1,0,0.3\nc,0.2,0.3,0\n")
    registry = {
        "pairs": lambda s: files.read_pair_files(s, str(tmp_path / "p"), "pairs"),
        "wide": lambda s: files.read_wide_matrix(s, str(tmp_path / "wide.csv"), "wide"),
    }
    aligned = align(files.load_sources(spark, registry, ["pairs", "wide"]), ["pairs", "wide"])
    assert aligned.n == 3 and aligned.stored == {"pairs": 2, "wide": 3} and aligned.absent("pairs") == 1
