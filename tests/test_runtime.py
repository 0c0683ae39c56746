import random
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from simlattice.functions.quantiles import exact_percentiles
from simlattice.runtime import cut, numbered, running_totals, shared_folder, with_next


def test_running_totals_over_ranges(spark, many_partitions):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else "cold", i, rng.randint(1, 5)) for i in range(500)]
    got = running_totals(spark.createDataFrame(rows, "k string, o int, w long").repartition(7), ["k"], ["o"], "w").collect()
    for k in ("hot", "cold"):
        before = 0
        for o, w in sorted((o, w) for kk, o, w in rows if kk == k):
            assert [r["before"] for r in got if r["k"] == k and r["o"] == o] == [before]
            before += w


def test_numbered_without_keys(spark, many_partitions):
    names = [f"n{i:03d}" for i in range(200)]
    random.Random(2).shuffle(names)
    got = numbered(spark.createDataFrame([(n,) for n in names], "n string"), [], ["n"])
    assert {r["n"]: r["pos"] for r in got.collect()} == {n: i for i, n in enumerate(sorted(names))}


def test_with_next_continues_over_range_borders(spark, many_partitions):
    rows = list(range(0, 300, 3))
    random.Random(3).shuffle(rows)
    got = with_next(spark.createDataFrame([(r,) for r in rows], "a int"), ["a"], [])
    assert {r["a"]: r["next"] and r["next"]["a"] for r in got.collect()} == {a: a + 3 if a < 297 else None for a in rows}


@pytest.mark.parametrize("limit", [1_000_000, 5])
def test_exact_percentiles(spark, limit):
    rng = np.random.default_rng(4)
    rows = [("a", float(x)) for x in rng.lognormal(size=400)] + [("b", 1.0)] * 300 + [("b", float(x)) for x in rng.normal(size=50)] + [("c", 7.0)]
    extra = {"a": (0.5, 37), "d": (2.0, 3)}
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = exact_percentiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", probs, extra, limit)
    for k in "abcd":
        data = [v for kk, v in rows if kk == k] + [extra[k][0]] * extra[k][1] if k in extra else [v for kk, v in rows if kk == k]
        assert got[k] == pytest.approx(list(np.percentile(data, [100 * p for p in probs])))


def test_cut_writes_a_table_in_the_shared_folder(spark):
    df = cut(spark.range(5).withColumn("x", F.col("id") * 2))
    assert sorted(r["x"] for r in df.collect()) == [0, 2, 4, 6, 8]
    assert all(f"{shared_folder(spark)}/simlattice" in f for f in df.inputFiles())


class FakeSession:
    def __init__(self, master, folder=None):
        self.sparkContext = SimpleNamespace(master=master)
        self.conf = SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)


def test_shared_folder_comes_from_the_session():
    assert shared_folder(FakeSession("yarn", "hdfs:///work")) == "hdfs:///work"
    assert Path(shared_folder(FakeSession("local[2]"))).is_dir()
    with pytest.raises(RuntimeError):
        shared_folder(FakeSession("yarn"))
