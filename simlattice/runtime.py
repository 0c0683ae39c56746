"""Session helpers: lineage cuts, distributed numbering and adjacency."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Functions run by tasks travel with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules["simlattice"])

_own_folder: str | None = None
_folders: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session (tests) may fall back to a temporary folder, because
    the executors of a cluster cannot read a folder of one machine.
    """
    global _own_folder
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="simlattice-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return _own_folder


def _remove(spark: SparkSession, folder: str) -> None:
    """Delete the tables of an application when its driver ends; nothing is left to do if the JVM has gone."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001
        pass


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there is deleted when the driver ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/simlattice/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, spark, folder)
    return f"{folder}/{uuid.uuid4().hex}"


# Rows of megabytes each: a group of rows is closed by its bytes from the first row on, not from the hundredth; readers hold one at a time.
HEAVY = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}


def cut(df: DataFrame, heavy: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends at files that outlive executors, the columns stay
    prunable and the file size tells Catalyst whether a broadcast is safe.
    ``heavy`` bounds what tasks hold of rows with large binary values.
    """
    path = scratch(df.sparkSession)
    df.write.options(**HEAVY if heavy else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Split ``df`` into contiguous ranges of ``order``; ``_part`` names the range.

    The cut fixes the sampled range bounds for every later reader.
    """
    return cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def running_totals(df: DataFrame, keys: list[str], order: list[str], weight: str, name: str = "before") -> DataFrame:
    """Sum of ``weight`` over all earlier rows of the same ``keys`` in ``order``.

    No group is sorted in one task: rows are range-partitioned, summed within
    their range, and shifted by the totals of the ranges before it. That table
    of totals has one row per key and range it occurs in.
    """
    ranged = _ranged(df, keys + order)
    totals = ranged.groupBy(*keys, "_part").agg(F.sum(weight).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(*keys, "_part", F.sum("_sum").over(earlier).alias("_shift"))
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(df.schema[weight].dataType)
    local = F.coalesce(F.sum(weight).over(within), zero)
    return (
        ranged.withColumn("_local", local)
        .join(shift, [*keys, "_part"])
        .withColumn(name, F.col("_local") + F.coalesce("_shift", zero))
        .drop("_part", "_local", "_shift")
    )


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """0-based position of every row among its ``keys`` in ``order`` (a total order)."""
    return running_totals(df.withColumn("_one", F.lit(1).cast("long")), keys, order, "_one", name).drop("_one")


def with_next(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Add struct ``next`` with ``columns`` of the following row in the global ``order``.

    Like ``lead`` without a partition, but spread over ranges: only the first
    row of each range is needed to continue the range before it.
    """
    ranged = _ranged(df, order)
    row = F.struct(*order, *[c for c in columns if c not in order])
    first = ranged.groupBy("_part").agg(F.min(row).alias("_first"))
    parts = Window.orderBy("_part")
    follow = first.select("_part", F.lead("_first").over(parts).alias("_first"))
    within = Window.partitionBy("_part").orderBy(*order)
    return (
        ranged.withColumn("_lead", F.lead(row).over(within))
        .join(F.broadcast(follow), "_part")
        .withColumn("next", F.coalesce("_lead", "_first"))
        .drop("_part", "_lead", "_first")
    )


def slots(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers that ``repartition(n, number)`` deals to a partition each, so no two long tasks share one."""
    held: dict[int, int] = {}
    begin, step = 0, 20 * n + 100
    while len(held) < n:
        dealt = spark.range(begin, begin + step).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("part")).agg(F.min("id").alias("id"))
        for r in dealt.collect():
            held.setdefault(r["part"], r["id"])
        begin += step
    return [held[part] for part in range(n)]


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """Inner join of ``rows`` with a ``table`` that has one row per key.

    ``hot(keys)`` lists the keys that hold very many rows. There are few of
    them by the count that made them hot, so their part of the table is
    broadcast and none of their rows is shuffled to one task.
    """
    if hot is None:
        return rows.join(table, keys)
    hot = F.broadcast(hot.select(*keys))
    frequent = rows.join(F.broadcast(table.join(hot, keys, "left_semi")), keys)
    return frequent.unionByName(rows.join(hot, keys, "left_anti").join(table, keys))


def hot_or_none(counts: DataFrame, weight: str, limit: int) -> DataFrame | None:
    """Rows of ``counts`` whose ``weight`` is above ``limit``, or None if there are none."""
    hot = cut(counts.filter(F.col(weight) > limit))
    return hot if hot.limit(1).count() else None


def choose(options: dict, key: Column, cast: str = "double") -> Column:
    """Literal lookup of a driver-side constant per source or combination."""
    value = F.lit(None).cast(cast)
    for name, constant in options.items():
        value = F.when(key == name, F.lit(constant).cast(cast)).otherwise(value)
    return value
