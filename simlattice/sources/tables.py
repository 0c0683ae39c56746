"""Demo sources: suppliers related by neighbouring sales of the same part.

All lines are put in one order (part, ship date, ...). Two lines that follow
each other and sell the same part relate their two suppliers. One line takes
part in two links at most, so the links grow with the table whatever the
number of lines of a part, an order or a supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlattice.operators.matrix import Matrices, entities_of
from simlattice.runtime import cut, with_next

SUPPLIER_SOURCES = ["follow", "pace", "worth", "alike"]


def supplier_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_partkey").alias("part"),
        F.col("l_shipdate").alias("day"),
        F.col("l_orderkey").alias("ord"),
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("supp"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.col("l_returnflag").alias("flag"),
    )
    order = ["part", "day", "ord", "line", "supp", "cents", "flag"]
    after = F.col("next")
    return with_next(lines, order, []).filter(
        (after["part"] == F.col("part")) & (after["supp"] != F.col("supp"))
    ).select(
        F.least("supp", after["supp"]).alias("id1"),
        F.greatest("supp", after["supp"]).alias("id2"),
        F.datediff(after["day"], "day").alias("days"),
        F.least("cents", after["cents"]).alias("cents"),
        (F.col("flag") == after["flag"]).alias("same"),
    )


def supplier_matrices(spark: SparkSession, sf_dir: str) -> Matrices:
    """Four sources over suppliers: links, close ship dates, value, same return flag.

    Sums run over integers, so no order of addition changes a similarity.
    """
    sums = supplier_links(spark, sf_dir).groupBy("id1", "id2").agg(
        F.count("days").alias("follow"),
        F.sum(F.floor(F.lit(1e6) / (1 + F.col("days")))).alias("pace"),
        F.sum("cents").alias("worth"),
        F.count(F.when(F.col("same"), 1)).alias("alike"),
    )
    long = sums.unpivot(
        ["id1", "id2"],
        [
            F.col("follow").cast("double").alias("follow"),
            (F.col("pace") / 1e6).alias("pace"),
            (F.col("worth") / 100).alias("worth"),
            F.col("alike").cast("double").alias("alike"),
        ],
        "source",
        "similarity",
    ).filter("similarity != 0")
    pairs = cut(long.select("source", "id1", "id2", "similarity"))
    return Matrices(pairs, entities_of(pairs))
