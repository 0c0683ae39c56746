"""Readers and writers as queries: what is written from the given tables is read back.

Every query writes into a new place of the shared folder and returns what the
reader finds there, so its rows grow with the tables. Damaged lines and cells
are written on purpose, where the readers say what becomes of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simlattice import sinks
from simlattice.operators import evaluate, neighbors, overlap
from simlattice.operators.align import restrict
from simlattice.operators.combine import combo_stats, threshold_range
from simlattice.operators.leader import cluster_sizes, leader_clusters
from simlattice.operators.matrix import Matrices, build_matrices
from simlattice.operators.silhouette import cluster_counts
from simlattice.plans.demo import _clustered, _combined, _six, _table, _vector_labels, _vectors
from simlattice.runtime import scratch
from simlattice.sources import files
from simlattice.sources.tables import SUPPLIER_SOURCES, supplier_links, supplier_matrices

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def _write_lines(rows: DataFrame, value: Column, order: list[str], prefix: str = "") -> str:
    """Folder of text files whose names, after ``prefix``, follow ``order``."""
    spark = rows.sparkSession
    path = scratch(spark)
    rows.orderBy(*order).select(value.alias("value")).write.text(path)
    if prefix:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith("part-"):
                fs.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, prefix + name))
    return path


def _link_files(spark: SparkSession, sf_dir: str) -> str:
    """Pair files of all supplier links; same-day links have no number, and links of whole ten cents a field too many."""
    number = F.when(F.col("days") == 0, "n/a").otherwise((1.0 / (1 + F.col("days"))).cast("string"))
    line = F.concat_ws("\t", "id2", "id1", number, F.when(F.col("cents") % 10 == 0, "more"))
    return _write_lines(supplier_links(spark, sf_dir), line, ["cents", "days", "id1", "id2"], "left__right-")


@query
def pair_files(spark, sf_dir):
    rows = files.read_pair_files(spark, _link_files(spark, sf_dir), "links")
    return _six(build_matrices(rows).pairs, "similarity")


@query
def pair_files_rejected(spark, sf_dir):
    rows = files.rejected_lines(spark, _link_files(spark, sf_dir))
    return rows.groupBy("reason").agg(F.sum("count").alias("n"))


@query
def url_pair_files(spark, sf_dir):
    """Every page and the page of the next number, by address."""
    pages = _table(spark, sf_dir, "pages").filter("url <> ''").select("page_id", "url")
    after = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("other"))
    line = F.concat_ws("\t", "url", "other", (1.0 / (1 + F.col("page_id") % 97)).cast("string"))
    path = _write_lines(pages.join(after, "page_id"), line, ["page_id"], "left|right-")
    return _six(files.read_pair_files(spark, path, "pages", url_keys=True).select("id1", "id2", "similarity"), "similarity")


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines sold per nation of the customer and nation of the supplier: ``a, b, n``."""
    lines = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ends = lines.join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return ends.groupBy(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).agg(F.count("*").alias("n"))


def _square(spark: SparkSession, sf_dir: str, cell: Column) -> tuple[DataFrame, list[int]]:
    """One row per nation, ``a, n_name``, with the ``cell`` of every nation in a column of its own."""
    nations = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), "n_name")
    keys = [r["a"] for r in nations.orderBy("a").collect()]
    wide = _trade(spark, sf_dir).groupBy("a").pivot("b", keys).agg(F.first(cell))
    return nations.join(wide, "a", "left").repartition(1).sortWithinPartitions("a"), keys


def _wide_file(spark: SparkSession, sf_dir: str, named: bool) -> str:
    cell = F.when((F.col("a") + F.col("b")) % 7 == 0, "").when(F.col("a") * F.col("b") % 11 == 5, "inf").otherwise(F.col("n").cast("string"))
    table, keys = _square(spark, sf_dir, cell)
    names = [r["n_name"] for r in _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()] if named else [str(i) for i in range(len(keys))]
    path = scratch(spark)
    table.drop("a").toDF("nation", *names).write.csv(path, header=True)
    return path


@query
def wide_matrix(spark, sf_dir):
    """A matrix whose columns bear names and one whose columns bear numbers."""
    one, two = (files.read_wide_matrix(spark, _wide_file(spark, sf_dir, named), source).pairs for source, named in (("named", True), ("indexed", False)))
    return one.unionByName(two).select("source", "id1", "id2", "similarity")


@query
def positional_matrix(spark, sf_dir):
    cell = F.when((F.col("a") + F.col("b")) % 7 == 0, "x").otherwise(F.col("n").cast("string"))
    table, keys = _square(spark, sf_dir, cell)
    line = F.concat(F.lit("BlockRealMatrix{{"), F.concat_ws(", ", *(F.coalesce(F.col(str(k)), F.lit("0")) for k in keys)), F.lit("}}"))
    dump = _write_lines(table, line, ["a"])
    nations = _table(spark, sf_dir, "nation")
    index = _write_lines(nations, F.concat_ws(": ", F.col("n_nationkey").cast("string"), "n_name"), ["n_nationkey"])
    return files.read_positional_matrix(spark, index, dump, "trade").pairs.select("source", "id1", "id2", "similarity")


@query
def entity_list(spark, sf_dir):
    """Names with blanks around them, and a blank line in place of every tenth."""
    suppliers = _table(spark, sf_dir, "supplier")
    line = F.when(F.col("s_suppkey") % 10 == 0, "  ").otherwise(F.concat(F.lit("  "), F.col("s_name"), F.lit("\t")))
    return files.read_entities(spark, _write_lines(suppliers, line, ["s_suppkey"]))


@query
def label_file(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(F.concat("source", F.lit(","), "lang", F.lit(",")).alias("line"), F.lit(1).alias("part"), "doc_id")
    head = spark.createDataFrame([("key,label,", 0, 0)], "line string, part int, doc_id long")
    return files.read_labels(spark, _write_lines(head.unionByName(rows), F.col("line"), ["part", "doc_id"]))


@query
def vector_file(spark, sf_dir):
    """Vectors with the first component as a number and the others as a tuple; ``mark`` depends on every component."""
    v = F.col("vector").cast("array<double>")
    table = _vectors(spark, sf_dir).select("id", v[0].alias("first"), F.concat(F.lit("("), F.array_join(F.slice(v, 2, F.size(v)), ", "), F.lit(")")).alias("others"))
    path = scratch(spark)
    table.write.csv(path, header=True)
    marks = F.transform("vector", lambda x, i: F.floor(x * 1e6) * (i + 1))
    rows = files.read_vectors(spark, path)
    return rows.select("id", F.size("vector").alias("dims"), F.aggregate(marks, F.lit(0).cast("long"), lambda s, x: s + x).alias("mark"))


@query
def loaded_sources(spark, sf_dir):
    registry = {
        "links": lambda s: files.read_pair_files(s, _link_files(s, sf_dir), "raw"),
        "trade": lambda s: files.read_wide_matrix(s, _wide_file(s, sf_dir, True), "raw"),
    }
    return _six(files.load_sources(spark, registry, ["links", "trade"]).pairs.select("source", "id1", "id2", "similarity"), "similarity")


@query
def cached_sources(spark, sf_dir):
    """The second call finds what the first has saved."""
    folder = scratch(spark)
    files.cached(spark, folder, lambda: supplier_matrices(spark, sf_dir))

    def again() -> Matrices:
        raise RuntimeError("saved matrices were not found")

    return _six(files.cached(spark, folder, again).pairs, "similarity")


# Writers


def _csv(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).csv(path, header=True)


@query
def saved_distances(spark, sf_dir):
    path = scratch(spark)
    sinks.save_distances(_combined(spark, sf_dir), path)
    return spark.read.parquet(path).select("combo", "id1", "id2", F.size("dists").alias("dims"), "d")


@query
def appended_results(spark, sf_dir):
    path, pairs = scratch(spark), supplier_matrices(spark, sf_dir).pairs
    for source in SUPPLIER_SOURCES:
        sinks.append_results(pairs.filter(F.col("source") == source), path)
    return _six(spark.read.parquet(path), "similarity")


@query
def saved_runs(spark, sf_dir):
    path, rows = scratch(spark), _six(combo_stats(_combined(spark, sf_dir)), "min_distance", "mean_distance", "max_distance")
    sinks.save_runs(rows, path, ["combo"])
    return _csv(spark, path, rows.select(F.lit("").alias("run_id"), *rows.columns))


@query
def saved_clusters(spark, sf_dir):
    path, done = scratch(spark), _clustered(spark, sf_dir)
    sinks.save_clusters(done.best, done.labels, path)
    members = spark.read.parquet(f"{path}/labels").groupBy("combo").agg(F.countDistinct("leader").alias("leaders"))
    return _six(spark.read.parquet(f"{path}/best").join(members, "combo"), "t1", "silhouette", "single_point_ratio")


@query
def saved_overlap(spark, sf_dir):
    path, done = scratch(spark), _clustered(spark, sf_dir)
    detail = overlap.overlap_detail(done.combined, done.labels, overlap.nested_pairs(done.combined.combos))
    sinks.save_overlap(detail, detail.groupBy("base", "other").agg(F.sum("shared").alias("shared")), path)
    mapping = spark.read.parquet(f"{path}/overlap_mapping").select("base", "other", "leader_a", F.explode("leaders_c").alias("leader_c"))
    return _six(spark.read.parquet(f"{path}/overlap_detail").join(mapping, ["base", "other", "leader_a", "leader_c"], "left_semi"), "score")


@query
def saved_cluster_info(spark, sf_dir):
    path, combined = scratch(spark), _combined(spark, sf_dir)
    clusters = leader_clusters(combined, threshold_range(combined))
    sizes = cluster_sizes(clusters)
    sinks.save_cluster_info(cluster_counts(clusters), sizes.select("combo", "step", "leader", "size"), path)
    return _csv(spark, f"{path}/sizes", sizes.select("combo", "step", "leader", "size"))


@query
def saved_report(spark, sf_dir):
    known = _vector_labels(spark, sf_dir).filter("label IS NOT NULL")
    path, report = scratch(spark), evaluate.topk_report(neighbors.nearest_vectors(_vectors(spark, sf_dir)), known)
    sinks.save_report(report, path)
    return _csv(spark, path, report).withColumnRenamed("acc@5", "acc_at_5")


@query
def saved_similarities(spark, sf_dir):
    rich = _table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("id"))
    path, rows = scratch(spark), restrict(supplier_matrices(spark, sf_dir).pairs, rich)
    sinks.save_similarities(rows, path)
    return _six(_csv(spark, path, rows), "similarity")
