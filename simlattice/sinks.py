"""Writers of results. Tables are parquet; small reports are CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlattice.operators.combine import Combined
from simlattice.runtime import numbered

def save_distances(combined: Combined, path: str) -> None:
    """Vector distances of all combinations, one folder per combination.

    A combination is written on its own from the columns it needs: written
    together, all rows of all combinations are sorted by folder on disk first.
    """
    combined.vectors.limit(0).write.mode("overwrite").partitionBy("combo").parquet(path)
    for combo in combined.combos:
        rows = combined.vectors_of(combo).withColumn("combo", F.lit(combo))
        rows.write.mode("append").option("compression", "zstd").partitionBy("combo").parquet(path)


def append_results(rows: DataFrame, path: str) -> None:
    """Add result rows to a table, which is created on the first call."""
    rows.write.mode("append").parquet(path)


def save_runs(rows: DataFrame, path: str, order: list[str]) -> None:
    """Overwrite a report whose rows are named ``Run 1``, ``Run 2``, ... in ``order``."""
    runs = numbered(rows, [], order, "_pos").withColumn("Run ID", F.concat(F.lit("Run "), (F.col("_pos") + 1).cast("string")))
    runs.drop("_pos").select("Run ID", *rows.columns).write.mode("overwrite").csv(path, header=True)


def save_clusters(best: DataFrame, labels: DataFrame, path: str) -> None:
    """Best thresholds and the clusters that belong to them."""
    best.write.mode("overwrite").parquet(f"{path}/best")
    labels.write.mode("overwrite").parquet(f"{path}/labels")


def save_overlap(detail: DataFrame, scores: DataFrame, path: str) -> None:
    """Scores, detail rows and cluster mapping of every pair of combinations."""
    scores.write.mode("overwrite").parquet(f"{path}/overlap")
    detail.write.mode("overwrite").parquet(f"{path}/overlap_detail")
    mapping = detail.groupBy("base", "other", "leader_a").agg(F.sort_array(F.collect_set("leader_c")).alias("leaders_c"))
    mapping.write.mode("overwrite").parquet(f"{path}/overlap_mapping")


def save_cluster_info(best: DataFrame, sizes: DataFrame, path: str) -> None:
    """Best scalars and cluster sizes in descending order."""
    best.write.mode("overwrite").csv(f"{path}/best", header=True)
    sizes.orderBy("combo", F.desc("size"), "leader").write.mode("overwrite").csv(f"{path}/sizes", header=True)


def save_report(report: DataFrame, path: str) -> None:
    """Neighbour report with one row per entity."""
    report.write.mode("overwrite").csv(path, header=True)


def save_similarities(pairs: DataFrame, path: str) -> None:
    """Similarities restricted to the evaluated entities."""
    pairs.write.mode("overwrite").csv(path, header=True)
