"""All operators as queries over the given tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlattice.functions import numeric, text
from simlattice.operators import compare, distribution, evaluate, kmeans, matrix, neighbors, overlap, similarity
from simlattice.operators.align import align, align_report, align_to_anchor, restrict, sample_ids, shared_entities
from simlattice.operators.combine import combine_distances, combo_stats, source_combinations, threshold_range, threshold_table
from simlattice.operators.embed import distance_planes, kmeans_clusters
from simlattice.operators.leader import cluster_sizes, leader_clusters, number_clusters
from simlattice.operators.matrix import Matrices, build_matrices
from simlattice.operators.medoid import medoids
from simlattice.operators.normalize import normalize, positive_range, stage_stats, to_distance, value_stats, with_background
from simlattice.operators.silhouette import cluster_counts
from simlattice.plans.comparison import cluster_combinations, compare_sources, source_distances
from simlattice.plans.evaluation import evaluate_sources
from simlattice.plans.evaluation import evaluate as evaluate_job
from simlattice.runtime import cut
from simlattice.sources.files import last_labels
from simlattice.sources.tables import SUPPLIER_SOURCES, supplier_links, supplier_matrices

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Thresholds of the similarity joins over page addresses and vectors.
URL_LEVENSHTEIN, URL_COSINE, URL_JACCARD = 0.75, 0.95, 0.8
HASH_COSINE, HASH_MINKOWSKI, VECTOR = 0.995, 0.7, 0.45
KMEANS = {"k": 5, "seed": 42, "starts": 3, "rounds": 15, "tolerance": 0.0}


def query(build):
    QUERIES[build.__name__] = build
    return build


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _suppliers(spark, sf_dir):
    return align(supplier_matrices(spark, sf_dir), SUPPLIER_SOURCES)


def _normal(spark, sf_dir):
    return normalize(_suppliers(spark, sf_dir))[0]


def _distances(spark, sf_dir):
    return to_distance(_normal(spark, sf_dir))


def _combined(spark, sf_dir, low=1, high=3):
    d = _distances(spark, sf_dir)
    return combine_distances(d, source_combinations(d.sources, low, high))


def _urls(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select(F.col("url").alias("id"))


def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _vector_labels(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")


def _link_rows(spark, sf_dir):
    """Every link as a raw pair row; the similarity of the last one in this order counts."""
    links = supplier_links(spark, sf_dir)
    return links.select(
        F.lit("links").alias("source"), F.col("id2").alias("id1"), F.col("id1").alias("id2"),
        (1.0 / (1 + F.col("days"))).alias("similarity"), F.struct("cents", "days").alias("seq"),
    )


# Sources and text functions


@query
def url_owner_key(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.owner_repo(F.col("url")).alias("owner_key"))


@query
def vowel_letter_count(spark, sf_dir):
    name = F.col("p_name")
    return _table(spark, sf_dir, "part").select("p_partkey", text.vowel_count(name).alias("vowels"), text.letter_count(name).alias("letters"))


@query
def hash_coordinates(spark, sf_dir):
    p = text.hash_point(F.col("url"))
    return _table(spark, sf_dir, "pages").select("page_id", *[F.round(p[i].cast("double"), 3).alias(c) for i, c in enumerate("xyz")])


@query
def clean_values(spark, sf_dir):
    raw = F.col("l_extendedprice") / F.nullif(F.col("l_linenumber") - 4, F.lit(0))
    broken = F.when(F.col("l_linenumber") == 1, F.lit(float("inf"))).when(F.col("l_linenumber") == 2, F.lit(float("nan"))).otherwise(raw)
    rows = _table(spark, sf_dir, "lineitem").select("l_linenumber", numeric.finite(broken).alias("v"))
    cents = F.round(F.col("v") * 100).cast("long")
    return rows.groupBy("l_linenumber").agg(F.count(F.when(F.col("v") != 0, 1)).alias("kept"), F.sum(cents).cast("long").alias("cents"))


@query
def log_values(spark, sf_dir):
    v = F.col("s_acctbal")
    shifted = F.when(v > 0, numeric.log_shifted(v))
    return _six(
        _table(spark, sf_dir, "supplier").select("s_suppkey", shifted.alias("log_shifted"), F.when(v > 0, F.log1p(v)).alias("log_plus_one")),
        "log_shifted", "log_plus_one",
    )


@query
def rename_labels(spark, sf_dir):
    names = {"en": "English", "fr": "French"}
    rows = _table(spark, sf_dir, "documents").select(text.rename(names, F.col("lang")).alias("language"))
    return rows.groupBy("language").agg(F.count("*").alias("n"))


@query
def last_label(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(F.col("source").alias("id"), F.col("lang").alias("label"), F.col("doc_id").alias("line"))
    return last_labels(rows)


@query
def build_matrix(spark, sf_dir):
    return _six(build_matrices(_link_rows(spark, sf_dir)).pairs, "similarity")


# Similarity joins


@query
def levenshtein_pairs(spark, sf_dir):
    return _six(similarity.levenshtein_pairs(_urls(spark, sf_dir), URL_LEVENSHTEIN), "similarity")


@query
def charcount_cosine(spark, sf_dir):
    return _six(similarity.charcount_pairs(_urls(spark, sf_dir), URL_COSINE), "similarity")


@query
def hash3d_minkowski(spark, sf_dir):
    return similarity.hash_minkowski_pairs(_urls(spark, sf_dir), HASH_MINKOWSKI)


@query
def hash3d_cosine(spark, sf_dir):
    return similarity.hash_cosine_pairs(_urls(spark, sf_dir), HASH_COSINE)


@query
def char_jaccard(spark, sf_dir):
    return similarity.char_jaccard_pairs(_urls(spark, sf_dir), URL_JACCARD)


@query
def vector_similarity(spark, sf_dir):
    return _six(similarity.vector_pairs(_vectors(spark, sf_dir), VECTOR), "similarity")


# Matrices and alignment


@query
def symmetrize(spark, sf_dir):
    rows = build_matrices(_link_rows(spark, sf_dir)).pairs
    return _six(matrix.symmetrize(rows), "similarity")


@query
def symmetric_cells(spark, sf_dir):
    pairs = supplier_matrices(spark, sf_dir).pairs
    return matrix.mirrored(pairs, "source", "similarity").groupBy("source", "id").agg(
        F.count("*").alias("neighbors"), (F.sum(F.round(F.col("similarity") * 1e6).cast("long")) / 1e6).alias("total")
    )


@query
def upper_aligned(spark, sf_dir):
    return _six(matrix.upper_aligned(supplier_matrices(spark, sf_dir).pairs, "pace", "alike", filter_zeros=True), "a", "b")


@query
def align_common(spark, sf_dir):
    return _six(_suppliers(spark, sf_dir).pairs, "similarity")


@query
def align_sampled(spark, sf_dir):
    return _six(align(supplier_matrices(spark, sf_dir), SUPPLIER_SOURCES, size=7).pairs, "similarity")


@query
def sample_entities(spark, sf_dir):
    return sample_ids(_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), 7)


def _partial(spark, sf_dir) -> Matrices:
    """Links per return flag of nations' suppliers: sources over different suppliers."""
    data = supplier_matrices(spark, sf_dir)
    nations = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey")
    kept = {"follow": F.col("s_nationkey") >= 5, "pace": F.col("s_nationkey") < 20, "alike": F.col("s_nationkey") != 10}
    ids = data.ids.join(nations, "id")
    keep = F.lit(False)
    for s, c in kept.items():
        keep = keep | ((F.col("source") == s) & c)
    ids = ids.filter(keep).select("source", "id")
    ends = [ids.select("source", F.col("id").alias(c)) for c in ("id1", "id2")]
    pairs = data.pairs.join(ends[0], ["source", "id1"], "left_semi").join(ends[1], ["source", "id2"], "left_semi")
    return Matrices(cut(pairs.select("source", "id1", "id2", "similarity")), cut(ids))


@query
def align_union_anchor(spark, sf_dir):
    return _six(align_to_anchor(_partial(spark, sf_dir), ["follow", "pace", "alike"], "follow").pairs, "similarity")


@query
def alignment_report(spark, sf_dir):
    data = _partial(spark, sf_dir)
    return align_report(data, align_to_anchor(data, ["follow", "pace", "alike"], "follow"))


@query
def entity_intersection(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    known = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").cast("string").alias("label"))
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return shared_entities(docs, known, vectors, labels=known, exclude="1")


@query
def restrict_pairs(spark, sf_dir):
    rich = _table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("id"))
    return _six(restrict(supplier_matrices(spark, sf_dir).pairs, rich), "similarity")


# Normalization, distances, combinations


@query
def normalize_stats(spark, sf_dir):
    stats = normalize(_suppliers(spark, sf_dir))[1]
    return _six(stats, "lower", "upper", "mean", "std", "zmin", "zmax", "crop_ratio")


@query
def normalize_zscore(spark, sf_dir):
    return _six(_normal(spark, sf_dir).pairs, "similarity")


@query
def normalize_log(spark, sf_dir):
    aligned = normalize(_suppliers(spark, sf_dir), use_log=True, iqr_multiplier=1.0, mapping=lambda x: x / (1 + F.abs(x)))[0]
    return _six(aligned.pairs, "similarity")


@query
def value_statistics(spark, sf_dir):
    return _six(value_stats(_suppliers(spark, sf_dir)), "min_value", "max_value", "mean_value", "std_value", "median_value")


@query
def stage_statistics(spark, sf_dir):
    """A row per source, stage of the normalization and bin."""
    rows = stage_stats(_suppliers(spark, sf_dir))
    numbers = [c for c in rows.columns if c != "histogram"]
    bars = rows.select(*numbers, F.posexplode("histogram").alias("bin", "bar")).select(*numbers, "bin", "bar.low", "bar.high", "bar.frequency")
    return _six(bars, *numbers[2:], "low", "high")


@query
def distance_summary(spark, sf_dir):
    return _six(positive_range(_distances(spark, sf_dir)), "min_value", "max_value", "mean_value")


@query
def vector_distances(spark, sf_dir):
    v = _combined(spark, sf_dir).vectors
    return v.select("combo", "id1", "id2", F.size("dists").alias("dims"), "d")


@query
def weighted_distances(spark, sf_dir):
    d = _distances(spark, sf_dir)
    combos = {"all": tuple(SUPPLIER_SOURCES)}
    v = combine_distances(d, combos, weights={"follow": 0.5, "pace": 2.0, "worth": 1.0, "alike": 0.25}).vectors
    return v.select("combo", "id1", "id2", "d")


@query
def combination_stats(spark, sf_dir):
    return _six(combo_stats(_combined(spark, sf_dir)), "min_distance", "mean_distance", "max_distance")


@query
def threshold_ranges(spark, sf_dir):
    combined = _combined(spark, sf_dir)
    return _six(threshold_table(combined, threshold_range(combined)), "t1", "skewness")


# Clustering


@query
def leader_labels(spark, sf_dir):
    combined = _combined(spark, sf_dir)
    return number_clusters(leader_clusters(combined, threshold_range(combined)))


def _clustered(spark, sf_dir):
    return cluster_combinations(_distances(spark, sf_dir))


@query
def silhouette_sweep(spark, sf_dir):
    return _six(_clustered(spark, sf_dir).sweep, "t1", "silhouette")


@query
def best_thresholds(spark, sf_dir):
    return _six(_clustered(spark, sf_dir).best, "t1", "silhouette", "single_point_ratio")


@query
def largest_clusters(spark, sf_dir):
    combined = _combined(spark, sf_dir)
    return cluster_sizes(leader_clusters(combined, threshold_range(combined)))


@query
def singleton_ratio(spark, sf_dir):
    combined = _combined(spark, sf_dir)
    return _six(cluster_counts(leader_clusters(combined, threshold_range(combined))), "single_point_ratio")


@query
def cluster_medoids(spark, sf_dir):
    done = _clustered(spark, sf_dir)
    return medoids(done.combined, done.labels)


@query
def first_medoids(spark, sf_dir):
    done = _clustered(spark, sf_dir)
    return medoids(done.combined, done.labels, relative=0.0, absolute=1e-12)


@query
def distance_embedding(spark, sf_dir):
    done = _clustered(spark, sf_dir)
    return distance_planes(done.combined, done.labels)


# Overlap


@query
def overlap_details(spark, sf_dir):
    done = _clustered(spark, sf_dir)
    detail = overlap.overlap_detail(done.combined, done.labels, overlap.nested_pairs(done.combined.combos))
    return _six(detail, "score")


@query
def overlap_matrix(spark, sf_dir):
    rows = compare_sources(supplier_matrices(spark, sf_dir), SUPPLIER_SOURCES)
    return _six(rows, "base_silhouette", "compared_with_silhouette", "overlap_ratio", "filtered_overlap_ratio")


# Comparison of sources and distributions


@query
def spearman_rho(spark, sf_dir):
    return _six(compare.spearman(_normal(spark, sf_dir)), "rho")


@query
def spearman_nonzero(spark, sf_dir):
    return _six(compare.spearman(_suppliers(spark, sf_dir), sparse=True), "rho")


@query
def permutation_p(spark, sf_dir):
    return _six(compare.permutation_test(_normal(spark, sf_dir)), "rho", "p_value")


@query
def permutation_p_nonzero(spark, sf_dir):
    return _six(compare.permutation_test(_suppliers(spark, sf_dir), sparse=True), "rho", "p_value")


@query
def permutation_histogram(spark, sf_dir):
    null = compare.permutation_null(_normal(spark, sf_dir))
    rows = null.select(F.concat_ws("|", "source1", "source2").alias("source"), F.col("rho").alias("value"), F.lit(1).cast("long").alias("w"))
    return _six(distribution.histogram(cut(rows), bins=30, density=True), "low", "high", "frequency")


@query
def hausdorff_blocks(spark, sf_dir):
    return _six(compare.hausdorff(_normal(spark, sf_dir), block_size=30), "gromov")


@query
def hausdorff_exact(spark, sf_dir):
    return _six(compare.hausdorff(_normal(spark, sf_dir), block_size=None), "gromov")


@query
def hausdorff_nonzero(spark, sf_dir):
    return _six(compare.hausdorff_values(_suppliers(spark, sf_dir)), "gromov")


@query
def frobenius_rmse(spark, sf_dir):
    return _six(compare.frobenius(_normal(spark, sf_dir)), "frobenius", "rmse")


@query
def frobenius_upper(spark, sf_dir):
    return _six(compare.frobenius(_normal(spark, sf_dir), sparse=True), "frobenius", "rmse")


@query
def metric_matrix(spark, sf_dir):
    return _six(compare.metric_matrix(_normal(spark, sf_dir)), "value")


@query
def histogram_original(spark, sf_dir):
    rows = with_background(_suppliers(spark, sf_dir), "similarity")
    return _six(distribution.histogram(rows, 50, use_log=True), "low", "high")


@query
def histogram_normalized(spark, sf_dir):
    return _six(distribution.histogram(with_background(_normal(spark, sf_dir), "similarity"), 50), "low", "high")


@query
def density_curves(spark, sf_dir):
    return _six(distribution.density_curve(with_background(_normal(spark, sf_dir), "similarity")), "x", "density")


@query
def distance_distribution(spark, sf_dir):
    rows = with_background(_distances(spark, sf_dir), "distance")
    return _six(distribution.joint_distribution(rows), "low", "high", "global_min", "global_max")


# Evaluation


@query
def topk_neighbors(spark, sf_dir):
    return _six(neighbors.nearest_vectors(_vectors(spark, sf_dir)), "similarity")


@query
def topk_accuracy(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    near = neighbors.nearest_vectors(vectors)
    return _six(evaluate.topk_accuracy(near, vectors.select("id"), _vector_labels(spark, sf_dir)), "accuracy")


@query
def topk_report(spark, sf_dir):
    """Report over every labelled vector; neighbours without a label show N/A."""
    known = _vector_labels(spark, sf_dir).filter("label IS NOT NULL")
    return evaluate.topk_report(neighbors.nearest_vectors(_vectors(spark, sf_dir)), known).withColumnRenamed("acc@5", "acc_at_5")


@query
def source_neighbors(spark, sf_dir):
    aligned = _suppliers(spark, sf_dir)
    return _six(neighbors.nearest_pairs(aligned.pairs, aligned.ids), "similarity")


@query
def source_accuracy(spark, sf_dir):
    aligned = _suppliers(spark, sf_dir)
    regions = _table(spark, sf_dir, "supplier").join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    truth = regions.select(F.col("s_suppkey").alias("id"), F.col("n_regionkey").alias("label"))
    return _six(evaluate_sources(aligned.pairs, aligned.ids, truth), "accuracy")


def _label_rows(spark, sf_dir):
    """Vector labels with a cluster both engines can derive: the place of the largest value."""
    vector = F.col("embedding")
    cluster = (F.array_position(vector, F.array_max(vector)) - 1).cast("int")
    return _table(spark, sf_dir, "embeddings").select("label", cluster.alias("cluster"))


@query
def mutual_information(spark, sf_dir):
    return _six(evaluate.normalized_mutual_information(_label_rows(spark, sf_dir)), "nmi")


@query
def adjusted_rand(spark, sf_dir):
    return _six(evaluate.adjusted_rand(_label_rows(spark, sf_dir)), "ari")


@query
def macro_f1_raw(spark, sf_dir):
    return _six(evaluate.classification_scores(_label_rows(spark, sf_dir), match="raw"), "macro_f1", "accuracy")


@query
def macro_f1_majority(spark, sf_dir):
    return _six(evaluate.classification_scores(_label_rows(spark, sf_dir)), "macro_f1", "accuracy")


@query
def label_codes(spark, sf_dir):
    return evaluate.label_codes(_table(spark, sf_dir, "documents").select(F.col("lang").alias("label")))


@query
def label_distribution(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"))
    known = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return evaluate.label_distribution(docs, known)


@query
def kmeans_points(spark, sf_dir):
    """Three starts and 15 rounds over sizes and prices of parts, which SQL can follow."""
    point = F.array(F.col("p_size").cast("double"), F.col("p_retailprice") - 900)
    points = _table(spark, sf_dir, "part").select(F.lit("part").alias("key"), F.col("p_partkey").alias("id"), point.alias("point"))
    return kmeans.lloyd(points, **KMEANS).select("id", "cluster")


@query
def kmeans_labels(spark, sf_dir):
    return kmeans_clusters(_vectors(spark, sf_dir), 10)


@query
def kmeans_scores(spark, sf_dir):
    """Vectors of revenue per month and all sources, scored by the region of the supplier."""
    lines = _table(spark, sf_dir, "lineitem")
    months = [F.sum(F.when(F.month("l_shipdate") == m, F.col("l_extendedprice")).otherwise(0.0)) / 1e5 for m in range(1, 13)]
    vectors = lines.groupBy(F.col("l_suppkey").alias("id")).agg(F.array(*months).alias("vector"))
    regions = _table(spark, sf_dir, "supplier").join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    truth = regions.select(F.col("s_suppkey").alias("id"), F.col("n_regionkey").alias("label"))
    done = evaluate_job(cut(vectors), truth, supplier_matrices(spark, sf_dir), SUPPLIER_SOURCES, anchor="follow")
    return _six(done.scores, "topk_accuracy", "nmi", "ari", "macro_f1", "accuracy")
