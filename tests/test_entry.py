import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["url_owner_key", "last_label", "char_jaccard", "align_union_anchor", "normalize_stats", "leader_labels", "overlap_matrix", "hausdorff_exact", "topk_report", "adjusted_rand", "symmetric_cells", "singleton_ratio", "permutation_p", "kmeans_points", "levenshtein_pairs", "hash3d_cosine", "stage_statistics", "pair_files", "pair_files_rejected", "url_pair_files", "wide_matrix", "positional_matrix", "entity_list", "label_file", "vector_file", "loaded_sources", "cached_sources", "appended_results", "saved_runs", "saved_clusters", "saved_overlap", "saved_cluster_info"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value + 0.0, 6)
    return value


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(str(plain(r[c])) for c in columns) for r in df.collect())
    found = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = sorted(tuple(str(plain(dict(zip(names, r))[c])) for c in columns) for r in found.fetchall())
    assert got == expected


def test_registration():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    own = {q for q in entry.queries() if q not in entry.LLM_QUERIES}
    assert own - set(entry.oracle_sql()) == {"distance_embedding", "permutation_p_nonzero", "kmeans_labels", "kmeans_scores"}
