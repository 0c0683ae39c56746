"""SQL with the meaning of every query of ``roundtrip``, on the tables that were written."""

from __future__ import annotations

from simlattice.plans import demo_sql
from simlattice.plans.demo_sql import LINKS, PAIRS, _with

ORACLES: dict[str, str] = {}

LINK_PAIRS = """SELECT 'links' AS source, least(a, b) AS id1, greatest(a, b) AS id2, round(max_by(1.0::DOUBLE / (1 + days), (cents, days)), 6) AS similarity FROM (
  SELECT CAST(id1 AS VARCHAR) AS a, CAST(id2 AS VARCHAR) AS b, days, cents FROM links WHERE days <> 0 AND cents % 10 <> 0) GROUP BY 2, 3"""
TRADE = """trade AS (
  SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"""
SQUARE = """SELECT {source} AS source, least(x.n_name, y.n_name) AS id1, greatest(x.n_name, y.n_name) AS id2, CAST(n AS DOUBLE) AS similarity
FROM trade JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b WHERE {cells} AND (a + b) % 7 <> 0"""
WIDE = "a <= b AND a * b % 11 <> 5"

ORACLES["pair_files"] = _with(LINKS, LINK_PAIRS)
ORACLES["pair_files_rejected"] = _with(
    LINKS, "SELECT CASE WHEN cents % 10 = 0 THEN 'fields' ELSE 'number' END AS reason, count(*) AS n FROM links WHERE cents % 10 = 0 OR days = 0 GROUP BY 1"
)
ORACLES["url_pair_files"] = _with(
    [f"keys AS ({demo_sql.ORACLES['url_owner_key']})", "named AS (SELECT page_id, trim(owner_key) AS owner_key FROM keys JOIN pages USING (page_id) WHERE url <> '')"],
    """SELECT p.owner_key AS id1, q.owner_key AS id2, round(1.0::DOUBLE / (1 + p.page_id % 97), 6) AS similarity
FROM named p JOIN named q ON q.page_id = p.page_id + 1""",
)
ORACLES["wide_matrix"] = _with([TRADE], SQUARE.format(source="'named'", cells=WIDE) + " UNION ALL " + SQUARE.format(source="'indexed'", cells=WIDE))
ORACLES["positional_matrix"] = _with([TRADE], SQUARE.format(source="'trade'", cells="a >= b"))
ORACLES["entity_list"] = "SELECT s_name AS id FROM supplier WHERE s_suppkey % 10 <> 0"
ORACLES["label_file"] = demo_sql.ORACLES["last_label"]
ORACLES["vector_file"] = """SELECT CAST(vec_id AS VARCHAR) AS id, CAST(len(embedding) AS INTEGER) AS dims,
  CAST(list_sum(list_transform(embedding, lambda x, i: CAST(floor(CAST(x AS DOUBLE) * 1e6) AS BIGINT) * i)) AS BIGINT) AS mark FROM embeddings"""
ORACLES["loaded_sources"] = _with([*LINKS, TRADE], f"({LINK_PAIRS}) UNION ALL ({SQUARE.format(source=chr(39) + 'trade' + chr(39), cells=WIDE)})")
ORACLES["cached_sources"] = ORACLES["appended_results"] = _with(PAIRS, "SELECT source, id1, id2, round(similarity, 6) AS similarity FROM pairs")
ORACLES["saved_distances"] = demo_sql.ORACLES["vector_distances"]
ORACLES["saved_runs"] = f"SELECT 'Run ' || row_number() OVER (ORDER BY combo) AS run_id, * FROM ({demo_sql.ORACLES['combination_stats']})"
ORACLES["saved_clusters"] = f"""SELECT *, CASE WHEN step IS NOT NULL THEN n_clusters END AS leaders FROM ({demo_sql.ORACLES['best_thresholds']})"""
ORACLES["saved_overlap"] = demo_sql.ORACLES["overlap_details"]
ORACLES["saved_cluster_info"] = demo_sql.ORACLES["largest_clusters"]
ORACLES["saved_report"] = demo_sql.ORACLES["topk_report"]
ORACLES["saved_similarities"] = demo_sql.ORACLES["restrict_pairs"]
