"""ANSI SQL with the meaning of every query that SQL can express, on the same tables.

The statements spell out every pair of entities, so they check the results of
the Spark queries, which read stored pairs only.
"""

from __future__ import annotations

from itertools import combinations

from simlattice.operators import permute
from simlattice.plans import demo
from simlattice.sources.tables import SUPPLIER_SOURCES

ORACLES: dict[str, str] = {}

STEPS = 20
COMBOS = {"_".join(c): c for k in (1, 2, 3) for c in combinations(SUPPLIER_SOURCES, k)}


def _with(parts: list[str], final: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + final


def _values(rows: list[tuple], columns: str) -> str:
    def one(v) -> str:
        return f"'{v}'" if isinstance(v, str) else str(v)

    return f"(VALUES {', '.join('(' + ', '.join(one(v) for v in r) + ')' for r in rows)}) AS t({columns})"


LINKS = [
    """lines AS (
  SELECT l_partkey AS part, l_shipdate AS day, l_orderkey AS ord, l_linenumber AS line, l_suppkey AS supp,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_returnflag AS flag FROM lineitem)""",
    """nxt AS (
  SELECT *, lead(part) OVER w AS npart, lead(day) OVER w AS nday, lead(supp) OVER w AS nsupp,
         lead(cents) OVER w AS ncents, lead(flag) OVER w AS nflag
  FROM lines WINDOW w AS (ORDER BY part, day, ord, line, supp, cents, flag))""",
    """links AS (
  SELECT least(supp, nsupp) AS id1, greatest(supp, nsupp) AS id2, date_diff('day', day, nday) AS days,
         least(cents, ncents) AS cents, flag = nflag AS same
  FROM nxt WHERE npart = part AND nsupp <> supp)""",
]
PAIRS = LINKS + [
    """sums AS (
  SELECT id1, id2, count(*) AS follow, sum(CAST(floor(1e6 / (1 + days)) AS BIGINT)) AS pace, sum(cents) AS worth,
         count(*) FILTER (WHERE same) AS alike FROM links GROUP BY id1, id2)""",
    """pairs AS (
  SELECT * FROM (
    SELECT 'follow' AS source, id1, id2, CAST(follow AS DOUBLE) AS similarity FROM sums UNION ALL
    SELECT 'pace', id1, id2, CAST(pace AS DOUBLE) / 1e6 FROM sums UNION ALL
    SELECT 'worth', id1, id2, CAST(worth AS DOUBLE) / 100 FROM sums UNION ALL
    SELECT 'alike', id1, id2, CAST(alike AS DOUBLE) FROM sums) WHERE similarity <> 0)""",
    "ids AS (SELECT DISTINCT source, id FROM (SELECT source, id1 AS id FROM pairs UNION ALL SELECT source, id2 FROM pairs))",
]
GRID = PAIRS + [
    "common AS (SELECT id FROM ids GROUP BY id HAVING count(DISTINCT source) = 4)",
    "cells AS (SELECT a.id AS id1, b.id AS id2 FROM common a JOIN common b ON a.id < b.id)",
    f"sources AS (SELECT source FROM {_values([(s,) for s in SUPPLIER_SOURCES], 'source')})",
    """grid AS (
  SELECT s.source, c.id1, c.id2, coalesce(p.similarity, 0.0) AS similarity, p.id1 IS NOT NULL AS stored
  FROM cells c CROSS JOIN sources s LEFT JOIN pairs p ON p.source = s.source AND p.id1 = c.id1 AND p.id2 = c.id2)""",
]


def _normal(spread: float = 1.5, shape: str = "x") -> list[str]:
    return GRID + [
        "q AS (SELECT source, quantile_cont(similarity, 0.1) AS q1, quantile_cont(similarity, 0.9) AS q3 FROM grid GROUP BY source)",
        f"limits AS (SELECT source, q1 - {spread} * (q3 - q1) AS lower, q3 + {spread} * (q3 - q1) AS upper FROM q)",
        f"""shaped AS (
  SELECT source, id1, id2, stored, out, {shape} AS x FROM (
    SELECT g.source, id1, id2, stored, similarity < lower OR similarity > upper AS out,
           least(greatest(similarity, lower), upper) AS x FROM grid g JOIN limits USING (source)))""",
        "st AS (SELECT source, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS lo, max(x) AS hi, avg(CAST(out AS INTEGER)) AS crop_ratio FROM shaped GROUP BY source)",
        "z AS (SELECT *, (lo - mean) / (std + 1e-6) AS zmin, (hi - mean) / (std + 1e-6) AS zmax FROM st)",
        """norm AS (
  SELECT source, id1, id2, stored, ((x - mean) / (std + 1e-6) - zmin) / (zmax - zmin + 1e-6) AS similarity
  FROM shaped JOIN z USING (source))""",
        "dist AS (SELECT source, id1, id2, stored, 1 - similarity AS distance FROM norm)",
    ]


NORMAL = _normal()
COMBINED = NORMAL + [
    f"combos AS (SELECT combo, source, dims FROM {_values([(n, s, len(c)) for n, c in COMBOS.items() for s in c], 'combo, source, dims')})",
    """vectors AS (
  SELECT combo, id1, id2, any_value(dims) AS dims, bool_or(stored) AS stored,
         round(CASE WHEN any_value(dims) = 1 THEN max(distance) ELSE sqrt(sum(distance * distance)) END, 8) AS d
  FROM dist JOIN combos USING (source) GROUP BY combo, id1, id2)""",
]


def _thresholds(steps: int = STEPS) -> list[str]:
    return COMBINED + [
        "spread AS (SELECT combo, any_value(dims) AS dims, avg(d) AS m, stddev_pop(d) AS s, min(d) AS lo, max(d) AS hi, count(*) AS n, avg(d) AS m1 FROM vectors GROUP BY combo)",
        "ends AS (SELECT combo, dims, greatest(m - 3 * s, lo) AS a, least(m + 3 * s, hi) AS b FROM spread)",
        f"""t1s AS (
  SELECT combo, dims, CAST(step AS INTEGER) AS step, round(CASE WHEN step = {steps - 1} THEN b ELSE a + step * ((b - a) / {steps - 1}) END, 8) AS t1
  FROM ends CROSS JOIN range({steps}) AS r(step))""",
    ]


def _leaders(steps: int = STEPS) -> list[str]:
    """Clusters by walking the entities in order with the list of leaders so far."""
    return _thresholds(steps) + [
        "ord AS (SELECT id, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id) AS pos FROM common)",
        "two_way AS (SELECT combo, id1 AS id, id2 AS nbr, d FROM vectors UNION ALL SELECT combo, id2, id1, d FROM vectors)",
        """visit AS (
  SELECT t.combo, t.step, o.pos, o.id, coalesce(list(b.nbr) FILTER (WHERE b.d <= t.t1 AND e.pos < o.pos), CAST([] AS BIGINT[])) AS nbrs
  FROM t1s t JOIN two_way b ON b.combo = t.combo JOIN ord o ON o.id = b.id JOIN ord e ON e.id = b.nbr
  GROUP BY t.combo, t.step, o.pos, o.id)""",
        """walk AS (
  SELECT combo, step, CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS leaders FROM t1s
  UNION ALL
  SELECT w.combo, w.step, w.pos + 1, CASE WHEN list_has_any(w.leaders, v.nbrs) THEN w.leaders ELSE list_append(w.leaders, v.id) END
  FROM walk w JOIN visit v ON v.combo = w.combo AND v.step = w.step AND v.pos = w.pos + 1)""",
        "last AS (SELECT combo, step, leaders FROM walk WHERE pos = (SELECT count(*) FROM common))",
        "opened AS (SELECT combo, step, unnest(leaders) AS leader, generate_subscripts(leaders, 1) AS label FROM last)",
        """clusters AS (
  SELECT combo, step, id, min_by(leader, label) AS leader, CAST(min(label) AS INTEGER) AS label FROM (
    SELECT o.combo, o.step, o.leader AS id, o.leader, o.label FROM opened o UNION ALL
    SELECT o.combo, o.step, b.id, o.leader, o.label FROM opened o
    JOIN t1s t ON t.combo = o.combo AND t.step = o.step
    JOIN two_way b ON b.combo = o.combo AND b.nbr = o.leader AND b.d <= t.t1) GROUP BY combo, step, id)""",
        "sizes AS (SELECT combo, step, leader, count(*) AS size FROM clusters GROUP BY combo, step, leader)",
        "counts AS (SELECT combo, step, count(*) AS n_clusters, avg(CAST(size = 1 AS INTEGER)) AS single_point_ratio FROM sizes GROUP BY combo, step)",
    ]


def _best() -> list[str]:
    return _leaders() + [
        """to_cluster AS (
  SELECT c.combo, c.step, c.id, c.leader, o.leader AS other, avg(b.d) AS mean, median(b.d) AS med
  FROM clusters c JOIN two_way b ON b.combo = c.combo AND b.id = c.id
  JOIN clusters o ON o.combo = c.combo AND o.step = c.step AND o.id = b.nbr
  GROUP BY c.combo, c.step, c.id, c.leader, o.leader)""",
        """point AS (
  SELECT combo, step, id, coalesce(max(mean) FILTER (WHERE leader = other), 0.0) AS a, min(med) FILTER (WHERE leader <> other) AS b
  FROM to_cluster GROUP BY combo, step, id)""",
        """scores AS (
  SELECT combo, step, avg(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0.0 END) AS silhouette, any_value(n_clusters) AS n_clusters
  FROM point JOIN counts USING (combo, step) WHERE n_clusters >= 2 GROUP BY combo, step)""",
        """swept AS (
  SELECT combo, step, t1, silhouette, n_clusters,
         row_number() OVER (PARTITION BY combo ORDER BY round(silhouette, 10) DESC, step) = 1 AND round(silhouette, 10) > -1 AS is_best
  FROM scores JOIN t1s USING (combo, step))""",
        "best AS (SELECT s.combo, s.step, s.t1, s.silhouette, s.n_clusters, c.single_point_ratio FROM swept s JOIN counts c USING (combo, step) WHERE is_best)",
        "labels AS (SELECT c.combo, c.id, c.leader FROM clusters c JOIN best USING (combo, step))",
    ]


def _medoids(relative: float, absolute: float) -> str:
    return f"""SELECT combo, leader, min(id) AS medoid, any_value(size) AS size FROM (
  SELECT *, min(mean) OVER (PARTITION BY combo, leader) AS least FROM (
    SELECT l.combo, l.leader, l.id, coalesce(sum(b.d), 0.0) / any_value(n.size) AS mean, any_value(n.size) AS size
    FROM labels l JOIN (SELECT combo, leader, count(*) AS size FROM labels GROUP BY combo, leader) n USING (combo, leader)
    LEFT JOIN (SELECT b.combo, b.id, b.nbr, b.d, l2.leader FROM two_way b JOIN labels l2 ON l2.combo = b.combo AND l2.id = b.nbr) b
      ON b.combo = l.combo AND b.id = l.id AND b.leader = l.leader
    GROUP BY l.combo, l.leader, l.id))
WHERE mean - least <= {absolute} + {relative} * abs(least) GROUP BY combo, leader"""


def _overlap() -> list[str]:
    nested = [
        (a, b) for a, x in COMBOS.items() for b, y in COMBOS.items() if a != b and (set(x) <= set(y) or set(y) <= set(x))
    ]
    return _best() + [
        f"nested AS (SELECT base, other FROM {_values(nested, 'base, other')})",
        """placed AS (
  SELECT DISTINCT base, base AS other FROM nested UNION ALL SELECT base, other FROM nested)""",
        "member AS (SELECT p.base, p.other, l.id, l.leader FROM placed p JOIN labels l ON l.combo = p.other)",
        "msize AS (SELECT base, other, leader, count(*) AS size FROM member GROUP BY base, other, leader)",
        """inside AS (
  SELECT m.base, m.other, m.leader, m.id, sum(b.d) AS total FROM member m
  JOIN two_way b ON b.combo = m.base AND b.id = m.id
  JOIN member o ON o.base = m.base AND o.other = m.other AND o.id = b.nbr AND o.leader = m.leader
  GROUP BY m.base, m.other, m.leader, m.id)""",
        """mmean AS (
  SELECT m.base, m.other, m.leader, m.id, s.size, coalesce(i.total, 0.0) / s.size AS mean
  FROM member m JOIN msize s USING (base, other, leader) LEFT JOIN inside i USING (base, other, leader, id))""",
        """medoid AS (
  SELECT base, other, leader, min(id) AS medoid FROM (SELECT *, min(mean) OVER (PARTITION BY base, other, leader) AS least FROM mmean)
  WHERE mean - least <= 1e-8 + 1e-5 * abs(least) GROUP BY base, other, leader)""",
        "firsts AS (SELECT base, leader, min(id) AS first_id FROM member WHERE base = other GROUP BY base, leader)",
        """mapping AS (
  SELECT base, other, leader_c, min_by(leader_a, (d, first_id)) AS leader_a FROM (
    SELECT c.base, c.other, c.leader AS leader_c, a.leader AS leader_a, f.first_id,
           CASE WHEN c.medoid = a.medoid THEN 0.0 ELSE b.d END AS d
    FROM medoid c JOIN medoid a ON a.base = c.base AND a.other = c.base AND c.other <> c.base
    JOIN firsts f ON f.base = a.base AND f.leader = a.leader
    LEFT JOIN two_way b ON b.combo = c.base AND b.id = c.medoid AND b.nbr = a.medoid) GROUP BY base, other, leader_c)""",
        """detail AS (
  SELECT m.base, m.other, m.leader_a, m.leader_c,
         (SELECT count(*) FROM labels x JOIN labels y ON x.id = y.id WHERE x.combo = m.base AND x.leader = m.leader_a AND y.combo = m.other AND y.leader = m.leader_c) AS shared,
         a.size AS size_a, c.size AS size_c
  FROM mapping m JOIN msize a ON a.base = m.base AND a.other = m.base AND a.leader = m.leader_a
  JOIN msize c ON c.base = m.base AND c.other = m.other AND c.leader = m.leader_c)""",
        "scored AS (SELECT *, CAST(shared AS DOUBLE) / size_c AS score, shared = 1 AND size_a = 1 AND size_c = 1 AS lone FROM detail)",
    ]


# Sources and text functions

ORACLES["url_owner_key"] = """
SELECT page_id, CASE WHEN stop > start THEN substring(url, start + 1, stop - start) ELSE '' END AS owner_key FROM (
  SELECT page_id, url,
         CASE WHEN strpos(back, '.') > 0 THEN length(url) - strpos(back, '.') ELSE greatest(length(url) - 1, 0) END AS stop,
         CASE WHEN s1 > 0 AND strpos(substring(back, s1 + 1), '/') > 0
              THEN length(url) - (s1 + strpos(substring(back, s1 + 1), '/')) + 1 ELSE 0 END AS start
  FROM (SELECT page_id, url, reverse(url) AS back, strpos(reverse(url), '/') AS s1 FROM pages))"""
ORACLES["vowel_letter_count"] = r"""
SELECT p_partkey, CAST(length(regexp_replace(p_name, '[^aeiouAEIOU]', '', 'g')) AS INTEGER) AS vowels,
       CAST(length(regexp_replace(p_name, '\P{L}', '', 'g')) AS INTEGER) AS letters FROM part"""
HASHED = """
  SELECT page_id, url, CAST(CAST(('0x' || substring(h, 1, 8)) AS BIGINT) % 1000 / 1000.0 AS FLOAT) AS x,
         CAST(CAST(('0x' || substring(h, 9, 8)) AS BIGINT) % 1000 / 1000.0 AS FLOAT) AS y,
         CAST(CAST(('0x' || substring(h, 17, 8)) AS BIGINT) % 1000 / 1000.0 AS FLOAT) AS z
  FROM (SELECT page_id, url, sha256(url) AS h FROM pages)"""
ORACLES["hash_coordinates"] = f"""
SELECT page_id, round(CAST(x AS DOUBLE), 3) AS x, round(CAST(y AS DOUBLE), 3) AS y, round(CAST(z AS DOUBLE), 3) AS z FROM ({HASHED})"""
ORACLES["clean_values"] = """
SELECT l_linenumber, count(*) FILTER (WHERE v <> 0) AS kept, CAST(sum(CAST(round(v * 100) AS BIGINT)) AS BIGINT) AS cents FROM (
  SELECT l_linenumber, CASE WHEN l_linenumber IN (1, 2, 4) THEN 0.0 ELSE l_extendedprice / (l_linenumber - 4) END AS v FROM lineitem)
GROUP BY l_linenumber"""
ORACLES["log_values"] = """
SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN round(ln(s_acctbal + 1e-6), 6) END AS log_shifted,
       CASE WHEN s_acctbal > 0 THEN round(ln(1 + s_acctbal), 6) END AS log_plus_one FROM supplier"""
ORACLES["rename_labels"] = """
SELECT CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE lang END AS language, count(*) AS n FROM documents GROUP BY 1"""
ORACLES["last_label"] = "SELECT source AS id, max_by(lang, doc_id) AS label FROM documents GROUP BY source"
ORACLES["build_matrix"] = _with(
    LINKS,
    "SELECT 'links' AS source, id1, id2, round(max_by(1.0::DOUBLE / (1 + days), (cents, days)), 6) AS similarity FROM links GROUP BY id1, id2",
)

# Similarity joins: all pairs compared

ORACLES["levenshtein_pairs"] = f"""
SELECT id1, id2, round(s, 6) AS similarity FROM (
  SELECT a.url AS id1, b.url AS id2, 1 - CAST(levenshtein(a.url, b.url) AS DOUBLE) / greatest(length(a.url), length(b.url)) AS s
  FROM pages a JOIN pages b ON a.url < b.url) WHERE s >= {demo.URL_LEVENSHTEIN}"""
ORACLES["charcount_cosine"] = f"""
WITH c AS (SELECT url, ch, CAST(count(*) AS DOUBLE) AS n FROM (SELECT url, unnest(string_split(lower(url), '')) AS ch FROM pages) GROUP BY url, ch),
w AS (SELECT url, ch, n / sqrt(sum(n * n) OVER (PARTITION BY url)) AS n FROM c)
SELECT a.url AS id1, b.url AS id2, round(sum(a.n * b.n), 6) AS similarity
FROM w a JOIN w b ON a.ch = b.ch AND a.url < b.url GROUP BY a.url, b.url HAVING sum(a.n * b.n) >= {demo.URL_COSINE}"""
ORACLES["hash3d_minkowski"] = f"""
WITH p AS ({HASHED}),
d AS (SELECT a.url AS id1, b.url AS id2, pow(pow(abs(CAST(a.x AS DOUBLE) - b.x), 3) + pow(abs(CAST(a.y AS DOUBLE) - b.y), 3) + pow(abs(CAST(a.z AS DOUBLE) - b.z), 3), 1.0 / 3) AS d
      FROM p a JOIN p b ON a.url < b.url),
m AS (SELECT max(d) AS longest FROM d)
SELECT id1, id2, round(exp(-5 * d / longest), 4) AS similarity FROM d, m WHERE exp(-5 * d / longest) >= {demo.HASH_MINKOWSKI}"""
ORACLES["hash3d_cosine"] = f"""
WITH p AS (SELECT url, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM ({HASHED}))
SELECT id1, id2, round(s, 4) AS similarity FROM (
  SELECT a.url AS id1, b.url AS id2, (a.x * b.x + a.y * b.y + a.z * b.z) / (sqrt(a.x * a.x + a.y * a.y + a.z * a.z) * sqrt(b.x * b.x + b.y * b.y + b.z * b.z)) AS s
  FROM p a JOIN p b ON a.url < b.url) WHERE s >= {demo.HASH_COSINE}"""
ORACLES["char_jaccard"] = f"""
WITH c AS (SELECT url, list_distinct(string_split(url, '')) AS cs FROM pages)
SELECT id1, id2, round(s, 4) AS similarity FROM (
  SELECT a.url AS id1, b.url AS id2, CAST(len(list_intersect(a.cs, b.cs)) AS DOUBLE) / len(list_distinct(list_concat(a.cs, b.cs))) AS s
  FROM c a JOIN c b ON a.url < b.url) WHERE s >= {demo.URL_JACCARD}"""
ORACLES["vector_similarity"] = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT id1, id2, round(s, 6) AS similarity FROM (
  SELECT a.vec_id AS id1, b.vec_id AS id2, 1 / (1 + list_distance(a.e, b.e)) AS s FROM v a JOIN v b ON a.vec_id < b.vec_id) WHERE s >= {demo.VECTOR}"""

# Matrices and alignment

ORACLES["symmetrize"] = _with(
    LINKS,
    "SELECT 'links' AS source, id1, id2, round(max_by(1.0::DOUBLE / (1 + days), (cents, days)) / 2, 6) AS similarity FROM links GROUP BY id1, id2",
)
ORACLES["symmetric_cells"] = _with(
    PAIRS,
    """SELECT source, id, count(*) AS neighbors, sum(CAST(round(similarity * 1e6) AS BIGINT)) / 1e6 AS total FROM (
  SELECT source, id1 AS id, similarity FROM pairs UNION ALL SELECT source, id2, similarity FROM pairs) GROUP BY source, id""",
)
ORACLES["upper_aligned"] = _with(
    PAIRS,
    """SELECT x.id1, x.id2, round(x.similarity, 6) AS a, round(y.similarity, 6) AS b FROM pairs x JOIN pairs y
  ON x.source = 'pace' AND y.source = 'alike' AND x.id1 = y.id1 AND x.id2 = y.id2""",
)
ORACLES["align_common"] = _with(
    PAIRS + [GRID[len(PAIRS)]],
    """SELECT source, id1, id2, round(similarity, 6) AS similarity FROM pairs
WHERE id1 IN (SELECT id FROM common) AND id2 IN (SELECT id FROM common)""",
)
ORACLES["align_sampled"] = _with(
    PAIRS + [GRID[len(PAIRS)], "picked AS (SELECT id FROM common ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id LIMIT 7)"],
    """SELECT source, id1, id2, round(similarity, 6) AS similarity FROM pairs
WHERE id1 IN (SELECT id FROM picked) AND id2 IN (SELECT id FROM picked)""",
)
ORACLES["sample_entities"] = "SELECT s_suppkey AS id FROM supplier ORDER BY md5(CAST(s_suppkey AS VARCHAR) || ':42'), s_suppkey LIMIT 7"
PARTIAL = PAIRS + [
    """pids AS (
  SELECT source, id FROM ids JOIN supplier ON s_suppkey = id
  WHERE (source = 'follow' AND s_nationkey >= 5) OR (source = 'pace' AND s_nationkey < 20) OR (source = 'alike' AND s_nationkey <> 10))""",
    """full_ids AS (
  SELECT id FROM pids WHERE source = 'follow' UNION
  SELECT id FROM pids WHERE source IN ('pace', 'alike') GROUP BY id HAVING count(DISTINCT source) = 2)""",
]
ORACLES["align_union_anchor"] = _with(
    PARTIAL,
    """SELECT p.source, id1, id2, round(similarity, 6) AS similarity FROM pairs p
JOIN pids a ON a.source = p.source AND a.id = id1 JOIN pids b ON b.source = p.source AND b.id = id2
WHERE id1 IN (SELECT id FROM full_ids) AND id2 IN (SELECT id FROM full_ids)""",
)
ORACLES["alignment_report"] = _with(
    PARTIAL,
    """SELECT source, count(*) AS total, (SELECT count(*) FROM full_ids) - count(f.id) AS missing
FROM pids p LEFT JOIN full_ids f ON f.id = p.id GROUP BY source""",
)
ORACLES["entity_intersection"] = """
SELECT doc_id AS id FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic <> 1 INTERSECT SELECT vec_id FROM embeddings"""
ORACLES["restrict_pairs"] = _with(
    PAIRS + ["rich AS (SELECT s_suppkey AS id FROM supplier WHERE s_acctbal > 5000)"],
    """SELECT source, id1, id2, round(similarity, 6) AS similarity FROM pairs
WHERE id1 IN (SELECT id FROM rich) AND id2 IN (SELECT id FROM rich)""",
)

# Normalization, distances, combinations

ORACLES["normalize_stats"] = _with(
    NORMAL,
    """SELECT source, n, round(lower, 6) AS lower, round(upper, 6) AS upper, round(mean, 6) AS mean, round(std, 6) AS std,
       round(zmin, 6) AS zmin, round(zmax, 6) AS zmax, round(crop_ratio, 6) AS crop_ratio FROM z JOIN limits USING (source)""",
)
ORACLES["normalize_zscore"] = _with(NORMAL, "SELECT source, id1, id2, round(similarity, 6) AS similarity FROM norm WHERE stored")
ORACLES["normalize_log"] = _with(
    _normal(1.0, "ln(x + 1e-6) / (1 + abs(ln(x + 1e-6)))"),
    "SELECT source, id1, id2, round(similarity, 6) AS similarity FROM norm WHERE stored",
)
ORACLES["value_statistics"] = _with(
    GRID,
    """SELECT source, round(min(similarity), 6) AS min_value, round(max(similarity), 6) AS max_value, round(avg(similarity), 6) AS mean_value,
       round(stddev_pop(similarity), 6) AS std_value, round(median(similarity), 6) AS median_value FROM grid GROUP BY source""",
)
ORACLES["stage_statistics"] = _with(
    NORMAL + [
        """stages AS (
  SELECT source, 'before' AS stage, similarity AS v FROM grid UNION ALL
  SELECT source, 'clip', x FROM shaped UNION ALL
  SELECT source, 'zscore', (x - mean) / (std + 1e-6) FROM shaped JOIN z USING (source) UNION ALL
  SELECT source, 'minmax', similarity FROM norm)""",
        "ends_ AS (SELECT source, stage, min(v) AS bottom, max(v) AS top, avg(v) AS mean_, stddev_pop(v) AS std_, median(v) AS mid FROM stages GROUP BY source, stage)",
        "hits AS (SELECT source, stage, least(floor(round((v - bottom) / (top - bottom) * 10, 9)), 9) AS bin, count(*) AS n FROM stages JOIN ends_ USING (source, stage) GROUP BY 1, 2, 3)",
    ],
    """SELECT e.source, e.stage, round(bottom, 6) AS min_value, round(top, 6) AS max_value, round(mean_, 6) AS mean_value, round(std_, 6) AS std_value, round(mid, 6) AS median_value,
  CASE WHEN e.stage = 'clip' THEN round(st.crop_ratio, 6) END AS crop_ratio, CAST(b.bin AS INTEGER) AS bin,
  round(bottom + (top - bottom) / 10 * b.bin, 6) AS low, round(bottom + (top - bottom) / 10 * (b.bin + 1), 6) AS high, CAST(coalesce(h.n, 0) AS DOUBLE) AS frequency
FROM ends_ e JOIN st USING (source) CROSS JOIN range(10) AS b(bin) LEFT JOIN hits h ON h.source = e.source AND h.stage = e.stage AND h.bin = b.bin""",
)
ORACLES["distance_summary"] = _with(
    NORMAL,
    """SELECT source, round(min(distance), 6) AS min_value, round(max(distance), 6) AS max_value, round(avg(distance), 6) AS mean_value
FROM dist WHERE distance > 0 GROUP BY source""",
)
ORACLES["vector_distances"] = _with(
    COMBINED, "SELECT combo, id1, id2, CAST(dims AS INTEGER) AS dims, d FROM vectors WHERE stored"
)
ORACLES["weighted_distances"] = _with(
    NORMAL + [f"weights AS (SELECT source, weight FROM {_values([('follow', 0.5), ('pace', 2.0), ('worth', 1.0), ('alike', 0.25)], 'source, weight')})"],
    """SELECT 'all' AS combo, id1, id2, round(sqrt(sum(CAST(weight AS DOUBLE) * distance * distance)), 8) AS d
FROM dist JOIN weights USING (source) GROUP BY id1, id2 HAVING bool_or(stored)""",
)
ORACLES["combination_stats"] = _with(
    COMBINED,
    """SELECT combo, round(min(abs(d)), 6) AS min_distance, round(avg(abs(d)), 6) AS mean_distance, round(max(abs(d)), 6) AS max_distance
FROM vectors GROUP BY combo""",
)
ORACLES["threshold_ranges"] = _with(
    _thresholds()
    + ["third AS (SELECT v.combo, avg(pow(d - m, 3)) / pow(any_value(s), 3) AS skewness FROM vectors v JOIN spread USING (combo) GROUP BY v.combo)"],
    """SELECT combo, step, round(t1, 6) AS t1, CASE WHEN dims = 1 THEN round(skewness, 6) END AS skewness FROM t1s JOIN third USING (combo)""",
)

# Clustering

ORACLES["leader_labels"] = _with(_leaders(), "SELECT combo, step, id, leader, label, size FROM clusters JOIN sizes USING (combo, step, leader)", True)
ORACLES["silhouette_sweep"] = _with(
    _best(), "SELECT combo, step, round(t1, 6) AS t1, round(silhouette, 6) AS silhouette, n_clusters, is_best FROM swept", True
)
ORACLES["best_thresholds"] = _with(
    _best(),
    """SELECT combo, step, round(t1, 6) AS t1, round(silhouette, 6) AS silhouette, n_clusters,
       round(single_point_ratio, 6) AS single_point_ratio FROM best""",
    True,
)
ORACLES["largest_clusters"] = _with(_leaders(), "SELECT combo, step, leader, size FROM sizes", True)
ORACLES["singleton_ratio"] = _with(
    _leaders(), "SELECT combo, step, n_clusters, round(single_point_ratio, 6) AS single_point_ratio FROM counts", True
)
ORACLES["cluster_medoids"] = _with(_best(), _medoids(1e-5, 1e-8), True)
ORACLES["first_medoids"] = _with(_best(), _medoids(0.0, 1e-12), True)

# Overlap

ORACLES["overlap_details"] = _with(
    _overlap(), "SELECT base, other, leader_a, leader_c, shared, size_a, size_c, round(score, 6) AS score FROM scored", True
)
ORACLES["overlap_matrix"] = _with(
    _overlap()
    + [
        "per_a AS (SELECT base, other, leader_a, avg(score) AS score FROM scored GROUP BY base, other, leader_a)",
        "overall AS (SELECT base, other, avg(score) AS overlap FROM per_a GROUP BY base, other)",
        "filtered AS (SELECT base, other, coalesce(avg(score) FILTER (WHERE NOT lone), 0.0) AS filtered FROM scored GROUP BY base, other)",
    ],
    """SELECT o.base, round(b.silhouette, 6) AS base_silhouette, b.n_clusters AS base_cluster_size, o.other AS compared_with,
       round(c.silhouette, 6) AS compared_with_silhouette, c.n_clusters AS compared_cluster_size,
       round(round(overlap, 12), 6) AS overlap_ratio, round(round(filtered, 12), 6) AS filtered_overlap_ratio
FROM overall o JOIN filtered USING (base, other) JOIN best b ON b.combo = o.base JOIN best c ON c.combo = o.other""",
    True,
)

# Comparison of sources and distributions


def _side_by_side(table: str) -> str:
    return f"""side AS (
  SELECT x.source AS source1, y.source AS source2, x.id1, x.id2, x.similarity AS a, y.similarity AS b
  FROM {table} x JOIN {table} y ON x.id1 = y.id1 AND x.id2 = y.id2
  JOIN {_values([(i, s) for i, s in enumerate(SUPPLIER_SOURCES)], 'p1, s1')} ON s1 = x.source
  JOIN (SELECT p1 AS p2, s1 AS s2 FROM {_values([(i, s) for i, s in enumerate(SUPPLIER_SOURCES)], 'p1, s1')}) ON s2 = y.source
  WHERE p1 < p2)"""


RANKED = """ranked AS (
  SELECT source1, source2,
         rank() OVER (PARTITION BY source1, source2 ORDER BY a) + (count(*) OVER (PARTITION BY source1, source2, a) - 1) / 2.0 AS ra,
         rank() OVER (PARTITION BY source1, source2 ORDER BY b) + (count(*) OVER (PARTITION BY source1, source2, b) - 1) / 2.0 AS rb
  FROM side)"""
RHO = "SELECT source1, source2, round(corr(ra, rb), 6) AS rho FROM ranked GROUP BY source1, source2"
ORACLES["spearman_rho"] = _with(NORMAL + [_side_by_side("norm"), RANKED], RHO)
ORACLES["spearman_nonzero"] = _with(PAIRS + [_side_by_side("pairs"), RANKED], RHO)


def _turns(a: str, b: str, seed: int) -> str:
    """Positions ``x, y`` of every cell after the turns of ``permute.moved`` on a grid ``a x b``."""
    rows = f"SELECT cell, r, cell // {b} AS x, cell % {b} AS y FROM ranks_ CROSS JOIN (SELECT unnest(range(3000)) AS r)"
    for t in range(permute.TURNS):
        one, other, size = ("x", "y", a) if t % 2 == 0 else ("y", "x", b)
        h = f"(({other} * {permute.A} + r * {permute.B} + {(seed + t) * permute.C}) % {permute.P})"
        rows = f"SELECT cell, r, {other}, ({one} + (({h} * {h} + {h} * {permute.D}) % {permute.P}) % {size}) % {size} AS {one} FROM ({rows})"
    return rows


NULL = [
    "numbered_ AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM common)",
    "size_ AS (SELECT max(n) AS n, CASE WHEN max(n) % 2 = 0 THEN max(n) - 1 ELSE max(n) END AS a, CASE WHEN max(n) % 2 = 0 THEN max(n) // 2 ELSE (max(n) - 1) // 2 END AS b FROM numbered_)",
    """ranks_ AS MATERIALIZED (
  SELECT i * (2 * n - i - 1) // 2 + j - i - 1 AS cell, """
    + ", ".join(f"max(CASE WHEN source = '{s}' THEN rk END) AS r{k}" for k, s in enumerate(SUPPLIER_SOURCES))
    + """ FROM (
    SELECT source, least(p.pos, q.pos) AS i, greatest(p.pos, q.pos) AS j, p.n,
           rank() OVER (PARTITION BY source ORDER BY similarity) + (count(*) OVER (PARTITION BY source, similarity) - 1) / 2.0 - (p.n * (p.n - 1) / 2 + 1) / 2.0 AS rk
    FROM norm JOIN numbered_ p ON p.id = id1 JOIN numbered_ q ON q.id = id2) GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY i, j, n"),
    f"moved AS (SELECT cell, r, x * (SELECT b FROM size_) + y AS target FROM ({_turns('(SELECT a FROM size_)', '(SELECT b FROM size_)', 42)}))",
    "sums_ AS (SELECT r, "
    + ", ".join(f"sum(u.r{i} * v.r{j}) AS c{i}_{j}" for i, j in combinations(range(len(SUPPLIER_SOURCES)), 2))
    + " FROM moved JOIN ranks_ u ON u.cell = moved.cell JOIN ranks_ v ON v.cell = moved.target GROUP BY r)",
    "null_ AS ("
    + " UNION ALL ".join(
        f"SELECT '{SUPPLIER_SOURCES[i]}' AS source1, '{SUPPLIER_SOURCES[j]}' AS source2, r, c{i}_{j} / (SELECT sqrt(sum(r{i} * r{i}) * sum(r{j} * r{j})) FROM ranks_) AS rho FROM sums_"
        for i, j in combinations(range(len(SUPPLIER_SOURCES)), 2)
    )
    + ")",
]
ORACLES["permutation_p"] = _with(
    NORMAL + [_side_by_side("norm"), RANKED, "seen_ AS (SELECT source1, source2, corr(ra, rb) AS seen FROM ranked GROUP BY source1, source2)"] + NULL,
    """SELECT source1, source2, round(seen, 6) AS rho,
  round(least(1.0, 2 * (least(count(*) FILTER (rho <= seen + abs(seen) * 1e-12), count(*) FILTER (rho >= seen - abs(seen) * 1e-12)) + 1) / 3001.0), 6) AS p_value
FROM null_ JOIN seen_ USING (source1, source2) GROUP BY source1, source2, seen""",
)
FROBENIUS = """SELECT source1, source2, round(sqrt({times} * sum((a - b) * (a - b))), 6) AS frobenius,
       round(sqrt({times} * sum((a - b) * (a - b)) / {cells}), 6) AS rmse FROM side GROUP BY source1, source2"""
ORACLES["frobenius_rmse"] = _with(
    NORMAL + [_side_by_side("norm")], FROBENIUS.format(times=2, cells="((SELECT count(*) FROM common) * (SELECT count(*) FROM common))")
)
ORACLES["frobenius_upper"] = _with(NORMAL + [_side_by_side("norm")], FROBENIUS.format(times=1, cells="count(*)"))
ROWS = [
    "cell AS (SELECT source, id1 AS id, id2 AS nbr, similarity FROM norm UNION ALL SELECT source, id2, id1, similarity FROM norm UNION ALL SELECT s.source, id, id, 0.0 FROM common CROSS JOIN sources s)",
    f"rowpos AS (SELECT source, id, list(similarity ORDER BY nbr) AS v FROM cell GROUP BY source, id)",
    "numbered AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM common)",
    f"srcpos AS (SELECT p, source FROM {_values([(i, s) for i, s in enumerate(SUPPLIER_SOURCES)], 'p, source')})",
    """apart AS (
  SELECT x.source AS source1, y.source AS source2, nx.pos AS i, ny.pos AS j, list_distance(x.v, y.v) AS d
  FROM rowpos x JOIN srcpos sx ON sx.source = x.source JOIN rowpos y ON true JOIN srcpos sy ON sy.source = y.source AND sx.p < sy.p
  JOIN numbered nx ON nx.id = x.id JOIN numbered ny ON ny.id = y.id)""",
]


def _hausdorff(block: int) -> str:
    return f"""SELECT source1, source2, max(least_d) AS gromov FROM (
  SELECT source1, source2, i, i // {block} AS bi, j // {block} AS bj, min(d) AS least_d FROM apart GROUP BY source1, source2, i, bi, bj
  UNION ALL
  SELECT source1, source2, j, i // {block} AS bi, j // {block} AS bj, min(d) FROM apart GROUP BY source1, source2, j, bi, bj) GROUP BY source1, source2"""


ORACLES["hausdorff_blocks"] = _with(NORMAL + ROWS, f"SELECT source1, source2, round(gromov, 6) AS gromov FROM ({_hausdorff(30)})")
ORACLES["hausdorff_exact"] = _with(NORMAL + ROWS, f"SELECT source1, source2, round(gromov, 6) AS gromov FROM ({_hausdorff(10**9)})")
ORACLES["hausdorff_nonzero"] = _with(
    PAIRS
    + [
        _side_by_side("pairs"),
        "av AS (SELECT DISTINCT source1, source2, a FROM side)",
        "bv AS (SELECT DISTINCT source1, source2, b FROM side)",
        "gap AS (SELECT source1, source2, a, b, abs(a - b) AS d FROM av JOIN bv USING (source1, source2))",
    ],
    """SELECT source1, source2, round(max(d), 6) AS gromov FROM (
  SELECT source1, source2, min(d) AS d FROM gap GROUP BY source1, source2, a UNION ALL
  SELECT source1, source2, min(d) AS d FROM gap GROUP BY source1, source2, b) GROUP BY source1, source2""",
)
ORACLES["metric_matrix"] = _with(
    NORMAL
    + ROWS
    + [
        _side_by_side("norm"),
        RANKED,
        f"""tall AS (
  SELECT 'Spearman' AS metric, source1, source2, corr(ra, rb) AS value FROM ranked GROUP BY source1, source2 UNION ALL
  SELECT 'Frobenius', source1, source2, sqrt(2 * sum((a - b) * (a - b))) FROM side GROUP BY source1, source2 UNION ALL
  SELECT 'Gromov', source1, source2, gromov FROM ({_hausdorff(200)}))""",
    ],
    """SELECT metric, source1, source2, round(value, 6) AS value FROM (
  SELECT metric, source1, source2, value FROM tall UNION ALL SELECT metric, source2, source1, value FROM tall UNION ALL
  SELECT m.metric, s.source, s.source, m.value FROM sources s CROSS JOIN (VALUES ('Spearman', 1.0), ('Frobenius', 0.0), ('Gromov', 0.0)) AS m(metric, value))""",
)


def _histogram(table: str, value: str) -> list[str]:
    return [
        f"raw AS (SELECT source, {value} AS v FROM {table})",
        "span AS (SELECT source, min(v) AS lo, max(v) AS hi FROM raw GROUP BY source)",
        "hits AS (SELECT source, least(floor(round((v - lo) / (hi - lo) * 50, 9)), 49) AS bin, count(*) AS n FROM raw JOIN span USING (source) GROUP BY 1, 2)",
        """hist AS (
  SELECT span.source, CAST(b.bin AS INTEGER) AS bin, round(lo + (hi - lo) / 50 * b.bin, 6) AS low, round(lo + (hi - lo) / 50 * (b.bin + 1), 6) AS high,
         CAST(coalesce(n, 0) AS DOUBLE) AS frequency
  FROM span CROSS JOIN range(50) AS b(bin) LEFT JOIN hits ON hits.source = span.source AND hits.bin = b.bin)""",
    ]


ORACLES["permutation_histogram"] = _with(
    NORMAL + NULL + ["null_rows AS (SELECT source1 || '|' || source2 AS source, rho AS v FROM null_)",
                     "span AS (SELECT source, min(v) AS lo, max(v) AS hi, count(*) AS total FROM null_rows GROUP BY source)",
                     "hits AS (SELECT source, least(floor(round((v - lo) / (hi - lo) * 30, 9)), 29) AS bin, count(*) AS n FROM null_rows JOIN span USING (source) GROUP BY 1, 2)"],
    """SELECT span.source, CAST(b.bin AS INTEGER) AS bin, round(lo + (hi - lo) / 30 * b.bin, 6) AS low, round(lo + (hi - lo) / 30 * (b.bin + 1), 6) AS high,
  round(coalesce(n, 0) / (total * (lo + (hi - lo) / 30 * (b.bin + 1) - (lo + (hi - lo) / 30 * b.bin))), 6) AS frequency
FROM span CROSS JOIN range(30) AS b(bin) LEFT JOIN hits ON hits.source = span.source AND hits.bin = b.bin""",
)
ORACLES["histogram_original"] = _with(GRID + _histogram("grid", "ln(1 + similarity)"), "SELECT * FROM hist")
ORACLES["histogram_normalized"] = _with(NORMAL + _histogram("norm", "similarity"), "SELECT * FROM hist")
ORACLES["distance_distribution"] = _with(
    NORMAL + _histogram("dist", "distance"),
    "SELECT *, round((SELECT min(v) FROM raw), 6) AS global_min, round((SELECT max(v) FROM raw), 6) AS global_max FROM hist",
)
ORACLES["density_curves"] = _with(
    NORMAL
    + [
        "kw AS (SELECT source, count(*) AS n, pow(count(*), -0.2) * stddev_samp(similarity) AS h, min(similarity) AS lo, max(similarity) AS hi FROM norm GROUP BY source)",
        "gridx AS (SELECT source, n, h, CAST(g.i AS INTEGER) AS point, lo - 3 * h + g.i * ((hi + 3 * h - (lo - 3 * h)) / 199) AS x FROM kw CROSS JOIN range(200) AS g(i))",
        "vals AS (SELECT source, similarity, count(*) AS w FROM norm GROUP BY source, similarity)",
    ],
    """SELECT source, point, round(any_value(x), 6) AS x,
       round(sum(w * exp(-0.5 * pow((x - similarity) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density
FROM gridx JOIN vals USING (source) GROUP BY source, point""",
)

# Evaluation

NEAREST = [
    "v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)",
    "near AS (SELECT a.id, b.id AS nbr, 1 / (1 + list_distance(a.e, b.e)) AS similarity, b.label AS nbr_label, a.label AS true_label FROM v a JOIN v b ON a.id <> b.id)",
    "top AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY similarity DESC, nbr) AS INTEGER) AS rank FROM near QUALIFY rank <= 5)",
]
ORACLES["topk_neighbors"] = _with(NEAREST, "SELECT id, nbr, round(similarity, 6) AS similarity, rank FROM top")
ORACLES["topk_accuracy"] = _with(
    NEAREST,
    """SELECT count(*) FILTER (WHERE nbr_label = true_label) AS hits, 5 * (SELECT count(*) FROM v) AS total,
       round(CAST(count(*) FILTER (WHERE nbr_label = true_label) AS DOUBLE) / (5 * (SELECT count(*) FROM v)), 6) AS accuracy FROM top""",
)
ORACLES["topk_report"] = _with(
    NEAREST,
    "SELECT id, true_label AS true_type, "
    + ", ".join(
        f"max(nbr) FILTER (WHERE rank = {r}) AS top{r}, max(coalesce(CAST(nbr_label AS VARCHAR), 'N/A')) FILTER (WHERE rank = {r}) AS top{r}_type"
        for r in range(1, 6)
    )
    + """, count(*) FILTER (WHERE nbr_label = true_label) AS match_count,
       CAST(count(*) FILTER (WHERE nbr_label = true_label) AS DOUBLE) / 5 AS acc_at_5
FROM top WHERE true_label IS NOT NULL GROUP BY id, true_label""",
)
SOURCE_NEAREST = GRID + [
    "ends AS (SELECT source, id1 AS id, id2 AS nbr, similarity FROM grid UNION ALL SELECT source, id2, id1, similarity FROM grid)",
    "top AS (SELECT *, CAST(row_number() OVER (PARTITION BY source, id ORDER BY similarity DESC, nbr) AS INTEGER) AS rank FROM ends QUALIFY rank <= 5)",
]
ORACLES["source_neighbors"] = _with(SOURCE_NEAREST, "SELECT source, id, nbr, round(similarity, 6) AS similarity, rank FROM top")
ORACLES["source_accuracy"] = _with(
    SOURCE_NEAREST + ["truth AS (SELECT s_suppkey AS id, n_regionkey AS label FROM supplier JOIN nation ON n_nationkey = s_nationkey)"],
    """SELECT source, count(*) FILTER (WHERE a.label = b.label) AS hits, 5 * (SELECT count(*) FROM common) AS total,
       round(CAST(count(*) FILTER (WHERE a.label = b.label) AS DOUBLE) / (5 * (SELECT count(*) FROM common)), 6) AS accuracy
FROM top JOIN truth a ON a.id = top.id JOIN truth b ON b.id = top.nbr GROUP BY source""",
)
LABELED = [
    "rows_ AS (SELECT label, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS cluster FROM embeddings)",
    "table_ AS (SELECT label, cluster, count(*) AS n FROM rows_ GROUP BY label, cluster)",
    "a_ AS (SELECT label, sum(n) AS a FROM table_ GROUP BY label)",
    "b_ AS (SELECT cluster, sum(n) AS b FROM table_ GROUP BY cluster)",
    "total_ AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM table_)",
]
ORACLES["mutual_information"] = _with(
    LABELED,
    """SELECT round((SELECT sum(n / t * ln(n * t / (a * b))) FROM table_ JOIN a_ USING (label) JOIN b_ USING (cluster), total_)
  / (((SELECT sum(-a / t * ln(a / t)) FROM a_, total_) + (SELECT sum(-b / t * ln(b / t)) FROM b_, total_)) / 2), 6) AS nmi""",
)
ORACLES["adjusted_rand"] = _with(
    LABELED
    + [
        "s AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM table_) AS i, (SELECT sum(CAST(a AS DOUBLE) * (a - 1) / 2) FROM a_) AS x, (SELECT sum(CAST(b AS DOUBLE) * (b - 1) / 2) FROM b_) AS y, (SELECT t * (t - 1) / 2 FROM total_) AS z)"
    ],
    "SELECT round((i - x * y / z) / ((x + y) / 2 - x * y / z), 6) AS ari FROM s",
)
F1 = """SELECT round((SELECT avg(2.0 * tp / (sup + pred)) FROM (
  SELECT c, sum(tp) AS tp, sum(sup) AS sup, sum(pred) AS pred FROM (
    SELECT label AS c, CASE WHEN label = cluster THEN 1 ELSE 0 END AS tp, 1 AS sup, 0 AS pred FROM {t} UNION ALL
    SELECT cluster, 0, 0, 1 FROM {t}) GROUP BY c)), 6) AS macro_f1,
  round((SELECT avg(CASE WHEN label = cluster THEN 1.0 ELSE 0.0 END) FROM {t}), 6) AS accuracy"""
ORACLES["macro_f1_raw"] = _with(LABELED, F1.format(t="rows_"))
ORACLES["macro_f1_majority"] = _with(
    LABELED
    + [
        "major AS (SELECT cluster, label AS m FROM table_ QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) = 1)",
        "matched AS (SELECT label, m AS cluster FROM rows_ JOIN major USING (cluster))",
    ],
    F1.format(t="matched"),
)
ORACLES["label_codes"] = "SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT lang AS label FROM documents)"
ORACLES["label_distribution"] = """
SELECT quality AS label, count(*) AS projects FROM labels JOIN documents USING (doc_id) WHERE lang = 'en' GROUP BY quality"""


def _kmeans() -> str:
    """Rounds of ``kmeans.lloyd`` without a tolerance, one table of centres after the other."""
    k, seed, starts, rounds = (demo.KMEANS[c] for c in ("k", "seed", "starts", "rounds"))
    parts = [
        "points AS MATERIALIZED (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice - 900 AS y FROM part)",
        f"""c0 AS MATERIALIZED (SELECT s, c, x, y FROM (
  SELECT s, x, y, row_number() OVER (PARTITION BY s ORDER BY md5(concat(id, ':', s + {seed})), id) - 1 AS c
  FROM points CROSS JOIN (SELECT unnest(range({starts})) AS s)) WHERE c < {k})""",
    ]

    def dealt(t: int) -> str:
        return f"""near{t} AS MATERIALIZED (SELECT * FROM (
  SELECT p.id, p.x, p.y, s, c, d, row_number() OVER (PARTITION BY s, id ORDER BY d, c) AS place FROM (
    SELECT p.id, p.x, p.y, s, c, (p.x - m.x) * (p.x - m.x) + (p.y - m.y) * (p.y - m.y) AS d FROM points p CROSS JOIN c{t} m) p) WHERE place = 1)"""

    for t in range(rounds):
        parts += [dealt(t), f"c{t + 1} AS MATERIALIZED (SELECT m.s, m.c, coalesce(avg(n.x), any_value(m.x)) AS x, coalesce(avg(n.y), any_value(m.y)) AS y FROM c{t} m LEFT JOIN near{t} n ON n.s = m.s AND n.c = m.c GROUP BY m.s, m.c)"]
    parts.append(dealt(rounds))
    return _with(parts, f"SELECT id, CAST(c AS INTEGER) AS cluster FROM near{rounds} WHERE s = (SELECT s FROM near{rounds} GROUP BY s ORDER BY sum(d), s LIMIT 1)")


ORACLES["kmeans_points"] = _kmeans()
