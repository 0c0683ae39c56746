"""Operator 6: URL rules and empirical-Bayes host reputation.

A listed rule decides a page where one fits. Every other page is judged by the
reputation of its host, learned from the pages whose outcome is known. A
level's outcomes are shrunk towards the level above by a beta-binomial prior:

    all pages -> suffix (``com``) -> registered domain -> host

A group with ``n`` known outcomes of which ``good`` are good has the posterior
``Beta(k * m + good, k * (1 - m) + n - good)`` with ``m`` the posterior mean of
the group above it. The weight ``k`` of a level is estimated from the data:
the variance between the groups of the level beyond that of chance. A page is
allowed if ``mean - z * deviation`` of its host's posterior reaches ``least``.

DataFrame functions only. Outcomes are summed per host before anything is
joined. Hosts with over a thousandth of all pages, of which there are 1000 at
most, are joined by broadcast, so their pages stay where they are.

Defined cases: a null url, or one without ``://``, has an empty host and path
and the reputation of the whole; an unknown outcome is not learned from;
repeated rows are judged each and count each; without known outcomes the mean
is 0.5; an empty table gives no rows; other columns are kept by ``judge``
unless they bear a name of its results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simlattice.runtime import cut, lookup

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules of the query: verdict, then host and start of the path.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

# Suffixes of two labels under which domains are registered.
DOUBLE_SUFFIXES = ["ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "com.mx", "org.uk"]

Z, LEAST, HOT_PART = 1.0, 0.5, 1000


def located(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path`` of its urls."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), CAPITALS, SMALL)
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def rule_for(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """Struct ``(rule, verdict)`` of the longest fitting rule, or null. Equal lengths: the first in text order."""
    found = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0])):
        domain, start = rule.split("/", 1)
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        found.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")


def domain_of(host: Column) -> Column:
    """Registered domain: the suffix and one label more; a host without one is its own domain."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(DOUBLE_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(DOUBLE_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def weight(groups: DataFrame) -> float:
    """Weight ``k`` of the prior of a level, by moments, from groups ``n, good, m``; between 1 and 1000.

    One row reaches the driver. All groups alike, or one group, give 1000 and 1.
    """
    known = groups.filter("n > 0").select("n", ((F.col("good") - F.col("n") * F.col("m")) ** 2).alias("off"), (F.col("n") * F.col("m") * (1 - F.col("m"))).alias("chance"), (F.col("n") * (F.col("n") - 1) * F.col("m") * (1 - F.col("m"))).alias("room"))
    row = known.agg(F.count("n").alias("g"), F.sum("off").alias("off"), F.sum("chance").alias("chance"), F.sum("room").alias("room")).first()
    if not row["g"] or row["g"] < 2 or not row["room"]:
        return 1.0
    share = (row["off"] - row["chance"]) / row["room"]  # the part of the variance that lies between groups
    return min(1000.0, max(1.0, 1 / share - 1)) if share > 0 else 1000.0


def reputation(pages: DataFrame, outcome: str = "good") -> DataFrame:
    """One row per host: ``host, pages, n, good, rep_mean, rep_bound``. ``outcome``: 1, 0 or null."""
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count(outcome).alias("n"), F.coalesce(F.sum(F.col(outcome).cast("long")), F.lit(0)).alias("good"))
    hosts = cut(hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = (total["good"] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
    domains = cut(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    level = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("m", F.lit(mean))
    level = _shrunk(level).select("suffix", "mean")
    level = _shrunk(cut(domains.join(level.withColumnRenamed("mean", "m"), "suffix"))).select("domain", "mean")
    rows = cut(hosts.join(level.withColumnRenamed("mean", "m"), "domain"))
    shrunk = _shrunk(rows)
    bound = F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("k") + 1))
    return shrunk.select("host", "pages", "n", "good", F.col("mean").alias("rep_mean"), bound.alias("rep_bound"))


def _shrunk(groups: DataFrame) -> DataFrame:
    """``groups`` with the weight ``k`` of their level and their posterior ``mean``."""
    k = weight(groups)
    return groups.withColumns({"k": F.lit(k), "mean": (k * F.col("m") + F.col("good")) / (k + F.col("n"))})


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", outcome: Column | None = None) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, rep_mean, rep_bound``.

    ``outcome`` (1 good, 0 bad, null unknown) labels pages. Without it the
    pages that a rule decides are the labelled ones: allowed 1, blocked 0.
    """
    names = ["host", "path", "rule", "verdict", "rep_mean", "rep_bound", "_by", "_good"]
    rows = located(pages.drop(*(c for c in names if c != url)), url)
    rows = rows.withColumn("_by", rule_for(rules, F.col("host"), F.col("path")))
    good = outcome if outcome is not None else (F.col("_by.verdict") == "allow").cast("int")
    hosts = cut(reputation(rows.select("host", good.alias("good"))))
    total = hosts.agg(F.sum("pages")).first()[0] or 0
    hot = cut(hosts.filter(F.col("pages") * HOT_PART > total).select("host"))
    judged = lookup(rows, hosts.select("host", "rep_mean", "rep_bound"), ["host"], hot)
    verdict = F.coalesce(F.col("_by.verdict"), F.when(F.col("rep_bound") >= LEAST, "allow").otherwise("block"))
    return judged.withColumns({"rule": F.col("_by.rule"), "verdict": verdict}).drop("_by")


def op6_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict", F.round("rep_bound", 6).alias("rep_bound"))


def op6_sql() -> str:
    order = sorted(RULES, key=lambda r: (-len(r[1]), r[1], r[0]))

    def case(value: str) -> str:
        tests = []
        for verdict, rule in order:
            domain, start = rule.split("/", 1)
            tests.append(f"WHEN (host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '/{start}') THEN '{rule if value == 'rule' else verdict}'")
        return "CASE " + " ".join(tests) + " END"

    doubles = ", ".join(f"'{s}'" for s in DOUBLE_SUFFIXES)

    def level(name: str, source: str, key: str) -> str:
        """Posterior of one level from groups with n, good, m."""
        return f"""
{name}_k AS (SELECT CASE WHEN g < 2 OR coalesce(room, 0) = 0 THEN 1.0 WHEN off_ <= chance THEN 1000.0
   ELSE least(1000.0, greatest(1.0, 1 / ((off_ - chance) / room) - 1)) END AS k
  FROM (SELECT count(*) AS g, sum((good - n * m) * (good - n * m)) AS off_, sum(n * m * (1 - m)) AS chance, sum(n * (n - 1) * m * (1 - m)) AS room FROM {source} WHERE n > 0)),
{name} AS (SELECT s.*, k, (k * m + good) / (k + n) AS mean FROM {source} AS s, {name}_k)"""

    return f"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{CAPITALS}', '{SMALL}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
q AS (SELECT *, {case('rule')} AS rule, {case('verdict')} AS given FROM p),
h0 AS (SELECT host, count(given) AS n, sum(CASE WHEN given = 'allow' THEN 1 ELSE 0 END) AS good, string_split(host, '.') AS l FROM q GROUP BY host),
h1 AS (SELECT host, n, good, l, CASE WHEN len(l) < 2 THEN host ELSE l[-2] || '.' || l[-1] END AS two FROM h0),
h AS (SELECT host, n, good, CASE WHEN two NOT IN ({doubles}) THEN two WHEN len(l) > 2 THEN l[-3] || '.' || two ELSE two END AS domain,
  CASE WHEN two IN ({doubles}) THEN two ELSE l[-1] END AS suffix FROM h1),
a AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(good) + 0.5) / (sum(n) + 1) ELSE 0.5 END AS m FROM h),
d0 AS (SELECT suffix, domain, sum(n) AS n, sum(good) AS good FROM h GROUP BY suffix, domain),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(m) AS m FROM d0, a GROUP BY suffix),
{level('s', 's0', 'suffix')},
d1 AS (SELECT d0.*, s.mean AS m FROM d0 JOIN s USING (suffix)),
{level('d', 'd1', 'domain')},
h2 AS (SELECT h.*, d.mean AS m FROM h JOIN d USING (domain)),
{level('hh', 'h2', 'host')},
r AS (SELECT host, mean - {Z} * sqrt(mean * (1 - mean) / (n + k + 1)) AS b FROM hh)
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN b >= {LEAST} THEN 'allow' ELSE 'block' END) AS verdict, round(b, 6) AS rep_bound FROM q JOIN r USING (host)"""
