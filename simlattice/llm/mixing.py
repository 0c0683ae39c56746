"""Operator 4: mixing sources to target weights by capped water-filling.

A share of all words is given to the sources in proportion to their weights. A
source that would need more than ``max_epochs`` repetitions is clamped there,
and its excess goes to the open sources by weight, until none is above. Every
round is one sum over the table of sources; the level only rises, so a source
once clamped stays so.

A source with ``e`` epochs gives every document ``floor(e)`` whole times; the
fraction left is filled by the documents first in a seeded order (MD5), up to
the one whose middle passes the target. So the words taken miss the target by
half a document at most, and reruns agree. The order is walked by ranges, not
source by source, so no source is sorted in one task. DataFrame functions only.

Defined cases: a null text has size 0; null sources are one source, the last;
rows that repeat a ``doc_id`` within a source are taken or left together; a
source of size 0 has the target 0; other columns are kept by ``mix`` unless
they bear a name of its results, and all by ``repeated``; no name of an input
column clashes with inner ones; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simlattice.llm.rules import SPACES
from simlattice.runtime import cut, lookup, numbered, running_totals

WEIGHTS, SHARE, MAX_EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix-1"
HOT_PART = 1000
_KEYS = ["_none", "_name"]
RESULTS = ["size", "source_size", "target", "repeats"]


def n_words(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.size(F.array_remove(F.split(plain, " "), "")).cast("long")


def water_level(sources: DataFrame, words: float) -> float | None:
    """Words per unit of weight of the open sources ``weight, cap``; None if all are clamped.

    One row a round reaches the driver. The rounds end when no source is clamped anew.
    """
    level = 0.0
    while True:
        clamped = F.col("cap") <= F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(clamped, F.col("cap"))).alias("full"), F.sum(F.when(~clamped, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            return None
        after = (words - (row["full"] or 0)) / row["open"]
        if after <= level:
            return level
        level = after


def plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Per source of ``_none, _name, doc_id, size``: ``docs, source_size, target, whole, last`` (``last``: the end of the extra repetition in the seeded order, or null)."""
    sources = cut(sized.groupBy(*_KEYS).agg(F.count("size").alias("docs"), F.sum("size").alias("source_size")))
    turn = numbered(sources, [], _KEYS, "turn")
    sources = cut(turn.withColumns({
        "weight": F.array(*(F.lit(float(w)) for w in weights))[(F.col("turn") % len(weights)).cast("int")], "cap": F.col("source_size") * F.lit(float(max_epochs)),
    }))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, share * total)
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    sources = sources.withColumn("target", target)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = cut(sources.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")))
    once = sized.groupBy(*_KEYS, "doc_id").agg(F.sum("size").alias("size"))
    placed = running_totals(once.withColumn("order", seeded(F.col("doc_id"), seed)).select(*_KEYS, "order", "size"), _KEYS, ["order"], "size")
    budgets = sources.select(*_KEYS, "docs", "budget")
    taken = _per_source(placed, budgets, sources).filter((F.col("budget") > 0) & (2 * F.col("before") + F.col("size") <= 2 * F.col("budget")))
    last = taken.groupBy(*_KEYS).agg(F.max("order").alias("last"))
    return cut(sources.join(last, _KEYS, "left").select(*_KEYS, "docs", "source_size", "target", "whole", "last"))


def _per_source(rows: DataFrame, table: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with the row of their source. Sources with over a thousandth of all rows, 1000 at most, are broadcast."""
    total = counts.agg(F.sum("docs")).first()[0] or 0
    hot = cut(counts.filter(F.col("docs") * HOT_PART > total).select(*_KEYS))
    return lookup(rows, table.drop("docs"), _KEYS, hot)


def seeded(key: Column, seed: str) -> Column:
    """Place of a document in the seeded order; the id itself ends it, so only equal ids share a place."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.concat(F.md5(F.concat(F.lit(seed + ":"), text)), text)


def _mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> tuple[DataFrame, dict]:
    """``RESULTS`` beside the columns of ``docs``, which bear the names ``c0, c1, ...`` of the second result."""
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = docs.toDF(*place.values())
    name = F.col(place[source])
    keyed = own.withColumns({"size": n_words(F.col(place[text])), "_none": name.isNull(), "_name": F.coalesce(name.cast("string"), F.lit(""))})
    sized = cut(keyed.select(*_KEYS, F.col(place[key]).alias("doc_id"), "size"))
    sources = plan(sized, weights, share, max_epochs, seed)
    extra = F.when(seeded(F.col(place[key]), seed) <= F.col("last"), 1).otherwise(0)
    found = _per_source(keyed, sources, sources)
    return found.withColumn("repeats", F.col("whole") + extra).drop("whole", "last", *_KEYS), place


def mix(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with ``size, source_size, target, repeats``: how often the mix takes each document. ``how``: see ``_mixed``."""
    rows, place = _mixed(docs, **how)
    return rows.select(*(F.col(at).alias(c) for c, at in place.items() if c.lower() not in RESULTS), *RESULTS)


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns."""
    rows, place = _mixed(docs, **how)
    copies = rows.filter("repeats > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
    return copies.select(*(F.col(at).alias(c) for c, at in place.items()))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, source, target and words taken of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op4_sql() -> str:
    weight = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(WEIGHTS))
    return f"""
WITH d AS (SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS name,
  CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT none, name, sum(size) AS source_size, {float(MAX_EPOCHS)} * sum(size) AS cap,
  CASE (row_number() OVER (ORDER BY none, name) - 1) % {len(WEIGHTS)} {weight} END AS weight FROM d GROUP BY none, name),
k AS (SELECT *, cap / weight AS edge, coalesce(sum(cap) OVER (ORDER BY cap / weight, none, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
  sum(weight) OVER (ORDER BY cap / weight, none, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_ FROM s),
j AS (SELECT *, ({SHARE} * (SELECT sum(source_size) FROM s) - full_) / open_ AS lam FROM k),
l AS (SELECT arg_min(lam, edge) FILTER (WHERE lam <= edge) AS level FROM j),
t AS (SELECT none, name, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM s, l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
o AS (SELECT d.*, md5('{SEED}:' || doc_id) || doc_id AS place FROM d),
r AS (SELECT *, sum(size) OVER (PARTITION BY none, name ORDER BY place) - size AS before FROM o)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(size * (whole + CASE WHEN 2 * before + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r JOIN b USING (none, name)"""
