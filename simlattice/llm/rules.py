"""Operator 2: quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger holds the measurements
and one long whose bit ``i`` says that rule ``i`` failed. A policy is a
version with the set of rules it applies, i.e. a bit mask: its verdict, its
reject counts and the ablation of each rule need the bits alone, never the
text again. DataFrame functions only; one pass without a shuffle.

Words are runs of characters other than space and 0x09-0x0D. Windows of five
words are known by 64-bit hashes within their own text.

Defined cases: a null text is empty (0 words, fails ``short``); other columns
are kept by ``ledger`` unless they bear a name of its results; repeated rows
are judged each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_bangs"]

#: Rule and the condition under which it fails, in SQL over the measurements. The place in the list is the bit.
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * word_chars",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < n_words * 2 or word_chars > n_words * 20",
    "capitals": "100 * n_capitals > 50 * word_chars",
    "bangs": "100 * n_bangs > 40 * n_words",
}

#: Versions of the policy: the rules each one applies.
POLICIES = {
    "base": ["short", "repeats"],
    "v1": ["short", "repeats", "symbols", "dup_lines"],
    "v2": ["short", "repeats", "symbols", "dup_lines", "word_length", "capitals", "bangs"],
}
CURRENT = "v2"


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeat_words(words: Column) -> Column:
    """Number of words in windows of five that the text has twice or more."""

    def of_sorted(windows: Column) -> Column:
        near = lambda w, i, d: F.get(windows, i + d)["h"].eqNullSafe(w["h"])
        hit = F.filter(windows, lambda w, i: near(w, i, -1) | near(w, i, 1))
        places = F.array_sort(F.transform(hit, lambda w: w["i"]))
        covered = lambda p: F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5))))
        return F.aggregate(bound(places, covered), F.lit(0), lambda s, x: s + x)

    def of_hashes(h: Column) -> Column:
        at = lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(5)))
        starts = F.sequence(F.lit(0), F.size(h) - 5)

        def count(windows: Column) -> Column:
            ordered = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("h"), i.alias("i"))))
            return F.when(F.size(F.array_distinct(windows)) < F.size(windows), bound(ordered, of_sorted)).otherwise(0)

        return F.when(F.size(h) < 6, 0).otherwise(bound(F.transform(starts, at), count))

    return bound(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``MEASURES``."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(F.translate(t, SPACES[1:], " " * (len(SPACES) - 1)), " "), "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    of_words = bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("r")))
    of_lines = bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    of_text = bound(t, lambda x: F.struct(
        F.length(_without(x, SPACES)).alias("c"), (F.length(x) - F.length(_without(x, SYMBOLS))).alias("s"),
        (F.length(x) - F.length(_without(x, CAPITALS))).alias("u"), (F.length(x) - F.length(_without(x, "!"))).alias("b"),
    ))
    held = docs.withColumns({"_words": of_words, "_lines": of_lines, "_text": of_text})
    inner = {"n_words": "_words.n", "n_repeat_words": "_words.r", "n_lines": "_lines.n", "n_dup_lines": "_lines.d", "word_chars": "_text.c", "n_symbols": "_text.s", "n_capitals": "_text.u", "n_bangs": "_text.b"}
    return held.withColumns({m: F.col(inner[m]).cast("long") for m in MEASURES}).drop("_words", "_lines", "_text")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and the failure bits ``failures``."""
    bits = [F.when(F.expr(test), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, test in enumerate(RULES.values())]
    failures = bits[0]
    for bit in bits[1:]:
        failures = failures.bitwiseOR(bit)
    return measured(docs, text).withColumn("failures", failures)


def mask(policy: str) -> int:
    return sum(1 << i for i, rule in enumerate(RULES) if rule in POLICIES[policy])


def passes(policy: str, failures: str = "failures") -> Column:
    """Verdict of a version of the policy on a ledger."""
    return F.col(failures).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(rows: DataFrame) -> DataFrame:
    """Per version and rule: documents and words that the rule rejects, and that it alone rejects.

    The ledger is first summed per set of bits, of which there are 2 to the
    number of rules at most.
    """
    sets = rows.groupBy("failures").agg(F.count("failures").alias("docs"), F.sum("n_words").alias("words"))
    uses = F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(rule).alias("rule"), F.lit(1 << i).cast("long").alias("bit"), F.lit(mask(p)).cast("long").alias("mask")) for p in POLICIES for i, rule in enumerate(RULES) if rule in POLICIES[p]))
    each = sets.withColumn("use", F.explode(uses)).select("*", "use.*").withColumn("hit", F.col("failures").bitwiseAND(F.col("mask")))
    fails, alone = F.col("hit").bitwiseAND(F.col("bit")) != 0, F.col("hit") == F.col("bit")
    total = lambda test, what: F.coalesce(F.sum(F.when(test, F.col(what))), F.lit(0)).cast("long")
    return each.groupBy("policy", "rule").agg(
        total(fails, "docs").alias("rejected"), total(alone, "docs").alias("rejected_alone"),
        total(fails, "words").alias("words_rejected"), total(alone, "words").alias("words_rejected_alone"),
    )


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdict of every document."""
    rows = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", *MEASURES, "failures", (~passes("base")).alias("base_failed"), passes(CURRENT).alias("kept"))


def op2_sql() -> str:
    bits = " + ".join(f"CASE WHEN {test} THEN {1 << i} ELSE 0 END" for i, test in enumerate(RULES.values()))
    return f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
win AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range(5) AS o(j) GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals, length(text) - length(replace(text, '!', '')) AS n_bangs
  FROM w LEFT JOIN covered USING (r)),
f AS (SELECT *, {bits} AS failures FROM m)
SELECT doc_id, {', '.join(MEASURES)}, CAST(failures AS BIGINT) AS failures, (failures & {mask('base')}) <> 0 AS base_failed, (failures & {mask(CURRENT)}) = 0 AS kept FROM f"""
