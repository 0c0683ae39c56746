"""Readers of similarity files, entity lists, labels and feature vectors.

Pair readers return ``(source, id1, id2, similarity, seq)`` for
``build_matrices``; ``seq`` orders repeated pairs by file and line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simlattice.functions.numeric import finite
from simlattice.functions.text import owner_repo
from simlattice.operators.matrix import Matrices, build_matrices
from simlattice.runtime import cut, numbered

# Number formats of the files (fixed values).
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
SPECIAL = r"[-+]?(?:nan|inf|infinity)"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def number(text: Column) -> Column:
    """Value of a number in text, null if it is none."""
    text = strip(text)
    return F.when(text.rlike(f"(?i)^(?:{NUMBER}|{SPECIAL})$"), text.try_cast("double"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the order they have in their file."""
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_name").alias("file"),
        F.struct(
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("seq"),
    )


def _pair_lines(spark: SparkSession, path: str, marks: tuple[str, ...]) -> DataFrame:
    """Lines of the ``.txt`` files whose name contains one of ``marks``, split at tabs."""
    named = F.col("file").endswith(".txt")
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.col("file").contains(m)
    lines = _lines(spark, path).withColumn("file", F.url_decode(F.regexp_replace("file", r"\+", "%2B")))
    return lines.filter(named & marked).withColumn("part", F.split(strip(F.col("value")), "\t"))


def read_pair_files(spark: SparkSession, path: str, source: str, url_keys: bool = False) -> DataFrame:
    """Tab-separated pair files of a folder.

    Plain keys come from names with ``|`` or ``__``, URL keys from names with
    ``|``. Lines without three fields or without a number are left out.
    """
    lines = _pair_lines(spark, path, ("|",) if url_keys else ("|", "__"))
    kept = lines.filter(F.size("part") == 3).withColumn("similarity", number(F.col("part")[2])).filter(F.col("similarity").isNotNull())

    def key(i: int) -> Column:
        part = F.col("part")[i]
        return strip(owner_repo(part) if url_keys else part)

    return kept.select(F.lit(source).alias("source"), key(0).alias("id1"), key(1).alias("id2"), "similarity", "seq")


def rejected_lines(spark: SparkSession, path: str, url_keys: bool = False) -> DataFrame:
    """Lines the pair reader leaves out, counted per file and reason."""
    lines = _pair_lines(spark, path, ("|",) if url_keys else ("|", "__"))
    reason = F.when(F.size("part") != 3, "fields").when(number(F.col("part")[2]).isNull(), "number")
    return lines.withColumn("reason", reason).filter("reason IS NOT NULL").groupBy("file", "reason").count()


def read_wide_matrix(spark: SparkSession, path: str, source: str, clean: bool = True) -> Matrices:
    """Wide CSV: the first column names the row, the others are its cells in row order.

    Cells are read by position: the j-th belongs to the j-th row, whatever the
    header says. The cell above the diagonal is the one that counts. Missing
    and infinite cells become 0; ``clean=False`` keeps them.
    """
    table = spark.read.csv(path, header=True)
    first, *names = table.columns
    cells = F.array(*[number(F.col(f"`{c}`")) for c in names])
    rows = table.select(
        F.col(f"`{first}`").alias("id1"), cells.alias("cells"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line"),
    )
    rows = cut(numbered(rows, [], ["_file", "_start", "_line"], "row").select("row", "id1", "cells"))
    others = rows.select(F.col("row").alias("at"), F.col("id1").alias("id2"))
    cell = rows.select("row", "id1", F.posexplode("cells").alias("at", "value")).filter(F.col("at") >= F.col("row"))
    value = finite(F.col("value")) if clean else F.col("value")
    pairs = cell.withColumn("at", F.col("at").cast("long")).join(others, "at").withColumn("similarity", value)
    upper = pairs.select(F.lit(source).alias("source"), F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), "similarity")
    stored = upper.filter(F.col("similarity").isNull() | (F.col("similarity") != 0))
    return Matrices(stored, rows.select(F.lit(source).alias("source"), F.col("id1").alias("id")).distinct())


def read_positional_matrix(spark: SparkSession, index_path: str, result_path: str, source: str) -> Matrices:
    """Matrix dump with rows ``BlockRealMatrix{{v, v}}`` and an index ``i: key``.

    Row and column numbers are positions in the index file. Bad values and
    short rows count as 0 and long rows are cut. Of the two cells of a pair the
    later row decides, unless it is NaN.
    """
    entry = F.split(strip(F.col("value")), ": ", 2)
    lines = _lines(spark, index_path).filter(F.size(entry) == 2).select(
        strip(entry[0]).try_cast("long").alias("no"), strip(entry[1]).alias("id"), "seq"
    )
    keys = lines.filter("no IS NOT NULL").groupBy("no").agg(F.min("seq").alias("seq"), F.max_by("id", "seq").alias("id"))
    at = cut(numbered(keys.select("id", "seq"), [], ["seq"], "pos").select("id", "pos"))
    size = at.count()

    inside = F.regexp_extract("value", r"BlockRealMatrix\{\{(.*?)\}\}", 1)
    matrix = _lines(spark, result_path).filter(F.col("value").rlike(r"BlockRealMatrix\{\{(.*?)\}\}")).select(inside.alias("cells"), "seq")
    rows = numbered(matrix, [], ["seq"], "row").select("row", F.posexplode(F.split("cells", r"[,\s]+")).alias("col", "text"))
    cells = rows.filter((F.col("row") < size) & (F.col("col") < size)).select(
        "row", F.col("col").cast("long").alias("col"), F.coalesce(number(F.col("text")), F.lit(0.0)).alias("value")
    )
    pairs = cells.groupBy(F.least("row", "col").alias("p1"), F.greatest("row", "col").alias("p2")).agg(
        F.max(F.when(F.col("row") >= F.col("col"), F.col("value"))).alias("later"),
        F.max(F.when(F.col("row") < F.col("col"), F.col("value"))).alias("earlier"),
    )
    value = finite(F.when(F.isnan("later"), F.col("earlier")).otherwise(F.col("later")))
    named = (
        pairs.select("p1", "p2", value.alias("similarity")).filter("similarity != 0")
        .join(at.select(F.col("pos").alias("p1"), F.col("id").alias("a")), "p1")
        .join(at.select(F.col("pos").alias("p2"), F.col("id").alias("b")), "p2")
    )
    stored = named.select(F.lit(source).alias("source"), F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"), "similarity")
    return Matrices(stored, at.select(F.lit(source).alias("source"), "id").distinct())


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entity list, one key per line; blank lines are left out."""
    return spark.read.text(path).select(strip(F.col("value")).alias("id")).filter("id != ''")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label file ``key,label,``: ``(id, label)``, the last line of a key wins.

    A byte order mark, carriage returns and blank lines are skipped; the first
    line that is left is the header.
    """
    text = F.regexp_replace("value", "^﻿|\r$", "")
    lines = _lines(spark, path).select(text.alias("value"), "seq").filter(F.trim("value") != "")
    fields = F.from_csv("value", F.lit("id string, label string, rest string"))
    rows = numbered(lines, [], ["seq"], "line").filter("line > 0").select(fields.alias("f"), "line")
    return last_labels(rows.select("f.id", "f.label", "line"))


def last_labels(rows: DataFrame) -> DataFrame:
    """Label of the last ``line`` of every key of ``rows(id, label, line)``."""
    return rows.groupBy("id").agg(F.max_by("label", "line").alias("label"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vector CSV: ``(id, vector)`` from cells that are numbers or tuples in text.

    The numbers of all cells are joined in column order. Text is searched for
    numbers and never run as code; an empty cell is NaN.
    """
    table = spark.read.csv(path, header=True, escape='"')
    first, *names = table.columns

    def numbers(name: str) -> Column:
        text = F.regexp_replace(F.coalesce(F.col(f"`{name}`"), F.lit("nan")), r"np\.float\d+\(", "(")
        found = F.regexp_extract_all(text, F.lit(f"(?i)({NUMBER}|{SPECIAL})"), F.lit(1))
        return F.transform(found, lambda x: x.cast("double"))

    return table.select(F.col(f"`{first}`").alias("id"), F.flatten(F.array(*[numbers(c) for c in names])).alias("vector"))


Loader = Callable[[SparkSession], Matrices | DataFrame]


def load_sources(spark: SparkSession, registry: dict[str, Loader], names: list[str]) -> Matrices:
    """Matrices of the named sources; a loader returns matrices or raw pair rows."""
    unknown = [n for n in names if n not in registry]
    if unknown:
        raise ValueError(f"unsupported data source: {unknown}")
    loaded = None
    for name in names:
        data = registry[name](spark)
        data = data if isinstance(data, Matrices) else build_matrices(data)
        pairs, ids = (d.withColumn("source", F.lit(name)) for d in data)
        loaded = Matrices(pairs, ids) if loaded is None else Matrices(loaded.pairs.unionByName(pairs), loaded.ids.unionByName(ids))
    return loaded


def cached(spark: SparkSession, folder: str, build: Callable[[], Matrices]) -> Matrices:
    """Matrices saved in ``folder``, computed and saved there on the first call.

    A hit needs both tables whole, i.e. with the mark that Spark leaves at the
    end of a write; then ``build`` does not run.
    """
    parts = [f"{folder}/{name}" for name in Matrices._fields]
    if not all(_complete(spark, part) for part in parts):
        for table, part in zip(build(), parts):
            table.write.mode("overwrite").parquet(part)
    return Matrices(*(spark.read.parquet(part) for part in parts))


def _complete(spark: SparkSession, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)
