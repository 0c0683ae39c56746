"""Similarity joins of the characters of keys: prefixes over distinct feature vectors.

Keys with the same characters are one class, and only classes are joined.
Features are ordered from the rarest on, the same for all. If the first feature
that two vectors share is late in that order, too little is left to reach the
similarity; so each is filed under its leading features alone, and meets
others there (Bayardo, Ma and Srikant, All-Pairs, WWW 2007). For sets, a vector
meets only sizes within the similarity (bands of sizes, neighbouring ones
together). A feature that very many classes share is dealt to pairs of blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simlattice.functions.text import characters
from simlattice.runtime import cut

#: Classes of one block; a task compares two blocks.
BLOCK_ROWS = 2000


def classes_of(names: DataFrame, text: Column, counts: bool) -> tuple[DataFrame, DataFrame]:
    """``(members, classes)`` of the distinct ``names(id)``: ``id, uid`` and ``uid, chars`` (sorted, repeated if ``counts``)."""
    chars = characters(text)
    key = F.array_join(F.array_sort(chars if counts else F.array_distinct(chars)), "")
    keys = cut(names.select("id").distinct().select("id", key.alias("chars")).filter("length(chars) > 0"))
    classes = cut(keys.select("chars").distinct().select(F.monotonically_increasing_id().alias("uid"), "chars"))
    return cut(keys.join(classes, "chars").select("id", "uid")), classes


def filed(classes: DataFrame, min_similarity: float, counts: bool) -> DataFrame:
    """``cell, band, side, uid, f, w`` : every class under its leading features ``cell``; ``f``: features from the rarest on, ``w``: counts."""
    features = cut(classes.select("uid", F.explode(characters(F.col("chars"))).alias("c")).groupBy("uid", "c").agg(F.count("c").cast("int").alias("w")))
    # One row per kind of character, so at most as many as Unicode has.
    order = cut(features.groupBy("c").agg(F.count("uid").alias("n")).withColumn("f", F.row_number().over(Window.orderBy("n", "c"))).select("c", "f"))
    ranked = features.join(order, "c").select("uid", "f", "w")
    mass = F.col("w").cast("long") * F.col("w") if counts else F.lit(1).cast("long")
    rest = Window.partitionBy("uid").orderBy(F.desc("f"))
    tail = ranked.withColumn("mass", mass).withColumn("tail", F.sum("mass").over(rest)).withColumn("total", F.sum("mass").over(Window.partitionBy("uid")))
    needed = min_similarity**2 if counts else min_similarity
    vectors = ranked.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("f", "w"))).alias("v"))  # as long as the key at most
    leading = tail.filter(F.col("tail") >= F.col("total") * needed - 1e-9).select("uid", F.col("f").alias("cell"), "total")
    rows = leading.join(vectors, "uid").select("cell", "uid", "total", F.col("v.f").alias("f"), F.col("v.w").alias("w"))
    if counts or min_similarity == 1:
        return rows.select("cell", F.lit(0).alias("band"), F.lit(0).alias("side"), "uid", "f", "w")
    band = F.floor(F.log("total") / math.log(1 / min_similarity) + 1e-9).cast("int")
    both = F.array(F.struct(band.alias("band"), F.lit(0).alias("side")), F.struct((band - 1).alias("band"), F.lit(1).alias("side")))
    return rows.withColumn("at", F.explode(both)).select("cell", "at.band", "at.side", "uid", "f", "w")


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """Rows of each cell dealt to pairs of blocks ``x <= y``; ``own``: the block of the row."""
    sizes = cut(rows.groupBy("cell", "band").agg(F.ceil(F.count("uid") / block).cast("int").alias("blocks")))
    rows = rows.join(sizes, ["cell", "band"]).withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("other", "blocks")


def _compare(min_similarity: float, counts: bool):
    def compare(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        uid, side, own = (group.column(c).to_numpy() for c in ("uid", "side", "own"))
        lists = group.column("f").combine_chunks()
        codes, flat = np.unique(np.asarray(lists.flatten()), return_inverse=True)
        m = np.zeros((len(uid), len(codes)))
        m[np.repeat(np.arange(len(uid)), np.asarray(lists.value_lengths())), flat] = np.asarray(group.column("w").combine_chunks().flatten()) if counts else 1
        size = (m * m).sum(axis=1)
        within = key[2].as_py() == key[3].as_py()
        left = np.flatnonzero(own == key[2].as_py())
        right = left if within else np.flatnonzero(own == key[3].as_py())
        cell = int(np.searchsorted(codes, key[0].as_py()))
        out = []
        for start in range(0, len(left), 256):
            rows = left[start : start + 256]
            common = m[rows] @ m[right].T
            if counts:
                near = common >= (min_similarity - 1e-9) * np.sqrt(size[rows][:, None] * size[right][None, :])
            else:
                near = common >= min_similarity * (size[rows][:, None] + size[right][None, :] - common) - 1e-9
            i, j = np.nonzero(near)
            a, b, both = rows[i], right[j], common[i, j]
            keep = (side[a] == 0) | (side[b] == 0)
            if within:
                keep &= uid[a] < uid[b]
            a, b, both = a[keep], b[keep], both[keep]
            # A pair counts under the first feature that it shares.
            first = ((m[a] > 0) & (m[b] > 0)).argmax(axis=1) == cell if len(a) else np.zeros(0, bool)
            out.append((uid[a[first]], uid[b[first]], both[first], size[a[first]], size[b[first]]))
        columns = [np.concatenate(c) if out else np.zeros(0) for c in zip(*out)] or [np.zeros(0)] * 5
        return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip(("a", "b", "common", "size_a", "size_b"), columns)})

    return compare


def feature_pairs(names: DataFrame, text: Column, min_similarity: float, counts: bool) -> DataFrame:
    """``id1, id2, similarity`` of the keys ``names(id)``: cosine of the character counts of ``text``, or Jaccard of its sets."""
    members, classes = classes_of(names, text, counts)
    rows = _dealt(filed(classes, min_similarity, counts), BLOCK_ROWS)
    found = rows.groupBy("cell", "band", "x", "y").applyInArrow(_compare(min_similarity, counts), "a long, b long, common long, size_a long, size_b long")
    if counts:
        # The root of the product is exact where the cosine is a fraction of whole numbers, so the limit is met there.
        exact, similarity = F.col("common") / F.sqrt(F.col("size_a") * F.col("size_b")), F.col("common") / (F.sqrt("size_a") * F.sqrt("size_b"))
    else:
        exact = similarity = F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))
    found = found.filter(exact >= min_similarity).withColumn("similarity", similarity)
    one, other = (members.select(F.col("uid").alias(u), F.col("id").alias(i)) for u, i in (("a", "p"), ("b", "q")))
    between = found.select("a", "b", "similarity").join(one, "a").join(other, "b")
    inside = one.join(other.withColumnRenamed("b", "a"), "a").filter("p < q").withColumn("similarity", F.lit(1.0))
    pairs = between.select("p", "q", "similarity").unionByName(inside.select("p", "q", "similarity"))
    return pairs.select(F.least("p", "q").alias("id1"), F.greatest("p", "q").alias("id2"), "similarity")
