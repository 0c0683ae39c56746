import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from simlattice.functions import numeric, text


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_owner_repo_follows_the_slice_rule(spark):
    urls = ["git://github.com/own/rep.git", "own/rep.git", "rep.git", "a/b", "x", "", "a.b/c/d", "/", "h/o/r.x.y", "no-dot/own/repo"]

    def sliced(url):
        slash = url.rfind("/")
        return url[url.rfind("/", 0, slash) + 1 : url.rfind(".")]

    got = values(spark, [(u,) for u in urls], "u string", "u", text.owner_repo(F.col("u")))
    assert dict(got) == {u: sliced(u) for u in urls}


def test_name_functions(spark):
    got = values(spark, [("Ab-éi9", "Ab")], "a string, b string", text.vowel_count(F.col("a")), text.letter_count(F.col("a")),
                 text.levenshtein_similarity(F.col("a"), F.col("b")), text.levenshtein_similarity(F.lit(""), F.lit("")),
                 text.jaccard(text.characters(F.col("a")), text.characters(F.col("b"))),
                 text.jaccard(text.characters(F.lit("")), text.characters(F.lit(""))), text.rename({"Ab": "x"}, F.col("b")), text.rename({}, F.col("b")))
    assert got == [(2, 4, pytest.approx(2 / 6), 1.0, pytest.approx(2 / 6), 0.0, "x", "Ab")]


def test_hash_point(spark):
    digest = hashlib.sha256(b"own/rep").hexdigest()
    expected = [np.float32(int(digest[i : i + 8], 16) % 1000 / 1000) for i in (0, 8, 16)]
    (got,) = values(spark, [("own/rep",)], "a string", text.hash_point(F.col("a")))
    assert [np.float32(x) for x in got[0]] == expected


def test_distances(spark):
    row = values(spark, [([0.0, 3.0], [4.0, 0.0])], "a array<double>, b array<double>", numeric.euclidean(F.col("a"), F.col("b")),
                 numeric.minkowski(F.col("a"), F.col("b"), 3), numeric.cosine(F.col("a"), F.col("b")), numeric.euclidean_similarity(F.col("a"), F.col("a")),
                 numeric.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.col("b")))
    assert row == [(5.0, pytest.approx((64 + 27) ** (1 / 3)), 0.0, 1.0, 0.0)]


def test_vector_distance_takes_any_width_and_weights(spark):
    d = [F.lit(x) for x in (1.0, 2.0, 2.0, 4.0)]
    row = values(spark, [(1,)], "a int", numeric.vector_distance(d[:1]), numeric.vector_distance(d), numeric.vector_distance(d[:2], [4.0, 3.0]))
    assert row == [(1.0, 5.0, 4.0)]
    with pytest.raises(ValueError):
        numeric.vector_distance(d, [1.0])


def test_finite(spark):
    got = values(spark, [(1.5,), (math.nan,), (math.inf,), (-math.inf,), (None,)], "v double", numeric.finite(F.col("v")))
    assert [g[0] for g in got] == [1.5, 0.0, 0.0, 0.0, 0.0]
