"""Operator 9: toxicity by gradient-boosted trees over dense features.

Three parts of a bounded sample of labelled rows are used one after the other,
so that no part judges what was learned from it: the first gives the lexicon
(words, and word beginnings of 4 to 6 bytes, that stand in many toxic and
hardly any other texts), the second the trees, the third the isotonic
calibration. The features of a text: densities of lexicon words and
beginnings, how near they stand to a second-person word, capitals,
punctuation, and obfuscated words (letters mixed with digits or symbols).
Digits and symbols that replace letters are read as those letters.

The sample holds ``SAMPLE`` toxic and twice as many other rows at most, by a
hash of their id, and weights restore the share of toxic rows. The lexicon
holds ``LEXICON`` entries at most. All documents are scored.

Defined cases: a null or empty text has all features 0 and the score that
goes with them; rows without text are scored too; labels of ids given twice
count as the larger; null labels and null ids are not learned from; without
labels of both kinds every score is the share of toxic labels (0 if none);
repeated rows score alike; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simlattice.llm.features import BANGS, CAPITALS, STOPS, rates
from simlattice.llm.words import buffers, chunks, mix, span_hashes
from simlattice.runtime import cut

SAMPLE = 5000
STEMS = (4, 5, 6)

# Second-person words of the languages at hand, and the letters that digits and symbols replace.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
REPLACED = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

FEATURES = ["words_hit", "words_rate", "stems_hit", "stems_rate", "near_second", "second_rate", "capitals", "bangs", "stops", "obfuscated", "log_words"]


def letter_table() -> np.ndarray:
    """Byte after reading A-Z as a-z and replaced letters as letters; 0 for what parts words."""
    table = np.zeros(256, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    for a, b in REPLACED.items():
        table[ord(a)] = ord(b)
    return table


def letter_words(data: np.ndarray, offsets: np.ndarray):
    """Hash, row, start and end of every run of letters, and the plain bytes."""
    plain = letter_table()[data]
    inside = plain > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return span_hashes(plain, starts, ends), np.searchsorted(offsets[1:], starts, "right"), starts, ends, plain


def stem_hashes(plain, starts, ends):
    """Per length of ``STEMS``: hash of the beginning and the places of the words longer than it."""
    for size in STEMS:
        long = np.flatnonzero(ends - starts > size)
        yield mix(span_hashes(plain, starts[long], starts[long] + size) + np.uint64(size)), long


def known(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in the sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def second_person() -> np.ndarray:
    raw = [w.encode() for w in SECOND_PERSON]
    ends = np.cumsum([len(r) for r in raw])
    return np.sort(span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends))


def features(data: np.ndarray, offsets: np.ndarray, words: np.ndarray, stems: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    hashes, rows, starts, ends, plain = letter_words(data, offsets)
    total = np.bincount(rows, minlength=n)
    per = np.maximum(total, 1)
    hit = known(hashes, words)
    stem = np.zeros(len(hashes), bool)
    for values, long in stem_hashes(plain, starts, ends):
        stem[long] |= known(values, stems)
    second = known(hashes, second_person())
    near = np.zeros(n)
    any_hit = hit | stem
    if any_hit.any() and second.any():
        at = np.flatnonzero(second)
        hits = np.flatnonzero(any_hit)
        right = np.minimum(np.searchsorted(at, hits), len(at) - 1)
        left = np.maximum(right - 1, 0)
        gap = np.full(len(hits), 1e9)
        for side in (left, right):
            same = rows[at[side]] == rows[hits]
            gap = np.where(same, np.minimum(gap, np.abs(at[side] - hits)), gap)
        np.maximum.at(near, rows[hits], 1 / (1 + gap))
    found = rates(data, offsets, [CAPITALS, BANGS, STOPS])
    size = np.maximum(np.diff(offsets), 1)
    letter = ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122))
    swapped = np.zeros(256, bool)
    swapped[[ord(c) for c in REPLACED] + [ord("*"), ord("#")]] = True
    inner = np.zeros(len(data), bool)
    inner[1:-1] = swapped[data[1:-1]] & letter[:-2] & letter[2:]
    sums = np.concatenate([[0], np.cumsum(inner)])
    return np.stack([
        np.log1p(np.bincount(rows[hit], minlength=n)), np.bincount(rows[hit], minlength=n) / per, np.log1p(np.bincount(rows[stem], minlength=n)), np.bincount(rows[stem], minlength=n) / per,
        near, np.bincount(rows[second], minlength=n) / per, found[:, 0] / size, found[:, 1] / per, found[:, 2] / per, (sums[offsets[1:]] - sums[offsets[:-1]]) / per, np.log1p(total),
    ], axis=1)


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32) -> dict:
    """Gradient-boosted trees for the logistic loss, on quantile bins."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    share = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
    start = float(np.log(share / (1 - share)))
    value = np.full(len(y), start)
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-value))
        g, h = weight * (y - p), weight * p * (1 - p) + 1e-9
        node = np.zeros(len(y), np.int64)
        nodes = 2 ** (depth + 1) - 1
        feature, edge, leaf = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        for at in range(nodes):
            own = np.flatnonzero(node == at)
            if not len(own):
                continue
            gs, hs = g[own].sum(), h[own].sum()
            leaf[at] = rate * gs / (hs + 1)
            if at >= 2**depth - 1 or len(own) < 10:
                continue
            best = (1e-6, None)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                gl = np.cumsum(np.bincount(binned[own, j], g[own], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[own, j], h[own], len(c) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], (j, i))
            if best[1]:
                feature[at], i = best[1]
                edge[at] = cuts[feature[at]][i]
                node[own] = 2 * at + 1 + (binned[own, feature[at]] > i)
        trees.append((feature, edge, leaf))
        value += _leaves(trees[-1], x)
    return {"start": start, "trees": trees}


def _leaves(tree, x: np.ndarray) -> np.ndarray:
    feature, edge, leaf = tree
    node = np.zeros(len(x), np.int64)
    while True:
        f = feature[node]
        go = np.flatnonzero(f >= 0)
        if not len(go):
            return leaf[node]
        node[go] = 2 * node[go] + 1 + (x[go, f[go]] > edge[node[go]])


def raw_score(model: dict, x: np.ndarray) -> np.ndarray:
    return model["start"] + sum((_leaves(t, x) for t in model["trees"]), np.zeros(len(x)))


def isotonic(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the steps of the best rising curve through the points, by pooling neighbours that fall."""
    order = np.argsort(z, kind="stable")
    z, y, weight = z[order], y[order], weight[order]
    groups = np.append(np.flatnonzero(z[1:] != z[:-1]), len(z) - 1)
    ws, ys = np.diff(np.append(0, np.cumsum(weight)[groups])), np.diff(np.append(0, np.cumsum(weight * y)[groups]))
    pools: list[list[float]] = []
    for top, w, s in zip(z[groups], ws, ys):
        pools.append([top, top, w, s])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            low, _, w0, s0 = pools[-2]
            pools[-2:] = [[low, pools[-1][1], w0 + pools[-1][2], s0 + pools[-1][3]]]
    xs = np.array([e for p in pools for e in (p[0], p[1])])
    return xs, np.array([e for p in pools for e in ((p[3] + 0.5 * 0.1) / (p[2] + 0.1),) * 2])


def sampled(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, usable: Column, per_class: dict[int, int]) -> DataFrame:
    """``id, text, y, part`` of a bounded sample of the labelled rows, each text once; ``part``: a number from 0 to 99."""
    found = labels.filter(usable & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("y"))
    order = F.md5(F.concat(F.lit("sample:"), F.col(key).cast("string")))
    chosen = None
    for y, n in per_class.items():
        part = found.filter(F.col("y") == y).orderBy(order, key).limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = cut(chosen)  # bounded by per_class, so it may be broadcast
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), key)
    hashed = rows.withColumn("_h", F.md5("text"))
    once = hashed.groupBy("_h").agg(F.min_by(F.struct(F.col(key).alias("id"), "text", "y"), F.col(key)).alias("r"))
    return cut(once.select("r.id", "r.text", "r.y", F.pmod(F.xxhash64("_h"), F.lit(100)).cast("int").alias("part")))


def mine(rows: DataFrame, n_toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """Lexicon words and beginnings from ``text, y``: in half a percent of the toxic texts at least, and nearly only there.

    That share bounds their number: by 200 times the mean of distinct words and
    beginnings in the toxic texts of the sample.
    """

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            y = batch.column(1).to_numpy()
            for first, last in chunks(offsets):
                base = offsets[first]
                hashes, of, starts, ends, plain = letter_words(data[base : offsets[last]], offsets[first : last + 1] - base)
                seen = [(hashes, of, 0)] + [(v, of[long], 1) for v, long in stem_hashes(plain, starts, ends)]
                for values, r, stem in seen:
                    pair = np.unique(np.stack([values, r.astype(np.uint64)]), axis=1)
                    keys, which = np.unique(pair[0], return_inverse=True)
                    toxic = np.bincount(which, y[first:last][pair[1].astype(np.int64)], len(keys)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), stem, np.int32)), pa.array(toxic), pa.array(np.bincount(which, minlength=len(keys)))], ["h", "stem", "toxic", "docs"])

    least = max(2, n_toxic // 200)
    counts = rows.select("text", "y").mapInArrow(run, "h long, stem int, toxic long, docs long").groupBy("h", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))
    found = counts.filter((F.col("toxic") >= least) & (F.col("toxic") * 20 >= F.col("docs") * 19)).collect()
    return tuple(np.sort(np.array([r["h"] for r in found if r["stem"] == s], np.int64).view(np.uint64)) for s in (0, 1))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """Lexicon, trees and calibration from the labelled rows for which ``usable`` holds."""
    share = {int(r["y"]): r["n"] for r in labels.filter(usable & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("y")).groupBy("y").agg(F.count("y").alias("n")).collect()}
    rows = sampled(docs, labels, label, key, text, usable, {1: SAMPLE, 0: 2 * SAMPLE})
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("y").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return {"constant": share.get(1, 0) / max(1, sum(share.values()))}
    n_mine = rows.filter("part < 50 and y = 1").count()
    words, stems = mine(rows.filter("part < 50"), n_mine)

    def run(batches):
        for batch in batches:
            for x, first, last in _feature_chunks(batch.column(0), words, stems):
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64())), *(batch.column(c).slice(first, last - first) for c in (1, 2))], ["x", "y", "part"])

    table = rows.filter("part >= 50").select("text", "y", "part").mapInArrow(run, "x array<double>, y int, part int").toPandas().sort_values(["part", "y", "x"], key=lambda s: s.map(str))
    if table.y.nunique() < 2:
        return {"constant": share.get(1, 0) / max(1, sum(share.values()))}
    x, y = np.array(table.x.tolist()), table.y.to_numpy(float)
    weight = np.where(y == 1, share.get(1, 1) / sizes[1], share.get(0, 1) / sizes[0])
    late = table.part.to_numpy() >= 85
    if min(y[late].sum(), (1 - y[late]).sum()) < 5:
        late = np.ones(len(y), bool)  # too few rows of their own: calibrate on all
    early = ~late if not late.all() else late
    model = boost(x[early], y[early], weight[early])
    xs, ys = isotonic(raw_score(model, x[late]), y[late], weight[late])
    return {"words": words, "stems": stems, "model": model, "xs": xs, "ys": ys}


def _feature_chunks(column: pa.Array, words, stems):
    data, offsets = buffers(column)
    for first, last in chunks(offsets):
        base = offsets[first]
        yield features(data[base : offsets[last]], offsets[first : last + 1] - base, words, stems), first, last


def scores(docs: DataFrame, fitted: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score, predicted`` of every row. The steps are joined by lines, and a trace of the raw score parts equal values."""

    def run(batches):
        for batch in batches:
            out = []
            for x, _, _ in _feature_chunks(batch.column(1), fitted.get("words"), fitted.get("stems")) if "model" in fitted else ():
                z = raw_score(fitted["model"], x)
                out.append(0.999 * np.interp(z, fitted["xs"], fitted["ys"]) + 0.001 / (1 + np.exp(-z)))
            score = np.concatenate(out) if out else np.full(len(batch), fitted.get("constant", 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", key)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored; labels of rows with crc32(doc_id) mod 5 = 0 are not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    fitted = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    return scores(docs, fitted).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")
