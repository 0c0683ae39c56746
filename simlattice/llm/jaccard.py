"""Operator 3: shingle sets joined by Jaccard similarity through signature trees.

1. Texts with equal shingle sets are one class; the smallest id stands for it.
2. The ``size - ceil(t * size) + 1`` shingles of lowest hash of two linked sets
   have one in common, so the sets that hold such a shingle form a cell, and
   no link runs outside the cells; the smaller set of a pair has it among its
   ``size - ceil(2 * t / (1 + t) * size) + 1`` lowest. Of cells with the same
   members one is kept.
3. Every cell is first linked along its smallest id. Members that this
   connects need no second look at each other.
4. Cells that share most of their members are merged. In every one that still
   holds several components, a signature tree is built over the members in order of size: a leaf is the bitmap of one set, a
   node the OR of two children with their range of sizes. The dual traversal
   starts with the root against itself and drops a pair of nodes whose sizes
   exclude the similarity, whose common bits cannot hold the shingles needed,
   or whose members are connected already. Large cells are cut into blocks of
   members, and each pair of blocks of fitting sizes is a tree pair of its own.
5. What is left is compared exactly, and the links give the components.

No pair within the threshold is lost: steps 2 and 4 drop only pairs whose
overlap is provably too small. ``component_id`` needs no more than a spanning
set of links; ``links`` (general interface) returns those found.

Defined cases: a null or empty text, or one without words, has size 0 and no
links; a text of fewer than five words is one shingle; a null id has a null
component; of rows with one id and several texts one text stands for the id;
repeated rows give repeated results; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlattice.llm.words import buffers, chunks, lower_ascii, mix, shingle_hashes, span_hashes, word_spans
from simlattice.runtime import cut, numbered

BLOCK = 4096
FRONTIER = 200_000
SALT = 2048
BITS = 4
BROADCAST = 300_000  # rows of four numbers, about 15 MB; longer lists are joined by shuffle


def shingle_sets(column: pa.Array, size: int = 5):
    """Sorted distinct shingle hashes of every row, in chunks: first row, hashes, counts."""
    data, offsets = buffers(column)
    for first, last in chunks(offsets):
        base, n = offsets[first], last - first
        part = lower_ascii(data[base : offsets[last]])
        starts, ends, rows = word_spans(part, offsets[first : last + 1] - base)
        hashes, rows = shingle_hashes(span_hashes(part, starts, ends), rows, n, size)
        order = np.lexsort((hashes, rows))
        hashes, rows = hashes[order], rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        yield first, hashes[new], np.bincount(rows[new], minlength=n)


def bitmap(hashes: np.ndarray) -> bytes:
    """Bitmap of a set, with 4 to 8 bits a shingle (a power of two, 64 at least)."""
    bits = max(64, 1 << int(BITS * len(hashes) - 1).bit_length()) if len(hashes) else 64
    marks = np.zeros(bits, bool)
    marks[(mix(hashes) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(marks, bitorder="little").tobytes()


def describe(docs: DataFrame, key: str, text: str, percent: int, size: int) -> DataFrame:
    """``id, n, fp1, fp2, prefix, sig`` of every row; prefix: the shingles of lowest hash that a linked set must meet."""

    def run(batches):
        for batch in batches:
            for first, hashes, counts in shingle_sets(batch.column(1), size):
                out = [], [], [], [], []
                ends = np.cumsum(counts)
                for a, b in zip((ends - counts).tolist(), ends.tolist()):
                    own, n = hashes[a:b], b - a
                    out[0].append(n)
                    out[1].append(int(mix(own).sum(dtype=np.uint64).astype(np.int64)))
                    out[2].append(int(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                    out[3].append(own[: n - -(-percent * n // 100) + 1].astype(np.int64) if n else None)
                    out[4].append(bitmap(own) if n else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(counts)), *map(pa.array, out, kinds)], ["id", "n", "fp1", "fp2", "prefix", "sig"])

    kinds = pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"id {kind}, n long, fp1 long, fp2 long, prefix array<long>, sig binary")


def components(links: DataFrame) -> DataFrame:
    """``id, comp``: the smallest id reachable from every id of the links ``a, b``.

    Each round takes the smallest neighbour and then the neighbour's own
    choice, which halves the depth; all tables stay as long as the links.
    """
    edges = cut(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    comp = cut(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")))
    while True:
        near = edges.join(comp.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        step = comp.join(near, "id").select("id", "comp", F.least("comp", "m").alias("new"))
        jump = comp.select(F.col("id").alias("new"), F.col("comp").alias("far"))
        after = cut(step.join(jump, "new").select("id", "comp", F.least("new", "far").alias("new")))
        if not after.filter("new != comp").limit(1).count():
            return comp
        comp = after.select("id", F.col("new").alias("comp"))


def overlap_needed(a, b, percent: int):
    """Smallest overlap of sets of sizes a and b with a similarity of ``percent`` at least."""
    return -(-percent * (a + b) // (100 + percent))


def verified(docs: DataFrame, pairs: DataFrame, key: str, text: str, percent: int, size: int) -> DataFrame:
    """Those of the pairs ``a, b`` that are similar enough, compared on their whole sets.

    The text of ``a`` meets those of its partners in one sorted run; a text
    with very many partners is copied to several runs.
    """
    pairs = cut(pairs.distinct())
    runs = pairs.groupBy("a").agg(F.ceil(F.count("b") / SALT).cast("int").alias("runs"))
    heads = runs.select("a", F.col("a").alias("id"), F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(0).alias("place"))
    tails = pairs.join(runs, "a").select("a", F.col("b").alias("id"), F.pmod(F.xxhash64("b"), F.col("runs")).cast("int").alias("run"), F.lit(1).alias("place"))
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    wanted = cut(heads.unionByName(tails))
    if wanted.count() <= BROADCAST:
        wanted = F.broadcast(wanted)
    rows = texts.join(wanted, "id").repartition("a", "run").sortWithinPartitions("a", "run", "place")

    def run(batches):
        head, own = None, None
        for batch in batches:
            a, place, ids = (batch.column(i).to_pylist() for i in (1, 3, 0))
            hits = [], []
            for first, hashes, counts in shingle_sets(batch.column(4), size):
                ends = np.cumsum(counts)
                for i, (x, y) in enumerate(zip((ends - counts).tolist(), ends.tolist()), first):
                    if place[i] == 0:
                        head, own = a[i], hashes[x:y].copy()
                    elif head == a[i] and y > x and len(own):
                        both = int(np.isin(hashes[x:y], own, assume_unique=True).sum())
                        if 100 * both >= percent * (len(own) + y - x - both):
                            hits[0].append(a[i])
                            hits[1].append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(h, batch.schema.field(0).type) for h in hits], ["a", "b"])

    kind = docs.schema[key].dataType.simpleString()
    return cut(rows.select("id", "a", "run", "place", "text").mapInArrow(run, f"a {kind}, b {kind}"))


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def dual_traversal(bits, sizes, comps, narrow, sides, percent):
    """Pairs of leaves that may be similar. Leaves come in order of size.

    ``narrow``: at least one leaf of a pair must have it; ``sides``: two leaves
    of different blocks must be one of each side (-1: no such rule).
    """
    n = len(sizes)
    filled = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    levels = [(bits, sizes, sizes, sizes - filled, comps, comps)]
    while len(levels[-1][1]) > 1:
        b, low, high, spare, c_low, c_high = levels[-1]
        even, odd = np.arange(0, len(low), 2), np.minimum(np.arange(0, len(low), 2) + 1, len(low) - 1)
        levels.append((b[even] | b[odd], np.minimum(low[even], low[odd]), np.maximum(high[even], high[odd]), np.maximum(spare[even], spare[odd]), np.minimum(c_low[even], c_low[odd]), np.maximum(c_high[even], c_high[odd])))
    root = np.zeros(min(1, n), np.int64)
    open_pairs, found = [(len(levels) - 1, root, root)], [np.zeros((2, 0), np.int64)]
    while open_pairs:  # depth first in bounded pieces, so the pairs held at once stay few
        depth, x, y = open_pairs.pop()
        if len(x) > FRONTIER:
            half = len(x) // 2
            open_pairs += [(depth, x[half:], y[half:]), (depth, x[:half], y[:half])]
            continue
        b, low, high, spare, c_low, c_high = levels[depth]
        keep = (100 * high[x] >= percent * low[y]) & (100 * high[y] >= percent * low[x])
        keep &= ~((c_low[x] == c_high[x]) & (c_low[y] == c_high[y]) & (c_low[x] == c_low[y]))
        if depth == 0:
            keep &= (x != y) & (narrow[x] | narrow[y])
            keep &= (sides[x] != sides[y]) | (sides[x] < 0)
        x, y = x[keep], y[keep]
        needed = overlap_needed(low[x], low[y], percent) - np.minimum(spare[x], spare[y])
        keep = np.zeros(len(x), bool)
        step = max(1, 500_000 // b.shape[1])
        for i in range(0, len(x), step):
            common = np.bitwise_count(b[x[i : i + step]] & b[y[i : i + step]]).sum(axis=1, dtype=np.int64)
            keep[i : i + step] = common >= needed[i : i + step]
        x, y = x[keep], y[keep]
        if depth == 0:
            found.append(np.stack([x, y]))
        elif len(x):
            kids = _children(x, y)
            open_pairs.append((depth - 1, *kids[:, (kids < len(levels[depth - 1][1])).all(axis=0)]))
    return np.concatenate(found, axis=1)


def _children(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs of children of node pairs; a node against itself has three."""
    other = x != y
    return np.concatenate([
        np.stack([2 * x, 2 * y]), np.stack([2 * x, 2 * y + 1]), np.stack([2 * x + 1, 2 * y + 1]), np.stack([2 * x[other] + 1, 2 * y[other]]),
    ], axis=1)


def tree_pairs(ids, sizes, comps, sides, sigs, percent):
    """Pairs of members of a cell that the signature trees leave.

    Bitmaps grow with the set in powers of two. Sets that can be linked have
    the same width or neighbouring ones, so there is one tree for each width
    with the next width folded into it.
    """
    widths = np.array([len(s) // 8 for s in sigs])
    found = []
    for width in np.unique(widths):
        own = np.flatnonzero((widths == width) | (widths == 2 * width))
        if len(own) < 2:
            continue
        own = own[np.lexsort((ids[own], sizes[own]))]
        bits = np.concatenate([fold(np.frombuffer(sigs[i], np.uint64).reshape(1, -1), width) for i in own])
        x, y = dual_traversal(bits, sizes[own], comps[own], widths[own] == width, sides[own], percent)
        found.append(np.stack([ids[own[x]], ids[own[y]]]))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), ids.dtype)
    return np.minimum(*pairs), np.maximum(*pairs)


def tree_join(members: DataFrame, sigs: DataFrame, percent: int, kind: str) -> DataFrame:
    """Pairs ``a, b`` left by the trees of all cells ``cell, id, n, comp``, cut into blocks by size; ``sigs``: the bitmaps."""
    sizes = members.groupBy("cell").agg(F.count("id").alias("m"))
    large = cut(sizes.filter(F.col("m") > BLOCK))
    small = members.join(large, "cell", "left_anti").select("cell", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(-1).alias("side"), "id", "n", "comp")
    if large.limit(1).count():
        placed = numbered(members.join(large.select("cell"), "cell", "left_semi").select("cell", "id", "n", "comp"), ["cell"], ["n", "id"])
        placed = cut(placed.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long")).drop("pos"))
        blocks = cut(placed.groupBy("cell", "block").agg(F.min("n").alias("low"), F.max("n").alias("high")))
        later = blocks.select("cell", F.col("block").alias("y"), F.col("low").alias("next_low"))
        pairs = blocks.select("cell", F.col("block").alias("x"), "high").join(later, "cell").filter("x <= y").filter(100 * F.col("high") >= percent * F.col("next_low"))
        pairs = cut(pairs.select("cell", "x", "y"))
        sides = pairs.select("cell", "x", "y", F.col("x").alias("block"), F.when(F.col("x") == F.col("y"), -1).otherwise(0).alias("side"))
        sides = sides.unionByName(pairs.filter("x < y").select("cell", "x", "y", F.col("y").alias("block"), F.lit(1).alias("side")))
        small = small.unionByName(placed.join(sides, ["cell", "block"]).select("cell", "x", "y", "side", "id", "n", "comp"))

    def run(batches):
        held, key = [], None

        def solve():
            table = pa.Table.from_batches(held)
            columns = [table.column(c).to_numpy() for c in ("id", "n", "comp", "side")]
            a, b = tree_pairs(columns[0], columns[1], columns[2], columns[3], table.column("sig").to_pylist(), percent)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("cell", "x", "y")]
            new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)) if len(batch) else np.zeros(0, bool)
            cuts = np.append(np.flatnonzero(new), len(batch))
            for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                at = tuple(k[first] for k in keys)
                if key != at and held:
                    yield solve()
                key = at
                held.append(batch.slice(first, last - first))
        if held:
            yield solve()

    return small.join(sigs, "id").repartition("cell", "x", "y").sortWithinPartitions("cell", "x", "y").mapInArrow(run, f"a {kind}, b {kind}")


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, size: int = 5) -> tuple[DataFrame, DataFrame]:
    """Description of all rows (``id, n, rep``) and the links ``a, b`` found between representatives.

    The links connect every two linked texts, directly or over others.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = cut(describe(docs, key, text, percent, size))
    classes = rows.filter("n > 0 and id is not null").groupBy("n", "fp1", "fp2").agg(F.min("id").alias("rep"))
    rows_of = cut(rows.select("id", "n", "fp1", "fp2").join(classes, ["n", "fp1", "fp2"], "left").select("id", "n", "rep"))
    reps = rows.join(classes.select("n", "fp1", "fp2", F.col("rep").alias("id")), ["n", "fp1", "fp2", "id"], "left_semi")
    inner = F.expr(f"n - div(2 * {percent} * n + {99 + percent}, {100 + percent}) + 1")
    prefix = reps.select("id", "n", F.posexplode("prefix").alias("pos", "cell")).select("cell", "id", (F.col("pos") >= inner).alias("outer"))
    held = cut(_shared(prefix, kind))
    cells = held.groupBy("cell").agg(F.count("id").alias("m"), F.min("id").alias("head"), F.sum(F.xxhash64("id") % 2**40).alias("mark"), F.min("outer").alias("outer"))
    cells = cut(cells.filter("not outer").groupBy("m", "head", "mark").agg(F.min("cell").alias("cell")))
    sizes = reps.select("id", "n").dropDuplicates(["id"])
    members = cut(held.select("cell", "id").join(cells.select("cell", "head", "m"), "cell").join(sizes, "id"))
    first = sizes.select(F.col("id").alias("head"), F.col("n").alias("head_n"))
    star = members.filter("id != head").select(F.col("head").alias("a"), F.col("id").alias("b"), "n").distinct().join(first.withColumnRenamed("head", "a"), "a")
    star = star.filter(100 * F.least("n", "head_n") >= percent * F.greatest("n", "head_n")).select("a", "b")
    sigs = reps.select("id", "sig").dropDuplicates(["id"])
    linked = verified(docs, _screened(star, reps, percent, kind), key, text, percent, size)
    comp = components(linked)
    rest = cut(_merged(members)).join(sizes, "id").join(comp, "id", "left").select("cell", "id", "n", F.coalesce("comp", "id").alias("comp"))
    mixed = rest.groupBy("cell").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("cell")
    open_cells = cut(rest.join(mixed, "cell"))
    more = verified(docs, tree_join(open_cells, sigs, percent, kind), key, text, percent, size)
    return rows_of, linked.unionByName(more)


def _merged(members: DataFrame) -> DataFrame:
    """``cell, id`` with every cell renamed to the larger one that it shares half of its members with.

    The larger one is the largest cell of the smallest member, so cells that
    one passage makes become one. All members of a cell get the same name, so
    no pair of a cell is parted.
    """
    best = members.groupBy("id").agg(F.max(F.struct("m", "cell")).alias("best"))
    heads = members.filter("id = head").select("cell", "id", "m").join(best, "id").filter("best.m > m").select("cell", F.col("best.cell").alias("parent"))
    inside = members.select("cell", "id", "m").join(heads, "cell").join(members.select(F.col("cell").alias("parent"), "id"), ["parent", "id"])
    near = cut(inside.groupBy("cell", "parent", "m").agg(F.count("id").alias("shared")).filter("2 * shared >= m").select("cell", "parent"))
    above = near.select(F.col("cell").alias("parent"), F.col("parent").alias("far"))
    name = near.join(above, "parent", "left").select("cell", F.coalesce("far", "parent").alias("name"))
    return members.join(name, "cell", "left").select(F.coalesce("name", "cell").alias("cell"), "id").distinct()


def _shared(prefix: DataFrame, kind: str) -> DataFrame:
    """Rows ``cell, id, outer`` whose cell has another row; the others end in the task that sorts them."""

    def run(batches):
        last = None  # the last row so far and whether it has met an equal one
        for batch in batches:
            if not len(batch):
                continue
            cell, ids, outer = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            if last is not None:
                cell, ids, outer = np.append(last[0], cell), np.append(last[1], ids), np.append(last[2], outer)
            same = cell[1:] == cell[:-1]
            keep = np.append(last is not None and last[3], same) | np.append(same, False)
            last = cell[-1:], ids[-1:], outer[-1:], bool(keep[-1])
            keep[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (cell, ids, outer)], ["cell", "id", "outer"])
        if last is not None and last[3]:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in last[:3]], ["cell", "id", "outer"])

    return prefix.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(run, f"cell long, id {kind}, outer boolean")


def _screened(pairs: DataFrame, reps: DataFrame, percent: int, kind: str) -> DataFrame:
    """Pairs ``a, b`` whose bitmaps allow the overlap needed."""
    one = reps.select(F.col("id").alias("a"), F.col("n").alias("n1"), F.col("sig").alias("s1"))
    two = reps.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("sig").alias("s2"))

    def run(batches):
        for batch in batches:
            n1, n2 = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            keep = np.zeros(len(batch), bool)
            for i, (p, q) in enumerate(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist())):
                width = min(len(p), len(q)) // 8
                x, y = (fold(np.frombuffer(s, np.uint64).reshape(1, -1), width) for s in (p, q))
                spare = min(n1[i] - np.bitwise_count(x).sum(dtype=np.int64), n2[i] - np.bitwise_count(y).sum(dtype=np.int64))
                keep[i] = np.bitwise_count(x & y).sum(dtype=np.int64) + spare >= overlap_needed(n1[i], n2[i], percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "n1", "s1", "n2", "s2").mapInArrow(run, f"a {kind}, b {kind}")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, size: int = 5) -> DataFrame:
    """``key, n_shingles, component_id`` of every row; see the module."""
    rows, found = links(docs, key, text, percent, size)
    comp = components(found).select(F.col("id").alias("rep"), "comp")
    whole = rows.join(comp, "rep", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("comp", "rep", "id").alias("component_id"))
    return whole


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, size: int = 5) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, each id once; rows without an id stay."""
    found = cut(jaccard_components(docs, key, text, percent, size).filter(F.col(key) == F.col("component_id")).groupBy(key).agg(F.count(key).alias("_rows")))
    ids = found.select(key)
    kept = docs.join(F.broadcast(ids) if found.count() <= BROADCAST else ids, key, "left_semi").select(*docs.columns)
    if found.filter("_rows > 1").limit(1).count():
        kept = kept.dropDuplicates([key])
    return kept.unionByName(docs.filter(F.col(key).isNull()))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set size and its component of linked documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
