"""Operator 7: texts scored by a weighted backoff automaton.

Training counts the n-grams of every training text. A history that was seen
is a state; a seen word leaves it by an arc with its smoothed probability, any
other word by the failure arc, whose weight leads to the state of the history
without its first word, down to the root that knows words alone:

    arc      log10((c(hw) + mu * p(w | shorter h)) / (c(h) + mu))
    failure  log10(mu / (c(h) + mu)), then on from the shorter history
    root     log10((c(w) - d) / N), an unknown word log10(d * V / N),
             d = ones / (ones + 2 * twos) held between 0.1 and 0.9

The probabilities after every history sum to 1. One pass from left to right
carries the state and adds the weights. The texts of a block are read side by
side, one word of each at a time. A text of over ``SEGMENT`` words is cut into
pieces; a piece first reads the ``order - 1`` words before it, unweighted,
which leads from the root to the state that the piece before it ends in.

The counts grow with the corpus, so no task holds the automaton. Documents
are dealt into blocks of bounded size by a hash of their id and length, and
rows that repeat one id and length too often by chance. A block asks for
its distinct n-grams, grouped in buckets by their hash; a bucket adds up the
counts of all blocks and sends back those asked for; then the block builds
the states, arcs and failure weights that its texts can meet, and walks them. Each n-gram crosses the network once per block that
has it, so frequent words cost no more than rare ones.

Words and n-grams are known by 64 bits: two different ones among 10**9 are
counted together with a probability of about 3 %.

Defined cases: a null text is empty and has the end as its only token; null
ids are training rows; repeated rows count and score each; without training
rows every score is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simlattice.llm.words import buffers, chunks, lower_ascii, mix, span_hashes, word_spans
from simlattice.runtime import cut

BLOCK_BYTES = 8_000_000
SEGMENT = 1024
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_FACTORS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x9FB21C651E98DF25, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def sequences(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``start, words, end`` of all texts, one after the other, and the place of every token in its text."""
    parts, places = [], []
    for column in columns:
        data, offsets = buffers(column)
        for first, last in chunks(offsets):
            base, n = offsets[first], last - first
            part = lower_ascii(data[base : offsets[last]])
            starts, ends, rows = word_spans(part, offsets[first : last + 1] - base)
            counts = np.bincount(rows, minlength=n) + 2
            stop = np.cumsum(counts)
            out = np.full(stop[-1], END, np.uint64)
            out[stop - counts] = START
            place = np.arange(stop[-1]) - np.repeat(stop - counts, counts)
            inner = np.ones(len(out), bool)
            inner[stop - 1] = inner[stop - counts] = False
            out[inner] = span_hashes(part, starts, ends)
            parts.append(out)
            places.append(place)
    return np.concatenate(parts), np.concatenate(places)


def grams(tokens: np.ndarray, place: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of every ``order``-gram and the position of its last token."""
    if order == 1:
        return tokens, np.arange(len(tokens))
    at = np.flatnonzero(place >= order - 1)
    key = np.zeros(len(at), np.uint64)
    for j in range(order):
        key += tokens[at - j] * _FACTORS[j % 5] + np.uint64(j)
    return mix(key), at


def distinct(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order of bucket, the bounds of the buckets, and the index of every key among them."""
    found, which = np.unique(keys, return_inverse=True)
    bucket = ((found >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return found[order], np.searchsorted(bucket[order], np.arange(buckets + 1)), back[which]


def pack(values: np.ndarray) -> bytes:
    """Counts in the narrowest of 1, 2, 4 or 8 bytes, which comes first."""
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _ask(order: int, buckets: int):
    """Per block: its distinct n-grams of each order and bucket, with their counts in training texts."""

    def solve(block, batches):
        tokens, place = sequences([b.column("text") for b in batches])
        held = np.concatenate([b.column("held_out").to_numpy(zero_copy_only=False) for b in batches])
        train = ~held[np.cumsum(place == 0) - 1]
        for k in range(1, order + 1):
            keys, at = grams(tokens, place, k)
            found, bounds, which = distinct(keys, buckets)
            counts = np.bincount(which[train[at]], minlength=len(found))
            full = np.flatnonzero(np.diff(bounds))
            spans = [(bounds[i], bounds[i + 1]) for i in full]
            yield pa.RecordBatch.from_arrays([
                pa.array(full.astype(np.int32)), pa.array(np.full(len(full), block, np.int32)), pa.array(np.full(len(full), k, np.int32)),
                pa.array([found[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([pack(counts[a:b]) for a, b in spans], pa.binary()),
            ], ["bucket", "block", "gram", "keys", "counts"])

    return _by_key("block", solve)


def _answer():
    """Per bucket and order: the counts of all blocks added up, sent back to each; and what smoothing needs of words."""

    def run(batches):
        held, key = [], None

        def solve():
            gram = key[1]
            parts = [np.frombuffer(k, np.uint64) for _, k, _ in held]
            found, which = np.unique(np.concatenate(parts), return_inverse=True)
            total = np.bincount(which, np.concatenate([unpack(c) for _, _, c in held]), len(found)).astype(np.int64)
            ends = np.cumsum([len(p) for p in parts])
            sent = [pack(total[which[e - len(p) : e]]) for e, p in zip(ends, parts)]
            words = total[found != START] if gram == 1 else total[:0]
            n = len(held)
            stats = [int(words.sum()), int((words > 0).sum()), int((words == 1).sum()), int((words == 2).sum())]
            table = pa.RecordBatch.from_arrays([
                pa.array([b for b, _, _ in held], pa.int32()), pa.array([gram] * n, pa.int32()), pa.array([key[0]] * n, pa.int32()), pa.array(sent, pa.binary()),
                *(pa.array([s] + [0] * (n - 1), pa.int64()) for s in stats),
            ], ["block", "gram", "bucket", "counts", "tokens", "types", "ones", "twos"])
            held.clear()
            return table

        for batch in batches:
            for bucket, block, gram, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (bucket, gram) and held:
                    yield solve()
                key = bucket, gram
                held.append((block, keys, counts))
        if held:
            yield solve()

    return run


class Automaton:
    """Root and states by number, arcs in order of state and word.

    ``at[k - 1]``: the index of the ``k``-gram that ends at every token, -1 if there is none; ``seen[k - 1]``: training counts by index.
    """

    def __init__(self, at: list[np.ndarray], seen: list[np.ndarray], mu: float, d: float, n: int, v: int):
        order = len(seen)
        self.words = len(seen[0])
        self.fail, self.back = [np.zeros(1, np.int64)], [np.array([np.log10(d * v / n) if n else 0.0])]
        keys, weights, targets, states = [], [], [], 1
        shorter_p, shorter_state = None, None
        for k in range(1, order + 1):
            count = seen[k - 1]
            last = np.zeros(len(count), np.int64)  # a token where each n-gram ends
            ends = np.flatnonzero(at[k - 1] >= 0)
            last[at[k - 1][ends]] = ends
            own = np.flatnonzero(count > 0)
            last = last[own]
            p = np.zeros(len(count))
            if k == 1:
                p[own] = (count[own] - d) / max(n, 1)
                source = suffix_state = np.zeros(len(own), np.int64)
            else:
                suffix, history = at[k - 2][last], at[k - 2][last - 1]
                p[own] = (count[own] + mu * shorter_p[suffix]) / (seen[k - 2][history] + mu)
                source, suffix_state = shorter_state[history], shorter_state[suffix]
            state = np.zeros(len(count), np.int64)
            if k < order:
                state[own] = states + np.arange(len(own))
                states += len(own)
                self.fail.append(suffix_state)
                self.back.append(np.log10(mu / (count[own] + mu)))
            keys.append(source * self.words + at[0][last])
            weights.append(np.log10(p[own]))
            targets.append(state[own] if k < order else suffix_state)
            shorter_p, shorter_state = p, state
        self.fail, self.back = np.concatenate(self.fail), np.concatenate(self.back)
        keys = np.concatenate(keys)
        sort = np.argsort(keys, kind="stable")
        self.keys, self.weights, self.targets = keys[sort], np.concatenate(weights)[sort], np.concatenate(targets)[sort]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after one word of each text, and the weights on the way."""
        state, weight, todo = state.copy(), np.zeros(len(state)), np.arange(len(state))
        while len(todo):
            want = state[todo] * self.words + word[todo]
            arc = np.searchsorted(self.keys, want)
            hit = np.zeros(len(todo), bool)
            inside = arc < len(self.keys)
            hit[inside] = self.keys[arc[inside]] == want[inside]
            weight[todo[hit]] += self.weights[arc[hit]]
            state[todo[hit]] = self.targets[arc[hit]]
            failed = todo[~hit]
            weight[failed] += self.back[state[failed]]
            todo = failed[state[failed] > 0]  # the root itself takes an unknown word
            state[failed] = self.fail[state[failed]]
        return state, weight

    def walk(self, word: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
        """Weight of every text, the start unweighted."""
        starts = np.flatnonzero(place == 0)
        stops = np.append(starts[1:], len(place))
        pieces = -(-(stops - starts) // SEGMENT)
        row = np.repeat(np.arange(len(starts)), pieces)
        first = starts[row] + SEGMENT * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        begin, counted, stop = np.maximum(starts[row], first - order + 1), np.maximum(first, starts[row] + 1), np.minimum(first + SEGMENT, stops[row])
        longest = np.argsort(begin - stop, kind="stable")
        row, begin, counted, stop = row[longest], begin[longest], counted[longest], stop[longest]
        state, score = np.zeros(len(row), np.int64), np.zeros(len(row))
        for t in range(int((stop - begin).max(initial=0))):
            live = np.searchsorted(begin - stop, -t)
            now = begin[:live] + t
            state[:live], weight = self.step(state[:live], word[now])
            score[:live] += np.where(now >= counted[:live], weight, 0.0)
        return np.bincount(row, score, len(starts))


def _walk(order: int, buckets: int, total: dict, mu: float):
    """Per block: the answers, then the texts, scored from left to right."""
    n, v = total["tokens"] or 0, total["types"] or 0
    ones, twos = total["ones"] or 0, total["twos"] or 0
    d = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5

    def solve(block, batches):
        table = pa.Table.from_batches(batches)
        rows = table.filter(pc.equal(table.column("kind"), 0))
        answers = {(g, b): c for g, b, c in zip(*(rows.column(c).to_pylist() for c in ("gram", "bucket", "counts")))}
        docs = table.filter(pc.equal(table.column("kind"), 1)).combine_chunks()
        if not docs.num_rows:
            return
        tokens, place = sequences(docs.column("text").chunks)
        ends, seen = [], []
        for k in range(1, order + 1):
            keys, at = grams(tokens, place, k)
            found, bounds, which = distinct(keys, buckets)
            seen.append(np.zeros(len(found), np.int64))
            for i in np.flatnonzero(np.diff(bounds)):
                seen[-1][bounds[i] : bounds[i + 1]] = unpack(answers[k, int(i)])
            ends.append(np.full(len(tokens), -1, np.int32))
            ends[-1][at] = which
        score = Automaton(ends, seen, mu, d, n, v).walk(ends[0], place, order)
        events = np.flatnonzero(place > 0)
        known = seen[0][ends[0][events]]
        row = (np.cumsum(place == 0) - 1)[events]
        m = docs.num_rows
        base = np.log10((known + 1) / (n + v + 1))
        size = np.bincount(row, minlength=m)
        yield pa.RecordBatch.from_arrays([
            docs.column("id").combine_chunks(), docs.column("held_out").combine_chunks(), pa.array(size), pa.array(np.bincount(row[known > 0], minlength=m)),
            pa.array(np.full(m, n, np.int64)), pa.array(np.bincount(row, base, m)), pa.array(score),
        ], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return _by_key("block", solve)


def _by_key(name: str, solve):
    """Task function that hands all batches of one key, sorted next to each other, to ``solve``."""

    def run(batches):
        held, key = [], None
        for batch in batches:
            keys = batch.column(name).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else [0]
            for first, last in zip(cuts[:-1], cuts[1:]):
                if held and key != keys[first]:
                    yield from solve(key, held)
                    held = []
                key = int(keys[first])
                held.append(batch.slice(first, last - first))
        if held:
            yield from solve(key, held)

    return run


def blocked(rows: DataFrame, blocks: int, block_bytes: int) -> DataFrame:
    """``rows`` with their ``block``, the same whenever it is read.

    Rows of one id and length share a hash. Where they hold over a quarter of a
    block, they are written once with a random block each.
    """
    rows = rows.withColumn("h", F.xxhash64(F.col("id").cast("string"), F.length("text")))
    sizes = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    hot = cut(sizes.filter((F.col("n") > 1) & (F.col("bytes") > block_bytes // 4)).select("h"))  # four a block at most
    by_hash = F.pmod(F.xxhash64("h"), F.lit(blocks)).cast("int")
    if hot.isEmpty():
        return rows.withColumn("block", by_hash).drop("h")
    spread = cut(rows.join(F.broadcast(hot), "h", "left_semi").withColumn("block", F.floor(F.rand() * blocks).cast("int")).drop("h"))
    return rows.join(F.broadcast(hot), "h", "left_anti").withColumn("block", by_hash).drop("h").unionByName(spread)


def lm_scores(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", order: int = 2, mu: float = 100.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row; rows not ``held_out`` train."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = size // block_bytes + 1
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = blocked(rows, blocks, block_bytes)
    asked = rows.select("block", "held_out", "text").repartition("block").sortWithinPartitions("block")
    asked = asked.mapInArrow(_ask(order, blocks), "bucket int, block int, gram int, keys binary, counts binary")
    asked = asked.repartition("bucket", "gram").sortWithinPartitions("bucket", "gram")
    answers = cut(asked.mapInArrow(_answer(), "block int, gram int, bucket int, counts binary, tokens long, types long, ones long, twos long"))
    total = answers.agg(*(F.sum(c).alias(c) for c in ("tokens", "types", "ones", "twos"))).first().asDict()
    none = F.lit(None)
    replies = answers.select("block", F.lit(0).alias("kind"), "gram", "bucket", "counts", none.cast(kind).alias("id"), F.lit(False).alias("held_out"), none.cast("string").alias("text"))
    texts = rows.select("block", F.lit(1).alias("kind"), none.cast("int").alias("gram"), none.cast("int").alias("bucket"), none.cast("binary").alias("counts"), "id", "held_out", "text")
    walked = replies.unionByName(texts).repartition("block").sortWithinPartitions("block").mapInArrow(
        _walk(order, blocks, total, mu), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return walked.withColumnRenamed("id", key)


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored; those with crc32(doc_id) mod 7 = 2 are not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lm_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
