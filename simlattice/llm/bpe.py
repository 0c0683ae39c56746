"""Operator 10: byte-level BPE through an index of pair occurrences.

The words (pre-tokens) of a window of documents are taken once each. All
their symbols lie in one array with links to the neighbours, and every
mergeable pair is mapped to all its positions. The active ranks are applied
in ascending order: one step merges all positions of a pair in every word of
the window and enters the pairs that it makes into the index. A merge can
only make pairs that were learned later, and the queue of ranks would take an
earlier one first, so each word gets the merges that it gets alone.

The vocabulary file is read on the driver and sent to the tasks; its size is
that of the vocabulary, whatever the input. A task holds ``WINDOW`` bytes of
text (or one longer document) at a time.

Defined cases: a null or empty text has no ids and decodes to the empty text;
repeated rows give repeated results; other columns are ignored or kept as
named; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from simlattice.llm.words import buffers, chunks, span_hashes

WINDOW = 4_000_000
_SPECIAL = np.uint64(1)

# The white space of Unicode, and the endings that a word-initial apostrophe takes along.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def character_classes() -> np.ndarray:
    """Of every code point: 0 white space, 1 letter, 2 number, 3 other."""
    kinds = np.full(0x110000, 3, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            kinds[c] = 1 if kind == "L" else 2
    kinds[WHITE_SPACE] = 0
    return kinds


def load_vocabulary(path: str) -> dict:
    """Arrays of a byte-level BPE file in the format of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    vocabulary = content["model"]["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in content["model"]["merges"]]
    left = np.array([vocabulary[a] for a, _ in merges], np.int64)
    right = np.array([vocabulary[b] for _, b in merges], np.int64)
    keys = (left << 32) | right
    order = np.argsort(keys, kind="stable")
    letters = byte_letters()
    value = {c: b for b, c in enumerate(letters)}
    added = {t["content"]: t["id"] for t in content["added_tokens"]}
    tokens = {i: bytes(value[c] for c in t) for t, i in vocabulary.items() if t not in added}
    tokens |= {i: t.encode() for t, i in added.items()}
    size = max(tokens) + 1
    spelled = [tokens.get(i, b"") for i in range(size)]
    byte_ids = np.array([vocabulary[c] for c in letters], np.int64)
    first = np.full((256, 256), -1, np.int32)
    of_byte = {int(v): b for b, v in enumerate(byte_ids)}
    for r in range(len(merges) - 1, -1, -1):
        a, b = of_byte.get(int(left[r])), of_byte.get(int(right[r]))
        if a is not None and b is not None:
            first[a, b] = r
    return {
        "left": left, "right": right, "made": np.array([vocabulary[a + b] for a, b in merges], np.int64),
        "keys": keys[order], "ranks": order.astype(np.int32), "byte_ids": byte_ids, "byte_pairs": first,
        "bytes": np.frombuffer(b"".join(spelled), np.uint8), "lengths": np.array([len(t) for t in spelled], np.int64),
        "added": added, "classes": character_classes(),
    }


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of the ranges ``start .. start + length``, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def pre_tokens(data: np.ndarray, offsets: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and hash of every pre-token, and the number of them in each row.

    The rules: letters, numbers and other characters form runs that take one
    preceding space along; white space is a run less the character before the
    next word; an apostrophe that starts a run takes its ending along. Added
    tokens stand alone and part the text before and after them.
    """
    text = data.tobytes().decode("utf-8")
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(code)
    width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width)])
    rows = np.searchsorted(at, offsets)
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    special = []
    if model["added"]:
        for found in re.finditer("|".join(re.escape(t) for t in sorted(model["added"], key=len, reverse=True)), text):
            a, b = found.span()
            if not edge[a + 1 : b].any():
                special.append((a, b))
    for a, b in special:
        edge[a] = edge[b] = True
    kind = model["classes"][code]
    change = edge[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(change)
    end = np.append(run[1:], n)
    is_space = kind[run] == 0
    start = np.zeros(n + 1, bool)
    start[run[is_space]] = True
    start[end[is_space & ~edge[end]] - 1] = True
    word = run[~is_space]
    follows_space = np.zeros(len(word), bool)
    follows_space[word > 0] = code[word[word > 0] - 1] == 32
    follows_space &= ~edge[word]
    start[word[~follows_space]] = True
    alone = run[(code[run] == 39) & (end - run == 1) & ~edge[end]]
    alone = alone[start[alone]]
    alone = alone[kind[alone + 1] == 1]
    for ending in ENDINGS:
        last = alone + len(ending)
        fits = last < n
        for j, c in enumerate(ending, 1):
            place = np.minimum(alone + j, n - 1)
            fits &= (code[place] == ord(c)) & ~edge[place]
        hit = alone[fits]
        start[hit + 1] = False
        after = hit + 1 + len(ending)
        after = after[after < n]
        start[after[(kind[after] == 1) & ~edge[after]]] = True
    for a, b in special:
        start[a + 1 : b] = False
        start[a] = True
    start[edge[: n + 1]] = True
    begins = np.flatnonzero(start[:n])
    places = at[begins]
    hashes = span_hashes(data, places, np.append(places[1:], len(data)))
    if special:
        hashes[np.searchsorted(begins, [a for a, _ in special])] = _SPECIAL + np.array([model["added"][text[a:b]] for a, b in special], np.uint64)
    return places, hashes, np.diff(np.searchsorted(begins, rows))


def rank_of(left: np.ndarray, right: np.ndarray, model: dict) -> np.ndarray:
    """Rank of each pair of symbols, -1 if it never merges."""
    key = (left << 32) | right
    place = np.minimum(np.searchsorted(model["keys"], key), len(model["keys"]) - 1)
    return np.where(model["keys"][place] == key, model["ranks"][place], -1)


def merge_words(letters: np.ndarray, lengths: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after the other, and the number of ids of each word."""
    n = len(letters)
    ends = np.cumsum(lengths)
    symbol = model["byte_ids"][letters]
    following, previous = np.arange(1, n + 1), np.arange(-1, n - 1)
    following[ends - 1] = -1
    previous[ends - lengths] = -1
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def enter(places: np.ndarray, ranks: np.ndarray) -> None:
        keep = ranks >= 0
        places, ranks = places[keep], ranks[keep]
        if not len(places):
            return
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for r, part in zip(ranks[np.append(0, cuts)].tolist(), np.split(places, cuts) if len(cuts) else [places]):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(queue, r)

    pairs = np.flatnonzero(following >= 0)
    enter(pairs, model["byte_pairs"][letters[pairs], letters[pairs + 1]] if n else pairs)
    while queue:
        r = heapq.heappop(queue)
        parts = index.pop(r)
        p = parts[0] if len(parts) == 1 else np.concatenate(parts)
        if len(p) > 1:
            p = np.unique(p)
        left, right = model["left"][r], model["right"][r]
        p = p[(symbol[p] == left) & (following[p] >= 0)]
        q = following[p]
        fits = symbol[q] == right
        p, q = p[fits], q[fits]
        if left == right and len(p) > 1:  # of a run of overlapping pairs, the first, third, ...
            new_run = np.append(True, p[1:] != q[:-1])
            first = np.maximum.accumulate(np.where(new_run, np.arange(len(p)), 0))
            odd = (np.arange(len(p)) - first) % 2 == 0
            p, q = p[odd], q[odd]
        if not len(p):
            continue
        symbol[p] = model["made"][r]
        symbol[q] = -1
        after = following[q]
        following[p] = after
        linked = after >= 0
        previous[after[linked]] = p[linked]
        before = previous[p]
        around = np.concatenate([before[before >= 0], p[linked]])
        if len(around):
            enter(around, rank_of(symbol[around], symbol[following[around]], model))
    alive = symbol >= 0
    counts = np.diff(np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], ends])])
    return symbol[alive], counts


def encode_column(column: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, one after the other, and the number of ids of each row."""
    data, offsets = buffers(column)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(column), np.int64)
    places, hashes, per_row = [], [], []
    for first, last in chunks(offsets):
        base = offsets[first]
        if offsets[last] == base:
            per_row.append(np.zeros(last - first, np.int64))
            continue
        p, h, c = pre_tokens(data[base : offsets[last]], offsets[first : last + 1] - base, model)
        places.append(p + base)
        hashes.append(h)
        per_row.append(c)
    place = np.concatenate(places)
    length = np.diff(np.append(place, len(data)))
    words, seen, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    ids, counts = merge_words(data[ranges(place[seen], length[seen])], length[seen], model)
    starts = np.cumsum(counts) - counts
    for token in model["added"].values():
        if (i := np.searchsorted(words, _SPECIAL + np.uint64(token))) < len(words) and words[i] == _SPECIAL + np.uint64(token):
            ids[starts[i]] = token
            counts[i] = 1
    per_word = counts[which]
    flat = ids[ranges(starts[which], per_word)]
    word_ends = np.concatenate([[0], np.cumsum(per_word)])
    row_ends = np.concatenate([[0], np.cumsum(np.concatenate(per_row))])
    return flat, np.diff(word_ends[row_ends])


def decode_ids(ids: np.ndarray, counts: np.ndarray, model: dict) -> list[bytes]:
    """UTF-8 of the text of every row; bytes that are no UTF-8 become U+FFFD."""
    lengths = model["lengths"][ids]
    starts = (np.cumsum(model["lengths"]) - model["lengths"])[ids]
    data = model["bytes"][ranges(starts, lengths)].tobytes()
    ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
    found = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        part = data[a:b]
        try:
            part.decode()
        except UnicodeDecodeError:
            part = part.decode("utf-8", "replace").encode()
        found.append(part)
    return found


def windows(batches, text: str):
    """Batches joined or cut to windows of at most ``WINDOW`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        lengths = np.diff(buffers(batch.column(text))[1])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        for first, last in chunks(ends, WINDOW):
            part = int(ends[last] - ends[first])
            if held and size + part > WINDOW:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(batch.slice(first, last - first))
            size += part
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def encode(docs: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with the ids of the whole ``text`` as ``array<int>`` in ``name`` (an earlier column of that name goes)."""
    docs = docs.drop(name)
    model = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches):
        for batch in windows(batches, text):
            ids, counts = encode_column(batch.column(text), model.value)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, name])

    return docs.mapInArrow(run, _with(docs, f"`{name}` array<int>"))


def decode(rows: DataFrame, path: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """``rows`` with the text of ``ids`` in ``name``; null ids give the empty text."""
    rows = rows.drop(name)
    model = rows.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches):
        for batch in batches:
            lists = batch.column(ids)
            counts = np.array([0 if x is None else x for x in pc.list_value_length(lists).to_pylist()], np.int64)
            flat = np.asarray(lists.flatten(), dtype=np.int64)
            texts = [t.decode() for t in decode_ids(flat, counts, model.value)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return rows.mapInArrow(run, _with(rows, f"`{name}` string"))


def _with(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), more])


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Count and SHA-256 of the ids of every text, and SHA-256 of what they decode to; ``with_ids``: the ids too."""
    model = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches):
        for batch in windows(batches, text):
            ids, counts = encode_column(batch.column(text), model.value)
            packed = ids.astype("<u4").tobytes()
            ends = np.concatenate([[0], np.cumsum(counts)]).tolist()
            of_ids = [hashlib.sha256(packed[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1], ends[1:])]
            of_text = [hashlib.sha256(t).hexdigest() for t in decode_ids(ids, counts, model.value)]
            columns = [batch.column(key), pa.array(counts), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(key, text).mapInArrow(run, schema)


def op10_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every document encoded and decoded with the 50k byte-level vocabulary."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary or default_vocabulary())


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
