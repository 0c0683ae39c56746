"""Numbers about whole texts as NumPy arrays, inside Arrow batches."""

from __future__ import annotations

import numpy as np

from simlattice.llm.words import lower_ascii, mix, shingle_hashes, span_hashes, word_spans


def rates(data: np.ndarray, offsets: np.ndarray, sets: list) -> np.ndarray:
    """How many bytes of each set of byte values every row has: an array of rows by sets."""
    out = np.zeros((len(offsets) - 1, len(sets)))
    for j, values in enumerate(sets):
        table = np.zeros(256, bool)
        table[list(values)] = True
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        out[:, j] = sums[offsets[1:]] - sums[offsets[:-1]]
    return out


def distinct_per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values of every row."""
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return np.bincount(r[new], minlength=n)


CAPITALS, DIGITS, SYMBOLS, BANGS, STOPS = range(65, 91), range(48, 58), b"#*$%&|<>", b"!", b".,;:?"

TEXT_FEATURES = ["log_words", "word_length", "symbols", "capitals", "digits", "bangs", "stops", "pipes", "distinct_words", "repeat_shingles", "equal_neighbours", "dup_lines", "line_words"]


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``TEXT_FEATURES`` of every row; an empty text has zeros."""
    n = len(offsets) - 1
    starts, ends, rows = word_spans(data, offsets)
    counts = np.bincount(rows, minlength=n).astype(float)
    per = np.maximum(counts, 1)
    letters = np.maximum(np.bincount(rows, ends - starts, n), 1)
    words = span_hashes(lower_ascii(data), starts, ends)
    found = rates(data, offsets, [SYMBOLS, CAPITALS, DIGITS, BANGS, STOPS, b"|", b"\n"])
    shingles, of = shingle_hashes(words, rows, n)
    n_shingles = np.bincount(of, minlength=n)
    same = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1]) if len(words) else np.zeros(0, bool)
    edges = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    line_start, line_end = edges[:-1], edges[1:]
    line_row = np.searchsorted(offsets[1:], line_start, "right")
    lines = span_hashes(np.where(data == 10, np.uint8(32), data), line_start, line_end) if len(line_start) else np.zeros(0, np.uint64)
    n_lines = np.bincount(line_row, minlength=n)
    return np.stack([
        np.log1p(counts), letters / per * (counts > 0), found[:, 0] / letters, found[:, 1] / letters, found[:, 2] / letters, found[:, 3] / per, found[:, 4] / per, found[:, 5] / per,
        distinct_per_row(words, rows, n) / per, 1 - distinct_per_row(shingles, of, n) / np.maximum(n_shingles, 1) * (n_shingles > 0) - (n_shingles == 0),
        np.bincount(rows[1:][same], minlength=n) / per, (n_lines - distinct_per_row(lines, line_row, n)) / np.maximum(n_lines, 1), np.log1p(counts / np.maximum(n_lines, 1)),
    ], axis=1)


def hashed(texts: list, size: int) -> np.ndarray:
    """Bucket of every string by its bytes; null has the last bucket."""
    raw = [b"" if t is None else str(t).encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64) if raw else np.zeros(0, np.int64)
    starts = ends - [len(r) for r in raw] if raw else ends
    bucket = (mix(span_hashes(data, starts, ends)) % np.uint64(size - 1)).astype(np.int64)
    bucket[[i for i, t in enumerate(texts) if t is None]] = size - 1
    return bucket


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the constant) of a ridge logistic regression by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (y - p)) - penalty * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w = w + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
