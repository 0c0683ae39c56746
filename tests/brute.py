"""Plain Python versions of the operators for small dense matrices."""

import hashlib

import numpy as np


def order(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{i}:{seed}".encode()).hexdigest(), i))


def leaders(ids, d, t1, seed=42):
    """``d[i][j]`` by id; returns id -> leader."""
    taken = {}
    for i in order(ids, seed):
        if i in taken:
            continue
        taken[i] = i
        for j in ids:
            if j not in taken and d[i, j] <= t1:
                taken[j] = i
    return taken


def silhouette(ids, d, label):
    total = []
    for i in ids:
        same = [d[i, j] for j in ids if j != i and label[j] == label[i]]
        a = np.mean(same) if same else 0.0
        b = min(np.median([d[i, j] for j in ids if label[j] == other]) for other in set(label.values()) if other != label[i])
        total.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(total))


def medoid(members, d):
    members = sorted(members)
    means = [np.mean([0.0 if i == j else d[i, j] for j in members]) for i in members]
    return next(i for i, m in zip(members, means) if np.isclose(m, min(means)))


def overlap(ids, d, a, c):
    """Overall and filtered overlap of labelings ``a`` (base) and ``c``."""
    groups_a, groups_c = {}, {}
    for i in sorted(ids):
        groups_a.setdefault(a[i], set()).add(i)
        groups_c.setdefault(c[i], set()).add(i)
    mid_a = {k: medoid(v, d) for k, v in groups_a.items()}
    mapped = {}
    for k, v in groups_c.items():
        m = medoid(v, d)
        best = min(groups_a, key=lambda x: 0.0 if mid_a[x] == m else d[m, mid_a[x]])
        mapped.setdefault(best, []).append(k)
    means, flat = [], []
    for k in groups_a:
        scores = []
        for j in mapped.get(k, []):
            shared = len(groups_a[k] & groups_c[j])
            scores.append(shared / len(groups_c[j]))
            if not (shared == 1 and len(groups_a[k]) == 1 and len(groups_c[j]) == 1):
                flat.append(scores[-1])
        if scores:
            means.append(np.mean(scores))
    return float(np.mean(means)) if means else 0.0, float(np.mean(flat)) if flat else 0.0
