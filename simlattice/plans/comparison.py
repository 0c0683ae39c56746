"""The comparison job: sources to overlap rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame

from simlattice.operators.align import Aligned, align
from simlattice.operators.combine import Combined, combine_distances, source_combinations, threshold_range
from simlattice.operators.leader import leader_clusters
from simlattice.operators.matrix import Matrices
from simlattice.operators.normalize import normalize, to_distance
from simlattice.operators.overlap import nested_pairs, overlap_detail, overlap_rows, overlap_scores
from simlattice.operators.silhouette import best_clusters, silhouette, sweep
from simlattice.runtime import cut


class Clustered(NamedTuple):
    combined: Combined
    ranges: dict[str, list[float]]
    clusters: DataFrame
    sweep: DataFrame
    best: DataFrame
    labels: DataFrame


def source_distances(
    data: Matrices, sources: Sequence[str], size: int | None = None, seed: int = 42, normalized: bool = True
) -> Aligned:
    """Aligned, normalized distances of all sources."""
    aligned = align(data, sources, size, seed)
    return to_distance(normalize(aligned)[0] if normalized else aligned)


def cluster_combinations(
    distances: Aligned, low: int = 1, high: int = 3, steps: int = 20, seed: int = 42, singleton: str = "one"
) -> Clustered:
    """Combine, sweep all thresholds and keep the best clustering per combination."""
    combined = combine_distances(distances, source_combinations(distances.sources, low, high))
    ranges = threshold_range(combined, steps)
    clusters = cut(leader_clusters(combined, ranges, seed))
    scored = cut(sweep(silhouette(combined, clusters, singleton), ranges))
    best, labels = best_clusters(scored, clusters, list(combined.combos))
    return Clustered(combined, ranges, clusters, scored, best, cut(labels))


def compare_sources(
    data: Matrices, sources: Sequence[str], low: int = 1, high: int = 3, steps: int = 20, size: int | None = None,
    seed: int = 42, normalized: bool = True,
) -> DataFrame:
    """One overlap row for every ordered pair of nested combinations."""
    done = cluster_combinations(source_distances(data, sources, size, seed, normalized), low, high, steps, seed)
    pairs = nested_pairs(done.combined.combos)
    return overlap_rows(overlap_scores(overlap_detail(done.combined, done.labels, pairs)), done.best)
