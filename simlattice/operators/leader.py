"""Threshold clustering of every combination and threshold at once.

Entities are visited in a seeded order. A visited entity without a cluster
leads a new one and takes every entity without a cluster within ``t1``. The
leaders are the greedy maximal independent set of the graph ``d <= t1``, which
is found in few rounds: an entity leads as soon as no undecided earlier entity
is near it (Blelloch, Fineman and Shun, SPAA 2012).

The thresholds of a combination are one bit mask per entity and an entity is
one row with the masks of all combinations, so a round reads each stored pair
once, not once per threshold and combination.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simlattice.operators.combine import Combined
from simlattice.runtime import choose, cut, hot_or_none, lookup, numbered

# Members of one cluster above which its rows are not shuffled to meet its label.
HOT_ROWS = 1_000_000
# Thresholds in one mask, which is a long.
MASK_STEPS = 62
# Stored pairs and entities of a combination up to which one task visits them in turn; beyond it rounds of joins do.
LOCAL_ROWS = 2_000_000


def visit_key(id: Column, seed: int = 42) -> Column:
    """Seeded visiting order: MD5 of id and seed, the id breaks ties."""
    return F.md5(F.concat(id.cast("string"), F.lit(f":{seed}")).cast("binary"))


def _with_steps(pairs: DataFrame, ranges: list[tuple[int, list[float]]]) -> DataFrame:
    """``(early, late, steps)`` of ``(early, late, d0, d1, ...)``.

    ``steps[k]`` is the first step of the ``k``-th range whose threshold reaches
    the length in its column, -1 where there is no length.
    """
    kinds = pairs.schema
    schema = f"early {kinds['early'].dataType.simpleString()}, late {kinds['late'].dataType.simpleString()}, steps array<tinyint>"

    def steps(batches):
        for batch in batches:
            found = np.full((batch.num_rows, len(ranges)), -1, np.int8)
            for k, (at, thresholds) in enumerate(ranges):
                d = batch.column(f"d{at}")
                here = np.flatnonzero(d.is_valid().to_numpy(zero_copy_only=False))
                found[here, k] = np.searchsorted(thresholds, d.drop_null().to_numpy(zero_copy_only=False))
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(ranges))
            lists = pa.ListArray.from_arrays(ends, pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("early"), batch.column("late"), lists], ["early", "late", "steps"])

    return pairs.mapInArrow(steps, schema)


def _edges_of(pairs: DataFrame, at: dict[str, int]) -> DataFrame:
    """Stored pairs ``(combo, early, late, from_step)`` of the combinations ``at`` these places of ``steps``."""
    rows = pairs.unpivot(["early", "late"], [F.col("steps")[k].alias(c) for c, k in at.items()], "combo", "from_step")
    return rows.filter("from_step >= 0").withColumn("from_step", F.col("from_step").cast("int"))


def _steps_of(mask: Column, steps: int) -> Column:
    every = F.sequence(F.lit(0), F.lit(steps - 1))
    return F.filter(every, lambda s: F.call_function("shiftright", mask, s).bitwiseAND(F.lit(1)) == 1)


def leader_clusters(combined: Combined, ranges: dict[str, list[float]], seed: int = 42) -> DataFrame:
    """Clusters ``(combo, step, id, leader)`` of all combinations and thresholds, one mask of thresholds after another."""
    parts = []
    for first in range(0, max(len(t) for t in ranges.values()), MASK_STEPS):
        part = {c: t[first : first + MASK_STEPS] for c, t in ranges.items() if len(t) > first}
        parts.append(_masked_clusters(combined, part, seed).withColumn("step", F.col("step") + F.lit(first)))
    return reduce(DataFrame.unionByName, parts)


def _masked_clusters(combined: Combined, ranges: dict[str, list[float]], seed: int) -> DataFrame:
    steps = max(len(t) for t in ranges.values())
    full = (1 << steps) - 1
    # Steps from which the pairs that are not stored are near as well.
    wide_from = {}
    for c, ts in ranges.items():
        near = [i for i, t in enumerate(ts) if combined.background[c] <= t] if combined.absent(c) else []
        wide_from[c] = near[0] if near else steps
    narrow_mask = {c: (1 << s) - 1 for c, s in wide_from.items()}

    ahead = F.struct(visit_key(F.col("id1"), seed).alias("key"), F.col("id1").alias("id")) < F.struct(
        visit_key(F.col("id2"), seed).alias("key"), F.col("id2").alias("id")
    )
    place = {c: k for k, c in enumerate(combined.combos)}
    ordered = combined.wide.select(
        F.when(ahead, F.col("id1")).otherwise(F.col("id2")).alias("early"), F.when(ahead, F.col("id2")).otherwise(F.col("id1")).alias("late"),
        *[F.col(f"d{place[c]}") for c in ranges],
    )
    pairs = cut(_with_steps(ordered, [(place[c], ts) for c, ts in ranges.items()]))
    at = {c: k for k, c in enumerate(ranges)}
    combo_rows = combined.ids.select("id", F.explode(F.array(*[F.lit(c) for c in ranges])).alias("combo"))
    small = [c for c in ranges if max(combined.n, combined.stored[c]) <= LOCAL_ROWS]
    parts = []
    if small:
        parts.append(_local_clusters(combo_rows.filter(F.col("combo").isin(small)), _edges_of(pairs, {c: at[c] for c in small}), {c: len(ranges[c]) for c in small}, wide_from, seed))
    large = {c: k for c, k in at.items() if c not in small}
    if large:
        combo_rows = combo_rows.filter(F.col("combo").isin(*large))
        masks = [choose(narrow_mask, F.lit(c), "long").alias(f"open{k}") for c, k in large.items()]
        nodes = cut(combined.ids.select("id", *masks, *[F.lit(0).cast("long").alias(f"leads{k}") for k in large.values()]))
        hubs = combined.hubs and cut(combined.hubs.select(F.col("id").alias("early")).distinct())
        nodes = _elect(nodes, pairs, hubs, list(large.values()), full)
        parts.append(_members(nodes, pairs, hubs, large, steps, full, seed))
        wide = {c: s for c, s in wide_from.items() if s < steps and c in large}
        if wide:
            parts.append(_wide_clusters(combo_rows, pairs, {c: at[c] for c in wide}, wide, steps, seed))
    return reduce(DataFrame.unionByName, parts)


def _local_clusters(combo_rows: DataFrame, edges: DataFrame, steps: dict[str, int], wide_from: dict[str, int], seed: int) -> DataFrame:
    """Clusters of combinations that are known to fit a task, one task each: the visits one after the other."""
    kind = combo_rows.schema["id"].dataType.simpleString()
    nodes = combo_rows.select("combo", F.col("id").alias("early"), F.lit(None).cast(kind).alias("late"), F.lit(None).cast("int").alias("from_step"), visit_key(F.col("id"), seed).alias("key"))
    links = edges.select("combo", "early", "late", F.col("from_step").cast("int").alias("from_step"), F.lit(None).cast(nodes.schema["key"].dataType).alias("key"))

    def visit(group: pa.Table) -> pa.Table:
        combo = group.column("combo")[0].as_py()
        is_node = pc.is_null(group.column("late"))
        order = group.filter(is_node).sort_by([("key", "ascending"), ("early", "ascending")])
        ids = order.column("early").combine_chunks()
        pairs = group.filter(pc.invert(is_node))
        a, b = (np.asarray(pc.index_in(pairs.column(c).combine_chunks(), value_set=ids)) for c in ("early", "late"))
        first, n = pairs.column("from_step").to_numpy(), len(ids)
        out = [_visited(n, a, b, first, s, s >= wide_from[combo]) for s in range(steps[combo])]
        leader = np.concatenate(out) if out else np.zeros(0, np.int64)
        at = np.tile(np.arange(n), len(out))
        return pa.table({
            "combo": pa.array([combo] * len(at)), "step": pa.array(np.repeat(np.arange(len(out)), n), pa.int32()),
            "id": ids.take(pa.array(at)), "leader": ids.take(pa.array(leader)),
        })

    return nodes.unionByName(links).groupBy("combo").applyInArrow(visit, f"combo string, step int, id {kind}, leader {kind}")


def _visited(n: int, a: np.ndarray, b: np.ndarray, first: np.ndarray, step: int, wide: bool) -> np.ndarray:
    """Leader of each of ``n`` entities in visiting order; pairs ``a < b`` are near from step ``first`` on, others if ``wide``."""
    use = first > step if wide else first <= step  # the stored pairs that keep apart, or that bring together
    one, other = a[use], b[use]
    order = np.argsort(one, kind="stable")
    other = other[order]
    start = np.searchsorted(one[order], np.arange(n + 1))
    leader = np.full(n, -1)
    for i in range(n):
        if leader[i] >= 0:
            continue
        known = other[start[i] : start[i + 1]]
        if wide:
            taken = leader[i + 1 :] < 0
            taken[known - i - 1] = False
            leader[i + 1 :][taken] = i
        else:
            leader[known[leader[known] < 0]] = i
        leader[i] = i
    return leader


def _near(k: int, full: int, mask: str) -> Column:
    """Steps of ``mask`` at which a pair is near in the ``k``-th combination."""
    first = F.col("steps")[k].cast("int")
    bits = F.call_function("shiftleft", F.lit(full).cast("long"), first).bitwiseAND(F.lit(full).cast("long"))
    return F.when(first >= 0, bits.bitwiseAND(F.col(mask))).otherwise(F.lit(0).cast("long"))


def _any(names: list[str]) -> Column:
    return reduce(Column.__or__, [F.col(n) != 0 for n in names])


def _elect(nodes: DataFrame, pairs: DataFrame, hubs: DataFrame | None, at: list[int], full: int) -> DataFrame:
    """Rounds until every entity is decided; ``leads`` holds the steps it leads.

    A row of ``nodes`` holds the masks of an entity in all combinations ``at``
    their places, so a round moves a pair once for all of them.
    """
    opens, leads = [f"open{k}" for k in at], [f"leads{k}" for k in at]

    def reached(among: DataFrame, mask: str, name: str) -> DataFrame:
        ends = among.filter(_any([f"{mask}{k}" for k in at])).select(F.col("id").alias("early"), *[f"{mask}{k}" for k in at])
        names = [f"{name}{k}" for k in at]
        found = lookup(pairs, ends, ["early"], hubs).select(F.col("late").alias("id"), *[_near(k, full, f"{mask}{k}").alias(n) for k, n in zip(at, names)])
        return found.filter(_any(names)).groupBy("id").agg(*[F.bit_or(n).alias(n) for n in names])

    def less(a: Column, b: str) -> Column:
        return a.bitwiseAND(F.bitwise_not(F.coalesce(F.col(b), F.lit(0).cast("long"))))

    while nodes.filter(_any(opens)).limit(1).count():
        blocked = reached(nodes, "open", "blocked")
        chosen = cut(
            nodes.join(blocked, "id", "left").select("id", *opens, *leads, *[less(F.col(f"open{k}"), f"blocked{k}").alias(f"new{k}") for k in at])
        )
        covered = reached(chosen, "new", "covered")
        nodes = cut(
            chosen.join(covered, "id", "left").select(
                "id",
                *[less(less(F.col(f"open{k}"), f"new{k}"), f"covered{k}").alias(f"open{k}") for k in at],
                *[F.col(f"leads{k}").bitwiseOR(F.col(f"new{k}")).alias(f"leads{k}") for k in at],
            )
        )
    return nodes


def _members(nodes: DataFrame, pairs: DataFrame, hubs: DataFrame | None, at: dict[str, int], steps: int, full: int, seed: int) -> DataFrame:
    """Every entity with the earliest leader near it, leaders with themselves."""
    names = [f"leads{k}" for k in at.values()]
    leaders = nodes.filter(_any(names)).select("id", *names)
    by = F.struct(visit_key(F.col("early"), seed).alias("key"), F.col("early").alias("leader"))
    found = lookup(pairs, leaders.withColumnRenamed("id", "early"), ["early"], hubs).select(
        F.col("late").alias("id"), "early", *[_near(k, full, f"leads{k}").alias(f"bits{k}") for k in at.values()]
    )
    taken = (
        found.unpivot(["id", "early"], [F.col(f"bits{k}").alias(c) for c, k in at.items()], "combo", "bits").filter("bits != 0")
        .withColumn("by", by).select("combo", "id", "by", F.explode(_steps_of(F.col("bits"), steps)).alias("step"))
        .groupBy("combo", "step", "id")
        .agg(F.min("by")["leader"].alias("leader"))
    )
    own = leaders.unpivot("id", [F.col(f"leads{k}").alias(c) for c, k in at.items()], "combo", "bits").filter("bits != 0").select(
        "combo", F.explode(_steps_of(F.col("bits"), steps)).alias("step"), "id", F.col("id").alias("leader")
    )
    return own.unionByName(taken)


def _wide_clusters(combo_rows: DataFrame, pairs: DataFrame, at: dict[str, int], wide: dict[str, int], steps: int, seed: int) -> DataFrame:
    """Steps at which absent pairs are near: only stored far pairs keep entities apart.

    One leader per combination and step is the earliest open entity; what stays
    open is among its stored far pairs, so the rounds shrink quickly.
    """
    mask = {c: ((1 << steps) - 1) ^ ((1 << s) - 1) for c, s in wide.items()}
    rows = combo_rows.filter(F.col("combo").isin(*wide))
    state = cut(rows.select("combo", "id", choose(mask, F.col("combo"), "long").alias("open")))
    done = None
    while state.filter("open != 0").limit(1).count():
        first = F.struct(visit_key(F.col("id"), seed).alias("key"), F.col("id").alias("id"))
        heads = state.groupBy("combo").agg(
            *[F.min(F.when(F.col("open").bitwiseAND(F.lit(1 << s)) != 0, first)).alias(f"s{s}") for s in range(steps)]
        )
        heads = cut(
            heads.select("combo", F.posexplode(F.array(*[F.col(f"s{s}.id") for s in range(steps)])).alias("step", "leader"))
            .filter(F.col("leader").isNotNull())
        )
        leads = heads.groupBy("combo", F.col("leader").alias("early")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("step"))).alias("leads")
        )
        # Only the pairs of a leader are spread to their combinations.
        far = _edges_of(pairs.join(F.broadcast(leads.select("early").distinct()), "early", "left_semi"), at).withColumn(
            "bits", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("from_step")) - 1
        )
        apart = (
            far.join(F.broadcast(leads), ["combo", "early"])
            .select("combo", F.col("late").alias("id"), F.col("bits").bitwiseAND(F.col("leads")).alias("apart"))
            .groupBy("combo", "id")
            .agg(F.bit_or("apart").alias("apart"))
        )
        split = cut(
            state.join(apart, ["combo", "id"], "left").select(
                "combo", "id", "open", F.col("open").bitwiseAND(F.coalesce("apart", F.lit(0).cast("long"))).alias("left")
            )
        )
        gone = F.col("open").bitwiseAND(F.bitwise_not("left"))
        taken = (
            split.select("combo", "id", F.explode(_steps_of(gone, steps)).alias("step"))
            .join(F.broadcast(heads), ["combo", "step"])
            .select("combo", "step", "id", "leader")
        )
        done = taken if done is None else done.unionByName(taken)
        state = split.select("combo", "id", F.col("left").alias("open"))
    return done


def cluster_sizes(clusters: DataFrame, label: str = "leader") -> DataFrame:
    """Members per cluster; order by ``size`` descending for a report."""
    return clusters.groupBy("combo", "step", label).agg(F.count("*").alias("size"))


def number_clusters(clusters: DataFrame, seed: int = 42, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``label`` 1, 2, ... in the order in which the clusters were opened, and ``size``."""
    sizes = cluster_sizes(clusters).withColumn("_key", visit_key(F.col("leader"), seed))
    order = numbered(sizes, ["combo", "step"], ["_key", "leader"], "_at")
    labels = cut(order.select("combo", "step", "leader", (F.col("_at") + 1).cast("int").alias("label"), "size"))
    key = ["combo", "step", "leader"]
    hot = hot_or_none(labels.select(*key, "size"), "size", hot_rows)
    return lookup(clusters, labels, key, hot).select("combo", "step", "id", "leader", "label", "size")
