"""Train, validation and test splits that keep related records together."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyard.functions.text import collapse
from tallyard.operators.components import connected_components, key_edges
from tallyard.operators.ranking import hashed_rank
from tallyard.runtime import cut, ratio, skew_safe_join

KEYS = ("family", "story_id", "graph_id")
#: Spellings that stand for a missing value, lower-cased.
STAND_INS = ("-", "--", "?", ".", "n/a", "na", "nan", "nil", "none", "null", "unknown", "undefined", "missing", "tbd", "not available", "not applicable")
BINS = 100


def relation_key(value: Column) -> Column:
    """value without case and outer white space; null where it is null, blank or a stand-in for a missing value."""
    plain = F.lower(collapse(value.cast("string")))
    return F.when((plain == "") | plain.isin(*STAND_INS), F.lit(None)).otherwise(plain)


def related_groups(records: DataFrame, record_id: str = "source_index", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(node, component) of every record related to another one, directly or not; component is its group's smallest id.

    Each key relates records by its own values only. Null ids are left out; repeated rows are one record.
    """
    rows = records.filter(F.col(record_id).isNotNull())
    return connected_components(key_edges(rows, record_id, {k: relation_key(F.col(k)) for k in keys}))


def balance_bins(weights: dict[int, int], bins: int) -> list[dict[int, int]]:
    """Spread groups over bins of equal weight by largest differencing; weights maps a weight to how many groups have it.

    Whole multiples of the bin count are dealt evenly. The rest of each weight, fewer groups than bins, starts as one
    partition with a group in each of so many bins, as differencing would place equal weights; the two partitions
    with the widest spread are combined, the heaviest bin of one with the lightest of the other, until one is left.
    Returns for each bin how many groups of each weight it holds. The driver holds one partition per distinct
    weight, of which n rows have fewer than the square root of 2n, and per partition one small number a bin.
    """
    even = {w: n // bins for w, n in weights.items() if n >= bins}
    small = np.uint8 if bins <= 256 else np.uint32
    heap: list[tuple[int, int]] = []
    loads: dict[int, np.ndarray] = {}
    made: list[tuple] = []  # per partition its weight and count, or the two it was made of and the order of their sums

    def start(w: int, n: int) -> np.ndarray:
        return np.concatenate([np.zeros(bins - n, np.int64), np.full(n, w, np.int64)])

    for w in sorted(weights, reverse=True):
        if weights[w] % bins:
            heapq.heappush(heap, (-w, len(made)))
            made.append((w, weights[w] % bins))
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        x, y = (loads.pop(i) if i in loads else start(*made[i]) for i in (a, b))
        both = x + y[::-1]
        order = np.argsort(both, kind="stable")
        loads[len(made)] = both = both[order]
        heapq.heappush(heap, (int(both[0] - both[-1]), len(made)))
        made.append((a, b, order.astype(small)))
    result = [dict(even) for _ in range(bins)]
    open_parts = [(heap[0][1], np.arange(bins))] if heap else []
    while open_parts:  # from the last partition back to the first ones: where each bin lay
        at, place = open_parts.pop()
        if len(made[at]) == 2:
            w, n = made[at]
            for i in np.flatnonzero(place >= bins - n):
                result[i][w] = result[i].get(w, 0) + 1
        else:
            a, b, order = made[at]
            before = order[place].astype(np.int64)
            open_parts += [(a, before), (b, bins - 1 - before)]
    return result


def allocate_bins(bins: list[dict[int, int]], targets: dict[str, float]) -> dict[str, dict[int, int]]:
    """Give whole bins to splits, heaviest first, each to the split that lacks most of its target; groups per weight and split."""
    loads = [sum(w * n for w, n in b.items()) for b in bins]
    total, share = sum(loads), sum(targets.values())
    lacks = {s: total * t / share for s, t in targets.items()}
    given: dict[str, dict[int, int]] = {s: {} for s in targets}
    for i in sorted(range(len(bins)), key=lambda i: (-loads[i], i)):
        split = max(lacks, key=lambda s: (lacks[s], -list(targets).index(s)))
        lacks[split] -= loads[i]
        for w, n in bins[i].items():
            given[split][w] = given[split].get(w, 0) + n
    return given


def grouped_splits(records: DataFrame, targets: DataFrame, record_id: str = "source_index", keys: tuple[str, ...] = KEYS, seed: int = 20260905) -> DataFrame:
    """(record_id, group_id, split_name) of every distinct record id; a group never spans splits.

    targets has split_name and target_share; shares are taken relative to their sum. A record without relatives is
    a group of its own. Null ids are left out; no records give an empty result; without targets split_name is null.
    The driver sees the number of groups per group size only; which groups of a size go where is drawn from seed
    by a distributed rank. A group that holds many records reaches them by broadcast, so no task gets all of them.
    """
    ids = records.select(F.col(record_id).alias("node")).filter("node is not null").distinct()
    groups = related_groups(records, record_id, keys)
    placed = cut(ids.join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("group_id")))
    sizes = cut(placed.groupBy("group_id").agg(F.count("*").alias("weight")))
    histogram = {r["weight"]: r["n"] for r in sizes.groupBy("weight").agg(F.count("*").alias("n")).collect()}
    wanted = {r["split_name"]: float(r["target_share"]) for r in targets.select("split_name", "target_share").dropna().distinct().orderBy(F.desc("target_share"), "split_name").collect()}
    given = allocate_bins(balance_bins(histogram, BINS), wanted) if wanted else {}
    spans = []
    for w in histogram:
        start = 0
        for split in wanted:
            n = given[split].get(w, 0)
            if n:
                spans.append((w, start, start + n, split))
            start += n
    spark = records.sparkSession
    plan = F.broadcast(spark.createDataFrame(spans, "weight bigint, low bigint, high bigint, split_name string"))  # at most one row per size and split
    ranked = hashed_rank(sizes, ["weight"], ["group_id"], seed, sum(histogram.values()))
    chosen = ranked.join(plan, (ranked["weight"] == plan["weight"]) & (F.col("rank") > F.col("low")) & (F.col("rank") <= F.col("high")), "left")
    named = cut(chosen.select("group_id", "split_name", ranked["weight"].alias("weight")))
    return skew_safe_join(placed, named, ["group_id"], "weight", sum(w * n for w, n in histogram.items())).select(F.col("node").alias(record_id), "group_id", "split_name")


def split_shares(placed: DataFrame, targets: DataFrame) -> DataFrame:
    """(split_name, records, share, target_share, deviation) of each target: what a result of grouped_splits holds of it.

    Shares are of all placed records, target shares of their sum, both rounded to six places; a split that got
    nothing has 0 records. A target without a name or share is left out.
    """
    wanted = targets.select("split_name", F.col("target_share").cast("double").alias("t")).dropna().groupBy("split_name").agg(F.sum("t").alias("t"))
    total = wanted.agg(F.sum("t").alias("all"))
    counted = placed.groupBy("split_name").agg(F.count("*").alias("records"))
    rows = counted.agg(F.sum("records").alias("of"))
    joined = wanted.join(F.broadcast(counted), "split_name", "left").join(F.broadcast(rows), how="left").join(F.broadcast(total), how="left")
    share, aim = F.round(ratio(F.coalesce("records", F.lit(0)), F.col("of")), 6), F.round(ratio(F.col("t"), F.col("all")), 6)
    return joined.select("split_name", F.coalesce("records", F.lit(0)).alias("records"), share.alias("share"), aim.alias("target_share"), F.round(share - aim, 6).alias("deviation"))


def related_pairs(records: DataFrame, record_id: str = "source_index", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(anchor_index, record_id) of every record other than the smallest of its group; records without relatives do not appear."""
    groups = related_groups(records, record_id, keys).filter("node <> component")
    return groups.select(F.col("component").alias("anchor_index"), F.col("node").alias(record_id))
