"""Exact ranks inside groups of any size, without sorting a group in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyard.runtime import cut, small_side

#: Rows that one ranking bucket holds on average, or the square root of all rows if that is more.
BUCKET_ROWS = 2048


def random_key(*columns: Column, seed: int) -> Column:
    """A 63-bit number that depends on the columns and the seed only, so that any partitioning gives the same order."""
    return F.xxhash64(F.lit(seed).cast("bigint"), *columns).bitwiseAND(F.lit((1 << 63) - 1))


def hashed_rank(df: DataFrame, group: list[str], unique: list[str], seed: int, total: int, rank: str = "rank") -> DataFrame:
    """df with a 1-based rank of each row inside its group, in an order drawn at random from seed.

    unique names columns that tell rows apart inside a group (ties in the drawn number are broken by them).
    The drawn number's leading bits give its bucket; buckets and rows of a bucket both grow with the square root of
    the rows at most. A histogram of (group, bucket) gives each bucket's offset and row_number runs inside buckets only, so a group holding a third of all rows
    is spread over as many tasks as any other rows. Null group values form a group of their own.
    """
    buckets = max(1, total // max(BUCKET_ROWS, math.isqrt(total)))
    draw = df.withColumn("_draw", random_key(*[F.col(c) for c in unique], seed=seed))
    draw = draw.withColumn("_bucket", F.floor(F.col("_draw") / F.lit(float(1 << 63)) * buckets).cast("bigint"))
    draw = draw.withColumn("_group", F.struct(*group) if group else F.lit(0))
    counts = draw.groupBy("_group", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_group", "_bucket").orderBy("_draw", *unique)
    placed = draw.join(offsets, ["_group", "_bucket"])
    return placed.withColumn(rank, F.row_number().over(inside) + F.col("_offset")).drop("_draw", "_bucket", "_group", "_offset")


def exact_quantiles(rows: DataFrame, by: str, measure: str, probs: tuple[float, ...], pieces: int = 128) -> DataFrame:
    """(by, quantiles): per group the interpolated quantiles of a measure, one for each of probs, exact and split over tasks.

    Equal values are counted once by partial aggregates. Approximate quantiles cut each group's values into pieces; the
    pieces' counts tell in which piece each wanted rank lies, and only those pieces are put in order, each by a task of its
    own. Null measures do not count; a group without any has null. Groups are told by one row each.
    """
    key = F.struct(F.col(by).alias("g")).alias("_k")
    known = rows.select(key, F.col(measure).cast("double").alias("_x")).filter("_x is not null")
    counts = known.groupBy("_k", "_x").agg(F.count("*").alias("_c"))
    edges = cut(known.groupBy("_k").agg(F.percentile_approx("_x", [i / pieces for i in range(1, pieces)], pieces * 20).alias("_e"), F.count("*").alias("_n")))
    cuts = small_side(edges, edges.count())
    placed = cut(counts.join(cuts, "_k").select("_k", "_x", "_c", F.size(F.filter("_e", lambda e: e < F.col("_x"))).alias("_p")))
    before = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_k", "_p").agg(F.sum("_c").alias("_s")).withColumn("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    places = [F.lit(p) * (F.col("_n") - 1) for p in probs]
    wanted = edges.select("_k", F.explode(F.array_distinct(F.array(*[f(x).cast("bigint") for x in places for f in (F.floor, F.ceil)]))).alias("_r"))
    where = wanted.join(sizes, "_k").filter((F.col("_r") >= F.col("_b")) & (F.col("_r") < F.col("_b") + F.col("_s"))).select("_k", "_p", (F.col("_r") - F.col("_b")).alias("_i"), "_r")
    where = where.groupBy("_k", "_p").agg(F.collect_list(F.struct("_i", "_r")).alias("_w"))  # at most two ranks for each of probs
    upto = Window.partitionBy("_k", "_p").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ordered = placed.join(where, ["_k", "_p"]).withColumn("_u", F.sum("_c").over(upto))
    hit = ordered.select("_k", "_x", F.explode(F.filter("_w", lambda w: (w["_i"] < F.col("_u")) & (w["_i"] >= F.col("_u") - F.col("_c")))).alias("_w"))
    found = hit.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct(F.col("_w._r").alias("r"), F.col("_x").alias("x")))).alias("_m"))
    value = lambda r: F.try_element_at("_m", r.cast("bigint"))
    parts = [value(F.floor(x)) + (value(F.ceil(x)) - value(F.floor(x))) * (x - F.floor(x)) for x in places]
    made = edges.join(found, "_k").select("_k", F.array(*parts).alias("quantiles"))
    groups = rows.select(key).distinct()
    return groups.join(made, "_k", "left").select(F.col("_k.g").alias(by), "quantiles")
