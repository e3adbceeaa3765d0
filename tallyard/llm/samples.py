"""A sample whose categories have given shares, by swap repair of signature counts."""

from __future__ import annotations

import heapq
import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyard.functions.text import collapse
from tallyard.operators.ranking import hashed_rank
from tallyard.runtime import cut, small_side

SIGNATURE = ("rung", "answer", "query_type")


def plain_category(value: Column) -> Column:
    """A category as text without case and outer white space."""
    return F.lower(collapse(value.cast("string")))


def _signed(df: DataFrame, signature: tuple[str, ...]) -> DataFrame:
    return df.withColumns({f"_s{i}": plain_category(F.col(c)) for i, c in enumerate(signature)})


def swap_repair(available: dict, wanted: dict, floors: dict, size: int, seed: int) -> dict:
    """How many records to draw of each signature: a random sample that meets the floors, repaired by exchanges.

    available and floors are per signature, wanted holds each signature's exact target count (0 if absent).
    Start: the floors as far as records reach, the rest of size drawn at random without replacement. Then one
    record after another is exchanged from the signature most above its target to the one most below it that
    has records left, as long as the summed absolute deviation falls and no floor is broken. Both are kept in
    heaps, so an exchange costs the logarithm of the number of signatures, whatever the number of records.
    """
    keys = sorted(available, key=repr)
    floor = {k: min(floors.get(k, 0), available[k]) for k in keys}
    drawn, rng = dict(floor), random.Random(seed)
    left = max(0, min(size, sum(available.values())) - sum(drawn.values()))
    rest = sum(available[k] - drawn[k] for k in keys)
    for k in keys:  # a multivariate hypergeometric draw, one signature after another
        free = available[k] - drawn[k]
        take = _hypergeometric(rng, free, rest - free, left)
        drawn[k] += take
        left, rest = left - take, rest - free
    over = [(-(drawn[k] - wanted.get(k, 0)), i) for i, k in enumerate(keys) if drawn[k] > floor[k]]
    under = [(-(wanted.get(k, 0) - drawn[k]), i) for i, k in enumerate(keys) if drawn[k] < available[k]]
    heapq.heapify(over)
    heapq.heapify(under)
    while over and under:
        (a, i), (b, j) = over[0], under[0]
        above, below = -a, -b
        steps = int(min(above, below))
        if i == j or above + below <= 1 + 1e-9 or above <= 0 or below <= 0:
            break
        out, into = keys[i], keys[j]
        n = max(1, min(steps, drawn[out] - floor[out], available[into] - drawn[into]))
        drawn[out], drawn[into] = drawn[out] - n, drawn[into] + n
        heapq.heappop(over)
        heapq.heappop(under)
        if drawn[out] > floor[out]:
            heapq.heappush(over, (-(drawn[out] - wanted.get(out, 0)), i))
        if drawn[into] < available[into]:
            heapq.heappush(under, (-(wanted.get(into, 0) - drawn[into]), j))
    return drawn


def _hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of draws from good + bad, without replacement, are good.

    The distribution function is inverted outwards from the mode, so the steps are about as many as its standard
    deviation, whatever the counts; chances are exact up to floating arithmetic.
    """
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    if low >= high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    up = down = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(total, draws))
    left, above, below = rng.random() - up, mode, mode
    while left > 0 and (above < high or below > low):
        if above < high:
            up *= (good - above) / (above + 1) * (draws - above) / (bad - draws + above + 1)
            above += 1
            left -= up
            if left <= 0:
                return above
        if below > low:
            down *= below / (good - below + 1) * (bad - draws + below) / (draws - below + 1)
            below -= 1
            left -= down
            if left <= 0:
                return below
        if up < 1e-300 and down < 1e-300:
            break
    return mode


class TargetSample:
    """A sample of records after target shares, and the report on what could be met.

    Available for a target are the distinct ids that have its signature in some row; an id with rows of several
    signatures is drawn under one of them, the smallest complete one, so the sample has distinct ids and its counts are
    those of the plan. targets: target_id,
    the signature columns, target_share, min_rows and sample_rows. A record with a null in its signature counts
    for no target but may fill the sample. Repeated targets of one signature count separately. The driver holds
    one number per signature (bounded by max_signatures, else an error); records never leave the executors.
    """

    def __init__(self, records: DataFrame, targets: DataFrame, record_id: str = "source_index", signature: tuple[str, ...] = SIGNATURE, seed: int = 20260905, max_signatures: int = 1_000_000):
        self.record_id, self.signature, self.seed = record_id, signature, seed
        names = [f"_s{i}" for i in range(len(signature))]
        self.names = names
        rows = _signed(records.select(record_id, *signature), signature).filter(F.col(record_id).isNotNull())
        distinct = cut(rows.select(record_id, *names).distinct())
        lacking = F.lit(False)
        for c in names:
            lacking = lacking | F.col(c).isNull()
        first = distinct.groupBy(record_id).agg(F.min(F.struct(lacking.alias("lacking"), *names)).alias("_k"))
        self.rows = cut(first.select(record_id, *[F.col(f"_k.{c}").alias(c) for c in names]))

        def counts(of: DataFrame) -> dict[tuple, int]:
            found = of.groupBy(*names).agg(F.count("*").alias("n")).limit(max_signatures + 1).collect()
            if len(found) > max_signatures:
                raise ValueError(f"more than {max_signatures} signatures; choose coarser categories")
            return {tuple(r[c] for c in names): r["n"] for r in found}

        self.available, pool = counts(distinct), counts(self.rows)
        self.targets = _signed(targets, signature)
        listed = self.targets.select(*names, "min_rows", "sample_rows", F.col("target_share").cast("double").alias("share")).collect()
        self.size = max((r["sample_rows"] or 0 for r in listed), default=0)
        wanted, floors = {}, {}
        for r in listed:
            key = tuple(r[c] for c in names)
            wanted[key] = wanted.get(key, 0) + (r["share"] or 0) * (r["sample_rows"] or 0)
            floors[key] = max(floors.get(key, 0), r["min_rows"] or 0)
        self.wanted = wanted
        usable = {k: n for k, n in pool.items() if None not in k}
        if sum(usable.values()) < self.size:
            usable = pool
        self.total = sum(pool.values())
        self.drawn = swap_repair(usable, wanted, floors, self.size, seed)

    def report(self) -> DataFrame:
        """Each target with its needed, available and drawn rows, its drawn share, whether records suffice for it (met), whether the
        drawn ones do (reached), and by how many rows the draw is off its signature's target count."""
        spark = self.rows.sparkSession
        layout = ", ".join(f"{c} string" for c in self.names)
        known = [(*k, n, self.drawn.get(k, 0), float(self.drawn.get(k, 0) - self.wanted.get(k, 0))) for k, n in self.available.items() if None not in k]
        counts = small_side(spark.createDataFrame(known, f"{layout}, available bigint, drawn bigint, off double"), len(known))
        need = F.greatest(F.coalesce("min_rows", F.lit(0)), F.ceil(F.coalesce("target_share", F.lit(0)) * F.coalesce("sample_rows", F.lit(0)))).cast("bigint")
        joined = self.targets.join(counts, self.names, "left").withColumns({"needed": need, "available": F.coalesce("available", F.lit(0)), "drawn": F.coalesce("drawn", F.lit(0))})
        share = F.try_divide(F.col("drawn").cast("double"), F.col("sample_rows").cast("double"))
        return joined.select("target_id", *self.signature, "target_share", "needed", "available", "drawn", share.alias("drawn_share"), (F.col("available") >= F.col("needed")).alias("met"), (F.col("drawn") >= F.col("needed")).alias("reached"), F.round("off", 4).alias("off"))

    def draw(self) -> DataFrame:
        """(record_id, signature columns) of the sample.

        Each signature's records get an exact random rank by distributed buckets; the first ones are taken.
        """
        spark = self.rows.sparkSession
        layout = ", ".join(f"{c} string" for c in self.names)
        plan = small_side(spark.createDataFrame([(*k, n) for k, n in self.drawn.items()], f"{layout}, _take bigint"), len(self.drawn))
        ranked = hashed_rank(self.rows, self.names, [self.record_id], self.seed, self.total)
        same = [ranked[c].eqNullSafe(plan[c]) for c in self.names]
        taken = ranked.join(plan, same).filter(F.col("rank") <= F.col("_take"))
        return taken.select(self.record_id, *[ranked[f"_s{i}"].alias(c) for i, c in enumerate(self.signature)])
