"""Near-duplicate records by meet-in-the-middle ball hashing over word multisets, with exact verification.

A record's fingerprint is its multiset of words, each word told apart by its occurrence. Two records of a and b
words with similarity t (words in common over all words) differ in at most (a + b)(1 - t) / (1 + t) words. Words
are hashed into so many parts that in some part the two differ in one word at most. Every fingerprint emits, per
part, all variants within half the radius: the part itself and the part without one of its words. Such a pair
meets where one side's whole part is the other's, or the other's without a word. Variants are shuffled, colliding
pairs are deduplicated and verified on the whole multisets, so no pair at or above t is lost.

Groups of records that share a variant are compared by a parity sketch, many at once, before any pair is made;
larger groups in blocks, dealt over tasks. Sizes fall into classes; a record emits once for its own class, to meet records up to
its size, and once for each larger class that similar records can be in, so that the number of parts fits both.
Variants that very many records share are not compared at once: their records emit again under another,
independent partition, so that only records agreeing in both meet.

Variants are not shuffled all at once but in rounds, each of some of the parts: a round's variants are made, meet and
leave the disk before the next round's are made. Candidates are verified in rounds as well. So the disk holds a fixed
number of variants for each record, however many it has, and each variant is still made once.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyard.llm.format_copies import with_copy_key
from tallyard.operators.components import connected_components
from tallyard.runtime import cut, drop_cut, skew_safe_join, small_side

#: Records of a group that one task compares with each other.
GROUP_ROWS = 4000
#: Records of a group that are compared in blocks; larger groups emit again.
BLOCKED_ROWS = 100_000
LEVELS = 3
#: One record in so many tells which variants are hot.
SAMPLE = 64
#: Groups of up to so many rows are compared together, larger ones in rectangles of so many pairs.
SMALL_GROUP, SQUARE = 32, 1 << 18
#: Rows that a task takes up at once.
CHUNK_ROWS = 200_000
#: Records whose variants are made at once; each becomes hundreds of rows.
EMIT_BAGS = 500
#: Variant rows of one round: so many for each record, or so many over all if that is more.
ROUND_BAG_ROWS, ROUND_ROWS = 16, 8_000_000
#: Candidate pairs that are verified in one round: a part of the records' number, or so many if that is more.
VERIFY_SHARE, VERIFY_ROWS = 4, 200_000
#: Variant rows that one task sorts.
SORT_ROWS = 1_000_000
#: Ratio of the largest to the smallest record size of one size class.
CLASS_RATIO = 1.5
#: Size classes at most (enough for 10^40 words); a variant's low bits hold its class.
CLASSES = 256

_ITEM = "record_id string, copy_key string, bag string, n int, tokens array<bigint>, s0 bigint, s1 bigint"
#: v holds the variant and in its low bits the class; m is twice the record's size, plus one for a whole part.
_VARIANT = "v bigint, m bigint, bag_id bigint, s0 bigint, s1 bigint"


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import regex
    import xxhash

    find = regex.compile(r"[\p{L}\p{Nd}]+").findall
    hashed = xxhash.xxh64_intdigest
    for batch in batches:
        rows = []
        for record, key, text in zip(batch["record_id"], batch["copy_key"], batch["text"], strict=True):
            counts = Counter(find(text.lower()))
            tokens = np.array([hashed(f"{w}\n{k}") for w, c in counts.items() for k in range(c)], np.uint64)
            tokens.sort()
            digest = hashlib.sha256(tokens.tobytes()).digest()
            sketch = [0, 0]
            for bit in (tokens >> np.uint64(57)).tolist():
                sketch[bit >> 6] ^= 1 << (bit & 63)
            s0, s1 = np.array(sketch, np.uint64).view(np.int64).tolist()
            rows.append((record, key, digest.hex(), len(tokens), tokens.view(np.int64), s0, s1))
        yield pd.DataFrame(rows, columns=["record_id", "copy_key", "bag", "n", "tokens", "s0", "s1"])


class _Scheme:
    """Size classes, how many parts each needs, and the classes that a record takes part in."""

    def __init__(self, t: Fraction, largest: int):
        lows = [1]
        while lows[-1] <= largest:
            lows.append(max(lows[-1] + 1, int(lows[-1] * CLASS_RATIO)))
        if len(lows) > CLASSES:
            raise ValueError("texts too long for the size classes")
        self.lows = np.array(lows)
        highs = [x - 1 for x in lows[1:]] + [lows[-1]]
        self.parts = np.array([int(2 * x * (1 - t) / (1 + t)) // 2 + 1 for x in highs], np.uint64)
        of = [[hi for hi in range(lo, len(lows)) if highs[lo] >= t * lows[hi]] for lo in range(len(lows))]
        self.count = np.array([len(x) for x in of])
        self.start = np.cumsum(self.count) - self.count
        self.kinds = np.array([k for x in of for k in x])

    def emitted(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, class) of every class that rows of n words take part in."""
        own = np.searchsorted(self.lows, n, "right") - 1
        times = self.count[own]
        row = np.repeat(np.arange(len(own)), times)
        step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        return row, self.kinds[self.start[own][row] + step]


def _variants(scheme: _Scheme, level: int, kind: np.ndarray, salt: np.ndarray, tokens: list[np.ndarray], turn: int = 0, rounds: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, variant, whether it is a whole part) of each row's tokens under the partition of that level; salt is mixed into every variant.

    Of the parts only those of the round turn: every part is in exactly one round, whatever row it is of.
    """
    sizes = np.array([len(x) for x in tokens])
    flat = np.concatenate(tokens).view(np.uint64) if len(tokens) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    parts = scheme.parts[kind]
    first = (turn - kind) % rounds  # a row's parts of this round are first, first + rounds, ...
    held = np.maximum(0, -((first - parts.astype(np.int64)) // rounds))
    start = np.concatenate([[0], np.cumsum(held)])
    part = (_mix(flat + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)) % parts[row]).astype(np.int64)
    mine = part % rounds == first[row]
    flat, row, part = flat[mine], row[mine], part[mine]
    cell = start[row] + (part - first[row]) // rounds
    total = int(start[-1])
    sums, counts = np.zeros(total, np.uint64), np.bincount(cell, minlength=total).astype(np.uint64)
    mixed = _mix(flat + np.uint64(7))
    np.add.at(sums, cell, mixed)
    cell_row = np.repeat(np.arange(len(sizes)), held)
    index = first[cell_row] + rounds * (np.arange(total) - start[cell_row])
    tag = _mix(salt.view(np.uint64)[cell_row] + _mix(index.astype(np.uint64) * np.uint64(1 << 20) + kind.astype(np.uint64)[cell_row] + np.uint64(level << 50)))
    whole = _mix(sums + _mix(tag + counts))
    less = _mix(sums[cell] - mixed + _mix(tag[cell] + counts[cell] - np.uint64(1)))
    variants = np.concatenate([whole, less]) & ~np.uint64(CLASSES - 1)
    rows = np.concatenate([cell_row, row])
    return rows, (variants | kind.astype(np.uint64)[rows]).view(np.int64), np.repeat([True, False], [total, len(row)])


def _emit(scheme: _Scheme, level: int, turn: int = 0, rounds: int = 1):
    """For mapInPandas: rows (bag_id, n, tokens, s0, s1) and, above level 0, v to the variants of a round, or to all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), EMIT_BAGS):
                b = batch.iloc[at : at + EMIT_BAGS].reset_index(drop=True)
                size = b["n"].to_numpy().astype(np.int64)
                if level:
                    salt, source = b["v"].to_numpy(), np.arange(len(b))
                    kind = salt & (CLASSES - 1)
                else:
                    source, kind = scheme.emitted(size)
                    salt = np.zeros(len(source), np.int64)
                tokens = b["tokens"].to_list()
                row, v, whole = _variants(scheme, level, kind, salt, [np.asarray(tokens[i]) for i in source], turn, rounds)
                whose = source[row]
                yield pd.DataFrame({"v": v, "m": 2 * size[whose] + whole} | {c: b[c].to_numpy()[whose] for c in ("bag_id", "s0", "s1")})

    return run


def _compare(scheme: _Scheme, t: Fraction, columns: tuple[str, ...]):
    """For mapInPandas over rows in order of columns: (a, b) of the rows of one group that may be similar; true for every similar pair in some group.

    One of the two must be a whole part, the class must be that of the larger record, and the sizes must be near
    enough. Each word that one side lacks flips one bit of the parity sketch, so no more bits may differ than words
    can. In a block of two different halves only pairs across them are compared. Memory is a chunk's, or a group's.
    """

    up, down = t.denominator - t.numerator, t.denominator + t.numerator

    def near(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, k = x["m"][a] >> 1, x["m"][b] >> 1
        larger, smaller = np.maximum(n, k), np.minimum(n, k)
        apart = np.bitwise_count(x["s0"][a] ^ x["s0"][b]).astype(np.int64) + np.bitwise_count(x["s1"][a] ^ x["s1"][b])
        right = apart * down <= (n + k) * up
        right &= smaller * t.denominator >= larger * t.numerator
        right &= (larger >= scheme.lows[x["v"][a] & (CLASSES - 1)]) & (x["bag_id"][a] != x["bag_id"][b])
        if "own" in x:
            right &= (x["i"][a] == x["j"][a]) | (x["own"][a] != x["own"][b])
        return right

    def candidates(x: dict[str, np.ndarray], ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(a, b): positions of a whole part and another row of its group; of large groups only those with near sketches."""
        starts = np.append(0, ends[:-1])
        whole = x["m"] & 1 == 1
        small = ends - starts <= SMALL_GROUP
        after = np.repeat(ends, ends - starts) - 1 - np.arange(len(whole))
        active, step = np.flatnonzero(whole & (after > 0) & np.repeat(small, ends - starts)), 1
        while len(active):
            yield active, active + step
            step += 1
            active = active[after[active] >= step]
        for low, high in zip(starts[~small].tolist(), ends[~small].tolist(), strict=True):
            wholes = int(whole[low:high].sum())
            size = x["m"][low:high] >> 1
            most = np.minimum((size + size.max()) * up // down, 255).astype(np.uint8)
            s0, s1 = x["s0"][low:high], x["s1"][low:high]
            width = max(1, SQUARE // (high - low))
            for at in range(0, wholes, width):
                to = min(at + width, wholes)
                apart = np.bitwise_count(s0[at:to, None] ^ s0[None, at:])
                apart += np.bitwise_count(s1[at:to, None] ^ s1[None, at:])
                a, b = np.nonzero(apart <= most[at:to, None])
                keep = b > a
                yield low + at + a[keep], low + at + b[keep]

    def pairs(x: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        order = np.lexsort((1 - (x["m"] & 1), *[x[c] for c in reversed(columns)]))  # whole parts first in their group
        x = {c: v[order].view(np.uint64) if c in ("s0", "s1") else v[order] for c, v in x.items()}
        new = np.zeros(len(order), bool)
        for c in columns:
            new[1:] |= x[c][1:] != x[c][:-1]
        found, count = [], 0
        for a, b in candidates(x, np.append(np.flatnonzero(new), len(order))):
            hit = near(x, a, b)
            if hit.any():
                found.append(np.stack([x["bag_id"][a[hit]], x["bag_id"][b[hit]]]))
                count += int(hit.sum())
            if count >= CHUNK_ROWS:
                yield written(found)
                found, count = [], 0
        if found:
            yield written(found)

    def written(found: list[np.ndarray]) -> pd.DataFrame:
        both = np.concatenate(found, axis=1)
        return pd.DataFrame({"a": both.min(axis=0), "b": both.max(axis=0)}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count < CHUNK_ROWS:
                continue
            x = {c: np.concatenate([h[c].to_numpy() for h in held]) for c in batch.columns}
            last = np.zeros(count, bool)
            for c in columns:
                last |= x[c] != x[c][-1]
            done = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            yield from pairs({c: v[:done] for c, v in x.items()})
            held, count = [pd.DataFrame({c: v[done:] for c, v in x.items()})], count - done
        if count:
            yield from pairs({c: np.concatenate([h[c].to_numpy() for h in held]) for c in held[0].columns})

    return run


def _meet(rows: DataFrame, on: tuple[str, ...], scheme: _Scheme, t: Fraction, expected: int) -> DataFrame:
    """Pairs of rows that agree in the columns on; groups are brought together by one shuffle and met in sorted order."""
    tasks = -(-expected // SORT_ROWS)
    dealt = rows.repartition(tasks, *on) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(*on)
    return dealt.sortWithinPartitions(*on).mapInPandas(_compare(scheme, t, on), "a bigint, b bigint")


def _candidates(source: DataFrame, bags: DataFrame, scheme: _Scheme, t: Fraction, level: int = 0) -> Iterator[DataFrame]:
    """Tables (a, b) of pairs that may be similar, one a round; true for every similar pair of source in some table.

    source: rows of bags, above level 0 with the variant v that they share. Which variants are hot is told from one
    record in SAMPLE, as only the way their groups are dealt depends on it: a group compared as a whole, in blocks or
    after another partition gives the same pairs.
    """
    records, words = source.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    sampled = F.pmod(F.xxhash64("bag_id"), F.lit(SAMPLE)) == 0
    seen = source.filter(sampled).mapInPandas(_emit(scheme, level), _VARIANT)
    hot = cut(seen.groupBy("v").agg((F.count("*") * SAMPLE).alias("c")).filter(F.col("c") > GROUP_ROWS), True)
    groups, largest = hot.agg(F.count("*"), F.coalesce(F.max("c"), F.lit(0))).head()
    last = level == LEVELS - 1 or largest <= BLOCKED_ROWS
    blocked = hot if last else hot.filter(F.col("c") <= BLOCKED_ROWS)
    repeated = blocked.agg(F.coalesce(F.sum(F.col("c") * F.ceil(F.col("c") / GROUP_ROWS)), F.lit(0))).head()[0]
    plain = int((words + words * (1 - t) / (1 + t) + records) * (1 if level else scheme.count.max()))
    rounds = min(-(-(plain + repeated) // max(ROUND_ROWS, ROUND_BAG_ROWS * records)), int(scheme.parts.max())) or 1
    known = small_side(hot.select("v"), groups)
    for turn in range(rounds):
        rows = source.mapInPandas(_emit(scheme, level, turn, rounds), _VARIANT)
        met = _meet(rows.join(known, "v", "left_anti") if groups else rows, ("v",), scheme, t, plain // rounds)
        if groups:
            dealt = _blocks(rows.join(small_side(blocked, groups), "v"), "bag_id")
            met = met.unionByName(_meet(dealt, ("v", "i", "j"), scheme, t, repeated // rounds))
        yield cut(met.distinct(), True)
        if not last:
            again = rows.join(small_side(hot.filter(F.col("c") > BLOCKED_ROWS).select("v"), groups), "v", "left_semi")
            deeper = cut(again.select("v", "bag_id").join(bags.hint("merge"), "bag_id"), True)
            yield from _candidates(deeper, bags, scheme, t, level + 1)
            drop_cut(deeper)
    drop_cut(hot)


def _verified(pairs: DataFrame, bags: DataFrame, t: Fraction) -> DataFrame:
    """(a, b, common) of the pairs that reach the similarity, by the whole multisets; in rounds by a, each with the bags it needs only."""
    count, records = pairs.count(), bags.count()
    rounds = -(-count // max(VERIFY_ROWS, records // VERIFY_SHARE)) or 1
    done = []
    for turn in range(rounds):
        some = pairs.filter(F.pmod(F.xxhash64("a"), F.lit(rounds)) == turn)

        def side(x: str, some: DataFrame = some) -> DataFrame:
            needed = bags.join(small_side(some.select(F.col(x).alias("bag_id")).distinct(), 2 * count // rounds), "bag_id", "left_semi") if rounds > 1 else bags
            return needed.select(F.col("bag_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"tokens_{x}")).hint("merge")

        both = some.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("tokens_a", "tokens_b")))
        done.append(cut(both.filter(F.col("common") * (t.denominator + t.numerator) >= (F.col("n_a") + F.col("n_b")) * t.numerator).select("a", "b", "common"), True))
    return _union(done)


def _union(tables: list[DataFrame]) -> DataFrame:
    made = tables[0]
    for more in tables[1:]:
        made = made.unionByName(more)
    return made


def similar_bags(bags: DataFrame, similarity: str = "0.7") -> DataFrame:
    """(a, b, common) of all pairs of different bags (bag_id, n, tokens, s0, s1) that reach the similarity, a < b. bags should be a result of cut, as every round reads it."""
    t = Fraction(similarity)
    bags = bags.filter("n > 0").select("bag_id", "n", "tokens", "s0", "s1")
    scheme = _Scheme(t, bags.agg(F.coalesce(F.max("n"), F.lit(1))).head()[0])
    found = list(_candidates(bags, bags, scheme, t))
    pairs = cut(_union(found).distinct(), True)
    for table in found:
        drop_cut(table)
    return _verified(pairs, bags, t)


def _blocks(rows: DataFrame, member: str) -> DataFrame:
    """rows of groups of c rows, dealt by member into blocks of about GROUP_ROWS and repeated for every pair of blocks they belong to."""
    blocks = F.ceil(F.col("c") / GROUP_ROWS).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64(member), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumns({"i": F.least("own", "_other"), "j": F.greatest("own", "_other")}).drop("_other", "c")


class NearDuplicates:
    """Records that are similar to others: bags of equal words once, the links between bags, and who belongs to each.

    Words are maximal runs of letters or digits of the fields together, lower-cased; similarity is the words in
    common, counted with repetition, over all words of both. Null fields count as empty; records without a word or
    with a null id are linked with nothing; repeated rows of one id are one record.

    bags: (bag_id, bag, n, tokens, s0, s1, rows), one row for each multiset of words. members: (bag_id, copy_key,
    record_id). links: (a, b, common) of similar bags, a < b. Each is a table in the shared folder.
    """

    def __init__(self, items: DataFrame, record_id: str = "item_id", fields: tuple[str, ...] = ("given_info", "question"), similarity: str = "0.7"):
        named = items.select(F.col(record_id).cast("string").alias("record_id"), *fields).filter("record_id is not null")
        keyed = with_copy_key(named, fields).select("record_id", "copy_key", F.concat_ws("\n", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]).alias("text"))
        made = cut(keyed.mapInPandas(_bags, _ITEM).filter("n > 0"), True)
        # ids are given while the table is written, once, so no two bags can share one
        grouped = made.groupBy("bag").agg(*[F.first(c).alias(c) for c in ("n", "tokens", "s0", "s1")], F.count("*").alias("rows"))
        self.bags = cut(grouped.withColumn("bag_id", F.monotonically_increasing_id()), True)
        total = self.bags.agg(F.coalesce(F.sum("rows"), F.lit(0))).head()[0]
        self.members = cut(skew_safe_join(made.select("record_id", "copy_key", "bag"), self.bags.select("bag", "bag_id", "rows"), ["bag"], "rows", total).drop("bag").distinct(), True)
        drop_cut(made)
        self.links = similar_bags(self.bags, similarity)

    def groups(self) -> DataFrame:
        """(record_id, class_id, links, group_id) of every record with a word.

        class_id is the smallest id of the records with the same words, links the number of other classes similar to
        that class, group_id the smallest id of all records reached by links: the records that small edits connect.
        No pair of records is made.
        """
        first = cut(self.members.groupBy("bag_id").agg(F.min("record_id").alias("class_id"), F.count("*").alias("rows")))
        ends = self.links.select(F.inline(F.array(F.struct(F.col("a").alias("bag_id")), F.struct(F.col("b").alias("bag_id")))))
        linked = ends.groupBy("bag_id").agg(F.count("*").alias("links"))
        reached = connected_components(self.links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "bag_id")
        joined = first.join(linked, "bag_id", "left").join(reached, "bag_id", "left").withColumn("component", F.coalesce("component", "bag_id"))
        smallest = cut(joined.groupBy("component").agg(F.min("class_id").alias("group_id"), F.count("*").alias("_n")))
        total = first.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).head()
        classes = cut(skew_safe_join(joined, smallest, ["component"], "_n", total[0]).select("bag_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"), "group_id", "rows"))
        return skew_safe_join(self.members.select("record_id", "bag_id"), classes, ["bag_id"], "rows", total[1]).select("record_id", "class_id", "links", "group_id")

    def pairs(self) -> DataFrame:
        """(record_id_a, record_id_b) of all similar pairs of records, the smaller id first, without format-only copies.

        Links are expanded to the copy keys of their bags and those to records. A bag of many copy keys, and a copy
        key of many records, is dealt into blocks, so that no task expands a large group alone.
        """
        classes = cut(self.members.groupBy("bag_id", "copy_key").agg(F.count("*").alias("rows")), True)
        named_class = lambda x: classes.select(F.col("bag_id").alias(x), F.col("copy_key").alias(f"key_{x}")).hint("merge")
        across = self.links.join(named_class("a"), "a").join(named_class("b"), "b").select("key_a", "key_b")
        counts = cut(classes.groupBy("bag_id").agg(F.count("*").alias("c"), F.count("*").alias("_n")).filter("c > 1"), True)
        several = skew_safe_join(classes.select("bag_id", "copy_key"), counts, ["bag_id"], "_n", counts.agg(F.coalesce(F.sum("c"), F.lit(0))).head()[0])
        dealt = _blocks(several, "copy_key")
        within = dealt.alias("x").join(dealt.alias("y").hint("merge"), [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("bag_id", "i", "j")] + [F.col("x.copy_key") < F.col("y.copy_key")])
        keys = cut(across.unionByName(within.select(F.col("x.copy_key").alias("key_a"), F.col("y.copy_key").alias("key_b"))).distinct(), True)
        sizes = cut(classes.groupBy("copy_key").agg(F.sum("rows").alias("rows")).withColumn("blocks", F.ceil(F.col("rows") / GROUP_ROWS).cast("int")), True)
        total = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0))).head()[0]
        placed = skew_safe_join(self.members.select("copy_key", "record_id"), sizes, ["copy_key"], "rows", total).withColumn("block", F.pmod(F.xxhash64("record_id"), "blocks").cast("int")).drop("blocks")
        for x in ("a", "b"):
            dealt_keys = keys.join(sizes.select(F.col("copy_key").alias(f"key_{x}"), "blocks"), f"key_{x}").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
            keys = dealt_keys.join(placed.select(F.col("copy_key").alias(f"key_{x}"), "block", F.col("record_id").alias(f"id_{x}")).hint("merge"), [f"key_{x}", "block"]).drop(f"key_{x}", "block")
        named = keys.filter("id_a <> id_b").select(F.least("id_a", "id_b").alias("record_id_a"), F.greatest("id_a", "id_b").alias("record_id_b"))
        return named.distinct()


def near_duplicates(items: DataFrame, record_id: str = "item_id", fields: tuple[str, ...] = ("given_info", "question"), similarity: str = "0.7") -> DataFrame:
    """The pairs of NearDuplicates."""
    return NearDuplicates(items, record_id, fields, similarity).pairs()
