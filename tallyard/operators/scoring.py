"""Scoring against gold labels, paired comparisons and their statistics. Nothing on the inference side imports this."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyard.functions.text import collapse
from tallyard.runtime import ratio

# The comparisons that are tested, first against second method.
COMPARISONS = (
    ("A1_SINGLE_V1", "A3_SINGLE_V1"),
    ("A1_SINGLE_V1", "A5_SINGLE_V1"),
    ("A1_SINGLE_V1", "C3_COUNCIL_V1"),
    ("A1_SINGLE_V1", "C5_COUNCIL_V1"),
    ("A3_SINGLE_V1", "C3_COUNCIL_V1"),
    ("A5_SINGLE_V1", "C5_COUNCIL_V1"),
    ("A3_SINGLE_V1", "A5_SINGLE_V1"),
    ("C3_COUNCIL_V1", "C5_COUNCIL_V1"),
)


#: What an item's subgroups are told by.
SUBGROUPS = ("rung", "query_type", "graph_id", "story_id")


def gold_labels(items: DataFrame, source: DataFrame) -> DataFrame:
    """(item_id, gold, rung, query_type, graph_id, story_id): YES or NO of each item from the source rows with the same texts; items whose source rows disagree or lack a label have none."""
    label = F.upper(collapse(F.col("answer")))
    named = [F.lower(collapse(F.col(f"meta.{c}"))).alias(c) for c in ("query_type", "graph_id", "story_id")]
    text = F.sha2(F.to_json(F.array("given_info", "question")), 256).alias("text_hash")  # texts are joined by their hash
    written = "given_info is not null and question is not null"
    known = source.filter(written).select(text, label.alias("label"), F.col("meta.rung").alias("rung"), *named)
    joined = items.filter(written).select("item_id", text).distinct().join(known.filter("label in ('YES', 'NO')"), "text_hash")
    per = joined.groupBy("item_id").agg(F.min("label").alias("low"), F.max("label").alias("high"), *[F.min(c).alias(c) for c in SUBGROUPS])
    return per.filter("low = high").select("item_id", F.col("low").alias("gold"), *SUBGROUPS)


def judged(finals: DataFrame, gold: DataFrame) -> DataFrame:
    """Final answers of items with gold, with correct (a missing answer is not correct) and answered.

    Units that a run planned but has no row for are no rows here; scores and the others count them from runs and gold.
    """
    right = F.coalesce(F.col("final_answer") == F.col("gold"), F.lit(False))
    return finals.join(gold, "item_id").withColumns({"correct": right, "answered": F.col("final_answer").isNotNull()})


def planned_runs(calls: DataFrame) -> DataFrame:
    """(run_id, config_id): the methods that each run has; each is to answer every item with gold."""
    return calls.select("run_id", "config_id").dropna().distinct()


def scores(rows: DataFrame, runs: DataFrame, gold: DataFrame, by: tuple[str, ...] = ("config_id",)) -> DataFrame:
    """units, answered, correct, accuracy, completion and invalid rate per group; by is config_id, or run_id and config_id.

    The denominator is the gold: every planned run and method owes an answer to every item with gold, so an item
    that never was answered counts as wrong. Units are counted, not listed: planned runs times items.
    """
    owed = runs.groupBy(*by).agg(F.count("*").alias("_runs"))
    items = F.broadcast(gold.agg(F.count("*").alias("_items")))  # one row
    got = rows.groupBy(*by).agg(F.count_if("answered").alias("answered"), F.count_if("correct").alias("correct"))
    per = owed.join(items, how="left").join(got, list(by), "left").na.fill(0, ["answered", "correct"]).withColumn("units", F.col("_runs") * F.col("_items"))
    rate = lambda c: F.round(ratio(F.col(c), F.col("units")), 6)
    invalid = F.round(ratio(F.col("units") - F.col("answered"), F.col("units")), 6)
    return per.select(*by, "units", "answered", "correct", rate("correct").alias("accuracy"), rate("answered").alias("completion"), invalid.alias("invalid_rate"))


def unknown_predictions(finals: DataFrame, gold: DataFrame) -> DataFrame:
    """(item_id) of predictions for items without gold."""
    return finals.select("item_id").distinct().join(gold, "item_id", "left_anti")


def subgroup_scores(rows: DataFrame, runs: DataFrame, gold: DataFrame, small: int = 20) -> DataFrame:
    """(config_id, dimension, value, units, correct, accuracy, small_cell) per method overall (dimension all) and by rung, query type, graph and story.

    Units are planned runs times the cell's items with gold; cells of few units are flagged; items without a value
    form a cell with a null value.
    """
    cells = F.array(F.struct(F.lit("all").alias("dimension"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in SUBGROUPS])
    sizes = gold.select(F.inline(cells)).groupBy("dimension", "value").agg(F.count("*").alias("_items"))
    right = rows.filter("correct").select("config_id", F.inline(cells)).groupBy("config_id", "dimension", "value").agg(F.count("*").alias("correct"))
    owed = F.broadcast(runs.groupBy("config_id").agg(F.count("*").alias("_runs")).groupBy().agg(F.collect_list(F.struct("config_id", "_runs")).alias("_owed")))  # one row: the methods
    units = sizes.join(owed, how="left").select("dimension", "value", "_items", F.inline("_owed"))
    joined = units.alias("u").join(right.alias("r"), (F.col("u.config_id") == F.col("r.config_id")) & (F.col("u.dimension") == F.col("r.dimension")) & F.col("u.value").eqNullSafe(F.col("r.value")), "left")
    counted = joined.select("u.config_id", "u.dimension", "u.value", (F.col("_runs") * F.col("_items")).alias("units"), F.coalesce("correct", F.lit(0)).alias("correct"))
    return counted.withColumns({"accuracy": F.round(ratio(F.col("correct"), F.col("units")), 6), "small_cell": F.col("units") < small})


def quarantined(rows: DataFrame, bad_items: DataFrame) -> DataFrame:
    """rows without the items of bad_items, the same for every method."""
    return rows.join(bad_items.select("item_id").distinct(), "item_id", "left_anti")


def paired(rows: DataFrame, runs: DataFrame, gold: DataFrame) -> DataFrame:
    """Per comparison: units, both right, only one right, neither, and the accuracy difference.

    A unit is an item with gold in a run that has both methods; one without an answer is not right. Units of one run
    and item are brought together once, at most one row per method; those that no method has right are counted as
    runs times items less the others. Comparisons that no run has do not appear.
    """
    tests = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second")) for a, b in COMPARISONS])
    has = runs.groupBy("run_id").agg(F.collect_set("config_id").alias("c")).select("run_id", F.explode(tests).alias("t"), "c")
    has = has.filter(F.array_contains("c", F.col("t.first")) & F.array_contains("c", F.col("t.second")))
    owed = has.groupBy("t.first", "t.second").agg(F.count("*").alias("_runs"))
    per = rows.filter("correct").groupBy("run_id", "item_id").agg(F.collect_set("config_id").alias("right"))
    by_run = has.groupBy("run_id").agg(F.collect_list("t").alias("tests"))
    sides = per.join(by_run, "run_id").select("right", F.explode("tests").alias("t"))
    sides = sides.select("t.first", "t.second", F.array_contains("right", F.col("t.first")).alias("x"), F.array_contains("right", F.col("t.second")).alias("y"))
    counted = sides.groupBy("first", "second").agg(F.count_if(F.col("x") & F.col("y")).alias("both"), F.count_if(F.col("x") & ~F.col("y")).alias("only_first"), F.count_if(~F.col("x") & F.col("y")).alias("only_second"))
    items = F.broadcast(gold.agg(F.count("*").alias("_items")))  # one row
    joined = owed.join(counted, ["first", "second"], "left").join(items, how="left").na.fill(0, ["both", "only_first", "only_second"]).withColumn("units", F.col("_runs") * F.col("_items"))
    found = joined.select("first", "second", "units", "both", "only_first", "only_second", (F.col("units") - F.col("both") - F.col("only_first") - F.col("only_second")).alias("neither"))
    return found.withColumn("difference", F.round(ratio(F.col("only_second") - F.col("only_first"), F.col("units")), 6))


def binomial_tail(n: Column, k: Column) -> Column:
    """The chance of at most k heads in n fair throws, summed over logarithms."""
    zero = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        log = F.when(i == 0, -n * F.lit(0.6931471805599453)).otherwise(acc["log"] + F.log((n - i + 1).cast("double") / F.greatest(i, F.lit(1)).cast("double")))
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), k), zero, step, lambda acc: acc["sum"])


def mcnemar(pairs: DataFrame) -> DataFrame:
    """pairs with the exact two-sided p-value and the continuity-corrected statistic; no discordant pair gives p = 1 and no statistic."""
    b, c = F.col("only_first"), F.col("only_second")
    exact = F.round(F.least(F.lit(1.0), 2 * binomial_tail(b + c, F.least(b, c))), 6)
    statistic = F.round(F.try_divide(F.pow(F.greatest(F.abs(b - c) - 1, F.lit(0)).cast("double"), F.lit(2.0)), (b + c).cast("double")), 6)
    return pairs.select("first", "second", "only_first", "only_second", exact.alias("p_value"), statistic.alias("statistic"))


def benjamini_hochberg(tests: DataFrame, q: float = 0.05) -> DataFrame:
    """tests with the adjusted p-value over all of them and whether it stays at or below q (a fixed list of tests)."""
    all_of = Window.partitionBy(F.lit(1))
    up = Window.partitionBy(F.lit(1)).orderBy("p_value", "first", "second")
    down = Window.partitionBy(F.lit(1)).orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = tests.withColumn("place", F.row_number().over(up)).withColumn("m", F.count("*").over(all_of))
    adjusted = ranked.withColumn("adjusted", F.round(F.least(F.lit(1.0), F.min(F.col("p_value") * F.col("m") / F.col("place")).over(down)), 6))
    return adjusted.select("first", "second", "p_value", F.col("place").cast("bigint").alias("place"), "adjusted", (F.col("adjusted") <= q).alias("significant"))


def bootstrap_differences(pairs: DataFrame, reps: int = 10_000, seed: int = 20260905) -> DataFrame:
    """(first, second, units, difference, low, high): each comparison's accuracy difference with its 95 % interval over resampled unit pairs.

    Drawing units with their pair of outcomes, with replacement, gives the four outcome counts a multinomial
    distribution, so resamples are drawn from the counts of paired: as exact as drawing units, at a cost that does not
    depend on how many there are. The draws depend on seed and comparison only. low and high are the 2.5 and 97.5 %
    points, interpolated; without units all three are null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if not r.units:
                    out.append((r.first, r.second, 0, None, None, None))
                    continue
                own = int.from_bytes(hashlib.sha256(f"{seed}:{r.first}:{r.second}".encode()).digest()[:8], "big")
                cells = [r.only_first, r.only_second, r.both + r.neither]
                drawn = np.random.default_rng(own).multinomial(r.units, np.array(cells) / r.units, size=reps)
                low, high = np.quantile((drawn[:, 1] - drawn[:, 0]) / r.units, [0.025, 0.975])
                out.append((r.first, r.second, r.units, (r.only_second - r.only_first) / r.units, float(low), float(high)))
            yield pd.DataFrame(out, columns=["first", "second", "units", "difference", "low", "high"])

    made = pairs.select("first", "second", "units", "both", "only_first", "only_second", "neither").mapInPandas(run, "first string, second string, units bigint, difference double, low double, high double")
    return made.select("first", "second", "units", *[F.round(c, 6).alias(c) for c in ("difference", "low", "high")])


def efficiency(score: DataFrame, usage: DataFrame) -> DataFrame:
    """Tokens and latency per correct answer per method; null where nothing is correct or nothing is known."""
    joined = score.join(usage, "config_id")
    per = lambda c: F.round(ratio(F.col(c), F.col("correct")), 6)
    return joined.select("config_id", "accuracy", "invalid_rate", "tokens", "latency", per("tokens").alias("tokens_per_correct"), per("latency").alias("latency_per_correct"))


def pareto_front(rows: DataFrame) -> DataFrame:
    """Methods that no other one beats or equals in accuracy, tokens, latency and invalid rate while being better in one. Rows are one per method."""
    a, b = rows.alias("a"), rows.alias("b")
    as_good = (F.col("b.accuracy") >= F.col("a.accuracy")) & (F.col("b.tokens") <= F.col("a.tokens")) & (F.col("b.latency") <= F.col("a.latency")) & (F.col("b.invalid_rate") <= F.col("a.invalid_rate"))
    better = (F.col("b.accuracy") > F.col("a.accuracy")) | (F.col("b.tokens") < F.col("a.tokens")) | (F.col("b.latency") < F.col("a.latency")) | (F.col("b.invalid_rate") < F.col("a.invalid_rate"))
    return a.join(b, as_good & better, "left_anti").select("config_id")


def method_costs(calls: DataFrame) -> DataFrame:
    """Per method over one row per call: calls, call_units (runs and items it was called for), tokens, latency and cost totals; unknown values are left out of a total."""
    per = calls.groupBy("config_id", "run_id", "item_id").agg(F.count("*").alias("c"), F.sum("total_tokens").alias("t"), F.sum("latency_ms").alias("l"), F.sum("normalized_list_cost_usd").alias("u"))
    return per.groupBy("config_id").agg(
        F.sum("c").alias("calls"), F.count("*").alias("call_units"), F.sum("t").alias("tokens"), F.round(F.sum("l"), 3).alias("latency"), F.round(F.sum("u").cast("double"), 8).alias("cost")
    )


def efficiency_gains(pairs: DataFrame, costs: DataFrame) -> DataFrame:
    """Per comparison the accuracy difference in points, and per 1,000 more tokens, per more call and per more cent of a unit of the second method.

    A gain is null where its denominator is unknown, zero or negative.
    """
    mean = lambda c, x: ratio(F.col(f"{x}.{c}"), F.col(f"{x}.call_units"))
    more = lambda c: mean(c, "b") - mean(c, "a")
    joined = pairs.alias("p").join(F.broadcast(costs).alias("a"), F.col("p.first") == F.col("a.config_id")).join(F.broadcast(costs).alias("b"), F.col("p.second") == F.col("b.config_id"))
    points = F.col("p.difference") * 100
    gain = lambda d: F.round(points / F.when(d > 0, d), 6)
    return joined.select("first", "second", F.round(points, 4).alias("points"), gain(more("tokens") / 1000).alias("per_1k_tokens"), gain(more("calls")).alias("per_call"), gain(more("cost") * 100).alias("per_cent"))


#: The single method with as many calls as each council.
MATCHED = {"C3_COUNCIL_V1": "A3_SINGLE_V1", "C5_COUNCIL_V1": "A5_SINGLE_V1"}


def method_report(score: DataFrame, costs: DataFrame, baseline: str = "A1_SINGLE_V1") -> DataFrame:
    """One row per method: units, accuracy, its difference to the baseline and to the single method with as many calls, completion, invalid rate, and means per called unit.

    Cost per correct answer is null where nothing is correct. Tables are one row per method.
    """
    other = lambda name: F.broadcast(score.select(F.col("config_id").alias(f"_{name}"), F.col("accuracy").alias(name)))
    matched = F.try_element_at(F.create_map(*[F.lit(x) for pair in MATCHED.items() for x in pair]), F.col("config_id"))
    rows = score.join(F.broadcast(costs), "config_id", "left").join(other("base"), F.col("_base") == F.lit(baseline), "left").join(other("like"), F.col("_like") == matched, "left")
    mean = lambda c: F.round(ratio(F.col(c), F.col("call_units")), 6)
    apart = lambda c: F.round(F.col("accuracy") - F.col(c), 6)
    return rows.select(
        "config_id", "units", mean("calls").alias("calls_per_unit"), "accuracy", apart("base").alias("vs_baseline"), apart("like").alias("vs_matched"), "completion", "invalid_rate",
        mean("latency").alias("mean_latency"), mean("tokens").alias("mean_tokens"), "cost", F.round(ratio(F.col("cost"), F.col("correct")), 6).alias("cost_per_correct"),
    )


def effect_bands(pairs: DataFrame) -> DataFrame:
    """Each comparison's difference as relevant (3 points or more), borderline (2 to 3) or negligible."""
    size = F.abs("difference")
    return pairs.select("first", "second", "difference", F.when(size >= 0.03, "relevant").when(size >= 0.02, "borderline").otherwise("negligible").alias("band"))


def council_transitions(calls: DataFrame, gold: DataFrame) -> DataFrame:
    """Per council method: units, critics who disagree with the analyst, flips from the first to the last answer, corrections and harms."""
    councils = calls.filter(F.col("config_id").startswith("C"))
    per = councils.groupBy("run_id", "item_id", "config_id").agg(
        F.min_by("parsed_answer", "topology_position").alias("first"), F.max_by("parsed_answer", "topology_position").alias("last"), F.collect_list(F.when(F.col("role").contains("critic"), F.col("parsed_answer"))).alias("critics")
    ).join(gold, "item_id")
    differ = F.size(F.filter("critics", lambda x: x != F.col("first")))
    return per.groupBy("config_id").agg(
        F.count("*").alias("units"), F.sum(differ).alias("disagreements"), F.count_if(F.col("first") != F.col("last")).alias("flips"), F.count_if((F.col("first") != F.col("gold")) & (F.col("last") == F.col("gold"))).alias("corrections"), F.count_if((F.col("first") == F.col("gold")) & (F.col("last") != F.col("gold"))).alias("harms")
    )
