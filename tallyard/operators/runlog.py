"""Analytics over attempt and call logs: latest deliveries, chains, gaps, completeness, overhead, distributions."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyard.functions.text import blank
from tallyard.operators.calls import PLAN
from tallyard.operators.ranking import exact_quantiles
from tallyard.runtime import ratio

#: The role of each position of each method that an attempt may have: the plan's, and the boundary method's single one.
ROLES = {(c, p): r for c, p, r, _ in (*PLAN, ("C1_BOUNDARY_V1", 0, "analyst", ()))}

ATTEMPT = ("call_id", "attempt_index")


def latest_attempts(events: DataFrame, columns: list[str]) -> DataFrame:
    """One row per attempt with the columns of its latest delivery; deliveries at one time are told apart by the columns' values."""
    rest = [c for c in columns if c not in ATTEMPT]
    return events.groupBy(*ATTEMPT).agg(F.max(F.struct("ingested_at", *rest)).alias("l")).select(*ATTEMPT, *[F.col(f"l.{c}").alias(c) for c in rest])


def utc_state(text):
    """ok, wrong_offset or unreadable for an ISO timestamp that must be in UTC; null stays null."""
    return F.when(text.isNull(), None).when(F.try_to_timestamp(text).isNull(), "unreadable").when(text.rlike(r"(Z|\+00:00)$"), "ok").otherwise("wrong_offset")


def attempt_chains(attempts: DataFrame) -> DataFrame:
    """Per call: attempts, first and last index, whether indexes run from 0 without a gap, and the last attempt's status."""
    per = attempts.groupBy("call_id").agg(F.count("*").alias("attempts"), F.min("attempt_index").alias("low"), F.max("attempt_index").alias("high"), F.max_by("status", "attempt_index").alias("last_status"))
    return per.withColumn("contiguous", (F.col("low") == 0) & (F.col("high") + 1 == F.col("attempts")))


def unmatched_calls(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(call_id, side): calls on one side of the full outer join only, expected_only or actual_only."""
    joined = expected.select("call_id", F.lit(True).alias("e")).distinct().join(actual.select("call_id", F.lit(True).alias("a")).distinct(), "call_id", "full_outer")
    return joined.filter("e is null or a is null").select("call_id", F.when(F.col("e").isNull(), "actual_only").otherwise("expected_only").alias("side"))


def start_gaps(attempts: DataFrame, seconds: float, span: float = 600.0) -> DataFrame:
    """Per run and provider: starts, and how many came within so many seconds of the one before. Unreadable times are left out.

    Time is cut into spans; starts are put in order inside a span only, and each span's first start is held against the
    last one of the span before that has any, over one row a span. So no task orders all starts of a provider.
    """
    micros, limit = F.unix_micros(F.try_to_timestamp("timestamp_utc")), int(seconds * 1_000_000)
    timed = attempts.select("run_id", "provider", micros.alias("at")).filter("at is not null").withColumn("span", F.floor(F.col("at") / int(span * 1_000_000)))
    inside = Window.partitionBy("run_id", "provider", "span").orderBy("at")
    gaps = timed.withColumn("gap", F.col("at") - F.lag("at").over(inside))
    spans = gaps.groupBy("run_id", "provider", "span").agg(F.count("*").alias("n"), F.count_if(F.col("gap") < limit).alias("close"), F.min("at").alias("first"), F.max("at").alias("last"))
    border = F.col("first") - F.lag("last").over(Window.partitionBy("run_id", "provider").orderBy("span"))
    joined = spans.withColumn("close", F.col("close") + F.coalesce((border < limit).cast("int"), F.lit(0)))
    return joined.groupBy("run_id", "provider").agg(F.sum("n").alias("starts"), F.sum("close").alias("too_close"))


def completeness(expected: DataFrame, done: DataFrame) -> DataFrame:
    """Per item: calls expected and done, and complete, partial or untouched."""
    joined = expected.select("item_id", "call_key").distinct().join(done.select("call_key", F.lit(1).alias("d")).distinct(), "call_key", "left")
    per = joined.groupBy("item_id").agg(F.count("*").alias("expected"), F.count("d").alias("done"))
    return per.withColumn("state", F.when(F.col("done") == 0, "untouched").when(F.col("done") < F.col("expected"), "partial").otherwise("complete"))


def next_batch(states: DataFrame, size: int) -> DataFrame:
    """The first items, by id, that are not complete (a bounded session)."""
    return states.filter("state <> 'complete'").orderBy("item_id").limit(size).select("item_id", "state")


def retry_overhead(attempts: DataFrame) -> DataFrame:
    """Per method: calls, attempts, retries, retry rate, and tokens and latency that repeated attempts took (null measures are no zeros)."""
    again = F.col("attempt_index") > 0
    per = attempts.groupBy("config_id").agg(
        F.count_distinct("call_id").alias("calls"),
        F.count("*").alias("attempts"),
        F.count_if(again).alias("retries"),
        F.sum(F.when(again, F.col("total_tokens"))).alias("retry_tokens"),
        F.round(F.sum(F.when(again, F.col("latency_ms"))), 3).alias("retry_latency_ms"),
        F.count_if(again & F.col("total_tokens").isNull()).alias("retries_without_tokens"),
    )
    return per.withColumn("retry_rate", F.round(ratio(F.col("retries"), F.col("attempts")), 6))


def failure_sets(attempts: DataFrame) -> DataFrame:
    """Failures by layer, provider, role and method, each on its own and in all: grouping sets in one pass."""
    failed = attempts.filter("failure_type is not null").withColumn("layer", F.regexp_extract("failure_type", "^([^/]+)", 1))
    sets = failed.groupingSets([["layer"], ["provider"], ["role_name"], ["config_id"], []], "layer", "provider", "role_name", "config_id")
    return sets.agg(F.grouping_id().alias("set_id"), F.count("*").alias("failures"))


def usage_totals(calls: DataFrame, by: str = "config_id") -> DataFrame:
    """Sums in which an unknown value is never a zero.

    Per group: calls, calls with a cost, total_cost (null if any call lacks one), subtotal_cost (of the known ones),
    call and token coverage, and actual_charge (only if every call reported one). Ratios are null where undefined.
    """
    cost = F.col("normalized_list_cost_usd")
    per = calls.groupBy(by).agg(
        F.count("*").alias("calls"),
        F.count(cost).alias("priced_calls"),
        F.sum(cost).alias("s"),
        F.sum("total_tokens").alias("known_tokens"),
        F.sum(F.when(cost.isNotNull(), F.col("total_tokens"))).alias("priced_tokens"),
        F.count("actual_charge_usd").alias("charged"),
        F.sum("actual_charge_usd").alias("a"),
    )
    return per.select(
        by,
        "calls",
        "priced_calls",
        F.round(F.when(F.col("priced_calls") == F.col("calls"), F.col("s")).cast("double"), 6).alias("total_cost"),
        F.round(F.coalesce(F.col("s").cast("double"), F.lit(0.0)), 6).alias("subtotal_cost"),
        F.round(ratio(F.col("priced_calls"), F.col("calls")), 6).alias("call_coverage"),
        F.round(ratio(F.coalesce("priced_tokens", F.lit(0)), F.col("known_tokens")), 6).alias("token_coverage"),
        F.round(F.when(F.col("charged") == F.col("calls"), F.col("a")), 6).alias("actual_charge"),
    )


def distribution(rows: DataFrame, by: str, measure: str) -> DataFrame:
    """Per group: n, mean, sample deviation, quartiles (interpolated) and range of a measure; nulls do not count."""
    m = F.col(measure)
    per = rows.groupBy(by).agg(F.count(m).alias("n"), F.round(F.avg(m), 6).alias("mean"), F.round(F.stddev_samp(m), 6).alias("sd"), F.min(m).alias("low"), F.max(m).alias("high"))
    three = exact_quantiles(rows, by, measure, (0.25, 0.5, 0.75)).withColumnRenamed(by, "_by")
    joined = per.join(three, per[by].eqNullSafe(three["_by"]), "left")
    q = lambda i: F.round(F.get("quantiles", F.lit(i)), 6)
    return joined.select(by, "n", "mean", "sd", "low", q(0).alias("q1"), q(1).alias("median"), q(2).alias("q3"), "high", (q(2) - q(0)).alias("iqr"))


# Statuses that an attempt may have.
STATUSES = ("success", "failure", "method_failure", "run_blocked", "data_validation_failure", "incomplete")
# Fields of an attempt that must not be blank.
NAMED = ("run_id", "item_id", "split_name", "model_id", "provider", "prompt_version", "call_id", "code_version")


def broken_rules(rules: dict[str, Column]) -> Column:
    """The names of the rules whose condition holds, in order, joined by commas; an unknown condition does not count."""
    return F.array_join(F.array_compact(F.array(*[F.when(v, k) for k, v in rules.items()])), ",")


def event_rules() -> dict[str, Column]:
    """What is wrong with an attempt, by rule: conditions over the columns of an event record."""
    steps = F.try_element_at(F.create_map(*[F.lit(x) for c, n in Counter(c for c, _ in ROLES).items() for x in (c, n)]), F.col("config_id"))
    roles = F.create_map(*[F.lit(x) for (c, p), r in ROLES.items() for x in (f"{c}:{p}", r)])
    role = F.try_element_at(roles, F.concat_ws(":", "config_id", F.col("topology_position").cast("string")))
    absent = F.lit(False)
    for field in NAMED:
        absent = absent | blank(F.col(field))
    negative = F.lit(False)
    for field in ("input_tokens", "output_tokens", "total_tokens"):
        negative = negative | F.coalesce(F.col(field) < 0, F.lit(False))
    both = F.col("input_tokens") + F.col("output_tokens")
    outside = lambda c, low, high: c.isNull() | (c < low) | (c >= high)
    return {
        "blank_name": absent,
        "config": steps.isNull(),
        "parsed_answer": F.coalesce(~F.col("parsed_answer").isin("YES", "NO", "INVALID"), F.lit(True)),
        "final_answer": ~F.col("final_answer").isin("YES", "NO"),
        "attempt_index": outside(F.col("attempt_index"), 0, 4),
        "position": steps.isNotNull() & outside(F.col("topology_position"), F.lit(0), steps),
        "role": role.isNotNull() & ~role.eqNullSafe(F.col("role_name")),
        "status": F.coalesce(~F.col("status").isin(*STATUSES), F.lit(True)),
        "latency": F.col("latency_ms") < 0,
        "tokens": negative,
        "token_sum": both.isNotNull() & ~both.eqNullSafe(F.col("total_tokens")),
        "cost": F.col("estimated_cost_usd") < 0,
        "backoff": F.col("backoff_seconds").isNull() | (F.col("backoff_seconds") < 0),
        "timestamp": F.coalesce(F.try_to_timestamp("timestamp_utc").isNull(), F.lit(True)),
        "offset": utc_state(F.col("timestamp_utc")) == "wrong_offset",
        "raw_output": F.col("raw_output").isNull() & (F.col("status") == "success"),
        "failure_type": F.col("failure_type").isNull() & (F.col("parsed_answer") == "INVALID"),
    }


def event_violations(events: DataFrame) -> DataFrame:
    """(call_id, attempt_index, violations) of the attempts that break a rule of event_rules in their latest delivery.

    Rules are judged before deliveries are brought together, so texts are not shuffled.
    """
    judged = events.select(*ATTEMPT, "ingested_at", broken_rules(event_rules()).alias("violations"))
    return latest_attempts(judged, ["violations"]).filter("violations <> ''")


def usage_rules() -> dict[str, Column]:
    """What is wrong with a call's token counts, by rule; unknown counts break none."""
    counts = ("input_tokens", "output_tokens", "reasoning_tokens", "cached_input_tokens")
    negative = F.lit(False)
    for field in counts:
        negative = negative | F.coalesce(F.col(field) < 0, F.lit(False))
    return {
        "negative": negative,
        "method": blank(F.col("token_accounting_method")),
        "reasoning_over_output": F.col("reasoning_tokens") > F.col("output_tokens"),
        "cached_over_input": F.col("cached_input_tokens") > F.col("input_tokens"),
    }


def usage_violations(calls: DataFrame) -> DataFrame:
    """(call_id, violations) of the calls whose usage breaks a rule of usage_rules; calls are one row each."""
    return calls.select("call_id", broken_rules(usage_rules()).alias("violations")).filter("violations <> ''")


def attempt_counts(attempts: DataFrame, per_call: int = 4) -> DataFrame:
    """(run_id, calls, attempts, ceiling, over): attempts of each run against per_call attempts for each of its calls."""
    per = attempts.groupBy("run_id").agg(F.count_distinct("call_id").alias("calls"), F.count("*").alias("attempts")).withColumn("ceiling", F.col("calls") * per_call)
    return per.withColumn("over", F.col("attempts") > F.col("ceiling"))


def rate_windows(attempts: DataFrame, length: str = "1 minute") -> DataFrame:
    """Starts, and tokens where known, per provider and tumbling window of event time."""
    timed = attempts.withColumn("at", F.try_to_timestamp("timestamp_utc")).filter("at is not null")
    per = timed.groupBy(F.window("at", length).alias("w"), "provider").agg(F.count("*").alias("starts"), F.sum("total_tokens").alias("tokens"))
    return per.select(F.unix_micros("w.start").alias("window_start"), "provider", "starts", "tokens")


def member_digests(rows: DataFrame, group: str, member: str) -> DataFrame:
    """Per group: distinct members, an order-free digest of them, and the SHA-256 of their sorted list.

    The list digest gathers a group's members in one row; it is meant for groups bounded by a plan, such as a run's items.
    """
    once = rows.select(group, member).dropna().distinct()
    joined = F.array_join(F.array_sort(F.collect_list(member)), "\n")
    return once.groupBy(group).agg(F.count("*").alias("members"), F.sha2(joined, 256).alias("digest"))
