"""Queries that score finished runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyard.operators import calls, scoring
from tallyard.plans.runlog import FINAL_SQL, _calls, _one_call
from tallyard.plans.sql import WS_SQL
from tallyard.runtime import load


def _gold(spark, sf_dir):
    return scoring.gold_labels(load(spark, sf_dir, "label_free_items"), load(spark, sf_dir, "source_items"))


def _judged(spark, sf_dir):
    return scoring.judged(calls.final_answers(_calls(spark, sf_dir)), _gold(spark, sf_dir))


def gold_labels(spark, sf_dir):
    return _gold(spark, sf_dir).select("item_id", "gold", "rung", "query_type")


def _runs(spark, sf_dir):
    return scoring.planned_runs(load(spark, sf_dir, "logical_calls"))


def score_summary(spark, sf_dir):
    return scoring.scores(_judged(spark, sf_dir), _runs(spark, sf_dir), _gold(spark, sf_dir))


def run_scores(spark, sf_dir):
    return scoring.scores(_judged(spark, sf_dir), _runs(spark, sf_dir), _gold(spark, sf_dir), ("run_id", "config_id"))


def unknown_predictions(spark, sf_dir):
    return scoring.unknown_predictions(calls.final_answers(_calls(spark, sf_dir)), _gold(spark, sf_dir))


def subgroup_accuracy(spark, sf_dir):
    return scoring.subgroup_scores(_judged(spark, sf_dir), _runs(spark, sf_dir), _gold(spark, sf_dir))


def quarantine_denominator(spark, sf_dir):
    bad = load(spark, sf_dir, "event_records").filter("status = 'run_blocked'")
    return scoring.scores(scoring.quarantined(_judged(spark, sf_dir), bad), _runs(spark, sf_dir), scoring.quarantined(_gold(spark, sf_dir), bad))


def paired_differences(spark, sf_dir):
    return scoring.paired(_judged(spark, sf_dir), _runs(spark, sf_dir), _gold(spark, sf_dir))


def mcnemar(spark, sf_dir):
    return scoring.mcnemar(paired_differences(spark, sf_dir))


def bh_adjust(spark, sf_dir):
    return scoring.benjamini_hochberg(mcnemar(spark, sf_dir))


def bootstrap_ci(spark, sf_dir):
    return scoring.bootstrap_differences(paired_differences(spark, sf_dir))


def _costs(spark, sf_dir):
    return scoring.method_costs(_one_call(spark, sf_dir))


def efficiency_gains(spark, sf_dir):
    return scoring.efficiency_gains(paired_differences(spark, sf_dir), _costs(spark, sf_dir))


def method_report(spark, sf_dir):
    return scoring.method_report(score_summary(spark, sf_dir), _costs(spark, sf_dir))


def _efficiency(spark, sf_dir):
    usage = _one_call(spark, sf_dir).groupBy("config_id").agg(F.sum("total_tokens").alias("tokens"), F.round(F.sum("latency_ms"), 3).alias("latency"))
    return scoring.efficiency(score_summary(spark, sf_dir), usage)


def efficiency_ratios(spark, sf_dir):
    return _efficiency(spark, sf_dir)


def pareto_front(spark, sf_dir):
    return scoring.pareto_front(_efficiency(spark, sf_dir))


def effect_bands(spark, sf_dir):
    return scoring.effect_bands(paired_differences(spark, sf_dir))


def council_transitions(spark, sf_dir):
    return scoring.council_transitions(_calls(spark, sf_dir), _gold(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        gold_labels, score_summary, run_scores, efficiency_gains, method_report, unknown_predictions, subgroup_accuracy, quarantine_denominator, paired_differences, mcnemar, bh_adjust, bootstrap_ci,
        efficiency_ratios, pareto_front, effect_bands, council_transitions,
    )
}


def _plain(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS_SQL}+', ' ', 'g'))"


_GOLD = f""", known AS (SELECT given_info, question, upper({_plain("answer")}) AS label, meta.rung AS rung, lower({_plain("meta.query_type")}) AS query_type, lower({_plain("meta.graph_id")}) AS graph_id, lower({_plain("meta.story_id")}) AS story_id FROM source_items),
  g AS (SELECT item_id, min(label) AS low, max(label) AS high, min(rung) AS rung, min(query_type) AS query_type, min(graph_id) AS graph_id, min(story_id) AS story_id FROM (SELECT DISTINCT item_id, given_info, question FROM label_free_items) JOIN known USING (given_info, question) WHERE label IN ('YES', 'NO') GROUP BY 1),
  gold AS (SELECT item_id, low AS gold, rung, query_type, graph_id, story_id FROM g WHERE low = high)"""
# every run and method that has a call owes an answer to every item with gold: gold left join predictions
_UNITS = (
    FINAL_SQL
    + _GOLD
    + """, runs AS (SELECT DISTINCT run_id, config_id FROM logical_calls WHERE run_id IS NOT NULL AND config_id IS NOT NULL),
  judged AS (SELECT r.run_id, r.config_id, gold.*, f.final_answer, coalesce(f.final_answer = gold.gold, FALSE) AS correct, f.final_answer IS NOT NULL AS answered
    FROM runs r CROSS JOIN gold LEFT JOIN finals f ON f.run_id = r.run_id AND f.config_id = r.config_id AND f.item_id = gold.item_id)"""
)
_SCORE = """ SELECT {1}, count(*) AS units, count(*) FILTER (WHERE answered) AS answered, count(*) FILTER (WHERE correct) AS correct, round(count(*) FILTER (WHERE correct) / count(*), 6) AS accuracy,
  round(count(*) FILTER (WHERE answered) / count(*), 6) AS completion, round(count(*) FILTER (WHERE NOT answered) / count(*), 6) AS invalid_rate FROM {0} GROUP BY ALL"""
_TESTS = """tests(first, second) AS (VALUES ('A1_SINGLE_V1', 'A3_SINGLE_V1'), ('A1_SINGLE_V1', 'A5_SINGLE_V1'), ('A1_SINGLE_V1', 'C3_COUNCIL_V1'), ('A1_SINGLE_V1', 'C5_COUNCIL_V1'),
  ('A3_SINGLE_V1', 'C3_COUNCIL_V1'), ('A5_SINGLE_V1', 'C5_COUNCIL_V1'), ('A3_SINGLE_V1', 'A5_SINGLE_V1'), ('C3_COUNCIL_V1', 'C5_COUNCIL_V1'))"""
_PAIRED = (
    _UNITS
    + ", "
    + _TESTS
    + """, sides AS (SELECT t.*, x.correct AS x, y.correct AS y FROM tests t JOIN judged x ON x.config_id = t.first JOIN judged y ON y.config_id = t.second AND y.run_id = x.run_id AND y.item_id = x.item_id),
    paired AS (SELECT first, second, count(*) AS units, count(*) FILTER (WHERE x AND y) AS both, count(*) FILTER (WHERE x AND NOT y) AS only_first, count(*) FILTER (WHERE NOT x AND y) AS only_second, count(*) FILTER (WHERE NOT x AND NOT y) AS neither,
      round((count(*) FILTER (WHERE NOT x AND y) - count(*) FILTER (WHERE x AND NOT y)) / count(*), 6) AS difference FROM sides GROUP BY ALL)"""
)
_MCNEMAR = (
    _PAIRED
    + """, tails AS (SELECT first, second, sum(exp(lgamma(only_first + only_second + 1) - lgamma(k + 1) - lgamma(only_first + only_second - k + 1) - (only_first + only_second) * ln(2))) AS tail
      FROM paired, unnest(range(0, least(only_first, only_second) + 1)) AS r(k) GROUP BY ALL),
    mc AS (SELECT first, second, only_first, only_second, round(least(1.0, 2 * tail), 6) AS p_value, round(pow(greatest(abs(only_first - only_second) - 1, 0), 2) / nullif(only_first + only_second, 0), 6) AS statistic FROM paired JOIN tails USING (first, second))"""
)
_SCORED = _UNITS + ", score AS (" + _SCORE.format("judged", "config_id") + ")"
_EFFICIENCY = (
    _SCORED
    + """, usage AS (SELECT config_id, CAST(sum(total_tokens) AS BIGINT) AS tokens, round(sum(latency_ms), 3) AS latency FROM one GROUP BY 1),
    eff AS (SELECT config_id, accuracy, invalid_rate, tokens, latency, round(tokens / nullif(correct, 0), 6) AS tokens_per_correct, round(latency / nullif(correct, 0), 6) AS latency_per_correct FROM score JOIN usage USING (config_id))"""
)
_COSTS = """, costs AS (SELECT config_id, count(*) AS calls, count(DISTINCT (run_id, item_id)) AS call_units, sum(total_tokens) AS tokens, round(sum(latency_ms), 3) AS latency, round(CAST(sum(normalized_list_cost_usd) AS DOUBLE), 8) AS cost FROM one GROUP BY 1)"""

ORACLES = {
    "gold_labels": "WITH " + _GOLD[2:] + " SELECT item_id, gold, rung, query_type FROM gold",
    "score_summary": _UNITS + _SCORE.format("judged", "config_id"),
    "run_scores": _UNITS + _SCORE.format("judged", "run_id, config_id"),
    "unknown_predictions": FINAL_SQL + _GOLD + " SELECT DISTINCT item_id FROM finals WHERE item_id NOT IN (SELECT item_id FROM gold)",
    "subgroup_accuracy": _UNITS
    + """, cells AS (SELECT config_id, 'all' AS dimension, CAST(NULL AS VARCHAR) AS value, correct FROM judged UNION ALL SELECT config_id, 'rung', CAST(rung AS VARCHAR), correct FROM judged UNION ALL SELECT config_id, 'query_type', query_type, correct FROM judged
      UNION ALL SELECT config_id, 'graph_id', graph_id, correct FROM judged UNION ALL SELECT config_id, 'story_id', story_id, correct FROM judged)
      SELECT config_id, dimension, value, count(*) AS units, count(*) FILTER (WHERE correct) AS correct, round(count(*) FILTER (WHERE correct) / count(*), 6) AS accuracy, count(*) < 20 AS small_cell FROM cells GROUP BY ALL""",
    "quarantine_denominator": _UNITS + ", kept AS (SELECT * FROM judged WHERE item_id NOT IN (SELECT item_id FROM event_records WHERE status = 'run_blocked' AND item_id IS NOT NULL))" + _SCORE.format("kept", "config_id"),
    "efficiency_gains": _PAIRED
    + _COSTS
    + """, d AS (SELECT p.*, b.tokens / b.call_units - a.tokens / a.call_units AS dt, b.calls / b.call_units - a.calls / a.call_units AS dc, b.cost / b.call_units - a.cost / a.call_units AS du
      FROM paired p JOIN costs a ON a.config_id = p.first JOIN costs b ON b.config_id = p.second)
      SELECT first, second, round(difference * 100, 4) AS points, round(difference * 100 / CASE WHEN dt / 1000 > 0 THEN dt / 1000 END, 6) AS per_1k_tokens, round(difference * 100 / CASE WHEN dc > 0 THEN dc END, 6) AS per_call,
      round(difference * 100 / CASE WHEN du * 100 > 0 THEN du * 100 END, 6) AS per_cent FROM d""",
    "method_report": _SCORED
    + _COSTS
    + """ SELECT s.config_id, s.units, round(c.calls / c.call_units, 6) AS calls_per_unit, s.accuracy, round(s.accuracy - base.accuracy, 6) AS vs_baseline, round(s.accuracy - alike.accuracy, 6) AS vs_matched, s.completion, s.invalid_rate,
      round(c.latency / c.call_units, 6) AS mean_latency, round(c.tokens / c.call_units, 6) AS mean_tokens, c.cost, round(c.cost / nullif(s.correct, 0), 6) AS cost_per_correct
      FROM score s LEFT JOIN costs c USING (config_id) LEFT JOIN score base ON base.config_id = 'A1_SINGLE_V1'
      LEFT JOIN score alike ON (s.config_id = 'C3_COUNCIL_V1' AND alike.config_id = 'A3_SINGLE_V1') OR (s.config_id = 'C5_COUNCIL_V1' AND alike.config_id = 'A5_SINGLE_V1')""",
    "paired_differences": _PAIRED + " SELECT * FROM paired",
    "mcnemar": _MCNEMAR + " SELECT * FROM mc",
    "bh_adjust": _MCNEMAR
    + """, ranked AS (SELECT *, row_number() OVER (ORDER BY p_value, first, second) AS place, count(*) OVER () AS m FROM mc),
      adj AS (SELECT *, round(least(1.0, min(p_value * m / place) OVER (ORDER BY place DESC ROWS UNBOUNDED PRECEDING)), 6) AS adjusted FROM ranked) SELECT first, second, p_value, place, adjusted, adjusted <= 0.05 AS significant FROM adj""",
    "efficiency_ratios": _EFFICIENCY + " SELECT * FROM eff",
    "pareto_front": _EFFICIENCY
    + """ SELECT config_id FROM eff a WHERE NOT EXISTS (SELECT 1 FROM eff b WHERE b.accuracy >= a.accuracy AND b.tokens <= a.tokens AND b.latency <= a.latency AND b.invalid_rate <= a.invalid_rate
      AND (b.accuracy > a.accuracy OR b.tokens < a.tokens OR b.latency < a.latency OR b.invalid_rate < a.invalid_rate))""",
    "effect_bands": _PAIRED + " SELECT first, second, difference, CASE WHEN abs(difference) >= 0.03 THEN 'relevant' WHEN abs(difference) >= 0.02 THEN 'borderline' ELSE 'negligible' END AS band FROM paired",
    "council_transitions": FINAL_SQL
    + _GOLD
    + """, u AS (SELECT run_id, item_id, config_id, arg_min(parsed_answer, topology_position) AS a, arg_max(parsed_answer, topology_position) AS z, list(parsed_answer) FILTER (WHERE contains(role, 'critic') AND parsed_answer IS NOT NULL) AS critics FROM one WHERE config_id LIKE 'C%' GROUP BY ALL)
      SELECT config_id, count(*) AS units, CAST(sum(coalesce(len(list_filter(critics, lambda x: x <> a)), 0)) AS BIGINT) AS disagreements, count(*) FILTER (WHERE a <> z) AS flips, count(*) FILTER (WHERE a <> gold AND z = gold) AS corrections, count(*) FILTER (WHERE a = gold AND z <> gold) AS harms
      FROM u JOIN gold USING (item_id) GROUP BY 1""",
}
