"""Queries over attempts and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyard.functions import answers, responses
from tallyard.operators import calls, runlog
from tallyard.plans.sql import WS_SQL
from tallyard.runtime import load
from tallyard.sources import connectors

_USAGE = ("attempt_index", "run_id", "item_id", "config_id", "total_tokens", "input_tokens", "output_tokens", "reasoning_tokens", "cached_input_tokens", "token_accounting_method", "latency_ms", "normalized_list_cost_usd", "actual_charge_usd")
_ATTEMPT_COLUMNS = ["call_id", "attempt_index", "run_id", "item_id", "config_id", "provider", "role_name", "topology_position", "status", "failure_type", "timestamp_utc", "latency_ms", "input_tokens", "output_tokens", "total_tokens"]


def _attempts(spark, sf_dir):
    return runlog.latest_attempts(load(spark, sf_dir, "event_records"), _ATTEMPT_COLUMNS)


def _calls(spark, sf_dir):
    return calls.latest_calls(load(spark, sf_dir, "logical_calls"))


def _one_call(spark, sf_dir):
    return calls.latest_calls(load(spark, sf_dir, "logical_calls"), _USAGE)


def latest_attempts(spark, sf_dir):
    return _attempts(spark, sf_dir).select("call_id", "attempt_index", "status", "failure_type", "total_tokens")


def attempt_chain_check(spark, sf_dir):
    return runlog.attempt_chains(_attempts(spark, sf_dir))


def expected_vs_actual(spark, sf_dir):
    return runlog.unmatched_calls(load(spark, sf_dir, "logical_calls"), load(spark, sf_dir, "event_records"))


def pacing_violations(spark, sf_dir):
    return runlog.start_gaps(_attempts(spark, sf_dir), 1.0)


def timestamp_states(spark, sf_dir):
    return _attempts(spark, sf_dir).groupBy(runlog.utc_state(F.col("timestamp_utc")).alias("state")).agg(F.count("*").alias("n"))


def _states(spark, sf_dir):
    key = lambda position: F.concat_ws(":", "item_id", "config_id", F.col(position).cast("string"))
    expected = calls.expand_calls(load(spark, sf_dir, "label_free_items"), calls.plan_table(spark)).withColumn("call_key", key("position"))
    done = load(spark, sf_dir, "logical_calls").filter("status = 'success'").withColumn("call_key", key("topology_position"))
    return runlog.completeness(expected, done)


def resume_items(spark, sf_dir):
    return _states(spark, sf_dir)


def session_batch(spark, sf_dir):
    return runlog.next_batch(_states(spark, sf_dir), 50)


def call_expansion(spark, sf_dir):
    return calls.expand_calls(load(spark, sf_dir, "label_free_items"), calls.plan_table(spark)).select("item_id", "config_id", "position", "role", "planned_id")


def call_counts(spark, sf_dir):
    return call_expansion(spark, sf_dir).groupBy("config_id", "role").agg(F.count("*").alias("calls"))


def upstream_cards(spark, sf_dir):
    rows = calls.upstream_answers(_calls(spark, sf_dir), calls.plan_table(spark))
    return rows.select("call_id", F.array_join(F.transform("cards", lambda c: F.concat_ws("=", c["position"].cast("string"), F.coalesce(c["answer"], F.lit("?")))), ",").alias("cards"))


def render_cards(spark, sf_dir):
    return calls.render_cards(calls.upstream_answers(_calls(spark, sf_dir), calls.plan_table(spark)))


def majority_vote(spark, sf_dir):
    return calls.majority_votes(_calls(spark, sf_dir))


def final_answers(spark, sf_dir):
    return calls.final_answers(_calls(spark, sf_dir))


def retry_overhead(spark, sf_dir):
    return runlog.retry_overhead(_attempts(spark, sf_dir))


def failure_grouping_sets(spark, sf_dir):
    return runlog.failure_sets(_attempts(spark, sf_dir)).withColumn("set_id", F.col("set_id").cast("bigint"))


def usage_totals(spark, sf_dir):
    return runlog.usage_totals(_one_call(spark, sf_dir))


def latency_stats(spark, sf_dir):
    return runlog.distribution(_attempts(spark, sf_dir), "provider", "latency_ms")


def event_violations(spark, sf_dir):
    return runlog.event_violations(load(spark, sf_dir, "event_records"))


def usage_violations(spark, sf_dir):
    return runlog.usage_violations(_one_call(spark, sf_dir))


def attempt_ceilings(spark, sf_dir):
    return runlog.attempt_counts(_attempts(spark, sf_dir))


def http_taxonomy(spark, sf_dir):
    """Failures of attempts that got a status, by what the status alone means."""
    seen = runlog.latest_attempts(load(spark, sf_dir, "event_records"), ["http_status"]).filter("http_status is not null and http_status <> 200")
    return seen.groupBy("http_status", connectors.failure_class(F.col("http_status"), F.lit(None).cast("string")).alias("failure_class")).agg(F.count("*").alias("attempts"))


def rate_windows(spark, sf_dir):
    return runlog.rate_windows(_attempts(spark, sf_dir))


def item_set_digest(spark, sf_dir):
    return runlog.member_digests(load(spark, sf_dir, "event_records"), "run_id", "item_id")


def response_outcomes(spark, sf_dir):
    """What the response readers make of each call's last response, by finish reason."""
    message = F.struct(F.col("raw_output").alias("content"))
    body = F.struct(F.array(F.struct("finish_reason", message.alias("message"))).alias("choices"), F.struct(F.col("input_tokens").alias("prompt_tokens"), F.col("output_tokens").alias("completion_tokens")).alias("usage"))
    read = load(spark, sf_dir, "logical_calls").select(responses.read_response(F.to_json(body)).alias("p"))
    return read.groupBy("p.finish_reason", "p.failure").agg(F.count("*").alias("calls"), F.sum("p.input_tokens").alias("input_tokens"), F.sum(F.length("p.text")).alias("chars"))


def _parsed():
    return ["p.answer", "p.failure", F.array_join("p.trace", ",").alias("trace")]


def parse_yesno(spark, sf_dir):
    """Parsed before repeats are removed, so texts are not shuffled."""
    raw = load(spark, sf_dir, "event_records").select("call_id", "attempt_index", answers.parse_yes_no(F.col("raw_output")).alias("p"))
    return raw.select("call_id", "attempt_index", *_parsed()).distinct()


def parse_structured(spark, sf_dir):
    raw = load(spark, sf_dir, "event_records").select("raw_output").distinct()
    return raw.withColumn("p", answers.parse_structured(F.col("raw_output"))).select("raw_output", *_parsed())


QUERIES = {
    f.__name__: f
    for f in (
        latest_attempts, attempt_chain_check, expected_vs_actual, pacing_violations, timestamp_states, resume_items, session_batch, call_expansion, call_counts,
        upstream_cards, render_cards, majority_vote, final_answers, retry_overhead, failure_grouping_sets, usage_totals, latency_stats, event_violations, usage_violations, attempt_ceilings, http_taxonomy, response_outcomes,
        rate_windows, item_set_digest, parse_yesno, parse_structured,
    )
}

ATTEMPTS_SQL = "WITH attempts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY call_id, attempt_index ORDER BY ingested_at DESC) AS rn FROM event_records) WHERE rn = 1)"
_PLAN_SQL = """plan(config_id, position, role, upstream) AS (VALUES ('A1_SINGLE_V1', 0, 'analyst', CAST([] AS INTEGER[])),
    ('A3_SINGLE_V1', 0, 'analyst', []), ('A3_SINGLE_V1', 1, 'analyst', []), ('A3_SINGLE_V1', 2, 'analyst', []),
    ('A5_SINGLE_V1', 0, 'analyst', []), ('A5_SINGLE_V1', 1, 'analyst', []), ('A5_SINGLE_V1', 2, 'analyst', []), ('A5_SINGLE_V1', 3, 'analyst', []), ('A5_SINGLE_V1', 4, 'analyst', []),
    ('C3_COUNCIL_V1', 0, 'analyst', []), ('C3_COUNCIL_V1', 1, 'critic', [0]), ('C3_COUNCIL_V1', 2, 'adjudicator', [0, 1]),
    ('C5_COUNCIL_V1', 0, 'analyst', []), ('C5_COUNCIL_V1', 1, 'semantic_query_critic', [0]), ('C5_COUNCIL_V1', 2, 'graph_identification_critic', [0]),
    ('C5_COUNCIL_V1', 3, 'formal_numerical_critic', [0]), ('C5_COUNCIL_V1', 4, 'adjudicator', [0, 1, 2, 3]))"""
CALLS_SQL = "WITH one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY attempt_index DESC) AS rn FROM logical_calls) WHERE rn = 1)"
_AT = "CASE WHEN timestamp_utc IS NOT NULL THEN TRY_CAST(timestamp_utc AS TIMESTAMPTZ) END"
_STATE = f"CASE WHEN timestamp_utc IS NULL THEN NULL WHEN {_AT} IS NULL THEN 'unreadable' WHEN regexp_matches(timestamp_utc, '(Z|\\+00:00)$') THEN 'ok' ELSE 'wrong_offset' END"
_EXPANDED = f"{_PLAN_SQL}, items AS (SELECT DISTINCT item_id FROM label_free_items), expanded AS (SELECT i.item_id, p.* FROM items i CROSS JOIN plan p)"
_COMPLETE = (
    "WITH "
    + _EXPANDED
    + """, done AS (SELECT DISTINCT item_id, config_id, topology_position FROM logical_calls WHERE status = 'success'),
    states AS (SELECT e.item_id, count(*) AS expected, count(d.item_id) AS done FROM expanded e LEFT JOIN done d ON d.item_id = e.item_id AND d.config_id = e.config_id AND d.topology_position = e.position GROUP BY 1),
    named AS (SELECT *, CASE WHEN done = 0 THEN 'untouched' WHEN done < expected THEN 'partial' ELSE 'complete' END AS state FROM states)"""
)
_UPSTREAM = (
    CALLS_SQL
    + ", "
    + _PLAN_SQL
    + """, ups AS (SELECT c.call_id, u.topology_position AS position, u.role, u.parsed_answer AS answer FROM one c JOIN plan p ON p.config_id = c.config_id AND p.position = c.topology_position
      JOIN one u ON u.run_id = c.run_id AND u.item_id = c.item_id AND u.config_id = c.config_id AND list_contains(p.upstream, u.topology_position)),
    heads AS (SELECT c.call_id FROM one c JOIN plan p ON p.config_id = c.config_id AND p.position = c.topology_position WHERE len(p.upstream) > 0)"""
)
_VOTES = CALLS_SQL + """, v AS (SELECT run_id, item_id, config_id, count(*) AS votes, count(*) FILTER (WHERE parsed_answer = 'YES') AS yes, count(*) FILTER (WHERE parsed_answer IN ('YES', 'NO')) AS valid
    FROM one WHERE config_id IN ('A3_SINGLE_V1', 'A5_SINGLE_V1') GROUP BY ALL),
    vote AS (SELECT *, CASE WHEN votes % 2 = 1 AND valid = votes THEN CASE WHEN yes * 2 > votes THEN 'YES' ELSE 'NO' END END AS winner FROM v)"""
FINAL_SQL = _VOTES + """, last AS (SELECT run_id, item_id, config_id, arg_max(parsed_answer, (topology_position, call_id)) AS a FROM one WHERE config_id NOT IN ('A3_SINGLE_V1', 'A5_SINGLE_V1') GROUP BY ALL),
    finals AS (SELECT run_id, item_id, config_id, CASE WHEN a IN ('YES', 'NO') THEN a END AS final_answer FROM last UNION ALL SELECT run_id, item_id, config_id, winner FROM vote)"""
_NAMELESS = " OR ".join(f"{c} IS NULL OR trim(regexp_replace({c}, '{WS_SQL}+', ' ', 'g')) = ''" for c in ("run_id", "item_id", "split_name", "model_id", "provider", "prompt_version", "call_id", "code_version"))
_STRIP = "regexp_replace({0}, '^" + WS_SQL.replace("{", "{{").replace("}", "}}") + "+|" + WS_SQL.replace("{", "{{").replace("}", "}}") + "+$', '', 'g')"
_LINES_SQL = r"\r\n|[\n\r\x{b}\x{c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"


def _strip(x: str) -> str:
    return _STRIP.format(x)


# body: the trimmed text t without a fence, where its first line starts with ``` and its last one is ```
_OPENED = f"""l AS (SELECT *, string_split_regex(t, '{_LINES_SQL}') AS ls FROM r),
      w AS (SELECT *, coalesce(len(ls) >= 2 AND starts_with(ls[1], '```') AND {_strip("ls[-1]")} = '```', FALSE) AS fenced FROM l),
      o AS (SELECT *, CASE WHEN fenced THEN array_to_string(ls[2:len(ls) - 1], chr(10)) ELSE t END AS body FROM w)"""
_TRACE = """CASE WHEN raw IS NULL OR t = '' THEN '' ELSE concat_ws(',', CASE WHEN t <> raw THEN 'trim_surrounding_whitespace' END, CASE WHEN fenced THEN 'remove_markdown_code_fence' END,
      CASE WHEN failure IS NULL AND {0} NOT IN ('YES', 'NO') THEN 'canonicalize_label_case' END) END"""

ORACLES = {
    "latest_attempts": ATTEMPTS_SQL + " SELECT call_id, attempt_index, status, failure_type, total_tokens FROM attempts",
    "attempt_chain_check": ATTEMPTS_SQL
    + " SELECT call_id, count(*) AS attempts, min(attempt_index) AS low, max(attempt_index) AS high, arg_max(status, attempt_index) AS last_status, min(attempt_index) = 0 AND max(attempt_index) + 1 = count(*) AS contiguous FROM attempts GROUP BY 1",
    "expected_vs_actual": "SELECT DISTINCT coalesce(e.call_id, a.call_id) AS call_id, CASE WHEN e.call_id IS NULL THEN 'actual_only' ELSE 'expected_only' END AS side FROM logical_calls e FULL JOIN event_records a ON e.call_id = a.call_id WHERE e.call_id IS NULL OR a.call_id IS NULL",
    "pacing_violations": ATTEMPTS_SQL
    + f", t AS (SELECT run_id, provider, epoch_us({_AT}) AS at_us, call_id, attempt_index FROM attempts WHERE {_AT} IS NOT NULL), g AS (SELECT *, at_us - lag(at_us) OVER (PARTITION BY run_id, provider ORDER BY at_us, call_id, attempt_index) AS gap FROM t) SELECT run_id, provider, count(*) AS starts, count(*) FILTER (WHERE gap < 1000000) AS too_close FROM g GROUP BY ALL",
    "timestamp_states": ATTEMPTS_SQL + f" SELECT {_STATE} AS state, count(*) AS n FROM attempts GROUP BY 1",
    "resume_items": _COMPLETE + " SELECT * FROM named",
    "session_batch": _COMPLETE + " SELECT item_id, state FROM named WHERE state <> 'complete' ORDER BY item_id LIMIT 50",
    "call_expansion": "WITH " + _EXPANDED + " SELECT item_id, config_id, position, role, substring(sha256('call-v2:cross_split_execution_r6:locked_test:' || config_id || ':' || item_id || ':' || position), 1, 32) AS planned_id FROM expanded",
    "call_counts": "WITH " + _EXPANDED + " SELECT config_id, role, count(*) AS calls FROM expanded GROUP BY ALL",
    "upstream_cards": _UPSTREAM + " SELECT h.call_id, coalesce(string_agg(u.position || '=' || coalesce(u.answer, '?'), ',' ORDER BY u.position), '') AS cards FROM heads h LEFT JOIN ups u USING (call_id) GROUP BY 1",
    "render_cards": _UPSTREAM
    + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY position) AS i FROM ups WHERE answer IS NOT NULL AND trim(answer) <> '')
      SELECT h.call_id, coalesce(string_agg('<<CARD ' || i || ' ' || role || '>>' || chr(10) || answer || chr(10) || '<<END>>', chr(10) || chr(10) ORDER BY i), '') || chr(10) AS prompt FROM heads h LEFT JOIN numbered USING (call_id) GROUP BY 1""",
    "majority_vote": _VOTES + " SELECT * FROM vote",
    "final_answers": FINAL_SQL + " SELECT * FROM finals",
    "retry_overhead": ATTEMPTS_SQL
    + """ SELECT config_id, count(DISTINCT call_id) AS calls, count(*) AS attempts, count(*) FILTER (WHERE attempt_index > 0) AS retries, CAST(sum(total_tokens) FILTER (WHERE attempt_index > 0) AS BIGINT) AS retry_tokens,
      round(sum(latency_ms) FILTER (WHERE attempt_index > 0), 3) AS retry_latency_ms, count(*) FILTER (WHERE attempt_index > 0 AND total_tokens IS NULL) AS retries_without_tokens,
      round(count(*) FILTER (WHERE attempt_index > 0) / count(*), 6) AS retry_rate FROM attempts GROUP BY 1""",
    "failure_grouping_sets": ATTEMPTS_SQL
    + """, f AS (SELECT split_part(failure_type, '/', 1) AS layer, provider, role_name, config_id FROM attempts WHERE failure_type IS NOT NULL)
      SELECT layer, provider, role_name, config_id, grouping(layer, provider, role_name, config_id) AS set_id, count(*) AS failures FROM f GROUP BY GROUPING SETS ((layer), (provider), (role_name), (config_id), ())""",
    "usage_totals": CALLS_SQL
    + """ SELECT config_id, count(*) AS calls, count(normalized_list_cost_usd) AS priced_calls,
      round(CASE WHEN count(normalized_list_cost_usd) = count(*) THEN CAST(sum(normalized_list_cost_usd) AS DOUBLE) END, 6) AS total_cost, round(coalesce(CAST(sum(normalized_list_cost_usd) AS DOUBLE), 0.0), 6) AS subtotal_cost,
      round(count(normalized_list_cost_usd) / count(*), 6) AS call_coverage, round(coalesce(CAST(sum(total_tokens) FILTER (WHERE normalized_list_cost_usd IS NOT NULL) AS DOUBLE), 0) / nullif(sum(total_tokens), 0), 6) AS token_coverage,
      round(CASE WHEN count(actual_charge_usd) = count(*) THEN sum(actual_charge_usd) END, 6) AS actual_charge FROM one GROUP BY 1""",
    "latency_stats": ATTEMPTS_SQL
    + """ SELECT provider, count(latency_ms) AS n, round(avg(latency_ms), 6) AS mean, round(stddev_samp(latency_ms), 6) AS sd, min(latency_ms) AS low, round(quantile_cont(latency_ms, 0.25), 6) AS q1, round(quantile_cont(latency_ms, 0.5), 6) AS median,
      round(quantile_cont(latency_ms, 0.75), 6) AS q3, max(latency_ms) AS high, round(quantile_cont(latency_ms, 0.75), 6) - round(quantile_cont(latency_ms, 0.25), 6) AS iqr FROM attempts GROUP BY 1""",
    "event_violations": ATTEMPTS_SQL
    + ", "
    + _PLAN_SQL
    + f""", roles AS (SELECT config_id, position, role FROM plan UNION ALL VALUES ('C1_BOUNDARY_V1', 0, 'analyst')), steps AS (SELECT config_id, count(*) AS steps FROM roles GROUP BY 1),
      v AS (SELECT a.call_id, a.attempt_index, concat_ws(',', CASE WHEN {_NAMELESS} THEN 'blank_name' END, CASE WHEN s.config_id IS NULL THEN 'config' END,
      CASE WHEN parsed_answer IS NULL OR parsed_answer NOT IN ('YES', 'NO', 'INVALID') THEN 'parsed_answer' END, CASE WHEN final_answer NOT IN ('YES', 'NO') THEN 'final_answer' END,
      CASE WHEN attempt_index IS NULL OR attempt_index NOT BETWEEN 0 AND 3 THEN 'attempt_index' END,
      CASE WHEN s.config_id IS NOT NULL AND (topology_position IS NULL OR topology_position NOT BETWEEN 0 AND steps - 1) THEN 'position' END, CASE WHEN r.role IS DISTINCT FROM role_name AND r.role IS NOT NULL THEN 'role' END,
      CASE WHEN status IS NULL OR status NOT IN ('success', 'failure', 'method_failure', 'run_blocked', 'data_validation_failure', 'incomplete') THEN 'status' END,
      CASE WHEN latency_ms < 0 THEN 'latency' END, CASE WHEN input_tokens < 0 OR output_tokens < 0 OR total_tokens < 0 THEN 'tokens' END,
      CASE WHEN input_tokens IS NOT NULL AND output_tokens IS NOT NULL AND total_tokens IS DISTINCT FROM input_tokens + output_tokens THEN 'token_sum' END,
      CASE WHEN estimated_cost_usd < 0 THEN 'cost' END, CASE WHEN backoff_seconds IS NULL OR backoff_seconds < 0 THEN 'backoff' END,
      CASE WHEN {_AT} IS NULL THEN 'timestamp' END, CASE WHEN {_STATE} = 'wrong_offset' THEN 'offset' END,
      CASE WHEN raw_output IS NULL AND status = 'success' THEN 'raw_output' END, CASE WHEN failure_type IS NULL AND parsed_answer = 'INVALID' THEN 'failure_type' END) AS violations
      FROM attempts a LEFT JOIN steps s USING (config_id) LEFT JOIN roles r ON r.config_id = a.config_id AND r.position = a.topology_position)
      SELECT * FROM v WHERE violations <> ''""",
    "usage_violations": CALLS_SQL
    + f""", v AS (SELECT call_id, concat_ws(',', CASE WHEN input_tokens < 0 OR output_tokens < 0 OR reasoning_tokens < 0 OR cached_input_tokens < 0 THEN 'negative' END,
      CASE WHEN token_accounting_method IS NULL OR trim(regexp_replace(token_accounting_method, '{WS_SQL}+', ' ', 'g')) = '' THEN 'method' END,
      CASE WHEN reasoning_tokens > output_tokens THEN 'reasoning_over_output' END, CASE WHEN cached_input_tokens > input_tokens THEN 'cached_over_input' END) AS violations FROM one) SELECT * FROM v WHERE violations <> ''""",
    "attempt_ceilings": ATTEMPTS_SQL + " SELECT run_id, count(DISTINCT call_id) AS calls, count(*) AS attempts, 4 * count(DISTINCT call_id) AS ceiling, count(*) > 4 * count(DISTINCT call_id) AS over FROM attempts GROUP BY 1",
    "http_taxonomy": ATTEMPTS_SQL
    + """ SELECT http_status, CASE WHEN http_status IN (401, 403) THEN 'configuration/authentication' WHEN http_status = 404 THEN 'configuration/nonexistent_model' WHEN http_status = 402 THEN 'configuration/quota_exhaustion'
      WHEN http_status IN (400, 405, 409, 415, 422) THEN 'configuration/malformed_request' WHEN http_status IN (408, 504) THEN 'transport/timeout' WHEN http_status = 429 THEN 'provider/http_429'
      WHEN http_status BETWEEN 500 AND 599 THEN 'provider/http_5xx' ELSE 'provider/http_error' END AS failure_class, count(*) AS attempts FROM attempts WHERE http_status <> 200 GROUP BY 1, 2""",
    "response_outcomes": """WITH r AS (SELECT nullif(finish_reason, '') AS finish_reason, raw_output, input_tokens, CASE WHEN coalesce(input_tokens < 0, FALSE) OR coalesce(output_tokens < 0, FALSE) THEN 'response/schema_failure'
        WHEN finish_reason IN ('length', 'max_tokens') THEN 'configuration/output_cap_truncation' WHEN finish_reason IN ('content_filter', 'safety') THEN 'response/safety_refusal' WHEN raw_output IS NULL THEN 'response/schema_failure' END AS failure FROM logical_calls)
      SELECT finish_reason, failure, count(*) AS calls, CAST(sum(input_tokens) FILTER (WHERE input_tokens >= 0) AS BIGINT) AS input_tokens, CAST(sum(length(raw_output)) FILTER (WHERE failure IS NULL) AS BIGINT) AS chars FROM r GROUP BY ALL""",
    "rate_windows": ATTEMPTS_SQL + f" SELECT epoch_us({_AT}) // 60000000 * 60000000 AS window_start, provider, count(*) AS starts, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM attempts WHERE {_AT} IS NOT NULL GROUP BY 1, 2",
    "item_set_digest": "SELECT run_id, count(DISTINCT item_id) AS members, sha256(string_agg(DISTINCT item_id, chr(10) ORDER BY item_id)) AS digest FROM event_records WHERE run_id IS NOT NULL AND item_id IS NOT NULL GROUP BY 1",
    # a reply is trimmed, one fence around it removed, then its last line that is not blank must be the label
    "parse_yesno": f"""WITH r AS (SELECT call_id, attempt_index, raw_output AS raw, {_strip("raw_output")} AS t FROM event_records), {_OPENED},
      e AS (SELECT *, list_filter(list_transform(string_split_regex(body, '{_LINES_SQL}'), lambda x: {_strip("x")}), lambda x: x <> '')[-1] AS last FROM o),
      f AS (SELECT *, CASE WHEN raw IS NULL OR t = '' OR last IS NULL THEN 'response/empty_content' WHEN upper(last) NOT IN ('YES', 'NO') THEN 'invalid_label' END AS failure FROM e)
      SELECT DISTINCT call_id, attempt_index, CASE WHEN failure IS NULL THEN upper(last) ELSE 'INVALID' END AS answer, failure, {_TRACE.format("last")} AS trace FROM f""",
    # a reply is trimmed, one fence around it removed, then it must be JSON, an object, with the field, and the field a label
    "parse_structured": f"""WITH r AS (SELECT DISTINCT raw_output, raw_output AS raw, {_strip("raw_output")} AS t FROM event_records), {_OPENED},
      j AS (SELECT *, CASE WHEN json_valid(body) THEN json(body) END AS js FROM o),
      k AS (SELECT *, CASE WHEN json_type(js, '$.answer') = 'VARCHAR' THEN json_extract_string(js, '$.answer') END AS last FROM j),
      f AS (SELECT *, CASE WHEN raw IS NULL OR t = '' THEN 'response/empty_content' WHEN js IS NULL THEN 'parse_failure' WHEN json_type(js) <> 'OBJECT' OR NOT list_contains(json_keys(js), 'answer') THEN 'schema_failure'
        WHEN last IS NULL OR upper({_strip("last")}) NOT IN ('YES', 'NO') THEN 'invalid_label' END AS failure FROM k)
      SELECT raw_output, CASE WHEN failure IS NULL THEN upper({_strip("last")}) ELSE 'INVALID' END AS answer, failure, {_TRACE.format("last")} AS trace FROM f""",
}
