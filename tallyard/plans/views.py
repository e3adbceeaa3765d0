"""Queries over splits, label-free views and scans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyard import sinks
from tallyard.functions.text import collapse
from tallyard.operators import allocation, audit, views
from tallyard.plans.sql import KEYED, WS_SQL, norm
from tallyard.runtime import load, shared_dir
from tallyard.sources import collections, prompts


def stable_rank_order(spark, sf_dir):
    return views.stable_order(load(spark, sf_dir, "candidates").select("source_index").distinct(), "source_index")


def split_allocation(spark, sf_dir):
    """The fixed quotas; where a table is too small for them, the rows there are."""
    return allocation.split_allocation(load(spark, sf_dir, "candidates"), fewer=True)


def allocation_overlap(spark, sf_dir):
    return views.overlap_between(split_allocation(spark, sf_dir), "split_name", ("family", "source_index"))


def _dealt(spark, sf_dir):
    digit = F.substring("tie_rank", 1, 1)
    split = F.when(digit.isin("0"), "smoke").when(digit.isin("1", "2", "3"), "calibration").otherwise("locked_test")
    plain = lambda c: F.lower(collapse(F.col(c)))
    rows = load(spark, sf_dir, "candidates").withColumns({"label": plain("answer"), "split_name": split} | {c: plain(c) for c in ("family", "graph_id", "story_id")})
    return rows.select("source_index", "question_id", "prompt_hash", "family", "rung", "label", "graph_id", "story_id", "split_name").distinct()


def split_quota_check(spark, sf_dir):
    return views.quotas(_dealt(spark, sf_dir), "split_name", ("rung", "label"))


def split_overlap_check(spark, sf_dir):
    return views.overlap_between(_dealt(spark, sf_dir), "split_name", ("source_index", "question_id", "prompt_hash", "family"))


def label_free_view(spark, sf_dir):
    return views.label_free(load(spark, sf_dir, "label_free_items"))


def view_round_trip(spark, sf_dir):
    """The label-free view as the sinks write it and the closed reader takes it up again, from the shared folder."""
    path = f"{shared_dir(spark)}/view-{uuid.uuid4().hex}.jsonl"
    sinks.project(label_free_view(spark, sf_dir), list(views.LABEL_FREE), path)
    return collections.read_items(spark, path)


_BUNDLE = {"system_instruction": "Answer by the item alone.", "task_instruction": "Weigh the evidence.", "role_instructions": {"analyst": "You analyse."}, "output_instructions": {"single_answer": "End with YES or NO."}, "final_answer_instruction": "Decide now."}


def rendered_prompts(spark, sf_dir):
    """(item_id, problem, prompt_hash): every item's prompt of a single analyst."""
    steps = label_free_view(spark, sf_dir).withColumns({"role": F.lit("analyst"), "output_schema": prompts.output_schema(F.lit("A1_SINGLE_V1"), F.lit("analyst")), "final": F.lit(True), "cards": F.array().cast("array<string>")})
    return prompts.render_prompts(steps, _BUNDLE, "item_id").select("item_id", "problem", F.sha2("prompt", 256).alias("prompt_hash"))


def repeated_items(spark, sf_dir):
    return views.repeated_ids(load(spark, sf_dir, "label_free_items"), "item_id")


def view_checksum(spark, sf_dir):
    return views.view_checksum(label_free_view(spark, sf_dir), ["item_id"])


def opaque_ids(spark, sf_dir):
    keyed = audit.prompt_hashes(audit.attach_background(audit.flat_items(load(spark, sf_dir, "source_items")), load(spark, sf_dir, "causal_models")))
    return keyed.select("source_index", views.opaque_id(F.col("prompt_hash"), F.col("source_index")).alias("opaque_id"))


def canary_per_stratum(spark, sf_dir):
    return views.smallest_per(load(spark, sf_dir, "candidates"), "rung", "prompt_hash")


def closed_schema_violations(spark, sf_dir):
    """Replies that are no JSON object with the one key answer, with the keys that are wrong."""
    named = load(spark, sf_dir, "event_records").select(F.concat_ws("/", "call_id", F.col("attempt_index").cast("string")).alias("attempt_key"), "raw_output")
    return views.schema_violations(named, "attempt_key", "raw_output", ("answer",), ("answer",)).distinct()


def metric_key_scan(spark, sf_dir):
    """How many distinct replies have which keys that tell of scoring."""
    scanned = load(spark, sf_dir, "event_records").select("raw_output").distinct().withColumn("keys", views.metric_keys(F.col("raw_output")))
    return scanned.groupBy("keys").agg(F.count("*").alias("n"))


def secret_key_scan(spark, sf_dir):
    scanned = load(spark, sf_dir, "event_records").select("raw_output").distinct().withColumn("keys", views.secret_keys(F.col("raw_output")))
    return scanned.groupBy("keys").agg(F.count("*").alias("n"))


def leakage_scan(spark, sf_dir):
    return load(spark, sf_dir, "documents").filter(views.leaks_label(F.col("text"))).select("doc_id")


def placeholder_scan(spark, sf_dir):
    return load(spark, sf_dir, "documents").filter(views.has_placeholder(F.col("text"))).select("doc_id")


def sealed_members(spark, sf_dir):
    """Candidates whose prompt hash no item of the raw collection has."""
    keyed = audit.prompt_hashes(audit.attach_background(audit.flat_items(load(spark, sf_dir, "source_items")), load(spark, sf_dir, "causal_models")))
    mine = load(spark, sf_dir, "candidates").select("source_index", "prompt_hash").distinct()
    joined = mine.join(keyed.select("source_index", F.col("prompt_hash").alias("fresh")), "source_index", "left")
    return joined.groupBy(F.coalesce(F.col("fresh") == F.col("prompt_hash"), F.lit(False)).alias("equal")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        stable_rank_order, split_allocation, allocation_overlap, split_quota_check, split_overlap_check, label_free_view, view_round_trip, rendered_prompts, repeated_items, view_checksum, opaque_ids,
        canary_per_stratum, closed_schema_violations, metric_key_scan, secret_key_scan, leakage_scan, placeholder_scan, sealed_members,
    )
}


def _plain(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '{WS_SQL}+', ' ', 'g')))"


_DEALT = f"""WITH dealt AS (SELECT DISTINCT source_index, question_id, prompt_hash, {_plain("family")} AS family, rung, {_plain("answer")} AS label, {_plain("graph_id")} AS graph_id, {_plain("story_id")} AS story_id,
  CASE WHEN tie_rank[1] = '0' THEN 'smoke' WHEN tie_rank[1] IN ('1', '2', '3') THEN 'calibration' ELSE 'locked_test' END AS split_name FROM candidates)"""
_VIEW = f"SELECT DISTINCT item_id, coalesce(background, '') AS background, coalesce(given_info, '') AS given_info, coalesce(question, '') AS question FROM label_free_items WHERE {norm('item_id')} <> '' AND {norm('question')} <> ''"
_KEYS_SQL = "list_distinct(list_transform(regexp_extract_all(raw_output, '\"((?:[^\"\\\\]|\\\\.)*)\"\\s*:', 1), lambda x: lower(x)))"

ORACLES = {
    "stable_rank_order": "SELECT DISTINCT source_index, sha256('[\"20260905\",\"candidate\",' || source_index || ']') AS rank_hash FROM candidates",
    "split_quota_check": _DEALT + " SELECT split_name, rung, label, count(*) AS n, count(DISTINCT family) AS families, count(DISTINCT graph_id) AS graphs, count(DISTINCT story_id) AS stories FROM dealt GROUP BY ALL",
    "split_overlap_check": _DEALT
    + " "
    + " UNION ALL ".join(f"SELECT '{k}' AS key_name, count(*) FILTER (WHERE x > 1) AS shared FROM (SELECT count(DISTINCT split_name) AS x FROM dealt WHERE {k} IS NOT NULL GROUP BY {k})" for k in ("source_index", "question_id", "prompt_hash", "family")),
    "label_free_view": _VIEW,
    "view_round_trip": _VIEW,
    "rendered_prompts": f"""WITH v AS ({_VIEW}), p AS (SELECT item_id, 'Answer by the item alone.' || chr(10) || chr(10) || 'You analyse.' || chr(10) || chr(10) || 'Weigh the evidence.' || chr(10) || chr(10) || regexp_replace('CAUSAL QUESTION CONTEXT' || chr(10)
        || 'BACKGROUND' || chr(10) || background || chr(10) || chr(10) || 'GIVEN INFORMATION' || chr(10) || given_info || chr(10) || chr(10) || 'QUESTION' || chr(10) || question, '\\s+$', '') || chr(10) || chr(10) || 'End with YES or NO.' || chr(10) || chr(10) || 'Decide now.' || chr(10) AS prompt FROM v),
      q AS (SELECT *, CASE WHEN regexp_matches(prompt, '(?i)\\b(answer|groundtruth|query_type|graph_id|story_id|model_id|question_id|split_name|protected_family|source_index|prompt_hash)\\b\\s*[:=]') THEN 'leak' END AS problem FROM p)
      SELECT item_id, problem, CASE WHEN problem IS NULL THEN sha256(prompt) END AS prompt_hash FROM q""",
    "repeated_items": "SELECT item_id, count(*) AS n FROM label_free_items GROUP BY 1 HAVING count(*) > 1",
    "view_checksum": f"WITH v AS ({_VIEW}) SELECT count(*) AS rows, CAST(CAST(sum(CAST(('0x' || substring(sha256('{{\"item_id\":\"' || item_id || '\"}}'), 1, 15)) AS HUGEINT)) AS HUGEINT) AS VARCHAR) AS checksum FROM v",
    "opaque_ids": KEYED + " SELECT source_index, substring(sha256('tallyard-view-v1:' || prompt_hash || ':' || source_index), 1, 24) AS opaque_id FROM keyed",
    "canary_per_stratum": "SELECT rung, min(prompt_hash) AS prompt_hash FROM candidates WHERE rung IS NOT NULL GROUP BY 1",
    "closed_schema_violations": """WITH k AS (SELECT call_id || '/' || attempt_index AS attempt_key, CASE WHEN json_valid(raw_output) AND json_type(raw_output) = 'OBJECT' THEN json_keys(raw_output) END AS ks FROM event_records),
      v AS (SELECT attempt_key, coalesce(array_to_string(list_sort(list_filter(ks, lambda x: list_contains(['answer', 'label', 'reasoning', 'rung', 'groundtruth', 'ground_truth', 'query_type', 'graph_id', 'story_id', 'model_id', 'question_id',
        'split', 'split_name', 'split_membership', 'family', 'protected_family', 'prompt_hash', 'source_index'], x))), ','), '') AS forbidden,
        coalesce(array_to_string(list_sort(list_filter(ks, lambda x: x <> 'answer')), ','), '') AS unknown, CASE WHEN ks IS NOT NULL AND NOT list_contains(ks, 'answer') THEN 'answer' ELSE '' END AS missing, ks IS NOT NULL AS readable FROM k)
      SELECT DISTINCT * FROM v WHERE forbidden <> '' OR unknown <> '' OR missing <> '' OR NOT readable""",
    "metric_key_scan": "WITH r AS (SELECT DISTINCT raw_output FROM event_records), k AS (SELECT coalesce(array_to_string(list_sort(list_filter("
    + _KEYS_SQL
    + ", lambda x: contains(x, 'accuracy') OR contains(x, 'correct') OR contains(x, 'gold') OR contains(x, 'label') OR contains(x, 'score'))), ','), '') AS keys FROM r) SELECT keys, count(*) AS n FROM k GROUP BY 1",
    "secret_key_scan": "WITH r AS (SELECT DISTINCT raw_output FROM event_records), k AS (SELECT coalesce(array_to_string(list_sort(list_filter("
    + _KEYS_SQL
    + f", lambda x: list_contains(['api_key', 'api_token', 'authorization', 'access_token', 'secret', 'credential', 'password', 'bearer'], x))), ','), '') AS keys FROM r) SELECT keys, count(*) AS n FROM k GROUP BY 1",
    "leakage_scan": r"""SELECT doc_id FROM documents WHERE coalesce(regexp_matches(text, '(?i)\b(answer|groundtruth|query_type|graph_id|story_id|model_id|question_id|split_name|protected_family|source_index|prompt_hash)\b\s*[:=]')
      OR regexp_matches(text, 'sk-or-v1-[A-Za-z0-9_-]{16,}') OR regexp_matches(text, 'gsk_[A-Za-z0-9_-]{16,}') OR regexp_matches(text, 'AIza[A-Za-z0-9_-]{20,}'), FALSE)""",
    "placeholder_scan": "SELECT doc_id FROM documents WHERE contains(upper(text), 'PLACEHOLDER') OR contains(upper(text), 'PENDING') OR contains(upper(text), 'TO_BE_FROZEN')",
    "sealed_members": KEYED + ", mine AS (SELECT DISTINCT source_index, prompt_hash FROM candidates) SELECT coalesce(k.prompt_hash = m.prompt_hash, FALSE) AS equal, count(*) AS n FROM mine m LEFT JOIN keyed k USING (source_index) GROUP BY 1",
}
