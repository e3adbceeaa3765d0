"""Pieces of SQL that several oracles share."""

from __future__ import annotations

WS_SQL = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def norm(column: str) -> str:
    """Collapsed, trimmed and lower-cased; null as empty."""
    return f"coalesce(lower(trim(regexp_replace({column}, '{WS_SQL}+', ' ', 'g'))), '')"


FLAT = "WITH flat AS (SELECT source_index, question_id, desc_id, given_info, question, answer, meta.query_type AS query_type, meta.rung AS rung, meta.story_id AS story_id, meta.graph_id AS graph_id, meta.model_id AS model_id, meta.groundtruth AS groundtruth FROM source_items)"
KEYED = (
    FLAT
    + """, known AS (SELECT model_id, min(background) AS low, max(background) AS high FROM causal_models WHERE model_id IS NOT NULL GROUP BY 1),
    joined AS (SELECT f.*, CASE WHEN k.low = k.high THEN k.low END AS background,
      CASE WHEN k.model_id IS NULL THEN 'missing' WHEN k.low <> k.high THEN 'conflicting' WHEN k.low IS NULL THEN 'empty' ELSE 'found' END AS background_state
      FROM flat f LEFT JOIN known k USING (model_id)),
    keyed AS (SELECT *, sha256("""
    + f"{norm('background')} || chr(10) || {norm('given_info')} || chr(10) || {norm('question')}) AS prompt_hash, sha256({norm('given_info')} || chr(10) || {norm('question')}) AS question_hash FROM joined)"
)
