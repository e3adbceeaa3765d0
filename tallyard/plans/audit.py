"""Queries over the raw item collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyard.functions.text import collapse
from tallyard.operators import audit, families
from tallyard.plans.sql import FLAT, KEYED, WS_SQL
from tallyard.runtime import load


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.flat_items(load(spark, sf_dir, "source_items"))


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.prompt_hashes(audit.attach_background(_flat(spark, sf_dir), load(spark, sf_dir, "causal_models")))


def normalize_hash(spark, sf_dir):
    return _keyed(spark, sf_dir).select("source_index", "prompt_hash", "question_hash")


def field_quality(spark, sf_dir):
    return audit.field_quality(load(spark, sf_dir, "source_items"))


def value_counts(spark, sf_dir):
    return audit.value_counts(_flat(spark, sf_dir), ["rung", "query_type", "graph_id", "story_id", "model_id"])


def answer_counts(spark, sf_dir):
    return audit.folded_counts(_flat(spark, sf_dir), "answer")


def cell_counts(spark, sf_dir):
    return audit.cell_counts(_flat(spark, sf_dir), ["graph_id", "query_type", "story_id"])


def cell_histogram(spark, sf_dir):
    return audit.histogram(cell_counts(spark, sf_dir))


def group_size_stats(spark, sf_dir):
    return audit.size_stats(_keyed(spark, sf_dir).groupBy("prompt_hash").agg(F.count("*").alias("n")))


def duplicate_groups(spark, sf_dir):
    return audit.duplicate_groups(_keyed(spark, sf_dir), "prompt_hash")


def duplicate_summary(spark, sf_dir):
    keyed = _keyed(spark, sf_dir)
    per = [audit.duplicate_groups(keyed, k).agg(F.lit(k).alias("key_name"), F.count("*").alias("groups"), F.coalesce(F.sum("redundant"), F.lit(0)).alias("redundant")) for k in ("prompt_hash", "question_hash")]
    return per[0].unionByName(per[1])


def duplicate_consistency(spark, sf_dir):
    return audit.group_consistency(_keyed(spark, sf_dir), "prompt_hash")


def canonical_items(spark, sf_dir):
    return audit.canonical_members(_keyed(spark, sf_dir), "prompt_hash")


def canonical_pool(spark, sf_dir):
    keyed = _keyed(spark, sf_dir)
    chosen = audit.canonical_members(keyed, "prompt_hash").select("source_index")
    return keyed.join(chosen, "source_index", "left_semi").groupBy("rung", F.lower(collapse(F.col("answer"))).alias("label")).agg(F.count("*").alias("n"))


def background_join(spark, sf_dir):
    return _keyed(spark, sf_dir).groupBy("background_state").agg(F.count("*").alias("n"))


def missing_models(spark, sf_dir):
    return audit.unresolved_models(_flat(spark, sf_dir), load(spark, sf_dir, "causal_models"))


def _in_families(spark, sf_dir):
    keyed = _keyed(spark, sf_dir)
    return keyed.withColumn("label", F.lower(collapse(F.col("answer")))).join(families.protected_families(keyed), "source_index")


def protected_families(spark, sf_dir):
    return families.protected_families(_keyed(spark, sf_dir))


def family_summary(spark, sf_dir):
    return families.family_summary(_in_families(spark, sf_dir))


def family_presence(spark, sf_dir):
    rows = _in_families(spark, sf_dir)
    return families.family_presence(rows, "rung").withColumn("kind", F.lit("rung")).unionByName(families.family_presence(rows, "label").withColumn("kind", F.lit("label")))


def mixed_families(spark, sf_dir):
    return families.mixed_families(_in_families(spark, sf_dir))


def top_families(spark, sf_dir):
    return families.largest_families(_in_families(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_hash, field_quality, value_counts, answer_counts, cell_counts, cell_histogram, group_size_stats, duplicate_groups, duplicate_summary,
        duplicate_consistency, canonical_items, canonical_pool, background_join, missing_models, protected_families, family_summary, family_presence,
        mixed_families, top_families,
    )
}

_FAMILY = (
    KEYED
    + """, near AS (
      SELECT a.source_index AS u, b.source_index AS v FROM keyed a JOIN keyed b ON a.model_id = b.model_id
      UNION SELECT a.source_index, b.source_index FROM keyed a JOIN keyed b ON a.prompt_hash = b.prompt_hash),
    reach(u, v) AS (
      SELECT source_index, source_index FROM keyed UNION SELECT r.u, n.v FROM reach r JOIN near n ON r.v = n.u),
    fam AS (SELECT u AS source_index, min(v) AS root FROM reach GROUP BY u),
    whole AS (SELECT k.*, f.root, lower(trim(regexp_replace(k.answer, '"""
    + WS_SQL
    + """+', ' ', 'g'))) AS label FROM keyed k JOIN fam f USING (source_index))"""
)
def _missing(c: str) -> str:
    return f"({c} IS NULL OR trim(regexp_replace(CAST({c} AS VARCHAR), '{WS_SQL}+', ' ', 'g')) = '')"



def _quality_sql() -> str:
    valid = {
        "answer": "lower(trim(regexp_replace(answer, '" + WS_SQL + "+', ' ', 'g'))) IN ('yes', 'no')",
        "rung": "rung IN (1, 2, 3)",
        "groundtruth": "json_valid(groundtruth)",
        "source_index": "source_index >= 0",
        "question_id": "question_id >= 0",
    }
    parts = []
    for f in audit.FIELDS:
        name = f.split(".")[-1]
        gone = _missing(name)
        rule = valid.get(name, "TRUE")
        parts.append(f"SELECT '{name}' AS field, count(*) FILTER (WHERE {gone}) AS missing, count(*) FILTER (WHERE NOT {gone} AND NOT coalesce({rule}, FALSE)) AS invalid, count(*) AS rows FROM flat")
    return FLAT + " " + " UNION ALL ".join(parts)


_DIFFERS = "coalesce(min({0}) <> max({0}) OR (count({0}) > 0 AND count({0}) < count(*)), FALSE)"
# a group of equal prompts has one value, or none at all, of each of these, else it is quarantined
_AGREE = " AND ".join(f"count(DISTINCT {c}) + CAST(count({c}) < count(*) AS INT) <= 1" for c in ("answer", "rung", "query_type", "graph_id", "story_id"))

ORACLES = {
    "normalize_hash": KEYED + " SELECT source_index, prompt_hash, question_hash FROM keyed",
    "field_quality": _quality_sql(),
    "value_counts": FLAT
    + " "
    + " UNION ALL ".join(f"SELECT '{c}' AS attribute, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM flat WHERE NOT {_missing(c)} GROUP BY 2" for c in ("rung", "query_type", "graph_id", "story_id", "model_id")),
    "answer_counts": FLAT + f" SELECT lower(trim(regexp_replace(answer, '{WS_SQL}+', ' ', 'g'))) AS value, count(*) AS n FROM flat WHERE NOT {_missing('answer')} GROUP BY 1",
    "cell_counts": FLAT + f" SELECT graph_id, query_type, story_id, count(*) AS n FROM flat WHERE NOT {_missing('graph_id')} AND NOT {_missing('query_type')} AND NOT {_missing('story_id')} GROUP BY ALL",
    "cell_histogram": FLAT
    + f", cells AS (SELECT count(*) AS n FROM flat WHERE NOT {_missing('graph_id')} AND NOT {_missing('query_type')} AND NOT {_missing('story_id')} GROUP BY graph_id, query_type, story_id) SELECT n AS size, count(*) AS groups FROM cells GROUP BY n",
    "group_size_stats": KEYED
    + ", g AS (SELECT count(*) AS n FROM keyed GROUP BY prompt_hash) SELECT count(*) AS groups, min(n) AS smallest, CAST(median(n) AS DOUBLE) AS median, quantile_disc(n, 0.95) AS p95, max(n) AS largest FROM g",
    "duplicate_groups": KEYED + " SELECT prompt_hash, count(*) AS n, count(*) - 1 AS redundant FROM keyed GROUP BY 1 HAVING count(*) > 1",
    "duplicate_summary": KEYED
    + """, p AS (SELECT 'prompt_hash' AS key_name, count(*) AS n FROM keyed GROUP BY prompt_hash HAVING count(*) > 1 UNION ALL SELECT 'question_hash', count(*) FROM keyed GROUP BY question_hash HAVING count(*) > 1)
      SELECT k.key_name, count(p.n) AS groups, CAST(coalesce(sum(p.n - 1), 0) AS BIGINT) AS redundant FROM (VALUES ('prompt_hash'), ('question_hash')) k(key_name) LEFT JOIN p USING (key_name) GROUP BY 1""",
    "duplicate_consistency": KEYED
    + ", g AS (SELECT prompt_hash, count(*) AS n, "
    + ", ".join(f"{_DIFFERS.format(f)} AS {f}_differs" for f in audit.CONSISTENT)
    + ", coalesce(min(model_id) <> max(model_id), FALSE) AS several_models FROM keyed GROUP BY 1 HAVING count(*) > 1) SELECT *, "
    + " OR ".join(f"{f}_differs" for f in audit.CONSISTENT)
    + " AS inconsistent FROM g",
    "canonical_items": KEYED + f" SELECT prompt_hash, first(source_index ORDER BY question_id NULLS LAST, source_index) AS source_index, count(*) AS n FROM keyed GROUP BY 1 HAVING {_AGREE}",
    "canonical_pool": KEYED
    + f", c AS (SELECT first(source_index ORDER BY question_id NULLS LAST, source_index) AS source_index FROM keyed GROUP BY prompt_hash HAVING {_AGREE}) SELECT rung, lower(trim(regexp_replace(answer, '{WS_SQL}+', ' ', 'g'))) AS label, count(*) AS n FROM keyed SEMI JOIN c USING (source_index) GROUP BY ALL",
    "background_join": KEYED + " SELECT background_state, count(*) AS n FROM keyed GROUP BY 1",
    "missing_models": FLAT + " SELECT model_id, count(*) AS items FROM flat WHERE model_id IS NOT NULL AND model_id NOT IN (SELECT model_id FROM causal_models WHERE model_id IS NOT NULL) GROUP BY 1",
    "protected_families": _FAMILY + " SELECT source_index, root, sha256('family-v1:' || root) AS family FROM fam",
    "family_summary": _FAMILY
    + """ SELECT root, count(*) AS n, count(DISTINCT model_id) AS models, count(DISTINCT prompt_hash) AS prompts,
        coalesce(array_to_string(list_sort(list(DISTINCT CAST(rung AS VARCHAR)) FILTER (WHERE rung IS NOT NULL)), ','), '') AS rungs,
        coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE label IS NOT NULL)), ','), '') AS labels FROM whole GROUP BY 1""",
    "family_presence": _FAMILY
    + " SELECT CAST(rung AS VARCHAR) AS value, count(DISTINCT root) AS families, 'rung' AS kind FROM whole WHERE rung IS NOT NULL GROUP BY 1 UNION ALL SELECT label, count(DISTINCT root), 'label' FROM whole WHERE label IS NOT NULL GROUP BY 1",
    "mixed_families": _FAMILY + ", p AS (SELECT min(rung) <> max(rung) AS r, min(label) <> max(label) AS l FROM whole GROUP BY root) SELECT count(*) AS families, count(*) FILTER (WHERE r) AS mixed_rungs, count(*) FILTER (WHERE l) AS mixed_labels FROM p",
    "top_families": _FAMILY + " SELECT root, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, root) AS place FROM whole GROUP BY root ORDER BY n DESC, root LIMIT 10",
}
for _k in ("protected_families", "family_summary", "family_presence", "mixed_families", "top_families"):
    ORACLES[_k] = ORACLES[_k].replace("WITH ", "WITH RECURSIVE ", 1)
