"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyard.llm import format_copies, leaks, near_duplicates, pairs, personal_data, samples, splits, token_ids
from tallyard.runtime import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts whose reply is no usable answer, with the kind of defect."""
    asked = ["item_id", "given_info", "question"]
    items = load(spark, sf_dir, "label_free_items").select(*asked).unionByName(load(spark, sf_dir, "canary_items").select(*asked))
    return pairs.broken_pairs(load(spark, sf_dir, "event_records"), load(spark, sf_dir, "logical_calls"), items)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that cannot be met, from the sampling operator's report."""
    made = samples.TargetSample(load(spark, sf_dir, "candidates"), load(spark, sf_dir, "sample_targets"))
    return made.report().filter("not met").select("target_id")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target with needed, available and drawn rows."""
    return samples.TargetSample(load(spark, sf_dir, "candidates"), load(spark, sf_dir, "sample_targets")).report()


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn records."""
    return samples.TargetSample(load(spark, sf_dir, "candidates"), load(spark, sf_dir, "sample_targets")).draw()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies that differ in format only, with the record to keep."""
    return format_copies.copy_pairs(format_copies.format_copies(load(spark, sf_dir, "label_free_items")))


def p3_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per canonical key with its number of copies."""
    ledger = format_copies.format_copies(load(spark, sf_dir, "label_free_items"))
    return ledger.entries().select(F.col("first_id").alias("item_id"), "copies")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related records with the smallest of their group."""
    return splits.related_pairs(load(spark, sf_dir, "candidates"))


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every record."""
    return splits.grouped_splits(load(spark, sf_dir, "candidates"), load(spark, sf_dir, "split_targets"))


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each split holds, against its target."""
    targets = load(spark, sf_dir, "split_targets")
    return splits.split_shares(splits.grouped_splits(load(spark, sf_dir, "candidates"), targets), targets)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items with small edits."""
    found = near_duplicates.near_duplicates(load(spark, sf_dir, "label_free_items"))
    return found.withColumnsRenamed({"record_id_a": "item_id_a", "record_id_b": "item_id_b"})


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with its class of equal words, that class's links and the group that small edits connect."""
    return near_duplicates.NearDuplicates(load(spark, sf_dir, "label_free_items")).groups().withColumnRenamed("record_id", "item_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return token_ids.encode_corpus(load(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage of a held-out item."""
    return leaks.leaks(leaks.leak_alignments(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items")))


def p7_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of documents with held-out items that cover most of an item, edited copies included."""
    return leaks.edited_leaks(leaks.leak_alignments(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"), share=leaks.SHARE))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in the documents."""
    return personal_data.personal_data(load(spark, sf_dir, "documents"), load(spark, sf_dir, "name_parts"))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with placeholders for personal data."""
    return personal_data.redacted(load(spark, sf_dir, "documents"), load(spark, sf_dir, "name_parts"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_report, p2_sample, p3_found, p3_ledger, p4_found, p4_splits, p4_shares, p5_found, p5_groups, p6_ids, p7_found, p7_alignments, p8_found, p8_redacted)}

_WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RELATED = " UNION ALL ".join(
    f"SELECT source_index, '{k}' AS kind, lower(trim(regexp_replace({k}, '{_WS}+', ' ', 'g'))) AS value FROM candidates" for k in splits.KEYS
)
_GRAMS = """SELECT DISTINCT {0}, array_to_string(w[i:i + 12], ' ') AS gram FROM (
  SELECT {0}, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT {0}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+') AS w FROM {1} WHERE text IS NOT NULL) WHERE len(w) >= 13)"""

ORACLES = {
    "p4_found": f"""WITH RECURSIVE keyed AS (SELECT DISTINCT * FROM ({_RELATED}) WHERE value <> '' AND value NOT IN {splits.STAND_INS}),
      firsts AS (SELECT kind, value, min(source_index) AS low FROM keyed GROUP BY ALL),
      near AS (SELECT k.source_index AS u, f.low AS v FROM keyed k JOIN firsts f USING (kind, value) UNION SELECT f.low, k.source_index FROM keyed k JOIN firsts f USING (kind, value)),
      reach(u, v) AS (SELECT u, v FROM near UNION SELECT r.u, n.v FROM reach r JOIN near n ON r.v = n.u)
      SELECT min(v) AS anchor_index, u AS source_index FROM reach GROUP BY u HAVING min(v) <> u""",
    "p7_found": f"SELECT DISTINCT d.doc_id, e.eval_id FROM ({_GRAMS.format('doc_id', 'documents')}) d JOIN ({_GRAMS.format('eval_id', 'eval_items')}) e USING (gram)",
    "p2_found": """
        WITH have AS (
          SELECT rung, lower(trim(answer, E' \\t\\r\\n')) AS answer, lower(trim(query_type, E' \\t\\r\\n')) AS query_type, count(DISTINCT source_index) AS n
          FROM candidates WHERE rung IS NOT NULL AND answer IS NOT NULL AND query_type IS NOT NULL GROUP BY 1, 2, 3)
        SELECT t.target_id FROM sample_targets t LEFT JOIN have h
          ON h.rung = t.rung AND h.answer = lower(t.answer) AND h.query_type = lower(t.query_type)
        WHERE coalesce(h.n, 0) < greatest(t.min_rows, CAST(ceil(t.target_share * t.sample_rows) AS BIGINT))""",
}
