"""Folders of evidence reports: which are accepted, why others are not, and who lacks one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What an accepted report says.
EXPECTED = {"schema_version": "1", "smoke_kind": "synthetic_non_benchmark", "status": "success", "parsed_answer": "YES", "http_status": "200", "contains_raw_output": "false"}


def _is_count(value: Column, name: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
    return F.coalesce((kind == "BIGINT") & (F.try_variant_get(value, f"$.{name}", "bigint") >= 0), F.lit(False))


def _is_measure(value: Column, name: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
    number = (kind == "BIGINT") | (kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL")
    return F.coalesce(number & (F.try_variant_get(value, f"$.{name}", "double") >= 0), F.lit(False))


def read_evidence(spark: SparkSession, folder: str, roster: DataFrame) -> DataFrame:
    """(path, provider, reason) of every JSON file in folder; reason is null for an accepted report, else the first rule it breaks.

    roster has provider and model_id, one row a provider; a provider that is not on it is unknown. Rules: unreadable,
    unknown_provider, then each expected field (wrong_<field>), requested and reported model, token counts, latency, retry list.
    """
    raw = spark.read.option("wholetext", "true").text(f"{folder}/*.json").select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    told = raw.withColumn("provider", F.try_variant_get("v", "$.provider", "string"))
    known = told.join(F.broadcast(roster.select("provider", "model_id")), "provider", "left")  # a roster is a fixed list
    value, text = F.col("v"), lambda name: F.try_variant_get(F.col("v"), f"$.{name}", "string")
    rules = [("unreadable", F.schema_of_variant(value).startswith("OBJECT")), ("unknown_provider", F.col("model_id").isNotNull())]
    rules += [(f"wrong_{name}", text(name) == expected) for name, expected in EXPECTED.items()]
    rules += [(f"wrong_{name}", text(name) == F.col("model_id")) for name in ("requested_model_id", "reported_model_id")]
    rules += [(f"wrong_{name}", _is_count(value, name)) for name in ("input_tokens", "output_tokens")]
    rules += [("wrong_latency_ms", _is_measure(value, "latency_ms"))]
    rules += [("wrong_retry_events", F.schema_of_variant(F.try_variant_get(value, "$.retry_events", "variant")).startswith("ARRAY"))]
    reason = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        reason = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(reason)
    return known.select("path", "provider", reason.alias("reason"))


def last_accepted(reports: DataFrame) -> DataFrame:
    """(provider, path): of each provider's accepted reports the last by path."""
    return reports.filter("reason is null").groupBy("provider").agg(F.max("path").alias("path"))


def missing_providers(roster: DataFrame, accepted: DataFrame) -> DataFrame:
    """(provider) of the roster's providers without an accepted report."""
    return roster.select("provider").distinct().join(accepted, "provider", "left_anti")
