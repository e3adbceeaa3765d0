"""Leakage-safe families: components over shared models and shared prompts, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyard.functions.text import sha256
from tallyard.operators.components import connected_components, key_edges


def protected_families(rows: DataFrame, keys: tuple[str, ...] = ("model_id", "prompt_hash"), node: str = "source_index") -> DataFrame:
    """(source_index, root, family): every row with the smallest index of its component; family is a hash of that index.

    All rows take part, redundant copies included; a row without relatives is a family of its own.
    """
    groups = connected_components(key_edges(rows, node, {k: F.col(k) for k in keys}))
    placed = rows.select(node).distinct().join(groups, F.col(node) == F.col("node"), "left")
    root = F.coalesce("component", node)
    return placed.select(node, root.alias("root"), sha256(F.concat(F.lit("family-v1:"), root.cast("string"))).alias("family"))


def family_summary(rows: DataFrame) -> DataFrame:
    """Per root: rows, distinct models and prompts, and the sorted lists of its rungs and answers."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",")
    return rows.groupBy("root").agg(F.count("*").alias("n"), F.count_distinct("model_id").alias("models"), F.count_distinct("prompt_hash").alias("prompts"), listed("rung").alias("rungs"), listed("label").alias("labels"))


def family_presence(rows: DataFrame, column: str) -> DataFrame:
    """(value, families): each family once per value it holds."""
    return rows.filter(F.col(column).isNotNull()).select("root", F.col(column).cast("string").alias("value")).distinct().groupBy("value").agg(F.count("*").alias("families"))


def mixed_families(rows: DataFrame) -> DataFrame:
    """One row: families, and how many hold several rungs or several labels."""
    per = rows.groupBy("root").agg((F.min("rung") != F.max("rung")).alias("r"), (F.min("label") != F.max("label")).alias("l"))
    return per.agg(F.count("*").alias("families"), F.count_if("r").alias("mixed_rungs"), F.count_if("l").alias("mixed_labels"))


def largest_families(rows: DataFrame, top: int = 10) -> DataFrame:
    """The top families by size, then smallest root, with their rank (a top-k report; the rank runs over top rows)."""
    from pyspark.sql import Window

    best = rows.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(top)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "root")))
