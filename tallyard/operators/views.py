"""Label-free views, opaque ids, closed schemas and scans for keys, secrets and leaked labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyard.functions.text import blank, sha256

LABEL_FREE = ("item_id", "background", "given_info", "question")
# Fields that an item for inference must not have.
FORBIDDEN = (
    "answer", "label", "reasoning", "rung", "groundtruth", "ground_truth", "query_type", "graph_id", "story_id", "model_id", "question_id",
    "split", "split_name", "split_membership", "family", "protected_family", "prompt_hash", "source_index",
)
# Keys that give a label away in a prompt.
GOLD_KEYS = ("answer", "groundtruth", "query_type", "graph_id", "story_id", "model_id", "question_id", "split_name", "protected_family", "source_index", "prompt_hash")
# Keys that carry secrets.
SECRET_KEYS = ("api_key", "api_token", "authorization", "access_token", "secret", "credential", "password", "bearer")
# Forms of secret tokens.
SECRET_TOKEN = r"sk-or-v1-[A-Za-z0-9_-]{16,}|gsk_[A-Za-z0-9_-]{16,}|AIza[A-Za-z0-9_-]{20,}"
# Marks of something still to be filled in, in any place of a text.
PLACEHOLDERS = ("PLACEHOLDER", "PENDING", "TO_BE_FROZEN")
# Parts of keys that tell of scoring.
METRIC_MARKS = ("accuracy", "correct", "gold", "label", "score")


def label_free(items: DataFrame) -> DataFrame:
    """The four columns that a model may see; null texts become empty, rows without id or question are left out, repeats once."""
    kept = items.filter(~blank(F.col("item_id")) & ~blank(F.col("question")))
    return kept.select("item_id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in LABEL_FREE[1:]]).distinct()


def repeated_ids(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of the keys that several rows have."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def opaque_id(prompt_hash: Column, source_index: Column, namespace: str = "tallyard-view-v1") -> Column:
    """24 hex digits that tell nothing about the item they stand for."""
    return F.substring(sha256(F.concat_ws(":", F.lit(namespace), prompt_hash, source_index.cast("string"))), 1, 24)


def smallest_per(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key): the smallest key of each group, as a partial aggregate."""
    return rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.min(key).alias(key))


def view_checksum(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows and an order-free checksum of the columns, equal for equal multisets of rows and computed in parts."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    digest = F.conv(F.substring(sha256(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(digest), F.lit(0)).cast("decimal(38,0)").cast("string").alias("checksum"))


def schema_violations(rows: DataFrame, key: str, json: str, allowed: tuple[str, ...], required: tuple[str, ...], forbidden: tuple[str, ...] = FORBIDDEN) -> DataFrame:
    """(key, forbidden, unknown, missing, readable) of the JSON objects that hold forbidden or other unknown keys, lack required ones or cannot be read.

    A forbidden key is unknown as well unless it is allowed. The sets are sorted and joined by commas.
    """
    keys = F.json_object_keys(F.col(json))
    named = lambda c: F.array(*[F.lit(x) for x in c]).cast("array<string>")
    listed = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    made = rows.select(
        key,
        listed(F.array_intersect(keys, named(forbidden))).alias("forbidden"),
        listed(F.array_except(keys, named(allowed))).alias("unknown"),
        listed(F.array_except(named(required), keys)).alias("missing"),
        keys.isNotNull().alias("readable"),
    )
    return made.filter("forbidden <> '' or unknown <> '' or missing <> '' or not readable")


def json_keys_at_any_depth(json: Column) -> Column:
    """The distinct lower-cased object keys of a JSON text, however deep."""
    return F.array_distinct(F.transform(F.regexp_extract_all(json, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1)), F.lower))


def secret_keys(json: Column) -> Column:
    """The secret-bearing keys that a JSON text has, sorted and joined; empty if none."""
    return F.coalesce(F.array_join(F.array_sort(F.array_intersect(json_keys_at_any_depth(json), F.array(*[F.lit(k) for k in SECRET_KEYS]))), ","), F.lit(""))


def metric_keys(json: Column) -> Column:
    """The keys of a JSON text, at any depth, that tell of scoring, sorted and joined; empty if none."""
    told = F.filter(json_keys_at_any_depth(json), lambda k: k.rlike("|".join(METRIC_MARKS)))
    return F.coalesce(F.array_join(F.array_sort(told), ","), F.lit(""))


def leaks_label(text: Column) -> Column:
    """Whether a text has a gold key followed by a colon or equals sign, or a secret token."""
    return F.coalesce(text.rlike(r"(?i)\b(" + "|".join(GOLD_KEYS) + r")\b\s*[:=]") | text.rlike(SECRET_TOKEN), F.lit(False))


def has_placeholder(text: Column) -> Column:
    """Whether a text holds a mark that something is still to be filled in."""
    return F.coalesce(F.upper(text).rlike("|".join(PLACEHOLDERS)), F.lit(False))


def overlap_between(rows: DataFrame, split: str, keys: tuple[str, ...]) -> DataFrame:
    """(key_name, shared): how many values of each key occur in more than one split, in one pass."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key_name"), F.col(k).cast("string").alias("value")) for k in keys])
    values = rows.select(split, F.inline(pairs)).filter("value is not null")
    return values.groupBy("key_name", "value").agg((F.min(split) != F.max(split)).alias("x")).groupBy("key_name").agg(F.count_if("x").alias("shared"))


def quotas(rows: DataFrame, split: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows and distinct families, graphs and stories per split and cell."""
    return rows.groupBy(split, *columns).agg(F.count("*").alias("n"), F.count_distinct("family").alias("families"), F.count_distinct("graph_id").alias("graphs"), F.count_distinct("story_id").alias("stories"))


def stable_order(rows: DataFrame, index: str, seed: str = "20260905") -> DataFrame:
    """(index, rank_hash): a pseudo-random order key, the SHA-256 of a JSON array of seed, purpose and index."""
    return rows.select(index, sha256(F.concat(F.lit(f'["{seed}","candidate",'), F.col(index).cast("string"), F.lit("]"))).alias("rank_hash"))


def place_in_group(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with their place inside groups that a plan bounds."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
