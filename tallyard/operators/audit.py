"""Audits of a raw item collection: field quality, value counts, duplicate groups, consistency, canonical members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyard.functions.text import blank, collapse, normalise, sha256

#: Fields of an item and how to reach them; dotted names go into the meta struct.
FIELDS = ("source_index", "question_id", "desc_id", "given_info", "question", "answer", "meta.query_type", "meta.rung", "meta.story_id", "meta.graph_id", "meta.model_id", "meta.groundtruth")
CONSISTENT = ("answer", "rung", "query_type", "graph_id", "story_id")


def flat_items(items: DataFrame) -> DataFrame:
    """Items with the meta fields as plain columns."""
    return items.select("source_index", "question_id", "desc_id", "given_info", "question", "answer", *[F.col(f"meta.{c}").alias(c) for c in ("query_type", "rung", "story_id", "graph_id", "model_id", "groundtruth")])


def model_backgrounds(models: DataFrame) -> DataFrame:
    """One row per model id: its background, or null and conflicting = true where its rows disagree; null backgrounds are no disagreement."""
    grouped = models.filter("model_id is not null").groupBy("model_id").agg(F.min("background").alias("low"), F.max("background").alias("high"))
    return grouped.select("model_id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("background"), F.coalesce(F.col("low") != F.col("high"), F.lit(False)).alias("conflicting"))


def attach_background(items: DataFrame, models: DataFrame) -> DataFrame:
    """Items with background and background_state: found, empty, conflicting or missing. Every item comes out once."""
    state = F.when(F.col("conflicting").isNull(), "missing").when(F.col("conflicting"), "conflicting").when(F.col("background").isNull(), "empty").otherwise("found")
    return items.join(model_backgrounds(models), "model_id", "left").withColumn("background_state", state).drop("conflicting")


def unresolved_models(items: DataFrame, models: DataFrame) -> DataFrame:
    """(model_id, items) of the model ids that items use and models lack."""
    return items.filter("model_id is not null").join(models.select("model_id"), "model_id", "left_anti").groupBy("model_id").agg(F.count("*").alias("items"))


def prompt_hashes(items: DataFrame) -> DataFrame:
    """Items with prompt_hash over background, given_info and question and question_hash over the latter two."""
    return items.withColumn("prompt_hash", sha256(normalise(F.col("background"), F.col("given_info"), F.col("question")))).withColumn("question_hash", sha256(normalise(F.col("given_info"), F.col("question"))))


def _valid(field: str) -> Column:
    name = field.split(".")[-1]
    value = F.col(field)
    rules = {
        "answer": F.lower(collapse(value)).isin("yes", "no"),
        "rung": value.isin(1, 2, 3),
        "groundtruth": F.try_parse_json(value).isNotNull(),
        "source_index": value >= 0,
        "question_id": value >= 0,
    }
    return rules[name] if name in rules else ~blank(value.cast("string"))


def field_quality(items: DataFrame) -> DataFrame:
    """(field, missing, invalid, rows) per field: missing is null or blank, invalid is present but against its rule. One pass."""
    measures = []
    for f in FIELDS:
        gone = blank(F.col(f).cast("string"))
        measures += [F.count_if(gone), F.count_if(~gone & ~F.coalesce(_valid(f), F.lit(False)))]
    row = items.agg(F.count("*").alias("rows"), *[m.alias(f"m{i}") for i, m in enumerate(measures)])
    parts = F.array(*[F.struct(F.lit(f.split(".")[-1]).alias("field"), F.col(f"m{2 * i}").alias("missing"), F.col(f"m{2 * i + 1}").alias("invalid"), "rows") for i, f in enumerate(FIELDS)])
    return row.select(F.inline(parts))


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(attribute, value, n) of every non-missing value of each column, in one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.inline(pairs)).filter(~blank(F.col("value"))).groupBy("attribute", "value").agg(F.count("*").alias("n"))


def folded_counts(rows: DataFrame, column: str) -> DataFrame:
    """(value, n) with case and outer white space ignored; missing values are left out."""
    return rows.filter(~blank(F.col(column))).groupBy(F.lower(collapse(F.col(column))).alias("value")).agg(F.count("*").alias("n"))


def cell_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per combination of the columns; rows that miss one of them are left out."""
    kept = rows
    for c in columns:
        kept = kept.filter(~blank(F.col(c).cast("string")))
    return kept.groupBy(*columns).agg(F.count("*").alias("n"))


def histogram(counts: DataFrame, column: str = "n") -> DataFrame:
    """How many groups have each size."""
    return counts.groupBy(F.col(column).alias("size")).agg(F.count("*").alias("groups"))


def size_stats(counts: DataFrame, column: str = "n") -> DataFrame:
    """groups, smallest, median (interpolated), nearest-rank 95 % and largest size, over the histogram of sizes."""
    return counts.agg(
        F.count("*").alias("groups"),
        F.min(column).alias("smallest"),
        F.median(column).alias("median"),
        F.expr(f"percentile_disc(0.95) within group (order by {column})").cast("bigint").alias("p95"),
        F.max(column).alias("largest"),
    )


def duplicate_groups(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, redundant) of the keys that more than one row has."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").withColumn("redundant", F.col("n") - 1)


def _differs(field: str) -> Column:
    """Whether a group's rows disagree on a field: its smallest and largest value differ, or some but not all are null."""
    return F.coalesce((F.min(field) != F.max(field)) | ((F.count(field) > 0) & (F.count(field) < F.count("*"))), F.lit(False))


def group_consistency(rows: DataFrame, key: str, fields: tuple[str, ...] = CONSISTENT) -> DataFrame:
    """Per key with several rows, whether its rows disagree on each field (null counts as a value), on any, and whether several models use it."""
    grouped = rows.groupBy(key).agg(
        F.count("*").alias("n"),
        *[_differs(f).alias(f"{f}_differs") for f in fields],
        F.coalesce(F.min("model_id") != F.max("model_id"), F.lit(False)).alias("several_models"),
    )
    some = F.lit(False)
    for f in fields:
        some = some | F.col(f"{f}_differs")
    return grouped.filter("n > 1").withColumn("inconsistent", some)


def canonical_members(rows: DataFrame, key: str, fields: tuple[str, ...] = CONSISTENT) -> DataFrame:
    """(key, source_index, n): the row with the smallest numeric question id, then the smallest index, for each key.

    A key whose rows disagree on one of the fields has no canonical row and is left out, all its rows with it; the
    quarantine is decided in the same aggregate.
    """
    order = F.struct(F.coalesce(F.expr("try_cast(question_id as bigint)"), F.lit((1 << 63) - 1)).alias("q"), F.col("source_index").alias("i"))
    found = rows.groupBy(key).agg(F.min(order).alias("first"), F.count("*").alias("n"), *[_differs(f).alias(f"_{i}") for i, f in enumerate(fields)])
    for i in range(len(fields)):
        found = found.filter(~F.col(f"_{i}"))
    return found.select(key, F.col("first.i").alias("source_index"), "n")
