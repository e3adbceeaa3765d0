"""Readers of item collections, manifests and run artifacts."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM_SCHEMA = "question_id bigint, desc_id string, given_info string, question string, answer string, meta struct<query_type: string, rung: int, story_id: string, graph_id: string, model_id: string, groundtruth: string>"
VIEW_SCHEMA = "item_id string, background string, given_info string, question string"


class ChecksumError(ValueError):
    """A file is not the one that was expected."""


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file below path, each hashed where it is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def require_hash(spark: SparkSession, path: str, sha256: str) -> None:
    """Raise unless path is one file with that SHA-256."""
    found = [r["sha256"] for r in file_hashes(spark, path).limit(2).collect()]
    if found != [sha256]:
        raise ChecksumError(f"{path}: expected {sha256}, found {found}")


def read_zip_json(spark: SparkSession, path: str, member: str, schema: str, sha256: str | None = None) -> DataFrame:
    """The objects of a JSON list inside ZIP archives, with source_index, their place in the list.

    The archive's hash is checked first if one is given. Archives are read in parallel, one task each; a member that
    is no list of objects is an error; a field of another type than the schema's becomes null.
    """
    if sha256:
        require_hash(spark, path, sha256)
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = json.loads(zipfile.ZipFile(io.BytesIO(content)).read(member))
                if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
                    raise ValueError(f"{member} is no list of objects")
                for at in range(0, len(rows), 5000):
                    part = rows[at : at + 5000]
                    yield pd.DataFrame({"source_index": range(at, at + len(part)), "json": [json.dumps(r, ensure_ascii=False) for r in part]})

    lines = raw.mapInPandas(run, "source_index bigint, json string")
    return lines.select("source_index", F.from_json("json", schema).alias("o")).select("source_index", "o.*")


def read_items(spark: SparkSession, path: str, schema: str = VIEW_SCHEMA, closed: bool = True) -> DataFrame:
    """Items of JSON lines, of a bare JSON list, or of an object with a list named items. Closed: an unknown or missing key is an error."""
    typed = T._parse_datatype_string(schema)
    if path.endswith((".jsonl", ".ndjson")):
        lines = spark.read.text(path).select(F.col("value").alias("json")).filter(F.trim("json") != "")
    else:
        whole = spark.read.option("wholetext", "true").text(path)
        listed = F.from_json(F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", "$.items")), "array<string>", {"primitivesAsString": "true"})
        lines = whole.select(F.explode(listed).alias("json"))
    if closed:
        names = sorted(typed.names)
        keys = F.array_sort(F.json_object_keys("json"))
        same = keys == F.array(*[F.lit(n) for n in names])
        lines = lines.withColumn("json", F.when(F.coalesce(same, F.lit(False)), F.col("json")).otherwise(F.raise_error(F.concat(F.lit("unexpected keys: "), F.coalesce(F.array_join(keys, ","), F.lit("unreadable"))))))
    return lines.select(F.from_json("json", typed, {"mode": "FAILFAST"}).alias("o")).select("o.*")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, answer) of a gold file: objects with exactly these two keys, answers YES or NO, each item once; else an error."""
    gold = read_items(spark, path, "item_id string, answer string")
    wrong = gold.agg(F.count_if(F.col("item_id").isNull() | F.coalesce(~F.col("answer").isin("YES", "NO"), F.lit(True))).alias("w")).head()["w"]
    if wrong:
        raise ValueError(f"{path}: {wrong} gold records without an item or with another answer than YES or NO")
    repeated = gold.groupBy("item_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"{path}: item {repeated[0]['item_id']} is there more than once")
    return gold


def without_fields(df: DataFrame, hidden: tuple[str, ...]) -> DataFrame:
    """df without columns and struct fields of these names at any depth; scans then never read them."""

    def kept(kind: T.DataType, col):
        if isinstance(kind, T.StructType):
            return F.struct(*[kept(f.dataType, col[f.name]).alias(f.name) for f in kind.fields if f.name.lower() not in hidden])
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(col, lambda x: kept(kind.elementType, x))
        return col

    return df.select(*[kept(f.dataType, F.col(f.name)).alias(f.name) for f in df.schema.fields if f.name.lower() not in hidden])


def read_view(spark: SparkSession, path: str, sidecar: str) -> DataFrame:
    """Items of a view document whose bytes and item count match its sidecar (inference_view_sha256, item_count); else an error."""
    expected = spark.read.option("multiLine", "true").json(sidecar).select("inference_view_sha256", "item_count").head()
    require_hash(spark, path, expected["inference_view_sha256"])
    items = read_items(spark, path)
    count = items.count()
    if count != expected["item_count"]:
        raise ChecksumError(f"{path}: expected {expected['item_count']} items, found {count}")
    return items


def read_run_records(spark: SparkSession, run_dir: str, kind: str, schema: str) -> DataFrame:
    """Records of run_dir/kind/<group>/<id>.json with group and file_id from the path; stem_matches tells whether the file is named after its call_id."""
    path = F.col("_metadata.file_path")
    read = spark.read.schema(schema).option("multiLine", "true").json(f"{run_dir}/{kind}/*/*.json")
    named = read.withColumns({"group": F.regexp_extract(path, r"([^/]+)/[^/]+\.json$", 1), "file_id": F.regexp_extract(path, r"([^/]+)\.json$", 1)})
    return named.withColumn("stem_matches", F.coalesce(F.col("file_id") == F.col("call_id"), F.lit(False))) if "call_id" in named.columns else named


def unexpected_files(spark: SparkSession, root: str, allowed: str) -> DataFrame:
    """(path) of the files below root whose path below it does not match the allowed pattern."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    below = F.regexp_replace("path", f"^.*{root.rstrip('/').rsplit('/', 1)[-1]}/", "")
    return listed.select(below.alias("path")).filter(~F.col("path").rlike(f"^(?:{allowed})$"))


def tree_digest(spark: SparkSession, root: str) -> DataFrame:
    """One row: files below root and the SHA-256 over 'path NUL hex LF' in order of path components. For artifact folders."""
    hashed = file_hashes(spark, root).withColumn("below", F.regexp_replace("path", f"^.*{root.rstrip('/').rsplit('/', 1)[-1]}/", ""))
    listed = F.array_sort(F.collect_list(F.struct(F.split("below", "/").alias("parts"), "below", "sha256")))
    text = F.array_join(F.transform(listed, lambda x: F.concat(x["below"], F.lit("\0"), x["sha256"], F.lit("\n"))), "")
    return hashed.agg(F.count("*").alias("files"), F.sha2(text, 256).alias("digest"))
