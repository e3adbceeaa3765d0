"""Writers: create-only tables, idempotent files, staged swaps, journals, frozen runs and reports.

Files are reached through the Hadoop file system that their path names, so a path may lie on any store that Spark can
write to. What appears under a name is made whole under another one first and then renamed.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyard.sources.collections import file_hashes


class Store:
    """The few file operations that the writers need, on the file system of a path."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def exists(self, path: str) -> bool:
        return self._files.exists(self._path(path))

    def read(self, path: str) -> bytes:
        stream = self._files.open(self._path(path))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def create(self, path: str, data: bytes) -> None:
        """Write a file that must not exist."""
        stream = self._files.create(self._path(path), False)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def move(self, source: str, target: str) -> bool:
        """Rename source to target unless target exists; whether it was done."""
        return not self.exists(target) and self._files.rename(self._path(source), self._path(target))

    def remove(self, path: str) -> None:
        self._files.delete(self._path(path), True)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(f.getPath().getName() for f in self._files.listStatus(at)) if self._files.exists(at) else []


def create_only(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write df to a path that must not exist; the committer makes it appear whole."""
    df.write.mode("errorifexists").format(fmt).save(path)


def replace_only(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Overwrite a path that must exist."""
    if not Store(df.sparkSession, path).exists(path):
        raise FileNotFoundError(path)
    swap_in({"": df}, path, overwrite=True, fmt=fmt)


def canonical_json(value: object) -> bytes:
    """value as JSON with sorted keys, indent 2, Unicode kept and a final newline."""
    return (json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n").encode()


def write_once(spark: SparkSession, data: bytes, path: str) -> bool:
    """Write a small file that never changes: True if written, False if it is there with the same bytes, an error if it differs."""
    store = Store(spark, path)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    if not store.exists(path):
        store.create(temporary, data)
        try:
            if store.move(temporary, path):
                return True
        finally:
            store.remove(temporary)
    if hashlib.sha256(store.read(path)).digest() != hashlib.sha256(data).digest():
        raise FileExistsError(f"{path} has other content")
    return False


def swap_in(tables: dict[str, DataFrame], path: str, overwrite: bool = False, fmt: str = "json") -> None:
    """Write tables to a staging folder and move it to path as a whole; on failure path stays as it was. A table without a name is path itself."""
    spark = next(iter(tables.values())).sparkSession
    store = Store(spark, path)
    if store.exists(path) and not overwrite:
        raise FileExistsError(path)
    staging, old = f"{path}.staging-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            df.write.format(fmt).save(f"{staging}/{name}".rstrip("/"))
        if store.exists(path):
            store.move(path, old)
        if not store.move(staging, path):
            raise FileExistsError(f"{path} appeared meanwhile")
    except BaseException:
        if store.exists(old):
            store.move(old, path)
        raise
    finally:
        store.remove(staging)
        if store.exists(path):
            store.remove(old)


def append_session(spark: SparkSession, folder: str, record: dict) -> str:
    """Write a record as the next session-NNNN.json of a journal; numbers only grow."""
    store = Store(spark, folder)
    last = max((int(m.group(1)) for n in store.names(folder) if (m := re.fullmatch(r"session-(\d+)\.json", n))), default=0)
    path = f"{folder}/session-{last + 1:04d}.json"
    write_once(spark, canonical_json(record), path)
    return path


def freeze(spark: SparkSession, run_dir: str) -> DataFrame:
    """(path, length, sha256) of a run's files, written to frozen.parquet beside it; a frozen run cannot be frozen again."""
    hashes = file_hashes(spark, run_dir)
    create_only(hashes, f"{run_dir.rstrip('/')}.frozen.parquet", "parquet")
    return spark.read.parquet(f"{run_dir.rstrip('/')}.frozen.parquet")


def changed_since_freeze(spark: SparkSession, run_dir: str) -> DataFrame:
    """(path, change) of the files added, removed or altered since the freeze."""
    then = spark.read.parquet(f"{run_dir.rstrip('/')}.frozen.parquet").select("path", F.col("sha256").alias("then"))
    joined = file_hashes(spark, run_dir).select("path", F.col("sha256").alias("now")).join(then, "path", "full_outer")
    change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("then") != F.col("now"), "altered")
    return joined.select("path", change.alias("change")).filter("change is not null")


def project(df: DataFrame, columns: list[str], path: str, fmt: str = "json") -> None:
    """Write the named columns only, in this order, to a path that must not exist: what a manifest may show of its rows."""
    create_only(df.select(*columns), path, fmt)


def markdown_counts(counts: DataFrame, title: str, key: str = "value", n: str = "n", top: int = 1000) -> str:
    """A Markdown table of the top counts, by falling count, then key as text (a report)."""
    rows = counts.orderBy(F.desc(n), F.col(key).cast("string")).limit(top).collect()
    return "\n".join([f"## {title}", "", f"| {key} | {n} |", "|---|---|", *[f"| {r[key]} | {r[n]} |" for r in rows], ""])
