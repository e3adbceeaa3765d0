"""Records that differ only in format: canonical keys and an incremental ledger of how many copies each key has."""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyard.functions.text import WORD
from tallyard.runtime import cut, drop_cut, shared_dir, skew_safe_join

#: Records that one bucket holds when the ledger is begun, and buckets at most.
BUCKET_RECORDS, MAX_BUCKETS = 2_000_000, 4096
#: Writers of one bucket's rows, so that a key with very many copies is not written by one task.
SALTS = 8

#: Entry separators of a labelled list in order of preference; an entry starts with a label and a colon.
_SEPARATORS = ("[;|/]", ",", "\n")
_LABEL = "[^;|/:,\n]+:"
_BLANKS = r"[\x{9}\x{b}\x{c}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _plain(text: Column) -> Column:
    return F.concat_ws(" ", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def with_copy_key(df: DataFrame, fields: tuple[str, ...], name: str = "copy_key") -> DataFrame:
    """df with a key that records share exactly if they differ in letter case, white space, punctuation or field order only.

    Each field becomes its lower-cased words in order; a field that lists two or more labelled entries becomes
    its sorted entries, split at the separator that stands before most labels. The key is the SHA-256 of the
    sorted fields. Null fields count as empty, so records without any word share one key.
    """
    step, marks = {}, {}
    for i, field in enumerate(fields):
        spaced = F.regexp_replace(F.lower(F.coalesce(F.col(field).cast("string"), F.lit(""))), _BLANKS, " ")
        step[f"_lines{i}"] = F.regexp_replace(spaced, " ?[\n\r][ \n\r]*", "\n")
    flat = {f"_flat{i}": F.translate(f"_lines{i}", "\n", " ") for i in range(len(fields))}
    for i in range(len(fields)):
        for j, sep in enumerate(_SEPARATORS):
            text = F.col(f"_lines{i}" if sep == "\n" else f"_flat{i}")
            marks[f"_marks{i}_{j}"] = F.regexp_count(text, F.lit(f"(?:^|{sep})(?= ?{_LABEL})"))
    keys = []
    for i in range(len(fields)):
        counts = [F.col(f"_marks{i}_{j}") for j in range(len(_SEPARATORS))]
        most = F.greatest(*counts)
        text, cut_at = F.col(f"_flat{i}"), F.lit("(?!)")
        for sep, count in reversed(list(zip(_SEPARATORS, counts, strict=True))):
            here = (most >= 2) & (count == most)
            text = F.when(here, F.col(f"_lines{i}" if sep == "\n" else f"_flat{i}")).otherwise(text)
            cut_at = F.when(here, F.lit(f"{sep}(?= ?{_LABEL})")).otherwise(cut_at)
        entries = F.filter(F.transform(F.split(text, cut_at), _plain), lambda e: e != "")
        keys.append(F.concat_ws(" ; ", F.array_sort(entries)))
    key = F.sha2(F.concat_ws("\n", F.array_sort(F.array(*keys))), 256)
    return df.withColumns(step).withColumns(flat).withColumns(marks).withColumn(name, key).drop(*step, *flat, *marks)


class CopyLedger:
    """Counts of records per canonical key, kept bucketed on disk and updated batch by batch.

    entries: (copy_key, copies, first_id, bucket), one row a key; first_id is the smallest record id, the one to
    keep. members: (copy_key, record_id, bucket). A batch is joined by a full outer join with the buckets it touches
    only; the other buckets are not read. A record delivered again counts once: its (key, id) is already a member. A
    record whose text changed counts under its new key as well. Null ids are left out.

    The ledger is its folder: opening the folder again goes on where it ended. What a batch wrote counts from the
    moment its state file appears, which is made once and never changed, so a batch that fails halfway leaves the
    ledger as it was, and two writers cannot both make the same one. A batch with an id that was added before is
    passed over. The number of buckets is chosen from the first batch's records and kept.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.root = root or f"{shared_dir(spark)}/copy-ledger-{uuid.uuid4().hex}"
        self.buckets = buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def state(self) -> dict:
        """The last complete state: its number, the bucket count, batch ids, where each bucket's entries and all members lie."""
        at = self._path(f"{self.root}/state")
        names = sorted(f.getPath().getName() for f in self._files.listStatus(at)) if self._files.exists(at) else []
        done = [n for n in names if n.endswith(".json")]
        if not done:
            return {"number": 0, "buckets": self.buckets, "batches": [], "entries": {}, "members": []}
        stream = self._files.open(self._path(f"{self.root}/state/{done[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        """Write a state under the next number: to a name of its own, then renamed to one that must not exist."""
        target = self._path(f"{self.root}/state/{state['number']:09d}.json")
        temporary = self._path(f"{self.root}/state/{uuid.uuid4().hex}.tmp")
        stream = self._files.create(temporary, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        try:
            if self._files.exists(target) or not self._files.rename(temporary, target):
                raise FileExistsError(f"{target.toString()}: another batch was added meanwhile")
        finally:
            self._files.delete(temporary, False)

    def _entries_at(self, state: dict, buckets: list[int]) -> DataFrame | None:
        at: dict[str, list[int]] = {}
        for b in buckets:
            if str(b) in state["entries"]:
                at.setdefault(state["entries"][str(b)], []).append(b)
        parts = [self.spark.read.schema("copy_key string, copies bigint, first_id string, bucket int").parquet(f"{self.root}/entries/{name}").filter(F.col("bucket").isin(own)) for name, own in at.items()]
        return functools.reduce(DataFrame.unionByName, parts) if parts else None

    def _members_at(self, state: dict, buckets: list[int] | None = None) -> DataFrame | None:
        parts = [self.spark.read.schema("copy_key string, record_id string, bucket int").parquet(f"{self.root}/members/{name}") for name in state["members"]]
        parts = [p if buckets is None else p.filter(F.col("bucket").isin(buckets)) for p in parts]
        return functools.reduce(DataFrame.unionByName, parts) if parts else None

    def entries(self) -> DataFrame:
        """The ledger as it is after the batches so far."""
        state = self.state()
        found = self._entries_at(state, sorted(int(b) for b in state["entries"]))
        return found if found is not None else self.spark.createDataFrame([], "copy_key string, copies bigint, first_id string, bucket int")

    def members(self) -> DataFrame:
        """All (copy_key, record_id, bucket) seen so far."""
        found = self._members_at(self.state())
        return found if found is not None else self.spark.createDataFrame([], "copy_key string, record_id string, bucket int")

    def add(self, records: DataFrame, record_id: str, fields: tuple[str, ...], batch_id: str | None = None) -> bool:
        """Aggregate a batch and merge it into the matching buckets; False if a batch of that id was added before."""
        state = self.state()
        name = batch_id or uuid.uuid4().hex
        if name in state["batches"]:
            return False
        named = records.select(F.col(record_id).cast("string").alias("record_id"), *fields).filter("record_id is not null")
        keyed = cut(with_copy_key(named, fields).select("record_id", "copy_key").distinct())
        if not state["buckets"]:
            state["buckets"] = min(MAX_BUCKETS, 1 + keyed.count() // BUCKET_RECORDS)
        batch = keyed.withColumn("bucket", F.pmod(F.xxhash64("copy_key"), F.lit(state["buckets"])).cast("int"))
        touched = sorted(r["bucket"] for r in batch.select("bucket").distinct().collect())  # at most MAX_BUCKETS numbers
        old = self._members_at(state, touched)
        if old is not None:
            batch = batch.join(old, ["bucket", "copy_key", "record_id"], "left_anti")
        written = f"{state['number']:09d}-{uuid.uuid4().hex}"
        salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS))
        batch.repartition(F.col("bucket"), salt("record_id")).write.partitionBy("bucket").parquet(f"{self.root}/members/{written}")
        drop_cut(keyed)
        added = self.spark.read.schema("copy_key string, record_id string, bucket int").parquet(f"{self.root}/members/{written}")
        fresh = added.groupBy("bucket", "copy_key").agg(F.count("*").alias("copies"), F.min("record_id").alias("first_id"))
        before = self._entries_at(state, touched)
        if before is not None:
            a, b = fresh.alias("a"), before.alias("b")
            fresh = a.join(b, ["bucket", "copy_key"], "full_outer").select(
                "bucket",
                "copy_key",
                (F.coalesce("a.copies", F.lit(0)) + F.coalesce("b.copies", F.lit(0))).alias("copies"),
                F.least("a.first_id", "b.first_id").alias("first_id"),
            )
        fresh.repartition(F.col("bucket"), salt("copy_key")).write.partitionBy("bucket").parquet(f"{self.root}/entries/{written}")
        entries = state["entries"] | {str(b): written for b in touched}
        self._commit({"number": state["number"] + 1, "buckets": state["buckets"], "batches": [*state["batches"], name], "entries": entries, "members": [*state["members"], written]})
        return True


def format_copies(items: DataFrame, record_id: str = "item_id", fields: tuple[str, ...] = ("given_info", "question"), batches: int = 2) -> CopyLedger:
    """A ledger filled with items in the given number of batches (all rows of one id are in one batch)."""
    ledger = CopyLedger(items.sparkSession)
    slot = F.pmod(F.xxhash64(F.col(record_id).cast("string")), F.lit(batches))
    for i in range(batches):
        ledger.add(items.filter(slot == i), record_id, fields, f"slot-{i}")
    return ledger


def copy_pairs(ledger: CopyLedger) -> DataFrame:
    """(keep_id, copy_id): every record other than the first of its key, with that first one."""
    groups = ledger.entries().filter("copies > 1").select("copy_key", F.col("first_id").alias("keep_id"), "copies")
    total = groups.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("t")).head()["t"]
    members = ledger.members().select("copy_key", F.col("record_id").alias("copy_id"))
    return skew_safe_join(members, groups, ["copy_key"], "copies", total).filter("copy_id <> keep_id").select("keep_id", "copy_id")
