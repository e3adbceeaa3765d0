"""Session set-up, lineage cuts and size-checked broadcasts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most this many keys are ever treated as hot, so tables of hot keys have a proven size.
MAX_HOT_KEYS = 1000
#: Rows up to which a side that was counted beforehand may be broadcast.
MAX_BROADCAST_ROWS = 500_000
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(app: str = "tallyard", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects: UTC, AQE with skew handling, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map=base | conf).getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The parquet table of that name below sf_dir, as a file or a folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which every executor can reach.

    Where it is unset a temporary folder is set, but only on a local master; elsewhere that is an error, since no
    other machine could read it.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), f"tallyard-{os.getuid()}-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def cut(df: DataFrame, free_shuffles: bool = False) -> DataFrame:
    """df with its lineage cut by a table written in the shared folder, so that losing an executor costs no recomputation.

    Readers see the table's true size, prune its columns and push filters into it. Tables lie under
    tallyard-<application id> in the shared folder until drop_cut or drop_all_cuts removes them. With free_shuffles
    the files that the write shuffled through are removed with its end, not when the driver collects its garbage.
    """
    spark = df.sparkSession
    where = f"{_cuts(spark)}/{uuid.uuid4().hex}"
    if free_shuffles:
        before = spark.conf.get(_FREE_SHUFFLES, "false")
        spark.conf.set(_FREE_SHUFFLES, "true")
        try:
            df.select("*").write.parquet(where)  # a Dataset keeps the setting it was made under
        finally:
            spark.conf.set(_FREE_SHUFFLES, before)
    else:
        df.write.parquet(where)
    table = spark.read.schema(df.schema).parquet(where)
    table._cut_at = where
    return table


def _cuts(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tallyard-{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder through the file system that its path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def drop_cut(table: DataFrame) -> None:
    """Remove the table behind a result of cut that nothing will read again."""
    remove(table.sparkSession, table._cut_at)


def drop_all_cuts(spark: SparkSession) -> None:
    """Remove all tables that cut has left behind; results that read them can't be read any more."""
    remove(spark, _cuts(spark))


def small_side(df: DataFrame, rows: int, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows are within limit; otherwise unmarked, so that the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def hot_limit(total: int) -> int:
    """Rows of one key, of total rows, beyond which the key is hot; at most MAX_HOT_KEYS keys can be."""
    return max(total // MAX_HOT_KEYS, 1000)


def skew_safe_join(big: DataFrame, small: DataFrame, on: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join big with small, which has one row per key and in weight the number of big's rows with that key.

    Keys that hold more than total / MAX_HOT_KEYS rows (so at most MAX_HOT_KEYS of them) are read to the driver and
    joined by a broadcast of just those; the rest by a plain join. No task gets a hot key's rows. Without hot keys
    the plan is the plain join. small should be cheap to read, such as a result of cut. The weight column is
    dropped. how is inner or left.
    """
    limit = hot_limit(total)
    found = small.filter(F.col(weight) > limit).drop(weight)
    hot = found.limit(MAX_HOT_KEYS + 1).collect()
    if len(hot) > MAX_HOT_KEYS:
        raise ValueError(f"weights of {', '.join(on)} sum to more than {total}")
    cold = small.filter(F.col(weight) <= limit).drop(weight) if hot else small.drop(weight)
    if not hot:
        return big.join(cold, on, how)
    few = F.broadcast(big.sparkSession.createDataFrame(hot, found.schema))
    return big.join(few, on).unionByName(big.join(few.select(*on), on, "left_anti").join(cold, on, how))


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as DOUBLE, null where the denominator is zero or null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))
