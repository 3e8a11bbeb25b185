"""What the operators share to run on a cluster: shared storage, bounded filters, groups that no task has to hold whole."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch; by Spark's default of 10,000 a batch of texts takes tens of MB in the JVM and again in Python.
BATCH = 2000


def bounded(docs: DataFrame) -> DataFrame:
    """The same rows; from now on their session hands Python batches of BATCH rows at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(docs.sparkSession.conf.get(key)) <= BATCH:
        docs.sparkSession.conf.set(key, str(BATCH))
    return docs


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset (one machine), a temporary one."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="wordmill-")
    atexit.register(shutil.rmtree, path, True)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def stash(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read from there: a cut of lineage that outlives executors.

    What was shuffled for them goes at once, the files when release() is told so, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    fs, there = _place(spark, path)
    fs.deleteOnExit(there)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stashed"] = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Deletes the files of rows that came from stash(); nothing may read them any more, nor a frame made of them."""
    for df in frames:
        if df is not None and (path := df.__dict__.get("_stashed")):
            fs, there = _place(df.sparkSession, path)
            fs.delete(there, True)
            fs.cancelDeleteOnExit(there)


def _place(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system and path."""
    context = spark.sparkContext
    there = context._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(context._jsc.hadoopConfiguration()), there


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each changed until no column has it, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key() -> Column:
    """64 bits of doc_id and text, by which rows of documents are found again."""
    return F.xxhash64("doc_id", "text")


def flagged(df: DataFrame, key: str, wanted: DataFrame, column: str, flag: str, how: str = "left", bits_a_key: int = 16, least: int = 1 << 18, most: int = 1 << 26) -> DataFrame:
    """The rows and a boolean `flag` that is true wherever the hash `key` is among the hashes `column` of wanted.

    It is true for few others, too, which an exact join puts right. What is broadcast is a bitmap of `bits_a_key` bits for
    each wanted hash, or `most` bits if that is less: most / 64 rows of two longs at the utmost, whatever the tables hold.
    `how` inner drops the other rows at once. `wanted` is counted, so it should be stored.
    """
    size, count = least, wanted.count()
    while size < bits_a_key * count and size < most:
        size *= 2
    slot, bits = unused(df.columns, "slot", "bits")
    place = lambda c: F.col(c).bitwiseAND(F.lit(size - 1))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), place(c).bitwiseAND(F.lit(63)).cast("int"))
    table = wanted.select(F.shiftright(place(column), 6).alias(slot), bit(column).alias(bits)).groupBy(slot).agg(F.bit_or(bits).alias(bits))
    met = df.withColumn(slot, F.shiftright(place(key), 6)).join(F.broadcast(table), slot, how)
    return met.withColumn(flag, F.coalesce(F.col(bits).bitwiseAND(bit(key)) != 0, F.lit(False))).drop(slot, bits)


def possible(df: DataFrame, key: str, wanted: DataFrame, column: str) -> DataFrame:
    """The rows whose hash `key` is among those of wanted, and few others; see flagged()."""
    (flag,) = unused(df.columns, "flag")
    return flagged(df, key, wanted, column, flag, "inner").where(flag).drop(flag)
