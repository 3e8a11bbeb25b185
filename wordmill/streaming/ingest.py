"""Streams of logs and events: file sources, exactly-once sinks, daily counts, learned state, recomputed sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_files(spark: SparkSession, path: str, schema: str, kind: str = "parquet", most_files: int = 1000) -> DataFrame:
    """New files of a folder or pattern, each once; the checkpoint of a query remembers which."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).format(kind).load(path)


def run(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Starts a query that hands each micro-batch over: all that is there and then the end, or every so often (`15 seconds`)."""
    writer = stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that gives each batch its own folder: one that is run again after a failure replaces what it wrote."""
    return lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Of what batch_writer() wrote in update mode, the last row of each key."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def daily_counts(events: DataFrame, time: str, by: list[str], late: str = "2 days") -> DataFrame:
    """Rows by UTC day and columns; the watermark lets a day go from state when nothing can come for it any more."""
    stamped = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return stamped.groupBy(F.window("__t", "1 day").alias("w"), *by).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), *by, "n")


def fold_word(state: tuple | None, days: list[int], explicit: bool, most_days: int = 8) -> tuple[int, int, list[int], bool]:
    """What learn() keeps of a key, in plain Python: n, distinct days (counted up to `most_days`, in order of arrival), those days, explicit."""
    n, _, seen, was = state or (0, 0, [], False)
    seen = list(seen)
    for day in days:
        if day not in seen and len(seen) < most_days:
            seen.append(day)
    return n + len(days), len(seen), seen, bool(was or explicit)


def learn(events: DataFrame, keys: list[str] | tuple[str, ...] = ("user_id", "word"), most_days: int = 8) -> DataFrame:
    """Keyed state of a stream (keys, day int, explicit boolean): keys, n, n_days (distinct ones, up to `most_days`) and
    explicit after every batch that touches a key. Nulls count as in SQL.

    The state is that of the engine's aggregates: no key goes to Python by itself.
    """
    days = F.least(F.size(F.collect_set("day")), F.lit(most_days)).alias("n_days")
    return events.groupBy(*keys).agg(F.count("*").alias("n"), days, F.bool_or("explicit").alias("explicit"))


def recompute_changed(spark: SparkSession, log: str, key: str, analyse: Callable[[DataFrame], DataFrame], out: str) -> Callable[[DataFrame, int], None]:
    """A batch function: the sessions that a batch touches are analysed anew from the whole log and replace their old results."""

    def batch(rows: DataFrame, number: int) -> None:
        changed = rows.select(key).distinct()
        whole = rows.sparkSession.read.parquet(log).join(changed, key, "left_semi")
        analyse(whole).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return batch


def results_of_changed(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The results of the last batch that analysed each session."""
    rows = spark.read.parquet(out)
    last = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(last, [key, "batch"]).drop("batch")
