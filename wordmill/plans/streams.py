"""Plans that run a stream over all there is, to its end, and give what its sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.plans.registry import query, table
from wordmill.sources.shared import fresh_dir
from wordmill.streaming import ingest, typing


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a pattern, as the file source lists folders and patterns
    return ingest.read_files(spark, f"{sf_dir}/events.parque[t]", ingest.EVENTS)


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fresh_dir(spark, "daily")
    counts = ingest.daily_counts(_stream(spark, sf_dir), "ts", ["event_type"])
    ingest.run(counts, f"{at}/log", ingest.batch_writer(f"{at}/out"), "update").awaitTermination()
    return ingest.latest(spark, f"{at}/out", ["day", "event_type"])


@query("SELECT user_id, props AS word, count(*) AS n, CAST(least(count(DISTINCT CAST(ts AS DATE)), 8) AS INT) AS n_days, bool_or(event_type = 'purchase') AS explicit FROM events GROUP BY 1, 2")
def streamed_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fresh_dir(spark, "learn")
    events = _stream(spark, sf_dir).select("user_id", F.col("props").alias("word"), F.date_diff("ts", F.lit("1970-01-01")).alias("day"), (F.col("event_type") == "purchase").alias("explicit"))
    ingest.run(ingest.learn(events), f"{at}/log", ingest.batch_writer(f"{at}/out"), "update").awaitTermination()
    return ingest.latest(spark, f"{at}/out", ["user_id", "word"])


@query()
def typing_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sessions whose snapshots grow by a turn; tests hold the machine against plain cases."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return typing.commits(rows.select(F.col("conv_id").cast("string").alias("sid"), F.col("turn").cast("double").alias("t"), "text"))
