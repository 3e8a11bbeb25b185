"""Readers and writers of the corpora's and logs' file formats: explicit schemas, counted rejects, ordered outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmill.functions.text import escape_tsv, is_importable, is_learnable, normal_word, unescape_tsv

COLD_START = "schema string, runId string, isProcessCold boolean, isSimulator boolean, deviceModel string, osVersion string, extensionVersion string, extensionBuild string, metrics map<string, double>"
APP = "t double, sid string, kind string, text string"
PASSES = "t double, sid string, window string, field string, bar array<struct<text: string, ac: boolean, vb: boolean, rs: boolean, conf: double>>, applied struct<kind: string, text: string>, taps array<struct<c: string, dx: double, dy: double>>, backspaces int, pIS double"
PAIRS = "typo string, intended string, context array<string>, lang string, category string, expectation string, seed bigint"


def word_counts(spark: SparkSession, path: str) -> DataFrame:
    """`word count` lines, split at the last space; others are skipped; equal normal forms are summed."""
    lines = spark.read.text(path).select(F.regexp_extract("value", r"^(.*) ([0-9]+)$", 1).alias("w"), F.regexp_extract("value", r"^(.*) ([0-9]+)$", 2).alias("n"))
    return lines.where("n != ''").select(normal_word(F.col("w")).alias("word"), F.col("n").cast("long").alias("freq")).groupBy("word").agg(F.sum("freq").alias("freq"))


def pair_counts(spark: SparkSession, path: str) -> DataFrame:
    """`w1 w2 count` lines of exactly three parts."""
    parts = spark.read.text(path).select(F.split("value", " ").alias("p")).where((F.size("p") == 3) & F.get("p", F.lit(2)).rlike("^[0-9]+$"))
    return parts.select(normal_word(F.get("p", F.lit(0))).alias("w1"), normal_word(F.get("p", F.lit(1))).alias("w2"), F.get("p", F.lit(2)).cast("long").alias("n")).groupBy("w1", "w2").agg(F.sum("n").alias("freq"))


def json_counts(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object {word: count} a file, gzip or not."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,bigint>")).alias("word", "freq"))


def json_triples(spark: SparkSession, path: str) -> DataFrame:
    """One JSON list [[w1, w2, count], ...] a file."""
    row = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("r"))
    return row.where(F.size("r") == 3).select(F.get("r", F.lit(0)).alias("w1"), F.get("r", F.lit(1)).alias("w2"), F.get("r", F.lit(2)).cast("long").alias("freq"))


def morphology(spark: SparkSession, path: str, word_classes: tuple[str, ...] = ()) -> DataFrame:
    """The first six columns of the semicolon table of forms; the filter reaches the scan."""
    rows = spark.read.csv(path, sep=";", schema="lemma string, bin_id bigint, word_class string, domain string, word_form string, mark string")
    return rows.where(F.col("word_class").isin(*word_classes)) if word_classes else rows


def first_columns(spark: SparkSession, *paths: str) -> DataFrame:
    """The distinct first tab-separated fields of all lines."""
    return spark.read.text(list(paths)).select(F.split_part("value", F.lit("\t"), F.lit(1)).alias("word")).where("word != ''").distinct()


def jsonl(spark: SparkSession, path: str, schema: str, bad: str = "drop") -> DataFrame:
    """Lines of JSON by schema; bad ones are dropped, fatal, or kept in _corrupt_record."""
    mode = {"drop": "DROPMALFORMED", "fail": "FAILFAST", "keep": "PERMISSIVE"}[bad]
    kind = T.StructType.fromDDL(schema)
    if bad == "keep":
        kind = kind.add("_corrupt_record", "string")
    return spark.read.schema(kind).json(path, mode=mode)


def cold_starts(spark: SparkSession, path: str, marker: str = "COLD_START_JSON ") -> tuple[DataFrame, DataFrame]:
    """Valid samples, the first of each run with how often it came, and counts of rejects by reason."""
    raw = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where(F.trim("value") != "")
    parsed = raw.withColumn("s", F.from_json(F.substring_index("value", marker, -1), COLD_START))
    fine = F.col("s.runId").isNotNull() & F.col("s.metrics").isNotNull() & F.forall(F.map_values("s.metrics"), lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0))
    rows = parsed.withColumn("reason", F.when(F.col("s").isNull() | F.col("s.runId").isNull(), "unreadable").when(~F.coalesce(fine, F.lit(False)), "invalid"))
    good = rows.where("reason IS NULL").groupBy("s.runId").agg(F.min_by("s", "line").alias("s"), (F.count("*") - 1).alias("duplicates")).select("s.*", "duplicates")
    return good, rows.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def intents(spark: SparkSession, path: str) -> DataFrame:
    """Commented JSON lines by lower-case typo; the last one counts."""
    rows = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where(~F.col("value").rlike(r"^\s*(#|$)"))
    rows = rows.select(F.from_json("value", "typo string, intended string, intentional boolean").alias("r"), "line").where("r.typo IS NOT NULL")
    return rows.groupBy(F.lower("r.typo").alias("key")).agg(F.max_by("r", "line").alias("r")).select("key", "r.intended", "r.intentional")


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Session ids by the names of their app logs."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*-app.jsonl").load(folder).select("path", "length")
    return files.select(F.regexp_extract("path", r"([^/]+)-app\.jsonl$", 1).alias("sid"), "length")


def learning_log(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Tab-separated events (version, day, code, up to three fields); other versions and torn lines are skipped."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(F.get(f, F.lit(0)).rlike("^[0-9]+$") & F.get(f, F.lit(1)).rlike("^-?[0-9]+$") & (F.size(f) >= 4))
    return rows.where(F.get(f, F.lit(0)).cast("int") == version).select(F.get(f, F.lit(1)).cast("int").alias("day"), F.get(f, F.lit(2)).alias("code"), *(unescape_tsv(F.get(f, F.lit(i))).alias(f"f{i - 2}") for i in (3, 4, 5))).where(F.col("code").isin("wc", "sa", "cr", "wt", "ts"))


def append_events(events: DataFrame, path: str, version: int = 1) -> None:
    """Appends events (day, code, f1, f2, f3) whose first field can be learned."""
    rows = events.where(is_learnable(F.col("f1")))
    line = F.concat_ws("\t", F.lit(str(version)), F.col("day").cast("string"), "code", *(F.coalesce(escape_tsv(F.col(c)), F.lit("")) for c in ("f1", "f2", "f3")))
    rows.select(line.alias("value")).write.mode("append").text(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """cp, name (the first spoken one), keywords (distinct, in order) of an XML of annotations."""
    rows = spark.read.schema("_VALUE string, _cp string, _type string").option("rowTag", "annotation").format("xml").load(path).withColumn("o", F.monotonically_increasing_id())
    name = F.min_by(F.when(F.col("_type") == "tts", F.col("_VALUE")), F.when(F.col("_type") == "tts", F.col("o")))
    parts = F.transform(F.sort_array(F.collect_list(F.when(F.col("_type").isNull(), F.struct("o", "_VALUE")))), lambda x: F.transform(F.split(x["_VALUE"], r"\|"), F.trim))
    return rows.groupBy(F.col("_cp").alias("cp")).agg(name.alias("name"), F.array_distinct(F.flatten(parts)).alias("keywords"))


@F.pandas_udf(T.StringType())
def _from_hex(points):
    return points.map(lambda p: "".join(chr(int(x, 16)) for x in p.split()), na_action="ignore")


def emoji_test(spark: SparkSession, path: str) -> DataFrame:
    """The fully-qualified rows of a table of emoji."""
    rows = spark.read.text(path).where(F.col("value").rlike(r"^[0-9A-F ]+;\s*fully-qualified"))
    return rows.select(_from_hex(F.trim(F.split_part("value", F.lit(";"), F.lit(1)))).alias("emoji"))


def vocabulary_import(spark: SparkSession, path: str) -> DataFrame:
    """Words of a list: `# ` is a comment, `#word` a word; the first of each normal form stays."""
    rows = spark.read.text(path).withColumn("o", F.monotonically_increasing_id()).where(~F.col("value").rlike(r"^\s*(#\s|#?$)"))
    rows = rows.select(F.regexp_replace(F.trim("value"), "^#", "").alias("word"), "o").where((F.length("word") >= 2) & is_importable(F.col("word")))
    return rows.groupBy(normal_word(F.col("word")).alias("key")).agg(F.min_by("word", "o").alias("word"))


def curated(spark: SparkSession, path: str, freq: int = 8) -> DataFrame:
    rows = spark.read.text(path).select(F.trim("value").alias("word")).where(~F.col("word").rlike(r"^(#|$)"))
    return rows.groupBy(F.lower("word").alias("key")).agg(F.min("word").alias("word")).select("word", F.lit(freq).cast("long").alias("freq"))


def write_sorted(rows: DataFrame, path: str, *keys: str) -> None:
    """Parquet in the order of the keys, so that footers prune ranges."""
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_jsonl(rows: DataFrame, path: str, *keys: str) -> None:
    (rows.orderBy(*keys) if keys else rows).write.mode("overwrite").json(path)


def append_history(rows: DataFrame, path: str) -> None:
    """Appends each row as one JSON line of sorted keys."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).write.mode("append").text(path)


def audit(spark: SparkSession, files: str, manifest: DataFrame) -> DataFrame:
    """Files against a manifest (name, bytes, sha256): ok, changed, missing or unlisted."""
    there = spark.read.format("binaryFile").load(files).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("b"), F.sha2("content", 256).alias("h"))
    both = manifest.join(there, "name", "full")
    return both.select("name", F.when(F.col("h").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when((F.col("h") == F.col("sha256")) & (F.col("b") == F.col("bytes")), "ok").otherwise("changed").alias("status"))


def markdown(rows: DataFrame, most: int = 200) -> str:
    """A table of `most` rows or fewer as Markdown, for reports; larger ones are refused, not cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report table has {most} rows at most")
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in found)
