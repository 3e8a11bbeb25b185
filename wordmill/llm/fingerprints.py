"""Document fingerprints: MinHash signatures of word shingles, and how far they follow an edit.

Classes of documents that are alike by these signatures (bands joined in Spark, Jaccard verified on whole shingle sets)
come from near_duplicates().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmill.llm import neardup, signatures, vec

PLACES = signatures.PLACES


def marks(column: pa.Array, places: int = PLACES) -> np.ndarray:
    """16 bits of every place of the MinHash signature of each text's five-word shingles (of all words if there are fewer).

    A text without words has one shingle, its signs; an empty one has none, and all ones.
    """
    out = [np.zeros((0, places), np.uint16)]
    for lo, hi, points, offsets in vec.steps(column):
        _, _, doc, hashes = vec.words(points, offsets)
        h, own = vec.shingles(hashes, doc, neardup.SHINGLE)
        bare = np.flatnonzero((np.bincount(doc, minlength=hi - lo) == 0) & (np.diff(offsets) > 0))
        if len(bare):
            signs = vec.segment_hashes(vec.char_values()[points], offsets[bare], offsets[bare + 1])
            h, own = np.concatenate([h, signs]), np.concatenate([own, bare])
            order = np.argsort(own, kind="stable")
            h, own = h[order], own[order]
        out.append(signatures.minhash(h, own, hi - lo, places).astype(np.uint16))
    return np.concatenate(out)


def text_of(mark: np.ndarray) -> list[str]:
    """Signatures as hexadecimal text, four digits for each place."""
    flat = np.ascontiguousarray(mark.astype(">u2")).tobytes().hex()
    width = 4 * mark.shape[1]
    return [flat[i : i + width] for i in range(0, len(flat), width)]


def fingerprints(docs: DataFrame, places: int = PLACES) -> DataFrame:
    """doc_id and fingerprint of every whole text. Equal texts have equal fingerprints; null is empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text_of(marks(vec.plain(batch.column(1)), places)), pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


def near_duplicates(docs: DataFrame, least: float = neardup.LIKENESS) -> DataFrame:
    """doc_id, node, class_id: classes of texts whose sets of shingles have a Jaccard likeness of `least` or more."""
    return neardup.classes(docs, signatures.minhash, counted=False, least=least)


def _coarse(docs: DataFrame) -> Column:
    """doc_id as a double in the same order (different ids may be equal), by which ranges are cut; null is the least."""
    kind, at = docs.schema["doc_id"].dataType, F.col("doc_id")
    if isinstance(kind, (T.NumericType, T.TimestampType)):
        number = at.cast("double")
    else:  # the first six bytes
        number = F.conv(F.rpad(F.hex(F.substring(at.cast("string").cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.coalesce(number, F.lit(float("-inf")))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) dealt into ranges of descending doc_id, each sorted and followed by the row after its last.

    The row after the last of all is the first of all. `copy` marks the added rows: one for each range (and its equals), of
    which the driver learns the id only. Null doc_ids come last; rows of one doc_id are ordered by a hash of their text.
    The ranges are cut by doc_id as a double or, of other kinds, by its first bytes; the order is that of doc_id itself.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _coarse(docs).alias("k"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.where("k > double('-infinity')").approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n)))
    dealt = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="k", outputCol="range", handleInvalid="keep").transform(rows) if cuts else rows.withColumn("range", F.lit(0.0))
    dealt = dealt.select("doc_id", "text", F.xxhash64("text").alias("h"), F.col("range").cast("int").alias("range"))
    first = F.max(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", F.bitwise_not("h").alias("h")))
    found = {r["range"]: (r["first"]["doc_id"], ~r["first"]["h"]) for r in dealt.groupBy("range").agg(first.alias("first")).collect()}
    there = sorted(found)
    if not there:
        return dealt.select("doc_id", "text", "range", F.lit(False).alias("copy"))
    above = dict(zip(there, [*there[1:], there[0]], strict=True))  # the first row of a range also ends the range above
    schema = T.StructType([T.StructField("r", T.IntegerType()), T.StructField("i", docs.schema["doc_id"].dataType), T.StructField("g", T.LongType()), T.StructField("above", T.IntegerType())])
    goal = F.broadcast(spark.createDataFrame([(r, *found[r], above[r]) for r in there], schema))  # a row for each range
    both = dealt.join(goal, (F.col("range") == F.col("r")) & (F.col("h") == F.col("g")) & F.col("doc_id").eqNullSafe(F.col("i")), "left")
    at = F.when(F.col("above").isNotNull(), F.array("range", "above")).otherwise(F.array("range"))
    both = both.select("doc_id", "text", "h", F.posexplode(at).alias("copy", "range")).withColumn("copy", F.col("copy") == 1)
    return both.repartitionById(max(there) + 1, F.col("range")).sortWithinPartitions("range", "copy", F.desc_nulls_last("doc_id"), "h").select("doc_id", "text", "range", "copy")


def compare_edits(docs: DataFrame, places: int = PLACES) -> DataFrame:
    """Every row's fingerprint beside that of its edited text and of the next document in descending doc_id.

    The edit puts the first floor(n / 2) code points of the next document (all, if it has fewer) in the place of the
    last floor(n / 2). Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    the last two the share of equal places. Null texts are empty; a single row is its own next one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def pairs(table: pa.Table) -> pa.RecordBatch:
        own = pa.array([not c for c in table["copy"].to_pylist()[: table.num_rows - 1]], pa.bool_())
        texts = table["text"].to_pylist()
        sign = marks(vec.plain(table["text"]), places)
        edited = []
        for text, after in zip(texts, texts[1:], strict=False):
            half = len(text) // 2
            edited.append(text[: len(text) - half] + after[:half])
        new = marks(pa.array(edited, pa.string()), places)
        same = lambda a, b: pa.array((a == b).mean(axis=1) if len(a) else np.zeros(0), pa.float64())
        columns = [
            table["doc_id"].combine_chunks()[: len(edited)], pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in edited], pa.string()),
            pa.array(text_of(sign[:-1]), pa.string()), pa.array(text_of(new), pa.string()), same(sign[:-1], new), same(sign[:-1], sign[1:]),
        ]
        return pa.RecordBatch.from_arrays(columns, names).filter(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = pa.Table.from_batches([batch.slice(at, 512)])
                table = pa.concat_tables([left, some]) if left is not None else some
                if table.num_rows > 1:
                    yield pairs(table)
                left = table.slice(table.num_rows - 1)

    return with_next(docs).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document; see compare_edits() for nulls, single rows and equal ids."""
    return compare_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
