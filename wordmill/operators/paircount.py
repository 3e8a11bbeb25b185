"""Counts of words that follow each other, over blobs of distinct pairs: rows are made of what is counted only, not of every pair of a text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a task counts before it hands pairs on, and buckets that pairs are dealt into, each counted by one task.
HELD, BUCKETS = 1 << 21, 1024
#: Rows of an Arrow batch at most: texts may be long.
BATCH = 2000


def spaced_words(text: Column) -> Column:
    """The words of functions.text.words() with one space between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def _blobs(lists: list[pa.Array]) -> pa.RecordBatch:
    """Of texts as lists of words the distinct pairs (first word, space, second one or nothing after a text's last) and their counts."""
    whole = pa.concat_arrays(lists)
    words = whole.flatten().dictionary_encode()
    known, code = words.dictionary.cast(pa.large_string()), words.indices.to_numpy().astype(np.int64)
    many = len(known) + 1  # the last number stands for the end of a text
    after = np.append(code[1:], many - 1)
    after[np.cumsum(whole.value_lengths().to_numpy()) - 1] = many - 1
    pair, count = np.unique(code * many + after, return_counts=True)
    first, second = np.divmod(pair, many)
    mark = np.fromiter(map(zlib.crc32, known.cast(pa.large_binary()).to_pylist()), np.uint32, len(known))
    bucket = (mark % np.uint32(BUCKETS)).astype(np.uint16)[first]
    order = np.argsort(bucket, kind="stable")
    second = second[order]
    empty, space = (pa.scalar(t, pa.large_string()) for t in ("", " "))
    right = pc.fill_null(known.take(pa.array(second, mask=second == many - 1)), empty)
    text = pc.binary_join_element_wise(known.take(pa.array(first[order])), right, space)
    ends = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1]
    some, begin = np.unique(bucket[order], return_index=True)
    edge = np.append(begin, len(order))

    def blob(at: np.ndarray, raw: pa.Buffer) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(at.astype(np.int32)), raw])

    size, n = np.diff(ends).astype("<u4"), count[order].astype("<u4")
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), blob(ends[edge], text.buffers()[2]), blob(edge * 4, pa.py_buffer(size.tobytes())), blob(edge * 4, pa.py_buffer(n.tobytes()))], ["bucket", "text", "size", "n"])


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, held = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            lists = pc.split_pattern(batch.column(0).slice(lo, 256), " ")
            parts.append(lists)
            held += len(lists.flatten())
            if held >= HELD:
                yield _blobs(parts)
                parts, held = [], 0
    if parts:
        yield _blobs(parts)


def _merged(texts: list[bytes], sizes: list[bytes], counts: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Each pair once, and its count."""
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(b"".join(sizes), "<u4"), dtype=np.int64)])
    pair = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(texts))])
    rows = pa.table([pair, pa.array(np.concatenate(counts))], ["pair", "n"]).group_by("pair", use_threads=False).aggregate([("n", "sum")])
    return pa.concat_arrays(rows["pair"].chunks), rows["n_sum"].to_numpy()


def _bytes(pair: pa.Array) -> tuple[bytes, np.ndarray]:
    """The signs of an array of strings and where each begins, with the end."""
    _, ends, raw = pair.buffers()
    ends = np.frombuffer(ends, np.int64)[pair.offset : pair.offset + len(pair) + 1]
    return raw.to_pybytes()[ends[0] : ends[-1]], ends - ends[0]


class Bucket:
    """What a bucket's first words are followed by: first and second (dictionary arrays), freq, and the count of each first word, n1.

    Blobs are merged on the way as soon as they hold HELD pairs more than were different before.
    """

    def __init__(self, blobs: Iterator[tuple[bytes, bytes, bytes]]):
        texts, sizes, counts, held, most = [], [], [], 0, HELD
        for text, size, n in blobs:
            texts.append(text)
            sizes.append(size)
            counts.append(np.frombuffer(n, "<u4").astype(np.int64))
            held += len(counts[-1])
            if held > most:
                pair, freq = _merged(texts, sizes, counts)
                text, ends = _bytes(pair)
                texts, sizes, counts, held, most = [text], [np.diff(ends).astype("<u4").tobytes()], [freq], len(freq), len(freq) + HELD
        pair, self.freq = _merged(texts, sizes, counts)
        text, ends = _bytes(pair)
        gap = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        edge = np.append(np.stack([ends[:-1], gap, gap + 1], axis=1).reshape(-1), ends[-1])
        parts, at = pa.Array.from_buffers(pa.large_string(), 3 * len(pair), [None, pa.py_buffer(edge), pa.py_buffer(text)]), 3 * np.arange(len(pair))
        self.first, self.second = (parts.take(pa.array(at + k)).cast(pa.string()).dictionary_encode() for k in (0, 2))
        self.code = self.first.indices.to_numpy()
        self.n1 = np.zeros(len(self.first.dictionary), np.int64)
        np.add.at(self.n1, self.code, self.freq)
        self.inside = self.second.indices.to_numpy() != pc.index(self.second.dictionary, "").as_py()  # -1 if no text ends here

    def pairs(self) -> pa.RecordBatch:
        some = pa.array(np.flatnonzero(self.inside))
        columns = [self.first.dictionary_decode(), self.second.dictionary_decode(), pa.array(self.freq), pa.array(self.n1[self.code])]
        return pa.RecordBatch.from_arrays([c.take(some) for c in columns], ["w1", "w2", "freq", "n1"])

    def words(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.first.dictionary, pa.array(self.n1)], ["word", "freq"])

    def best(self, k: int) -> pa.RecordBatch:
        """The k most frequent pairs of each first word; of equal ones those whose second word comes first by its bytes."""
        some = np.flatnonzero(self.inside)
        place = np.empty(len(self.second.dictionary), np.int64)
        place[pc.sort_indices(self.second.dictionary.cast(pa.binary())).to_numpy()] = np.arange(len(place))
        code = self.code[some]
        order = np.lexsort((place[self.second.indices.to_numpy()[some]], -self.freq[some], code))
        some, code = some[order], code[order]
        begin = np.flatnonzero(np.diff(code, prepend=-1))
        rank = np.arange(len(code)) - np.repeat(begin, np.diff(np.append(begin, len(code)))) + 1
        at = pa.array(some[rank <= k])
        return pa.RecordBatch.from_arrays([self.first.dictionary_decode().take(at), self.second.dictionary_decode().take(at), pa.array(self.freq).take(at), pa.array(rank[rank <= k], pa.int32())], ["w1", "w2", "freq", "rank"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for _, group in groupby(rows, key=lambda row: row[0]):
        yield Bucket(row[1:] for row in group)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from (b.pairs() for b in _buckets(batches))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from (b.words() for b in _buckets(batches))


def dealt(docs: DataFrame) -> DataFrame:
    """Blobs of the distinct pairs of words of texts (text), in buckets by their first words; what the functions below take."""
    spark, key = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))
    texts = docs.select(spaced_words(F.col("text")).alias("text")).where("text != ''")
    return texts.mapInArrow(_dealt, "bucket int, text binary, size binary, n binary").repartition("bucket").sortWithinPartitions("bucket")


def followed(blobs: DataFrame) -> DataFrame:
    """w1, w2, freq of words that follow each other in a text, and n1, how often w1 stands in all."""
    return blobs.mapInArrow(_pairs, "w1 string, w2 string, freq long, n1 long")


def totals(blobs: DataFrame) -> DataFrame:
    """word, freq of all words."""
    return blobs.mapInArrow(_words, "word string, freq long")


def continued(blobs: DataFrame, k: int) -> DataFrame:
    """w1, w2, freq, rank: the k words that follow each word most often, equal ones in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (b.best(k) for b in _buckets(batches))

    return blobs.mapInArrow(run, "w1 string, w2 string, freq long, rank int")
