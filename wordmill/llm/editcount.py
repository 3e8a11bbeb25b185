"""Edit-aware token counts: a tree of sums over each text's stretches, of which an edit re-encodes only those it touches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.llm import tokens, vec


def stretches(bpe: tokens.WordBpe, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of every stretch, its number of ids, and where each text's stretches begin, with the end.

    A stretch is a run without white space and the white space after it; one before the first is part of the first. No
    piece of the tokenizer crosses white space, and neither does any composition of NFC: stretches are counted alone.
    """

    def begins(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        black = vec.classes()[points] != vec.SPACE
        begin = black.copy()
        begin[1:] &= ~black[:-1]
        first = offsets[:-1][offsets[:-1] < len(points)]
        begin[first] = black[first]
        return np.flatnonzero(begin)

    starts = begins(points, offsets)
    bounds = np.searchsorted(starts, offsets)
    if bpe.is_odd(points):
        ends = np.append(starts[1:], len(points))
        text = points.tobytes().decode("utf-32-le")
        count = np.array([len(bpe.exact.encode(text[a:b], add_special_tokens=False).ids) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    else:
        normal, at, piece, ids = bpe.counts(points, offsets)
        own = np.searchsorted(begins(normal, at), piece, "right") - 1
        count = np.bincount(own, ids, len(starts)).astype(np.int64)
    return starts, count, bounds


class Tree:
    """Sums of characters and ids over one text's stretches. A stretch may come to hold what an edit made of several."""

    def __init__(self, text: str, starts: list[int], chars: np.ndarray, ids: np.ndarray):
        self.text, self.starts, self.changed = text, starts, {}
        self.levels = [(chars, ids)]
        while len(chars) > 1:
            if len(chars) % 2:
                chars, ids = np.append(chars, 0), np.append(ids, 0)
                self.levels[-1] = (chars, ids)
            chars, ids = chars[0::2] + chars[1::2], ids[0::2] + ids[1::2]
            self.levels.append((chars, ids))

    @property
    def n_chars(self) -> int:
        return int(self.levels[-1][0].sum())

    @property
    def n_ids(self) -> int:
        return int(self.levels[-1][1].sum())

    def leaf(self, place: int) -> tuple[int, int]:
        """The stretch that holds the character at a place, and the place of the stretch."""
        at, before = 0, 0
        for chars, _ in self.levels[-2::-1]:
            at *= 2
            if place >= before + chars[at] and at + 1 < len(chars):
                before += int(chars[at])
                at += 1
        return at, before

    def piece(self, leaf: int) -> str:
        if leaf in self.changed:
            return self.changed[leaf]
        end = self.starts[leaf + 1] if leaf + 1 < len(self.starts) else len(self.text)
        return self.text[self.starts[leaf] : end] if leaf < len(self.starts) else ""

    def touch(self, start: int, end: int, new: str) -> tuple[int, int, str]:
        """First and last stretch that an edit touches, with one more on either side, and their text after it."""
        total = self.n_chars
        start = min(max(0, start), total)
        end = min(max(start, end), total)
        if not total:
            return 0, max(0, len(self.starts) - 1), new
        first, before = self.leaf(max(0, start - 1))
        last, _ = self.leaf(min(end, max(0, total - 1)))
        if last < first:
            last = first
        while first and not self.levels[0][0][first - 1]:  # stretches that an earlier edit emptied
            first -= 1
        if first:
            first -= 1
            before -= int(self.levels[0][0][first])
        text = "".join(self.piece(i) for i in range(first, last + 1))
        while last + 1 < len(self.starts):
            last += 1
            text += (more := self.piece(last))
            if more:
                break
        return first, last, text[: start - before] + new + text[end - before :]

    def put(self, first: int, last: int, text: str, ids: int) -> None:
        """The stretches first to last now hold this text, of so many ids."""
        for leaf in range(first, last + 1):
            self.changed[leaf] = text if leaf == first else ""
        if not len(self.starts):
            self.starts, self.levels = [0], [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
        chars, counts = self.levels[0]
        chars[first : last + 1] = counts[first : last + 1] = 0
        chars[first], counts[first] = len(text), ids
        for (chars, counts), (up_chars, up_counts) in zip(self.levels, self.levels[1:], strict=False):
            first, last = first // 2, last // 2
            up_chars[first : last + 1] = chars[2 * first : 2 * last + 2 : 2] + chars[2 * first + 1 : 2 * last + 2 : 2]
            up_counts[first : last + 1] = counts[2 * first : 2 * last + 2 : 2] + counts[2 * first + 1 : 2 * last + 2 : 2]


def trees(bpe: tokens.WordBpe, column: pa.Array) -> Iterator[Tree]:
    for lo, hi, points, offsets in vec.steps(column):
        starts, count, bounds = stretches(bpe, points, offsets)
        text = points.tobytes().decode("utf-32-le")
        for row in range(hi - lo):
            a, b = int(offsets[row]), int(offsets[row + 1])
            own = starts[bounds[row] : bounds[row + 1]] - a
            ids = count[bounds[row] : bounds[row + 1]]
            if b > a and not len(own):  # nothing but white space
                own, ids = np.zeros(1, np.int64), np.zeros(1, np.int64)
            if len(own):
                own[0] = 0
            yield Tree(text[a:b], own.tolist(), np.diff(own, append=b - a), ids)


def count_edits(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Counts ids of texts before and after edits (doc_id, text, edits: array of start, stop, new).

    Edits are made one after the other, each by code points of the text that the last one left; places beyond an end are
    cut to it. One row each: doc_id, n_chars, n_ids, n_edits, n_chars_after, n_ids_after, n_reencoded (code points that
    met the tokenizer again). Null texts are empty, null edits none, null parts of one 0 or empty; repeated rows get
    equal answers; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens.word_bpe(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                yield _counted(bpe, batch.slice(lo, 256))

    return docs.select("doc_id", "text", "edits").mapInArrow(run, f"doc_id {kind}, n_chars long, n_ids long, n_edits int, n_chars_after long, n_ids_after long, n_reencoded long")


def _counted(bpe: tokens.WordBpe, batch: pa.RecordBatch) -> pa.RecordBatch:
    forest, edits = list(trees(bpe, vec.plain(batch.column(1)))), [e or [] for e in batch.column(2).to_pylist()]
    before = [(t.n_chars, t.n_ids) for t in forest]
    again = [0] * len(forest)
    for k in range(max(map(len, edits), default=0)):
        rows = [i for i, e in enumerate(edits) if k < len(e)]
        touched = [forest[i].touch((e := edits[i][k] or {}).get("start") or 0, e.get("stop") or 0, e.get("new") or "") for i in rows]
        counts = [int(count[a:b].sum()) for lo, hi, p, o in vec.steps(pa.array([x[2] for x in touched], pa.string())) for _, count, bounds in [stretches(bpe, p, o)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for i, (first, last, text), ids in zip(rows, touched, counts, strict=True):
            forest[i].put(first, last, text, ids)
            again[i] += len(text)
    columns = [batch.column(0), *(pa.array([b[j] for b in before], pa.int64()) for j in (0, 1)), pa.array([len(e) for e in edits], pa.int32()), pa.array([t.n_chars for t in forest], pa.int64()), pa.array([t.n_ids for t in forest], pa.int64()), pa.array(again, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "n_ids", "n_edits", "n_chars_after", "n_ids_after", "n_reencoded"])


#: The query's edits of every document: three, each putting 24 of its code points in the place of 12 others.
EDITS = """transform(sequence(0, 2), k -> named_struct(
    'start', pmod(crc32(concat(length(text), ':', k)), length(text) + 1),
    'stop', pmod(crc32(concat(length(text), ':', k)), length(text) + 1) + 12,
    'new', substring(text, cast(pmod(crc32(concat(k, ':', length(text))), length(text) + 1) as int) + 1, 24)))"""


def op2_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: ids before and after its edits; see count_edits() for nulls and edits out of bounds."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_edits(docs.withColumn("edits", F.expr(EDITS)), public_tokenizers.path("word_bpe_49k.json"))
