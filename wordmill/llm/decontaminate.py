"""Benchmark decontamination: spaced seeds of words are joined between texts and test items, aligned overlaps decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.llm import vec
from wordmill.llm.cluster import flagged, row_key, stash, unused

#: Which words of a stretch a seed takes; the others may differ. Of random places of as many other words as SHARE and
#: WORDS allow, these meet 0.97 or more, whatever the item's length.
MASKS = ("10111", "1100101", "110000011", "1101001")
#: An overlap counts from so many equal words (all, of shorter items) and such a share of the item's; long ones count whatever the share.
WORDS, SHARE, LONG = 8, 0.6, 25
#: Items of fewer words are no evidence.
LEAST = 5
#: Seeds of test items that one pass over the texts looks for, and bits of the filter that executors hold meanwhile (8 MB).
BLOCK, BITS = 4_000_000, 1 << 26
_SHIFTS = (0, 19, 38)


def seeds(hashes: np.ndarray, owner: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every place where the mask lies within one text."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, np.uint64(len(mask)))
    for k, c in enumerate(mask):
        if c == "1":
            h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n + k] + np.uint64(k)
    at = np.flatnonzero(owner[:n] == owner[len(mask) - 1 :])
    return vec.mix(h[at]), at


def _all_seeds(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = [seeds(hashes, owner, mask) for mask in MASKS]
    return np.concatenate([h for h, _ in found]), np.concatenate([at for _, at in found])


def _raw(words: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The words of each text as eight bytes each."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((8 * bounds).astype(np.int64)), pa.py_buffer(words.astype("<u8").tobytes())]).cast(pa.binary())


def _by_seed(h: np.ndarray, own: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """How many different seeds each of n texts has, those seeds, and lists of the places of each."""
    order = np.lexsort((place, h, own))
    h, own, place = h[order], own[order], place[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])])) if len(h) else np.zeros(0, np.int64)
    return np.bincount(own[new], minlength=n), pa.array(h[new].view(np.int64)), vec.ragged(place.astype(np.int32), np.diff(np.append(new, len(h))), pa.int32())


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """item_id, item (a hash of the row), n and words of the items of LEAST words or more; and their seeds: seed, item, places."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, points, offsets in vec.steps(batch.column(1)):
                _, _, owner, words = vec.words(points, offsets)
                bounds = np.searchsorted(owner, np.arange(hi - lo + 1))
                n = np.diff(bounds)
                rows = pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array(n, pa.int32()), _raw(words, bounds)], ["item_id", "item", "n", "words"])
                yield rows.filter(pa.array(n >= LEAST))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = np.frombuffer(raw, "<u8").astype(np.uint64)
                h, place = _all_seeds(words, np.zeros(len(words), np.int64))
                _, seed, places = _by_seed(h, np.zeros(len(h), np.int64), place, 1)
                yield pa.RecordBatch.from_arrays([seed, pa.array(np.full(len(seed), item, np.int64)), places], ["seed", "item", "places"])

    rows = benchmark.select("item_id", "text", F.xxhash64("item_id", "text").alias("item")).mapInArrow(read, f"item_id {kind}, item long, n int, words binary")
    items = stash(rows.dropDuplicates(["item"]))
    return items, stash(items.select("item", "words").mapInArrow(cut, "seed long, item long, places array<int>"))


def _filter(known: DataFrame) -> np.ndarray:
    """A bitmap in which three bits of every seed are set."""
    shift = F.explode(F.array(*map(F.lit, _SHIFTS)))
    slot = known.select("seed", shift.alias("s")).select(F.shiftrightunsigned("seed", 0).alias("seed"), "s")
    slot = slot.select(F.expr(f"shiftrightunsigned(seed, s) & {BITS - 1}").alias("at"))
    table = slot.select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most BITS / 64 rows
    out = np.zeros(BITS // 64, np.uint64)
    out[table["w"].to_numpy(np.int64)] = table["b"].to_numpy(np.int64).view(np.uint64)
    return out


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for s in _SHIFTS:
        at = h >> np.uint64(s) & np.uint64(BITS - 1)
        out &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def _hits(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, row, words and hits (seed, places) of the texts that hold a seed of `known`, or seem to."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(_filter(known))  # BITS / 8 bytes, whatever the tables hold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for lo, hi, points, offsets in vec.steps(batch.column(1)):
                _, _, owner, words = vec.words(points, offsets)
                h, at = _all_seeds(words, owner)
                some = np.flatnonzero(_passes(bits, h))
                if not len(some):
                    continue
                bounds = np.searchsorted(owner, np.arange(hi - lo + 1))
                h, at = h[some], at[some]
                size, seed, places = _by_seed(h, owner[at], at - bounds[owner[at]], hi - lo)
                struct = pa.StructArray.from_arrays([seed, places], ["seed", "places"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), struct)
                rows = pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(2)[lo:hi], _raw(words, bounds), lists], ["doc_id", "row", "words", "hits"])
                yield rows.filter(pa.array(size > 0))

    schema = f"doc_id {kind}, row long, words binary, hits array<struct<seed: long, places: array<int>>>"
    return docs.select("doc_id", "text", row_key().alias("row")).mapInArrow(run, schema).dropDuplicates(["doc_id", "row"])


def overlap(text: np.ndarray, item: np.ndarray, met: list[tuple[np.ndarray, np.ndarray]]) -> tuple[int, int, int]:
    """First word, word after the last and equal words of an item in a text, from the places of common seeds in both.

    Along each diagonal the best run of equal words over others is kept, the longest of equals; the equal words are those of all diagonals of
    five or more, the first and last ones those of the diagonal with most.
    """
    diagonals, votes = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for here, there in met:
        step = max(1, (1 << 20) // len(there))
        for lo in range(0, len(here), step):
            found, many = np.unique(np.subtract.outer(here[lo : lo + step].astype(np.int64), there), return_counts=True)
            diagonals, at = np.unique(np.concatenate([diagonals, found]), return_inverse=True)
            votes = np.bincount(at, np.concatenate([votes, many]), len(diagonals)).astype(np.int64)
    equal, best = np.zeros(len(item), bool), (0, 0, 0)
    for shift in diagonals[np.lexsort((diagonals, -votes))].tolist():
        x, y = max(0, -shift), min(len(item), len(text) - shift)
        same = text[x + shift : y + shift] == item[x:y]
        score = np.concatenate([[0], np.cumsum(np.where(same, 1, -1))])
        gain = score - np.minimum.accumulate(score)
        end = len(gain) - 1 - int(np.argmax(gain[::-1]))
        start = int(np.argmin(score[: end + 1]))
        same[:start], same[end:] = False, False
        n = int(same.sum())
        if n >= LEAST:
            equal[x:y] |= same
            if n > best[2]:
                best = (x + shift + start, x + shift + end, n)
        if n == len(item):  # nothing can be added
            break
    return best[0], best[1], int(equal.sum())


def is_leak(n_equal: int, n_item: int, words: int = WORDS, share: float = SHARE, long: int = LONG) -> bool:
    return n_equal >= min(words, n_item) and n_equal >= share * n_item or n_equal >= long


def leaks(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, share: float = SHARE, long: int = LONG, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, first_word, last_word, n_equal, n_item of every text that holds a test item, wholly or nearly.

    Words are lower-case runs of letters, marks and numbers. Text and item meet where a mask's words are equal: a join by
    seeds, of which a bitmap lets through to it what may be in some item. Along that diagonal the best run of equal words
    over substituted ones is kept (runs on other diagonals, after words put in or left out, add to it). A pair is a leak
    if it has `words` equal words (all, of an item of fewer) that are `share` of the item's, or `long`. Items of fewer
    than LEAST words are no evidence and find nothing; so do null or empty texts; equal items of other ids are all
    reported, repeated rows once. The texts are read once for every `block` seeds of the benchmark; either table may be
    empty. Only doc_id, item_id and text are read, so no other column can clash.
    """
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    items, known = _items(benchmark)
    parts = max(1, -(-known.count() // block))
    met: DataFrame | None = None
    for k in range(parts):
        some = known.where(F.pmod("seed", F.lit(parts)) == k)
        found = stash(_hits(docs, some))
        hit = found.select("doc_id", "row", F.explode("hits").alias("h")).select("doc_id", "row", F.col("h.seed").alias("seed"), F.col("h.places").alias("here"))
        pairs = hit.join(some.withColumnRenamed("places", "there"), "seed").groupBy("doc_id", "row", "item").agg(F.collect_list(F.struct("here", "there")).alias("met"))
        texts = found.select(F.col("doc_id").alias("i"), F.col("row").alias("r"), F.col("words").alias("text"))
        part = pairs.join(texts, (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("i"))).drop("i", "r")
        part = stash(part) if parts > 1 else part
        met = part if met is None else met.unionByName(part)
    if parts > 1:
        met = met.groupBy("doc_id", "row", "item").agg(F.flatten(F.collect_list("met")).alias("met"), F.first("text").alias("text"))
    rows = met.join(items, "item").select("doc_id", "item_id", "n", "text", "words", "met")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, out, good = batch.column(2).to_pylist(), [], []
            for row, (text, item, places) in enumerate(zip(batch.column(3), batch.column(4), batch.column(5), strict=True)):
                text, item = (np.frombuffer(x.as_buffer(), "<u8") for x in (text, item))
                x = overlap(text, item, [(np.array(p["here"]), np.array(p["there"])) for p in places.as_py()])
                if is_leak(x[2], n[row], words, share, long):
                    out.append(x)
                    good.append(row)
            first, last, equal = zip(*out, strict=True) if out else ((), (), ())
            some = batch.take(pa.array(good, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(equal, pa.int32()), some.column(2)], ["doc_id", "item_id", "first_word", "last_word", "n_equal", "n_item"])

    return rows.mapInArrow(judge, f"doc_id {kind}, item_id {item_kind}, first_word long, last_word long, n_equal int, n_item int")


def keep_clean(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows, with all their columns, of texts in which no test item leaks; all rows of a doc_id that leaks in one text only stay but that text's."""
    (row, flag) = unused(docs.columns, "row", "flag")
    keyed = docs.withColumn(row, row_key())
    # leaks() of the row's hash as doc_id: the rows that go are found again by it
    found = leaks(docs.select(row_key().alias("doc_id"), "text"), benchmark, block=block)
    gone = stash(found.select(F.col("doc_id").alias(row)).distinct())
    marked = flagged(keyed, row, gone, row, flag)
    part = marked.where(flag).join(gone, row, "left_anti")
    return marked.where(~F.col(flag)).select(*docs.columns).unionByName(part.select(*docs.columns))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, first_word, last_word, n_equal, n_item of every leak; see leaks() for nulls, short items and repeats."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
