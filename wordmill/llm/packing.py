"""Best-fit packing of tokenised documents into sequences, by bin completion."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.llm import tokens, vec
from wordmill.llm.cluster import stash

CAPACITY = 2048
#: Pieces that one task packs together. A block leaves at most about one sequence unfilled, 1 in some 3,000.
BLOCK = 8192
#: Nodes of the search tree that a block, of any size, may visit beside the first descent.
NODES = 20_000


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of every length: longest first, each to the fullest bin that has room."""
    order = np.argsort(-lengths, kind="stable")
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = np.zeros(capacity + 2, bool)  # which rooms there are
    out = np.empty(len(lengths), np.int64)
    bins = 0
    for i in order.tolist():
        n = int(lengths[i])
        fit = int(filled[n:].argmax()) + n
        if filled[fit]:
            b = room[fit].pop()
            filled[fit] = bool(room[fit])
        else:
            b, fit, bins = bins, capacity, bins + 1
        out[i] = b
        if fit > n:
            room[fit - n].append(b)
            filled[fit - n] = True
    return out


def bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins (Martello and Toth's bound over all thresholds up to a half)."""
    sizes = np.arange(len(counts))
    total, n = np.concatenate([[0], np.cumsum(counts * sizes)]), np.concatenate([[0], np.cumsum(counts)])
    most = -(-int(total[-1]) // capacity)
    for k in range(capacity // 2 + 1):
        large = int(n[-1] - n[capacity - k + 1])
        half = int(n[capacity - k + 1] - n[capacity // 2 + 1])
        free = half * capacity - int(total[capacity - k + 1] - total[capacity // 2 + 1])
        small = int(total[capacity // 2 + 1] - total[k])
        most = max(most, large + half + max(0, -(-(small - free) // capacity)))
    return most


def fillings(counts: np.ndarray, room: int, most: int) -> Iterator[tuple[int, ...]]:
    """All fillings of the room that waste at most `most` and to which no further piece can be added, least waste first.

    Every undominated filling is one of these: one that leaves room for a piece is dominated by itself with that piece. So
    all pieces up to the waste are in it; the others are found by the sums that they reach, without dead ends.
    """
    sizes = [int(s) for s in np.flatnonzero(counts[: room + 1])[::-1] if s]
    many = [int(counts[s]) for s in sizes]
    mask, small, reach = (2 << room) - 1, -1, [1]

    def grow(at: int, left: int, taken: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if not left:
            yield taken
            return
        for k in range(at, len(reach) - 1):
            if not reach[k] >> left & 1:
                return
            for n in range(min(many[k], left // sizes[k]), 0, -1):
                if reach[k + 1] >> left - n * sizes[k] & 1:
                    yield from grow(k + 1, left - n * sizes[k], taken + (sizes[k],) * n)

    for waste in range(min(most, room) + 1):
        before, small = small, sum(s <= waste for s in sizes)
        if small != before:
            reach, held = [1], tuple(s for s, n in zip(sizes, many, strict=True) if s <= waste for _ in range(n))
            for k in range(len(sizes) - small - 1, -1, -1):  # reach[k]: a bit for each sum of the pieces from the k-th size on
                sums = reach[-1]
                for _ in range(min(many[k], room // sizes[k])):
                    sums |= sums << sizes[k] & mask
                reach.append(sums)
            reach.reverse()
        if sum(held) > room - waste:
            return
        for rest in grow(0, room - waste - sum(held), ()):
            yield rest + held


def completions(counts: np.ndarray, room: int, width: int = 4) -> list[tuple[int, ...]]:
    """Fillings of the room by up to three pieces, least waste first, none of which another one dominates.

    A filling dominates one whose pieces fit, in groups, into its pieces: so of single pieces only the longest counts,
    pairs only if they fill more, and of equal sums the filling of fewer and longer pieces.
    """
    sizes = np.flatnonzero(counts[: room + 1])
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return [()]
    found: dict[int, tuple[int, ...]] = {}
    best = int(sizes[-1])
    found[best] = (best,)
    if best < room:
        partner = np.searchsorted(sizes, room - sizes, "right") - 1  # the longest that fits beside each
        ok = partner >= 0
        a, b = sizes[ok], sizes[partner[ok]]
        ok = (a > b) | (a == b) & (counts[a] > 1)
        same = (a == b) & (counts[a] < 2) & (partner[partner >= 0] > 0)
        a, b = np.concatenate([a[ok], a[same]]), np.concatenate([b[ok], sizes[partner[partner >= 0][same] - 1]])
        total = a + b
        for i in np.argsort(-total * 4096 - a, kind="stable")[: 2 * width].tolist():
            if (t := int(total[i])) > best:
                found.setdefault(t, (int(a[i]), int(b[i])))
        if not found.keys() & {room}:
            top = max(found)
            for a in sizes[::-1][: 4 * width].tolist():  # a longest piece, then a pair that fills what is left
                left = room - a
                rest = sizes[sizes <= min(a, left)]
                if not len(rest):
                    continue
                partner = np.searchsorted(rest, left - rest, "right") - 1
                ok = partner >= 0
                b, c = rest[ok], rest[partner[ok]]
                need = (b == a).astype(int) + (c == a) + 1
                ok = (b >= c) & (counts[a] >= need) & ((b != c) | (counts[b] >= 2 + (b == a)))
                if ok.any():
                    i = int(np.argmax(np.where(ok, b + c, -1)))
                    if (t := a + int(b[i] + c[i])) > top:
                        found.setdefault(t, (a, int(b[i]), int(c[i])))
    return [found[t] for t in sorted(found, reverse=True)[:width]]


def complete(counts: np.ndarray, capacity: int, incumbent: int, least: int, nodes: int = NODES) -> list[list[int]] | None:
    """Bins of lengths that are fewer than the incumbent, or None: depth first over fillings around the longest piece.

    At each node the best fillings of few pieces come first, then all others, however many pieces there are. A branch ends
    when the room that it wastes can no longer save a bin.
    """
    counts, total = counts.copy(), int((counts * np.arange(len(counts))).sum())
    best: list[list[int]] | None = None
    nodes += incumbent
    stack: list[tuple[Iterator[tuple[int, ...]], int]] = []  # choices left, waste before them
    bins: list[tuple[int, ...]] = []

    def choices(waste: int) -> Iterator[tuple[int, ...]]:
        """Bins around the longest piece. Whenever one is asked for, the counts are those of the first time."""
        first = int(np.flatnonzero(counts)[-1])
        counts[first] -= 1
        own = completions(counts, capacity - first)
        counts[first] += 1
        seen = set()
        for pick in own:
            pick = [first, *pick]
            # the fillings beyond three pieces: the longest that still fits, again and again
            rest = counts[: capacity - sum(pick) + 1].copy()
            for n in pick:
                if n < len(rest):
                    rest[n] -= 1
            while len(fits := np.flatnonzero(rest[1 : capacity - sum(pick) + 1])):
                pick.append(int(fits[-1]) + 1)
                rest[pick[-1]] -= 1
            seen.add(tuple(sorted(pick)))
            yield tuple(pick)
        counts[first] -= 1
        left = counts[: capacity - first + 1].copy()
        counts[first] += 1
        for pick in fillings(left, capacity - first, (incumbent - 1) * capacity - total - waste):
            if tuple(sorted((first, *pick))) not in seen:
                yield (first, *pick)

    stack.append((choices(0), 0))
    while stack and nodes > 0:
        todo, waste = stack[-1]
        if (pick := next(todo, None)) is None:
            stack.pop()
            if bins:
                counts += np.bincount(bins.pop(), minlength=len(counts))
            continue
        wasted = waste + capacity - sum(pick)
        nodes -= 1
        if wasted > (incumbent - 1) * capacity - total:
            continue
        counts -= np.bincount(pick, minlength=len(counts))
        bins.append(pick)
        if counts.any():
            stack.append((choices(wasted), wasted))
            continue
        best, incumbent = [list(b) for b in bins], len(bins)
        if incumbent <= least:
            break
        counts += np.bincount(bins.pop(), minlength=len(counts))
    return best


def pack(lengths: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it of every length (each from 1 to the capacity)."""
    if not len(lengths):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = best_fit(lengths, capacity)
    counts = np.bincount(lengths, minlength=capacity + 1)
    least, now = bound(counts, capacity), int(own.max()) + 1
    if now > least and (better := complete(counts, capacity, now, least, nodes)):
        order = np.argsort(lengths, kind="stable")
        at = np.concatenate([[0], np.cumsum(counts)])[:-1].tolist()
        for b, sizes in enumerate(better):
            for n in sizes:
                own[order[at[n]]] = b
                at[n] += 1
    order = np.argsort(own, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    first = np.flatnonzero(np.diff(own[order], prepend=-1))
    place = np.empty(len(lengths), np.int64)
    place[order] = before - np.repeat(before[first], np.diff(np.append(first, len(order))))
    return own, place


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document.

    A document is its text's ids and then id 0; null texts are empty. Longer ones than the capacity are cut.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens.word_bpe(tokenizer)
        for batch in batches:
            for lo, hi, ids, bounds in bpe.encode(vec.plain(batch.column(1))):
                ids = np.insert(ids, bounds[1:], 0).astype("<u4")
                begin = bounds + np.arange(hi - lo + 1)
                size = np.diff(begin)
                many = -(-size // capacity)
                row = np.repeat(np.arange(hi - lo), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(capacity, size[row] - start)
                raw, first = memoryview(ids).cast("B"), begin[row] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
                columns = [batch.column(0)[lo:hi].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if keep_ids:
                    columns.append(vec.ragged(ids.astype(np.int32), length, pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])
        bpe.forget()  # the worker may go on with other stages
        vec.trim()

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, block: int = BLOCK, nodes: int = NODES, keep_ids: bool = False) -> DataFrame:
    """Packs documents (doc_id, text; other columns don't matter) into sequences of at most `capacity` tokens.

    One row for each piece: doc_id, piece (from 0), start, length, ids_crc32, sequence_id, offset (and ids). Pieces are
    dealt by hash into blocks of about `block`; in each, best-fit packing is the incumbent of a bin-completion search.
    Empty and null texts are pieces of one id; repeated rows and null doc_ids are pieces like any other; an empty table
    gives no row. Only doc_id and text are read, so no other column can clash.
    """
    pieces = stash(token_pieces(docs, tokenizer, capacity, keep_ids))
    blocks = max(1, -(-pieces.count() // block))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("ids_crc32", "piece", F.monotonically_increasing_id()), F.lit(blocks)))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        own, place = pack(rows["length"].to_numpy(np.int64), capacity, nodes)
        return rows[names].assign(sequence_id=(int(key[0]) << 32) + own, offset=place)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return dealt.groupBy("block").applyInPandas(fill, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id and its ids in order, of pack_documents(keep_ids=True)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each piece of every document; see pack_documents() for nulls, long texts and repeats."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
