"""License scans: fuzzy search for short notices, from exact pigeonhole seeds to bounded-error matching."""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.llm import vec

#: Phrases that count wherever their words stand next to each other.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices, of which each may stand with an edit for every ten signs.
NOTICES = {
    "licensed under the apache license, version 2.0": "apache-2.0",
    "licensed under the gnu general public license, version 2": "gpl-2.0",
    "licensed under the gnu general public license, version 3": "gpl-3.0",
    "the gnu lesser general public license": "lgpl",
    "the gnu affero general public license": "agpl",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "licensed under cc by 4.0": "cc-by-4.0",
    "licensed under cc by-sa 4.0": "cc-by-sa-4.0",
    "licensed under cc by-nc 4.0": "cc-by-nc-4.0",
    "licensed under cc by-nd 4.0": "cc-by-nd-4.0",
    "creative commons attribution 4.0": "cc-by-4.0",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the bsd license": "bsd",
    "the mozilla public license, version 2.0": "mpl-2.0",
    "the eclipse public license": "epl",
    "permission to use, copy, modify, and/or distribute this software": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "the boost software license, version 1.0": "bsl-1.0",
}
SEED = 8
_WORD, _GAP = rb"0-9a-z\x80-\xff", rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
#: Upper case and signs between words, made one sign for one.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 32 or chr(c) in ",;:()[]*#/\"'" else c for c in range(256))
_IS_WORD = np.array([48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c >= 128 for c in range(256)])


@functools.cache
def _phrases() -> list[tuple[re.Pattern[bytes], str, bytes]]:
    out = []
    for phrase, label in PHRASES.items():
        first, *rest = phrase.encode().split()
        out.append((re.compile(first + rb"(?<![" + _WORD + rb"]" + first + rb")" + b"".join(_GAP + w for w in rest) + rb"(?![" + _WORD + rb"])"), label, max(rest, key=len)))
    return out


class Notices:
    """The seeds of all notices. k edits leave one of k + 1 stretches of a notice whole, and that is where to look."""

    def __init__(self, notices: dict[str, str]):
        import regex

        self.all = []
        self.seeds: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for notice, label in notices.items():
            folded = notice.encode().translate(_FOLD)
            size = len(folded)
            edits = max(0, min(size // 10, size // SEED - 1))
            n = len(self.all)
            self.all.append((label, edits, size, regex.compile(f"(?b)(?:{regex.escape(folded.decode())}){{e<={edits}}}")))
            for k in range(edits + 1):
                at = k * size // (edits + 1)
                self.seeds[folded[at : at + SEED]].append((n, at))
        self.there, self.later = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)  # by a hash of a seed's first and last four bytes
        for table, part in ((self.there, slice(4)), (self.later, slice(4, 8))):
            table[self.slot(np.array([int.from_bytes(s[part], "little") for s in self.seeds], np.uint32))] = True

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(16)

    def hits(self, folded: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place of a seed, notice, the seed's place in it)"""
        n = len(folded) - SEED + 1
        if n <= 0:
            return
        wide = folded.astype(np.uint32)
        two = wide[:-1] | wide[1:] << np.uint32(8)
        four = two[:-2] | two[2:] << np.uint32(16)
        maybe = np.flatnonzero(self.there[self.slot(four[:n])])
        maybe = maybe[self.later[self.slot(four[maybe + 4])]]
        for at in maybe.tolist():
            for notice, offset in self.seeds.get(folded[at : at + SEED].tobytes(), ()):
                yield at, notice, offset

    def find(self, folded: bytes, hits: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int, float]]:
        """start, end (code points), label, edits and likeness of the notices in one text; of those that overlap, the likest."""
        spans = defaultdict(list)
        for at, n, offset in hits:
            _, edits, size, _ = self.all[n]
            lo = at - offset - edits
            if spans[n] and lo <= spans[n][-1][1]:
                spans[n][-1][1] = max(spans[n][-1][1], lo + size + 2 * edits)
            else:
                spans[n].append([lo, lo + size + 2 * edits])
        found = []
        for n, stretches in spans.items():
            label, _, size, pattern = self.all[n]
            for lo, hi in stretches:
                lo, hi = max(0, lo), min(len(folded), hi)
                while lo and folded[lo] & 0xC0 == 0x80:
                    lo -= 1
                while hi < len(folded) and folded[hi] & 0xC0 == 0x80:
                    hi += 1
                text = folded[lo:hi].decode("utf-8", "replace")
                before = len(folded[:lo].decode("utf-8", "replace"))
                for m in pattern.finditer(text):
                    edits = sum(m.fuzzy_counts)
                    found.append((before + m.start(), before + m.end(), label, edits, 1 - edits / size))
        found.sort(key=lambda x: (-x[4], x[0] - x[1], x[0], x[2]))
        kept: list[tuple[int, int, str, int, float]] = []
        for x in found:
            if all(x[1] <= y[0] or y[1] <= x[0] for y in kept):
                kept.append(x)
        return sorted(kept)


@functools.cache
def _notices() -> Notices:
    return Notices(NOTICES)


SCAN = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, notices array<struct<start: long, end: long, label: string, edits: int, likeness: double>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and what its whole text holds: n_words, n_base, first_word, last_word, base_labels, notices.

    Words are runs of a-z (either case), digits and everything beyond ASCII. A base place is one where a phrase's words
    stand consecutively; first_word and last_word are the smallest and largest of their word numbers, null without any.
    notices are the matches of NOTICES with their edits, in code points. Null and empty texts have no words and no
    places; repeated rows get equal answers; only doc_id and text are read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notices = _notices()
        for batch in batches:
            column = vec.plain(batch.column(1))
            rows: list[dict] = []
            for i in range(0, len(column), 500):
                rows += _texts(column[i : i + 500], notices)
            schema = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("notices", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int32()), ("likeness", pa.float64())])))])
            out = pa.RecordBatch.from_pylist(rows, schema)
            yield pa.RecordBatch.from_arrays([batch.column(0), *out.columns], ["doc_id", *out.schema.names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCAN}")


def _texts(column: pa.Array, notices: Notices) -> list[dict]:
    at = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = memoryview(column.buffers()[2])[int(at[0]) : int(at[-1])] if column.buffers()[2] is not None else memoryview(b"")
    at = at - at[0]
    folded = bytes(data).translate(_FOLD)
    low = bytes(data).lower()  # of ASCII letters only
    raw = np.frombuffer(low, np.uint8)
    inside = _IS_WORD[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < len(raw)]
    begin[first] = inside[first]
    begins = np.flatnonzero(begin)
    bounds = np.searchsorted(begins, at)
    seeds = defaultdict(list)
    for place, n, offset in notices.hits(np.frombuffer(folded, np.uint8)):
        row = int(np.searchsorted(at, place, "right")) - 1
        if place + SEED <= at[row + 1]:
            seeds[row].append((place - int(at[row]), n, offset))
    out = []
    for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        places, labels = [], set()
        for pattern, label, rare in _phrases():
            if low.find(rare, a, b) >= 0:
                text = low[a:b]
                here = [m.start() for m in pattern.finditer(text)]
                if here:
                    labels.add(label)
                    places += (np.searchsorted(begins, np.array(here) + a) - bounds[row]).tolist()
        found = notices.find(folded[a:b], seeds[row]) if row in seeds else []
        out.append(
            {
                "n_words": int(bounds[row + 1] - bounds[row]), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": sorted(labels),
                "notices": [dict(zip(("start", "end", "label", "edits", "likeness"), x, strict=True)) for x in found],
            }
        )
    return out


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, by the contract; see scan() for nulls, empty texts and repeats."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    likeness = F.array_max(F.transform("notices", lambda n: n["likeness"]))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base_labels")).alias("base_labels"),
        joined(F.concat("base_labels", F.transform("notices", lambda n: n["label"]))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(likeness, F.lit(0.0))).alias("score"),
        F.array_join(F.transform("notices", lambda n: F.concat_ws(":", n["label"], n["start"].cast("string"), n["end"].cast("string"), n["edits"].cast("string"))), ",").alias("spans"),
    )
