"""A lower-casing word-BPE tokenizer over whole Arrow batches.

The vocabulary file is one for the ``tokenizers`` library: NFC, lower case, pieces of letters, single numbers or other
signs, white space dropped, BPE with a word-end sign. Pieces are cut and hashed by numpy; each distinct piece meets BPE
once per Python worker, in a byte-pair encoder that gets the word end as a NUL byte. The two encoders give the same ids
because every merged token, encoded alone, gives itself (``tests/llm/test_tokens.py`` holds them against each other).
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from wordmill.llm import vec

#: Distinct pieces that a worker remembers; beyond them it starts anew.
REMEMBERED = 300_000
_APOSTROPHE = 0x27


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordBpe:
    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end, of = model["end_of_word_suffix"], byte_letters()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocab: dict[str, int] = model["vocab"]
        bytes_of = lambda t: bytes(of[c] for c in t.removesuffix(end)) + b"\0" * t.endswith(end)
        ranks, ids = {}, []
        for t in [*of, *(c + end for c in of), *(a + b for a, b in merges)]:
            if (raw := bytes_of(t)) not in ranks:
                ranks[raw] = len(ids)
                ids.append(vocab[t])
        self.ids = np.array(ids, np.uint32)
        self.closes = np.array([len(raw) > 1 and raw.endswith(b"\0") for raw in ranks], bool)
        self.bpe = tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={})
        self.forget()

    @functools.cached_property
    def exact(self):
        """The tokenizer of the library, which few texts need: it is loaded for the first of them."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def forget(self) -> None:
        self.keys, self.slots = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)
        self.n, self.used = 0, 0
        self.begin, self.count, self.pool = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32), np.zeros(1 << 16, np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of every key, -1 where there is none."""
        mask = np.uint64(len(self.keys) - 1)
        at = keys & mask
        seen = self.keys[at]
        out = np.where(seen == keys, self.slots[at], -1)
        left = np.flatnonzero((seen != keys) & (seen != 0))
        while len(left):
            at_left = (at[left] + np.uint64(1)) & mask
            at[left] = at_left
            seen = self.keys[at_left]
            hit = seen == keys[left]
            out[left[hit]] = self.slots[at_left[hit]]
            left = left[~hit & (seen != 0)]
        return out

    def put(self, keys: np.ndarray, entries: np.ndarray) -> None:
        """Keys that aren't there yet, each once."""
        mask, left = np.uint64(len(self.keys) - 1), np.arange(len(keys))
        at = keys & mask
        while len(left):
            free = self.keys[at[left]] == 0
            one = left[free]
            self.keys[at[one]] = keys[one]  # of those that meet in a slot, the last stays
            own = one[self.keys[at[one]] == keys[one]]
            self.slots[at[own]] = entries[own]
            done = np.zeros(len(keys), bool)
            done[own] = True
            left = left[~done[left]]
            at[left] = (at[left] + np.uint64(1)) & mask

    def learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Encodes pieces that are new."""
        odd = [i for i, p in enumerate(pieces) if "\0" in p]
        if odd:
            kept = [p if "\0" not in p else "a" for p in pieces]
        else:
            kept = pieces
        ranks = np.array(self.bpe.encode_ordinary("\0".join(kept) + "\0"), np.int64)
        ids, ends = self.ids[ranks], np.flatnonzero(self.closes[ranks]) + 1
        begins = np.concatenate([[0], ends[:-1]])
        counts = ends - begins
        if odd:
            parts = [ids[a:b] for a, b in zip(begins, ends, strict=True)]
            for i in odd:
                parts[i] = np.array(self.exact.encode(pieces[i], add_special_tokens=False).ids, np.uint32)
            counts = np.array([len(p) for p in parts])
            begins, ids = np.concatenate([[0], np.cumsum(counts)[:-1]]), np.concatenate(parts)
        need = self.n + len(keys)
        if need > len(self.begin):
            room = max(2 * len(self.begin), need)
            self.begin, self.count = np.resize(self.begin, room), np.resize(self.count, room)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, max(2 * len(self.pool), self.used + len(ids)))
        entries = np.arange(self.n, need, dtype=np.int32)
        self.begin[self.n : need], self.count[self.n : need] = begins + self.used, counts
        self.pool[self.used : self.used + len(ids)] = ids
        self.n, self.used = need, self.used + len(ids)
        if 2 * self.n > len(self.keys):
            old = self.keys != 0
            old_keys, old_slots = self.keys[old], self.slots[old]
            size = 1 << int(4 * self.n - 1).bit_length()
            self.keys, self.slots = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self.put(old_keys, old_slots)
        self.put(keys, entries)

    def pieces(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every piece of normalised text."""
        kind = vec.classes()[points]
        kind[kind == vec.MARK] = vec.OTHER
        begin = np.ones(len(points), bool)
        if len(points):
            np.not_equal(kind[1:], kind[:-1], out=begin[1:])
            begin |= kind == vec.NUMBER
            begin[offsets[:-1][offsets[:-1] < len(points)]] = True
            quotes = np.flatnonzero((points == _APOSTROPHE) & begin)
            quotes = quotes[quotes + 1 < len(points)]
            if len(quotes):
                last = offsets[1:][np.searchsorted(offsets, quotes, "right") - 1]
                pad = np.concatenate([points, [0, 0]])
                a, b = pad[quotes + 1], pad[quotes + 2]
                one = np.isin(a, [ord(c) for c in "stmd"]) & (quotes + 1 < last)
                two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & (quotes + 2 < last)
                for hit, k in ((quotes[one], 1), (quotes[two], 2)):
                    begin[hit + 1] = False
                    after = hit + 1 + k
                    begin[after[after < len(points)]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(points))
        own = kind[starts] != vec.SPACE
        return starts[own], ends[own]

    def normal(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """NFC and lower case, letter by letter."""
        if len(points) and points.max() >= 0x300 or (points == 0x130).any():
            text = points.tobytes().decode("utf-32-le")
            if "İ" in text or not unicodedata.is_normalized("NFC", text):
                texts = [unicodedata.normalize("NFC", text[a:b]).replace("İ", "i̇") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        return vec.lowered()[points], offsets

    @staticmethod
    def is_odd(points: np.ndarray) -> bool:
        """Whether there are code points that Python and the tokenizer may class differently."""
        return bool(len(points) and points.max() >= 0x370 and vec.unassigned()[points].any())

    def entries(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of every piece."""
        keys = vec.segment_hashes(vec.char_values()[points], starts, ends) | np.uint64(1)
        found = self.find(keys)
        if len(new := np.flatnonzero(found < 0)):
            fresh, first = np.unique(keys[new], return_index=True)
            first = new[first]
            if self.n and self.n + len(fresh) > REMEMBERED:
                self.forget()
                fresh, first = np.unique(keys, return_index=True)
            text = points.tobytes().decode("utf-32-le")
            self.learn(fresh, [text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            found = self.find(keys)
        return found

    def counts(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Normalised code points, their offsets, starts of pieces and how many ids each piece has."""
        points, offsets = self.normal(points, offsets)
        starts, ends = self.pieces(points, offsets)
        entry = self.entries(points, starts, ends)  # may replace self.count
        return points, offsets, starts, self.count[entry]

    def encode(self, column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, ids of all texts in a row, where each text's ids begin, with the end)."""
        for lo, hi, points, offsets in vec.steps(column):
            if self.is_odd(points):
                texts = column[lo:hi].to_pylist()
                ids = [self.exact.encode(t or "", add_special_tokens=False).ids for t in texts]
                yield lo, hi, np.array([i for x in ids for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
                continue
            points, offsets = self.normal(points, offsets)
            starts, ends = self.pieces(points, offsets)
            entry = self.entries(points, starts, ends)
            count = self.count[entry].astype(np.int64)
            stop = np.cumsum(count)
            total = int(stop[-1]) if len(stop) else 0
            at = np.arange(total) + np.repeat(self.begin[entry] - (stop - count), count)
            bounds = np.concatenate([[0], stop])[np.searchsorted(starts, offsets)]
            yield lo, hi, self.pool[at], bounds


@functools.cache
def word_bpe(path: str) -> WordBpe:
    """One for each Python worker and file."""
    return WordBpe(path)
