"""Signatures of shingles whose equal places estimate a likeness: MinHash for sets, BagMinHash for multisets."""

from __future__ import annotations

import numpy as np

from wordmill.llm import vec

PLACES = 128
#: Places in a band of a text: at a likeness of 0.8, 32 bands of 4 miss a pair once in 20 million.
ROWS = 4
_STEP = np.uint64(0x9E3779B97F4A7C15)


def permutations(places: int = PLACES, seed: int = 20_240_601) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of universal hash functions."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, places, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, places, np.uint64)


def minhash(h: np.ndarray, own: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """n rows of the least value of each permutation over a text's shingles; rows of texts without any stay all ones."""
    out = np.full((n, places), 0xFFFFFFFF, np.uint32)
    if len(h):
        first = np.flatnonzero(np.diff(own, prepend=-1))
        rows = own[first]
        for p, (a, b) in enumerate(zip(*permutations(places), strict=True)):
            out[rows, p] = np.minimum.reduceat((h * a + b) >> np.uint64(32), first)
    return out


def weights(h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each shingle of each text once, with its count, text by text."""
    key = vec.mix(h + own.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    at = order[first]
    back = np.argsort(at)
    return h[at][back], own[at][back], count[back]


def bag_minhash(h: np.ndarray, own: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """n rows of 32-bit marks; two rows agree in a place with the probability of their bags' weighted Jaccard likeness.

    A shingle of weight w owns the points of a Poisson process over time and the weights up to w, each with a place drawn
    by hash; a place keeps the mark of its earliest point. Weights are split at 1, 2, 4, ...: each interval up to w has
    one process for all its weights, whose points above w don't count. A text looks at times up to a limit by which its
    places have all been met, nearly always, and twice as far where not.
    """
    marks = np.zeros((n, places), np.uint32)
    if not len(h):
        return marks
    h, own, w = weights(h, own)
    levels = np.zeros(len(w), np.int64)
    big = w > 1
    levels[big] = np.ceil(np.log2(w[big])).astype(np.int64)
    row = np.repeat(np.arange(len(w)), levels + 1)
    level = np.arange(len(row)) - np.repeat(np.cumsum(levels + 1) - levels - 1, levels + 1)
    text, top = own[row], w[row]
    rate = np.where(level == 0, 1.0, 2.0 ** (level - 1.0))
    base = np.where(level == 0, 0.0, rate)
    seed = vec.mix(h[row] + (level + 1).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    total = np.bincount(own, w, n)
    limit = places * (np.log(places) + 3) / np.maximum(total, 1)
    earliest = np.full(n * places, np.inf)
    flat = marks.reshape(-1)
    time, step = np.zeros(len(row)), np.zeros(len(row), np.int64)
    live = np.arange(len(row))
    while len(live):
        ahead = live
        while len(ahead):
            expected = np.ceil(rate[ahead] * (limit[text[ahead]] - time[ahead])).astype(np.int64)
            many = np.maximum(1, np.minimum(expected, 4096))
            end = np.cumsum(many)
            begin = end - many
            at = np.repeat(ahead, many)
            k = np.arange(len(at)) - np.repeat(begin, many) + np.repeat(step[ahead], many) + 1
            bits = vec.mix(seed[at] + k.astype(np.uint64) * _STEP)
            gap = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[at]
            run = np.cumsum(gap)
            x = run - np.repeat(run[begin] - gap[begin], many) + np.repeat(time[ahead], many)
            more = vec.mix(bits ^ np.uint64(0x5851F42D4C957F2D))
            weight = base[at] + np.floor((more >> np.uint64(40)).astype(np.float64) * 2.0**-24 * rate[at]) + 1
            good = (x <= limit[text[at]]) & (weight <= top[at])
            slot = text[at[good]] * places + ((more[good] & np.uint64(0xFFFFFF)) % np.uint64(places)).astype(np.int64)
            np.minimum.at(earliest, slot, x[good])
            won = earliest[slot] == x[good]
            flat[slot[won]] = (bits[good][won] & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
            early = x <= limit[text[at]]
            kept = np.add.reduceat(early, begin, dtype=np.int64)  # what comes later is drawn again if the limit grows
            some = kept > 0
            time[ahead[some]] = x[(begin + kept - 1)[some]]
            step[ahead] += kept
            ahead = ahead[kept == many]
        missed = np.isinf(earliest.reshape(n, places)).any(axis=1) & (total > 0)
        limit[missed] *= 2
        live = live[missed[text[live]]]
    return marks


def bands(marks: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each run of `rows` places, different from band to band."""
    n, places = marks.shape
    parts = marks.reshape(n, places // rows, rows).astype(np.uint64)
    out = np.arange(1, places // rows + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.zeros((n, 1), np.uint64)
    for k in range(rows):
        out = vec.mix(out * _STEP + parts[:, :, k])
    return out


def band_keys(marks: np.ndarray) -> np.ndarray:
    """A 64-bit key for each run of ROWS places, of 16 bits of each; places() reads them again."""
    n, count = marks.shape
    packed = np.ascontiguousarray(marks.astype("<u2")).view("<u8").reshape(n, count // ROWS).astype(np.uint64)
    return vec.mix(packed + np.arange(1, count // ROWS + 1, dtype=np.uint64) * _STEP)


def places(keys: np.ndarray) -> np.ndarray:
    """The 16 bits of every place, of rows of band_keys()."""
    packed = vec.unmix(keys) - np.arange(1, keys.shape[1] + 1, dtype=np.uint64) * _STEP
    return np.ascontiguousarray(packed.astype("<u8")).view("<u2").reshape(len(keys), -1)
