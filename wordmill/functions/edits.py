"""Edit distances, edit categories, and the variants of a word that lookups try."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmill.functions.text import category_base

ROWS = ("qwertyuiopð", "asdfghjklæö", "zxcvbnmþ")
SHIFT = (0.0, 0.5, 0.75)
INSERT, DELETE, SWAP, UNKNOWN, CONFUSED, SIGMA, LEAST, MOST = 4.0, 4.0, 2.0, 5.0, 1.5, 0.7, 0.35, 8.0
CONFUSIONS = {frozenset(p) for p in ("aá", "eé", "ií", "oó", "uú", "yý", "dð", "tþ", "oö", "aæ", "iy", "íý")}
KEYS = {c: (i + SHIFT[r], float(r)) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
ALPHABET = "abcdefghijklmnopqrstuvwxyzáéíóúýþæöð"


def substitution(a: str, b: str) -> float:
    """The price of one key for another: by distance, within bounds; pairs that hands or spelling confuse are cheap."""
    if a == b:
        return 0.0
    if frozenset((a, b)) in CONFUSIONS:
        return CONFUSED
    if a not in KEYS or b not in KEYS:
        return UNKNOWN
    (x, y), (u, v) = KEYS[a], KEYS[b]
    return min(MOST, max(LEAST, ((x - u) ** 2 + (y - v) ** 2) / (2 * SIGMA**2)))


def channel(typed: str, word: str) -> float:
    """Restricted Damerau distance under those prices."""
    if not typed or not word:
        return INSERT * max(len(typed), len(word))
    before, last = None, [INSERT * j for j in range(len(word) + 1)]
    for i, a in enumerate(typed, 1):
        row = [DELETE * i]
        for j, b in enumerate(word, 1):
            best = min(last[j - 1] + substitution(a, b), last[j] + DELETE, row[j - 1] + INSERT)
            if before is not None and i > 1 and j > 1 and a == word[j - 2] and typed[i - 2] == b and a != b:
                best = min(best, before[j - 2] + SWAP)
            row.append(best)
        before, last = last, row
    return last[-1]


@F.pandas_udf(T.DoubleType())
def channel_cost(typed: pd.Series, word: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or w is None else channel(t, w) for t, w in zip(typed, word, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def completion_cost(typed: pd.Series, word: pd.Series) -> pd.Series:
    """The cheapest of: the whole word, or one of its beginnings and half a point for each sign that follows."""
    return pd.Series([None if t is None or w is None else min(channel(t, w[:k]) + 0.5 * (len(w) - k) for k in range(max(1, len(t) - 1), len(w) + 1)) if len(w) >= max(1, len(t) - 1) else channel(t, w) for t, w in zip(typed, word, strict=True)], dtype="float64")


@F.pandas_udf(T.IntegerType())
def rewrite_distance(typed: pd.Series, word: pd.Series) -> pd.Series:
    """Levenshtein distance in which restored letters and apostrophes are free."""
    fold = str.maketrans("áéíóúýðþö", "aeiouydto")

    def of(a: str, b: str) -> int:
        a, b = a.replace("'", "").translate(fold), b.replace("'", "").translate(fold)
        last = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row = [i]
            for j, d in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
            last = row
        return last[-1]

    return pd.Series([None if t is None or w is None else of(t, w) for t, w in zip(typed, word, strict=True)], dtype="Int32")


def common_prefix(a: Column, b: Column) -> Column:
    """How many first signs are equal."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, F.array_max(F.transform(F.sequence(F.lit(0), n), lambda k: F.when(F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k), k).otherwise(0)))).otherwise(0)


def is_plausible(typed: Column, word: Column) -> Column:
    """Whether one word may be meant by the other, whatever the case: half of the shorter one is shared, or few edits lie between.

    Equal words are no edit; words of one or two signs that begin otherwise and differ by more than one edit are none either.
    """
    a, b = F.lower(typed), F.lower(word)
    less, more = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    shared, far = common_prefix(a, b), F.levenshtein(a, b)
    return (a != b) & ~((less <= 2) & (shared == 0) & (far > 1)) & ((2 * shared >= less) | (far <= F.greatest(F.lit(2), F.floor(more / 3))))


def is_inflection(a: Column, b: Column) -> Column:
    """Words of one stem, whatever the case: four signs and three fifths of the longer shared, endings of one to five signs in both."""
    a, b = F.lower(a), F.lower(b)
    stem = common_prefix(a, b)
    tail = lambda w: (F.length(w) - stem).between(1, 5)
    return (a != b) & (stem >= 4) & (stem >= 0.6 * F.greatest(F.length(a), F.length(b))) & tail(a) & tail(b)


def _doubled(short: Column, long: Column) -> Column:
    """Whether the sign that the long word has more stands beside an equal one."""
    return F.exists(F.sequence(F.lit(2), F.length(long)), lambda k: (F.substring(long, k, F.lit(1)) == F.substring(long, k - 1, F.lit(1))) & (F.concat(F.substring(long, F.lit(1), k - 1), F.substring(long, k + 1, F.length(long))) == short))


def _one_less(short: Column, long: Column) -> Column:
    return F.exists(F.sequence(F.lit(1), F.length(long)), lambda k: F.concat(F.substring(long, F.lit(1), k - 1), F.substring(long, k + 1, F.length(long))) == short)


def category(typo: Column, meant: Column) -> Column:
    """What kind of slip leads from the word that was meant to the typo, whatever the case."""
    typo, meant = F.lower(typo), F.lower(meant)
    n, m = F.length(typo), F.length(meant)
    signs = lambda w: F.array_sort(F.split(w, ""))
    return (
        F.when((typo == "") | (meant == "") | (typo == meant), "other")
        .when(typo.rlike("['’]") | meant.rlike("['’]"), "contraction_damage").when(typo.contains(" ") | meant.contains(" "), "space_miss")
        .when(category_base(typo) == category_base(meant), "accent_drop")
        .when(n == m, F.when(signs(typo) == signs(meant), "transposition").otherwise("substitution"))
        .when((n == m - 1) & _one_less(typo, meant), F.when(_doubled(typo, meant), "gemination").otherwise("deletion"))
        .when((n == m + 1) & _one_less(meant, typo), F.when(_doubled(meant, typo), "gemination").otherwise("insertion"))
        .otherwise("substitution")
    )


def deletes(word: Column, distance: int = 1) -> Column:
    """The word and what is left of it without up to `distance` signs: near words share one of these."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, F.length(w))))
    out = F.array(word)
    step = F.array(word)
    for _ in range(distance):
        step = F.array_distinct(F.flatten(F.transform(F.filter(step, lambda w: F.length(w) > 0), one)))
        out = F.array_distinct(F.concat(out, step))
    return out


def edits1(word: str) -> list[tuple[str, float]]:
    """All words one edit away and what the edit costs (the cheapest way to each)."""
    out: dict[str, float] = {}

    def put(w: str, cost: float) -> None:
        if w and w != word and cost < out.get(w, np.inf):
            out[w] = cost

    for i in range(len(word) + 1):
        a, b = word[:i], word[i:]
        if b:
            put(a + b[1:], DELETE)
        if len(b) > 1 and b[0] != b[1]:
            put(a + b[1] + b[0] + b[2:], SWAP)
        for c in ALPHABET:
            if b:
                put(a + c + b[1:], substitution(b[0], c))
            put(a + c + b, INSERT)
    return sorted(out.items())


#: Letters that stand for each other without a slip of the hand.
TWINS = {a: {b for p in CONFUSIONS if a in p for b in p if b != a} for a in {c for p in CONFUSIONS for c in p}}


def adjacent(reach: float = 1.25) -> list[tuple[str, str]]:
    """Pairs of keys whose middles lie no farther apart than `reach`."""
    return sorted((a, b) for a, (x, y) in KEYS.items() for b, (u, v) in KEYS.items() if a != b and (x - u) ** 2 + (y - v) ** 2 <= reach**2)


NEAR = {a: {c for b, c in adjacent() if b == a} for a in KEYS}


def cheap_edits(word: str) -> list[str]:
    """Words one cheap edit away: a neighbouring key or a twin, a sign left out, two swapped, or any sign put in."""
    out = {word[:i] + c + word[i + 1 :] for i, k in enumerate(word) for c in NEAR.get(k, set()) | TWINS.get(k, set())}
    out |= {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in ALPHABET}
    return sorted(out - {word})


def restorations(word: str, most: int = 3) -> list[str]:
    """Words that up to three letters, typed without their mark, may stand for."""
    marks = {"a": "áæ", "e": "é", "i": "í", "o": "óö", "u": "ú", "y": "ý", "d": "ð", "t": "þ"}
    found, front = {word}, {word}
    for _ in range(most):
        front = {w[:i] + m + w[i + 1 :] for w in front for i, c in enumerate(w) for m in marks.get(c, "")} - found
        found |= front
    return sorted(found - {word})


def geminations(word: str) -> list[str]:
    """The word with one sign doubled, or one of a double taken."""
    out = {word[:i] + word[i] + word[i:] for i in range(len(word))} | {word[:i] + word[i + 1 :] for i in range(1, len(word)) if word[i] == word[i - 1]}
    return sorted(out - {word})


VARIANTS = {"edit": lambda w: [c for c, _ in edits1(w)], "diacritic": restorations, "gemination": geminations, "cheap": cheap_edits}


def variants(kind: str):
    """A column function: all variants of one kind."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def of(word: pd.Series) -> pd.Series:
        return word.map(VARIANTS[kind], na_action="ignore")

    return of


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("old", T.StringType()), T.StructField("new", T.StringType())])))
def word_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """Words that took another's place: the replaced stretches of a diff, paired in order of likeness."""
    from difflib import SequenceMatcher

    def of(a: str, b: str) -> list[dict]:
        x, y = (a or "").split(), (b or "").split()
        out = []
        for tag, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            if tag != "replace":
                continue
            ranked = sorted((-SequenceMatcher(None, x[p], y[q]).ratio(), abs((p - i) - (q - k)), p, q) for p in range(i, j) for q in range(k, m))
            used: set[tuple[str, int]] = set()
            pairs = []
            for _, _, p, q in ranked:
                if ("x", p) not in used and ("y", q) not in used:
                    used |= {("x", p), ("y", q)}
                    pairs.append((p, q))
            out += [{"old": x[p], "new": y[q]} for p, q in sorted(pairs)]
        return out

    return pd.Series([of(a, b) for a, b in zip(before, after, strict=True)])
