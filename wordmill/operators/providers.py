"""Candidate providers over one lexicon (word, freq), each giving typed, word, freq; and whether the best candidate is applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordmill.functions.model import SETTINGS, Settings
from wordmill.functions.text import skeleton

#: Words that are never written as one, and how they are.
NEVER_COMPOUNDS = {
    "margskonar": "margs konar", "afturábak": "aftur á bak", "afþvíað": "af því að", "annarstaðar": "annars staðar", "fjögurhundruð": "fjögur hundruð",
    "mikilsháttar": "mikils háttar", "niðrá": "niður á", "níuhundruð": "níu hundruð", "samskonar": "sams konar", "seinnihluta": "seinni hluta",
}


def _cut(a: Column | str, begin, length=None) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    return F.substring(a, F.lit(begin) if isinstance(begin, int) else begin, F.length(a) if length is None else F.lit(length) if isinstance(length, int) else length)


def dedoubled(word: Column) -> Column:
    """The word with one sign of a double taken, for each double."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), lambda i: (i < F.length(word)) & (_cut(word, i, 1) == _cut(word, i + 1, 1)))
    return F.array_distinct(F.transform(at, lambda i: F.concat(_cut(word, 1, i), _cut(word, i + 2))))


def doubled(word: Column) -> Column:
    """The word with one sign doubled, for each sign."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(_cut(word, 1, i), _cut(word, i))))


def gemination(typed: DataFrame, lexicon: DataFrame) -> DataFrame:
    tried = typed.select("typed").distinct().select("typed", F.explode(F.array_distinct(F.concat(doubled(F.col("typed")), dedoubled(F.col("typed"))))).alias("word"))
    return tried.where("word != typed").join(lexicon, "word").select("typed", "word", "freq")


def gemination_restoration(typed: DataFrame, lexicon: DataFrame, most: int = 2) -> DataFrame:
    """Words that restore up to `most` letters of the token without one of its doubled signs."""
    tried = typed.select("typed").distinct().select("typed", F.explode(dedoubled(F.col("typed"))).alias("base"))
    found = tried.join(lexicon.withColumn("base", skeleton(F.col("word"))), "base").where("word != base AND word != typed")
    changes = F.size(F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: _cut("word", i, 1) != _cut("base", i, 1)))
    return found.where(changes <= most).select("typed", "word", "freq").distinct()


def _begun(typed: DataFrame, lexicon: DataFrame, prefixes: Column, key: Column, k: int) -> DataFrame:
    """The k most frequent words that begin, by key, with one of each token's prefixes; an equality on prefix and its length."""
    asked = typed.select("typed").distinct().select("typed", F.explode(prefixes).alias("prefix"))
    lengths = asked.select(F.length("prefix").alias("n")).distinct()
    words = lexicon.withColumn("key", key).crossJoin(F.broadcast(lengths)).where(F.length("key") >= F.col("n")).select(F.expr("substring(key, 1, n)").alias("prefix"), "word", "freq")
    words = words.join(asked.select("prefix").distinct(), "prefix", "left_semi")
    top = words.withColumn("r", F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("freq"), "word"))).where(F.col("r") <= k)
    return asked.join(top, "prefix").where("word != typed").select("typed", "word", "freq").distinct()


def _shorter(longest: Column) -> Column:
    least = F.greatest(F.lit(3), F.length("typed") - 4)
    return F.transform(F.sequence(least, F.greatest(least, longest)), lambda n: _cut("typed", 1, n))


def shorter_prefixes(typed: DataFrame, lexicon: DataFrame, close: DataFrame, k: int = 8) -> DataFrame:
    """Completions of what is left of tokens of five signs or more without up to four of them, if nothing close was found (typed)."""
    far = typed.where(F.length("typed") >= 5).select("typed").distinct().join(close.select("typed").distinct(), "typed", "left_anti")
    return _begun(far, lexicon, _shorter(F.length("typed") - 1), F.col("word"), k)


def diacritic_prefixes(typed: DataFrame, lexicon: DataFrame, attested: DataFrame, k: int = 8) -> DataFrame:
    """Words whose skeleton begins as such a token or its beginnings do, if no known word was found close to it (typed)."""
    far = typed.where(F.length("typed") >= 5).select("typed").distinct().join(attested.select("typed").distinct(), "typed", "left_anti")
    return _begun(far, lexicon.where(skeleton(F.col("word")) != F.col("word")), _shorter(F.length("typed")), skeleton(F.col("word")), k)


def personal_completions(typed: DataFrame, personal: DataFrame, k: int = 8) -> DataFrame:
    """The k words of a personal vocabulary (word, freq) used most that the token begins."""
    return _begun(typed, personal, F.array("typed"), F.col("word"), k)


def dotted(tokens: DataFrame, lexicon: DataFrame, endings: tuple[str, ...]) -> DataFrame:
    """typed, word, freq: tokens `a.b` of two known words, not an address, as two words; freq is that of the rarer one."""
    parts = tokens.select("typed").distinct().where(F.col("typed").rlike(r"^\p{L}+\.\p{L}+$")).withColumn("a", F.split_part(F.lower("typed"), F.lit("."), F.lit(1))).withColumn("b", F.split_part(F.lower("typed"), F.lit("."), F.lit(2)))
    known = lambda c, f: lexicon.select(F.col("word").alias(c), F.col("freq").alias(f))
    found = parts.where(~F.col("b").isin(*endings)).join(known("a", "fa"), "a").join(known("b", "fb"), "b")
    return found.select("typed", F.concat_ws(" ", "a", "b").alias("word"), F.least("fa", "fb").alias("freq"))


def never_compound(typed: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """typed, word: how a word that is never one is written."""
    rows = typed.sparkSession.createDataFrame(list((NEVER_COMPOUNDS if table is None else table).items()), "typed string, word string")
    return typed.select("typed").distinct().join(F.broadcast(rows), "typed")


def applies(typed: Column, best: Column, margin: Column, cost: Column, z: Column, rewrite: Column, single: Column, s: Settings = SETTINGS) -> Column:
    """Whether the best candidate of an unknown token replaces it by itself.

    Length, cost and kept apostrophes and quotation marks come first. A split needs a raised margin and no single word
    within a close cost; a word needs the margin, three times of it if it is hardly known, and to be common enough: more
    so far from what was typed, or for very short tokens, which are never completed.
    """
    kept = lambda signs: F.length(F.regexp_replace(typed, f"[^{signs}]", "")) <= F.length(F.regexp_replace(best, f"[^{signs}]", ""))
    first = (F.length(typed) >= 2) & (cost <= s.most_cost) & kept("'’") & kept('"“”„«»‹›')
    short = F.length(typed) <= 2
    least = F.greatest(F.lit(s.least_z), F.when(rewrite >= s.far_edits, 0.0).otherwise(s.least_z), F.when(short, 1.5).otherwise(s.least_z))
    need = F.when(z < s.junk_z, s.margin * s.junk_factor).otherwise(s.margin)
    gap = F.coalesce(margin, F.lit(float("inf")))
    longer = short & (F.length(best) > F.length(typed)) & best.startswith(typed)
    split = (gap >= s.split_margin) & (F.coalesce(single, F.lit(float("inf"))) > s.split_margin)
    return first & (typed != best) & F.when(best.contains(" "), split).otherwise((gap >= need) & (z >= least) & ~longer)
