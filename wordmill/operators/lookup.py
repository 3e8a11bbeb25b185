"""Lookups over lexicons as joins: completions, continuations, fuzzy neighbours, splits; and ranking of what they find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordmill.functions.edits import channel_cost, deletes, variants
from wordmill.functions.text import skeleton


def top(rows: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; the order must be total."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def continuations(bigram: DataFrame, k: int = 3) -> DataFrame:
    return top(bigram, ["w1"], [F.desc("freq"), F.asc("w2")], k)


def completions(prefixes: DataFrame, unigram: DataFrame, k: int = 3) -> DataFrame:
    """prefix, word, freq, rank: the most frequent words that begin with each prefix (itself too; the empty one finds nothing).

    Words are exploded into beginnings of the lengths that are asked for, and those joined by equality: no range join.
    """
    asked = prefixes.select("prefix").where("prefix != ''").distinct()
    lengths = asked.select(F.length("prefix").alias("n")).distinct()
    begun = unigram.crossJoin(F.broadcast(lengths)).where(F.length("word") >= F.col("n")).select(F.expr("substring(word, 1, n)").alias("prefix"), "word", "freq")
    return top(begun.join(asked, "prefix", "left_semi"), ["prefix"], [F.desc("freq"), F.asc("word")], k)


def next_words(contexts: DataFrame, bigram: DataFrame, unigram: DataFrame, k: int = 3) -> DataFrame:
    """context, word, freq, rank: what follows a context word; where nothing does, the most frequent words of all."""
    asked = contexts.select("context").distinct()
    seen = continuations(bigram.join(asked.withColumnRenamed("context", "w1"), "w1", "left_semi"), k).select(F.col("w1").alias("context"), F.col("w2").alias("word"), "freq", "rank", F.lit("bigram").alias("source"))
    common = unigram.orderBy(F.desc("freq"), "word").limit(k)
    common = common.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("freq"), "word")))
    bare = asked.join(seen.select("context").distinct(), "context", "left_anti").crossJoin(F.broadcast(common)).select("context", "word", "freq", "rank", F.lit("unigram").alias("source"))
    return seen.unionByName(bare)


def fuzzy(queries: DataFrame, unigram: DataFrame, distance: int = 1) -> DataFrame:
    """typed, word, freq, edits of all words within `distance` edits: words meet in what is left without some signs."""
    index = unigram.select("word", "freq", F.explode(deletes(F.col("word"), distance)).alias("key"))
    asked = queries.select("typed").distinct().select("typed", F.explode(deletes(F.col("typed"), distance)).alias("key"))
    met = asked.join(index, "key").select("typed", "word", "freq").distinct()
    return met.withColumn("edits", F.levenshtein("typed", "word")).where((F.col("edits") <= distance) & (F.col("typed") != F.col("word")))


def priced(found: DataFrame, most: float = 8.0) -> DataFrame:
    """With the keyboard's price of each, where it is no more than `most`."""
    return found.withColumn("cost", channel_cost("typed", "word")).where(F.col("cost") <= most)


def restored(queries: DataFrame, unigram: DataFrame) -> DataFrame:
    """Words whose skeleton is the typed word: one equi-join."""
    return queries.select("typed").distinct().join(unigram.withColumn("typed", skeleton(F.col("word"))), "typed").where("typed != word").select("typed", "word", "freq")


def variant_hits(queries: DataFrame, unigram: DataFrame, kind: str) -> DataFrame:
    """Known words among a kind of variants (edit, diacritic, gemination)."""
    return queries.select("typed").distinct().withColumn("word", F.explode(variants(kind)(F.col("typed")))).join(unigram, "word").select("typed", "word", "freq")


def splits(queries: DataFrame, unigram: DataFrame, least: int = 2, each: int = 1) -> DataFrame:
    """typed, left, right, score: both parts known words; best by the less frequent part."""
    cut = queries.select("typed").distinct().where(F.length("typed") >= 2 * least).select("typed", F.explode(F.sequence(F.lit(least), F.length("typed") - least)).alias("at"))
    cut = cut.select("typed", F.expr("substring(typed, 1, at)").alias("left"), F.expr("substring(typed, at + 1)").alias("right"))
    u = lambda k: unigram.select(F.col("word").alias(k), F.col("freq").alias(f"f_{k}"))
    both = cut.join(u("left"), "left").join(u("right"), "right").withColumn("score", F.least("f_left", "f_right"))
    return top(both, ["typed"], [F.desc("score"), F.asc("left")], each)


def compounds(queries: DataFrame, unigram: DataFrame, least: int = 3) -> DataFrame:
    """typed, modifier, head: the longest known head behind a known modifier."""
    cut = queries.select("typed").distinct().where(F.length("typed") >= 2 * least).select("typed", F.explode(F.sequence(F.lit(least), F.length("typed") - least)).alias("at"))
    cut = cut.select("typed", F.expr("substring(typed, 1, at)").alias("modifier"), F.expr("substring(typed, at + 1)").alias("head"))
    known = unigram.select("word")
    both = cut.join(known.withColumnRenamed("word", "modifier"), "modifier", "left_semi").join(known.withColumnRenamed("word", "head"), "head", "left_semi")
    return top(both, ["typed"], [F.desc(F.length("head"))], 1).drop("rank")


def pool(parts: dict[str, DataFrame], disabled: tuple[str, ...] = ()) -> DataFrame:
    """typed, word, freq, provider: what all providers found, each word once, by the first provider that had it."""
    out: DataFrame | None = None
    for place, (name, rows) in enumerate(parts.items()):
        if name not in disabled:
            rows = rows.select("typed", "word", "freq", F.lit(name).alias("provider"), F.lit(place).alias("place"))
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("all providers are disabled")
    return out.groupBy("typed", "word").agg(F.max("freq").alias("freq"), F.min(F.struct("place", "provider"))["provider"].alias("provider"))


def ranked(found: DataFrame, score: Column, k: int = 8) -> DataFrame:
    """With score, rank and, for the first, its margin to the runner-up."""
    scored = found.withColumn("score", score)
    order = Window.partitionBy("typed").orderBy(F.desc("score"), "word")
    return scored.withColumn("margin", F.col("score") - F.lead("score").over(order)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def confidence(rows: DataFrame, by: list[str], k: int = 8) -> DataFrame:
    """Softmax of the scores of the first k of each group."""
    group = Window.partitionBy(*by)
    kept = rows.where(F.col("rank") <= k).withColumn("__most", F.max("score").over(group))
    weight = F.exp(F.col("score") - F.col("__most"))
    return kept.withColumn("confidence", weight / F.sum(weight).over(group)).drop("__most")


def capped_by_splits(rows: DataFrame) -> DataFrame:
    """Compounds score no better than the worst split of the same word."""
    worst = F.min(F.when(F.col("provider") == "split", F.col("score"))).over(Window.partitionBy("typed"))
    return rows.withColumn("score", F.when((F.col("provider") == "compound") & worst.isNotNull(), F.least("score", worst)).otherwise(F.col("score")))


def suggestion_bar(rows: DataFrame, k: int = 3) -> DataFrame:
    """slot, text of each typed word: itself first, then the best others; words with digits get nothing but themselves."""
    own = rows.select("typed").distinct().select("typed", F.col("typed").alias("text"), F.lit(0).alias("o"))
    more = rows.where(~F.col("typed").rlike("[0-9]") & (F.col("word") != F.col("typed"))).select("typed", F.col("word").alias("text"), F.col("rank").alias("o"))
    return top(own.unionByName(more), ["typed"], [F.asc("o"), F.asc("text")], k, "slot").drop("o")
