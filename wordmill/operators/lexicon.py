"""Building lexicons from counts: sums, prunes, repairs, scales, and what governs which case."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordmill.functions.text import strip_all_accents, words
from wordmill.operators.paircount import dealt, followed, totals


def tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each word of each text: the other columns, and w."""
    return docs.withColumn("w", F.explode(words(F.col(text)))).drop(text)


def pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each two words that follow each other in a text: w1, w2."""
    listed = docs.select(words(F.col(text)).alias("ws")).where(F.size("ws") > 1)
    both = F.zip_with(F.expr("slice(ws, 1, size(ws) - 1)"), F.expr("slice(ws, 2, size(ws) - 1)"), lambda a, b: F.struct(a.alias("w1"), b.alias("w2")))
    return listed.select(F.explode(both).alias("p")).select("p.w1", "p.w2")


def unigrams(docs: DataFrame) -> DataFrame:
    return tokens(docs.select("text")).groupBy(F.col("w").alias("word")).agg(F.count("*").alias("freq"))


def bigrams(docs: DataFrame) -> DataFrame:
    return followed(dealt(docs)).select("w1", "w2", "freq")


def counted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """bigrams(), with n1, how often w1 stands in all, and unigrams() of the same texts, which are cut into words once for both."""
    blobs = dealt(docs)
    return followed(blobs), totals(blobs)


def _looked_up(each: DataFrame) -> DataFrame:
    """One row a key, to be held by its hash while a larger table streams by unsorted."""
    return each.hint("shuffle_hash")


def keep_known(bigram: DataFrame, unigram: DataFrame, by: tuple[str, ...] = ("w1", "w2")) -> DataFrame:
    """Bigrams both of whose words (or those that `by` names) are in the unigram table."""
    for k in by:
        bigram = bigram.join(_looked_up(unigram.select(F.col("word").alias(k))), k, "left_semi")
    return bigram.select("w1", "w2", "freq")


def fan_out(bigram: DataFrame) -> DataFrame:
    """Totals by first word, by second word and by pair, in one pass; side tells which."""
    return bigram.groupingSets([["w1"], ["w2"], ["w1", "w2"]], "w1", "w2").agg(F.grouping_id().alias("g"), F.sum("freq").alias("total")).select(F.when(F.col("g") == 1, "first").when(F.col("g") == 2, "second").otherwise("pair").alias("side"), "w1", "w2", "total")


def accent_dominated(unigram: DataFrame, ratio: float = 10.0, fold: Callable[[Column], Column] = strip_all_accents) -> DataFrame:
    """Bare words that go because an accented one is `ratio` times as frequent or more."""
    folded = unigram.select(fold(F.col("word")).alias("bare"), "word", "freq").where("word != bare").groupBy("bare").agg(F.max("freq").alias("most"))
    return unigram.join(folded.withColumnRenamed("bare", "word"), "word").where(F.col("most") >= ratio * F.col("freq")).select("word", "freq", "most")


def prune_unlisted(unigram: DataFrame, members: DataFrame, top: int, often: int) -> DataFrame:
    """All member words; of the others the `top` most frequent and those that occur `often`.

    The top ones are found by counting back from the frequency that the rank falls on, so no window holds all words.
    """
    other = unigram.join(members.select("word"), "word", "left_anti")
    cut = other.orderBy(F.desc("freq"), "word").limit(top).agg(F.min("freq").alias("edge_freq"), F.max(F.struct(-F.col("freq"), "word"))["word"].alias("edge_word"))
    kept = other.crossJoin(F.broadcast(cut)).where((F.col("freq") >= often) | (F.col("freq") > F.col("edge_freq")) | (F.col("freq") == F.col("edge_freq")) & (F.col("word") <= F.col("edge_word")))
    return unigram.join(members.select("word"), "word", "left_semi").unionByName(kept.select("word", "freq"))


def scale(unigram: DataFrame, most: int) -> DataFrame:
    """Frequencies divided by the whole number that brings the largest to `most`, and at least 1."""
    divisor = unigram.agg(F.greatest(F.lit(1), F.ceil(F.max("freq") / F.lit(most))).alias("d"))
    return unigram.crossJoin(F.broadcast(divisor)).select("word", F.greatest(F.lit(1), F.floor(F.col("freq") / F.col("d"))).cast("long").alias("freq"))


def transfer(phrases: DataFrame, unigram: DataFrame, bigram: DataFrame) -> DataFrame:
    """What a contraction (word, w1, w2; pair, its words' own count, is looked up where that column is missing) should count, by its two words: at least what it does.

    The less of f(w1) * share of w2 after w1 and f(w2) * share of w1 before w2, rounded to even; without one the other.
    """
    first, second = bigram.groupBy("w1").agg(F.sum("freq").alias("fan1")), bigram.groupBy("w2").agg(F.sum("freq").alias("fan2"))
    u = lambda k, n: unigram.select(F.col("word").alias(k), F.col("freq").alias(n))
    paired = phrases if "pair" in phrases.columns else phrases.join(bigram.withColumnRenamed("freq", "pair"), ["w1", "w2"], "left")
    joined = paired.join(first, "w1", "left").join(second, "w2", "left").join(u("w1", "f1"), "w1", "left").join(u("w2", "f2"), "w2", "left").join(u("word", "old"), "word", "left")
    one, two = F.col("f1") * F.col("pair") / F.col("fan1"), F.col("f2") * F.col("pair") / F.col("fan2")
    guess = F.least(F.when(one > 0, one), F.when(two > 0, two))
    return joined.select("word", F.coalesce("old", F.lit(0)).alias("old"), F.greatest(F.coalesce("old", F.lit(0)), F.coalesce(F.bround(guess), F.lit(0)).cast("long")).alias("freq"))


def backfill(unigram: DataFrame, extra: DataFrame) -> DataFrame:
    """Words that are missing, at half of the frequency of what stands for them (word, stand_in)."""
    new = extra.join(unigram.select("word"), "word", "left_anti").join(unigram.select(F.col("word").alias("stand_in"), "freq"), "stand_in")
    return unigram.unionByName(new.select("word", F.greatest(F.lit(1), F.floor(F.col("freq") / 2)).cast("long").alias("freq")))


def floors(unigram: DataFrame, floor: DataFrame) -> DataFrame:
    """At least the floor of each word that has one (word, least)."""
    return unigram.join(floor, "word", "full").select("word", F.greatest(F.coalesce("freq", F.lit(0)), F.coalesce("least", F.lit(0))).cast("long").alias("freq"))


def governors(bigram: DataFrame, analyses: DataFrame, least_mass: float = 50, most_ratio: float = 0.9) -> DataFrame:
    """Words whose next word's class is narrow: word, mass, ratio, class, share (analyses: word, class, several of a word split its count)."""
    held = analyses.groupBy("word").agg(F.collect_set("class").alias("classes"))
    split = held.select(F.col("word").alias("w2"), "classes", F.size("classes").alias("k"))
    credit = bigram.join(_looked_up(split), "w2").select("w1", F.explode("classes").alias("class"), (F.col("freq") / F.col("k")).alias("part")).groupBy("w1", "class").agg(F.sum("part").alias("credit"))
    total = credit.groupBy("w1").agg(F.sum("credit").alias("mass"), F.count("*").alias("n")).where(F.col("mass") >= least_mass)
    share = credit.join(total, "w1").withColumn("share", F.col("credit") / F.col("mass"))
    entropy = share.groupBy("w1").agg((-F.sum(F.col("share") * F.log2("share"))).alias("h"), F.first("n").alias("n"))
    ratio = entropy.select("w1", F.when(F.col("n") > 1, F.col("h") / F.log2(F.col("n").cast("double"))).otherwise(0.0).alias("ratio")).where(F.col("ratio") <= most_ratio)
    return share.join(ratio, "w1").select(F.col("w1").alias("word"), F.round("mass", 6).alias("mass"), F.round("ratio", 6).alias("ratio"), "class", F.round("share", 6).alias("share"))


def calibration(unigram: DataFrame, add_k: float = 0.5, top: int = 12, least: float = 0.25) -> DataFrame:
    """Mean and spread of ln(freq + k) over the `top` words of every two first letters, by the columns beside word and freq."""
    by = [c for c in unigram.columns if c not in ("word", "freq")]
    ranked = unigram.where(F.length("word") >= 2).withColumn("b", F.substring("word", 1, 2)).withColumn("r", F.row_number().over(Window.partitionBy(*by, "b").orderBy(F.desc("freq"), "word"))).where(F.col("r") <= top)
    value = F.log(F.col("freq") + add_k)
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.greatest(F.stddev_pop(value), F.lit(least)).alias("spread"))


def inverted_index(rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """token, keys (distinct, sorted), postings."""
    return rows.select(key, F.explode(F.array_distinct(F.col(tokens))).alias("token")).groupBy("token").agg(F.sort_array(F.collect_set(key)).alias("keys"), F.count_distinct(key).alias("postings"))


def unique_terms(names: DataFrame, keywords: DataFrame) -> DataFrame:
    """Terms (term, owner) that belong to one owner alone; what is a name is no keyword."""
    alone = lambda d: d.groupBy("term").agg(F.min("owner").alias("owner"), F.max("owner").alias("other")).where("owner = other").select("term", "owner")
    own = alone(names)
    return own.withColumn("kind", F.lit("name")).unionByName(alone(keywords).join(names.select("term"), "term", "left_anti").withColumn("kind", F.lit("keyword")))


def siblings(forms: DataFrame, words: DataFrame, case: int) -> DataFrame:
    """For words, the forms of the same lemma whose bundle differs in its case only (forms: lemma, pos, gender, form, bundle)."""
    from wordmill.functions.model import with_case

    own = forms.join(words.select(F.col("word").alias("form")), "form").select(F.col("form").alias("word"), "lemma", "pos", "gender", with_case(F.col("bundle"), case).alias("bundle"))
    return own.join(forms, ["lemma", "pos", "gender", "bundle"]).where("form != word").select("word", "lemma", "form", "bundle").distinct()


def lone_lemmas(learned: DataFrame, forms: DataFrame) -> DataFrame:
    """All other forms of the lemma of a learned word that has one lemma only, where those forms have no other either."""
    lemma = forms.select("form", "lemma").distinct()
    single = lemma.groupBy("form").agg(F.min("lemma").alias("lemma"), F.count("*").alias("n")).where("n = 1").select("form", "lemma")
    of = learned.select(F.col("word").alias("form")).join(single, "form").select("lemma").distinct()
    return single.join(of, "lemma", "left_semi").join(learned.select(F.col("word").alias("form")), "form", "left_anti").select("form", "lemma")
