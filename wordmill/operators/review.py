"""Review of typing and of models: findings and intents, attestations, personal vocabularies, evaluation sets, search by names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordmill.functions.text import skeleton, strip_accents
from wordmill.functions.text import strip_all_accents as fold


def attested(tokens: DataFrame, lexicons: dict[str, DataFrame], english: str = "en") -> DataFrame:
    """Distinct tokens (w) with a flag for each lexicon (word, freq), for a possessive of an English word, and valid: any of these."""
    out = tokens.select("w").distinct().withColumn("base", F.regexp_extract("w", r"^(\p{L}+[^s\P{L}])['’]s$", 1))
    for name, rows in lexicons.items():
        out = out.join(rows.select(F.col("word").alias("w"), F.lit(True).alias(name)), "w", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    own = lexicons[english].select(F.col("word").alias("base"), F.lit(True).alias("possessive"))
    out = out.join(own, "base", "left").withColumn("possessive", F.coalesce("possessive", F.lit(False))).drop("base")
    valid = F.col("possessive")
    for name in lexicons:
        valid = valid | F.col(name)
    return out.withColumn("valid", valid)


def with_intents(findings: DataFrame, intents: DataFrame) -> DataFrame:
    """Findings (typed, guess) with what was meant: a confirmed intent (key, intended, intentional) wins over the guess; on purpose is no slip."""
    out = findings.withColumn("key", F.lower("typed")).join(intents, "key", "left").drop("key")
    return out.select("typed", F.coalesce("intended", "guess").alias("meant"), F.col("intended").isNotNull().alias("confirmed"), F.coalesce("intentional", F.lit(False)).alias("intentional"))


def uncontested(ranked: DataFrame) -> DataFrame:
    """typed, word: the first candidates (typed, word, freq, penalty) of penalty 0 that stand alone, or before a dearer one, or before one of a third of their frequency."""
    order = Window.partitionBy("typed").orderBy("penalty", F.desc("freq"), "word")
    rows = ranked.select("typed", "word", "freq", "penalty", F.lead("penalty").over(order).alias("p2"), F.lead("freq").over(order).alias("f2"), F.row_number().over(order).alias("r"))
    return rows.where((F.col("r") == 1) & (F.col("penalty") == 0) & (F.col("p2").isNull() | (F.col("p2") > 0) | (F.col("freq") >= 3 * F.col("f2")))).select("typed", "word")


def silent_candidates(tokens: DataFrame, common: DataFrame, cheap, near: DataFrame, k: int = 5) -> DataFrame:
    """typed, word, freq, penalty, rank of the words that an unknown token may stand for.

    Penalty 0 is one cheap edit, 1 two of them (edits of token and word meet in the middle, as each can be undone), 2 any
    two edits: `near` has typed and word of those.
    """
    asked = tokens.select("typed").distinct().withColumn("edit", F.explode(F.concat(F.array("typed"), cheap(F.col("typed")))))
    words = common.select("word", F.explode(F.concat(F.array("word"), cheap(F.col("word")))).alias("edit"))
    met = asked.join(words, "edit").groupBy("typed", "word").agg(F.min(F.when((F.col("edit") == F.col("word")) | (F.col("edit") == F.col("typed")), 0).otherwise(1)).alias("penalty"))
    rows = met.unionByName(near.select("typed", "word", F.lit(2).alias("penalty"))).where("typed != word AND length(word) >= 2")
    rows = rows.groupBy("typed", "word").agg(F.min("penalty").alias("penalty")).join(common, "word")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("typed").orderBy("penalty", F.desc("freq"), "word"))).where(F.col("rank") <= k)


def latest_only(rows: DataFrame, key: list[str], generation: list[str]) -> DataFrame:
    """The row of the last generation of each key; requests that a later one superseded go."""
    order = Window.partitionBy(*key).orderBy(*(F.desc(g) for g in generation))
    return rows.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def largest(rows: DataFrame, key: str, size: Column, value: str) -> DataFrame:
    """key, value: of each key what is largest, of equals the least value."""
    best = F.min(F.struct((-size).alias("s"), F.col(value).alias("v")))
    return rows.groupBy(key).agg(best.alias("b")).select(key, F.col("b.v").alias(value))


def merged_offsets(taps: DataFrame, key: str, session: str, x: str, y: str) -> DataFrame:
    """key, count, mean_dx, mean_dy by sums of each session that are then merged."""
    part = taps.groupBy(session, key).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"))
    return part.groupBy(key).agg(F.sum("n").alias("count"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy")).select(key, "count", (F.col("sx") / F.col("count")).alias("mean_dx"), (F.col("sy") / F.col("count")).alias("mean_dy"))


def possessives(typed: DataFrame, english: DataFrame, share: float = 0.1) -> DataFrame:
    """typed, word, base, score: tokens that end in s whose stem is a word as that word's possessive, at a share of its frequency."""
    rows = typed.select("typed").distinct().where(F.col("typed").rlike(r"^\p{L}{2,}s$") & (F.length("typed") >= 4) & ~F.col("typed").endswith("ss"))
    rows = rows.withColumn("base", F.expr("substring(typed, 1, length(typed) - 1)"))
    return rows.join(english.select(F.col("word").alias("base"), "freq"), "base").select("typed", F.concat("base", F.lit("'s")).alias("word"), "base", (F.col("freq") * share).alias("score"))


def fold_twins(unigram: DataFrame, ratio: float = 10.0, most: int = 5) -> DataFrame:
    """word, twin: bare words that an accented word of the same letters outweighs by `ratio`; words of more than `most` vowels have none."""
    twins = unigram.where(strip_accents(F.col("word")) != F.col("word")).select(F.translate("word", "áéíóúý", "aeiouy").alias("bare"), F.col("word").alias("twin"), F.col("freq").alias("f"))
    twins = twins.where("bare != twin").groupBy("bare").agg(F.min(F.struct((-F.col("f")).alias("o"), "twin", "f")).alias("t"))
    asked = unigram.where(F.regexp_count("word", F.lit("[aeiouy]")) <= most)
    return asked.join(twins, F.col("word") == F.col("bare")).where(F.col("t.f") >= ratio * F.greatest("freq", F.lit(1))).select("word", F.col("t.twin").alias("twin"))


def lemmas(words: DataFrame, forms: DataFrame) -> DataFrame:
    """word, lemmas (the word itself if unknown), kinds (lemma and class; none if unknown), open (whether a class is open), cases."""
    of = forms.groupBy("form").agg(F.sort_array(F.collect_set("lemma")).alias("lemmas"), F.sort_array(F.collect_set(F.struct("lemma", "pos"))).alias("kinds"), F.bool_or(F.col("pos").isin("no", "so", "lo")).alias("open"), F.sort_array(F.collect_set("case")).alias("cases"))
    out = words.select("word").distinct().join(of.withColumnRenamed("form", "word"), "word", "left")
    return out.select("word", F.coalesce("lemmas", F.array("word")).alias("lemmas"), F.coalesce(F.size("kinds"), F.lit(0)).alias("n_kinds"), F.coalesce("open", F.lit(False)).alias("open"), F.coalesce(F.size("cases"), F.lit(0)).alias("n_cases"))


def surface(text: Column, learned: Column, known: Column) -> Column:
    """The learned form of a word, but its capitals where the word is known without them: those come from keyboards."""
    shouted = (F.length(learned) > 1) & (learned == F.upper(learned)) & (learned != F.lower(learned))
    capital = learned == F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))
    return F.when(learned.isNull() | known & (shouted | capital), text).otherwise(learned)


def snapshot(learned: DataFrame, added: DataFrame, tombstones: DataFrame, by: list[str]) -> DataFrame:
    """by, word, n: what was learned (by, word, n) and what the user added, which counts 1 at least; no deleted word."""
    rows = learned.select(*by, "word", "n").unionByName(added.select(*by, "word", F.lit(1).cast("long").alias("n"))).groupBy(*by, "word").agg(F.max("n").alias("n"))
    return rows.join(tombstones.select(*by, "word"), [*by, "word"], "left_anti")


def safety_pairs(pairs: DataFrame, valid: DataFrame, most: int) -> DataFrame:
    """lang, category, typo, intended, place: rows that must stay as they are, at most so many of each language and category by hash.

    From pairs (lang, typo, intended): what was meant, unchanged, if it is a valid word (lang, word); and typos that are valid words.
    """
    same = lambda c: valid.select("lang", F.col("word").alias(c))
    rows = pairs.where(~F.col("intended").rlike(r"\s"))
    clean = rows.join(same("intended"), ["lang", "intended"], "left_semi").select("lang", F.lit("clean_identity").alias("category"), F.col("intended").alias("typo"), "intended")
    hard = rows.where(~F.col("typo").rlike(r"\s") & (F.lower("typo") != F.lower("intended"))).join(same("typo"), ["lang", "typo"], "left_semi")
    both = clean.unionByName(hard.select("lang", F.lit("valid_word_hard_negative").alias("category"), "typo", "intended"))
    key = F.concat_ws("|", "lang", "category", F.lower("typo"), F.lower("intended"))
    both = both.withColumn("key", key).groupBy("key").agg(F.min(F.struct("lang", "category", "typo", "intended")).alias("r")).select("r.*", F.md5("key").alias("mark"), "key")
    return both.withColumn("place", F.row_number().over(Window.partitionBy("lang", "category").orderBy("mark", "key"))).where(F.col("place") <= most).select("lang", "category", "typo", "intended", "place")


def exported(ranked: DataFrame, k: int = 8) -> DataFrame:
    """typed, candidates: the first k candidates of each token with their scores, best first."""
    rows = F.sort_array(F.collect_list(F.struct("rank", "word", "score")))
    return ranked.where(F.col("rank") <= k).groupBy("typed").agg(rows.alias("candidates"))


def slips(words: DataFrame) -> DataFrame:
    """word, category, typo: one slip of each kind at a place drawn by the word's MD5; none where the kind doesn't apply."""
    w, n = F.col("word"), F.length("word")
    draw = lambda salt, size: F.pmod(F.conv(F.substring(F.md5(F.concat(w, F.lit(salt))), 1, 8), 16, 10).cast("long"), size).cast("int")
    cut = lambda a, b: F.substring(w, a, b)
    one = F.lit(1)
    at, swap = draw("del", n) + 1, draw("swap", F.greatest(n - 1, one)) + 1
    double = draw("double", n) + 1
    kinds = {
        "deletion": F.when(n >= 2, F.concat(cut(one, at - 1), cut(at + 1, n))),
        "transposition": F.when((n >= 2) & (cut(swap, one) != cut(swap + 1, one)), F.concat(cut(one, swap - 1), cut(swap + 1, one), cut(swap, one), cut(swap + 2, n))),
        "gemination": F.concat(cut(one, double), cut(double, n)),
        "accent_drop": F.when(strip_accents(w) != w, strip_accents(w)),
        "contraction_damage": F.when(w.contains("'"), F.replace(w, F.lit("'"), F.lit(""))),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("category"), v.alias("typo")) for k, v in kinds.items()))
    return words.select("word", F.explode(rows).alias("s")).select("word", "s.category", "s.typo").where("typo IS NOT NULL")


def search(entries: DataFrame, queries: DataFrame, k: int = 24) -> DataFrame:
    """query, id, hit, rank of entries (id, name, other, name_tokens, keyword_tokens, seen: place by use, null if unused, o: order).

    0: one of the names; 1: a keyword, or several words as one (#...); 2: a word of the name; 3, 4: begins a word of the
    name, a keyword. Several words rank by the worst of theirs, and all must hit. A query that hits nothing is tried
    without accents, 5 places down. Equal hits are ordered by use, then as they come.
    """
    def hit(q: Column, names: list[Column], name_tokens: Column, keyword_tokens: Column) -> Column:
        begins = lambda tokens, t: F.exists(tokens, lambda x: x.startswith(t))
        single = F.when(F.array_contains(keyword_tokens, q), 1).when(F.array_contains(name_tokens, q), 2).when(begins(name_tokens, q), 3).when(begins(keyword_tokens, q), 4)
        each = F.transform(F.split(q, " "), lambda t: F.when(F.array_contains(name_tokens, t), 2).when(begins(name_tokens, t), 3).when(begins(keyword_tokens, t), 4).otherwise(99))
        several = F.when(F.array_contains(keyword_tokens, F.concat(F.lit("#"), q)), 1).when(F.array_max(each) < 99, F.array_max(each))
        own = names[0] == q
        for n in names[1:]:
            own = own | (n == q)
        return F.when(own, 0).when(q.contains(" "), several).otherwise(single)

    asked = queries.select("query", F.array_join(F.filter(F.split(F.lower("query"), r"\s+"), lambda x: x != ""), " ").alias("q")).where("q != ''")
    folded = lambda tokens: F.transform(tokens, fold)
    dealt = entries.repartition(4 * entries.sparkSession.sparkContext.defaultParallelism)  # a small file is one task's
    dealt = dealt.select("*", fold(F.col("name")).alias("__name"), fold(F.col("other")).alias("__other"), folded(F.col("name_tokens")).alias("__names"), folded(F.col("keyword_tokens")).alias("__keys"))
    met = dealt.crossJoin(F.broadcast(asked.withColumn("__q", fold(F.col("q")))))  # a stated set of queries against all entries
    direct = hit(F.col("q"), [F.col("name"), F.col("other")], F.col("name_tokens"), F.col("keyword_tokens"))
    retry = hit(F.col("__q"), [F.col("__name"), F.col("__other")], F.col("__names"), F.col("__keys")) + 5
    both = F.explode(F.array(F.struct(F.lit(0).alias("way"), direct.alias("hit")), F.struct(F.lit(1).alias("way"), retry.alias("hit"))))
    rows = met.select("query", "id", "seen", "o", both.alias("b")).select("query", "id", "seen", "o", "b.way", "b.hit").where("hit IS NOT NULL")
    order = Window.partitionBy("query", "way").orderBy("hit", F.asc_nulls_last("seen"), "o")
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.withColumn("first", F.min("way").over(Window.partitionBy("query"))).where("way = first").select("query", "id", "hit", "rank")


def replaced(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """typed, text: tokens with a replacement (place, shortcut, text), whatever their case; of a shortcut the first counts, and none gives itself."""
    first = pairs.groupBy(F.lower("shortcut").alias("key")).agg(F.min(F.struct("place", "text"))["text"].alias("text"))
    return tokens.select("typed").distinct().withColumn("key", F.lower("typed")).join(F.broadcast(first), "key").where("text != typed").select("typed", "text")


def aligned_taps(rows: DataFrame) -> DataFrame:
    """The rows (taps: array of c, dx, dy; word) with the taps whose key is the word's sign at their place; none if their numbers differ."""
    good = F.filter(F.transform("taps", lambda t, i: F.struct(t.alias("t"), (t["c"] == F.substring(F.lower("word"), i + 1, F.lit(1))).alias("ok"))), lambda x: x["ok"])
    return rows.withColumn("taps", F.when(F.size("taps") == F.length("word"), F.transform(good, lambda x: x["t"])).otherwise(F.slice("taps", 1, 0)))


def apply_guard(recorded: Column, text: Column) -> Column:
    """Whether the word that a correction was computed for is still the last one of the text."""
    return recorded == F.regexp_extract(text, r"(\S*)$", 1)


def vouchable(typed: Column, meant: Column, kind: Column) -> Column:
    """Whether a finding can be vouched for by grammar: not a tap, and no mere beginning of what was meant."""
    return (kind != "TAP_USED") & ~(F.lower(meant).startswith(F.lower(typed)) & (F.length(typed) < F.length(meant)))


def restorable(typed: Column, word: Column) -> Column:
    """Different words of one length and skeleton."""
    a, b = F.lower(typed), F.lower(word)
    return (a != b) & (F.length(a) == F.length(b)) & (skeleton(a) == skeleton(b))
