"""Plans over texts: lexicon building, lookups, language models, candidate ranking, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordmill.functions import edits, model, text
from wordmill.operators import lexicon, lookup, paircount, quality, sessions
from wordmill.plans.registry import query, table

TOK = r"tok AS MATERIALIZED (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '(\p{L}+)', 1)) AS w FROM documents)"
UNI = TOK + ", uni AS MATERIALIZED (SELECT w AS word, count(*) AS freq FROM tok GROUP BY w)"
BI = r"""lst AS MATERIALIZED (SELECT regexp_extract_all(lower(text), '(\p{L}+)', 1) AS ws FROM documents),
pr AS MATERIALIZED (SELECT unnest(list_zip(ws[1:len(ws) - 1], ws[2:])) AS p FROM lst WHERE len(ws) > 1),
bi AS MATERIALIZED (SELECT p[1] AS w1, p[2] AS w2, count(*) AS freq FROM pr GROUP BY ALL)"""
BENCH = r"bw AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '(\p{L}+)', 1)) AS word FROM benchmark)"
SKELETON = "translate({}, 'áéíóúýðþ', 'aeiouydt')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "text")


def _bench(spark: SparkSession, sf_dir: str, name: str = "word") -> DataFrame:
    return table(spark, sf_dir, "benchmark", "text").select(F.explode(text.words(F.col("text"))).alias(name)).distinct()


@query(f"WITH {UNI} SELECT word, freq FROM uni")
def unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.unigrams(_docs(spark, sf_dir))


@query(f"WITH {BI} SELECT w1, w2, freq FROM bi")
def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.bigrams(_docs(spark, sf_dir))


@query(f"""WITH {BI} SELECT CASE WHEN GROUPING(w2) = 1 THEN 'first' WHEN GROUPING(w1) = 1 THEN 'second' ELSE 'pair' END AS side, w1, w2, CAST(sum(freq) AS BIGINT) AS total
FROM bi GROUP BY GROUPING SETS ((w1), (w2), (w1, w2))""")
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.fan_out(lexicon.bigrams(_docs(spark, sf_dir)))


@query(f"""WITH {BI} SELECT w1, w2, freq, rank FROM (SELECT *, row_number() OVER (PARTITION BY w1 ORDER BY freq DESC, w2) AS rank FROM bi) WHERE rank <= 3""", rank="INT")
def continuations_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paircount.continued(paircount.dealt(_docs(spark, sf_dir)), 3)


@query(f"""WITH {UNI}, f AS (SELECT strip_accents(word) AS bare, max(freq) AS most FROM uni WHERE word != strip_accents(word) GROUP BY 1)
SELECT word, freq, most FROM uni JOIN f ON word = bare WHERE most >= 10 * freq""")
def accent_dominated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.accent_dominated(lexicon.unigrams(_docs(spark, sf_dir)))


@query(f"""WITH {UNI}, {BENCH}, o AS (SELECT *, row_number() OVER (ORDER BY freq DESC, word) AS r FROM uni ANTI JOIN bw USING (word))
SELECT word, freq FROM o WHERE r <= 1000 OR freq >= 50 UNION ALL SELECT word, freq FROM uni SEMI JOIN bw USING (word)""")
def pruned_unlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.prune_unlisted(lexicon.unigrams(_docs(spark, sf_dir)), _bench(spark, sf_dir), 1000, 50)


@query(f"""WITH {UNI}, {BI}, k AS MATERIALIZED (SELECT word FROM uni WHERE freq >= 5)
SELECT w1, w2, bi.freq FROM bi JOIN k a ON a.word = w1 JOIN k b ON b.word = w2""")
def known_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, uni = lexicon.counted(_docs(spark, sf_dir))
    return lexicon.keep_known(pairs.where("n1 >= 5"), uni.where("freq >= 5"), ("w2",))


@query(f"""WITH {UNI}, d AS (SELECT greatest(1, CAST(ceil(max(freq) / 255.0) AS BIGINT)) AS d FROM uni)
SELECT word, CAST(greatest(1, freq // d) AS BIGINT) AS freq FROM uni, d""")
def scaled_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.scale(lexicon.unigrams(_docs(spark, sf_dir)), 255)


@query(f"""WITH {UNI}, {BI}, ph AS (SELECT w1 || w2 AS word, w1, w2, freq AS pair FROM bi WHERE freq >= 20),
f1 AS (SELECT w1, sum(freq) AS fan FROM bi GROUP BY 1), f2 AS (SELECT w2, sum(freq) AS fan FROM bi GROUP BY 1),
j AS (SELECT ph.word, coalesce(o.freq, 0) AS old, least(u1.freq * CAST(pair AS DOUBLE) / f1.fan, u2.freq * CAST(pair AS DOUBLE) / f2.fan) AS guess FROM ph JOIN f1 USING (w1) JOIN f2 USING (w2)
JOIN uni u1 ON u1.word = w1 JOIN uni u2 ON u2.word = w2 LEFT JOIN uni o ON o.word = ph.word)
SELECT word, old, greatest(old, CAST(round_even(guess, 0) AS BIGINT)) AS freq FROM j""")
def transferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, uni = lexicon.counted(_docs(spark, sf_dir))
    return lexicon.transfer(pairs.where("freq >= 20").select(F.concat("w1", "w2").alias("word"), "w1", "w2", F.col("freq").alias("pair")), uni, pairs)


@query(f"""WITH {UNI}, e AS (SELECT word || 's' AS word, word AS stand_in, freq FROM uni WHERE freq >= 100)
SELECT word, freq FROM uni UNION ALL SELECT word, greatest(1, freq // 2) FROM e WHERE word NOT IN (SELECT word FROM uni)""")
def backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    uni = lexicon.unigrams(_docs(spark, sf_dir))
    return lexicon.backfill(uni, uni.where("freq >= 100").select(F.concat("word", F.lit("s")).alias("word"), F.col("word").alias("stand_in")))


@query(f"""WITH {UNI}, {BENCH} SELECT coalesce(uni.word, bw.word) AS word, CAST(greatest(coalesce(freq, 0), CASE WHEN bw.word IS NULL THEN 0 ELSE 10 END) AS BIGINT) AS freq
FROM uni FULL JOIN bw ON uni.word = bw.word""")
def floored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.floors(lexicon.unigrams(_docs(spark, sf_dir)), _bench(spark, sf_dir).withColumn("least", F.lit(10)))


@query(f"""WITH {UNI}, {BI}, an AS (SELECT word, right(word, 1) AS class FROM uni UNION SELECT word, 'n' || length(word) FROM uni),
cr AS (SELECT w1, class, sum(freq / 2.0) AS credit FROM bi JOIN an ON an.word = w2 GROUP BY 1, 2),
t AS (SELECT w1, sum(credit) AS mass, count(*) AS n FROM cr GROUP BY 1 HAVING sum(credit) >= 50),
s AS (SELECT w1, class, mass, n, credit / mass AS share FROM cr JOIN t USING (w1)),
h AS (SELECT w1, CASE WHEN any_value(n) > 1 THEN -sum(share * log2(share)) / log2(any_value(n)) ELSE 0 END AS ratio FROM s GROUP BY 1)
SELECT w1 AS word, round(CAST(mass AS DOUBLE), 6) AS mass, round(CAST(ratio AS DOUBLE), 6) AS ratio, class, round(CAST(share AS DOUBLE), 6) AS share FROM s JOIN h USING (w1) WHERE ratio <= 0.9""")
def governors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, uni = lexicon.counted(_docs(spark, sf_dir))
    analyses = uni.select("word", F.explode(F.array(F.right("word", F.lit(1)), F.concat(F.lit("n"), F.length("word").cast("string")))).alias("class"))
    return lexicon.governors(pairs, analyses)


CAL = """lu AS (SELECT lang, w AS word, count(*) AS freq FROM tok WHERE lang IS NOT NULL GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY lang, substr(word, 1, 2) ORDER BY freq DESC, word) AS r FROM lu WHERE length(word) >= 2),
cal AS (SELECT lang, count(*) AS n, avg(ln(freq + 0.5)) AS mean, greatest(stddev_pop(ln(freq + 0.5)), 0.25) AS spread FROM rk WHERE r <= 12 GROUP BY lang)"""


def _by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "lang", "text").where("lang IS NOT NULL")
    return lexicon.tokens(docs).groupBy("lang", F.col("w").alias("word")).agg(F.count("*").alias("freq"))


@query(f"WITH {TOK}, {CAL} SELECT lang, n, round(mean, 6) AS mean, round(spread, 6) AS spread FROM cal")
def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.calibration(_by_language(spark, sf_dir)).select("lang", "n", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"))


@query(f"""WITH {TOK}, {CAL}, t AS (SELECT lang, sum(freq) AS total FROM lu GROUP BY 1),
z AS (SELECT word, lang, (ln((freq + 0.5) / (total + 50000)) - (mean - ln(total + 50000))) / spread AS z FROM lu JOIN cal USING (lang) JOIN t USING (lang)),
p AS (SELECT word, max(z) FILTER (lang = 'en') AS a, max(z) FILTER (lang = 'fr') AS b FROM z WHERE lang IN ('en', 'fr') GROUP BY 1),
m AS (SELECT *, greatest(coalesce(a, -1.25), -1.25) - greatest(coalesce(b, -1.25), -1.25) AS m FROM p)
SELECT word, round(a, 6) AS z_en, round(b, 6) AS z_fr, round(sign(m) * least(greatest(0, abs(m) - 1), 1.1), 6) + 0.0 AS nats FROM m""")
def lane_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _by_language(spark, sf_dir)
    cal, total = lexicon.calibration(by), by.groupBy("lang").agg(F.sum("freq").alias("total"))
    z = by.where("lang IN ('en', 'fr')").join(cal, "lang").join(total, "lang").withColumn("z", model.z_score(model.unigram_p(F.col("freq"), F.col("total")), F.col("total"), F.col("mean"), F.col("spread")))
    both = z.groupBy("word").agg(F.max(F.when(F.col("lang") == "en", F.col("z"))).alias("a"), F.max(F.when(F.col("lang") == "fr", F.col("z"))).alias("b"))
    return both.select("word", F.round("a", 6).alias("z_en"), F.round("b", 6).alias("z_fr"), (F.round(model.lane_evidence(F.col("a"), F.col("b")), 6) + 0.0).alias("nats"))


@query(f"""WITH {UNI}, {BI}, t AS (SELECT sum(freq) AS n FROM uni), p AS (SELECT word, freq, (freq + 0.5) / (n + 50000) AS p FROM uni, t)
SELECT w1, w2, round(ln(b.p), 6) AS ln_p, round(ln(0.6 * bi.freq / a.freq + 0.4 * b.p), 6) AS ln_pair, round(ln(0.6 * bi.freq / a.freq + 0.4 * b.p) - ln(b.p), 6) AS lift
FROM bi JOIN p a ON a.word = w1 JOIN p b ON b.word = w2""")
def pair_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, uni = lexicon.counted(_docs(spark, sf_dir))
    total = uni.agg(F.sum("freq").alias("n"))
    p = uni.crossJoin(F.broadcast(total)).withColumn("p", model.unigram_p(F.col("freq"), F.col("n")))
    both = pairs.withColumnRenamed("n1", "f1").join(p.select(F.col("word").alias("w2"), "p").hint("shuffle_hash"), "w2")
    pair = F.log(model.bigram_p(F.col("freq"), F.col("f1"), F.col("p")))
    return both.select("w1", "w2", F.round(F.log("p"), 6).alias("ln_p"), F.round(pair, 6).alias("ln_pair"), F.round(pair - F.log("p"), 6).alias("lift"))


@query(f"""WITH {UNI}, {BENCH}, q AS (SELECT DISTINCT substr(word, 1, 2) AS prefix FROM bw UNION SELECT DISTINCT substr(word, 1, 3) FROM bw)
SELECT prefix, word, freq, rank FROM (SELECT prefix, word, freq, row_number() OVER (PARTITION BY prefix ORDER BY freq DESC, word) AS rank FROM q JOIN uni ON starts_with(word, prefix)) WHERE rank <= 3""", rank="INT")
def completions_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _bench(spark, sf_dir).select(F.explode(F.array(F.substring("word", 1, 2), F.substring("word", 1, 3))).alias("prefix"))
    return lookup.completions(asked, lexicon.unigrams(_docs(spark, sf_dir)))


CONTEXTS = r"ctx AS (SELECT DISTINCT list_last(ws) AS context FROM (SELECT regexp_extract_all(lower(text), '(\p{L}+)', 1) AS ws FROM conversations) WHERE len(ws) > 0)"


@query(f"""WITH {UNI}, {BI}, {CONTEXTS},
s AS (SELECT context, w2 AS word, freq, row_number() OVER (PARTITION BY context ORDER BY freq DESC, w2) AS rank FROM ctx JOIN bi ON w1 = context),
c AS (SELECT word, freq, row_number() OVER (ORDER BY freq DESC, word) AS rank FROM uni)
SELECT context, word, freq, rank, 'bigram' AS source FROM s WHERE rank <= 3
UNION ALL SELECT context, word, freq, rank, 'unigram' FROM ctx, c WHERE rank <= 3 AND context NOT IN (SELECT w1 FROM bi)""", rank="INT")
def next_word_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, uni = lexicon.counted(_docs(spark, sf_dir))
    turns = table(spark, sf_dir, "conversations", "text").select(text.words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    return lookup.next_words(turns.select(F.element_at("ws", -1).alias("context")), pairs, uni)


#: DuckDB's levenshtein counts bytes, so letters beyond ASCII are put in the place of capitals, which the words don't have.
PLAIN = "translate({}, 'äöüßéèêëáàâçñóòôíìîúùûœæåãõø', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ01')"
FUZZY = f"""up AS MATERIALIZED (SELECT word, freq, length(word) AS n, {PLAIN.format('word')} AS pl FROM uni), bp AS MATERIALIZED (SELECT word, length(word) AS n, {PLAIN.format('word')} AS pl FROM bw),
fz AS MATERIALIZED (SELECT b.word AS typed, u.word, u.freq, levenshtein(b.pl, u.pl) AS edits FROM bp b JOIN up u ON u.n BETWEEN b.n - 1 AND b.n + 1 WHERE b.pl != u.pl AND levenshtein(b.pl, u.pl) <= 1)"""


def _fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.fuzzy(_bench(spark, sf_dir, "typed"), lexicon.unigrams(_docs(spark, sf_dir)))


@query(f"WITH {UNI}, {BENCH}, {FUZZY} SELECT typed, word, freq, CAST(edits AS INT) AS edits FROM fz")
def fuzzy_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fuzzy(spark, sf_dir)


@query()
def fuzzy_priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by the keyboard's prices; tests hold channel() against a plain recursion."""
    return lookup.priced(_fuzzy(spark, sf_dir)).withColumn("cost", F.round("cost", 6))


@query(f"""WITH {UNI}, {BENCH}, {FUZZY}, x AS (SELECT typed AS t, word AS m, length(typed) AS n, length(word) AS k FROM fz),
y AS (SELECT *, CASE WHEN n < k THEN t ELSE m END AS s, CASE WHEN n < k THEN m ELSE t END AS l FROM x)
SELECT t AS typed, m AS word, CASE WHEN translate(t, 'áéíóúýöæðþ', 'aeiouyoadt') = translate(m, 'áéíóúýöæðþ', 'aeiouyoadt') THEN 'accent_drop'
WHEN n = k THEN CASE WHEN list_sort(string_split(t, '')) = list_sort(string_split(m, '')) THEN 'transposition' ELSE 'substitution' END
WHEN len(list_filter(range(2, length(l) + 1), lambda i: l[i] = l[i - 1] AND l[1:i - 1] || l[i + 1:] = s)) > 0 THEN 'gemination'
WHEN n < k THEN 'deletion' ELSE 'insertion' END AS category FROM y""")
def edit_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fuzzy(spark, sf_dir).select("typed", "word", edits.category(F.col("typed"), F.col("word")).alias("category"))


@query(f"""WITH {UNI}, {BENCH}, s AS (SELECT DISTINCT {SKELETON.format('word')} AS typed FROM bw)
SELECT typed, word, freq FROM s JOIN uni ON {SKELETON.format('word')} = typed WHERE typed != word""")
def restored_diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _bench(spark, sf_dir).select(text.skeleton(F.col("word")).alias("typed"))
    return lookup.restored(typed, lexicon.unigrams(_docs(spark, sf_dir)))


CUT = "ct AS (SELECT word AS typed, substr(word, 1, i) AS l, substr(word, i + 1) AS r FROM bw, range(1, 60) g(i) WHERE length(word) >= 2 * {0} AND i >= {0} AND i <= length(word) - {0})"


@query(f"""WITH {UNI}, {BENCH}, {CUT.format(2)}, b AS (SELECT typed, l AS "left", r AS "right", a.freq AS f_left, c.freq AS f_right, least(a.freq, c.freq) AS score FROM ct JOIN uni a ON a.word = l JOIN uni c ON c.word = r)
SELECT typed, "left", "right", f_left, f_right, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY score DESC, "left") AS rank FROM b) WHERE rank <= 1""", rank="INT")
def best_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.splits(_bench(spark, sf_dir, "typed"), lexicon.unigrams(_docs(spark, sf_dir))).select("typed", "left", "right", "f_left", "f_right", "score", "rank")


@query(f"""WITH {UNI}, {BENCH}, {CUT.format(3)} SELECT typed, l AS modifier, r AS head FROM (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY length(r) DESC) AS k FROM ct
WHERE l IN (SELECT word FROM uni) AND r IN (SELECT word FROM uni)) WHERE k = 1""")
def compound_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.compounds(_bench(spark, sf_dir, "typed"), lexicon.unigrams(_docs(spark, sf_dir))).select("typed", "modifier", "head")


POOL = f"""pool0 AS MATERIALIZED (SELECT typed, word, freq, 0 AS place FROM fz UNION ALL SELECT s.typed, u.word, u.freq, 1 FROM (SELECT word AS typed FROM bw) s JOIN uni u ON {SKELETON.format('u.word')} = s.typed WHERE s.typed != u.word),
pool AS (SELECT typed, word, max(freq) AS freq, CASE min(place) WHEN 0 THEN 'fuzzy' ELSE 'diacritic' END AS provider FROM pool0 GROUP BY 1, 2)"""


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed, uni = _bench(spark, sf_dir, "typed"), lexicon.unigrams(_docs(spark, sf_dir))
    return lookup.pool({"fuzzy": lookup.fuzzy(typed, uni), "diacritic": lookup.restored(typed, uni)})


@query(f"""WITH {UNI}, {BENCH}, {FUZZY}, {POOL}, s AS (SELECT *, ln(freq + 0.5) AS score FROM pool),
r AS (SELECT *, score - lead(score) OVER w AS margin, row_number() OVER w AS rank FROM s WINDOW w AS (PARTITION BY typed ORDER BY score DESC, word)),
m AS (SELECT *, exp(score - max(score) OVER (PARTITION BY typed)) AS e FROM r WHERE rank <= 8)
SELECT typed, word, provider, rank, round(score, 6) AS score, round(margin, 6) AS margin, round(e / sum(e) OVER (PARTITION BY typed), 10) AS confidence FROM m""", rank="INT")
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.confidence(lookup.ranked(_pool(spark, sf_dir), F.log(F.col("freq") + 0.5)), ["typed"])
    return found.select("typed", "word", "provider", "rank", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"), F.round("confidence", 10).alias("confidence"))


@query(f"""WITH {UNI}, {BENCH}, {FUZZY}, {POOL} SELECT provider, count(*) AS n FROM pool GROUP BY 1""")
def provider_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir).groupBy("provider").agg(F.count("*").alias("n"))


@query(f"""WITH {UNI}, {BENCH}, {FUZZY}, {POOL}, r AS (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY ln(freq + 0.5) DESC, word) AS o FROM pool),
b AS (SELECT DISTINCT typed, typed AS "text", 0 AS o FROM r UNION ALL SELECT typed, word, o FROM r WHERE o <= 8 AND word != typed)
SELECT typed, "text", slot FROM (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY o, "text") AS slot FROM b) WHERE slot <= 3""", slot="INT")
def suggestion_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.suggestion_bar(lookup.ranked(_pool(spark, sf_dir), F.log(F.col("freq") + 0.5)))


@query(f"""WITH {UNI}, {BENCH}, {FUZZY}, {POOL}, s AS (SELECT typed, word, ln(freq + 0.5) AS score, length(word) AS evidence FROM pool),
g AS (SELECT unnest([0.0, 0.1, 0.5]) AS weight), r AS (SELECT *, row_number() OVER (PARTITION BY weight, typed ORDER BY round(score + weight * evidence, 9) DESC, word) AS k FROM s, g),
b AS (SELECT typed, word FROM (SELECT typed, word, row_number() OVER (PARTITION BY typed ORDER BY length(word) DESC, word) AS k FROM s) WHERE k = 1),
h AS (SELECT weight, r.typed, r.word = b.word AS hit FROM r JOIN b USING (typed) WHERE k = 1), z AS (SELECT typed, hit AS base FROM h WHERE weight = 0)
SELECT CAST(weight AS DOUBLE) AS weight, count_if(hit) AS "right", count_if(hit AND NOT base) AS won, count_if(NOT hit AND base) AS lost FROM h JOIN z USING (typed) WHERE weight != 0 GROUP BY 1""", right="BIGINT", won="BIGINT", lost="BIGINT")
def weight_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pool(spark, sf_dir).withColumn("score", F.log(F.col("freq") + 0.5)).withColumn("evidence", F.length("word"))
    longest = rows.groupBy("typed").agg(F.min(F.struct(-F.length("word"), "word"))["word"].alias("longest"))
    return quality.sweep(rows.join(longest, "typed"), [0.1, 0.5], F.col("score"), F.col("evidence"), "typed", "word", "longest")


LINES = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents)"


@query(rf"""WITH {LINES} SELECT doc_id, count(*) AS n, count_if(regexp_matches(s, '^\s*(=+.*=+|#+\s.*|[*\-•].*|[0-9]+[.)].*)\s*$')) AS structural,
count_if(length(s) BETWEEN 30 AND 240 AND len(string_split_regex(s, ' +')) >= 5 AND regexp_matches(s, '[.!?]$') AND regexp_matches(s, '^\p{{Lu}}') AND NOT regexp_matches(s, '[|{{}}\[\]<>=]|http|www')
AND length(s) - length(regexp_replace(s, '[0-9]', '', 'g')) <= 0.2 * length(s)) AS clean FROM ln GROUP BY doc_id""", structural="BIGINT", clean="BIGINT")
def sentence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(F.split("text", "\n")).alias("s"))
    s = F.col("s")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(text.is_structural(s)).alias("structural"), F.count_if(text.is_clean_sentence(s)).alias("clean"))


@query(r"""WITH t AS (SELECT unnest(list_filter(string_split_regex(translate(text, chr(10) || chr(9) || chr(13), '   '), ' +'), lambda x: x != '')) AS w FROM documents)
SELECT count(*) AS n, count_if(length(w) >= 2 AND NOT regexp_matches(w, '^(#|@|http)') AND NOT regexp_matches(w, '[0-9]') AND regexp_matches(w, '\p{L}')) AS eligible,
count_if(regexp_full_match(w, '\p{L}[\p{L}''\-]*\p{L}')) AS importable, count_if(regexp_full_match(lower(w), '[a-zþðæöáéíóúý]+(''[a-zþðæöáéíóúý]+)*')) AS words,
count_if(regexp_matches(w, '^[^\n]+[.@][^\n]+$') OR regexp_matches(w, '^[^\p{L}\p{N}]')) AS verbatim, count_if(regexp_matches(w, '[þðæöáéíóúýÞÐÆÖÁÉÍÓÚÝ]')) AS icelandic FROM t""", eligible="BIGINT", importable="BIGINT", words="BIGINT", verbatim="BIGINT", icelandic="BIGINT")
def token_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    rows = _docs(spark, sf_dir).select(F.explode(F.split(F.translate("text", "\n\t\r", "   "), " +")).alias("w")).where("w != ''")
    rows = rows.groupBy("w").agg(F.count("*").alias("k"))  # the patterns meet every token once
    often = lambda f: F.coalesce(F.sum(F.when(f, F.col("k"))), F.lit(0))
    return rows.agg(often(F.lit(True)).alias("n"), *(often(f).alias(k) for k, f in {"eligible": text.is_eligible(w), "importable": text.is_importable(w), "words": text.is_word(F.lower(w)), "verbatim": text.is_verbatim(w), "icelandic": text.is_icelandic(w)}.items()))


FORMS = "fm AS (SELECT substr(word, 1, 4) AS lemma, word AS form, freq, CAST((length(word) - 4) | 8 AS INT) AS bundle FROM uni WHERE length(word) BETWEEN 5 AND 8)"


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a table of paradigms: words of one beginning, their length as case."""
    uni = lexicon.unigrams(_docs(spark, sf_dir)).where(F.length("word").between(5, 8))
    bundle = model.pack({"case": F.length("word") - 4, "gender": F.lit(1)})
    return uni.select(F.substring("word", 1, 4).alias("lemma"), F.lit(1).alias("pos"), F.lit(1).alias("gender"), F.col("word").alias("form"), bundle.alias("bundle"), "freq")


@query(f"""WITH {UNI}, {FORMS}, {BENCH} SELECT DISTINCT b.word, a.lemma, f.form, f.bundle FROM bw b JOIN fm a ON a.form = b.word JOIN fm f ON f.lemma = a.lemma AND f.bundle = (8 | 3) AND f.form != b.word""")
def case_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.siblings(_forms(spark, sf_dir).drop("freq"), _bench(spark, sf_dir), 3)


@query(f"""WITH {UNI}, {FORMS}, {BENCH}, l AS (SELECT DISTINCT lemma FROM fm JOIN bw ON form = word) SELECT form, lemma FROM fm WHERE lemma IN (SELECT lemma FROM l) AND form NOT IN (SELECT word FROM bw)""")
def lemma_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.lone_lemmas(_bench(spark, sf_dir), _forms(spark, sf_dir))


@query(f"""WITH {UNI}, {FORMS} SELECT lemma, form, CAST(bundle & 7 AS INT) AS "case", 'c' || (bundle & 7) || ':g1:n0:d0:p0:t0:m0' AS bundle FROM fm JOIN (SELECT lemma FROM fm GROUP BY 1 HAVING max(freq) >= 10) USING (lemma)""")
def paradigms(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = _forms(spark, sf_dir)
    often = forms.groupBy("lemma").agg(F.max("freq").alias("most")).where("most >= 10").select("lemma")
    return forms.join(often, "lemma", "left_semi").select("lemma", "form", model.unpack(F.col("bundle"), "case").alias("case"), model.bundle_text(F.col("bundle")).alias("bundle"))


@query("""SELECT doc_id, lang, mark, place FROM (SELECT doc_id, lang, md5(concat_ws('|', CAST(doc_id AS VARCHAR), source)) AS mark, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), source))) AS place FROM documents) WHERE place <= 20""", place="INT")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "source")
    return quality.stratified(docs, "lang", 20, F.col("doc_id").cast("string"), F.col("source")).select("doc_id", "lang", "mark", "place")


@query()
def split_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint by a hash of the key; DuckDB has no crc32, so tests hold it against zlib."""
    docs = table(spark, sf_dir, "documents", "doc_id")
    return docs.select("doc_id", quality.halves(F.col("doc_id").cast("string")).alias("half"))


@query("""WITH s AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1), t AS (SELECT sum(n) AS a FROM s),
f AS (SELECT lang, n * 37 // a AS q, n * 37 % a AS rest FROM s, t), r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, lang) AS k, sum(q) OVER () AS given FROM f)
SELECT lang, CAST(q + CASE WHEN k <= 37 - given THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r""")
def language_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents", "lang").where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n"))
    return quality.quotas(sizes, "lang", "n", 37)


@query("""WITH j AS (SELECT lang, source, quality, toxic FROM labels JOIN documents USING (doc_id)),
g AS (SELECT CASE WHEN GROUPING(lang) = 0 THEN 'lang' WHEN GROUPING(source) = 0 THEN 'source' ELSE 'all' END AS dim, CASE WHEN GROUPING(lang) = 0 THEN lang WHEN GROUPING(source) = 0 THEN source ELSE 'all' END AS name,
count(*) AS n, count_if(quality = 1) AS good, count_if(toxic = 1) AS toxic FROM j GROUP BY GROUPING SETS ((), (lang), (source))) SELECT dim, name, n, good, toxic FROM g""", good="BIGINT", toxic="BIGINT")
def label_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents", "doc_id", "lang", "source"), "doc_id")
    return quality.tally(rows, ["lang", "source"], {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})


@query(f"""WITH {UNI}, {BENCH}, {FUZZY}, {POOL}, r AS (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY freq DESC, word) AS k FROM pool),
t AS (SELECT typed, max(word) FILTER (k = 1) AS top, max(freq) FILTER (k = 1) AS f, count(*) AS n FROM r GROUP BY 1),
x AS (SELECT typed, top, f >= 20 AS fired, CASE WHEN length(typed) % 2 = 0 THEN typed ELSE top END AS meant, length(typed) % 3 != 0 AS repair, n > 3 AS found FROM t)
SELECT CASE WHEN NOT repair THEN CASE WHEN fired AND top != typed THEN 'error' ELSE 'success' END WHEN fired AND top != meant THEN 'error' WHEN top = meant THEN CASE WHEN fired THEN 'success' ELSE 'abstention' END
WHEN found THEN 'ranking' ELSE 'discovery' END AS stage, count(*) AS n FROM x GROUP BY 1""")
def stage_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = lookup.top(_pool(spark, sf_dir), ["typed"], [F.desc("freq"), F.asc("word")], 1).select("typed", F.col("word").alias("top"), F.col("freq").alias("f"))
    many = _pool(spark, sf_dir).groupBy("typed").agg(F.count("*").alias("n"))
    rows = best.join(many, "typed").withColumn("meant", F.when(F.length("typed") % 2 == 0, F.col("typed")).otherwise(F.col("top")))
    kind = quality.stage(F.col("typed"), F.col("meant"), F.col("top"), F.col("f") >= 20, F.col("n") > 3, F.length("typed") % 3 != 0)
    return rows.select(kind.alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))


PLAUSIBLE = """pre AS (SELECT typed, word, edits, coalesce(t.freq, 0) AS own, fz.freq, row_number() OVER (PARTITION BY typed ORDER BY fz.freq DESC, word) AS rank,
len(list_filter(range(1, least(length(typed), length(word)) + 1), lambda i: typed[1:i] = word[1:i])) AS p, least(length(typed), length(word)) AS s, greatest(length(typed), length(word)) AS l FROM fz LEFT JOIN (SELECT word AS typed, freq FROM uni) t USING (typed))"""


@query(f"""WITH {UNI}, {BENCH}, {FUZZY}, {PLAUSIBLE} SELECT typed, word, CASE WHEN own > 10 * freq THEN 'AUTOCORRECT_UNDONE'
WHEN s <= 2 AND p = 0 AND edits > 1 OR NOT (2 * p >= s OR edits <= greatest(2, l // 3)) THEN NULL
WHEN p >= 4 AND p >= 0.6 * l AND length(typed) - p BETWEEN 1 AND 5 AND length(word) - p BETWEEN 1 AND 5 THEN 'INFLECTION_MISS' WHEN rank <= 3 THEN 'MISS_OFFERED' ELSE 'MISS_ABSENT' END AS class FROM pre""")
def slip_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours as slips: offered are the three most frequent ones, undone those that a far more frequent word was typed for."""
    uni = lexicon.unigrams(_docs(spark, sf_dir)).select(F.col("word").alias("typed"), F.col("freq").alias("own"))
    found = _fuzzy(spark, sf_dir).join(uni, "typed", "left").withColumn("rank", F.row_number().over(Window.partitionBy("typed").orderBy(F.desc("freq"), "word")))
    rows = found.select("typed", F.col("word").alias("meant"), (F.col("rank") <= 3).alias("offered"), (F.coalesce("own", F.lit(0)) > 10 * F.col("freq")).alias("undone"), F.lit(False).alias("tapped"))
    return sessions.classify(rows).select("typed", F.col("meant").alias("word"), "class")


@query(f"""WITH {UNI}, {BENCH}, {FUZZY} SELECT typed, word, CASE WHEN freq < 2 THEN 'clean-noop' WHEN length(word) > length(typed) THEN 'inflection' WHEN {SKELETON.format('word')} = {SKELETON.format('typed')} THEN 'restoration' WHEN freq > 50 THEN 'context-ranking' ELSE 'NOVEL' END AS kind FROM fz""")
def finding_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"context-ranking": F.col("freq") > 50, "restoration": text.skeleton(F.col("word")) == text.skeleton(F.col("typed")), "inflection": F.length("word") > F.length("typed"), "clean-noop": F.col("freq") < 2}
    return sessions.taxonomy(_fuzzy(spark, sf_dir), rules).select("typed", "word", "kind")


@query("""WITH c AS (SELECT conv_id, turn, length(text) AS n FROM conversations)
SELECT conv_id, turn, coalesce(array_to_string(list(n) OVER w, ','), '') AS before, lag(n) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""", last="INT")
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.collect_list(n).over(order.rowsBetween(-4, -1)), ",").alias("before"), F.lag(n).over(order).alias("last"))


@query("""WITH s AS (SELECT CAST(conv_id AS VARCHAR) AS sid, CAST(turn AS DOUBLE) AS t, coalesce(text, '') AS text FROM conversations),
a AS (SELECT *, lag(text) OVER w AS before, lag(t) OVER w AS before_t FROM s WINDOW w AS (PARTITION BY sid ORDER BY t, text)),
b AS (SELECT *, sign(length(text) - length(before)) AS turn FROM a),
c AS (SELECT *, last_value(CASE WHEN turn != 0 THEN turn END IGNORE NULLS) OVER (PARTITION BY sid ORDER BY t, text ROWS UNBOUNDED PRECEDING) AS way FROM b),
d AS (SELECT *, coalesce(turn < 0 AND coalesce(lag(way) OVER (PARTITION BY sid ORDER BY t, text), 0) >= 0, false) AS begins FROM c),
e AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY t, text ROWS UNBOUNDED PRECEDING) AS nth FROM d)
SELECT * FROM (SELECT sid, max(CASE WHEN begins THEN before_t END) AS peak_t, max(CASE WHEN begins THEN before END) AS peak, arg_max(text, (t, text)) FILTER (way < 0) AS trough, max(t) AS end_t, arg_max(text, (t, text)) AS "end" FROM e WHERE nth > 0 GROUP BY sid, nth) WHERE "end" != peak AND trough != peak""")
def erased_and_retyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes over conversations taken as snapshots."""
    snapshots = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("sid"), F.col("turn").cast("double").alias("t"), "text")
    return sessions.episodes(snapshots)
