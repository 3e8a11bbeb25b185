"""Plans of the review operators over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordmill.functions import edits, model, text
from wordmill.operators import learning, lexicon, lookup, quality, review, sessions
from wordmill.plans.activity import EV, GONE, PAIRS, WC, _counts, _events, _gone, _pairs
from wordmill.plans.corpus import BENCH, BI, CAL, FORMS, FUZZY, POOL, SKELETON, TOK, UNI, _bench, _by_language, _docs, _forms, _fuzzy, _pool
from wordmill.plans.registry import query, table


@query()
def silent_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words that few texts hold, and what common words they may stand for; tests hold it against plain edits."""
    uni = lexicon.unigrams(_docs(spark, sf_dir))
    common = uni.where("freq >= 50")
    rare = _bench(spark, sf_dir, "typed").join(uni.where("freq >= 3").select(F.col("word").alias("typed")), "typed", "left_anti")
    return review.silent_candidates(rare, common, edits.variants("cheap"), lookup.fuzzy(rare, common, 2)).select("typed", "word", "freq", "penalty", "rank")


@query(f"""WITH {TOK}, {BENCH}, lu AS MATERIALIZED (SELECT lang, w AS word FROM tok WHERE lang IN ('en', 'fr') GROUP BY 1, 2),
a AS (SELECT word AS w, word IN (SELECT word FROM lu WHERE lang = 'en') AS en, word IN (SELECT word FROM lu WHERE lang = 'fr') AS fr FROM (SELECT word FROM bw UNION SELECT word || '''s' FROM bw)),
b AS (SELECT *, regexp_extract(w, '^(\\p{{L}}+[^s\\P{{L}}])[''’]s$', 1) AS base FROM a), c AS (SELECT w, en, fr, base != '' AND base IN (SELECT word FROM lu WHERE lang = 'en') AS possessive FROM b) SELECT *, en OR fr OR possessive AS valid FROM c""")
def attested_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _by_language(spark, sf_dir)
    asked = _bench(spark, sf_dir, "w")
    asked = asked.unionByName(asked.select(F.concat("w", F.lit("'s")).alias("w")))
    return review.attested(asked, {k: words.where(F.col("lang") == k).select("word", "freq") for k in ("en", "fr")})


@query(f"""WITH {UNI}, {BENCH}, {FUZZY}, f AS (SELECT typed, word FROM (SELECT typed, word, row_number() OVER (PARTITION BY typed ORDER BY freq DESC, word) AS k FROM fz) WHERE k = 1),
i AS (SELECT typed AS key, min(word) AS intended, length(typed) > 8 AS intentional FROM fz WHERE length(word) = length(typed) GROUP BY 1, 3)
SELECT typed, coalesce(intended, word) AS meant, intended IS NOT NULL AS confirmed, coalesce(intentional, false) AS intentional FROM f LEFT JOIN i ON lower(typed) = key""")
def confirmed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _fuzzy(spark, sf_dir)
    guess = lookup.top(found, ["typed"], [F.desc("freq"), F.asc("word")], 1).select("typed", F.col("word").alias("guess"))
    intents = found.where("length(word) = length(typed)").groupBy(F.col("typed").alias("key")).agg(F.min("word").alias("intended")).withColumn("intentional", F.length("key") > 8)
    return review.with_intents(guess, intents)


@query(f"""WITH {UNI}, {BENCH}, {FUZZY}, r AS (SELECT typed, word, freq, CASE WHEN length(word) = length(typed) THEN 0 ELSE 1 END AS p FROM fz),
o AS (SELECT *, lead(p) OVER w AS p2, lead(freq) OVER w AS f2, row_number() OVER w AS k FROM r WINDOW w AS (PARTITION BY typed ORDER BY p, freq DESC, word)) SELECT typed, word FROM o WHERE k = 1 AND p = 0 AND (p2 IS NULL OR p2 > 0 OR freq >= 3 * f2)""")
def uncontested_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.uncontested(_fuzzy(spark, sf_dir).withColumn("penalty", F.when(F.length("word") == F.length("typed"), 0).otherwise(1)))


@query(f"""WITH {EV}, m AS (SELECT least(count(*), 3) AS a, greatest(count(*) - 3, 0) AS b FROM (SELECT DISTINCT day FROM ev WHERE event_type NOT IN ('view', 'signup'))),
l2 AS (SELECT DISTINCT day FROM ev WHERE event_type NOT IN ('view', 'signup') ORDER BY day DESC LIMIT 3),
c AS (SELECT event_type AS class, count(*) AS total, count(l2.day) AS recent, arg_min(word || ' > ' || event_type, event_id) AS example FROM ev LEFT JOIN l2 USING (day) WHERE event_type NOT IN ('view', 'signup') GROUP BY 1),
r AS (SELECT *, total - recent AS prior, recent / a AS now, CASE WHEN b > 0 THEN (total - recent) / b ELSE 0 END AS was, CASE class WHEN 'error' THEN 'fixed: once' ELSE 'watch' END AS status FROM c, m)
SELECT row_number() OVER (ORDER BY class != 'NOVEL', NOT starts_with(status, 'fixed:'), recent DESC, total DESC, class) AS place, class, status, total, recent, prior,
CASE WHEN was = 0 THEN CASE WHEN recent > 0 THEN 'rising' ELSE 'flat' END WHEN now / was > 1.2 THEN 'rising' WHEN now / was < 0.8 THEN 'falling' ELSE 'flat' END AS trend, example FROM r""", place="INT", recent="BIGINT", prior="BIGINT")
def top_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = _events(spark, sf_dir).select(kind.alias("class"), F.when(kind == "error", "fixed: once").otherwise("watch").alias("status"), F.col("day").alias("session"), F.col("word").alias("typed"), kind.alias("meant"), F.col("event_id").alias("o"))
    return sessions.ranked_gaps(rows, ("view",), ("signup",))


@query("SELECT event_type AS class, count(*) AS n FROM events WHERE event_type IN ('view', 'signup') GROUP BY 1")
def non_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_type").where(F.col("event_type").isin("view", "signup")).groupBy(F.col("event_type").alias("class")).agg(F.count("*").alias("n"))


@query("""SELECT user_id AS sid, count(*) AS committed, count_if(event_type = 'click') AS fired, count_if(event_type = 'error') AS undone, count_if(event_type = 'view') AS taps,
CASE WHEN count_if(event_type = 'click') = 0 THEN 0 ELSE round_even(count_if(event_type = 'error') / count_if(event_type = 'click'), 4) END AS false_positive FROM events GROUP BY 1""", fired="BIGINT", undone="BIGINT", taps="BIGINT")
def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events", "user_id", "event_type").withColumnRenamed("user_id", "sid")
    return sessions.rates(rows, ["sid"], {"committed": F.lit(True), "fired": kind == "click", "undone": kind == "error", "taps": kind == "view"}, {"false_positive": ("undone", "fired")})


@query("SELECT l_returnflag AS key, count(*) AS count, round(sum(l_discount) / count(*), 6) AS mean_dx, round(sum(l_tax) / count(*), 6) AS mean_dy FROM lineitem GROUP BY 1")
def tap_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    taps = table(spark, sf_dir, "lineitem", "l_returnflag", "l_suppkey", "l_discount", "l_tax").withColumnRenamed("l_returnflag", "key")
    return review.merged_offsets(taps, "key", "l_suppkey", "l_discount", "l_tax").select("key", "count", F.round("mean_dx", 6).alias("mean_dx"), F.round("mean_dy", 6).alias("mean_dy"))


@query("""SELECT build, first_day, row_number() OVER (ORDER BY first_day, build) AS place FROM (SELECT user_id % 7 AS build, min(CAST(ts AS DATE)) AS first_day FROM events GROUP BY 1)""", place="INT")
def build_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "user_id", "ts").groupBy((F.col("user_id") % 7).alias("build")).agg(F.min(F.to_date("ts")).alias("first_day"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy("first_day", "build")))


@query("SELECT p_partkey, round(percent_rank() OVER w, 6) AS place, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS quarter FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice)", quarter="INT")
def price_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("p_brand")
    part = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_retailprice")
    return part.select("p_partkey", F.round(F.percent_rank().over(by.orderBy("p_retailprice")), 6).alias("place"), F.ntile(4).over(by.orderBy("p_retailprice", "p_partkey")).alias("quarter"))


@query("""WITH p AS (SELECT user_id, event_id, props AS word, event_type, last_value(CASE WHEN event_type = 'purchase' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, value FROM events)
SELECT user_id AS sid, event_id AS t, word AS applied, prev FROM p WHERE event_type = 'error' OR event_type = 'click' AND word = prev AND value > 5""")
def stale_applies(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").withColumn("word", F.col("props"))
    window = F.when(kind == "purchase", F.concat(F.replace("word", F.lit(" "), F.lit("_")), F.lit(" "))).otherwise("")
    passes = rows.select(F.col("user_id").alias("sid"), F.col("event_id").alias("t"), window.alias("window"), F.when(kind == "error", "stale-skip").when(kind == "click", "autocorrect").otherwise("none").alias("kind"), F.replace("word", F.lit(" "), F.lit("_")).alias("applied"), F.when(F.col("value") > 5, 1).otherwise(0).alias("others"))
    return sessions.stale_applies(passes).select("sid", "t", F.replace("applied", F.lit("_"), F.lit(" ")).alias("applied"), F.replace("prev", F.lit("_"), F.lit(" ")).alias("prev"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.latest_only(table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("SELECT source, v[2] AS doc_id FROM (SELECT source, min((-coalesce(length(text), 0), doc_id)) AS v FROM documents GROUP BY 1)")
def largest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.largest(table(spark, sf_dir, "documents", "doc_id", "source", "text"), "source", F.coalesce(F.length("text"), F.lit(0)), "doc_id")


@query(r"""WITH l AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '(\p{L}+)', 1) AS ws FROM conversations) SELECT conv_id, turn, array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i), ' ') AS words FROM l""")
def distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return rows.select("conv_id", "turn", F.array_join(F.array_distinct(text.words(F.coalesce("text", F.lit("")))), " ").alias("words"))


@query("SELECT conv_id AS sid, arg_max(text, turn) AS text FROM conversations WHERE text != '' GROUP BY 1")
def final_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return sessions.final_texts(rows.select(F.col("conv_id").alias("sid"), F.col("turn").alias("t"), F.lit("snapshot").alias("kind"), "text"))


@query(f"""WITH {UNI}, {BENCH}, q AS (SELECT word AS typed, left(word, -1) AS base FROM bw WHERE length(word) >= 4 AND regexp_full_match(word, '\\p{{L}}{{2,}}s') AND NOT word LIKE '%ss')
SELECT typed, base || '''s' AS word, base, round(freq * 0.1, 6) AS score FROM q JOIN uni ON uni.word = base""", score="DOUBLE")
def possessive_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.possessives(_bench(spark, sf_dir, "typed"), lexicon.unigrams(_docs(spark, sf_dir))).withColumn("score", F.round("score", 6))


@query(f"""WITH {UNI}, t AS (SELECT translate(word, 'áéíóúý', 'aeiouy') AS bare, word AS twin, freq AS f FROM uni WHERE translate(word, 'áéíóúýö', 'aeiouyo') != word AND translate(word, 'áéíóúý', 'aeiouy') != word),
b AS (SELECT bare, min((-f, twin)) AS o FROM t GROUP BY 1) SELECT word, o[2] AS twin FROM uni JOIN b ON word = bare WHERE len(regexp_extract_all(word, '[aeiouy]')) <= 5 AND -o[1] >= 2 * greatest(freq, 1)""")
def accent_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.fold_twins(lexicon.unigrams(_docs(spark, sf_dir)), 2.0)


@query(f"""WITH {UNI}, {FORMS}, {BENCH}, f AS (SELECT form, lemma, CASE bundle & 1 WHEN 1 THEN 'no' ELSE 'ao' END AS pos, bundle & 7 AS "case" FROM fm),
g AS (SELECT form, list_sort(list(DISTINCT lemma)) AS lemmas, count(DISTINCT (lemma, pos)) AS kinds, bool_or(pos IN ('no', 'so', 'lo')) AS open, count(DISTINCT "case") AS cases FROM f GROUP BY 1)
SELECT word, array_to_string(coalesce(lemmas, [word]), ',') AS lemmas, coalesce(kinds, 0) AS n_kinds, coalesce(open, false) AS open, coalesce(cases, 0) AS n_cases FROM bw LEFT JOIN g ON form = word""", n_kinds="INT", n_cases="INT")
def word_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = _forms(spark, sf_dir).select("form", "lemma", F.when(F.col("bundle") % 2 == 1, "no").otherwise("ao").alias("pos"), model.unpack(F.col("bundle"), "case").alias("case"))
    return review.lemmas(_bench(spark, sf_dir), forms).withColumn("lemmas", F.array_join("lemmas", ","))


@query(f"""WITH {UNI}, {BENCH}, {FUZZY} SELECT typed, word, len(list_intersect([typed[1:4], typed[1:5]], [word[1:4], word[1:5]])) AS shared FROM fz""", shared="INT")
def shared_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems = lambda c: F.array_distinct(F.array(F.substring(c, 1, 4), F.substring(c, 1, 5)))
    return _fuzzy(spark, sf_dir).select("typed", "word", F.size(F.array_intersect(stems("typed"), stems("word"))).alias("shared"))


@query(f"""WITH {EV}, {GONE}, {WC}, l AS (SELECT user_id, word, n FROM wc WHERE n >= 2), a AS (SELECT DISTINCT user_id, word FROM ev WHERE event_type = 'signup'),
u AS (SELECT user_id, word, max(n) AS n FROM (SELECT * FROM l UNION ALL SELECT user_id, word, 1 FROM a) GROUP BY 1, 2) SELECT user_id, word, n FROM u ANTI JOIN gone USING (user_id, word)""", n="BIGINT")
def personal_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return review.snapshot(_counts(events).where("n >= 2"), events.where("event_type = 'signup'").select("user_id", "word").distinct(), _gone(events), ["user_id"])


@query(f"""WITH {EV}, {WC}, s AS (SELECT lower(word) AS key, arg_max(word, (n, word)) AS surface FROM wc GROUP BY 1), k AS (SELECT DISTINCT lower(event_type) AS key FROM ev)
SELECT lower(word) AS text, count(*) AS n, CASE WHEN surface IS NULL OR (k.key IS NOT NULL AND (length(surface) > 1 AND surface = upper(surface) AND surface != lower(surface) OR surface = upper(left(lower(word), 1)) || substr(lower(word), 2))) THEN lower(word) ELSE surface END AS shown
FROM ev LEFT JOIN s ON s.key = lower(word) LEFT JOIN k ON k.key = lower(word) GROUP BY 1, 3""")
def restored_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    learned = learning.personal_index(_counts(events).drop("user_id")).select(F.col("key").alias("text"), "surface")
    known = events.select(F.lower("event_type").alias("text"), F.lit(True).alias("known")).distinct()
    rows = events.groupBy(F.lower("word").alias("text")).agg(F.count("*").alias("n")).join(learned, "text", "left").join(known, "text", "left")
    return rows.select("text", "n", review.surface(F.col("text"), F.col("surface"), F.coalesce("known", F.lit(False))).alias("shown"))


@query(f"""WITH {UNI}, {BENCH}, {FUZZY}, v AS (SELECT word FROM uni WHERE freq >= 20), p AS (SELECT 'x' AS lang, typed AS typo, word AS intended FROM fz),
b AS (SELECT DISTINCT lang, 'clean_identity' AS category, intended AS typo, intended FROM p SEMI JOIN v ON v.word = intended UNION SELECT DISTINCT lang, 'valid_word_hard_negative', typo, intended FROM p SEMI JOIN v ON v.word = typo WHERE lower(typo) != lower(intended))
SELECT lang, category, typo, intended, place FROM (SELECT *, row_number() OVER (PARTITION BY lang, category ORDER BY md5(concat_ws('|', lang, category, lower(typo), lower(intended))), concat_ws('|', lang, category, lower(typo), lower(intended))) AS place FROM b) WHERE place <= 100""", place="INT")
def safety_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _fuzzy(spark, sf_dir).select(F.lit("x").alias("lang"), F.col("typed").alias("typo"), F.col("word").alias("intended"))
    valid = lexicon.unigrams(_docs(spark, sf_dir)).where("freq >= 20").select(F.lit("x").alias("lang"), "word")
    return review.safety_pairs(pairs, valid, 100)


@query(f"""WITH {UNI}, {BENCH}, {FUZZY}, {POOL}, r AS (SELECT typed, word, freq, row_number() OVER (PARTITION BY typed ORDER BY freq DESC, word) AS k FROM pool)
SELECT typed, string_agg(word || ':' || freq, ' ' ORDER BY k) AS candidates FROM r WHERE k <= 8 GROUP BY 1""")
def candidate_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.exported(lookup.ranked(_pool(spark, sf_dir), F.col("freq")))
    return rows.select("typed", F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["word"], c["score"].cast("string"))), " ").alias("candidates"))


@query(f"""WITH {UNI}, {BENCH}, {FUZZY}, {POOL}, r AS (SELECT typed, word, freq, row_number() OVER (PARTITION BY typed ORDER BY freq DESC, word) AS k FROM pool) SELECT typed, word AS top FROM r WHERE k = 1 AND NOT (freq >= 20 AND word != typed)""")
def kept_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that nothing would replace by itself."""
    best = lookup.top(_pool(spark, sf_dir), ["typed"], [F.desc("freq"), F.asc("word")], 1)
    return best.where(~((F.col("freq") >= 20) & (F.col("word") != F.col("typed")))).select("typed", F.col("word").alias("top"))


@query(f"""WITH {UNI}, {BENCH}, {FUZZY}, x AS (SELECT word FROM uni WHERE freq < 3) SELECT typed, CAST(min(edits) AS INT) AS cost FROM fz ANTI JOIN x USING (word) GROUP BY 1""")
def best_attested_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _fuzzy(spark, sf_dir)
    return found.join(lexicon.unigrams(_docs(spark, sf_dir)).where("freq < 3").select("word"), "word", "left_anti").groupBy("typed").agg(F.min("edits").cast("int").alias("cost"))


DRAW = "CAST(CAST('0x' || substr(md5(word || '{}'), 1, 8) AS BIGINT) % {} AS INT)"


@query(f"""WITH {BENCH}, d AS (SELECT word, length(word) AS n, {DRAW.format('del', 'length(word)')} + 1 AS a, {DRAW.format('swap', 'greatest(length(word) - 1, 1)')} + 1 AS b, {DRAW.format('double', 'length(word)')} + 1 AS c FROM bw),
s AS (SELECT word, 'deletion' AS category, CASE WHEN n >= 2 THEN substr(word, 1, a - 1) || substr(word, a + 1) END AS typo FROM d UNION ALL SELECT word, 'transposition', CASE WHEN n >= 2 AND word[b] != word[b + 1] THEN substr(word, 1, b - 1) || word[b + 1] || word[b] || substr(word, b + 2) END FROM d
UNION ALL SELECT word, 'gemination', substr(word, 1, c) || substr(word, c) FROM d UNION ALL SELECT word, 'accent_drop', CASE WHEN translate(word, 'áéíóúýö', 'aeiouyo') != word THEN translate(word, 'áéíóúýö', 'aeiouyo') END FROM d) SELECT * FROM s WHERE typo IS NOT NULL""")
def generated_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.slips(_bench(spark, sf_dir))


@query("""WITH q AS (SELECT unnest(['red widget', 'economy', 'bolt', 'g', 'sm', 'larg red', 'wídget']) AS query), f AS (SELECT query, query AS q, 0 AS add FROM q UNION ALL SELECT query, strip_accents(query), 5 FROM q),
e AS (SELECT p_partkey AS id, p_name AS name, lower(p_type) AS other, string_split(p_name, ' ') AS nt, [lower(p_type), '#' || p_name] AS kt, CASE WHEN p_size < 5 THEN p_size END AS seen FROM part),
h AS (SELECT query, add, id, seen, CASE WHEN name = q OR other = q THEN 0 WHEN contains(q, ' ') THEN CASE WHEN list_contains(kt, '#' || q) THEN 1 ELSE list_max(list_transform(string_split(q, ' '), lambda t: CASE WHEN list_contains(nt, t) THEN 2 WHEN len(list_filter(nt, lambda x: starts_with(x, t))) > 0 THEN 3 WHEN len(list_filter(kt, lambda x: starts_with(x, t))) > 0 THEN 4 ELSE 99 END)) END
WHEN list_contains(kt, q) THEN 1 WHEN list_contains(nt, q) THEN 2 WHEN len(list_filter(nt, lambda x: starts_with(x, q))) > 0 THEN 3 WHEN len(list_filter(kt, lambda x: starts_with(x, q))) > 0 THEN 4 END AS hit FROM f, e),
g AS (SELECT query, add, id, seen, hit + add AS hit FROM h WHERE hit < 99), k AS (SELECT query, min(add) AS add FROM g GROUP BY 1)
SELECT query, id, CAST(hit AS INT) AS hit, rank FROM (SELECT g.*, row_number() OVER (PARTITION BY g.query ORDER BY hit, seen NULLS LAST, id) AS rank FROM g JOIN k ON k.query = g.query AND k.add = g.add) WHERE rank <= 24""", rank="INT")
def named_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_size")
    entries = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lower("p_type").alias("other"), F.split("p_name", " ").alias("name_tokens"), F.array(F.lower("p_type"), F.concat(F.lit("#"), "p_name")).alias("keyword_tokens"), F.when(F.col("p_size") < 5, F.col("p_size")).alias("seen"), F.col("p_partkey").alias("o"))
    asked = spark.createDataFrame([(q,) for q in ("red widget", "economy", "bolt", "g", "sm", "larg red", "wídget")], "query string")
    return review.search(entries, asked)


@query(f"""WITH {BENCH}, r AS (SELECT * FROM (VALUES (1, 'THE', 'teh'), (2, 'the', 'a'), (3, 'of', 'off'), (4, 'and', 'and')) v(place, shortcut, "text")),
f AS (SELECT lower(shortcut) AS key, arg_min("text", place) AS "text" FROM r GROUP BY 1) SELECT word AS typed, "text" FROM bw JOIN f ON lower(word) = key WHERE "text" != word""")
def text_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame([(1, "THE", "teh"), (2, "the", "a"), (3, "of", "off"), (4, "and", "and")], "place int, shortcut string, text string")
    return review.replaced(_bench(spark, sf_dir, "typed"), pairs)


@query(f"""WITH {UNI}, {BENCH}, {FUZZY} SELECT typed, word, NOT (starts_with(lower(word), lower(typed)) AND length(typed) < length(word)) AS vouchable, lower(typed) != lower(word) AND length(typed) = length(word) AND {SKELETON.format('typed')} = {SKELETON.format('word')} AS restorable FROM fz""")
def finding_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed, word = F.col("typed"), F.col("word")
    return _fuzzy(spark, sf_dir).select("typed", "word", review.vouchable(typed, word, F.lit("MISS_ABSENT")).alias("vouchable"), review.restorable(typed, word).alias("restorable"))


@query("""SELECT conv_id, turn, regexp_extract(coalesce(lag(text) OVER w, ''), '(\\S*)$', 1) = regexp_extract(coalesce(text, ''), '(\\S*)$', 1) AS applies FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def apply_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the last word of the turn before is still the last one."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("text", F.coalesce("text", F.lit("")))
    before = F.regexp_extract(F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")), r"(\S*)$", 1)
    return rows.select("conv_id", "turn", review.apply_guard(before, F.col("text")).alias("applies"))


@query("SELECT CAST(i AS INT) AS step, round(CASE WHEN t <= 0 THEN 0 WHEN t >= 1 THEN 1 ELSE t * t * (3 - 2 * t) END, 9) AS weight, round(greatest(0.02, 0.35 * (1 - CASE WHEN t <= 0 THEN 0 WHEN t >= 1 THEN 1 ELSE t * t * (3 - 2 * t) END)), 9) AS price FROM (SELECT i, (i / 100.0::DOUBLE - 0.5) / 0.25 AS t FROM range(101) r(i))", weight="DOUBLE", price="DOUBLE")
def fold_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("id") / F.lit(100.0)
    return spark.range(101).select(F.col("id").cast("int").alias("step"), F.round(model.smoothstep(p, 0.5, 0.75), 9).alias("weight"), F.round(model.fold_price(p), 9).alias("price"))


@query(f"""WITH {TOK}, {CAL}, t AS (SELECT lang, sum(freq) AS total FROM lu GROUP BY 1), z AS (SELECT word, lang, (ln((freq + 0.5) / (total + 50000)) - (mean - ln(total + 50000))) / spread AS z FROM lu JOIN cal USING (lang) JOIN t USING (lang)),
p AS (SELECT word, max(z) FILTER (lang = 'en') AS a, max(z) FILTER (lang = 'fr') AS b FROM z WHERE lang IN ('en', 'fr') GROUP BY 1 HAVING count(*) = 2)
SELECT word, round(ln(0.7 * exp(a) + 0.3 * exp(b)), 6) AS score FROM p""")
def blended_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _by_language(spark, sf_dir)
    cal, total = lexicon.calibration(by), by.groupBy("lang").agg(F.sum("freq").alias("total"))
    z = by.where("lang IN ('en', 'fr')").join(cal, "lang").join(total, "lang").withColumn("z", model.z_score(model.unigram_p(F.col("freq"), F.col("total")), F.col("total"), F.col("mean"), F.col("spread")))
    both = z.groupBy("word").agg(F.max(F.when(F.col("lang") == "en", F.col("z"))).alias("a"), F.max(F.when(F.col("lang") == "fr", F.col("z"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return both.select("word", F.round(model.blend(F.lit(0.7), F.col("a"), F.col("b")), 6).alias("score"))


@query(f"""WITH {EV}, {WC}, {PAIRS}, m AS (SELECT user_id, w2 AS word, max(n) AS pair FROM pc GROUP BY 1, 2) SELECT user_id, word, round(least(2 + 0.75 * ln(1 + n), 6) + least(2 * ln(1 + coalesce(pair, 0)), 6), 6) AS boost FROM wc LEFT JOIN m USING (user_id, word)""")
def personal_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    pair = _pairs(events).groupBy("user_id", F.col("w2").alias("word")).agg(F.max("n").alias("pair"))
    return _counts(events).join(pair, ["user_id", "word"], "left").select("user_id", "word", F.round(model.personal_boost(F.col("n"), F.col("pair")), 6).alias("boost"))


@query("""WITH r AS (SELECT * FROM (VALUES (0, 0.0, 'qwertyuiopð'), (1, 0.5, 'asdfghjklæö'), (2, 0.75, 'zxcvbnmþ')) v(y, shift, ks)), k AS (SELECT ks[i] AS key, i - 1 + shift AS x, y FROM r, range(1, 12) g(i) WHERE i <= length(ks))
SELECT a.key AS key, b.key AS near FROM k a, k b WHERE a.key != b.key AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1.5625""")
def adjacent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(edits.adjacent(), "key string, near string")


@query("""SELECT lang, doc_id, place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents) WHERE place <= 20""", place="INT")
def spot_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.top(table(spark, sf_dir, "documents", "lang", "doc_id"), ["lang"], [F.asc("doc_id")], 20, "place").select("lang", "doc_id", "place")


@query(r"""WITH q AS (SELECT regexp_extract_all(lower(text), '(\p{L}+)', 1) AS ws FROM benchmark), t AS (SELECT DISTINCT ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3 FROM q, range(1, 2000) g(i) WHERE i <= len(ws) - 2),
d AS MATERIALIZED (SELECT regexp_extract_all(lower(text), '(\p{L}+)', 1) AS ws FROM documents), n AS (SELECT unnest(list_zip(ws[1:len(ws) - 2], ws[2:len(ws) - 1], ws[3:])) AS p FROM d WHERE len(ws) > 2),
c AS MATERIALIZED (SELECT p[1] AS w1, p[2] AS w2, p[3] AS w3, count(*) AS n FROM n GROUP BY ALL) SELECT w1, w2, w3, coalesce(n, 0) AS n, round(ln(1 + coalesce(n, 0)), 6) AS evidence FROM t LEFT JOIN c USING (w1, w2, w3)""")
def trigram_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    def triples(rows: DataFrame) -> DataFrame:
        listed = rows.select(text.words(F.col("text")).alias("ws")).where(F.size("ws") > 2)
        every = F.transform(F.sequence(F.lit(1), F.size("ws") - 2), lambda i: F.struct(*(F.element_at("ws", i + k).alias(f"w{k + 1}") for k in range(3))))
        return listed.select(F.explode(every).alias("t")).select("t.*")

    asked = triples(table(spark, sf_dir, "benchmark", "text")).distinct()
    counts = triples(_docs(spark, sf_dir)).join(asked, ["w1", "w2", "w3"], "left_semi")
    n = F.coalesce("n", F.lit(0))
    return asked.join(counts.groupBy("w1", "w2", "w3").agg(F.count("*").alias("n")), ["w1", "w2", "w3"], "left").select("w1", "w2", "w3", n.alias("n"), F.round(F.log1p(n), 6).alias("evidence"))


@query("""WITH a AS (SELECT event_type, quantile_cont(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY 1) SELECT 'latency' AS gate, event_type AS name, n >= 20 AND p95 <= 150 AS passed FROM a
UNION ALL SELECT 'cohort', 'l_returnflag', count(DISTINCT l_returnflag) = 1 FROM lineitem""")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gates in one table; a run fails if any row does."""
    report = quality.latency_gate(quality.percentiles(table(spark, sf_dir, "events", "event_type", "value"), ["event_type"], "value"), {"p95": 150.0})
    one = report.select(F.lit("latency").alias("gate"), F.col("event_type").alias("name"), (F.col("status") == "pass").alias("passed"))
    uniform = quality.is_uniform(table(spark, sf_dir, "lineitem", "l_returnflag"), ["l_returnflag"])
    return one.unionByName(uniform.select(F.lit("cohort").alias("gate"), F.lit("l_returnflag").alias("name"), (F.col("l_returnflag") == 1).alias("passed")))


@query("""WITH m AS (SELECT * FROM (VALUES (0, 'a1'), (1, 'b2')) v(k, build)), s AS (SELECT user_id AS sid, count(*) AS n FROM events GROUP BY 1) SELECT coalesce(build, 'unknown') AS build, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS n FROM s LEFT JOIN m ON sid % 3 = k GROUP BY 1""")
def sessions_by_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = spark.createDataFrame([(0, "a1"), (1, "b2")], "k long, build string")
    rows = table(spark, sf_dir, "events", "user_id").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("k", F.col("user_id") % 3)
    return rows.join(F.broadcast(manifest), "k", "left").groupBy(F.coalesce("build", F.lit("unknown")).alias("build")).agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))
