"""Plans of the candidate providers and of what is applied, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordmill.functions.text import TLDS
from wordmill.operators import learning, lexicon, lookup, providers
from wordmill.plans.activity import EV, WC, _counts, _events
from wordmill.plans.corpus import BENCH, FUZZY, SKELETON, UNI, _bench, _docs, _fuzzy
from wordmill.plans.registry import query, table

DEDOUBLED = "SELECT DISTINCT word AS typed, substr(word, 1, i) || substr(word, i + 2) AS base FROM bw, range(1, 60) g(i) WHERE i < length(word) AND word[i] = word[i + 1]"


def _uni(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.unigrams(_docs(spark, sf_dir))


@query(f"""WITH {UNI}, {BENCH}, t AS (SELECT word AS typed, substr(word, 1, i) || substr(word, i) AS base FROM bw, range(1, 60) g(i) WHERE i <= length(word) UNION {DEDOUBLED})
SELECT typed, word, freq FROM t JOIN uni ON word = base WHERE word != typed""")
def gemination_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.gemination(_bench(spark, sf_dir, "typed"), _uni(spark, sf_dir))


@query(f"""WITH {UNI}, {BENCH}, t AS ({DEDOUBLED}) SELECT DISTINCT typed, word, freq FROM t JOIN uni ON {SKELETON.format('word')} = base
WHERE word != base AND word != typed AND len(list_filter(range(1, length(word) + 1), lambda i: word[i] != base[i])) <= 2""")
def gemination_restorations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.gemination_restoration(_bench(spark, sf_dir, "typed"), _uni(spark, sf_dir))


SHORTER = """a AS (SELECT typed, substr(typed, 1, n) AS prefix FROM far, range(3, 60) g(n) WHERE n >= greatest(3, length(typed) - 4) AND n <= {}),
p AS (SELECT DISTINCT prefix FROM a), w AS (SELECT prefix, word, freq, row_number() OVER (PARTITION BY prefix ORDER BY freq DESC, word) AS r FROM p JOIN {} u ON starts_with(u.key, prefix))
SELECT DISTINCT typed, word, freq FROM a JOIN w USING (prefix) WHERE r <= 8 AND word != typed"""


@query(f"""WITH {UNI}, {BENCH}, {FUZZY}, far AS (SELECT word AS typed FROM bw WHERE length(word) >= 5 AND word NOT IN (SELECT typed FROM fz)), k AS (SELECT word, freq, word AS key FROM uni), {SHORTER.format('length(typed) - 1', 'k')}""")
def shorter_prefix_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.shorter_prefixes(_bench(spark, sf_dir, "typed"), _uni(spark, sf_dir), _fuzzy(spark, sf_dir))


@query(f"""WITH {UNI}, {BENCH}, {FUZZY}, far AS (SELECT word AS typed FROM bw WHERE length(word) >= 5 AND word NOT IN (SELECT typed FROM fz WHERE freq >= 5)), k AS (SELECT word, freq, {SKELETON.format('word')} AS key FROM uni WHERE {SKELETON.format('word')} != word), {SHORTER.format('length(typed)', 'k')}""")
def diacritic_prefix_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.diacritic_prefixes(_bench(spark, sf_dir, "typed"), _uni(spark, sf_dir), _fuzzy(spark, sf_dir).where("freq >= 5"))


@query(f"""WITH {EV}, {WC}, i AS (SELECT lower(word) AS word, CAST(sum(n) AS BIGINT) AS freq FROM wc GROUP BY 1), t AS (SELECT DISTINCT substr(lower(word), 1, 7) AS typed FROM ev),
w AS (SELECT typed, word, freq, row_number() OVER (PARTITION BY typed ORDER BY freq DESC, word) AS r FROM t JOIN i ON starts_with(word, typed)) SELECT typed, word, freq FROM w WHERE r <= 8 AND word != typed""")
def personal_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    own = learning.personal_index(_counts(events).drop("user_id")).select(F.col("key").alias("word"), F.col("n").alias("freq"))
    return providers.personal_completions(events.select(F.expr("substring(lower(word), 1, 7)").alias("typed")), own)


@query(rf"""WITH {UNI}, t AS (SELECT DISTINCT unnest(string_split_regex(text, '\s+')) AS typed FROM documents), p AS (SELECT typed, split_part(lower(typed), '.', 1) AS a, split_part(lower(typed), '.', 2) AS b FROM t WHERE regexp_full_match(typed, '\p{{L}}+\.\p{{L}}+'))
SELECT typed, a || ' ' || b AS word, least(x.freq, y.freq) AS freq FROM p JOIN uni x ON x.word = a JOIN uni y ON y.word = b WHERE b NOT IN {TLDS}""")
def dotted_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents", "text").select(F.explode(F.split("text", r"\s+")).alias("typed"))
    return providers.dotted(tokens, _uni(spark, sf_dir), TLDS)


@query(f"""WITH {BENCH}, n AS (SELECT min(word) AS typed FROM bw) SELECT typed, 'written apart' AS word FROM n""")
def never_compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed table extended by a word that the benchmark has."""
    words = _bench(spark, sf_dir, "typed")
    return providers.never_compound(words, providers.NEVER_COMPOUNDS | {words.agg(F.min("typed")).first()[0]: "written apart"})


@query(f"""WITH {UNI}, {BENCH}, {FUZZY}, r AS (SELECT typed, word, edits, ln(freq + 0.5) AS score, row_number() OVER w AS k, ln(freq + 0.5) - lead(ln(freq + 0.5)) OVER w AS margin FROM fz WINDOW w AS (PARTITION BY typed ORDER BY freq DESC, word)),
x AS (SELECT *, score - 4 AS z FROM r WHERE k = 1) SELECT typed, word, length(typed) >= 2 AND 2 * edits <= 6 AND coalesce(margin, 'inf'::DOUBLE) >= CASE WHEN z < -1 THEN 1.15 * 3 ELSE 1.15 END
AND z >= greatest(-2.5, CASE WHEN edits >= 3 THEN 0 ELSE -2.5 END, CASE WHEN length(typed) <= 2 THEN 1.5 ELSE -2.5 END) AND NOT (length(typed) <= 2 AND length(word) > length(typed) AND starts_with(word, typed)) AS applied FROM x""")
def applied_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("typed").orderBy(F.desc("freq"), "word")
    score = F.log(F.col("freq") + 0.5)
    best = _fuzzy(spark, sf_dir).withColumn("margin", score - F.lead(score).over(order)).withColumn("k", F.row_number().over(order)).where("k = 1")
    told = providers.applies(F.col("typed"), F.col("word"), F.col("margin"), 2 * F.col("edits"), score - 4, F.col("edits"), F.lit(None).cast("double"))
    return best.select("typed", "word", told.alias("applied"))


@query(f"""WITH {UNI}, {BENCH}, {FUZZY}, s AS (SELECT typed, word, ln(freq + 0.5) AS score, CASE edits % 2 WHEN 1 THEN CASE WHEN length(word) > length(typed) THEN 'compound' ELSE 'split' END END AS provider FROM fz),
w AS (SELECT *, min(score) FILTER (provider = 'split') OVER (PARTITION BY typed) AS worst FROM s) SELECT typed, word, round(CASE WHEN provider = 'compound' AND worst IS NOT NULL THEN least(score, worst) ELSE score END, 6) AS score FROM w""")
def split_capped_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer words as compounds, others as splits."""
    rows = _fuzzy(spark, sf_dir).withColumn("score", F.log(F.col("freq") + 0.5)).withColumn("provider", F.when(F.length("word") > F.length("typed"), "compound").otherwise("split"))
    return lookup.capped_by_splits(rows).select("typed", "word", F.round("score", 6).alias("score"))
