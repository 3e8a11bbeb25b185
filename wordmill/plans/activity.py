"""Plans over events, orders and parts: sessions, learned vocabularies, merges, gates, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.operators import learning, lexicon, lookup, quality, sessions
from wordmill.plans.registry import query, table

DAY = "datediff('day', DATE '1970-01-01', CAST(ts AS DATE))"
EV = f"ev AS (SELECT *, CAST({DAY} AS BIGINT) AS day, props AS word FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("day", learning.day(F.col("ts"))).withColumn("word", F.col("props"))


@query("""WITH n AS (SELECT max(ts) AS now FROM events), s AS (SELECT user_id, event_type, sum(pow(2, -(epoch_us(now) - epoch_us(ts)) / 1e6 / 86400 / 30)) AS score, max(ts) AS last_touch FROM events, n GROUP BY 1, 2)
SELECT user_id, event_type, round(score, 6) AS score FROM s""")
def frecency(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rows = events.crossJoin(F.broadcast(events.agg(F.max("ts").alias("now"))))
    return learning.frecency(rows, ["user_id", "event_type"], "ts", F.col("now")).select("user_id", "event_type", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT user_id, event_type, count(*) AS score FROM events WHERE event_type != 'view' GROUP BY 1, 2), seed AS (SELECT * FROM (VALUES ('view', 1), ('click', 2), ('share', 3)) v(event_type, place)),
a AS (SELECT user_id, event_type, 0 AS o, -score AS p FROM s UNION ALL SELECT u.user_id, seed.event_type, 1, place FROM (SELECT DISTINCT user_id FROM s) u, seed WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = u.user_id AND s.event_type = seed.event_type))
SELECT user_id, event_type, slot FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o, p, event_type) AS slot FROM a) WHERE slot <= 5""", slot="INT")
def recent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "events", "user_id", "event_type").where("event_type != 'view'").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("score"))
    seeds = spark.createDataFrame([("view", 1), ("click", 2), ("share", 3)], "event_type string, place int")
    return learning.recents(scores, seeds, ["user_id"], "event_type", 5)


LATENCY = "p AS (SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS most FROM events GROUP BY 1)"


@query(f"""WITH {LATENCY} SELECT *, CASE WHEN n < 20 THEN 'insufficient-data' WHEN over != '' THEN 'fail' ELSE 'pass' END AS status FROM (SELECT *, concat_ws(',', CASE WHEN p50 > 35 THEN 'p50' END, CASE WHEN p95 > 150 THEN 'p95' END) AS over FROM p)""")
def latency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.percentiles(table(spark, sf_dir, "events", "event_type", "value"), ["event_type"], "value")
    return quality.latency_gate(report, {"p50": 35.0, "p95": 150.0})


@query("SELECT count(DISTINCT l_returnflag) AS l_returnflag, count(DISTINCT l_linestatus) AS l_linestatus FROM lineitem")
def cohort_uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.is_uniform(table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus"), ["l_returnflag", "l_linestatus"])


@query("""SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean_x, round(avg(l_discount), 6) AS mean_y, round(var_pop(l_quantity), 6) AS var_x, round(var_pop(l_discount), 6) AS var_y, round(covar_pop(l_quantity, l_discount), 6) AS cov FROM lineitem GROUP BY 1""")
def touch_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = learning.touch_stats(table(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity", "l_discount"), ["l_returnflag"], "l_quantity", "l_discount")
    return found.select("l_returnflag", "n", F.round("mean_x", 6).alias("mean_x"), F.round("mean_y", 6).alias("mean_y"), *(F.round(F.col(a) / F.col("n"), 6).alias(b) for a, b in (("m2_x", "var_x"), ("m2_y", "var_y"), ("c_xy", "cov"))))


@query("""WITH s AS (SELECT user_id % 7 AS build, count(*) AS n, count_if(event_type = 'click') AS fired, count_if(event_type = 'error') AS undone FROM events GROUP BY 1)
SELECT build, n, fired, undone, CASE WHEN fired = 0 THEN 0 ELSE round_even(undone / fired, 4) END AS undo_rate, CASE WHEN n = 0 THEN 0 ELSE round_even(fired / n, 4) END AS fire_rate FROM s""", fired="BIGINT", undone="BIGINT")
def build_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "user_id", "event_type").withColumn("build", F.col("user_id") % 7)
    kind = F.col("event_type")
    return sessions.rates(rows, ["build"], {"n": F.lit(True), "fired": kind == "click", "undone": kind == "error"}, {"undo_rate": ("undone", "fired"), "fire_rate": ("fired", "n")})


@query(f"""WITH {EV}, ds AS (SELECT DISTINCT day FROM ev), l AS (SELECT day FROM ds ORDER BY day DESC LIMIT 3), m AS (SELECT least(count(*), 3) AS a, greatest(count(*) - 3, 0) AS b FROM ds),
c AS (SELECT word, count(*) AS total, count(l.day) AS recent FROM ev LEFT JOIN l USING (day) GROUP BY 1), r AS (SELECT *, total - recent AS prior, recent / a AS now, CASE WHEN b > 0 THEN (total - recent) / b ELSE 0 END AS was FROM c, m)
SELECT word, total, recent, prior, CASE WHEN a = 0 THEN 'none' WHEN was = 0 THEN CASE WHEN recent > 0 THEN 'rising' ELSE 'flat' END WHEN now / was > 1.2 THEN 'rising' WHEN now / was < 0.8 THEN 'falling' ELSE 'flat' END AS trend FROM r""", prior="BIGINT", recent="BIGINT")
def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.trends(_events(spark, sf_dir), "word", "day")


@query(f"""WITH {EV} SELECT lower(event_type) AS typed, lower(word) AS meant, count(*) AS n, count(DISTINCT user_id) AS sessions, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds, CASE WHEN count(*) >= 15 THEN 'tune' ELSE 'watch' END AS action FROM ev GROUP BY 1, 2""")
def slip_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.patterns(_events(spark, sf_dir), "event_type", "word", "user_id", "event_type", 15)


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events""")
def last_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    return sessions.as_of(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_id"), "last_purchase").select("event_id", "last_purchase")


@query("""SELECT p.event_id, count(c.event_id) AS n FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON c.user_id = p.user_id AND c.ts <= p.ts AND epoch_us(c.ts) > epoch_us(p.ts) - CAST(21600000000 AS BIGINT) GROUP BY 1""")
def clicks_before_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    return sessions.interval_counts(events.where("event_type = 'purchase'"), events.where("event_type = 'click'"), "user_id", "ts", 21600).select("event_id", "n")


@query("""WITH w AS (SELECT event_id, value / 500 AS p, coalesce(lag(value / 500) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0.5) AS p_before FROM events) SELECT event_id, round(p, 6) AS p, round(p_before, 6) AS p_before FROM w WHERE abs(p - p_before) > 0.35""")
def lane_whiplash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("p", F.col("value") / 500)
    return sessions.whiplash(rows, ["user_id"], ["ts", "event_id"], "p").select("event_id", F.round("p", 6).alias("p"), F.round("p_before", 6).alias("p_before"))


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE WHEN event_type IN ('click', 'purchase') THEN 0.7 WHEN event_type = 'error' THEN -0.9 ELSE 0 END AS v FROM events),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(0.5 AS DOUBLE) AS p FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT user_id, k, least(greatest(o / (1 + o), 0.1), 0.9) FROM (SELECT e.user_id, e.k, (0.92 * p + 0.08 * (1 - p)) / (1 - (0.92 * p + 0.08 * (1 - p))) * exp(CAST(v AS DOUBLE)) AS o FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1))
SELECT user_id, k - 1 AS pos, round(p, 6) AS p FROM f WHERE k > 0""")
def lane_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").withColumn("v", F.when(kind.isin("click", "purchase"), 0.7).when(kind == "error", -0.9).otherwise(0.0))
    steps = sessions.posterior(rows, "user_id", ["ts", "event_id"], "v").select("user_id", F.posexplode("steps").alias("pos", "p"))
    return steps.select("user_id", F.col("pos").cast("long").alias("pos"), F.round("p", 6).alias("p"))


@query("""WITH d AS (SELECT user_id, ts, event_id, sum(CASE WHEN event_type IN ('signup', 'click') THEN 1 WHEN event_type = 'view' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS depth FROM events)
SELECT user_id, CAST(max(depth) AS BIGINT) AS most, CAST(arg_max(depth, (ts, event_id)) AS BIGINT) AS left_over FROM d GROUP BY 1""")
def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return sessions.backlog(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.when(kind.isin("signup", "click"), 1).when(kind == "view", -1).otherwise(0))


GONE = "gone AS (SELECT DISTINCT user_id, word FROM ev WHERE event_type = 'error' AND value > 60)"


def _gone(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'error' AND value > 60").select("user_id", "word").distinct()


@query(f"""WITH {EV}, {GONE} SELECT user_id, word, count(*) AS n, count(DISTINCT day) AS n_days, bool_or(event_type = 'purchase') AS explicit FROM ev WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.user_id = ev.user_id AND gone.word = ev.word) GROUP BY 1, 2 HAVING count(DISTINCT day) >= 2 OR bool_or(event_type = 'purchase')""")
def learned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return learning.learned(events, ["user_id"], "word", "day", F.col("event_type") == "purchase", _gone(events))


@query(f"""WITH {EV}, f AS (SELECT word, day, min((ts, event_id)) AS o FROM ev GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY o, day) AS k FROM f),
d AS (SELECT word, array_to_string(list(day ORDER BY k), ',') AS days FROM r WHERE k <= 8 GROUP BY 1)
SELECT word, days, count(*) AS n, count_if(event_type = 'view') AS n_is, count_if(event_type = 'click') AS n_en, count_if(event_type NOT IN ('view', 'click')) AS n_unknown, bool_or(event_type = 'purchase') AS explicit FROM ev JOIN d USING (word) GROUP BY 1, 2""", n_en="BIGINT", n_is="BIGINT", n_unknown="BIGINT")
def word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = _events(spark, sf_dir).select("word", "day", "ts", "event_id", F.when(kind == "view", "is").when(kind == "click", "en").otherwise("unknown").alias("hint"), (kind == "purchase").alias("explicit"))
    return learning.word_stats(rows, [], ["ts", "event_id"]).withColumn("days", F.array_join("days", ","))


PAIRS = "pq AS (SELECT user_id, lag(word) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS w1, word AS w2 FROM ev), pc AS (SELECT user_id, w1, w2, count(*) AS n FROM pq WHERE w1 IS NOT NULL GROUP BY 1, 2, 3)"


def _pairs(events: DataFrame) -> DataFrame:
    rows = sessions.as_of(events, ["user_id"], ["ts", "event_id"], F.lit(True), F.col("word"), "w1").where("w1 IS NOT NULL")
    return rows.groupBy("user_id", "w1", F.col("word").alias("w2")).agg(F.count("*").alias("n"))


@query(f"""WITH {EV}, {GONE}, {PAIRS} SELECT * FROM pc WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.user_id = pc.user_id AND (g.word = w1 OR g.word = w2))""")
def personal_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return learning.without(_pairs(events), _gone(events), ["w1", "w2"], ["user_id"]).select("user_id", "w1", "w2", "n")


@query(f"""WITH {EV}, {PAIRS} SELECT user_id, w1, w2, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, w1, w2) AS k FROM pc) WHERE k <= 10""")
def capped_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.capped(_pairs(_events(spark, sf_dir)), ["user_id"], 10, [F.desc("n"), F.asc("w1"), F.asc("w2")]).select("user_id", "w1", "w2", "n")


WC = "wc AS (SELECT user_id, word, count(*) AS n, bool_or(event_type = 'purchase') AS explicit FROM ev GROUP BY 1, 2)"


def _counts(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "word").agg(F.count("*").alias("n"), F.bool_or(F.col("event_type") == "purchase").alias("explicit"))


@query(f"""WITH {EV}, {WC}, t AS (SELECT user_id, sum(n) > 60 AS over FROM wc GROUP BY 1) SELECT user_id, word, CASE WHEN over THEN CAST(floor(n * 0.5) AS BIGINT) ELSE n END AS n, explicit FROM wc JOIN t USING (user_id) WHERE NOT over OR floor(n * 0.5) > 0 OR explicit""")
def decayed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.decayed(_counts(_events(spark, sf_dir)), ["user_id"], 60, F.col("explicit")).select("user_id", "word", "n", "explicit")


@query(f"""WITH {EV}, {WC}, r AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS size, row_number() OVER (PARTITION BY user_id, explicit ORDER BY n, word DESC) AS k FROM wc) SELECT user_id, word, n, explicit FROM r WHERE explicit OR k > size - 30""")
def evicted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.evicted(_counts(_events(spark, sf_dir)), ["user_id"], 30, F.col("explicit")).select("user_id", "word", "n", "explicit")


REP = """rep AS (SELECT user_id, word, event_id % 2 AS r, count(*) AS n, bool_or(event_type = 'purchase') AS explicit, list(DISTINCT day) AS days, count_if(event_type = 'click') AS touch_n,
round(avg(value), 4) AS x, round(avg(day), 4) AS y, round(var_pop(value), 4) AS xx, round(var_pop(day), 4) AS yy, round(covar_pop(value, day), 4) AS xy FROM ev GROUP BY 1, 2, 3)"""


@query(f"""WITH {EV}, {GONE}, {REP},
g AS (SELECT user_id, word, max(n) AS n, bool_or(explicit) AS explicit, array_to_string(list_sort(list_distinct(flatten(list(days))))[1:8], ',') AS days, min((-touch_n, x, y, xx, yy, xy)) AS t FROM rep ANTI JOIN gone USING (user_id, word) GROUP BY 1, 2)
SELECT user_id, word, n, explicit, days, -t[1] AS touch_n, t[2] AS x, t[3] AS y, t[4] AS xx, t[5] AS yy, t[6] AS xy FROM g""", touch_n="BIGINT")
def merged_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).withColumn("r", F.col("event_id") % 2)
    rounded = lambda c, name: (F.round(c * 10_000) / 10_000).alias(name)
    taps = F.array_sort(F.collect_list(F.struct("event_id", "value", "day")))  # SQL takes them as they are stored, by event_id
    counts = [F.count("*").alias("n"), F.bool_or(F.col("event_type") == "purchase").alias("explicit"), F.collect_set("day").alias("days"), F.count_if(F.col("event_type") == "click").alias("touch_n"), F.avg("day").alias("y"), taps.alias("taps")]
    rows = events.groupBy("user_id", "word", "r").agg(*counts).withColumn("t", learning.folded(F.col("taps"), "value", "day"))
    touch = [F.col("touch_n").alias("n"), rounded(F.col("t.x"), "x"), rounded(F.col("y"), "y"), *(rounded(F.col(f"t.{c}"), c) for c in ("xx", "yy", "xy"))]
    rows = rows.select("user_id", "word", "r", "n", "explicit", "days", F.struct(*touch).alias("touch"))
    out = learning.merged(rows, ["user_id"], _gone(events)).withColumn("days", F.array_join("days", ","))
    return out.select("user_id", "word", "n", "explicit", "days", F.col("touch.n").alias("touch_n"), *(F.col(f"touch.{c}").alias(c) for c in ("x", "y", "xx", "yy", "xy")))


@query(f"""WITH {EV}, {GONE}, pq AS (SELECT user_id, event_id % 2 AS r, lag(word) OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) AS w1, word AS w2 FROM ev),
pc AS (SELECT user_id, r, w1, w2, count(*) AS n FROM pq WHERE w1 IS NOT NULL GROUP BY 1, 2, 3, 4), m AS (SELECT user_id, w1, w2, max(n) AS n FROM pc WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.user_id = pc.user_id AND (g.word = w1 OR g.word = w2)) GROUP BY 1, 2, 3)
SELECT user_id, w1, w2, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, w1 || ' ' || w2) AS k FROM m) WHERE k <= 20""")
def merged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).withColumn("r", F.col("event_id") % 2)
    pairs = sessions.as_of(events, ["user_id", "r"], ["ts", "event_id"], F.lit(True), F.col("word"), "w1").where("w1 IS NOT NULL").groupBy("user_id", "r", "w1", F.col("word").alias("w2")).agg(F.count("*").alias("n"))
    return learning.merged_pairs(pairs, ["user_id"], _gone(events), 20).select("user_id", "w1", "w2", "n")


@query(f"""WITH {EV}, a AS (SELECT word, count(*) AS n FROM ev WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT word, count(*) AS n FROM ev WHERE event_id % 2 = 1 GROUP BY 1) SELECT coalesce(a.word, b.word) AS word, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS n FROM a FULL JOIN b ON a.word = b.word""")
def merged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    side = lambda k: events.where(F.col("event_id") % 2 == k).groupBy("word").agg(F.count("*").alias("n"))
    return learning.merge_two(side(0), side(1), ["word"])


@query(f"""WITH {EV}, {GONE}, {WC}, new AS (SELECT DISTINCT user_id, word FROM ev WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.user_id = ev.user_id AND g.word = ev.word)),
old AS (SELECT * FROM wc WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.user_id = wc.user_id AND g.word = wc.word))
SELECT coalesce(old.user_id, new.user_id) AS user_id, coalesce(old.word, new.word) AS word, CASE WHEN new.word IS NULL THEN n ELSE greatest(coalesce(n, 0), 3) END AS n, coalesce(explicit, false) OR new.word IS NOT NULL AS explicit FROM old FULL JOIN new ON old.user_id = new.user_id AND old.word = new.word""")
def imported_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    counts, gone = _counts(events), _gone(events)
    words, _, tombstones = learning.delete_word(counts, _pairs(events), gone.limit(0), gone, ["user_id"])
    return learning.imported(words, events.where("event_type = 'signup'").select("user_id", "word"), tombstones, ["user_id"])


@query(f"""WITH {EV}, {WC} SELECT lower(word) AS key, CAST(sum(n) AS BIGINT) AS n, arg_max(word, (n, word)) AS surface, bool_or(explicit) AS explicit FROM wc GROUP BY 1""")
def personal_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.personal_index(_counts(_events(spark, sf_dir)).drop("user_id"))


GATE = "(SELECT o_orderstatus, o_orderpriority, count(*) AS n, count_if(o_totalprice > 200000) AS top1, count_if(o_totalprice < 5000) AS false_ac FROM orders WHERE o_orderkey % 2 = {} GROUP BY 1, 2)"


@query(f"""WITH j AS (SELECT coalesce(a.o_orderstatus, b.o_orderstatus) AS o_orderstatus, coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority,
concat_ws(',', CASE WHEN a.n IS NULL THEN 'missing' END, CASE WHEN b.n IS NULL THEN 'new' END, CASE WHEN a.top1 < b.top1 THEN 'top1 fell' END, CASE WHEN a.false_ac > b.false_ac THEN 'false_ac rose' END, CASE WHEN a.n != b.n THEN 'n differs' END) AS why
FROM {GATE.format(0)} a FULL JOIN {GATE.format(1)} b ON a.o_orderstatus = b.o_orderstatus AND a.o_orderpriority = b.o_orderpriority) SELECT o_orderstatus, o_orderpriority, why = '' AS passed, why FROM j""")
def baseline_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    side = lambda k: orders.where(F.col("o_orderkey") % 2 == k).groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("top1"), F.count_if(F.col("o_totalprice") < 5000).alias("false_ac"))
    return quality.gate(side(0), side(1), ["o_orderstatus", "o_orderpriority"], ["top1"], ["false_ac"], ["n"])


@query("""WITH t AS (SELECT l_returnflag, l_linestatus, count_if(l_discount > 0.05) AS a, count_if(l_discount > 0.07) AS b, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_linestatus, b - a AS d_hits, 0 AS d_n FROM t""", d_hits="BIGINT")
def ablation_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_returnflag", "l_linestatus"]
    rows = table(spark, sf_dir, "lineitem", *keys, "l_discount")
    side = lambda x: rows.groupBy(*keys).agg(F.count_if(F.col("l_discount") > x).alias("hits"), F.count("*").alias("n"))
    return quality.deltas(side(0.05), side(0.07), keys, ["hits", "n"]).withColumn("d_n", F.col("d_n").cast("int"))


@query("""SELECT p_brand, p_type, 'left' AS side FROM (SELECT p_brand, p_type FROM part WHERE p_partkey % 2 = 0 EXCEPT ALL SELECT p_brand, p_type FROM part WHERE p_partkey % 2 = 1)
UNION ALL SELECT p_brand, p_type, 'right' FROM (SELECT p_brand, p_type FROM part WHERE p_partkey % 2 = 1 EXCEPT ALL SELECT p_brand, p_type FROM part WHERE p_partkey % 2 = 0)""")
def cohort_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type")
    side = lambda k: part.where(F.col("p_partkey") % 2 == k).select("p_brand", "p_type")
    return quality.set_difference(side(0), side(1))


@query("""SELECT event_id, user_id, event_type, duplicates FROM (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id, event_type) - 1 AS duplicates FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE k = 1""")
def first_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.first_wins(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")]).select("event_id", "user_id", "event_type", "duplicates")


@query("""WITH o AS (SELECT lower(event_type) AS a, word, event_id FROM (SELECT event_type, props AS word, min(event_id) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2)),
n AS (SELECT lower(event_type) AS a, props AS word, min(event_id) AS event_id FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2) SELECT a AS event_type, word, event_id FROM o UNION ALL SELECT a, word, event_id FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.a = n.a AND o.word = n.word)""")
def upserted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    old = events.where(F.col("event_id") % 2 == 0).groupBy("event_type", "word").agg(F.min("event_id").alias("event_id"))
    new = events.where(F.col("event_id") % 2 == 1).select("event_type", "word", "event_id")
    return quality.upsert(old, new, [F.lower("event_type"), F.col("word")])


@query("""SELECT token, array_to_string(list_sort(list(DISTINCT p_partkey)), ',') AS keys, count(DISTINCT p_partkey) AS postings FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part) GROUP BY 1""")
def part_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part", "p_partkey", "p_name").withColumn("tokens", F.split("p_name", " "))
    return lexicon.inverted_index(rows, "p_partkey", "tokens").withColumn("keys", F.array_join("keys", ","))


@query("""WITH nm AS (SELECT p_brand || ' ' || p_name AS term, p_partkey AS owner FROM part), kw AS (SELECT p_name AS term, p_partkey AS owner FROM part UNION ALL SELECT p_brand || ' ' || p_type, p_partkey FROM part),
a AS (SELECT term, min(owner) AS owner FROM nm GROUP BY 1 HAVING min(owner) = max(owner)), b AS (SELECT term, min(owner) AS owner FROM kw GROUP BY 1 HAVING min(owner) = max(owner))
SELECT term, owner, 'name' AS kind FROM a UNION ALL SELECT term, owner, 'keyword' FROM b WHERE term NOT IN (SELECT term FROM nm)""")
def unique_part_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type")
    names = part.select(F.concat_ws(" ", "p_brand", "p_name").alias("term"), F.col("p_partkey").alias("owner"))
    keywords = part.select(F.col("p_name").alias("term"), F.col("p_partkey").alias("owner")).unionByName(part.select(F.concat_ws(" ", "p_brand", "p_type").alias("term"), F.col("p_partkey").alias("owner")))
    return lexicon.unique_terms(names, keywords)


@query("""WITH q AS (SELECT unnest(['red widget', 'economy', 'bolt', 'g', 'sm', 'large']) AS query),
r AS (SELECT query, p_partkey, CASE WHEN p_name = query THEN 0 WHEN lower(p_type) = query THEN 1 WHEN list_contains(string_split(p_name, ' '), query) THEN 2 WHEN len(list_filter(string_split(p_name, ' '), lambda t: starts_with(t, query))) > 0 THEN 3 WHEN starts_with(lower(p_type), query) THEN 4 END AS hit FROM q, part)
SELECT query, p_partkey, hit, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hit, p_partkey) AS rank FROM r WHERE hit IS NOT NULL) WHERE rank <= 24""", rank="INT")
def part_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.explode(F.array(*map(F.lit, ("red widget", "economy", "bolt", "g", "sm", "large"))))
    rows = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type").withColumn("query", asked)
    hit = quality.search_rank(F.col("query"), F.col("p_name"), F.split("p_name", " "), F.array(F.lower("p_type")))
    return lookup.top(rows.withColumn("hit", hit).where("hit IS NOT NULL"), ["query"], [F.asc("hit"), F.asc("p_partkey")], 24).select("query", "p_partkey", "hit", "rank")
