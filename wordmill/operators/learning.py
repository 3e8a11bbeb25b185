"""Learned vocabularies: folding of events, decay, caps, merges, and edits of a personal model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day(time: Column) -> Column:
    """Whole UTC days since 1970."""
    return F.floor(F.unix_micros(time) / 86_400_000_000)


def learned(events: DataFrame, by: list[str], word: str, days: str, explicit: Column, tombstones: DataFrame | None = None, least_days: int = 2) -> DataFrame:
    """Words seen on `least_days` days or taken on purpose, minus those that were deleted."""
    out = events.groupBy(*by, word).agg(F.count("*").alias("n"), F.count_distinct(days).alias("n_days"), F.bool_or(explicit).alias("explicit"))
    out = out.where((F.col("n_days") >= least_days) | F.col("explicit"))
    return out if tombstones is None else out.join(tombstones, [*by, word], "left_anti")


def word_stats(events: DataFrame, by: list[str], order: list[str], most_days: int = 8) -> DataFrame:
    """Counts by hint, the first distinct days in order of arrival, and whether a word was ever taken on purpose (word, hint, day, explicit)."""
    first = events.groupBy(*by, "word", "day").agg(F.min(F.struct(*order)).alias("__first"))
    first = first.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "word").orderBy("__first", "day"))).where(F.col("__r") <= most_days)
    days = first.groupBy(*by, "word").agg(F.transform(F.sort_array(F.collect_list(F.struct("__r", "day"))), lambda x: x["day"]).alias("days"))
    counts = events.groupBy(*by, "word").agg(F.count("*").alias("n"), *(F.count_if(F.col("hint") == h).alias(f"n_{h}") for h in ("is", "en", "unknown")), F.bool_or("explicit").alias("explicit"))
    return counts.join(days, [*by, "word"])


def without(rows: DataFrame, tombstones: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Rows none of whose words was deleted (tombstones: by and word)."""
    for key in keys:
        rows = rows.join(tombstones.select(*by, F.col("word").alias(key)), [*by, key], "left_anti")
    return rows


def decayed(counts: DataFrame, by: list[str], ceiling: int, protected: Column, factor: float = 0.5) -> DataFrame:
    """Groups whose counts (n) sum to more than the ceiling: each times the factor, floored; zeros go unless protected."""
    total = counts.groupBy(*by).agg((F.sum("n") > ceiling).alias("__over"))
    out = counts.join(total, by).withColumn("n", F.when(F.col("__over"), F.floor(F.col("n") * factor)).otherwise(F.col("n")).cast("long"))
    return out.where((F.col("n") > 0) | protected | ~F.col("__over")).drop("__over")


def capped(rows: DataFrame, by: list[str], most: int, order: list[Column]) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= most).drop("__r")


def evicted(rows: DataFrame, by: list[str], most: int, protected: Column) -> DataFrame:
    """At most `most` words of a group: those of least count that nothing protects go first (word, n)."""
    size = rows.groupBy(*by).agg(F.count("*").alias("__n"))
    order = Window.partitionBy(*by, protected).orderBy("n", F.desc("word"))
    out = rows.join(size, by).withColumn("__r", F.row_number().over(order))
    return out.where(protected | (F.col("__r") > F.col("__n") - most)).drop("__r", "__n")


def merged(replicas: DataFrame, by: list[str], tombstones: DataFrame | None = None) -> DataFrame:
    """Any number of replicas (word, n, explicit, days array, touch: n, x, y, xx, yy, xy) in one: field by field the most, the first eight of all days, any flag.

    The touch statistics of the larger count stay whole, of equal ones those of the least values in that order. Words that
    any replica has deleted (tombstones: by and word) go. Order and grouping don't matter.
    """
    rows = replicas if tombstones is None else without(replicas, tombstones, ["word"], by)
    touch = F.min(F.struct((-F.col("touch.n")).alias("n"), *(F.col(f"touch.{c}").alias(c) for c in ("x", "y", "xx", "yy", "xy"))))
    days = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("days")))), 1, 8)
    out = rows.groupBy(*by, "word").agg(F.max("n").alias("n"), F.bool_or("explicit").alias("explicit"), days.alias("days"), touch.alias("t"))
    return out.select(*by, "word", "n", "explicit", "days", F.struct((-F.col("t.n")).alias("n"), *(F.col(f"t.{c}").alias(c) for c in ("x", "y", "xx", "yy", "xy"))).alias("touch"))


def merged_pairs(replicas: DataFrame, by: list[str], tombstones: DataFrame, most: int = 20_000) -> DataFrame:
    """Pairs of words (w1, w2, n) of all replicas: the larger count, none that touches a deleted word, the `most` most frequent of each group."""
    rows = without(replicas, tombstones, ["w1", "w2"], by).groupBy(*by, "w1", "w2").agg(F.max("n").alias("n"))
    return capped(rows, by, most, [F.desc("n"), F.concat_ws(" ", "w1", "w2").asc()])


def merge_two(a: DataFrame, b: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """Two payloads by full join: the larger value."""
    return a.join(b.withColumnRenamed(value, "__b"), keys, "full").select(*keys, F.greatest(F.col(value), F.col("__b")).alias(value))


def touch_stats(taps: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """n, means, sums of squares and of products about the means: what Welford's recurrence gives without decay."""
    n = F.count("*")
    return taps.groupBy(*by).agg(n.alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), (F.coalesce(F.var_pop(x), F.lit(0.0)) * n).alias("m2_x"), (F.coalesce(F.var_pop(y), F.lit(0.0)) * n).alias("m2_y"), (F.coalesce(F.covar_pop(x, y), F.lit(0.0)) * n).alias("c_xy"))


def folded(rows: Column, x: str, y: str) -> Column:
    """The mean of x, the variances of x and y and their covariance (x, xx, yy, xy) of an array of structs, by Welford's recurrence in its order.

    Sums of doubles depend on their order: aggregates over partitions give other last bits from run to run, which a rounding
    at a tie makes visible. Rows where x or y is null count for neither covariance nor that column's own figures.
    """
    zero, double = F.lit(0.0), lambda row, c: row[c].cast("double")

    def spread(c: str) -> Column:
        def step(a: Column, row: Column) -> Column:
            n, v = a["n"] + 1, double(row, c)
            mean = a["mean"] + (v - a["mean"]) / n
            return F.struct(n.alias("n"), mean.alias("mean"), (a["m"] + (v - mean) * (v - a["mean"])).alias("m"))

        start = F.struct(zero.alias("n"), zero.alias("mean"), zero.alias("m"))
        return F.aggregate(F.filter(rows, lambda row: row[c].isNotNull()), start, step, lambda a: F.when(a["n"] > 0, a["m"] / a["n"]))

    def both(a: Column, row: Column) -> Column:
        n, u, v = a["n"] + 1, double(row, x), double(row, y)
        mx, my = a["mx"] + (u - a["mx"]) / n, a["my"] + (v - a["my"]) / n
        return F.struct(n.alias("n"), mx.alias("mx"), my.alias("my"), (a["m"] + (v - a["my"]) * (u - mx)).alias("m"))

    here = F.filter(rows, lambda row: row[x].isNotNull())
    mean = F.aggregate(here, zero, lambda a, row: a + double(row, x)) / F.nullif(F.size(here), F.lit(0))
    start = F.struct(zero.alias("n"), zero.alias("mx"), zero.alias("my"), zero.alias("m"))
    xy = F.aggregate(F.filter(here, lambda row: row[y].isNotNull()), start, both, lambda a: F.when(a["n"] > 0, a["m"] / a["n"]))
    return F.struct(mean.alias("x"), spread(x).alias("xx"), spread(y).alias("yy"), xy.alias("xy"))


def frecency(touches: DataFrame, by: list[str], time: str, now: Column, half_life_days: float = 30.0) -> DataFrame:
    """The sum of 2^(-age / half-life): what decaying at every touch comes to."""
    age = (F.unix_micros(now) - F.unix_micros(time)) / 1e6 / 86400.0
    return touches.groupBy(*by).agg(F.sum(F.pow(F.lit(2.0), -age / half_life_days)).alias("score"), F.max(time).alias("last_touch"))


def recents(scores: DataFrame, seeds: DataFrame, by: list[str], item: str, k: int) -> DataFrame:
    """The k best items of each group, filled up with seeds (item, place) it doesn't have."""
    groups = scores.select(*by).distinct()
    have = scores.select(*by, item, F.lit(0).alias("o"), (-F.col("score")).alias("p"))
    more = groups.crossJoin(F.broadcast(seeds)).join(scores.select(*by, item), [*by, item], "left_anti").select(*by, item, F.lit(1).alias("o"), F.col("place").cast("double").alias("p"))
    rows = have.unionByName(more)
    return rows.withColumn("slot", F.row_number().over(Window.partitionBy(*by).orderBy("o", "p", item))).where(F.col("slot") <= k).select(*by, item, "slot")


def delete_word(words: DataFrame, bigrams: DataFrame, tombstones: DataFrame, gone: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The model without some words, their bigrams gone and the words remembered as deleted."""
    return without(words, gone, ["word"], by), without(bigrams, gone, ["w1", "w2"], by), tombstones.select(*by, "word").unionByName(gone.select(*by, "word")).distinct()


def imported(words: DataFrame, new: DataFrame, tombstones: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Imported words are explicit and count `least` at least; deleted ones stay away."""
    rows = without(new.select(*by, "word").distinct(), tombstones, ["word"], by).withColumn("__new", F.lit(True))
    out = words.join(rows, [*by, "word"], "full")
    return out.select(*by, "word", F.when(F.col("__new"), F.greatest(F.coalesce("n", F.lit(0)), F.lit(least))).otherwise(F.col("n")).cast("long").alias("n"), (F.coalesce("explicit", F.lit(False)) | F.coalesce("__new", F.lit(False))).alias("explicit"))


def personal_index(rows: DataFrame) -> DataFrame:
    """By lower-case word: summed count, the surface of the largest, whether any was explicit."""
    return rows.groupBy(F.lower("word").alias("key")).agg(F.sum("n").alias("n"), F.max(F.struct("n", F.col("word").alias("w")))["w"].alias("surface"), F.bool_or("explicit").alias("explicit"))
