"""Evaluation: tallies, gates against baselines, percentiles, sweeps, search ranks, samples and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tally(rows: DataFrame, dims: list[str], measures: dict[str, Column]) -> DataFrame:
    """n and counts of conditions by each dimension and over all, in one pass: dim, name, n, measures."""
    out = rows.groupingSets([[], *[[d] for d in dims]], *dims).agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in measures.items()), *(F.grouping(d).alias(f"__{d}") for d in dims))
    dim, name = F.lit("all"), F.lit("all")
    for d in reversed(dims):
        dim, name = F.when(F.col(f"__{d}") == 0, d).otherwise(dim), F.when(F.col(f"__{d}") == 0, F.col(d).cast("string")).otherwise(name)
    return out.select(dim.alias("dim"), name.alias("name"), "n", *measures)


def stage(typo: Column, meant: Column, top: Column, fired: Column, found: Column, repair: Column) -> Column:
    """Where a row of a corpus succeeded or failed."""
    return (
        F.when(~repair, F.when(fired & (top != typo), "error").otherwise("success"))
        .when(fired & (top != meant), "error").when(top == meant, F.when(fired, "success").otherwise("abstention"))
        .when(found, "ranking").otherwise("discovery")
    )


def gate(now: DataFrame, base: DataFrame, keys: list[str], at_least: list[str], at_most: list[str], equal: list[str]) -> DataFrame:
    """One row for each cohort of either side: whether it passes, and why not; a cohort that is missing fails."""
    old = base.select(*keys, *(F.col(c).alias(f"base_{c}") for c in [*at_least, *at_most, *equal]), F.lit(True).alias("__base"))
    both = now.withColumn("__now", F.lit(True)).join(old, keys, "full")
    faults = [F.when(F.col("__now").isNull(), "missing"), F.when(F.col("__base").isNull(), "new")]
    faults += [F.when(F.col(c) < F.col(f"base_{c}"), f"{c} fell") for c in at_least] + [F.when(F.col(c) > F.col(f"base_{c}"), f"{c} rose") for c in at_most] + [F.when(F.col(c) != F.col(f"base_{c}"), f"{c} differs") for c in equal]
    why = F.concat_ws(",", *faults)
    return both.select(*keys, (why == "").alias("passed"), why.alias("why"))


def percentiles(rows: DataFrame, by: list[str], value: str, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact, between neighbours in proportion, with n and the largest."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), *(F.round(F.percentile(value, p), 6).alias(f"p{round(100 * p)}") for p in at), F.max(value).alias("most"))


def latency_gate(report: DataFrame, limits: dict[str, float], least: int = 20) -> DataFrame:
    """status of each row: insufficient-data, fail or pass, with what is over its limit."""
    over = F.concat_ws(",", *(F.when(F.col(c) > x, c) for c, x in limits.items()))
    return report.withColumn("over", over).withColumn("status", F.when(F.col("n") < least, "insufficient-data").when(F.col("over") != "", "fail").otherwise("pass"))


def is_uniform(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Whether a cohort is of one kind: distinct values by field."""
    return rows.agg(*(F.count_distinct(f).alias(f) for f in fields))


def sweep(rows: DataFrame, weights: list[float], score: Column, evidence: Column, group: str, item: str, right: str) -> DataFrame:
    """For every weight: groups in which the right item comes first by score + weight * evidence, and how many won or lost against none."""
    spark = rows.sparkSession
    grid = F.broadcast(spark.createDataFrame([(float(w),) for w in [0.0, *weights]], "weight double"))
    order = Window.partitionBy("weight", group).orderBy(F.desc("__s"), item)
    first = rows.crossJoin(grid).withColumn("__s", F.round(score + F.col("weight") * evidence, 9)).withColumn("__r", F.row_number().over(order)).where("__r = 1")
    hit = first.select("weight", group, (F.col(item) == F.col(right)).alias("hit"))
    base = hit.where("weight = 0").select(group, F.col("hit").alias("base")).dropDuplicates([group])
    return hit.where("weight != 0").join(base, group).groupBy("weight").agg(F.count_if("hit").alias("right"), F.count_if(F.col("hit") & ~F.col("base")).alias("won"), F.count_if(~F.col("hit") & F.col("base")).alias("lost"))


def deltas(a: DataFrame, b: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    return a.join(b.select(*keys, *(F.col(m).alias(f"__{m}") for m in measures)), keys).select(*keys, *((F.col(f"__{m}") - F.col(m)).alias(f"d_{m}") for m in measures))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, and of which."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def search_rank(query: Column, name: Column, name_tokens: Column, keyword_tokens: Column) -> Column:
    """0 exact name, 1 exact keyword, 2 exact word of the name, 3 begins a word of the name, 4 begins a keyword; null: no hit."""
    begins = lambda tokens: F.exists(tokens, lambda t: t.startswith(query))
    return F.when(name == query, 0).when(F.array_contains(keyword_tokens, query), 1).when(F.array_contains(name_tokens, query), 2).when(begins(name_tokens), 3).when(begins(keyword_tokens), 4)


def stratified(rows: DataFrame, by: str, most: int, *key: Column) -> DataFrame:
    """At most `most` rows of each stratum, in the order of an MD5 of what identifies them."""
    mark = F.md5(F.concat_ws("|", *key))
    return rows.withColumn("mark", mark).withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("mark"))).where(F.col("place") <= most)


def halves(key: Column) -> Column:
    """dev or heldout, by a hash: the same for a key in any partitioning."""
    return F.when(F.pmod(F.crc32(key), F.lit(2)) == 0, "dev").otherwise("heldout")


def quotas(sizes: DataFrame, name: str, size: str, target: int) -> DataFrame:
    """Whole quotas in proportion to sizes that sum to the target: floors, and one more for the largest remainders. For few rows."""
    total = sizes.agg(F.sum(size).alias("__all"))
    exact = sizes.crossJoin(F.broadcast(total)).withColumn("__x", F.col(size) * target)
    part = exact.withColumn("__f", F.floor(F.col("__x") / F.col("__all"))).withColumn("__rest", F.col("__x") - F.col("__f") * F.col("__all"))
    place = F.row_number().over(Window.orderBy(F.desc("__rest"), name))
    return part.withColumn("__p", place).withColumn("__given", F.sum("__f").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).select(name, (F.col("__f") + F.when(F.col("__p") <= target - F.col("__given"), 1).otherwise(0)).cast("long").alias("quota"))


def first_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, with how many more there were."""
    w = Window.partitionBy(*key)
    return rows.withColumn("__r", F.row_number().over(w.orderBy(*order))).withColumn("duplicates", F.count("*").over(w) - 1).where("__r = 1").drop("__r")


def upsert(old: DataFrame, new: DataFrame, key: list[Column]) -> DataFrame:
    """Old rows and those new ones whose key is new; of new ones of one key the least."""
    keyed = lambda d: d.withColumns({f"__k{i}": k for i, k in enumerate(key)})
    names = [f"__k{i}" for i in range(len(key))]
    fresh = keyed(new).join(keyed(old).select(*names), names, "left_anti").groupBy(*names).agg(F.min(F.struct(*old.columns)).alias("r")).select("r.*")
    return old.unionByName(fresh.select(*old.columns))
