"""Chat formatting by quotation linking, in DataFrame functions only.

Quoted passages (lines behind `>`, nested by their number) are hashed in normal form and joined to the message that said
them first; answers then follow what they quote, without the quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordmill.llm.cluster import stash

#: Words from which a passage is evidence of what it quotes.
LEAST = 3
#: Turns that one window holds.
SPAN = 1024
MARK = r"^[ \t]*((?:>[ \t]?)+)"


def normal(text: Column) -> Column:
    """Lower case, runs of anything but letters, marks and numbers as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "))


def passage_key(text: Column) -> Column:
    """128 bits of a normal form."""
    return F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.reverse(text), F.length(text)).alias("y"))


def parse(messages: DataFrame) -> DataFrame:
    """Adds own (the text without quotes), blocks (runs of lines of one quote level: depth, said) and n_quotes."""
    lines = F.split(F.coalesce("text", F.lit("")), "\r?\n", -1)
    with_lines = messages.withColumn("__lines", F.transform(lines, lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARK, 1), "[^>]", "")).alias("depth"), F.regexp_replace(x, MARK, "").alias("said"))))
    depth = lambda i: F.get("__lines", i)["depth"]
    starts = F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), lambda i: (i == 0) | (depth(i) != depth(i - 1)))
    with_starts = with_lines.withColumn("__starts", starts)
    ends = F.concat(F.slice("__starts", F.lit(2), F.size("__starts")), F.array(F.size("__lines")))
    block = lambda a, b: F.struct(depth(a).alias("depth"), F.array_join(F.transform(F.slice("__lines", a + 1, b - a), lambda x: x["said"]), "\n").alias("said"))
    out = with_starts.withColumn("blocks", F.zip_with("__starts", ends, block))
    own = F.array_join(F.transform(F.filter("blocks", lambda b: b["depth"] == 0), lambda b: b["said"]), "\n")
    return out.withColumn("own", F.regexp_replace(own, r"^\s+|\s+$", "")).withColumn("n_quotes", F.size(F.filter("blocks", lambda b: b["depth"] > 0))).drop("__lines", "__starts")


def link(parsed: DataFrame, least: int = LEAST) -> DataFrame:
    """conv_id, turn, row, reply_conv, reply_turn, n_found: for messages with quotes the message that they answer (parsed by parse()).

    A passage of any depth is matched whole, by its paragraphs and by its lines; what a message says itself gives the other
    side, by the same parts. Among messages that say a part, the first of the same conversation before the answer counts,
    else the first of all before it. Of the quotes of least depth that are found the message said last is the one answered.
    """
    part = lambda text: F.filter(F.array_distinct(F.transform(F.concat(F.array(text), F.split(text, "\n\\s*\n"), F.split(text, "\n")), normal)), lambda x: F.size(F.split(x, " ")) >= least)
    quoted = parsed.where("n_quotes > 0").select("conv_id", "turn", "row", F.explode(F.filter("blocks", lambda b: b["depth"] > 0)).alias("b"))
    quoted = quoted.select("conv_id", "turn", "row", "b.depth", F.explode(part(F.col("b.said"))).alias("p"))
    asked = stash(quoted.groupBy("conv_id", "turn", "row", passage_key(F.col("p")).alias("key")).agg(F.min("depth").alias("depth")))
    said = parsed.select("conv_id", "turn", F.explode(part(F.col("own"))).alias("p")).select("conv_id", "turn", passage_key(F.col("p")).alias("key"))
    said = stash(said.join(asked.select("key").distinct(), "key", "left_semi"))
    near = stash(said.groupBy("key", "conv_id").agg(F.min("turn").alias("near")))
    far = stash(said.where(F.col("conv_id").isNotNull()).groupBy("key").agg(F.min(F.struct("conv_id", "turn")).alias("far")))
    before = F.when(F.col("near") < F.col("turn"), F.struct("conv_id", F.col("near").alias("turn")))
    earlier = F.when((F.col("far.conv_id") < F.col("conv_id")) | (F.col("far.conv_id") == F.col("conv_id")) & (F.col("far.turn") < F.col("turn")), F.col("far"))
    met = asked.join(near, ["key", "conv_id"], "left").join(far, "key", "left").withColumn("of", F.coalesce(before, earlier)).where("of IS NOT NULL")
    best = F.max(F.struct((-F.col("depth")).alias("d"), "of"))["of"]
    return met.groupBy("conv_id", "turn", "row").agg(best.alias("of"), F.count("*").alias("n_found")).select("conv_id", "turn", "row", F.col("of.conv_id").alias("reply_conv"), F.col("of.turn").alias("reply_turn"), "n_found")


def roots(links: DataFrame) -> DataFrame:
    """conv_id and root of every conversation that answers an earlier one: pointers doubled until nothing moves.

    A conversation hangs on the earliest that it answers; pointers go to smaller ids only, so they meet no circle.
    """
    now = stash(links.where("reply_conv < conv_id").groupBy("conv_id").agg(F.min("reply_conv").alias("root")))
    while True:
        up = now.select(F.col("conv_id").alias("root"), F.col("root").alias("above"))
        moved = stash(now.join(up, "root", "left").select("conv_id", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        still = moved.where("moved").isEmpty()
        now = moved.drop("moved")
        if still:
            return now


def conversations(messages: DataFrame) -> DataFrame:
    """Every message once, without its quotes, with what it answers and its place in a thread.

    Columns: conv_id, turn, role, text (null stays null), n_quotes, reply_conv and reply_turn (of the quoted message; else
    the turn before in the conversation; null for a first one), n_found (parts of quotes that were found), thread (the
    conversation that the thread began with), position (place in the thread, from 0: by conv_id, turn and what is said, so
    that an answer never comes before what it quotes). Repeated rows stay, and are linked alike; null conv_ids are threads
    without a name, null turns are linked to nothing, and neither has a position; a message of quotes only has an empty
    text. An empty table gives none. Only the four columns are read, so no other can clash.
    """
    rows = messages.select("conv_id", "turn", "role", "text").withColumn("row", F.xxhash64("text"))
    own = F.when(F.col("text").isNotNull(), F.when(F.col("n_quotes") > 0, F.col("own")).otherwise(F.col("text")))
    parsed = stash(parse(rows).select("conv_id", "turn", "role", "row", "own", "blocks", "n_quotes", own.alias("kept")))
    found = stash(link(parsed))
    thread = stash(roots(found))
    # the turn before, in two steps, so that no window holds a whole conversation: within SPAN turns, then between such spans
    turns = stash(rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").groupBy("conv_id", "turn").agg(F.count("*").alias("n")).withColumn("span", F.floor(F.col("turn") / SPAN)))
    turns = turns.join(thread, "conv_id", "left").withColumn("thread", F.coalesce("root", "conv_id")).drop("root")
    spans = turns.groupBy("thread", "conv_id", "span").agg(F.max("turn").alias("last"), F.sum("n").alias("n"))
    order = Window.partitionBy("thread").orderBy("conv_id", "span")
    spans = spans.select("thread", "conv_id", "span", F.lag("last").over(Window.partitionBy("conv_id").orderBy("span")).alias("last"), (F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    inside = Window.partitionBy("thread", "conv_id", "span").orderBy("turn")
    inner = turns.withColumn("near", F.lag("turn").over(inside)).withColumn("first", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    before = inner.join(spans, ["thread", "conv_id", "span"]).select("conv_id", "turn", "thread", F.coalesce("near", "last").alias("before"), (F.col("start") + F.col("first")).alias("at"))
    linked = found.select("conv_id", "turn", "row", "reply_conv", "reply_turn", "n_found")
    out = parsed.select("conv_id", "turn", "role", F.col("kept").alias("text"), "n_quotes", "row").join(linked, ["conv_id", "turn", "row"], "left").join(before, ["conv_id", "turn"], "left")
    same = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("row", "role")) - 1
    return out.select(
        "conv_id", "turn", "role", "text", "n_quotes", F.when(F.col("reply_turn").isNotNull(), F.col("reply_conv")).when(F.col("before").isNotNull(), F.col("conv_id")).alias("reply_conv"),
        F.coalesce("reply_turn", "before").alias("reply_turn"), F.coalesce("n_found", F.lit(0)).alias("n_found"), F.coalesce("thread", "conv_id").alias("thread"), (F.col("at") + same).alias("position"),
    )


def op10_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of all conversations in reply order, without quotes; see conversations() for nulls and repeats."""
    return conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
