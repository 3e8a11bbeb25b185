"""Near-duplicate texts: signatures banded in Spark, candidates verified on whole shingle bags or sets, classes by components.

No bucket is ever gathered. In large buckets each text is first held against the most central text that it meets (the one
that shares most buckets with others); then every pair of a bucket that is still in different classes is looked at, blocks
of texts against each other, so that the classes are those of all alike pairs that share a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.llm import signatures, vec
from wordmill.llm.cluster import flagged, possible, release, row_key, stash, unused

SHINGLE, LIKENESS = 5, 0.8
#: Standard errors below the likeness asked for from which two signatures exclude a pair: once in a thousand million pairs wrongly.
ERRORS = 6
#: Buckets of more nodes than SMALL are first held against central ones; those of more than BLOCK nodes are dealt into
#: blocks, of which every pair meets that may hold texts of different classes. Texts of one star go to SALT tasks.
SMALL, BLOCK, SALT = 16, 512, 16
Signer = Callable[[np.ndarray, np.ndarray, int], np.ndarray]
#: Likeness of pairs of data, below what is asked for (-1, say) where it is not worth computing.
Check = Callable[[list[bytes], list[bytes]], np.ndarray]
#: Made of the sketches of some nodes: which pairs (i, j) are to be verified in the bucket of a key. It says no to pairs that
#: can't be alike and, unless `anywhere`, to pairs that another of their buckets sees to.
Pairing = Callable[..., Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]]


def keys(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key of each text's words (two columns of uint64), equal for equal words in equal order, and which texts have words."""
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    ends = np.append(first[1:], len(doc))
    out, some = np.zeros((n, 2), np.uint64), np.zeros(n, bool)
    if len(first):
        rows = doc[first]
        some[rows] = True
        out[rows, 0] = vec.segment_hashes(hashes, first, ends)
        out[rows, 1] = vec.segment_hashes(vec.mix(hashes ^ np.uint64(0xC2B2AE3D27D4EB4F)), first, ends)
    return out, some


def binary(key: np.ndarray, some: np.ndarray) -> pa.Array:
    """Keys as 16 bytes each, null where there is none."""
    raw = np.ascontiguousarray(key).tobytes()
    return pa.array([raw[16 * k : 16 * k + 16] if s else None for k, s in enumerate(some.tolist())], pa.binary())


def nodes(docs: DataFrame, sign: Signer) -> DataFrame:
    """doc_id, row (row_key()), node (128 bits of the text's words; null without words) and the text's band keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, points, offsets in vec.steps(batch.column(1)):
                _, _, doc, hashes = vec.words(points, offsets)
                key, some = keys(hashes, doc, hi - lo)
                band = signatures.band_keys(sign(*vec.shingles(hashes, doc, SHINGLE), hi - lo))
                lists = vec.ragged(band.reshape(-1).view(np.int64), np.full(hi - lo, band.shape[1]), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(2)[lo:hi], binary(key, some), lists], ["doc_id", "row", "node", "keys"])

    return docs.select("doc_id", "text", row_key().alias("row")).mapInArrow(run, f"doc_id {kind}, row long, node binary, keys array<long>")


def bags(docs: DataFrame, signed: DataFrame, wanted: DataFrame, counted: bool) -> DataFrame:
    """node and data of wanted nodes (and few others): 32-bit marks of the text's shingles, sorted, repeats apart if they are counted.

    Only rows that hold a wanted node go to Python, one of each node if no two rows are equal.
    """
    one = stash(signed.join(wanted, "node").groupBy("node").agg(F.min("row").alias("row")).select("row"))
    some = possible(docs.select("text", row_key().alias("row")), "row", one, "row").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, points, offsets in vec.steps(batch.column(0)):
                _, _, doc, hashes = vec.words(points, offsets)
                key, some = keys(hashes, doc, hi - lo)
                h, own, count = signatures.weights(*vec.shingles(hashes, doc, SHINGLE))
                if counted and (count > 1).any():
                    own, nth = np.repeat(own, count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    h = vec.mix(np.repeat(h, count) + nth.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
                marks = (vec.mix(h) >> np.uint64(32)).astype(np.uint32)
                marks = marks[np.argsort(own.astype(np.uint64) << np.uint64(32) | marks)]
                size = np.bincount(own, minlength=hi - lo)[some]
                ends = np.cumsum(size).astype(np.int32) * 4
                data = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(marks.tobytes())])
                yield pa.RecordBatch.from_arrays([binary(key[some], np.ones(len(size), bool)), data], ["node", "data"])

    out = stash(some.mapInArrow(run, "node binary, data binary").groupBy("node").agg(F.first("data").alias("data")))
    release(one)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted arrays of marks, each mark once in either."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return same / max(1, len(both) - same)


def bag_likeness(least: float) -> Check:
    """likeness() of pairs of bags; -1 where their sizes alone put it below `least`."""

    def check(xs: list[bytes], ys: list[bytes]) -> np.ndarray:
        x, y = np.array([len(t) for t in xs], float), np.array([len(t) for t in ys], float)
        out = np.full(len(xs), -1.0)
        for i in np.flatnonzero(np.minimum(x, y) >= least * np.maximum(x, y)).tolist():
            out[i] = likeness(np.frombuffer(xs[i], np.uint32), np.frombuffer(ys[i], np.uint32))
        return out

    return check


def by_signature(least: float, errors: float = ERRORS) -> Pairing:
    """Pairs in the bucket of their first common band whose signatures don't put their likeness `errors` standard errors below `least`."""

    def prepare(lists: pa.Array, anywhere: bool = False) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        band = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(lists), -1)
        place = signatures.places(band)
        need = place.shape[1] * least - errors * np.sqrt(place.shape[1] * least * (1 - least))

        def good(i: np.ndarray, j: np.ndarray, key: np.ndarray) -> np.ndarray:
            out = np.zeros(len(i), bool)
            for lo in range(0, len(i), 8192):
                a, b = i[lo : lo + 8192], j[lo : lo + 8192]
                same = band[a] == band[b]
                first = same.argmax(axis=1)
                met = same[np.arange(len(a)), first] & (anywhere | (band[a, first].view(np.int64) == key[lo : lo + 8192]))
                met[met] = (place[a[met]] == place[b[met]]).sum(axis=1) >= need
                out[lo : lo + 8192] = met
            return out

        return good

    return prepare


def runs(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = 0) -> Iterator[pa.Table]:
    """Runs of whole groups (equal values of the first column) of `rows` rows, up to 8 times as many while they take less than `size` bytes, or, where a group ends later, more."""
    parts: list[pa.RecordBatch] = []
    for batch in batches:
        parts.append(batch)
        count = sum(p.num_rows for p in parts)
        if count >= rows and (count >= 8 * rows or sum(p.nbytes for p in parts) >= size):
            table = pa.Table.from_batches(parts)
            group = table.column(0).to_numpy()
            if len(before := np.flatnonzero(group != group[-1])):
                yield table.slice(0, int(before[-1]) + 1)
                parts = table.slice(int(before[-1]) + 1).combine_chunks().to_batches()
    if parts and sum(p.num_rows for p in parts):
        yield pa.Table.from_batches(parts)


def _meetings(table: pa.Table, comp: np.ndarray, pairing: Pairing) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of one group whose comps differ when it is their turn, that pairing() takes."""
    group, key, side = (table[c].to_numpy() for c in ("group", "key", "side"))
    good = pairing(table["sketch"].combine_chunks())
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(first, len(group)))
    left = np.repeat(size, size) - (np.arange(len(group)) - np.repeat(first, size))
    for shift in range(1, int(size.max())):
        i = np.flatnonzero(left > shift)
        j = i + shift
        some = (comp[i] != comp[j]) & ((side[i] < 0) | (side[i] != side[j]))
        i, j = i[some], j[some]
        some = good(i, j, key[i]) if len(i) else np.zeros(0, bool)
        if some.any():
            yield i[some], j[some]


def _numbers(table: pa.Table) -> np.ndarray:
    return table["comp"].combine_chunks().dictionary_encode().indices.to_numpy().copy()


def _suspects(groups: Iterator[pa.Table], pairing: Pairing) -> Iterator[pa.RecordBatch]:
    """The rows of nodes that have something to verify in their group."""
    for table in groups:
        seen = np.zeros(table.num_rows, bool)
        for i, j in _meetings(table, _numbers(table), pairing):
            seen[i] = seen[j] = True
        yield from table.filter(pa.array(seen)).to_batches()


def _across(groups: Iterator[pa.Table], pairing: Pairing, check: Check, least: float, many: int = 1) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between the comps of verified pairs. What is linked on the way is one comp for the rest of the group."""
    for table in groups:
        data, comp, name = table["data"].to_pylist(), _numbers(table), table["comp"].combine_chunks()
        for i, j in _gathered(_meetings(table, comp, pairing), many):
            some = comp[i] != comp[j]
            i, j = i[some], j[some]
            some = np.flatnonzero(check([data[k] for k in i.tolist()], [data[k] for k in j.tolist()]) >= least)
            if len(some):
                yield pa.RecordBatch.from_arrays([name.take(pa.array(i[some])), name.take(pa.array(j[some]))], ["a", "b"])
                _join(comp, comp[i[some]], comp[j[some]])
        vec.trim()


def _join(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Renumbers comps in place, so that the comps a[k] and b[k] are one, for every k."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top[up]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        top[root(y)] = root(x)
    number = np.arange(int(comp.max()) + 1)
    number[list(top)] = [root(x) for x in list(top)]
    comp[:] = number[comp]


def _gathered(meetings: Iterator[tuple[np.ndarray, np.ndarray]], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, few at once put together: at most as many more as there were before them, or `least`."""
    wait, held, done = [], 0, 0
    for pair in meetings:
        wait.append(pair)
        held += len(pair[0])
        if held >= min(done, least) or held >= least:
            yield np.concatenate([i for i, _ in wait]), np.concatenate([j for _, j in wait])
            wait, held, done = [], 0, done + held
    if wait:
        yield np.concatenate([i for i, _ in wait]), np.concatenate([j for _, j in wait])


def _stars(member: DataFrame, sizes: DataFrame, sketch: DataFrame, data_of: Callable[[DataFrame], DataFrame], pairing: Pairing, check: Check, least: float, small: int) -> DataFrame | None:
    """Components (node, comp) of verified links between the nodes of large buckets and the most central node that each meets."""
    large = stash(sizes.where(F.col("size") > small))
    if large.isEmpty():
        release(large)
        return None
    big = stash(possible(member, "key", large, "key").join(large, "key").select("key", "node", "size"))
    rank = stash(big.groupBy("node").agg(F.sum("size").alias("rank")))
    lead = stash(big.join(rank, "node").groupBy("key").agg(F.max(F.struct("rank", "node")).alias("lead")))
    best = big.join(lead, "key").groupBy("node").agg(F.max(F.struct("lead", "key")).alias("best"))
    pairs = best.select("node", F.col("best.lead.node").alias("lead"), F.col("best.key").alias("key"), F.pmod(F.xxhash64("node"), F.lit(SALT)).alias("salt"))
    pairs = stash(pairs.where("node != lead"))
    release(large, big, rank, lead)

    def beside(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        """The pairs with a column of the table of nodes for either: x of the node, y of the central one."""
        central = pairs.select("lead", "salt").distinct().join(table.select(F.col("node").alias("lead"), F.col(column).alias("y")), "lead")
        return pairs.join(table.select("node", F.col(column).alias("x")), "node").join(central, ["lead", "salt"])

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            good = pairing(pa.concat_arrays([batch["x"], batch["y"]]), True)(np.arange(n), n + np.arange(n), batch["key"].to_numpy())
            yield batch.select(["node", "lead", "key", "salt"]).filter(pa.array(good))

    ends = stash(pairs.select("node").unionByName(pairs.select(F.col("lead").alias("node"))).distinct())
    few = possible(sketch.withColumn("mark", F.xxhash64("node")), "mark", ends.select(F.xxhash64("node").alias("mark")), "mark")
    every, pairs = pairs, stash(beside(pairs, few, "sketch").select("node", "lead", "key", "salt", "x", "y").mapInArrow(may, pairs.schema))
    wanted = stash(pairs.select("node").unionByName(pairs.select(F.col("lead").alias("node"))).distinct())
    data = data_of(wanted)
    release(every, ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = check(batch["x"].to_pylist(), batch["y"].to_pylist()) >= least
            yield pa.RecordBatch.from_arrays([batch["node"], batch["lead"]], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    links = stash(beside(pairs, data, "data").select("node", "lead", "x", "y").mapInArrow(run, _ends(member)))
    release(pairs, wanted, data)
    return components(links)


def _ends(member: DataFrame) -> str:
    """The schema of links between nodes."""
    kind = member.schema["node"].dataType.simpleString()
    return f"a {kind}, b {kind}"


def _dealt(at: DataFrame) -> tuple[DataFrame, DataFrame]:
    """group, key, node, comp, side, and the stashed rows that they are read with, of the rows (key, node, comp, size) of buckets: rows of a group meet, but for those of one side of 0 or more.

    A bucket of up to BLOCK nodes is one group. In a larger one the nodes of its largest comp don't meet each other, so they
    are dealt into blocks that each meet the blocks of the other nodes; those meet among themselves, too.
    """
    small = at.where(F.col("size") <= BLOCK).select(F.xxhash64("key").alias("group"), "key", "node", "comp", F.lit(-1).alias("side"))
    large = at.where(F.col("size") > BLOCK)
    each = large.groupBy("key", "comp").agg(F.count("*").alias("n"))
    main = stash(each.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("all")))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    rows = large.join(main.select("key", F.col("m.comp").alias("main"), blocks(F.col("m.n")).alias("bm"), blocks(F.col("all") - F.col("m.n")).alias("bo")), "key")
    rows = rows.withColumn("inner", F.col("comp") == F.col("main")).withColumn("own", F.pmod(F.xxhash64("node", F.lit(-1)), F.when(F.col("inner"), F.col("bm")).otherwise(F.col("bo"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda kind, a, b, side: F.struct(F.xxhash64("key", F.lit(kind), a, b).alias("group"), side.cast("int").alias("side"))
    own = F.col("own")
    with_others = F.transform(upto("bo"), lambda o: cell(1, own, o, F.lit(0)))
    with_main = F.transform(upto("bm"), lambda m: cell(1, m, own, F.lit(1)))
    each_other = F.transform(upto("bo"), lambda o: cell(2, F.least(own, o), F.greatest(own, o), F.when(o == own, -1).otherwise(own)))
    rows = rows.withColumn("cell", F.explode(F.when(F.col("inner"), with_others).otherwise(F.concat(with_main, each_other))))
    return small.unionByName(rows.select(F.col("cell.group").alias("group"), "key", "node", "comp", F.col("cell.side").alias("side"))), main


def linked(signed: DataFrame, data_of: Callable[[DataFrame], DataFrame], pairing: Pairing, check: Check, least: float, small: int = SMALL, read: Callable[[], None] = lambda: None) -> DataFrame | None:
    """Components (node, comp), or None, that the verified pairs of nodes sharing a key connect.

    signed has node, keys and sketch; a node may have several rows, all equal. First the nodes of buckets of more than
    `small` are held against central ones; most alike ones are one component then. After that every pair of a bucket whose nodes are still
    in different components is looked at, without exception: pairing() takes or excludes it by the sketches, and
    data_of() is asked for (node, data) of the nodes of pairs that are left, which check() verifies. read() is
    called as soon as signed isn't needed any more.
    """
    each = signed.select("node", F.explode("keys").alias("key"))
    tagged = each.select("key", F.hash("node").alias("tag"))
    shared = stash(tagged.groupBy("key").agg(F.min("tag").alias("p"), F.max("tag").alias("q")).where("p != q").select("key"))
    member = stash(possible(each, "key", shared, "key").select("key", "node").distinct())
    sizes = stash(member.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    names = stash(member.select("node", F.xxhash64("node").alias("mark")).distinct())
    sketch = possible(signed.select("node", "sketch", F.xxhash64("node").alias("mark")), "mark", names, "mark").groupBy("node").agg(F.first("sketch").alias("sketch"))
    sketch = stash(sketch)
    release(shared, names)
    read()
    return connected(member, sizes, sketch, data_of, pairing, check, least, small)


def connected(member: DataFrame, sizes: DataFrame, sketch: DataFrame, data_of: Callable[[DataFrame], DataFrame], pairing: Pairing, check: Check, least: float, small: int = SMALL, size: int = 0, many: int = 1) -> DataFrame | None:
    """linked(), of stored rows (key, node), each once, of keys that several nodes share, their sizes (key, size) and sketches (node, sketch). All are released.

    Rows that have their key's size, too, are all looked at; of others first those of keys whose nodes are in different
    components. A task takes more groups at once up to `size` bytes, and verifies up to `many` pairs at once.
    """
    spent, member = member, member.select("key", "node")
    first = _stars(member, sizes, sketch, data_of, pairing, check, least, small)
    if "size" in spent.columns:
        met = spent.withColumn("comp", F.col("node")) if first is None else stash(spent.join(first, "node", "left").withColumn("comp", F.coalesce("comp", "node")).select("key", "node", "comp", "size"))
    else:
        met = _apart(member.join(first, "node", "left").withColumn("comp", F.coalesce("comp", "node")) if first else member.withColumn("comp", F.col("node")), sizes)
    if first is not None or "size" not in spent.columns:
        release(spent, sizes)
    rows, main = _dealt(met)
    dealt = int(member.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = lambda d: d.repartition(dealt, "group").sortWithinPartitions("group", "node")
    rows = rows.join(sketch, "node").select("group", "key", "node", "comp", "side", "sketch")
    rows = stash(together(rows).mapInArrow(lambda batches: _suspects(runs(batches, size=size // 4), pairing), rows.schema))
    wanted = stash(rows.select("node").distinct())
    release(met, main, sketch)
    if first is None and "size" in spent.columns:
        release(spent)
    data = data_of(wanted)
    met = together(rows.join(data, "node").select("group", "key", "node", "comp", "side", "sketch", "data"))
    links = stash(met.mapInArrow(lambda batches: _across(runs(batches, size=size), pairing, check, least, many), _ends(member)))
    release(rows, wanted, data)
    second = components(links)
    if first is None or second is None:
        return second if first is None else first
    every = stash(first.unionByName(second.select("node", F.col("node").alias("comp")).join(first, "node", "left_anti")))
    above = second.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    out = stash(every.join(above, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")))
    release(first, second, every)
    return out


def _apart(at: DataFrame, sizes: DataFrame) -> DataFrame:
    """key, node, comp, size of the rows of keys whose nodes are in different components, stashed."""
    apart = at.groupBy("key").agg(F.min(F.hash("comp")).alias("p"), F.max(F.hash("comp")).alias("q")).where("p != q").select("key")
    apart = stash(sizes.join(apart, "key").select("key", "size"))
    met = stash(possible(at, "key", apart, "key").join(apart, "key").select("key", "node", "comp", "size"))
    release(apart)
    return met


def components(edges: DataFrame) -> DataFrame | None:
    """node and comp, the least node of its component, for all nodes of edges (a, b), stashed; None of no edges. The edges are released.

    Large star and small star in turn (Kiveris and others, 2014) until all trees are stars: O(log n) rounds of group-bys
    with partial aggregation and joins; no neighbourhood is gathered. What is joined was stored, so that adaptive
    execution can split the rows of a hub.
    """
    if edges.isEmpty():
        release(edges)
        return None
    now, spent = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v"), edges
    while True:
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        first = stash(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        down = stash(both.where("v > u").join(first, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        release(first, spent)
        least = stash(down.groupBy("u").agg(F.min("v").alias("m")))
        now = stash(down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        release(down, least)
        spent = now
        # a forest of stars: no node is both a root and below one, and every node has one root
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("n")), F.struct(F.col("v").alias("node"), F.lit(1 << 20).alias("n")))).alias("e"))
        places = ends.groupBy("e.node").agg(F.sum(F.when(F.col("e.n") == 1, 1).otherwise(0)).alias("below"), F.max("e.n").alias("most"))
        if places.where("below > 1 OR below = 1 AND most > 1").isEmpty():
            break
    out = stash(now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()))
    release(now)
    return out


def found_classes(docs: DataFrame, sign: Signer, counted: bool, least: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, row, node of all rows; and node, comp of those nodes that several rows have or that links connect. Both are stashed."""
    signed = stash(nodes(docs, sign))
    own = signed.where(F.col("node").isNotNull())
    rows = stash(signed.drop("keys"))
    comps = linked(own.select("node", "keys", F.col("keys").alias("sketch")), lambda wanted: bags(docs, rows, wanted, counted), by_signature(least), bag_likeness(least), least, read=lambda: release(signed))
    several = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    if comps is None:
        return rows, stash(several.select("node", F.col("node").alias("comp")))
    out = stash(several.join(comps, "node", "full").select("node", F.coalesce("comp", "node").alias("comp")))
    release(comps)
    return rows, out


def classes(docs: DataFrame, sign: Signer = signatures.bag_minhash, counted: bool = True, least: float = LIKENESS) -> DataFrame:
    """doc_id, node and class_id of every row.

    Texts of equal words are one node; nodes whose bags of five-word shingles (of all words, where there are fewer) have
    a likeness of `least` or more are linked, and class_id is the least doc_id of the nodes that links connect. Null and
    empty texts and texts without words have no node: each row is a class of its own (class_id is its doc_id). Repeated
    rows share a class; null doc_ids are never the least unless alone. An empty table gives none. Only doc_id and text
    are read, so no other column can clash.
    """
    signed, comps = found_classes(docs, sign, counted, least)
    rows = stash(signed.select("doc_id", "node").join(comps, "node", "left"))
    release(signed, comps)
    of = stash(rows.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("class_id")))
    alone = rows.where("comp IS NULL").select("doc_id", "node", F.col("doc_id").alias("class_id"))
    return rows.where("comp IS NOT NULL").join(of, "comp").select("doc_id", "node", "class_id").unionByName(alone)


def keep_one(docs: DataFrame, sign: Signer = signatures.bag_minhash, counted: bool = True, least: float = LIKENESS) -> DataFrame:
    """Of each class one row, with all its columns: the one of least doc_id (null last; of several the least row_key(); of equal rows, one).

    Rows without words are all kept: nothing tells whether they are alike.
    """
    signed, comps = found_classes(docs, sign, counted, least)
    rows = stash(signed.select("doc_id", "row", "node").join(comps, "node").select("doc_id", "row", "comp").distinct())
    release(signed, comps)
    best = stash(rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")))
    told = rows.join(best, "comp").select("doc_id", "row", (F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.row") == F.col("row"))).alias("kept"))
    told = stash(told)
    release(rows, best)
    names = docs.columns
    row, flag, same, kept = unused([*names, "doc_id", "row"], "the_row", "flag", "same", "kept")
    marked = flagged(docs.withColumn(row, row_key()), row, told, "row", flag)
    told = told.select(F.col("doc_id").alias(same), F.col("row").alias(row), F.col("kept").alias(kept))
    met = marked.where(flag).join(told, (marked[row] == told[row]) & marked["doc_id"].eqNullSafe(told[same]), "left").drop(told[row])
    once = met.where(F.col(kept)).dropDuplicates(["doc_id", row])
    return marked.where(~F.col(flag)).select(*names).unionByName(met.where(F.col(kept).isNull()).select(*names)).unionByName(once.select(*names))


def op8_bagminhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id of every document; see classes() for what nulls, empty texts and repeats give."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "class_id")
