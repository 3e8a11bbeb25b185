"""Column functions and state machines against plain Python."""

import functools
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF
from wordmill.functions import edits, model, text
from wordmill.operators import learning, quality, review, sessions
from wordmill.streaming import ingest, typing


def plain_channel(a, b):
    """The same prices by recursion over prefixes."""

    @functools.cache
    def d(i, j):
        if not i or not j:
            return 4.0 * max(i, j)
        best = min(d(i - 1, j - 1) + edits.substitution(a[i - 1], b[j - 1]), d(i - 1, j) + 4.0, d(i, j - 1) + 4.0)
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and a[i - 1] != b[j - 1]:
            best = min(best, d(i - 2, j - 2) + 2.0)
        return best

    return d(len(a), len(b))


@settings(max_examples=200, deadline=None)
@given(st.text("aeiðþsrt", max_size=7), st.text("aeiðþsrt", max_size=7))
def test_channel(a, b):
    assert abs(edits.channel(a, b) - plain_channel(a, b)) < 1e-9


def test_variants():
    found = dict(edits.edits1("hus"))
    assert found["hús"] == edits.CONFUSED and found["hsu"] == 2.0 and "hus" not in found
    assert "kvöld" in edits.restorations("kvold") and "kaffi" in edits.geminations("kafi")


def test_columns(spark):
    one = spark.createDataFrame([("kaffi", "kafi"), ("Hús", "hus"), (None, "x")], "a string, b string")
    got = one.select(text.strip_accents(F.lower("a")).alias("s"), edits.category(F.col("b"), F.col("a")).alias("c"), text.unescape_tsv(text.escape_tsv(F.concat("a", F.lit("\t\\n")))).alias("t")).collect()
    assert [r["s"] for r in got] == ["kaffi", "hus", None]
    assert got[0]["c"] == "gemination" and got[0]["t"] == "kaffi\t\\n"
    mark = spark.createDataFrame([("ÞGFFTgr",), ("NFET",)], "m string").select(model.parse_mark(F.col("m")).alias("b")).select(model.unpack(F.col("b"), "case").alias("case"), model.unpack(F.col("b"), "number").alias("number"), model.unpack(F.col("b"), "definite").alias("d")).collect()
    assert [tuple(r) for r in mark] == [(3, 2, 1), (1, 1, 0)]


def test_halves(spark):
    rows = spark.range(50).select(F.col("id").cast("string").alias("k")).select("k", quality.halves(F.col("k")).alias("h")).collect()
    assert all(r["h"] == ("dev" if zlib.crc32(r["k"].encode()) % 2 == 0 else "heldout") for r in rows)


def plain_merge(rows, gone):
    out = {}
    for word, n, explicit, days, touch in rows:
        if word not in gone:
            m, e, d, t = out.get(word, (0, False, set(), None))
            key = (-touch[0], *touch[1:])
            out[word] = (max(m, n), e or explicit, d | set(days), key if t is None else min(t, key))
    return {w: (n, e, sorted(d)[:8], (-t[0], *t[1:])) for w, (n, e, d, t) in out.items()}


def test_merge_laws(spark):
    r = random.Random(5)
    touch = lambda: (r.randint(0, 2), *(r.randint(0, 1) / 4 for _ in range(5)))
    rows = [(r.choice("abcde"), r.randint(1, 9), r.random() < 0.3, sorted(r.sample(range(12), 3)), touch()) for _ in range(40)]
    schema = "word string, n long, explicit boolean, days array<int>, touch struct<n: int, x: double, y: double, xx: double, yy: double, xy: double>"
    gone = spark.createDataFrame([("c",)], "word string")
    found = lambda some: {x["word"]: (x["n"], x["explicit"], x["days"], tuple(x["touch"])) for x in learning.merged(spark.createDataFrame(some, schema), [], gone).collect()}
    assert found(rows) == plain_merge(rows, {"c"})
    assert found(rows + rows[::-1]) == plain_merge(rows, {"c"})  # order and repetition don't matter
    once = [(w, *v) for w, v in found(rows).items()]
    assert found(once + rows) == found(rows) and found(once) == found(rows)  # what was merged absorbs its parts


def test_merged_pairs(spark):
    rows = spark.createDataFrame([("a", "b", 3), ("a", "b", 5), ("b", "a", 5), ("c", "a", 9), ("a", "d", 4)], "w1 string, w2 string, n long")
    got = learning.merged_pairs(rows, [], spark.createDataFrame([("c",)], "word string"), 2).collect()
    assert sorted((r["w1"], r["w2"], r["n"]) for r in got) == [("a", "b", 5), ("b", "a", 5)]


def test_slips_between_words(spark):
    cases = [  # typo, meant, plausible, inflection, category
        ("a", "ef", False, False, "substitution"), (".", "er", False, False, "substitution"), ("a", "á", True, False, "accent_drop"), ("vi", "við", True, False, "deletion"), ("er", "xy", False, False, "substitution"),
        ("Same", "same", False, False, "other"), ("dont", "don't", True, False, "contraction_damage"), ("it's", "is", True, False, "contraction_damage"), ("of the", "ofthe", True, False, "space_miss"), ("a b", "xyz", False, False, "space_miss"),
        ("kirkjubæjarklaustri", "Kirkjubæjarklaustur", True, True, "substitution"), ("reykjavik", "reykjavikur", True, False, "substitution"), ("kafi", "kaffi", True, False, "gemination"), ("teh", "the", True, False, "transposition"), ("foðu", "góðu", True, False, "substitution"), ("foðu", "af", False, False, "substitution"),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "t string, w string")
    got = df.select(edits.is_plausible(F.col("t"), F.col("w")).alias("p"), edits.is_inflection(F.col("t"), F.col("w")).alias("i"), edits.category(F.col("t"), F.col("w")).alias("c")).collect()
    assert [(r["p"], r["i"], r["c"]) for r in got] == [c[2:] for c in cases]


def test_trend_by_session(spark):
    rows = [("old", d) for d in range(10) for _ in range(2)] + [("new", 9)] + [("more", d) for d in range(10)] + [("more", 9)] * 3 + [("less", d) for d in range(7)]
    got = {r["word"]: (r["total"], r["recent"], r["prior"], r["trend"]) for r in sessions.trends(spark.createDataFrame(rows, "word string, day int"), "word", "day").collect()}
    assert got == {"old": (20, 6, 14, "flat"), "new": (1, 1, 0, "rising"), "more": (13, 6, 7, "rising"), "less": (7, 0, 7, "falling")}


def test_silent_candidates(spark):
    common = {"hann": 900, "frá": 800, "fá": 100, "síðan": 90, "að": 5000, "fram": 70}
    words = spark.createDataFrame(list(common.items()), "word string, freq long")
    asked = spark.createDataFrame([("habb",), ("fra",), ("awgke",)], "typed string")

    def plain(token):
        one = set(edits.cheap_edits(token))
        two = {x for w in one for x in edits.cheap_edits(w)}
        found = {w: 0 if w in one else 1 if w in two else 2 for w in common if w != token and (w in one or w in two or near(token, w))}
        return sorted(found, key=lambda w: (found[w], -common[w], w))[:5]

    def near(a, b):
        d = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            e = [i]
            for j, k in enumerate(b, 1):
                e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (c != k)))
            d = e
        return d[-1] <= 2

    from wordmill.operators import lookup

    got = review.silent_candidates(asked, words, edits.variants("cheap"), lookup.fuzzy(asked, words, 2)).orderBy("typed", "rank").collect()
    assert {t: [r["word"] for r in got if r["typed"] == t] for t in ("habb", "fra", "awgke")} == {t: plain(t) for t in ("habb", "fra", "awgke")}
    assert [r["penalty"] for r in got if r["typed"] == "fra"][0] == 0


def test_stale_applies_and_taps(spark):
    rows = [("s", 1.0, "ég fer ", "none", "", 0), ("s", 2.0, "ég fer hem", "autocorrect", "fer", 1), ("s", 3.0, "ég fer hem", "autocorrect", "fer", 0), ("s", 4.0, "ég fer heim ", "stale-skip", "hem", 0)]
    got = sessions.stale_applies(spark.createDataFrame(rows, "sid string, t double, window string, kind string, applied string, others int")).orderBy("t").collect()
    assert [(r["t"], r["applied"], r["prev"]) for r in got] == [(2.0, "fer", "fer"), (4.0, "hem", "fer")]
    taps = spark.createDataFrame([([("h", 0.1, 0.0), ("y", 0.2, 0.1)], "hú"), ([("h", 0.1, 0.0)], "hús")], "taps array<struct<c: string, dx: double, dy: double>>, word string")
    assert [len(r["taps"]) for r in review.aligned_taps(taps).collect()] == [1, 0]


def plain_episodes(texts):
    """Stretches by their definition: from each fall that follows no fall, down and then up."""
    falls, way = [], 0
    for i in range(1, len(texts)):
        turn = (len(texts[i]) > len(texts[i - 1])) - (len(texts[i]) < len(texts[i - 1]))
        if turn < 0 and way >= 0:
            falls.append(i)
        way = turn or way
    out = []
    for k, i in enumerate(falls):
        end = falls[k + 1] if k + 1 < len(falls) else len(texts)
        low = i
        while low + 1 < end and len(texts[low + 1]) <= len(texts[low]):
            low += 1
        if texts[end - 1] != texts[i - 1] and texts[low] != texts[i - 1]:
            out.append((texts[i - 1], texts[low], texts[end - 1]))
    return out


def test_episodes_equal_plain_scan(spark):
    r = random.Random(3)
    all_texts = {str(k): ["x" * r.randint(0, 4) + r.choice("ab") for _ in range(r.randint(1, 14))] for k in range(60)}
    rows = spark.createDataFrame([(k, float(i), t) for k, ts in all_texts.items() for i, t in enumerate(ts)], "sid string, t double, text string")
    got = {}
    for e in sessions.episodes(rows).orderBy("sid", "peak_t").collect():
        got.setdefault(e["sid"], []).append((e["peak"], e["trough"], e["end"]))
    assert got == {k: want for k, ts in all_texts.items() if (want := plain_episodes(ts))}


def test_episodes(spark):
    texts = ["ka", "kaffo", "kaf", "kaffi", "kaffi k", "kaffi", "kaffi k"]
    rows = spark.createDataFrame([("s", float(i), t) for i, t in enumerate(texts)], "sid string, t double, text string")
    got = sessions.episodes(rows).collect()
    assert [(e["peak"], e["trough"], e["end"]) for e in got] == [("kaffo", "kaf", "kaffi k")]


def test_typing():
    assert typing.replay(["ég", "ég ", "ég fer", "ég fór", "ég fór "]) == [(1, "wc", "ég", None), (3, "cr", "fór", "fer"), (4, "wc", "fór", "ég")]
    ledger = typing.Ledger()
    for k in range(40):
        ledger.expect(str(k))
    assert len(ledger.waiting) == typing.CAPACITY and ledger.observe("20") and not ledger.observe("9")
    for _ in range(typing.EXPIRES):
        ledger.observe("nothing")
    assert not ledger.waiting


def test_typing_stream_equals_batch(spark, tmp_path):
    rows = [("a", 0.0, "x"), ("a", 1.0, "x y "), ("b", 0.0, "p "), ("a", 2.0, "x y z "), ("b", 1.0, "p q ")]
    schema = "sid string, t double, text string"
    for k in range(2):
        spark.createDataFrame(rows[k * 3 : k * 3 + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = typing.commits_stream(ingest.read_files(spark, str(tmp_path / "in"), schema))
    ingest.run(stream, str(tmp_path / "log"), ingest.batch_writer(str(tmp_path / "out"))).awaitTermination()
    want = {tuple(r) for r in typing.commits(spark.createDataFrame(rows, schema)).collect()}
    assert {tuple(r)[:5] for r in spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()} == want


def test_fold_word():
    assert ingest.fold_word(None, [1, 1, 2], False) == (3, 2, [1, 2], False)
    assert ingest.fold_word((3, 2, [1, 2], False), [9], True) == (4, 3, [1, 2, 9], True)
    assert ingest.fold_word((8, 8, list(range(8)), False), [9], False)[1] == 8


def test_sources(spark, tmp_path):
    from wordmill.sources import text as sources

    (tmp_path / "w.txt").write_text("Kaffi 3\nkaffi 4\nbad line\ntwo words 5\n")
    assert {tuple(r) for r in sources.word_counts(spark, str(tmp_path / "w.txt")).collect()} == {("kaffi", 7), ("two words", 5)}
    (tmp_path / "c.jsonl").write_text('COLD_START_JSON {"runId":"a","metrics":{"x":1.0}}\nnonsense\n{"runId":"a","metrics":{"x":1.0}}\n{"runId":"b","metrics":{"x":-1.0}}\n')
    good, bad = sources.cold_starts(spark, str(tmp_path / "c.jsonl"))
    assert [(r["runId"], r["duplicates"]) for r in good.collect()] == [("a", 1)]
    assert {r["reason"]: r["n"] for r in bad.collect()} == {"unreadable": 1, "invalid": 1}
    events = spark.createDataFrame([(1, "wc", "orð\tx", "", ""), (1, "wc", "orð", "a", "")], "day int, code string, f1 string, f2 string, f3 string")
    sources.append_events(events, str(tmp_path / "log"))
    assert [r["f1"] for r in sources.learning_log(spark, str(tmp_path / "log")).collect()] == ["orð"]


def test_whole_tables_are_read(spark):
    from wordmill import plans

    words = plans.QUERIES["unigram_counts"](spark, SF).agg(F.sum("freq")).first()[0]
    assert words == spark.read.parquet(f"{SF}/documents.parquet").select(F.sum(F.size(text.words(F.col("text"))))).first()[0]
