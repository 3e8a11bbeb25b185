"""Pairs of words counted over blobs: as by rows, whatever is merged on the way."""

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from wordmill.operators import lexicon, paircount

TEXTS = [None, "", "12 .. 7", "a", "A a a", "Það er það, sem ÞAÐ er", "𝒜b x𝒜b 𝒜b", "x1y\tx\ny", "éte été", "b a b a b a"]


def _count():
    pairs, words = Counter(), Counter()
    for text in ("a", "a a a", "b a b a b", "c b a", "a c a b"):
        ws = text.split()
        words.update(ws)
        pairs.update(zip(ws, ws[1:]))
    return pairs, words


def test_counts_equal_rows(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    pairs, words = lexicon.counted(docs)
    want = {tuple(r) for r in lexicon.pairs(docs).groupBy("w1", "w2").agg(F.count("*")).collect()}
    uni = {tuple(r) for r in lexicon.unigrams(docs).collect()}
    assert {tuple(r)[:3] for r in pairs.collect()} == want
    assert {tuple(r) for r in words.collect()} == uni
    assert all(r["n1"] == dict(uni)[r["w1"]] for r in pairs.collect())


def test_merges_on_the_way(monkeypatch):
    monkeypatch.setattr(paircount, "HELD", 2)
    texts = pa.RecordBatch.from_arrays([pa.array(["a", "a a a", "b a b a b", "c b a", "a c a b"])], ["text"])
    blobs = pa.Table.from_batches([b for _ in range(3) for b in paircount._dealt([texts])]).sort_by("bucket").combine_chunks().to_batches()
    pairs, words = _count()
    found = [r for b in paircount._pairs(blobs) for r in b.to_pylist()]
    assert {(r["w1"], r["w2"]): r["freq"] for r in found} == {p: 3 * n for p, n in pairs.items()}
    assert {r["word"]: r["freq"] for b in paircount._words(blobs) for r in b.to_pylist()} == {w: 3 * n for w, n in words.items()}
    best = [r for bucket in paircount._buckets(blobs) for r in bucket.best(2).to_pylist()]
    for first in words:
        want = sorted((-n, w2) for (w1, w2), n in pairs.items() if w1 == first)[:2]
        assert [(-r["freq"] // 3, r["w2"]) for r in best if r["w1"] == first] == want
