"""Operators against brute force on the smallest tables, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tests.conftest import SF  # noqa: E402
from wordmill.llm import decontaminate, editcount, fingerprints, language, licenses, lines, neardup, packing, queries, quotes, secrets, signatures, tokens, vec  # noqa: E402

BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, None), (2, ""), (3, "   \n"), (4, "é" * 30_000), (None, "a b c d e f g"), (5, "one two three four five six"), (5, "one two three four five six"), (6, "İstanbul \u0000 x"), (7, "a\n\nb")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", t) for i, t in ODD], "doc_id long, text string, lang string, source string, node string")


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def bag(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def test_tokens_equal_the_tokenizer(docs):
    texts = [r["text"] or "" for r in docs.collect()] + [t or "" for _, t in ODD] + ["it's WE'LL 'tis don't 12a", "ǅ ﬁ Å é"]
    exact = tokens.word_bpe(BPE).exact
    for lo, hi, ids, bounds in tokens.word_bpe(BPE).encode(pa.array(texts)):
        for k in range(lo, hi):
            assert ids[bounds[k - lo] : bounds[k - lo + 1]].tolist() == exact.encode(texts[k], add_special_tokens=False).ids


def test_edit_counts_equal_counting_anew(docs, odd):
    from pyspark.sql import functions as F

    exact = tokens.word_bpe(BPE).exact
    count = lambda t: len(exact.encode(t, add_special_tokens=False).ids)
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).withColumn("edits", F.expr(editcount.EDITS))
    got = Counter((r["doc_id"], r["n_ids"], r["n_chars_after"], r["n_ids_after"]) for r in editcount.count_edits(rows, BPE).collect())
    want = Counter()
    for r in rows.collect():
        text = r["text"] or ""
        for e in r["edits"] or []:
            a = min(max(0, e["start"] or 0), len(text))
            b = min(max(a, e["stop"] or 0), len(text))
            text = text[:a] + (e["new"] or "") + text[b:]
        want[(r["doc_id"], count(r["text"] or ""), len(text), count(text))] += 1
    assert got == want


def test_packing(docs, odd):
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    packed = packing.pack_documents(rows, BPE, keep_ids=True).toPandas()
    assert packed["length"].between(1, 2048).all()
    for _, part in packed.sort_values("offset").groupby("sequence_id"):
        assert (part["offset"].to_numpy() == np.concatenate([[0], np.cumsum(part["length"])[:-1]])).all() and part["length"].sum() <= 2048
    assert all(c == zlib.crc32(np.array(i, "<u4").tobytes()) for c, i in zip(packed["ids_crc32"], packed["ids"], strict=True))
    exact = tokens.word_bpe(BPE).exact
    assert packed["length"].sum() == sum(len(exact.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in rows.collect())
    least = packing.bound(np.bincount(packed["length"], minlength=2049), 2048)
    assert packed["sequence_id"].nunique() <= least + max(1, least // 1000)


def test_bin_completion_beats_best_fit():
    lengths = np.array([6, 5, 5, 4, 4, 4, 2], np.int64)  # best fit: 4 bins of 10, best: 3
    own, place = packing.pack(lengths, 10)
    assert own.max() + 1 == packing.bound(np.bincount(lengths, minlength=11), 10) == 3


def least_bins(lengths, capacity):
    """The optimum by depth-first search, longest piece first, equal rooms once."""
    best = len(lengths)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= lengths[k]:
                rest = list(rooms)
                rest[rest.index(room)] -= lengths[k]
                put(k + 1, rest)
        put(k + 1, [*rooms, capacity - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    put(0, [])
    return best


def test_few_pieces_are_packed_optimally():
    rng = np.random.default_rng(9)
    for _ in range(300):
        capacity = int(rng.integers(8, 40))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 10)))
        own, _ = packing.pack(lengths.astype(np.int64), capacity)
        assert own.max() + 1 == least_bins(lengths.tolist(), capacity)


def test_language_held_out(docs):
    model = language.train(docs)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["lang"] and len(words(r["text"])) > 5]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_near_duplicates_equal_brute_force(docs, odd):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both and both / (sum(bags[i].values()) + sum(bags[j].values()) - both) >= 0.8:
                a, b = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                parent[b] = a
    want = {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()} == want
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "7", "None"]


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(3)
    h = vec.mix(np.arange(60, dtype=np.uint64))
    a, b = rng.integers(0, 4, 60), rng.integers(0, 4, 60)
    sign = lambda w: signatures.bag_minhash(np.repeat(h, w), np.zeros(w.sum(), np.int64), 1, 4096)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sign(a) == sign(b)).mean() - want) < 0.04


def test_lines():
    rng = np.random.default_rng(1)
    xs = ["".join(rng.choice(list("abcé"), rng.integers(0, 60))) for _ in range(400)]
    ys = ["".join(c for c in x if rng.random() > 0.1) + "z" * int(rng.integers(0, 3)) for x in xs]

    def plain(a, b):
        last = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row = [i]
            for j, d in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
            last = row
        return last[-1]

    far = [plain(a, b) for a, b in zip(xs, ys, strict=True)]
    assert [lines.edits(a, b) for a, b in zip(xs, ys, strict=True)] == far
    assert lines.alike(xs, ys).tolist() == [d <= 0.2 * max(len(a), len(b)) + 1e-9 for d, a, b in zip(far, xs, ys, strict=True)]


def test_line_dedup(spark):
    long = "the quick brown fox jumps over the lazy dog near the old river bank today"
    near = long.replace("quick", "quik")
    rows = [(1, f"{long}\nshort one\nunique words stand here alone"), (2, f"short one\n{long.upper()}"), (3, f"{near}\nanother line of its own here"), (4, None), (5, ""), (6, long), (6, long)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_lines string")
    got = sorted(((r["doc_id"], r["text"], r["n_dropped"]) for r in lines.dedup(df).collect()), key=str)
    assert got == sorted([(1, rows[0][1], 0), (2, "short one", 1), (3, "another line of its own here", 1), (4, None, 0), (5, "", 0), (6, "", 1), (6, "", 1)], key=str)


def test_decontamination(spark):
    item = " ".join(f"word{k}" for k in range(20))
    swapped = " ".join("other" if k in (6, 13) else f"word{k}" for k in range(20))
    many = " ".join("other" if k % 5 in (1, 3) else f"word{k}" for k in range(20))  # 12 of 20 are left
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, f"some {swapped} end"), (3, "nothing of it"), (4, None), (5, ""), (6, "an Exact short item, yes"), (7, f"x {many} y"), (8, "it has word1 word2 word3 word4 word5 word6 alone")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (10, None), (11, "too few"), (12, "an exact short item yes"), (9, item)], "item_id long, text string")
    want = [(1, 9, 20), (2, 9, 18), (6, 12, 5), (7, 9, 12)]
    for block in (decontaminate.BLOCK, 5):
        assert sorted((r["doc_id"], r["item_id"], r["n_equal"]) for r in decontaminate.leaks(docs, bench, block=block).collect()) == want
    clash = docs.selectExpr("doc_id", "text", "text AS row", "doc_id AS flag", "text AS slot")
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(clash, bench).collect()) == [3, 4, 5, 8]
    assert decontaminate.keep_clean(clash, bench).columns == clash.columns
    assert decontaminate.leaks(docs.limit(0), bench).count() == decontaminate.leaks(docs, bench.limit(0)).count() == 0


def plain_overlap(text, item):
    """Equal words of an item by all diagonals, one at a time."""
    equal = set()
    for shift in range(-len(item) + 1, len(text)):
        same = [0 <= k + shift < len(text) and text[k + shift] == w for k, w in enumerate(item)]
        lo, hi = max(0, -shift), min(len(item), len(text) - shift)
        best = max(((sum(1 if same[k] else -1 for k in range(a, b)), b, -a) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
        some = {k for k in range(-best[2], best[1]) if same[k]}
        if len(some) >= decontaminate.LEAST:
            equal |= some
    return len(equal)


def test_leaks_equal_all_diagonals(spark):
    rng = np.random.default_rng(2)
    items = [[f"i{k}w{j}" for j in range(int(rng.integers(5, 26)))] for k in range(12)]
    texts = []
    for k in range(60):
        item = items[k % 12]
        part = [w if rng.random() > 0.35 * rng.random() else f"x{rng.integers(99)}" for w in item][int(rng.integers(0, 4)) :]
        if k % 3 == 0 and len(part) > 8:
            part.insert(4, "more")
        texts.append([f"y{rng.integers(99)}" for _ in range(5)] + part + [f"z{rng.integers(99)}" for _ in range(5)])
    frame = lambda rows, name: spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], f"{name} long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_equal"] for r in decontaminate.leaks(frame(texts, "doc_id"), frame(items, "item_id")).collect()}
    want = {(i, j): n for i, t in enumerate(texts) for j, w in enumerate(items) if decontaminate.is_leak(n := plain_overlap(t, w), len(w))}
    assert len(want) > 20 and got.keys() <= want.keys() and len(got) >= 0.95 * len(want)
    assert all(got[k] <= want[k] for k in got) and sum(got[k] == want[k] for k in got) >= 0.9 * len(got)


@pytest.mark.parametrize("n", [8, 10, 13, 16, 20, 30, 40])
def test_seeds_meet_substituted_items(n):
    """Recall at the most substitutions that still are a leak."""
    rng = np.random.default_rng(4)
    most = n - max(decontaminate.WORDS, int(np.ceil(decontaminate.SHARE * n)))
    met = 0
    for _ in range(300):
        a = vec.mix(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = a.copy()
        b[rng.choice(n, most, replace=False)] ^= np.uint64(1)
        met += any(len(np.intersect1d(decontaminate.seeds(a, np.zeros(n), m)[0], decontaminate.seeds(b, np.zeros(n), m)[0])) for m in decontaminate.MASKS)
    assert met >= 270


def test_fingerprints(docs, odd):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.compare_edits(docs).collect()}
    for k, (i, text) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert len({(hashlib.md5((t or "").encode()).digest(), got[i]["fingerprint"]) for i, t in rows}) == len({t for _, t in rows})
    assert fingerprints.compare_edits(odd).count() == len(ODD)
    assert fingerprints.compare_edits(odd.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_fingerprints_follow_ids_beyond_doubles(spark, kind):
    ids = [2**60 + k for k in range(40)] if kind == "long" else [f"prefix-{k:03d}" for k in range(40)]
    texts = [f"text {k} " * (k % 5 + 1) for k in range(40)]
    got = {r["doc_id"]: r for r in fingerprints.compare_edits(spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {kind}, text string")).collect()}
    order = sorted(range(40), key=lambda k: ids[k], reverse=True)
    for place, k in enumerate(order):
        after, half = texts[order[(place + 1) % 40]], len(texts[k]) // 2
        edited = texts[k][: len(texts[k]) - half] + after[:half]
        assert got[ids[k]]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_minhash_classes_equal_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = [set(bag(t)) for _, t in rows]
    root = {i: i for i, _ in rows}
    for a, (i, _) in enumerate(rows):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[i] != root[rows[b][0]]:
                x, y = sorted((root[i], root[rows[b][0]]))
                root = {k: x if r == y else r for k, r in root.items()}
    assert {r["doc_id"]: r["class_id"] for r in fingerprints.near_duplicates(docs).collect()} == root


def test_secrets(docs):
    from pyspark.sql import functions as F

    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    for r in secrets.scan(docs).join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id").collect():
        t = r["text"]
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [(s["start"], secrets.KINDS.index(s["kind"]), s["end"]) for s in r["spans"] if s["kind"] != "novel"] == sorted(want)
        assert all(0 <= s["start"] < s["end"] <= len(t) for s in r["spans"])


def test_novel_secrets(spark):
    secret = "x9Kq2LmZ7vTb4RwYp0Hs"
    rows = [(1, f"auth header: bearer {secret} end"), (2, f"no such place {secret}"), (3, "signature = value_list_order_status_12 and auth example_access_key_id_2"), (4, f"token={secret}")]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [("novel", 20, 40)], 2: [], 3: [], 4: [("assign", 0, 26)]}


def test_licenses(docs, spark):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    more = spark.createDataFrame([(-1, "x MIT License, mit-license; CC BY 4.0 and Apache\nLicense"), (-2, "Licensed under the Apche License, Version 2.0"), (-3, None)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(more)
    text = {r["doc_id"]: r["text"] for r in rows.collect()}
    got = {r["doc_id"]: r for r in licenses.scan(rows).collect()}
    for i, t in text.items():
        w = pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        at = sorted(k for k, _ in places)
        assert (got[i]["n_words"], got[i]["n_base"], got[i]["first_word"], got[i]["last_word"]) == (len(w), len(at), at[0] if at else None, at[-1] if at else None)
        assert got[i]["base_labels"] == sorted({label for _, label in places})
    assert [(n["label"], n["edits"]) for n in got[-2]["notices"]] == [("apache-2.0", 1)]


def plain_quotes(rows):
    """Link and place of every message, one by one."""
    normal = lambda t: re.sub(r"[\W_]+", " ", t.lower()).strip()
    parts = lambda t: {p for x in (t, *re.split(r"\n\s*\n", t), *t.split("\n")) if len((p := normal(x)).split()) >= quotes.LEAST}
    parsed = {}
    for conv, turn, _, text in rows:
        blocks = []
        for line in (text or "").split("\n"):
            mark = re.match(r"[ \t]*((?:>[ \t]?)+)", line)
            depth = mark[1].count(">") if mark else 0
            line = line[mark.end() :] if mark else line
            if blocks and blocks[-1][0] == depth:
                blocks[-1][1].append(line)
            else:
                blocks.append((depth, [line]))
        own = "\n".join("\n".join(b) for d, b in blocks if not d)
        quoted = {}
        for d, b in blocks:
            for p in parts("\n".join(b)) if d else ():
                quoted[p] = min(quoted.get(p, 99), d)
        parsed[conv, turn] = (parts(own.strip()), quoted)
    out = {}
    for at, (_, quoted) in parsed.items():
        found = []
        for p, depth in quoted.items():
            said = sorted(k for k, (own, _) in parsed.items() if p in own and k < at)
            if said:
                found.append((-depth, next((k for k in said if k[0] == at[0]), said[0])))
        earlier = sorted(k for k in parsed if k[0] == at[0] and k < at)
        out[at] = (max(found)[1] if found else earlier[-1] if earlier else None, len(found))
    root = {}
    for conv in sorted({c for c, _ in parsed}):
        up = [reply[0] for (c, _), (reply, n) in out.items() if c == conv and n and reply[0] < conv]
        root[conv] = root[min(up)] if up else conv
    place = {}
    for thread in set(root.values()):
        place |= {k: i for i, k in enumerate(sorted(k for k in parsed if root[k[0]] == thread))}
    return {k: (*out[k], root[k[0]], place[k]) for k in parsed}


def test_quotes_equal_plain_linking(spark):
    rng = np.random.default_rng(11)
    rows, said = [], []
    for conv in range(40):
        for turn in range(int(rng.integers(1, 5))):
            own = " ".join(f"w{rng.integers(400)}" for _ in range(int(rng.integers(3, 8))))
            quote = [f"{'>' * int(rng.integers(1, 3))} {said[int(rng.integers(len(said)))]}" for _ in range(int(rng.integers(0, 3)))] if said else []
            said.append(own)
            rows.append((conv, turn, "user", "\n".join([*quote, own])))
    got = {(r["conv_id"], r["turn"]): ((r["reply_conv"], r["reply_turn"]) if r["reply_turn"] is not None else None, r["n_found"], r["thread"], r["position"]) for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == plain_quotes(rows)


def test_quotes(spark):
    rows = [(1, 0, "user", "How does the pump work here?"), (1, 1, "assistant", "> How does the pump work here?\nBy pressure."), (2, 0, "user", ">> How does the pump work here?\nReally?"), (3, 0, "user", None), (None, 1, "user", "> x\ny"), (4, None, "user", "z"), (5, 0, "user", "z"), (5, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table = quotes.conversations(df.selectExpr("*", "text AS row", "text AS own", "turn AS position")).collect()
    got = {(r["conv_id"], r["turn"]): r for r in table}
    assert len(table) == len(rows) and sorted(r["position"] for r in table if r["conv_id"] == 5) == [0, 1]
    assert (got[1, 1]["text"], got[1, 1]["reply_conv"], got[1, 1]["reply_turn"], got[1, 1]["n_quotes"]) == ("By pressure.", 1, 0, 1)
    assert got[2, 0]["text"] == "Really?" and (got[2, 0]["reply_conv"], got[2, 0]["reply_turn"], got[2, 0]["thread"], got[2, 0]["position"]) == (1, 0, 1, 2)
    assert got[3, 0]["text"] is None and got[4, None]["position"] is None
    assert quotes.conversations(df.limit(0)).count() == 0 and not queries.ORACLE_SQL


@pytest.mark.parametrize("operator", ["scan_licenses", "identify", "secrets", "pieces", "nodes", "fingerprints"])
def test_odd_and_empty_rows(odd, operator):
    run = {"scan_licenses": licenses.scan, "identify": lambda d: language.identify(d, language.fit(["a b"], ["en"])), "secrets": secrets.scan, "pieces": lambda d: packing.token_pieces(d, BPE), "nodes": lambda d: neardup.classes(d), "fingerprints": fingerprints.fingerprints}[operator]
    assert {r["doc_id"] for r in run(odd).collect()} == {i for i, _ in ODD}
    assert run(odd.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        docs = corpus_pipeline.stash(after)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
