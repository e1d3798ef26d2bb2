"""Near duplicates, repeats, fingerprints and similar vectors against brute force."""

import hashlib
import random
import re
import tracemalloc
import unicodedata
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeledger.llm import components as components_
from treeledger.llm import repeats, staging
from treeledger.llm.cells import runs
from treeledger.llm.components import components, forest
from treeledger.llm.embedding_dedup import similar_vectors
from treeledger.llm.fingerprint import fingerprints
from treeledger.llm.minhash import near_duplicates, unique_documents
from treeledger.llm.repeats import deduplicated, without_repeats
from treeledger.llm.suffix_array import sorted_strings, suffix_array

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(row):
    return tuple((x is not None, x) for x in row)


def joined(ids, links):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def near(rows, width, percent=80):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    common = defaultdict(int)
    for v in holders.values():
        for i, a in enumerate(sorted(v)):
            for b in sorted(v)[i + 1 :]:
                common[a, b] += 1
    links = [p for p, k in common.items() if 100 * k >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - k)]
    return sorted((d, len(sets[d]), c, d == c) for d, c in joined(sets, links).items())


def test_near_duplicates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r) for r in near_duplicates(docs, width=4).collect())
    assert got == near([(r.doc_id, r.text) for r in docs.collect()], 4)


def test_crowded_buckets_lose_no_link(spark):
    """Many copies with edits, so that likeness lies on both sides of the threshold."""
    rng = random.Random(2)
    rows = []
    for base in range(3):
        text = [f"w{base}_{rng.randrange(10**6)}" for _ in range(120)]
        for i in range(60):
            own = list(text)
            for _ in range(rng.randrange(9)):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
            rows.append((base * 100 + i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_duplicates(docs, width=4).collect()) == near(rows, 4)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, "A b c", "x"), (2, "a  B\tc", "x"), (3, None, "x"), (4, "", "x"), (5, " \n", "x"), (6, "z", "x"), (7, "Z", "x"), (7, "Z", "x"), (8, "word " * 3000, "x"), (None, "a b c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((tuple(r) for r in near_duplicates(docs).collect()), key=key)
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False), (7, 1, 6, False), (8, 1, 8, True), (None, 1, None, True)], key=key)
    kept = unique_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 4, 5, 6, 8, None], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("at_once", [10**6, 7])
def test_components(spark, monkeypatch, at_once):
    """With few links to a task it takes the rounds over all of them."""
    monkeypatch.setattr(components_, "CONTRACTED", at_once)
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (1, 2)]
    got = {r.vertex: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: c for v, c in joined({x for p in links for x in p}, links).items()}


@pytest.mark.parametrize("letters", [1, 2, 4, 250])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    for n in (1, 2, 7, 300):
        text = rng.integers(0, letters, n).astype(np.uint8)
        assert suffix_array(text, n + 8).tolist() == sorted(range(n), key=lambda i: text.tobytes()[i:])


def cut(rows, n=50):
    order = lambda d: 2**63 - 1 if d is None else d
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            first[b[i : i + n]] = min(first.get(b[i : i + n], order(d)), order(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < order(d):
                gone[i : i + n] = True
        rest = np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=key)


PASSAGE = "This passage is longer than fifty bytes, and more than one document holds it. "
ODD = [
    (1, PASSAGE), (2, "x" + PASSAGE + "y"), (3, PASSAGE), (3, PASSAGE), (3, "ab" + PASSAGE[:60]), (None, PASSAGE * 2), (None, PASSAGE), (5, None), (6, ""), (7, "a" * 300), (8, "b" + "a" * 200),
    (9, "é" * 80), (10, "zé" * 3 + "é" * 60), (11, PASSAGE[:49]), (12, PASSAGE[:50]), (12, "\0" * 70), (13, "\0" * 80), (14, "\n".join([PASSAGE] * 900)),
]


def test_repeats(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    assert sorted((tuple(r) for r in deduplicated(docs).collect()), key=key) == cut(ODD)
    assert deduplicated(docs.limit(0)).count() == 0
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted((tuple(r) for r in deduplicated(real).collect()), key=key) == cut([(r.doc_id, r.text) for r in real.collect()])


def test_texts_without_repeats(spark):
    rows = [(*r, "n") for r in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").selectExpr("*", "cast(length(text) as int) n_chars")
    out = without_repeats(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text or "", r.n_chars) for r in out.collect()), key=key)
    assert len(got) == len(rows)
    sums = {(d, hashlib.sha256(t.encode()).hexdigest()) for d, t, _ in got if d is not None and d < 9}
    assert sums == {(d, sha) for d, _, _, _, sha in cut(ODD) if d is not None and d < 9}


def described(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    canon = lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())).strip(" ")
    for i, (d, t) in enumerate(rows):
        t, following = t or "", rows[(i + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        yield d, len(t), hashlib.sha256(edited.encode()).hexdigest(), canon(t), canon(edited), float(canon(t) == canon(edited)), float(canon(t) == canon(following))


@pytest.mark.parametrize("bits", [64, 3])
def test_fingerprints(spark, bits):
    """With three bits most buckets hold unequal texts, and the comparison of bytes has to part them."""
    small = [(1, "Ab  c"), (2, "ab C"), (5, None), (7, ""), (None, "ﬁx Straße"), (9, "fix STRASSE"), (9, "fix STRASSE"), (9, "zz"), (11, "é"), (12, "É")]
    for docs in (spark.createDataFrame(small, "doc_id long, text string"), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        got = sorted((tuple(r) for r in fingerprints(docs, bits).collect()), key=lambda r: key((r[0], r[2])))
        want = sorted(described([(r.doc_id, r.text) for r in docs.collect()]), key=lambda r: key((r[0], r[2])))
        assert [(*r[:3], *r[5:]) for r in got] == [(*r[:3], *r[5:]) for r in want]
        pairs = {(g[i], w[i]) for g, w in zip(got, want, strict=True) for i in (3, 4)}
        assert len({p[0] for p in pairs}) == len({p[1] for p in pairs}) == len(pairs)


def test_fingerprints_of_one_and_no_document(spark):
    one = spark.createDataFrame([(3, "abcd", 1)], "doc_id long, text string, digest int")
    row = fingerprints(one).first()
    assert (row.near_next, row.edited_sha256) == (1.0, hashlib.sha256(b"abab").hexdigest())
    assert fingerprints(one.limit(0)).count() == 0


def linked(rows, cosine=0.98):
    rows = list(rows)
    ok = [d is not None and v is not None and k is not None and None not in v and np.isfinite(v).all() and np.any(v) for d, v, k in rows]
    unit = [np.array(v, float) / np.linalg.norm(v) if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    links, n = [], [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links.append((i, j))
                n[i] += 1
                n[j] += 1
    top = joined(range(len(rows)), links)
    low = defaultdict(list)
    for i in range(len(rows)):
        low[top[i]].append(rows[i][0])
    return sorted(((d, n[i], min(low[top[i]]) if ok[i] else d, not ok[i] or d == min(low[top[i]])) for i, (d, _, _) in enumerate(rows)), key=key)


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(30):
        centre = rng.standard_normal(64)
        for _ in range(20):
            rows.append((len(rows), (centre + rng.uniform(0, 0.2) * rng.standard_normal(64)).tolist(), c % 3))
    hot = rng.standard_normal(64)
    rows += [(1000 + i, (hot + 0.05 * rng.standard_normal(64)).tolist(), 1) for i in range(150)] + [(2000 + i, hot.tolist(), 1) for i in range(9)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((tuple(r) for r in similar_vectors(docs, block=40).collect()), key=key)
    assert got == linked(rows)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.01], 1), (3, [2.0, 0.01], 1), (4, [0.0, 0.0], 1), (5, None, 1), (6, [1.0, None], 1), (7, [1.0, float("nan")], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 2), (10, [1.0, 0.0, 0.0], 1), (11, [-1.0, 0.0], 1), (12, [], 1), (13, [1e300, 1.0], 1), (14, [float("inf"), 1.0], 1)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    want = linked([r if r[0] != 13 else (13, [1.0, 0.0], 1) for r in rows])
    assert sorted((tuple(r) for r in similar_vectors(docs).collect()), key=key) == want
    assert similar_vectors(docs.limit(0)).count() == 0


def test_runs_cross_batches():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(k, pa.int64())], names=["k"]) for k in ([1, 1], [1, 2], [], [2], [3])]
    assert [t["k"].to_pylist() for t in runs(iter(batches), "k")] == [[1, 1, 1], [2, 2], [3]]


def test_crowded_minimisers_are_cut_into_single_strings(spark, monkeypatch):
    """Many documents hold one passage between texts of their own; the result is the same wherever the bound lies."""
    rng = random.Random(8)
    words = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage, other = words(300), words(70)
    rows = [(i, words(40) + passage[rng.randrange(20) : 300 - rng.randrange(20)] + words(30) + (other if i % 3 else "")) for i in range(150)] + [(200, passage), (201, passage), (202, other)]
    want = cut(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for crowded, size in ((5, 1000), (10**6, 10**6), (0, 5000)):
        monkeypatch.setattr(repeats, "CROWDED", crowded)
        monkeypatch.setattr(repeats, "PARTITION_BYTES", size)
        assert sorted((tuple(r) for r in deduplicated(docs).collect()), key=key) == want


def test_a_batch_sends_a_shared_passage_once():
    n, passage = 2000, "".join(random.Random(8).choices("abcdefgh ", k=400))
    texts = pa.array([f"{i:09d}{passage}{i:09d}" for i in range(n)])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.zeros(n, np.int32)), texts], names=["id", "tag", "text"])
    held = pa.Table.from_batches(list(repeats._held(50)(iter([batch])))).to_pandas()
    values = [{"value": v, "crowded": False} for v in held[held["low"] < held["high"]]["value"]]
    assert (held[held["low"] < held["high"]]["n"] == 1).sum() >= 3  # all places of such a minimiser have one run
    shared = pa.array([values] * n, pa.list_(pa.struct([("value", pa.int64()), ("crowded", pa.bool_())])))
    sent = pa.Table.from_batches(list(repeats._cut_out(1, 50)(iter([pa.RecordBatch.from_arrays([*batch.columns, shared], names=["id", "tag", "text", "shared"])])))).to_pandas()
    inner = sent["data"].dropna().map(lambda d: d.count(passage.encode()[180:230])).sum()
    assert 1 <= inner <= 3
    assert sent["place"].notna().sum() >= 5 * n


def complement_pairs(letters, sizes=(1024, 4096)):
    """Words that a hash by sums of powers can't tell apart."""
    for a, b in letters:
        bits = [0]
        for n in sizes:
            while len(bits) < n:
                bits += [1 - x for x in bits]
            yield "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_complementary_words_are_different(spark):
    rows = [(i, w) for i, w in enumerate(w for pair in complement_pairs(("ab", "xe")) for w in pair)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i, _ in rows}


def test_unequal_texts_with_one_id(spark):
    """Every id stands for two texts, each of them near to one of another id."""
    rng = random.Random(6)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(100)] for _ in range(80)]
    rows = [(i // 2, " ".join(t)) for i, t in enumerate(texts)] + [(1000 + i, " ".join([*t[:-2], "new", "end"])) for i, t in enumerate(texts)]
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect())
    assert [c for d, _, c, _ in got if d >= 1000] == [i // 2 for i in range(80)]
    assert all(c == d for d, _, c, _ in got if d < 1000)


def test_unequal_vectors_with_one_id(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((40, 32))
    rows = [(i // 2, v.tolist(), 1) for i, v in enumerate(x)] + [(1000 + i, (v + 0.02 * rng.standard_normal(32)).tolist(), 1) for i, v in enumerate(x)] + [(5, x[3].tolist(), 1)]
    got = sorted((tuple(r) for r in similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()), key=key)
    assert got == linked(rows)


def test_a_crowded_cell_tells_counts_and_a_forest(spark):
    """Near vectors that all link: what a cell sends grows with its vectors, not with their pairs."""
    rng = np.random.default_rng(3)
    hot = rng.standard_normal(300)
    rows = [(i, (hot + 0.02 * rng.standard_normal(300)).tolist(), 1) for i in range(400)]
    got = similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=100).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(399, 0)}
    node, low = forest(6, np.array([1, 2, 4]), np.array([2, 3, 5]))
    assert list(zip(node.tolist(), low.tolist(), strict=True)) == [(2, 1), (3, 1), (5, 4)]


def test_batches_for_python_are_limited_in_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["x"])

    docs = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    assert staging.stage(docs.mapInArrow(sizes, "x long"), "sizes").agg(F.max("x")).first()[0] < 2 * staging.BATCH_BYTES


def test_runs_of_a_pass_take_little_memory():
    data = np.random.default_rng(1).integers(97, 123, 2 << 20, np.uint8)
    data[4999::5000] = 10
    offsets = np.append(np.arange(0, len(data), 5000), len(data))
    data[-1] = 10
    tracemalloc.start()
    repeats._runs(data, offsets, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * len(data)


def test_runs_are_those_of_each_place_alone():
    """Also over the edges of the blocks that minimisers are found in."""
    for block in (1, 7, 1 << 16):
        texts = ["", "a" * 200, "b" * 49, "c" * 50, "".join(random.Random(3).choices("ab", k=300)), "x"]
        data = np.frombuffer("".join(t + "\n" for t in texts).encode(), np.uint8)
        offsets = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(repeats, "BLOCK", block)
            text, place, count, value = repeats._runs(data, offsets, 50)
        got = {(t, p + i): v for t, p, c, v in zip(text.tolist(), place.tolist(), count.tolist(), value.tolist(), strict=True) for i in range(c)}
        assert sorted(got) == [(t, p) for t, x in enumerate(texts) for p in range(len(x) - 49)]
        for (t, p), v in got.items():
            one = np.frombuffer((texts[t][p : p + 50] + "\n").encode(), np.uint8)
            assert v == repeats._runs(one, np.array([0, 51]), 50)[3][0]


@pytest.mark.parametrize("letters", [1, 2, 30, 256])
def test_strings_at_some_places(letters):
    rng = np.random.default_rng(letters)
    for n, depth in ((1, 1), (5, 24), (400, 1), (400, 9), (3000, 50)):
        text = rng.integers(0, letters, n).astype(np.uint8)
        text[n // 2 : n // 2 + n // 4] = text[: n // 4]
        places = np.flatnonzero(rng.random(n) < 0.6)
        order, new = sorted_strings(text, places, depth)
        strings = [text.tobytes()[i : i + depth] for i in order]
        assert strings == sorted(text.tobytes()[i : i + depth] for i in places) and sorted(order) == places.tolist()
        assert new.tolist() == [not k or strings[k] != strings[k - 1] for k in range(len(strings))]


def test_a_partition_sorts_each_string_about_once(monkeypatch):
    """Neither places where no string begins nor strings that are equal to the full length take part in more sorting."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefgh ", k=90)).encode() for _ in range(300)]
    data = [t[:84] for t in texts] + [t[6:] for t in texts]
    at = np.arange(len(data))
    frame = pd.DataFrame({"part": 0, "sub": at, "least": at % 300, "most": at % 300 + 300, "data": data})
    taken = []
    for name in ("argsort", "lexsort"):
        plain = getattr(np, name)
        monkeypatch.setattr(np, name, lambda x, *a, plain=plain, name=name, **k: taken.append(len(x) if name == "argsort" else len(x[0])) or plain(x, *a, **k))
    out = repeats._suffixes(50)(frame)
    lows = dict(zip(out["sub"], out["lows"], strict=True))
    assert all(np.frombuffer(lows[i], np.int64).tolist() == [i % 300] * 35 for i in at.tolist())
    assert sum(taken) < 1.3 * 35 * len(data)


def test_each_text_has_its_minimisers_once():
    rng = random.Random(4)
    texts = ["a" * 400, "a" * 90, "", *("".join(rng.choices("ab", k=300)) * 2 for _ in range(30)), "b" * 49, "a" * 50]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), pa.array(np.zeros(len(texts), np.int32)), pa.array(texts)], names=["id", "tag", "text"])
    got = [(r["id"], r["value"]) for b in repeats._having(50)(iter([batch])) for r in b.to_pylist()]
    want = set()
    for i, t in enumerate(texts):
        _, _, _, value = repeats._runs(np.frombuffer((t + "\n").encode(), np.uint8), np.array([0, len(t) + 1]), 50)
        want |= {(i, v) for v in value.view(np.int64).tolist()}
    assert len(got) == len(want) and set(got) == want
