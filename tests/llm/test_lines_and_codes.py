"""Shared lines, vector codes and whitening against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeledger.llm.cuckoo import Cuckoo
from treeledger.llm.line_dedup import added, opened, removed, shared_keys, without_shared_lines
from treeledger.llm.queries import QUERIES
from treeledger.llm.vector_codes import coded, nearest
from treeledger.llm.whitening import leading, whitened

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = (1 << 63) - 1


def test_cuckoo_holds_copies():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**62), 2**62, 40_000)
    held = Cuckoo.sized(60_000)
    held.insert(keys)
    held.insert(keys[:20_000])
    assert held.copies == 60_000
    assert (held.count(keys[:20_000]) >= 2).all() and (held.count(keys[20_000:]) >= 1).all()
    other = rng.integers(-(2**62), 2**62, 100_000)
    assert (held.count(other) > 0).mean() < 0.001
    held.delete(keys[:20_000])
    held.delete(keys)
    assert held.copies == 0 and not held.count(keys).any()


def test_cuckoo_beyond_its_room():
    """What finds no room is stashed, found and taken out again."""
    keys = np.arange(400)
    held = Cuckoo.sized(100)
    held.insert(np.concatenate((keys, np.zeros(30, np.int64))))
    assert held.copies == 430 and len(held.stash) and (held.count(keys) >= 1).all() and held.count(np.zeros(1, np.int64))[0] >= 31
    again = Cuckoo.read(*held.written())
    again.delete(np.concatenate((keys, np.zeros(30, np.int64))))
    assert again.copies == 0


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(FOLD)


def lines_by_hand(rows, known=None):
    least, most = {}, {}
    for d, t in known or rows:
        d = LAST if d is None else d
        for k in {key(x) for x in (t or "").split("\n")}:
            least[k], most[k] = min(least.get(k, d), d), max(most.get(k, d), d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or least[key(x)] == most[key(x)] or least[key(x)] == (LAST if d is None else d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def told(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=repr)


ODD = [
    (1, "Same line here\nshort\n\n  same LINE here \nown line of one"),
    (2, "\tsame line HERE\r\nshort\nÄ same line here"),
    (3, None),
    (4, ""),
    (5, "Same line here"),
    (2, "\tsame line HERE\r\nshort\nÄ same line here"),
    (2, "another text of two, same line here\nsame line here"),
    (None, "same line here\na line that null ids hold"),
    (None, "a line that null ids hold\n"),
    (7, "ääääääääää\n same line here\nnine char"),
    (8, "ääääääääää\n same line here\nnine char"),
    (9, "own own own own\nown own own own"),
]


def test_shared_lines_of_odd_documents(spark):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in ODD], "doc_id long, text string, places string, d int")
    assert told(without_shared_lines(docs)) == lines_by_hand(ODD)
    assert told(without_shared_lines(docs.where("doc_id < 0"))) == []


def test_shared_lines_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert told(without_shared_lines(docs)) == lines_by_hand(rows)
    got = {r.doc_id: r for r in QUERIES["op11_lines"](spark, SF).collect()}
    assert all(got[d].kept_sha256 == hashlib.sha256(t.encode()).hexdigest() for d, _, _, t in lines_by_hand(rows)) and len(got) == len(rows)


def state(store):
    counts = sorted(tuple(r) for r in store.counts.collect())
    copies = Counter(min(r[2], 2) for r in counts)
    held = [Cuckoo.read(r.table, r.stash) for r in store.filters.collect()]
    assert sum(h.copies for h in held) == copies[1] + 2 * copies[2]
    return counts, sorted(tuple(r) for r in store.lines.collect()), sorted(tuple(r) for r in shared_keys(store).collect())


def test_store_is_reversible(spark):
    rng = random.Random(3)
    text = lambda: "\n".join(f"line number {rng.randrange(300)}" for _ in range(rng.randrange(20)))
    rows = [(i, text()) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first, second = docs.where("doc_id % 3 > 0"), docs.where("doc_id % 3 = 0")
    base = opened(first, shard_keys=40)
    assert base.shards > 3
    both = added(base, second)
    assert told(without_shared_lines(docs, both)) == lines_by_hand(rows)
    assert state(both) == state(opened(docs, shard_keys=40))
    assert told(without_shared_lines(second, both)) == lines_by_hand([r for r in rows if r[0] % 3 == 0], rows)
    assert state(removed(both, second)) == state(base)
    empty = removed(removed(both, second), first.select("doc_id"))
    assert state(empty) == ([], [], [])
    assert told(without_shared_lines(docs, added(empty, docs))) == lines_by_hand(rows)


def test_store_outgrows_its_filters(spark):
    """Filters that would be crowded are built anew from the counts."""
    docs = spark.range(40).selectExpr("id AS doc_id", "concat_ws('\n', transform(sequence(1, 50), i -> concat('a line of ', id, ' and ', i)), 'one for all of them') AS text")
    base = opened(docs.where("doc_id < 2"), shard_keys=50)
    both = added(base, docs.where("doc_id >= 2"))
    assert state(both)[0] == state(opened(docs))[0]
    assert told(without_shared_lines(docs, both)) == lines_by_hand([(r.doc_id, r.text) for r in docs.collect()])


def test_a_long_text_of_lines(spark):
    """12 MB, half of whose lines another document holds."""
    many = "\n".join(f"line {i} of a text" for i in range(300_000))
    long = many + "\n" + many.replace("line", "row")
    rows = [(1, many), (2, long), (3, "line 77 of a text")]
    got = told(without_shared_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == lines_by_hand(rows) and len(long) > 12_000_000


def test_hot_line_is_one_row_a_task(spark):
    """Counts are combined before the shuffle."""
    docs = spark.range(0, 20_000, 1, 8).selectExpr("id AS doc_id", "'the line of all documents' AS text")
    store = opened(docs)
    assert [(r.refs, r.least, r.most) for r in store.counts.collect()] == [(20_000, 0, 19_999)]
    plan = store.lines.groupBy("h", "g").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
    assert without_shared_lines(docs, store).where("n_dropped = 1 and text = ''").count() == 19_999


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def usable(rows):
    fine = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    sizes = Counter(len(r[1]) for r in fine)
    length = max(sizes, key=lambda n: (sizes[n], n)) if sizes else 0
    return [r for r in fine if len(r[1]) == length], length


def codes_by_hand(rows, parts=8, entries=16, rounds=6):
    rows, length = usable(rows)
    x = [[math.floor(4096 * c) for c in r[1]] for r in rows]
    cuts = [length * i // parts for i in range(parts + 1)]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i]))[:entries]
    books = [[x[i][a:z] for i in first] for a, z in zip(cuts, cuts[1:], strict=False)]

    def assign(v, p):
        mine = v[cuts[p] : cuts[p + 1]]
        return min((sum((a - b) ** 2 for a, b in zip(mine, e, strict=True)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            mine = defaultdict(list)
            for v in x:
                mine[assign(v, p)[1]].append(v[cuts[p] : cuts[p + 1]])
            new.append([[sum(c) // len(mine[j]) for c in zip(*mine[j], strict=True)] if mine[j] else e for j, e in enumerate(books[p])])
        books = new
    found = [[assign(v, p) for p in range(parts)] for v in x]
    error = [sum(d for d, _ in f) for f in found]
    by = defaultdict(int)
    for r, e in zip(rows, error, strict=True):
        by[r[2]] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    fit = lambda n: n if n < 1 << 63 else None
    return sorted(((r[0], "".join(f"{j:02x}" for _, j in f), fit(e), fit(by[r[2]]), digest) for r, f, e in zip(rows, found, error, strict=True)), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_codes_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    assert rows_of(QUERIES["op12_codes"](spark, SF)) == codes_by_hand(rows)


def odd_vectors(width=19):
    rng = random.Random(4)
    rows = [(i // 2 if i < 40 else i, [rng.gauss(0, 3) for _ in range(width)], rng.choice([1, 2, None])) for i in range(90)]
    rows += [(200 + i, [1.0] * width, 1) for i in range(12)] + [(None, [0.0] * width, None), (None, [2.0] * width, 3)]
    return rows + [(300, None, 1), (301, [float("nan")] * width, 1), (302, [None] * width, 1), (303, [1.0] * 3, 1), (304, [float("inf")] + [0.0] * (width - 1), 2), (305, [], 2)]


def test_codes_of_odd_vectors(spark):
    rows = odd_vectors()
    assert rows_of(coded(vectors(spark, rows))[0]) == codes_by_hand(rows)
    for few in (rows[:3], rows[-3:], [(1, [1.5, -2.5], 1)], [(1, [1e12, 1.0], 1), (2, [-1e12, 3.0], 1), (3, [1.0, 1.0], 2)]):
        assert rows_of(coded(vectors(spark, few))[0]) == codes_by_hand(few)
    assert rows_of(coded(vectors(spark, []))[0]) == []


@pytest.mark.parametrize("entries", [1, 2, 16, 200])
def test_the_annulus_loses_no_entry(entries):
    rng = np.random.default_rng(entries)
    book = rng.integers(-6, 6, (entries, 3))
    points = rng.integers(-8, 8, (3000, 3))
    every = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    index, distance = nearest(points, book)
    assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    index, distance = nearest(points[:50].astype(object) * 10**12, book.astype(object) * 10**12)
    assert (index == every[:50].argmin(axis=1)).all() and list(distance) == [int(d) * 10**24 for d in every[:50].min(axis=1)]


def check_whitened(df, rows, components=32, tight=1e-7):
    rows, length = usable(rows)
    x = [[math.floor(64 * c) + 1_000_000 for c in r[1]] for r in rows]
    n, k = len(x), min(components, length)
    sums = [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[float((n * a - s) / n) for a, s in zip(v, sums, strict=True)] for v in x])
    cov = centred.T @ centred / n
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    live = int((value > 1e-12 * value[0]).sum()) if value[0] > 0 else 0
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert len(got) == n * k
    want = []
    for r, v, c in zip(rows, x, centred, strict=True):
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        for j in range(k):
            want.append((r[0], j + 1, n, deviation if deviation < 1 << 63 else None, abs(float(c @ vector[:, j]) / math.sqrt(value[j])) if j < live else None, float(value[j] / np.trace(cov)) if j < live else 0.0))
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[3] or 0, round(abs(r[4] or 0), 4))
    got, want = sorted(got, key=order), sorted(want, key=order)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and (g[4] is None) == (w[4] is None)
        assert w[4] is None or abs(abs(g[4]) - w[4]) < tight * max(1, w[4])
        assert abs(g[5] - w[5]) <= 1e-9 * max(w[5], 1e-9)
        assert g[6] is None if not live else g[6] < 1e-8
    return got


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitened(QUERIES["op13_whitening"](spark, SF), rows)


def test_whitening_of_odd_vectors(spark):
    rows = odd_vectors(7)
    check_whitened(whitened(vectors(spark, rows)), rows)
    few = [(1, [1.0, 2.0, 3.0], 1), (2, [2.0, 0.0, 1.0], 1), (2, [2.0, 0.0, 1.0], 1)]
    check_whitened(whitened(vectors(spark, few)), few)
    wide = [(i, [1e12 * i, 1.0 * (i % 3), -1e12 * (i % 5)], 1) for i in range(20)]
    check_whitened(whitened(vectors(spark, wide)), wide, tight=1e-3)
    one = whitened(vectors(spark, [(1, [1.0, 2.0], 1)])).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, None), (2, 0, None, 0.0, None)]
    assert whitened(vectors(spark, [])).collect() == [] and whitened(vectors(spark, [(1, [], 1)])).collect() == []


@pytest.mark.parametrize("limit", [512, 12])
def test_block_lanczos(limit):
    """Multiple and vanishing eigenvalues, a block that breaks down, bases that are contracted."""
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    for value in (np.r_[9.0, 9, 9, 9, 9, 4, 4, 1, np.zeros(52)], 0.8 ** np.arange(60), np.r_[np.ones(60)], np.zeros(60), np.r_[5.0, np.zeros(59)]):
        a = (q * value) @ q.T
        got, vectors_ = leading(lambda v, a=a: a @ v, 60, 4, limit)
        assert np.allclose(got, np.sort(value)[::-1][:4], atol=1e-12)
        assert np.allclose(vectors_.T @ vectors_, np.eye(4), atol=1e-13) and np.allclose(a @ vectors_, vectors_ * got, atol=1e-11)
