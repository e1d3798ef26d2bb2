"""Language-model scores, languages, toxicity and token counts against plain versions."""

import functools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeledger.llm import language_id, lm_scoring, toxicity
from treeledger.llm import token_counts as token_counts_
from treeledger.llm.lm_scoring import language_model_scores
from treeledger.llm.token_counts import token_counts

SF = "/root/testdata/sf0.01"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EMPTY = "doc_id long, text string, score int, lang string, source string"


def scores(rows, order, least=2):
    docs = [(d, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))) for d, t in rows]
    c = Counter(tuple(ws[i : i + k]) for _, ws in docs for k in range(1, order + 1) for i in range(len(ws) - k + 1))
    total, out, n = sum(v for g, v in c.items() if len(g) == 1), Counter(), Counter()

    def score(g):
        if len(g) == 1:
            return math.log(c[g] / total)
        return math.log(c[g] / c[g[:-1]]) if c[g] >= least else math.log(0.4) + score(g[1:])

    for d, ws in docs:
        n[d] += len(ws)
        out[d] += sum(score(tuple(ws[max(0, i - order + 1) : i + 1])) for i in range(len(ws)))
    return {d: (n[d], out[d]) for d, _ in docs}


@pytest.mark.parametrize(("big", "order", "least"), [(False, 1, 2), (False, 2, 2), (False, 3, 2), (False, 4, 2), (True, 3, 2), (False, 2, 1), (False, 3, 1), (True, 2, 1), (False, 2, 3)])
def test_language_model(spark, big, order, least):
    small = [(1, "a b a B", 0), (1, "a b", 0), (2, None, 0), (None, "c a b d", 0), (4, " ", 0), (5, "x", 0), (6, "a " * 5000, 0), (7, "d a b a b", 0)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text") if big else spark.createDataFrame(small, "doc_id long, text string, n_words int")
    want = scores([(r.doc_id, r.text) for r in docs.collect()], order, least)
    got = language_model_scores(docs, order, least).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.log_score) == (want[r.doc_id][0], pytest.approx(want[r.doc_id][1], rel=1e-9, abs=1e-9))
        assert (r.mean_log_score is None) == (r.n_words == 0)
    assert language_model_scores(docs.limit(0), order, least).count() == 0


@pytest.mark.parametrize("known", [0, 1])
def test_words_that_no_task_holds_meet_their_table(spark, monkeypatch, known):
    monkeypatch.setattr(lm_scoring, "KNOWN", known)
    rows = [(1, "a b a B a a a"), (1, "a b"), (2, None), (3, "c a b d"), (5, "x")]
    want = scores(rows, 2)
    got = language_model_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.log_score == pytest.approx(want[r.doc_id][1], rel=1e-9, abs=1e-9)


def test_words_seen_once_are_counted_in_the_exact_form(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    assert [round(r.log_score, 3) for r in language_model_scores(docs, min_count=1).collect()] == [-1.386, -1.386]


def test_token_counts_are_the_library_s(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(5)
    letters = "aaab'sStT ΣσςİıIéÉ́ñ123٣½\n\t\x85  ​　\x1c漢\U0001f389<|endoftext|>#$%'ll_ﬁǅß"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    # words that a hash by sums of powers can't tell apart
    bits = [0]
    while len(bits) < 4096:
        bits += [1 - b for b in bits]
    texts += ["".join(ab[b ^ flip] for b in bits[:n]) for n in (1024, 4096) for ab in ("er", "in", "xe") for flip in (0, 1)]
    texts += ["", None, "a" * 5000, "<|startoftext|>it's<|endoftext|>DON'T", "\0", "x y " * 40000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = Tokenizer.from_file(path)
    want = {i: len(e.ids) for i, e in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False))}
    got = token_counts(docs.unionAll(docs.limit(5)), path).collect()
    assert len(got) == len(texts) + 5
    for r in got:
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want[r.doc_id], len((texts[r.doc_id] or "").encode()), want[r.doc_id] > 2048)
    assert token_counts(docs.limit(0), path).count() == 0


def test_every_code_point_is_split_as_the_library_does():
    """Versions of Unicode differ in what is a letter, a mark to compose, or a capital."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), token_counts_.BytePairs(path)
    points = [*range(0xD800), *range(0xE000, 0x32000), *range(0x32000, 0xE0000, 97), *range(0xE0000, 0xE0200), *range(0xE0200, 0x110000, 97)]
    rng = random.Random(7)
    texts = [f"a{c}1{c}${c} {c}" for c in map(chr, points)] + ["".join(chr(rng.choice(points)) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    for i in range(0, len(texts), 50_000):
        part = texts[i : i + 50_000]
        want = [len(e.ids) for e in library.encode_batch(part, add_special_tokens=False)]
        got = own.counts(part)
        assert [(t, g, w) for t, g, w in zip(part, got, want, strict=True) if g != w] == []


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    odd = spark.createDataFrame([(-1, None), (-2, "12 %% ☃"), (-3, ""), (None, "the and of thing")], "doc_id long, text string")
    out = {r.doc_id: r for r in language_id.languages(docs.unionByName(odd, allowMissingColumns=True)).collect()}
    assert len(out) == len(truth) + 4
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(out[d].held_out == (d in set(held)) for d in truth)
    assert sum(out[d].lang_pred == truth[d] for d in held) / len(held) > 0.98
    assert [(out[d].lang_pred, out[d].score) for d in (-1, -2, -3)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in out.values())
    untaught = language_id.languages(odd.selectExpr("*", "cast(null as string) lang")).collect()
    assert {r.lang_pred for r in untaught} == {"und"}
    assert language_id.languages(docs.limit(0)).count() == 0


def test_switched_texts_are_labelled_by_word(spark):
    """Half of one language and half of another: the spans part them near the place where they meet."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and length(text) between 400 and 4000")
    own = {}
    for r in docs.orderBy("doc_id").collect():
        if zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
            own.setdefault(r.lang, []).append(re.sub(r"\s+", " ", r.text))
    pairs = [(a, b, x[:400], y[:400]) for a in own for b in own if a != b for x, y in zip(own[a][:6], own[b][:6], strict=False)]
    mixed = spark.createDataFrame([(10**6 + i, f"{x} {y}") for i, (_, _, x, y) in enumerate(pairs)], "doc_id long, text string")
    out = {r.doc_id - 10**6: r for r in language_id.languages(docs.unionByName(mixed, allowMissingColumns=True)).where("doc_id >= 1000000").collect()}
    right = total = 0
    for i, (a, b, x, y) in enumerate(pairs):
        for s in out[i].spans:
            total += s.end - s.start
            right += (min(s.end, len(x)) - min(s.start, len(x))) * (s.lang == a) + (max(s.end, len(x)) - max(s.start, len(x))) * (s.lang == b)
            assert 0 <= s.start < s.end <= len(x) + 1 + len(y)
    assert right / total > 0.95
    assert sum(r.n_switches >= 1 for r in out.values()) / len(out) > 0.9


def test_runs_of_letters_without_spaces_are_read_whole():
    points, starts, ends, count = language_id._words(["x" * 100, "\u0130b"])
    assert (ends - starts).tolist() == [14] * 7 + [2, 2]
    assert count.tolist() == [8, 1]


def test_segments_give_the_posteriors_of_whole_texts():
    rng = np.random.default_rng(3)
    emission, step, start = rng.normal(size=(900, 3)), np.exp(rng.normal(size=(3, 3))), np.exp(rng.normal(size=3))
    length = np.array([1, 128, 129, 600, 42])
    got = language_id._posteriors(emission, length, step, start)
    at = 0
    for n in length:
        e = np.exp(emission[at : at + n])
        a, b = np.zeros((n, 3)), np.ones((n, 3))
        for t in range(n):
            a[t] = (start if not t else a[t - 1] @ step) * e[t]
            a[t] /= a[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = step @ (e[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        want = a * b
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def plain_toxicity(model, text):
    """Noisy-or over sentences, feature by feature."""
    weights = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))

    @functools.cache
    def key(kind, word):
        data = np.frombuffer(word, np.uint8)
        h = toxicity.word_hashes(data, np.array([0]), np.array([len(data)]))[0]
        return int(h) ^ (kind * 0x1F3D5B792E4C6A88 % (1 << 64))

    clean = 1.0
    for sentence in re.split(rb"[\n!.?]", (text or "").encode()):
        words = re.findall(rb"[A-Za-z\x80-\xff]+", sentence)
        z = model.bias
        for w in words:
            z += weights.get(key(0, w), 0)
            for kind, size in enumerate((toxicity.TAIL, *toxicity.HEADS), 1):
                if len(w) > size:
                    z += weights.get(key(kind, w[-size:] if kind == 1 else w[:size]), 0)
        if words:
            clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_toxicity_is_the_noisy_or_of_sentences(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(-1, None, "x"), (-2, "", "x"), (-3, " .!\n", "x"), (-4, "trash. idiot " * 20000, "x"), (-5, "It is no trash", "x")], "doc_id long, text string, score string")
    both = docs.select("doc_id", "text").withColumn("score", F.lit("x")).unionAll(odd)
    model = toxicity.learned(both, labels)
    got = {r.doc_id: r for r in toxicity.toxicity(both, labels).collect()}
    texts = {r.doc_id: r.text for r in both.where("doc_id < 120").collect()}
    for d, t in texts.items():
        assert got[d].score == pytest.approx(plain_toxicity(model, t), abs=1e-9)
    assert [got[d].score for d in (-1, -2, -3)] == [0, 0, 0]
    assert got[-4].score > 0.99 and got[-4].n_offending == len(got[-4].offending)
    kept = toxicity.without_toxic(both, labels)
    assert kept.columns == both.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if not r.predicted}


def test_long_sentences_are_read_by_pieces_and_stay_whole():
    """Texts of more than a pass, with sentences longer than one, score as the plain version has them."""
    words = ["it", "is", "trash", "what", "idiot", "says", "ordinary"]
    hashed = np.sort(np.array([toxicity.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0] for w in words]))
    model = toxicity.Model(hashed, np.random.default_rng(2).normal(0, 1e-4, len(hashed)), -2.0)
    long = "it is ordinary what " * 130_000
    texts = [long + ". trash idiot says. " + long[:50] + "!" + "it says trash " * 10, "x. " + long + "\n" + long + "?", "idiot " * 500_000, "." * 2_200_000 + long, "says " * 9, "x" * 2_500_000, "", "trash. " + "x" * 3_000_000]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = [r for b in toxicity._score(model, None)([rows]) for r in b.to_pylist()]
    for r, t in zip(got, texts, strict=True):
        assert r["score"] == pytest.approx(plain_toxicity(model, t), rel=1e-6)
    spans = [(m.start(), m.end()) for m in re.finditer(r"[^\n!.?]+", texts[0]) if m[0].strip()]
    assert (got[0]["worst_start"], got[0]["worst_end"]) in [(a + (len(texts[0][a:b]) - len(texts[0][a:b].lstrip())), len(texts[0][:b].rstrip())) for a, b in spans]


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(out) == docs.count()
    held = [d for d in truth if out[d].held_out]
    assert all(out[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in out)
    caught = [out[d].predicted for d in held if truth[d]]
    wrong = [out[d].predicted for d in held if not truth[d]]
    # some labels are set although no sentence is toxic, and of the rarer languages most words are unseen
    assert sum(caught) / len(caught) >= 0.85
    assert sum(wrong) / len(wrong) < 0.01


def test_toxicity_of_rare_languages_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity(docs, labels).where("held_out").join(labels.where("toxic = 1").select("doc_id"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.predicted for r in out) / len(out) > 0.85
    rare = [r.predicted for r in out if r.lang != "en"]
    assert sum(rare) / len(rare) > 0.75


def test_toxicity_finds_the_sentence_and_keeps_clean_rows(spark):
    rows = [(i, f"All is well here {i}. " * 3 + ("You vilest wretch! " if i % 2 else "Good day! ") + "The end.", "x") for i in range(200)]
    docs = spark.createDataFrame(rows + [(900, None, "x"), (901, "", "x"), (901, "", "x"), (None, "vilest", "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(200)] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, text int")
    out = [r for r in toxicity.toxicity(docs, labels).collect()]
    for r in out:
        if r.doc_id is not None and r.doc_id < 200:
            text = rows[r.doc_id][1]
            assert r.predicted == r.doc_id % 2
            if r.predicted:
                assert text[r.worst_start : r.worst_end] == "You vilest wretch"
    assert [r.score for r in out if r.doc_id in (900, 901)] == [0.0] * 3
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {0, 2, 900, 901}
    assert not {r.doc_id for r in kept.collect()} & {1, 3}
    assert toxicity.toxicity(docs, labels.limit(0)).agg({"score": "max"}).first()[0] == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_finds_every_offending_sentence(spark):
    rows = [(i, f"All is fine {i}. " * 3 + ("Hé, you vilest wretch! Good day. Vilest wretch there? " if i % 2 else "Good day! ") + "The end.") for i in range(200)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    for r in toxicity.toxicity(docs, labels).collect():
        text = rows[r.doc_id][1].encode() if r.doc_id < 200 else b""
        assert [text[s.start : s.end].decode() for s in r.offending] == (["Hé, you vilest wretch", "Vilest wretch there"] if r.doc_id % 2 and r.doc_id < 200 else [])
        assert r.n_offending == len(r.offending)
        assert all(s.score >= 0.5 for s in r.offending)
        if r.offending:
            assert (r.worst_start, r.worst_end) in [(s.start, s.end) for s in r.offending if s.score == max(o.score for o in r.offending)]
    assert all(r.offending == [] for r in toxicity.toxicity(docs, labels.limit(0)).collect())
