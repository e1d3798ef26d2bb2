"""Mixing, packing and the pipeline."""

import hashlib
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dedup import cut, near

import corpus_pipeline
from treeledger.llm import toxicity
from treeledger.llm.mixing import mixed, take, targets
from treeledger.llm.packing import boundaries, packed

SF = "/root/testdata/sf0.01"


def shares(sizes, most=3):
    """Excess over `most` times a source's size is shared again by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = float(sum(sizes.values())), {}
    while True:
        open_ = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: float(most * sizes[s]) for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 100, None: 1000}, {"a": 1, "b": 1, "c": 1000, "d": 2}, {"x": 5}, {"a": 0, "b": 7}, {"\U0001f600": 9, "￿": 9, "z": 1}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(shares(sizes))


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = mixed(docs).join(docs.select("doc_id", "source"), "doc_id")
    rows = out.collect()
    assert len(rows) == docs.count()
    taken, target = {}, {}
    for r in rows:
        assert r.taken % r.size == 0 and r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    sizes = {r.source: r.source_size for r in rows}
    assert target == pytest.approx(shares(sizes))
    assert all(abs(taken[s] - target[s]) < 0.01 * target[s] for s in taken)
    again = mixed(docs.repartition(7)).select("doc_id", "taken").collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in rows}


def test_marginals_hold_over_many_documents(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(id % 5 + 1 as int))").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    rows = mixed(docs, block=16).collect()
    for source_size, target in {(r.source_size, r.target) for r in rows}:
        for size in range(1, 6):
            own = [r.copies for r in rows if (r.source_size, r.size) == (source_size, size)]
            assert np.mean(own) == pytest.approx(target / source_size, abs=0.06)


def test_mix_of_odd_rows(spark):
    rows = [(1, None, "a", 1), (2, "", None, 1), (3, "x y", None, 1), (3, "x y", None, 1), (None, "p", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = mixed(docs).collect()
    assert len(out) == 5
    assert sorted(r.size for r in out) == [0, 0, 1, 2, 2]
    assert all(r.taken <= 3 * r.size for r in out)
    assert take(docs).columns == docs.columns
    assert mixed(docs.limit(0)).count() == take(docs.limit(0)).count() == 0


def padding(counts, ends):
    lengths = np.arange(len(counts))
    return int(sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts, strict=True) if c))


@pytest.mark.parametrize("seed", range(4))
def test_boundaries_are_the_best(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 9, 11) * rng.integers(0, 2, 11)
    counts[rng.integers(11)] = 3
    lengths = np.flatnonzero(counts).tolist()
    for k in (1, 2, 3):
        ends = boundaries(counts, k)
        tried = [padding(counts, [*c, lengths[-1]]) for n in range(k) for c in combinations(lengths[:-1], n)]
        assert padding(counts, ends) == min(tried)


def test_packing_holds_each_piece_once(spark):
    docs = spark.createDataFrame([(1, "w " * 5000, 0), (2, None, 0), (2, "", 0), (3, "a b", 0), (3, "a b", 0), (None, "x", 0)], "doc_id long, text string, batch_id int")
    docs = docs.unionAll(spark.range(10, 500).selectExpr("id", "repeat('v ', cast(id % 90 as int))", "0"))
    rows = packed(docs, longest=2048, buckets=4, budget=4096, shard=100).collect()
    pieces = sorted((r.piece, r.start_word, r.n_words) for r in rows if r.doc_id == 1)
    assert pieces == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]
    assert len(rows) == 3 + 5 + 490
    batches = {}
    for r in rows:
        assert r.n_words <= r.bucket_len
        batches.setdefault(r.batch_id, []).append(r)
    for own in batches.values():
        assert len({r.bucket_len for r in own}) == 1
        assert len(own) * own[0].bucket_len <= 4096
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert packed(docs.limit(0)).count() == 0


def test_lengths_may_be_a_column(spark):
    docs = spark.createDataFrame([(1, "a b c", 5000), (2, "a", None), (3, "a", 7)], "doc_id long, text string, n_tokens long")
    rows = packed(docs, longest=2048, buckets=2, budget=4096, length=F.col("n_tokens")).collect()
    assert sorted((r.doc_id, r.piece, r.start_word, r.n_words) for r in rows) == [(1, 0, 0, 2048), (1, 1, 2048, 2048), (1, 2, 4096, 904), (2, 0, 0, 0), (3, 0, 0, 7)]


def test_pipeline_against_plain_versions(spark):
    """Documents with nulls, empty and long texts, copies, a shared passage and more columns, one of them named like an
    operator's own. Each stage's rows are those of a plain version over what the stage before kept."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    base = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 150").withColumn("kept", F.lit("x"))
    row = base.orderBy("doc_id").first().asDict()
    odd = [row | {"doc_id": 10**6 + i, "text": t, "source": s} for i, (t, s) in enumerate([(None, "src1"), ("", None), ("word " * 9000, "src1"), (row["text"], "src2"), (f"{row['text']} more", "src2"), ("a b", None)])]
    docs = base.unionByName(spark.createDataFrame(odd, base.schema))

    scored = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    docs = corpus_pipeline.drop_toxic(spark, docs, SF).checkpoint()
    assert sorted(r.doc_id for r in docs.collect()) == sorted(d for d, s in scored.items() if s < 0.7)

    want = near([(r.doc_id, r.text) for r in docs.collect()], 4)
    docs = corpus_pipeline.drop_near_duplicates(spark, docs, SF).checkpoint()
    assert sorted(r.doc_id for r in docs.collect()) == [d for d, _, _, kept in want if kept]

    want = {d: (n - gone, sha) for d, n, gone, _, sha in cut([(r.doc_id, r.text) for r in docs.collect()])}
    docs = corpus_pipeline.cut_repeats(spark, docs, SF).checkpoint()
    got = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert got.keys() == want.keys()
    for d, text in got.items():
        # only a character that was cut in two may be missing besides
        assert want[d][0] - 6 <= len(text) <= want[d][0]
        assert len(text) < want[d][0] or hashlib.sha256(text).hexdigest() == want[d][1]

    rows = {r.doc_id: r for r in mixed(docs).collect()}
    taken = Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, SF).select("doc_id").collect())
    assert {d: taken[d] for d in rows} == {d: r.copies for d, r in rows.items()}
    docs = corpus_pipeline.mix_sources(spark, docs, SF).checkpoint()
    sizes = {d: len(re.findall(rb"[^\x20\x09-\x0D]+", t)) for d, t in got.items()}
    assert {d: r.size for d, r in rows.items()} == sizes

    out = corpus_pipeline.pack(spark, docs, SF).collect()
    pieces = Counter((r.doc_id, r.start_word, r.n_words) for r in out)
    assert pieces == Counter((d, 2048 * k, min(2048, sizes[d] - 2048 * k)) for d in sizes for k in range(max(1, -(-sizes[d] // 2048))) for _ in range(taken[d]))
    counts = np.bincount([r.n_words for r in out], minlength=2049)
    assert sum(r.bucket_len - r.n_words for r in out) == padding(counts, boundaries(counts, 8))
    batches = {}
    for r in out:
        batches.setdefault(r.batch_id, []).append(r)
    assert all(len(own) * own[0].bucket_len <= 32_768 for own in batches.values())


def test_an_empty_table_passes_the_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
    assert docs.count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "repeats", "mixing", "packing"]
    sizes = [docs.count()]
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, SF)
        if i < 4:
            assert out.dtypes == docs.dtypes
            docs = out.checkpoint()
        sizes.append(out.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3]
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert corpus_pipeline.run(spark, SF).count() == sizes[-1]
