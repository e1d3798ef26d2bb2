import hashlib
import random

import pytest
from pyspark.sql import functions as F

from treeledger.operators import assertions, manifest, plan, repair, reports, scan, selection, sync, trees
from treeledger.operators import links as links_
from treeledger.operators.links import ends, ways
from treeledger.plans import QUERIES

FILE = "field string, manifest_pos int, pos int, file string, is_folder boolean, size long, md5 string, chunks array<struct<id:string,uncompressed_md5:string,offset:long,compressed_size:long,uncompressed_size:long>>"


def build(spark, **files):
    """A letter is a chunk of 64 bytes."""
    rows = []
    for pos, (name, letters) in enumerate(files.items()):
        chunks = [(f"id-{c}", f"md5-{c}", 64 * i, 60, 64) for i, c in enumerate(letters)]
        rows.append(("game", 0, pos, name, False, 64 * len(letters), f"md5-{letters}", chunks))
    return spark.createDataFrame(rows, FILE)


def scored(spark, old, new):
    a, b = build(spark, **old), build(spark, **new)
    return {r.file: r for r in manifest.scored(a, b, manifest.flatten(a), manifest.flatten(b)).collect()}


def test_classes(spark):
    got = scored(spark, {"same": "AB", "none": "AB", "kept": "AB", "moved": "PQR", "gone": "X", "one": "A"}, {"same": "AB", "none": "CD", "kept": "AC", "moved": "RPT", "new": "Y", "one": "B"})
    assert {f: r["class"] for f, r in got.items()} == {"same": "identical", "none": "no_reuse", "kept": "reuse_in_place", "moved": "reuse_moved", "gone": "removed", "new": "added", "one": None}
    assert (got["moved"].reused, got["moved"].moved, got["moved"].moved_later, got["moved"].moved_earlier, got["moved"].patch_bytes) == (2, 2, 1, 1, 60)


def test_first_source_is_by_list_order(spark):
    old = spark.createDataFrame([("f", 0, 0, 0, "x", "m", 500, 8, 8), ("f", 0, 0, 1, "x", "m", 0, 8, 8)], "field string, manifest_pos int, pos int, cpos int, file string, uncompressed_md5 string, offset long, compressed_size long, uncompressed_size long")
    assert manifest.first_sources(old).first().source == 500


@pytest.mark.parametrize(("old", "new", "ascending", "kept"), [("AB", "BC", True, 1), ("AB", "CA", False, 1), ("AB", "BA", True, 1)])
def test_salvage_order(spark, old, new, ascending, kept):
    a, b = manifest.flatten(build(spark, f=old)), manifest.flatten(build(spark, f=new))
    row = repair.salvage_order(manifest.chunk_reuse(b, a).withColumn("usable_len", F.lit(128))).first()
    assert row.ascending is ascending
    assert max(row.kept_ascending, row.kept_descending) == kept


def test_structure(spark):
    files = build(spark, a="AB").unionAll(build(spark, a="C")).withColumn("size", F.lit(64))
    row = manifest.structure_counts(files).first()
    assert (row.duplicates, row.wrong_size, row.max_chunk) == (1, 1, 64)


def test_tiling_overlap_names_the_farthest(spark):
    rows = spark.createDataFrame([("f", 0, 100), ("f", 10, 5), ("f", 50, 10), ("f", 120, 5)], "k string, offset long, length long")
    got = {r.offset: (r.gap, r.prev_offset) for r in manifest.tiling(rows, "k").collect()}
    assert got == {0: (0, None), 10: (0, 0), 50: (0, 0), 120: (20, None)}


def test_plan_takes_the_first_of_a_fold_and_refuses_bad_paths(spark):
    files = build(spark, **{"A/x": "A", "a/X": "B", "./b": "C"})
    assert [r.rel for r in repair.plan_files(files).collect()] == ["A/x", "b"]
    with pytest.raises(Exception, match="bad path"):
        repair.plan_files(build(spark, **{"../x": "A"})).collect()


def test_limits_are_strict(spark):
    row = spark.createDataFrame([(5, 6)], "files long, bytes long")
    assert [r.what for r in repair.limit_hits(row, {"files": 5, "bytes": 5}).collect()] == ["bytes"]


def test_audio_manifests_come_by_the_second_step(spark):
    names = ["game", "zh-cn", "en-us", "long-fields"]
    files = spark.createDataFrame([(n,) for n in names], "field string")
    got = sorted(r.field for r in manifest.select_manifests(files, [], ["en-us", "game"]).collect())
    assert got == ["en-us", "game", "game", "long-fields"]


SIDE = "rel string, kind string, size long, mtime_ns long, hashes map<string,binary>"


@pytest.mark.parametrize(
    ("a", "b", "trust", "algos", "tag"),
    [
        ((1, 1, {}), (2, 1, {}), (True, True), [], "stat-size"), ((1, 1, {}), (1, 2, {}), (True, True), [], "stat-mtime"), ((1, 1, {}), (2, 2, {}), (True, True), ["md5"], "stat-size+stat-mtime"),
        ((1, 1, {"md5": b"a"}), (1, 1, {"md5": b"b"}), (True, True), ["md5"], "digest-differs:md5"), ((1, 1, {"md5": b"a", "sha256": b"a"}), (1, 1, {"md5": b"b", "sha256": b"b"}), (True, True), ["md5", "sha256"], "digest-differs:md5+sha256"),
        ((1, 1, {"md5": b"a"}), (1, 1, {"md5": b"a"}), (True, True), ["md5"], "digest-matches:md5"), ((1, 1, {}), (1, 1, {}), (True, True), [], "stat-match"),
        ((1, 1, {}), (2, 1, {}), (False, True), [], "unverifiable:size"), ((1, 1, {}), (2, 2, {}), (False, False), [], "unverifiable:size+mtime"), ((1, 1, {"md5": b"a"}), (1, 2, {"md5": b"a"}), (True, False), ["md5"], "digest-matches:md5"),
    ],
)
def test_verdicts(spark, a, b, trust, algos, tag):
    src, dst = (spark.createDataFrame([("x", "file", *v)], SIDE) for v in (a, b))
    assert trees.tree_diff(src, dst, trees.Trust(*trust), algos).first().tag == tag


def test_case_mismatch_is_out_of_step_with_total_0(spark):
    src, dst = (spark.createDataFrame([(r, "file", 1, 1, {})], SIDE) for r in ("Ax", "aX"))
    row = trees.diff_summary(trees.tree_diff(src, dst, fold=True)).first()
    assert (row.total, row.case_mismatch, row.in_step) == (0, 1, False)


def test_a_pair_in_two_spellings_is_told_twice(spark):
    src = spark.createDataFrame([("A", "file", 1, 1, {}), ("B", "file", 1, 1, {}), ("c", "file", 1, 1, {})], SIDE)
    dst = spark.createDataFrame([("a", "file", 1, 1, {}), ("b", "file", 2, 1, {}), ("c", "file", 1, 1, {})], SIDE)
    diff = trees.tree_diff(src, dst, fold=True)
    row = trees.diff_summary(diff).first()
    assert (row.identical, row.changed, row.case_mismatch, row.total) == (2, 1, 2, 1)
    told = [(r.label, r.rel, r.tag) for r in reports.verdict_stream(diff).collect()]
    assert told == [("CHANGED", "B", "stat-size"), ("CASE-MISMATCH", "A", "a"), ("CASE-MISMATCH", "B", "b"), ("SUMMARY", None, "missing=0 extra=0 changed=1 type_conflict=0 case_mismatch=2 identical=2 total=1")]


def test_cache_is_taken_over_when_one_spelling_is_stale(spark):
    live = spark.createDataFrame([("A", "file", 1, 1), ("b", "file", 2, 2)], "rel string, kind string, size long, mtime_ns long")
    cache = spark.createDataFrame([("a", "file", 1, 1, {"md5": b"x"}), ("B", "file", 2, 2, {}), ("B ", "file", 2, 2, {})], SIDE)
    got = {r.rel: r.fresh for r in trees.with_cache(live, cache, fold=True).collect()}
    assert got == {"A": True, "b": True}
    assert {r.rel: r.fresh for r in trees.with_cache(live, cache).collect()} == {"A": False, "b": False}


def test_sync_actions(spark):
    rows = lambda *xs: spark.createDataFrame([(r, k, s, 1, {}) for r, k, s in xs], SIDE)
    src, dst = rows(("d", "dir", 0), ("n", "file", 1), ("c", "file", 1)), rows(("c", "file", 2), ("x", "file", 1), ("x/yy", "file", 1))
    got = [(r.stage, r.rel, r.because) for r in sync.sync_plan(trees.tree_diff(src, dst)).collect()]
    assert got == [("MKDIR", "d", None), ("DELETE", "x", None), ("DELETE", "x/yy", None), ("COPY", "c", "changed"), ("COPY", "n", "missing")]
    least = sync.sync_plan(trees.tree_diff(src, dst), missing_only=True, keep_extra=True)
    assert {(r.stage, r.rel) for r in least.collect()} == {("MKDIR", "d"), ("COPY", "n")}


def test_folders_links_and_conflicts_of_a_plan(spark):
    rows = lambda *xs: spark.createDataFrame([(r, k, 1, 1, {}) for r, k in xs], SIDE)
    src = rows(("fix", "dir"), ("fix/new", "file"), ("over", "file"), ("shared", "dir"))
    dst = rows(("fix", "file"), ("over", "dir"), ("over/sub", "dir"), ("gone", "dir"), ("gone/deep", "dir"), ("link", "dir"), ("link/x", "file"), ("shared", "dir"), ("shared/y", "file"))
    links = spark.createDataFrame([("link", None), ("shared", None)], "rel string, target string")
    diff = trees.tree_diff(src, dst)
    plan = sync.sync_plan(diff, links)
    assert [(r.stage, r.rel) for r in plan.collect()] == [("FIX-DIR", "fix"), ("DELETE", "link"), ("COPY", "fix/new"), ("COPY", "over"), ("RMDIR", "gone/deep"), ("RMDIR", "gone")]
    shared = sync.shared_link_extras(diff, links)
    assert [tuple(r) for r in sync.guards(plan, dst, links, shared).collect()] == [("shared-link", "shared/y", "shared")]
    assert sync.guards(plan, dst, links).count() == 0  # the file above fix/new is replaced first
    bad = spark.createDataFrame([("COPY", "link/z"), ("COPY", "fix/new")], "stage string, rel string")
    assert {tuple(r) for r in sync.guards(bad, dst, links).collect()} == {("through-link", "link/z", "link"), ("file-above", "fix/new", "fix")}


def test_what_links_need_is_spared(spark):
    links = spark.createDataFrame([("a", "file", "l/b"), ("l/b", "file", "real/d/x"), ("dead", "file", "other")], "rel string, kind string, target string")
    src = spark.createDataFrame([("a", "file")], "rel string, kind string")
    assert {tuple(r) for r in sync.spared(src, links).collect()} == {("l/b", "link"), ("real/d/x", "storage"), ("l", "directory"), ("real", "directory"), ("real/d", "directory")}


LINKS = "rel string, kind string, target string"


def test_links_through_links_are_spared(spark):
    """A target below a folder link is stored elsewhere: both spellings and every link on the way stay."""
    links = spark.createDataFrame([("k", "file", "through/x"), ("through", "dir", "real"), ("other", "dir", "real")], LINKS)
    src = spark.createDataFrame([("k", "file")], "rel string, kind string")
    assert {tuple(r) for r in sync.spared(src, links).collect()} == {("through", "link"), ("through/x", "alias"), ("real/x", "storage"), ("real", "directory")}
    dst = spark.createDataFrame([("DELETE", "through"), ("DELETE", "other"), ("RMDIR", "real"), ("COPY", "k")], "stage string, rel string")
    assert {tuple(r) for r in sync.sparing(dst, sync.spared(src, links)).select("stage", "rel").collect()} == {("DELETE", "other"), ("COPY", "k")}


def test_links_in_other_letters(spark):
    """On a disk that matches case a link's text may spell what it names in another way."""
    links = spark.createDataFrame([("k", "file", "DATA/x"), ("j", "file", "Through/Y"), ("through", "dir", "real")], LINKS)
    src = spark.createDataFrame([("k", "file"), ("j", "file")], "rel string, kind string")
    held = spark.createDataFrame([("data",), ("data/x",), ("through/y",), ("real/y",), ("real/Y",)], "rel string")
    assert {tuple(r) for r in sync.spared(src, links, held, fold=True).collect()} == {("data/x", "storage"), ("data", "directory"), ("through", "link"), ("through/y", "alias"), ("real/Y", "storage"), ("real", "directory")}
    assert {r.rel for r in sync.spared(src, links, held).collect()} == {"DATA/x", "DATA", "Through/Y", "Through"}


def test_a_way_that_grows_has_no_end(spark, monkeypatch):
    monkeypatch.setattr(links_, "HOPS", 4)
    links = spark.createDataFrame([("grow", "dir", "grow/x"), ("g", "file", "grow/y"), ("f", "file", "d")], LINKS)
    way = ways(links.where("kind = 'file'").select(F.col("target").alias("path")), links)
    assert way.count() == 6 and {r.path: (r.end, r.fate) for r in ends(way).collect()}["grow/y"] == (None, "endless")


def test_ways_of_links_end(spark):
    chain = [(f"c{i}", "file", f"c{i + 1}") for i in range(10)] + [("c10", "file", "end"), ("a", "file", "b"), ("b", "file", "a"), ("out", "dir", None), ("o", "file", "out/z")]
    links = spark.createDataFrame(chain + [("n", "file", "d1/d2/f"), ("d1", "dir", "e"), ("e/d2", "dir", "d3"), ("d1/d2", "dir", "d3")], LINKS)
    way = ways(links.where("kind = 'file'").select(F.col("target").alias("path")), links)
    got = {r.path: (r.end, r.fate) for r in ends(way).collect()}
    assert {got[f"c{i}"] for i in range(1, 11)} == {("end", "inside")}
    assert got["a"] == got["b"] == (None, "endless") and got["out/z"] == (None, "outside") and got["d1/d2/f"] == ("d3/f", "inside")
    src = links.where("kind = 'file'").select("rel", "kind")
    refused = {(r.rule, r.rel, r["at"]) for r in sync.link_refusals(src, links, spark.createDataFrame([("FIX-DIR", "d3/f")], "stage string, rel string")).collect()}
    assert refused == {("endless-link", "a", None), ("endless-link", "b", None), ("storage-replaced", "n", "d3/f")}
    kept = {tuple(r) for r in sync.spared(src.where("rel = 'n'"), links).collect()}
    assert kept == {("d1", "link"), ("d1/d2", "link"), ("e/d2", "link"), ("d1/d2/f", "alias"), ("e/d2/f", "alias"), ("d3/f", "storage"), ("e", "directory"), ("d3", "directory")}
    copied = spark.createDataFrame([("COPY", "c3")], "stage string, rel string")
    held = sync.shared_storage(src, links, copied).collect()
    assert [(r.storage, len(r.names)) for r in held] == [("end", 11)]


def test_a_record_is_held_against_its_disk(spark):
    record = spark.createDataFrame([("a", "file", 1, 1, {"md5": bytes.fromhex("0cc175b9c0f1b6a831c399e269772661")}), ("b", "file", 1, 1, {"md5": b"x"}), ("c", "file", 9, 1, {})], SIDE)
    live = spark.createDataFrame([("a", "file", 1, 1), ("b", "file", 1, 1), ("c", "file", 1, 1)], "rel string, kind string, size long, mtime_ns long")
    contents = spark.createDataFrame([("a", b"a"), ("b", b"b"), ("c", b"c")], "rel string, content binary")
    got = {r.src_rel: r.tag for r in sync.compare_self(record, live, contents, trees.Trust(), ["md5"]).collect()}
    assert got == {"a": "digest-matches:md5", "b": "digest-differs:md5", "c": "stat-size"}
    new = {r.rel: sorted(r.hashes) for r in sync.updated(live, record, contents, ["sha256"]).collect()}
    assert new == {"a": ["md5", "sha256"], "b": ["md5", "sha256"], "c": ["sha256"]}


def test_a_record_side_is_filtered_in_its_scan(spark, tmp_path):
    names = ["a/x", "a", "b/y", "b/z.tmp", "own-cache", "c/own-2/q", "A/x", "ab/x"]
    spark.createDataFrame([(n, "file", 1, 1, {}) for n in names], SIDE).write.parquet(str(tmp_path / "record"))
    stored = spark.read.parquet(str(tmp_path / "record"))
    side = sync.record_side(stored, exclude=["a", "*.tmp"], fold=False, own="own-")
    assert {r.rel for r in side.collect()} == {"b/y", "A/x", "ab/x"}
    assert {r.rel for r in sync.record_side(stored, exclude=["a/**"], fold=False).collect()} == set(names) - {"a/x"}
    assert {r.rel for r in sync.record_side(stored, exclude=["a"]).collect()} == {"b/y", "b/z.tmp", "own-cache", "c/own-2/q", "ab/x"}
    plan_ = side._jdf.queryExecution().executedPlan().toString()
    assert "Not(StringStartsWith(rel,a/))" in plan_.replace(" ", "") or "StringStartsWith(rel,a/)" in plan_


def test_renamed_parent_moves_its_children(spark):
    got = [(r.from_rel, r.src_rel) for r in trees.rename_steps(spark.createDataFrame([("A", "a"), ("A/B", "a/b")], "src_rel string, dst_rel string")).collect()]
    assert got == [("a", "A"), ("A/b", "A/B")]


def test_links(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "link string, target string")
    assert trees.link_closure(edges).count() == 9
    chain = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(60)], "link string, target string")
    assert trees.link_closure(chain).count() == 60 * 61 // 2
    assert trees.link_above(spark.createDataFrame([("x/y/z",)], "rel string"), spark.createDataFrame([("x/y",), ("x",)], "rel string")).first().link == "x"


def test_pulled_in(spark):
    live = spark.createDataFrame([("a", "dir"), ("a/b", "dir"), ("a/b/f", "file"), ("z", "dir")], "rel string, kind string")
    assert {r.rel for r in trees.pulled_in(live, F.col("rel").endswith("f")).collect()} == {"a", "a/b", "a/b/f"}


def test_greedy_does_not_charge_what_is_refused(spark):
    items = spark.createDataFrame([(1, "a", 5), (2, "b", 7), (3, "c", 4), (4, "free", 0), (5, "huge", 100)], "n int, key string, cost long")
    got = {r.key for r in selection.greedy(items, 10, "n").where("admitted").collect()}
    assert got == {"a", "c", "free"}
    assert [r.key for r in selection.admitted_prefix(items, 10, "n").orderBy("spent").collect()] == ["free", "c", "a"]


def test_greedy_walks_ranges_as_one_list(spark):
    rng = random.Random(3)
    for budget in (0, 1, 1000, 10**6, 10**17):
        # every key twice; costs of all sizes up to beyond the budget
        rows = [(i, f"k{i // 2}", int(2 ** rng.uniform(0, 1 + budget.bit_length())) - 1) for i in range(2000)]
        left, want = budget, {}
        for i, _, c in rows:
            if c <= left:
                left -= c
                want[i] = budget - left
        got = selection.greedy(spark.createDataFrame(rows, "n int, key string, cost long").repartition(7), budget, "n").collect()
        assert len(got) == len(rows)
        assert {r.n for r in got if r.admitted} == set(want)
        assert all(r.spent == want[r.n] for r in got if r.admitted and r.cost > 0)


def test_no_task_of_an_admission_gets_all_items(spark):
    items = spark.range(8000).select((F.col("id") * 37 % 8000).alias("n"), F.col("id").alias("key"), F.lit(3).cast("long").alias("cost"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for out in (selection.greedy(items, 10**6, "n"), selection.admitted_prefix(items, 10**6, "n")):
            parts = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            assert sum(parts) == 8000
            assert max(parts) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.spent for r in selection.admitted_prefix(items, 1000, "n", already=100).orderBy("n").collect()] == list(range(103, 1001, 3))


def test_greedy_walk_covers_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = sorted((r.p_partkey, round(r.p_retailprice * 100)) for r in spark.read.parquet(f"{sf}/part.parquet").collect())
    left, want = 2_000_000, {}
    for k, c in rows:
        want[k] = c <= left
        left -= c if want[k] else 0
    assert {r.p_partkey: r.admitted for r in QUERIES["greedy_fold"](spark, sf).collect()} == want


def test_selection_covers_and_reports_over_budget(spark):
    # the same path in another field is another file
    rows = [("game", "i", "identical", 1, 0, 1, 1, 1, 1), ("game", "m", "changed", 8, 1, 2, 3, 1, 1), ("zh-cn", "m", "identical", 30, 0, 1, 1, 1, 1), ("game", "n", "changed", 50, 0, 0, 2, 1, 1), ("game", "add", "added", 7, 0, 0, 1, None, 2)]
    found = selection.candidates(spark.createDataFrame(rows, "field string, file string, state string, total_cost long, moved long, reused long, nchunks long, old_size long, new_bytes long"))
    out, status = selection.select_by_class(found, 1, 20, [("game", "m")])
    by = {s["class"]: (s["status"], s["file"]) for s in status}
    assert by == {"identical": ("captured", "i"), "no_reuse": ("over_budget", "n"), "reuse_in_place": ("unavailable", None), "reuse_moved": ("covered", "m"), "added": ("captured", "add"), "removed": ("unavailable", None)}
    assert [o["file"] for o in out if o["admitted"]] == ["m", "i", "add"]
    table = spark.createDataFrame([(s["class"], s["status"]) for s in status], "class string, status string")
    assert {r.line for r in selection.unmet(table, ["no_reuse", "reuse_moved", "removed"]).collect()} == {"no_reuse: over_budget", "removed: unavailable"}
    with pytest.raises(ValueError, match="no_reuse: over_budget"):
        selection.require(table, ["identical", "no_reuse"])
    selection.require(table, ["identical", "added"])


def test_numbers_do_not_depend_on_partitions(spark):
    rows = spark.range(100).select((F.col("id") * 37 % 100).alias("x"))
    for n in (1, 7):
        assert all(r.n == r.x + 1 for r in selection.numbered(rows.repartition(n), [F.col("x")], "n").collect())


def test_assertions(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 1)], "name string, retcode int")
    checks = assertions.retcodes(rows)
    assert assertions.summary(checks).first().asDict() == {"id": "A1", "total": 2, "passed": 1, "failed": 1}
    assert assertions.result(checks).first().result == "fail"
    assert assertions.result(checks.where("ok"), complete=False).first().result == "incomplete"
    recorded = spark.createDataFrame([("A1", True), ("A2", True)], "id string, ok boolean")
    assert {r.id: r.agrees for r in assertions.agreement(recorded, checks).collect()} == {"A1": False, "A2": True}


def test_a_scan_of_files_is_the_scan_of_their_contents(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    texts = {f"d/{i}": bytes(rng.randrange(97, 100) for _ in range(n)) for i, n in enumerate((0, 1, 300, 5000))}
    (tmp_path / "d").mkdir()
    rows = []
    for rel, data in [*texts.items(), ("d/none", b"abc")]:
        if rel in texts:
            (tmp_path / rel).write_bytes(data)
        for c in range(12):
            a, n = rng.randrange(len(data) + 2), rng.randrange(40)
            held = data[a : a + n]
            source = rng.choice([None, rng.randrange(len(data) + 2)])
            rows.append((rel, c, a, n, hashlib.md5(held if rng.random() < 0.7 else b"x").hexdigest().upper(), source))
    chunks = spark.createDataFrame(rows, "rel string, cpos long, offset long, uncompressed_size long, uncompressed_md5 string, source long")
    disk = spark.createDataFrame(list(texts.items()), "rel string, content binary")
    want = sorted(tuple(r) for r in scan.deep_scan(chunks, disk).collect())
    monkeypatch.setattr(scan, "READ", 7)
    assert len(want) == len(rows)
    assert sorted(tuple(r) for r in scan.scan_files(chunks, str(tmp_path)).collect()) == want
    assert {r[2] for r in want} == {True, False}
    # one read tells the ranges and the files
    told = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    whole = told(scan.deep_scan(chunks, disk, whole=True))
    assert [r[:4] for r in sorted(whole)] == want and {r[4:] for r in whole} == {(len(d), hashlib.md5(d).hexdigest()) for d in texts.values()} | {(None, None)}
    assert told(scan.scan_files(chunks, str(tmp_path), whole=True)) == whole
    for n in (1, 64, 10_000):
        pieces = spark.createDataFrame([(r, a, d[a : a + n]) for r, d in texts.items() for a in range(0, max(1, len(d)), n)], "rel string, offset long, content binary")
        assert sorted(told(scan.scan_pieces(chunks, pieces.repartition(5)))) == want
        assert told(scan.scan_pieces(chunks, pieces.repartition(5), whole=True)) == whole
    plan_ = spark.createDataFrame([(r, len(d), hashlib.md5(d + b"" * (r != "d/1")).hexdigest().upper()) for r, d in texts.items()] + [("d/none", 3, "x")], "rel string, size long, md5 string")
    plan_ = plan_.withColumn("size", F.when(F.col("rel") == "d/2", 7).otherwise(F.col("size"))).withColumn("md5", F.when(F.col("rel") == "d/3", "y").otherwise(F.col("md5")))
    assert told(scan.integrity_of(scan.deep_scan(chunks, disk, whole=True), plan_)) == told(repair.integrity(plan_, disk))
    torn = pieces.where("rel = 'd/3'").withColumn("offset", F.col("offset") + 1)
    assert not any(r.dest_ok or r.source_ok or r.found for r in scan.scan_pieces(chunks, torn, whole=True).collect())


def test_sizes_of_chunks_must_add_up(spark):
    rows = [("a", 0, 0, 5, 10), ("a", 1, 5, 5, 10), ("b", 0, 0, 5, 10), ("c", 0, 0, 5, 10), ("c", 1, 6, 4, 10), ("d", 0, 0, (1 << 63) - 1, 10), ("d", 1, 0, (1 << 63) - 1, 10), ("e", 0, 0, 12, 10)]
    chunks = spark.createDataFrame([("game", f, 0, 0, c, o, n, size) for f, c, o, n, size in rows], "field string, file string, manifest_pos int, pos int, cpos int, offset long, uncompressed_size long, size long")
    got = {(r.file, r.cpos, r.rule) for r in manifest.layout_violations(chunks).collect()}
    assert got == {("b", None, "total"), ("c", 1, "gap"), ("c", None, "total"), ("d", 0, "past-end"), ("d", 1, "past-end"), ("d", None, "total"), ("e", 0, "past-end"), ("e", None, "total")}


def test_a_repair_plan_refuses_bad_ranges_and_tidies_chunks(spark):
    good = [("f", [("b", "m", 10, 1, 5), ("a", "m", 0, 1, 10), ("e", "m", 3, 1, 0)], 15)]
    make = lambda rows: spark.createDataFrame([("game", 0, i, f, False, n, "m", c) for i, (f, c, n) in enumerate(rows)], FILE)
    row = plan.repair_plan(make(good)).first()
    assert ([c.id for c in row.chunks], row.tiled) == (["a", "b"], True)
    assert not plan.repair_plan(make([("f", [("a", "m", 0, 1, 10)], 15)])).first().tiled
    for chunk in (("a", "m", -1, 1, 1), ("a", "m", 0, 1, -1), ("a", "m", 10, 1, 10), ("a", "m", (1 << 63) - 1, 1, 5)):
        bad = make([*good, ("g", [chunk], 15)])
        with pytest.raises(Exception, match="bad range"):
            plan.repair_plan(bad).collect()
        # what is out of scope refuses nothing
        assert plan.repair_plan(bad, exclude=["g"]).count() == 1
    with pytest.raises(ValueError, match="selects nothing"):
        plan.scope_selected(plan.repair_plan(make(good), include=["zz"]), None, ["zz"])


def test_a_chunk_plan_has_a_ceiling(spark):
    old, new = (manifest.flatten(build(spark, **f)) for f in ({"a": "AB", "b": "X"}, {"a": "BC", "b": "Y"}))
    admitted = spark.createDataFrame([("game", "a")], "field string, file string")
    kept, wanted, projected = plan.chunk_plan(admitted, old, new, ceiling=180)
    assert (wanted.count(), projected.first().projected) == (3, "180")
    with pytest.raises(ValueError, match="more than 179"):
        plan.chunk_plan(admitted, old, new, ceiling=179)


def test_rebuild(spark, tmp_path):
    parts = spark.createDataFrame([("g", "d/f", 2, b"c"), ("g", "d/f", 0, b"ab"), ("g", "hole", 1, b"x")], "field string, file string, offset long, bytes binary")
    got = {r.file: (r.size, r.md5, r.tiled) for r in manifest.rebuild(parts, str(tmp_path)).collect()}
    assert got == {"d/f": (3, hashlib.md5(b"abc").hexdigest(), True), "hole": (1, hashlib.md5(b"x").hexdigest(), False)}
    assert (tmp_path / "g/d/f").read_bytes() == b"abc"


def test_ways_through_links_broadcast_nothing(spark):
    given = spark.createDataFrame([("k/1", "file", "p/1/x"), ("p/1", "dir", "q/1")], "rel string, kind string, target string")
    src = given.where("kind = 'file'").select("rel", "kind")
    plan = spark.createDataFrame([("FIX-DIR", "q/1/x")], "stage string, rel string")
    step = links_._step(given.select(F.col("target").alias("path")), given, False)
    for frame in (step, links_.on_the_way(step.select("path"), given), sync.link_refusals(src, given, plan)):
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in sync.link_refusals(src, given, plan).collect()] == [("storage-replaced", "k/1", "q/1/x")]


def test_a_scan_of_this_plan_cuts_the_build_once(spark):
    plan = QUERIES["scan_of_this_plan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "documents.parquet" not in plan
