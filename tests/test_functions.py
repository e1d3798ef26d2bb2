import pytest
from pyspark.sql import functions as F

from treeledger.functions import globs, paths, totals


def values(spark, rows, expr):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(expr(F.col("x"))).collect()]


def test_only_ascii_folds(spark):
    assert values(spark, ["KÄ", "abC"], paths.path_key) == ["kÄ", "abc"]


def test_clean_rel(spark):
    assert values(spark, ["a\\b", "./a/./b", "a//b"], paths.clean_rel) == ["a/b", "a/b", "a/b"]
    bad = ["", "a/", "C:x", "/a", "a/../b", "a./b", "a ", "a:b", "nul", "x/COM1.txt", "."]
    assert values(spark, bad, paths.clean_rel) == [None] * len(bad)
    assert None not in values(spark, bad, paths.bad_rel)


def test_devices_escape_and_come_back(spark):
    rows = ["a/con.txt", "%con", "plain", "COM1/x", "%plain", "%%nul.z", "con ", "a%b"]
    escaped = values(spark, rows, paths.escape_devices)
    assert escaped[:3] == ["a/%con.txt", "%%con", "plain"]
    assert len(set(escaped)) == len(rows)
    assert values(spark, escaped, paths.unescape_devices) == rows


def test_percent(spark):
    rows = ["a b%20\t\r\n%", "%2520"]
    assert values(spark, rows, paths.percent_encode)[0] == "a%20b%2520%09%0D%0A%25"
    assert values(spark, rows, lambda x: paths.percent_decode(paths.percent_encode(x))) == rows


def test_rules(spark):
    assert values(spark, ["", "0123456789abcdef_" + "0" * 32, "x", "a/b"], paths.chunk_id_rule) == ["chunk-id.empty", None, "chunk-id.shape", "chunk-id.shape"]
    assert values(spark, ["1.2", "7.1.0-beta", "", "1.", "con"], paths.tag_rule) == [None, None, "tag.empty", "tag.edge-dot", "tag.device"]
    assert values(spark, ["con"], lambda x: paths.tag_rule(x, allow_device=True)) == [None]
    assert values(spark, ["5.1", "4.0", "x"], lambda x: paths.staleness(F.lit("5.0"), x)) == [0, 1, None]
    assert values(spark, ["0123456789ABCDEF_" + "A" * 32, "z"], lambda x: paths.split_manifest_id(x)["checksum"]) == ["a" * 32, None]


def test_ancestors_and_containment(spark):
    assert values(spark, ["a/b/c", "a"], paths.ancestors) == [["a", "a/b"], []]
    assert values(spark, ["a/b", "ab", "a"], lambda x: paths.within(x, F.lit("a"))) == [True, False, True]
    assert values(spark, ["A/b", "Ab", "a", "\u00c4/b"], lambda x: paths.within(x, F.lit("a/"), fold=True)) == [True, False, False, False]
    assert values(spark, ["A/b"], lambda x: paths.within(x, F.lit("a"))) == [False]


@pytest.mark.parametrize(("glob", "path", "match"), [("*.pak", "x/Y.PAK", True), ("a?c", "a/c", True), ("[!a]b", "ab", False), ("[a-c]b", "Bb", True), ("a\\b", "a/b", True), ("a.b", "axb", False)])
def test_globs(spark, glob, path, match):
    assert values(spark, [path], lambda x: globs.in_scope(x, [glob], [])) == [match]


def test_excluded_ancestor_hides_what_is_below(spark):
    keep = lambda x: globs.kept_by_filter(x, [], ["a/b"])
    assert values(spark, ["a/b/c", "a/bc", "A/B"], keep) == [False, True, False]
    assert values(spark, ["a*b", "axb"], lambda x: globs.kept_by_filter(x, ["a\\*b"], [])) == [True, False]


def test_values_are_cut_between_characters(spark):
    rows = ["abc", "éé", "漢字", "🎉🎉", "a🎉", ""]
    for most in range(9):
        want = [max((t[:k] for k in range(len(t) + 1) if len(t[:k].encode()) <= most), key=len) for t in rows]
        assert values(spark, rows, lambda x, n=most: totals.capped(x, n)) == want


def test_saturating_sum(spark):
    most = (1 << 63) - 1
    total = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x long").agg(totals.saturating_sum(F.col("x"))).first()[0]
    assert total(most, most, most) == (1 << 64) - 1
    assert total(-5, 3, None) == 3
    assert total() == 0


def test_slices(spark):
    import hashlib

    row = spark.createDataFrame([(b"abcdef", [(0, 3, hashlib.md5(b"abc").hexdigest().upper()), (4, 3, hashlib.md5(b"ef").hexdigest())])], "content binary, ranges array<struct<offset:long,length:long,md5:string>>")
    assert row.select(F.transform("ranges", lambda r: totals.slice_matches(F.col("content"), r))).first()[0] == [True, False]
