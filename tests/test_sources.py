import gzip
import hashlib
import json
import os

import pytest
import zstandard
from pyspark.sql import functions as F

from treeledger.functions.records import ordered
from treeledger.operators import bundle
from treeledger.sources import files, manifests, requests, settings
from treeledger.streaming.requests import bytes_by_window, read_log


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def number(k, n):
    return varint(k << 3) + varint(n)


def block(k, data):
    return varint(k << 3 | 2) + varint(len(data)) + data


def test_manifest_decodes_and_errors_are_rows(spark):
    chunk = block(1, b"id") + block(2, b"MD5") + number(3, 7) + number(4, 5) + number(5, -1) + number(6, 150)
    message = block(1, block(1, b"a/b") + block(2, chunk) + number(4, 9) + block(5, b"ABC")) + block(1, block(1, b"dir") + number(3, 1))
    frame = zstandard.compress(message)
    sum_ = hashlib.md5(message).hexdigest().upper()
    rows = [("new", "game", 0, frame, len(message), sum_), ("new", "bad", 1, b"junk", None, None), ("new", "lie", 2, frame, len(message), "0" * 32)]
    got = manifests.read_manifests(spark.createDataFrame(rows, "build_tag string, field string, manifest_pos int, content binary, size long, checksum string")).orderBy("manifest_pos", "pos").collect()
    assert [(r.field, r.file, r.is_folder, r.size, r.md5) for r in got[:2]] == [("game", "a/b", False, 9, "abc"), ("game", "dir", True, 0, "")]
    assert got[0].chunks[0].asDict() == {"id": "id", "uncompressed_md5": "MD5", "offset": 7, "compressed_size": 5, "uncompressed_size": -1, "unknown_field6": 150, "compressed_md5": ""}
    assert "zstd" in got[2].error and "checksum" in got[3].error


def test_stat_tree_has_nanoseconds_links_and_errors(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/f").write_bytes(b"xyz")
    os.utime(tmp_path / "d/f", ns=(5, 1234567891))
    (tmp_path / "l").symlink_to(tmp_path / "nowhere")
    (tmp_path / "own.cache").write_text("")
    got = {r.rel: r for r in files.stat_tree(spark, str(tmp_path), skip="own.cache", followlinks="true").collect()}
    assert set(got) == {"d", "d/f", "l"}
    assert (got["d/f"].size, got["d/f"].mtime_ns) == (3, 1234567891)
    assert got["l"].is_link and got["l"].error


def test_a_walk_is_dealt_by_upper_levels(spark, tmp_path):
    for d in ("one/a", "one/b/c", "two"):
        (tmp_path / d).mkdir(parents=True)
    for f in ("one/a/f", "one/b/c/g", "two/h", "top"):
        (tmp_path / f).write_text("x")
    (tmp_path / "one/b/up").symlink_to(tmp_path / "one")
    walk = files._Walk({"path": str(tmp_path), "followlinks": "true"})
    parts = walk.partitions()
    assert [(p.rel, p.whole) for p in parts] == [("one", False), ("one/a", False), ("one/a/f", True), ("one/b", False), ("one/b/c", True), ("one/b/up", True), ("top", True), ("two", False), ("two/h", True)]
    got = {r.rel: (r.is_dir, r.error) for r in files.stat_tree(spark, str(tmp_path), followlinks="true").collect()}
    assert got == {"one": (True, None), "one/a": (True, None), "one/a/f": (False, None), "one/b": (True, None), "one/b/c": (True, None), "one/b/c/g": (False, None), "one/b/up": (True, "loop"), "top": (False, None), "two": (True, None), "two/h": (False, None)}
    shallow = {r.rel for r in files.stat_tree(spark, str(tmp_path), maxdepth="2").collect()}
    assert shallow == {"one", "one/a", "one/b", "top", "two", "two/h"}


def test_a_walk_that_fails_raises_its_first_fault(spark, tmp_path):
    for d in ("b/deep", "a", "own-1", "b/own-2/x"):
        (tmp_path / d).mkdir(parents=True)
    (tmp_path / "b/own-file").write_text("x")
    (tmp_path / "a/f").write_text("x")
    whole = files.whole_tree(spark, str(tmp_path), followlinks="true", own="own-")
    assert {r.rel for r in whole.collect()} == {"a", "a/f", "b", "b/deep"}
    (tmp_path / "b/deep/none").symlink_to(tmp_path / "nowhere")
    (tmp_path / "b-later").symlink_to(tmp_path / "nowhere")
    (tmp_path / "own-link").symlink_to(tmp_path / "nowhere")
    for enough in (1, 3, 256):
        files._Walk.ENOUGH, before = enough, files._Walk.ENOUGH
        try:
            with pytest.raises(ValueError, match="b/deep/none: No such file"):
                files.whole_tree(spark, str(tmp_path), followlinks="true", own="own-")
        finally:
            files._Walk.ENOUGH = before


def test_answers_and_nodes(spark):
    bodies = spark.createDataFrame([("a", '{"retcode": 0, "data": {"x": 1}}'), ("b", '{"retcode": 5, "message": "no"}')], "name string, body string")
    assert requests.answers(bodies.where("name = 'a'"), "struct<x:int>").first().data.x == 1
    with pytest.raises(Exception, match="b: retcode 5 no"):
        requests.answers(bodies, "struct<x:int>").collect()
    assert requests.node(bodies, "a").count() == 1
    with pytest.raises(ValueError, match="0 nodes"):
        requests.node(bodies, "c")


def test_a_bundle_opens_or_says_why_not(spark, tmp_path):
    (tmp_path / "diff").mkdir()
    (tmp_path / "MANIFEST.json").write_text('{"schema_version": 1, "x": 2}')
    (tmp_path / "diff/a.json").write_text('{\n "schema_version": 1\n}')
    assert {r.path: r.schema_version for r in bundle.open_bundle(spark, str(tmp_path), [1]).select("path", "schema_version").collect()} == {"MANIFEST.json": 1, "diff/a.json": 1}
    (tmp_path / "diff/a.json").write_text("{")
    with pytest.raises(Exception, match="diff/a.json: not JSON"):
        bundle.open_bundle(spark, str(tmp_path), [1]).select("path", "schema_version").collect()


def test_a_bundle_s_document(spark):
    matrix = spark.createDataFrame([("removed", "unavailable", None), ("identical", "captured", "a")], "class string, status string, file string")
    listed = spark.createDataFrame([("b", 2, "m", "s", "identity"), ("a", 1, "m", "s", "gzip")], "path string, bytes long, md5 string, sha256 string, encoding string")
    sets = spark.createDataFrame([("reuse", 3), ("patch_fetch", 1)], "role string, chunks long")
    doc = json.loads(bundle.bundle_manifest(matrix, listed, sets).first().document)
    assert (doc["totals"], doc["totals_by_set"]) == ({"files": 2, "bytes": 3}, {"patch_fetch": 1, "reuse": 3})
    assert [m["class"] for m in doc["matrix"]] == ["identical", "removed"] and [f["path"] for f in doc["files"]] == ["a", "b"]


def test_manifest_dump_round_trip(spark, tmp_path):
    rows = [("7.1", "game", 0, 0, "a/b", False, 9, "m", [("id", "u", 0, 1, 2)]), ("7.1", "zh-cn", 0, 0, "d", True, 0, "", [])]
    entries = spark.createDataFrame(rows, "build_tag string, field string, manifest_pos int, pos int, file string, is_folder boolean, size long, md5 string, chunks array<struct<id:string,uncompressed_md5:string,offset:long,compressed_size:long,uncompressed_size:long>>")
    manifests.write_dump(entries, str(tmp_path / "dump"))
    assert sorted(map(tuple, manifests.read_dump(spark, str(tmp_path / "dump")).select("build_tag", "field", "file", "size").collect())) == [("7.1", "game", "a/b", 9), ("7.1", "zh-cn", "d", 0)]
    manifests.write_paths(entries, str(tmp_path / "paths"))
    assert {(r.field, r.file, r.size, r.chunks) for r in manifests.read_paths(spark, str(tmp_path / "paths")).collect()} == {("game", "a/b", 9, 1), ("zh-cn", "d", 0, 0)}
    with pytest.raises(Exception, match="field.multi-component"):
        manifests.write_dump(entries.withColumn("field", F.lit("x/y")), str(tmp_path / "bad"))


def test_inventory_digests_what_a_gzip_holds(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"abc")
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"abc"))
    got = {r.path: r for r in files.inventory(files.contents(spark, str(tmp_path))).collect()}
    assert got["a.txt"].md5 == got["b.gz"].md5 == hashlib.md5(b"abc").hexdigest()
    assert (got["b.gz"].encoding, got["b.gz"].bytes) == ("gzip", 3)
    assert "content" not in files.contents(spark, str(tmp_path)).select("rel", "length")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_settings(spark, tmp_path):
    ini = tmp_path / "config.ini"
    ini.write_text("[g]\ngame_version=1.0\ngame_version =2.0=x\ngame_version=\n")
    found = settings.lines(spark, str(ini))
    assert settings.game_version(found).first().version == "2.0=x"
    sections = {(r.section, r.key): r.value for r in settings.merged_ini(found, {"channel": "1"}).collect()}
    assert sections == {("g", "game_version"): "", ("General", "channel"): "1", ("General", "sdk_version"): ""}
    ini.write_text('top="x"\n; note\n[General]\nk = 1\n[Other]\nK=2\n[general]\nCHANNEL=old\nsdk_version=9\n[ ]\nk=3\nno\n[Empty]\n')
    text = settings.ini_text(settings.merged_ini(settings.lines(spark, str(ini)), {"channel": "1", "game_version": "5"})).first().text
    assert text == "[General]\nCHANNEL=1\ngame_version=5\nk=3\nsdk_version=9\ntop=x\n\n[Other]\nK=2\n\n[Empty]\n\n"
    ini.write_text("[g]\nx=1\n")
    text = settings.ini_text(settings.merged_ini(settings.lines(spark, str(ini)), {"game_version": "5"})).first().text
    assert text == "[g]\nx=1\n\n[General]\ngame_version=5\nsdk_version=\n\n"
    assert settings.hash_list(" MD5,sha256,md5") == ["md5", "sha256"] and settings.hash_list("none") == []
    with pytest.raises(ValueError, match="none"):
        settings.hash_list("none,md5")
    with pytest.raises(ValueError, match="both sides"):
        settings.distinct_sides("/a/", "/a")
    keep = tmp_path / "keep"
    keep.write_text('﻿{"remoteName": "a"}\nbad\n{"remoteName": "b"}\n')
    assert {r.rel for r in settings.path_list(settings.lines(spark, str(keep))).collect()} == {"a", "b"}
    keep.write_text("bad\nworse\n")
    with pytest.raises(ValueError, match="no line"):
        settings.path_list(settings.lines(spark, str(keep)))
    audio = tmp_path / "audio"
    audio.write_text("Korean\nEnglish(US)\n?\n")
    assert settings.audio_languages(settings.lines(spark, str(audio))) == ["en-us", "ko-kr"]
    assert settings.audio_languages(None) == ["en-us"]
    assert settings.scan_file(["ko-kr", "en-us"]) == "English(US)\nKorean\n"


def test_bundles_and_branches(spark, tmp_path):
    for name, text in (("a", '{"schema_version": 1}'), ("b", "{"), ("c", '{"schema_version": 9}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "MANIFEST.json").write_text(text)
    assert [r.reason for r in settings.bundles(spark, str(tmp_path), [1]).collect()] == [None, "not JSON", "unknown version"]
    body = '{"retcode": 0, "data": {"game_branches": [{"main": {"branch": "main", "tag": "5.0", "diff_tags": ["4.9", "4.8"]}}]}}'
    branch = settings.main_branch(spark.createDataFrame([(body,)], "body string"))
    assert settings.version_pair(branch) == ("5.0", "4.9")
    with pytest.raises(ValueError, match="another"):
        settings.version_pair(branch, old="5.0")


def test_request_log_round_trip_and_stream(spark, tmp_path):
    rows = [(2, "2024-01-01T00:00:01Z", "api", "https://h/x", 200, 5), (1, "2024-01-01T00:00:00Z", "api", "https://h/x", 500, 3)]
    log = spark.createDataFrame(rows, "seq long, ts string, kind string, url string, status int, bytes_in long").withColumn("ts", F.to_timestamp("ts"))
    requests.write_log(log, str(tmp_path / "log"))
    back = requests.read_log(spark, str(tmp_path / "log"))
    assert {r.seq for r in back.collect()} == {1, 2}
    assert back.where(requests.retryable(F.col("status"))).count() == 1
    assert requests.match_bodies(spark.createDataFrame([("h/x",), ("none",)], "endpoint string"), back).orderBy("endpoint").collect()[0].seq == 2
    # beyond a few endpoints each is looked up by its first letters
    urls = [f"https://h/{i % 40}/api/{i}" for i in range(300)]
    many = spark.createDataFrame([(i, u, 200 if i % 7 else 404) for i, u in enumerate(urls)], "seq long, url string, status int")
    ends = [f"/{i}/api" for i in range(50)] + [f"api/{i}" for i in range(0, 300, 3)] + ["", "zz", "https://h/3/api/43/and/more"]
    bodies = spark.createDataFrame([(e,) for e in ends], "endpoint string")
    want = {e: max((i for i, u in enumerate(urls) if e in u and i % 7), default=0) for e in ends}
    for few in (1000, 5):
        requests.FEW = few
        assert {r.endpoint: r.seq for r in requests.match_bodies(bodies, many).collect()} == want
    query = bytes_by_window(read_log(spark, str(tmp_path / "log"))).writeStream.outputMode("update").format("memory").queryName("totals").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT max(bytes_in), max(failed) FROM totals").first() == (8, 1)


def test_ordered_frames(spark):
    a, b = (spark.createDataFrame([(x,)], "rel string") for x in "ab")
    assert [(r.stage, r.rel) for r in ordered([("MKDIR", b), ("COPY", a)], "rel").collect()] == [("MKDIR", "b"), ("COPY", "a")]
