import hashlib
import json

from pyspark.sql import functions as F

from treeledger.operators import bundle, documents, reports
from treeledger.operators.phases import Phases


def one(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_gates(spark):
    row = one(spark, "a string, b string", (None, "x"), ("x", "x"), ("y", "x"))
    assert [r[0] for r in row.select(reports.declared_mismatch(F.col("a"), F.col("b"))).collect()] == [False, False, True]
    row = one(spark, "m string, c int, e int", ("CHUNK", 1, 0), ("file", 1, 0), ("chunk", 2, 0), ("chunk", 1, 1))
    assert [r[0] for r in row.select(reports.container_refusal(F.col("m"), F.col("c"), F.col("e"))).collect()] == [None, "download mode", "compression", "encryption"]


def test_exit_status_is_the_first_hard_stop(spark):
    schema = "usage_error boolean, metadata_error boolean, limit_hits int, write_error boolean, failed int"
    rows = one(spark, schema, (False, False, 0, False, 0), (False, False, 1, True, 1), (True, True, 0, False, 0), (False, False, 0, False, 2))
    assert [r.status for r in reports.exit_status(rows).collect()] == ["ok", "limit", "usage", "damaged"]


def test_one_file_at_a_time_is_staged_if_it_fits(spark):
    p = one(spark, "file string, payload long", ("a", 1_000_000), ("b", 10), ("c", 10), ("d", 0))
    tiers = lambda ceiling: {r.file: r.tier for r in reports.tiering(p, ceiling).collect()}
    assert tiers(100) == {"a": "ordered", "b": "staged", "c": "staged", "d": "staged"}
    assert set(tiers(0).values()) == {"ordered"} and set(tiers(None).values()) == {"staged"}


def test_actions(spark):
    rows = one(spark, "dest_ok boolean, source long, live boolean, staged boolean", (True, None, False, False), (False, 0, True, True), (False, 0, True, False), (False, 0, False, False), (False, None, False, False))
    assert [r.action for r in reports.file_actions(rows).collect()] == ["kept", "staged", "copied", "download", "download"]
    rows = one(spark, "offset long, uncompressed_size long, prefix_len long, slice_ok boolean", (0, 10, 10, False), (10, 10, 10, True), (20, 1, 10, False))
    assert [r.action for r in reports.resumed(rows).collect()] == ["resumed", "copied", "download"]


def test_sets_and_indexes(spark):
    sets = one(spark, "name string, fetch array<string>, new array<string>, reuse array<string>", ("ok", ["a"], ["a", "b"], ["b"]), ("bad", ["c", "b"], ["a", "b"], ["b"]))
    assert [(r.subset, r.disjoint) for r in reports.set_checks(sets).collect()] == [(True, True), (False, False)]
    a, b = one(spark, "id string, offset long", ("x", 0), ("y", 1)), one(spark, "id string, offset long", ("x", 0), ("x", 5))
    assert {(r.id, r.why) for r in reports.index_mismatches(a, b).collect()} == {("y", "not indexed"), ("x", "not planned")}


def test_trim_and_overlap(spark):
    rows = one(spark, "file string, source long, uncompressed_size long, live boolean, target_size long", ("a", 90, 20, True, 100), ("b", 90, 20, False, 100), ("c", None, 20, False, 100))
    assert {r.file: r.free for r in reports.trim_is_free(rows).collect()} == {"a": False, "b": True, "c": True}
    rows = one(spark, "file string, start long, end long", ("a", 0, 10), ("a", 5, 15), ("b", 0, 10), ("b", 10, 12))
    assert {r.file: r.terminal for r in reports.redo_terminal(rows).collect()} == {"a": True, "b": False}


def test_probe_summary_and_plan_line(spark):
    probes = one(spark, "tag string, status int", ("1.0", 200), ("1.1", 200), ("1.2", 404))
    assert tuple(reports.tag_probe_summary(probes, ["1.0"]).first()) == (3, 2, 1)
    line = reports.plan_line(one(spark, "size long", (5,), (-1,)), one(spark, "est_download long, max_chunk long", (3, 2)), spark.createDataFrame([], "bytes long"), True).first()
    assert line.asDict() == {"files": 2, "est_write": 5, "est_download": 3, "max_chunk_bytes": 2, "purge_files": 0, "purge_bytes": 0, "scoped": True}


def test_blob_problems_and_verdict_reuse(spark):
    schema = "b struct<verified:struct<compressed_size:boolean,compressed_md5:boolean,uncompressed_size:boolean,uncompressed_md5:boolean>,error:string,partial:boolean>"
    rows = one(spark, schema, (((True, True, True, True), None, False),), (((True, False, True, True), "decode", True),))
    assert [r[0] for r in rows.select(reports.blob_problems(F.col("b"))).collect()] == [[], ["compressed_md5 differs", "decode", "partial"]]
    rows = one(spark, "m long, s long", (0, 3_000_000_000), (0, 2_000_000_000), (None, 9_000_000_000))
    same = reports.verdict_reusable(F.lit(1), F.lit(1), F.lit(2), F.lit(2), F.col("m"), F.col("m"), F.col("s"))
    assert [r[0] for r in rows.select(same).collect()] == [True, False, False]


def test_a_long_document_is_the_same_in_any_number_of_parts(spark, tmp_path):
    n = 200_000
    files = spark.range(n).selectExpr("concat('d/', lpad(id, 8, '0')) AS path", "id AS bytes", "md5(string(id)) AS md5", "sha2(string(id), 256) AS sha256", "if(id % 2 = 0, 'identity', null) AS encoding").repartition(7)
    matrix = spark.createDataFrame([("added", "unavailable", None), ("identical", "captured", 'a "b"')], "class string, status string, file string")
    sets = spark.createDataFrame([("reuse", 3), ("patch_fetch", 2)], "role string, chunks long")
    document = documents.manifest_document(matrix, files, sets)
    seen = set()
    for parts in (1, 5, 16):
        at = tmp_path / f"doc{parts}.json"
        documents.write(document, str(at), parts)
        seen.add(hashlib.sha256(at.read_bytes()).hexdigest())
        assert not (tmp_path / f"doc{parts}.json.runs").exists()
    assert len(seen) == 1
    body = json.loads(at.read_bytes())
    assert [f["path"] for f in body["files"]] == [f"d/{i:08d}" for i in range(n)] and body["totals"] == {"files": n, "bytes": n * (n - 1) // 2}
    assert body["matrix"][0] == {"class": "identical", "status": "captured", "file": 'a "b"'} and body["totals_by_set"] == {"patch_fetch": 2, "reuse": 3}
    few = files.where("bytes < 3")
    told, short = (json.loads(d) for d in (documents.text_of(documents.manifest_document(matrix, few, sets)), bundle.bundle_manifest(matrix, few, sets).first().document))
    short["matrix"][1]["file"] = None  # the short form leaves nulls out
    assert told == short | {"files": [{"path": f"d/{i:08d}", "bytes": i, "md5": hashlib.md5(str(i).encode()).hexdigest(), "sha256": hashlib.sha256(str(i).encode()).hexdigest(), "encoding": "identity" if i % 2 == 0 else None} for i in range(3)]}
    assert json.loads(documents.text_of(documents.manifest_document(matrix.limit(0), few.limit(0), sets.limit(0))))["files"] == []


def test_documents_of_answers(spark):
    bodies = spark.createDataFrame([("a", 2, "u2", 500, 1, "text/plain", 10), ("a", 1, "u1", 404, 3, None, 95), ("b", 7, "u7", 403, 1, None, 0)], "grp string, seq long, url string, status int, attempts int, content_type string, bytes long")
    got = json.loads(documents.text_of(documents.error_document(reports.stored_bodies(bodies, 100), 100)))
    assert (got["budget"], got["count"], got["retained_bytes"]) == (100, 3, 100)
    assert [(r["seq"], r["retained_bytes"], r["truncated"], r["stored_path"]) for r in got["responses"]] == [(1, 95, False, "api/error_bodies/000001.body"), (2, 5, True, "api/error_bodies/000002.body"), (7, 0, False, None)]
    kept = spark.createDataFrame([(2, "b.json", 5, "y"), (1, "a.json", 3, "x")], "seq long, file string, bytes long, sha256 string")
    got = json.loads(documents.text_of(documents.api_document(kept, F.col("seq") < 2)))
    assert (got["count"], got["stored"]) == (2, 1) and [r["stored_as"] for r in got["bodies"]] == ["api/a.json", None]


def test_counters_come_from_the_run(spark):
    run = Phases()
    out = run.run("one", spark.range(10).where("id > 3"), rows=F.count("*"), most=F.max("id"))
    run.run("none", spark.range(0), rows=F.count("*"), sum=F.sum("id"))
    assert out.count() == 6 and run.record(spark).first().asDict() == {"one_rows": 6, "one_most": 9, "none_rows": 0, "none_sum": 0}
