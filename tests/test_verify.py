"""A bundle written to a folder, verified from it whole and damaged in one way after another."""

import gzip
import hashlib
import json
import shutil

import pytest
import zstandard

from treeledger.operators import verify
from treeledger.operators.manifest import CLASSES

md5 = lambda b: hashlib.md5(b).hexdigest()
sha = lambda b: hashlib.sha256(b).hexdigest()


def blocks(name, letters):
    return [f"{name} {c} ".encode() * 40 for c in letters]


#: capture, path, chunks of the old and of the new file by letter
CAPTURES = [("identical", "Data/same.bin", "ab", "ab"), ("reuse_in_place", "Data/con.txt", "abc", "axc"), ("reuse_moved", "deep/er/moved.blk", "abcd", "bacd"), ("removed", "Data/gone", "pq", None), ("added", "Data/new", None, "rs")]


def write(root):
    blobs, maps, files = {}, [], {}
    for capture, path, old, new in CAPTURES:
        side, places = {}, {}
        for tag, tree, letters in (("1.0.0", "game", old), ("2.0.0", "expected", new)):
            if letters is None:
                continue
            at, body = 0, b"".join(blocks(capture, letters))
            role = "materialize_old" if tree == "game" else "materialize_new"
            for data in blocks(capture, letters):
                blobs.setdefault(md5(data), (data, []))[1].append((tag, capture, path, role, at))
                places.setdefault((tree, md5(data)), at)
                at += len(data)
            side[tree] = {"tag": tag, "size": len(body), "md5": md5(body), "nchunks": len(letters)}
            files[f"{tree}/{path.replace('con.txt', '%con.txt')}"] = body
        plan, at = [], 0
        for i, data in enumerate(blocks(capture, new or "")):
            source = places.get(("game", md5(data)))
            if source is None:
                blobs[md5(data)][1].append(("2.0.0", capture, path, "patch_fetch", at))
            span = lambda a, n=len(data): {"start": a, "end": a + n}
            plan.append({"i": i, "decision": "FETCH" if source is None else "REUSE", "target_range": span(at), "source_range": None if source is None else span(source), "chunk_id": md5(data), "compressed_size": len(packed(data)), "uncompressed_size": len(data)})
            at += len(data)
        fetch = [p for p in plan if p["decision"] == "FETCH"]
        cost = sum(p["compressed_size"] for p in fetch)
        totals = {"chunks": len(plan), "reuse": len(plan) - len(fetch), "fetch": len(fetch), "moved": sum(p["source_range"] is not None and p["source_range"] != p["target_range"] for p in plan), "download_bytes": cost} if new else None
        maps.append({"schema_version": 3, "capture_id": capture, "path": path, "old": side.get("game"), "new": side.get("expected"), "plan": plan if new else None, "totals": totals, "expectations": {"download_bytes": cost}})
    index = [
        {"chunk_id": id_, "stored_path": f"chunks/blobs/{id_}.zst", "bytes": len(packed(data)), "md5_compressed": md5(packed(data)), "md5_decompressed": md5(data), "sha256_compressed": sha(packed(data)), "uncompressed_size": len(data), "partial": False,
         "decode_error": None, "fetch_error": None, "measurement_error": None, "referenced_by": [dict(zip(("tag", "capture_id", "path", "role", "offset"), r, strict=True)) for r in used]}
        for id_, (data, used) in sorted(blobs.items())
    ]
    files |= {f"chunks/blobs/{id_}.zst": packed(data) for id_, (data, _) in blobs.items()}
    files |= {f"patchmaps/{m['capture_id']}.json": json.dumps(m).encode() for m in maps}
    files |= {"game/config.ini": b"[General]\r\ngame_version=1.0.0\r\n", "manifests/1.0.0/game.json.gz": gzip.compress(b"{}" * 100, mtime=0), "chunks/index.json": json.dumps({"schema_version": 3, "blobs": index}).encode()}
    body = lambda path, data: gzip.decompress(data) if path.endswith(".gz") else data
    listed = [{"path": p, "bytes": len(body(p, d)), "md5": md5(body(p, d)), "sha256": sha(body(p, d)), "encoding": "gzip" if p.endswith(".gz") else "identity"} for p, d in sorted(files.items())]
    matrix = [{"class": c, "status": "captured" if c in {x[0] for x in CAPTURES} else "unavailable"} for c in CLASSES]
    recorded = [{"id": i, "ok": True} for i in ("A6", "A7", "A8", "A11", "A16", "A18", "A20")]
    files["MANIFEST.json"] = json.dumps({"schema_version": 3, "versions": {"old": {"tag": "1.0.0"}, "new": {"tag": "2.0.0"}}, "matrix": matrix}).encode()
    files["verify/checksums.json"] = json.dumps({"schema_version": 3, "entries": listed}).encode()
    files["verify/selfcheck.json"] = json.dumps({"schema_version": 3, "assertions": recorded}).encode()
    for path, data in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)


def packed(data):
    return zstandard.ZstdCompressor().compress(data)


@pytest.fixture(scope="module")
def whole(tmp_path_factory):
    root = tmp_path_factory.mktemp("bundle") / "whole"
    write(root)
    return root


def judged(spark, root):
    b = verify.opened(spark, str(root), [3])
    rows = verify.verified(b).cache()
    failed = {(r.id, r.subject) for r in rows.where("not ok").collect()}
    return failed, verify.report(b, rows).first(), {r.id for r in rows.select("id").distinct().collect()}


def test_a_whole_bundle_holds(spark, whole):
    failed, row, ids = judged(spark, whole)
    assert failed == set() and (row.result, row.failed, row.line, row.agrees) == ("pass", 0, None, True)
    assert ids == {"A6", "A7", "A8", "A11", "A12", "A13", "A14", "A16", "A17", "A18", "A20"} and row.total == row.passed


def edit(root, path, change):
    """Change a document and its place in the list of digests."""
    body = json.loads((root / path).read_text())
    change(body)
    data = json.dumps(body).encode()
    (root / path).write_bytes(data)
    if path not in verify.UNLISTED:
        edit(root, verify.CHECKSUMS, lambda c: next(e for e in c["entries"] if e["path"] == path).update(bytes=len(data), md5=md5(data), sha256=sha(data)))


def spoil(root, path, data):
    at = root / path
    at.write_bytes(data(at.read_bytes()))


def blob(letter, capture="reuse_moved"):
    return md5(blocks(capture, letter)[0])


def first(x, **fields):
    """The first reference in an index with these fields."""
    return next(u for b in x["blobs"] for u in b["referenced_by"] if all(u[k] == v for k, v in fields.items()) and (u["offset"] > 0 or "role" not in fields))


#: what is done, and the assertions that fail for it: id and the beginning of the subject
DAMAGE = {
    "a blob is cut short": (lambda r: spoil(r, f"chunks/blobs/{blob('c')}.zst", lambda d: d[:-3]), [("A6", f"chunks/blobs/{blob('c')}"), ("A16", f"chunks/blobs/{blob('c')}"), ("A18", "reuse_moved old"), ("A18", "reuse_moved new")]),
    "a blob is gone": (lambda r: (r / f"chunks/blobs/{blob('a', 'identical')}.zst").unlink(), [("A6", f"chunks/blobs/{blob('a', 'identical')}"), ("A16", f"chunks/blobs/{blob('a', 'identical')}"), ("A18", "identical old"), ("A18", "identical new")]),
    "a blob holds other bytes": (lambda r: spoil(r, f"chunks/blobs/{blob('p', 'removed')}.zst", lambda d: packed(b"x" * 440)), [("A6", f"chunks/blobs/{blob('p', 'removed')}"), ("A16", f"chunks/blobs/{blob('p', 'removed')}"), ("A7", "removed Data/gone"), ("A18", "game/Data/gone")]),
    "a shipped file differs": (lambda r: spoil(r, "expected/Data/%con.txt", lambda d: d[:-1] + b"?"), [("A16", "expected/Data/%con.txt"), ("A18", "expected/Data/%con.txt")]),
    "a shipped file is gone": (lambda r: (r / "game/Data/gone").unlink(), [("A16", "game/Data/gone"), ("A18", "game/Data/gone")]),
    "a declared digest differs": (lambda r: edit(r, "patchmaps/added.json", lambda m: m["new"].update(md5="0" * 32)), [("A8", "added Data/new")]),
    "a declared size differs": (lambda r: edit(r, "patchmaps/removed.json", lambda m: m["old"].update(size=1)), [("A7", "removed Data/gone"), ("A11", "removed old")]),
    "a chunk is elsewhere": (lambda r: edit(r, "chunks/index.json", lambda x: first(x, capture_id="added", role="materialize_new").update(offset=7)), [("A11", "added new")]),
    "totals are no sums": (lambda r: edit(r, "patchmaps/reuse_in_place.json", lambda m: m["totals"].update(download_bytes=0)), [("A20", "patchmaps/reuse_in_place")]),
    "totals are missing": (lambda r: edit(r, "patchmaps/added.json", lambda m: m.update(totals=None)), [("A20", "patchmaps/added")]),
    "a fetched chunk isn't kept": (lambda r: edit(r, "chunks/index.json", lambda x: [b["referenced_by"].remove(u) for b in x["blobs"] for u in list(b["referenced_by"]) if u["role"] == "patch_fetch" and u["capture_id"] == "reuse_in_place"]), [("A12", "reuse_in_place 1")]),
    "the settings name another tag": (lambda r: spoil(r, "game/config.ini", lambda d: d.replace(b"1.0.0", b"3.0.0")), [("A13", "game/config.ini"), ("A16", "game/config.ini")]),
    "a class is left open": (lambda r: edit(r, "MANIFEST.json", lambda m: m["matrix"].pop(0)), [("A17", CLASSES[0])]),
    "a file is stray": (lambda r: (r / "game/stray.txt").write_bytes(b"x"), [("A14", "game/stray.txt")]),
    "a blob was fetched in part": (lambda r: edit(r, "chunks/index.json", lambda x: next(b for b in x["blobs"] if b["chunk_id"] == blob("r", "added")).update(partial=True)), [("A6", f"chunks/blobs/{blob('r', 'added')}"), ("A18", "added new")]),
}
#: damages that are done together, and how the line begins that tells the root of them
GROUPS = [
    (["a blob is cut short", "a declared digest differs", "totals are no sums", "a class is left open", "a file is stray"], "A18 reuse_moved new: " + blob("c") + ": ValueError: the frame is cut short"),
    (["a blob holds other bytes", "a shipped file differs", "a chunk is elsewhere", "a fetched chunk isn't kept", "the settings name another tag"], f"A6 chunks/blobs/{blob('p', 'removed')}"),
    (["a blob is gone", "a blob was fetched in part", "a declared size differs", "totals are missing"], "A18 added new"),
    (["a shipped file is gone"], "A16 game/Data/gone: absent"),
]


@pytest.mark.parametrize(("damages", "line"), GROUPS)
def test_damage_is_found(spark, whole, tmp_path, damages, line):
    root = tmp_path / "bundle"
    shutil.copytree(whole, root)
    for what in damages:
        DAMAGE[what][0](root)
    failed, row, _ = judged(spark, root)
    expected = [e for what in damages for e in DAMAGE[what][1]]
    assert not [e for e in expected if not any(i == e[0] and s.startswith(e[1]) for i, s in failed)]
    assert not [f for f in failed if not any(f[0] == i and f[1].startswith(s) for i, s in expected)]
    assert (row.result, row.failed, row.agrees) == ("fail", len(failed), False) and row.line.startswith(line)


def test_what_is_no_bundle_raises(spark, whole, tmp_path):
    root = tmp_path / "bundle"
    shutil.copytree(whole, root)
    (root / "verify/selfcheck.json").unlink()
    with pytest.raises(ValueError, match="selfcheck.json is missing"):
        verify.opened(spark, str(root), [3])
    with pytest.raises(Exception, match="unknown version"):
        verify.opened(spark, str(root), [2])
