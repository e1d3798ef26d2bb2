"""Near-duplicate documents by circulant MinHash, with exact Jaccard verification.

Two permutations of the 32-bit universe make every signature coordinate: sigma scatters
the shingles once, and coordinate k is the minimum of pi over the set shifted
circularly by k. Bands of coordinates propose pairs, full shingle sets decide.
With 36 bands of 5 rows a pair at the threshold 0.8 shares no band with a
probability of 6e-7.

Defined results: a null or wordless text has no shingles and links with nothing. Rows that
share a doc_id are judged each by its own text; a component's id is the smallest doc_id in it. A row without
doc_id links with nothing and is kept. A very long text is one set like any other. Ties can't matter, as all
links count. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.cells import in_cells, runs, sides
from treeledger.llm.components import components
from treeledger.llm.staging import drop, small, stage
from treeledger.llm.text import distinct_per_text, mix, passes, shingle_hashes, word_hashes, words

BANDS, ROWS = 36, 5
#: Percent of the union that the intersection of linked sets has at least.
PERCENT = 80
#: A bucket of at most so many classes that are still apart is compared pair by pair; members of a block otherwise.
SMALL, BLOCK = 16, 1024
#: Shingles whose incidence a block's matrix holds at once.
COLUMNS = 8192
#: What tells one set from another.
_SET = ["set_a", "set_b", "n_shingles"]
_SET_TYPES = "set_a long, set_b long, n_shingles long"
_SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary"


#: Shifts and odd factors of the two permutations.
_SIGMA = ((16, 0x7FEB352D), (15, 0x846CA68B))
_PI = ((15, 0xD168AAAD), (15, 0xAF723597))


def _permute(x: np.ndarray, tmp: np.ndarray, steps: tuple = _SIGMA) -> np.ndarray:
    """A bijection of 32-bit integers, in place."""
    for shift, factor in steps:
        np.right_shift(x, np.uint32(shift), out=tmp)
        np.bitwise_xor(x, tmp, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=tmp)
    return np.bitwise_xor(x, tmp, out=x)


def signatures(values: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """n coordinates for each non-empty set values[bounds[i]:bounds[i + 1]] of 64-bit hashes."""
    sigma = (values >> np.uint64(32)).astype(np.uint32)
    tmp, x = np.empty_like(sigma), np.empty_like(sigma)
    _permute(sigma, tmp)
    out = np.empty((n, len(bounds) - 1), np.uint32)
    for k in range(n):
        np.subtract(sigma, np.uint32(k), out=x)
        out[k] = np.minimum.reduceat(_permute(x, tmp, _PI), bounds[:-1])
    return out


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for row, data, offsets in passes(column):
        starts, ends, first = words(data, offsets)
        doc, value = shingle_hashes(word_hashes(data, starts, ends), first, width)
        yield (row, *distinct_per_text(doc, value, len(offsets) - 1))


def _digests(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set (0 for the empty one): equal sets have equal ones, and n, the sums and the size tell sets apart."""
    out = np.zeros((2, len(bounds) - 1), np.uint64)
    has = np.flatnonzero(np.diff(bounds))
    if len(has):
        for i in range(2):
            out[i][has] = np.add.reduceat(mix(value + np.uint64(0x632BE59BD9B4E019 * (i + 1) % (1 << 64))), bounds[:-1][has])
    return out[0].view(np.int64), out[1].view(np.int64)


def _sign(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value, bounds in _sets(batch.column(1), width):
                size = np.diff(bounds)
                has = np.flatnonzero(size)
                keys = np.zeros((len(has), bands), np.uint64)
                sketch = np.full(len(size), None, object)
                if len(has):
                    sig = signatures(value, np.append(bounds[:-1][has], len(value)), bands * rows)
                    for b in range(bands):
                        acc = np.full(len(has), b + 1, np.uint64)
                        for r in range(rows):
                            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + sig[b * rows + r])
                        keys[:, b] = acc
                    sketch[has] = [x.tobytes() for x in np.ascontiguousarray(sig.T).astype(np.uint8)]
                offsets = np.zeros(len(size) + 1, np.int32)
                offsets[1:] = np.cumsum(np.where(size > 0, bands, 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(size)), pa.array(size.astype(np.int64)), *map(pa.array, _digests(value, bounds)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).ravel())), pa.array(sketch, pa.binary())],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"],
                )

    return run


def _full_sets(width: int):
    """Documents -> their distinct sets, once for each pass over some texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, value, bounds in _sets(batch.column(1), width):
                a, b = _digests(value, bounds)
                size = np.diff(bounds)
                _, one = np.unique(np.stack((a, b, size)), axis=1, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(value.view(np.int64))).take(pa.array(one))
                yield pa.RecordBatch.from_arrays([pa.array(a[one]), pa.array(b[one]), pa.array(size[one].astype(np.int64)), lists], names=[*_SET, "shingles"])

    return run


def _promising(least: float):
    """Pairs whose signatures agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in batch.columns[2:])
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= least))

    return run


def _verified(texts: _Texts, sketches: DataFrame, pairs: DataFrame, percent: int, coordinates: int) -> DataFrame:
    """Those of pairs (a, b) of classes whose full shingle sets are alike enough.

    Signatures that agree six standard deviations too seldom for that (a chance of 1e-9 at the threshold) spare
    the reading of their texts.
    """
    share = percent / 100
    least = share - 6 * (share * (1 - share) / coordinates) ** 0.5
    near = pairs.join(sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("y")), "b")
    pairs = stage(near.select("a", "b", "x", "y").mapInArrow(_promising(least), "a long, b long").distinct(), "pairs")
    sets = stage(texts.sets(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()), "sets")
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y")).cast("long")
    linked = stage(both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b"), "linked")
    drop(sets, pairs)
    return linked


class _Texts:
    """Full sets of classes (rep, doc_id: a document that has the set, and the set's digests)."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, repeated: bool) -> None:
        self.docs, self.classes, self.width, self.repeated = docs, classes, width, repeated

    def sets(self, reps: DataFrame) -> DataFrame:
        """rep, shingles: one row for each of reps (rep)."""
        wanted = stage(self.classes.join(reps, "rep").select("rep", "doc_id", *_SET), "wanted")
        found = self.docs.join(small(wanted.select("doc_id").distinct()), "doc_id", "left_semi").mapInArrow(_full_sets(self.width), f"{_SET_TYPES}, shingles array<long>")
        # a document's other rows have other sets, and equal ones come from each pass
        found = found.join(small(wanted.select("rep", *_SET)), _SET).select("rep", "shingles")
        return found.dropDuplicates(["rep"]) if self.repeated else found


def _cell_links(percent: int):
    """Rows of cells (rep, c, keys, shingles) -> links between components c of reps that share a key, by the sizes of
    all common sets of two blocks at once: products of their shingles' incidence matrices."""

    def matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, value number) of each list entry, for values that several rows have."""
        value = np.asarray(lists.flatten())
        row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
        _, number, many = np.unique(value, return_inverse=True, return_counts=True)
        use = many[number] > 1
        return row[use], np.unique(number[use], return_inverse=True)[1]

    def common(row: np.ndarray, number: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(number, kind="stable")
        row, number = row[order], number[order]
        top = int(number[-1]) + 1 if len(number) else 0
        for a in range(0, top, COLUMNS):
            s, e = np.searchsorted(number, [a, a + COLUMNS])
            x = np.zeros((n, min(COLUMNS, top - a)), np.float32)
            x[row[s:e], number[s:e] - a] = 1
            out += x[left] @ x[right].T
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches, "g", "i", "j"):
            left, right = sides(cell)
            if cell.num_rows < 2 or not len(left) or not len(right):
                continue
            rep, c, size = (np.asarray(cell[x]) for x in ("rep", "c", "n"))
            least, most = np.minimum.outer(size[left], size[right]), np.maximum.outer(size[left], size[right])
            may = (c[left][:, None] != c[right][None, :]) & (100 * least >= percent * most)
            if left is right:
                may = np.triu(may, 1)
            if may.any():
                may &= common(*matrix(cell["keys"].combine_chunks()), left, right, cell.num_rows) > 0
            if may.any():
                both = common(*matrix(cell["shingles"].combine_chunks()), left, right, cell.num_rows).astype(np.int64)
                a, b = np.nonzero(may & (100 * both >= percent * (least + most - both)))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[left[a]], rep[right[b]])), pa.array(np.maximum(rep[left[a]], rep[right[b]]))], names=["a", "b"])

    return run


def _mixed(left: DataFrame, found: DataFrame) -> DataFrame:
    """Of (key, rep, n): the buckets that hold several components, with c and m (rows of the bucket)."""
    own = left.join(found.withColumnRenamed("vertex", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component_id", "rep").alias("c"))
    mixed = own.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("m")).where("x <> y").select("key", "m")
    return stage(own.join(mixed, "key"), "mixed")


def _linked_classes(texts: _Texts, reps: DataFrame, percent: int, coordinates: int) -> DataFrame:
    """vertex, component_id of the classes (reps: rep, n, bands, sketch) that are linked with another.

    The classes of a bucket meet its first member, then its member with most links: 2 * (m - 1) pairs for a bucket of
    m. Whatever is in different components of a bucket after that is compared as well: small buckets pair by pair, large ones
    in cells of two blocks that give only links. Each step ends it when nothing is apart any more.
    """
    sketches = reps.select("rep", "sketch")
    verified = lambda pairs: _verified(texts, sketches, pairs, percent, coordinates)
    may = lambda m, n: 100 * F.least(m, n) >= percent * F.greatest(m, n)
    keyed = reps.select("rep", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("rep", "n")).alias("leader")).where("m > 1")
    members = stage(keyed.join(shared, "key").where("rep <> leader.rep").select("key", "rep", "n", "leader"), "members")
    links = verified(members.where(may("leader.n", "n")).select(F.col("leader.rep").alias("a"), F.col("rep").alias("b")).distinct())
    found = components(links)

    left = _mixed(members.select("key", "rep", "n"), found)
    if left.isEmpty():
        return found
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("degree"))
    known = left.join(degree, "rep", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    best = known.groupBy("key").agg(F.max(F.struct("degree", "rep", "n", "c")).alias("best"))
    pairs = left.join(best, "key").where((F.col("c") != F.col("best.c")) & may("n", "best.n"))
    new = verified(pairs.select(F.least("rep", "best.rep").alias("a"), F.greatest("rep", "best.rep").alias("b")).distinct())
    if not new.isEmpty():
        links = stage(links.unionByName(new), "links")
        found = components(links)
        left = _mixed(left.select("key", "rep", "n"), found)

    few = left.where(F.col("m") <= SMALL)
    other = few.select("key", F.col("rep").alias("b"), F.col("n").alias("n2"), F.col("c").alias("c2"))
    pairs = few.withColumnRenamed("rep", "a").join(other, "key").where((F.col("a") < F.col("b")) & (F.col("c") != F.col("c2")) & may("n", "n2"))
    new = verified(pairs.select("a", "b").distinct())
    if not new.isEmpty():
        links = stage(links.unionByName(new), "links")
        found = components(links)
    left = left.where(F.col("m") > SMALL)
    if left.isEmpty():
        return found

    left = _mixed(left.select("key", "rep", "n"), found)
    firsts = left.groupBy("key").agg(F.min("rep").alias("b"))
    near = components(left.join(firsts, "key").select(F.col("rep").alias("a"), "b").distinct())
    members = left.groupBy("rep", "n", "c").agg(F.collect_set("key").alias("keys")).join(near, F.col("rep") == F.col("vertex")).withColumnRenamed("component_id", "g").drop("vertex")
    members = stage(members, "crowded")
    full = members.join(texts.sets(members.select("rep")), "rep")
    sizes = members.groupBy("g").agg(F.count("*").alias("size"))
    cells = in_cells(full.join(sizes, "g"), "g", "rep", F.col("size"), BLOCK).select("g", "i", "j", "block", "rep", "c", "n", "keys", "shingles")
    new = stage(cells.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(_cell_links(percent), "a long, b long"), "crossed")
    return found if new.isEmpty() else components(links.unionByName(new))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest reachable doc_id), kept.

    docs has doc_id and text. Equal sets become one class with a number of its own.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage(docs.mapInArrow(_sign(width, bands, rows), _SIGNATURE).withColumn("row", F.monotonically_increasing_id()), "signed")
    has_set = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    # a class goes by the number of one of its rows; as it is written, the number stays
    classes = stage(signed.where(has_set).groupBy(*_SET).agg(F.min("row").alias("rep"), F.min("doc_id").alias("least")), "classes")
    reps = stage(signed.join(classes.select("rep"), F.col("row") == F.col("rep"), "left_semi").select(F.col("row").alias("rep"), "doc_id", F.col("n_shingles").alias("n"), "set_a", "set_b", "bands", "sketch"), "reps")
    counts = signed.agg(F.count("*"), F.count_distinct("doc_id")).first()
    texts = _Texts(docs, reps.select("rep", "doc_id", "set_a", "set_b", F.col("n").alias("n_shingles")), width, counts[0] > counts[1])
    found = _linked_classes(texts, reps, percent, bands * rows)

    own = classes.join(found.withColumnRenamed("vertex", "rep"), "rep", "left").select(*_SET, "least", F.coalesce("component_id", "rep").alias("component"))
    own = stage(own, "own")
    first = own.groupBy("component").agg(F.min("least").alias("component_id"))
    out = signed.select("doc_id", *_SET).join(own.join(first, "component").select(*_SET, "component_id"), _SET, "left")
    component = F.when(has_set, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def unique_documents(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, whole, that near_duplicates() keeps. Rows with one doc_id stay or go together: they go if none is kept."""
    gone = near_duplicates(docs, width, percent).groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept").select("doc_id")
    return docs.join(small(stage(gone, "gone")), "doc_id", "left_anti").select(*docs.columns)
