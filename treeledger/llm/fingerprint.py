"""Canonical exact fingerprints of documents, in DataFrame operations only.

A text is normalised (NFKC by the ICU library that Spark brings), case-folded and its white space is
folded to single spaces; two 64-bit xxhash values of that are its bucket. Where a bucket has
more than one member, the canonical bytes themselves are compared: texts that share a
bucket but not the bytes get different fingerprints (a number is appended).

Defined results: a null text is the empty text. Documents are in order of doc_id, null first, then text; after the
last comes the first, so one document alone is followed by itself. Repeated rows are rows of their own.
The likeness of exact fingerprints is 1 or 0. A very long text is a value like any other. Other columns of the input
are not read. Normalisation and case folding are calls of a Java method by name, once a text (twice if it isn't ASCII):
that is outside generated code, but no text leaves the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeledger.llm.staging import partitions, small, stage

_ICU = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"


def canonical(text: Column) -> Column:
    """Normalised, case-folded, white space folded and trimmed."""
    composed = lambda x: F.java_method(F.lit(_ICU[0]), F.lit("compose"), x, F.lit(True))
    folded = F.java_method(F.lit(_ICU[1]), F.lit("foldCase"), composed(text), F.lit(True))
    plain = F.octet_length(text) == F.char_length(text)
    return F.trim(F.regexp_replace(F.when(plain, F.lower(text)).otherwise(composed(folded)), r"[\p{IsWhite_Space}]+", " "))


def _digest(canon: Column, bits: int) -> Column:
    """Two hashes of a canonical text; fewer bits only serve tests of unequal texts in equal buckets."""
    both = F.xxhash64(canon), F.xxhash64(F.lit("second"), canon)
    return F.struct(*[(h if bits == 64 else F.pmod(h, F.lit(1 << bits))).alias(n) for n, h in zip(("x", "y"), both, strict=True)])


def _edited(text: Column, following: Column) -> Column:
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def _longs(values: list[int]) -> Column:
    """A constant array: one literal in the plan, however long it is."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _bucket(key: Column, bounds: list[int]) -> Column:
    """Number of the bounds that are at most key, by way of about sqrt(n) groups of them."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    count = lambda of: F.size(F.filter(of, lambda b: b <= key))
    group = count(_longs(bounds[::step]))
    inner = F.slice(_longs(bounds), F.greatest(group - 1, F.lit(0)) * step + 1, F.lit(step))
    return F.when(key.isNull() | (group == 0), 0).otherwise((group - 1) * step + count(inner))


def _with_following(docs: DataFrame, digest: Column) -> DataFrame:
    """Each document with the one after it, both as structs of doc_id, text and digest. Documents are dealt to ranges of
    doc_id of like size, so no task orders them all. What follows the last of a range is looked up by its doc_id."""
    n = 4 * partitions(docs.sparkSession)
    found = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] or []
    ranged = docs.withColumn("range", _bucket(F.col("doc_id"), sorted(set(found))))
    # one number a range from here; in a struct null comes first, as in the order of documents
    firsts = ranged.groupBy("range").agg(F.min(F.struct("doc_id")).alias("first"))
    across = Window.orderBy("range")
    everything = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = stage(firsts.select("range", F.coalesce(F.lead("first").over(across), F.first("first").over(everything))["doc_id"].alias("next_id")), "after")
    doc = F.struct("doc_id", "text", "digest")
    looked_up = docs.alias("d").join(small(after).alias("a"), F.col("d.doc_id").eqNullSafe(F.col("a.next_id"))).groupBy("a.range").agg(F.min(F.struct("d.doc_id", "d.text")).alias("first"))
    looked_up = looked_up.select("range", "first.*").withColumn("digest", digest).select("range", doc.alias("after"))
    own = Window.partitionBy("range").orderBy("doc_id", "text")
    led = ranged.withColumn("digest", digest).select("range", doc.alias("own"), F.lead(doc).over(own).alias("following"))
    return led.join(looked_up, "range").select("own", F.coalesce("following", "after").alias("following"))


def fingerprints(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one row per row of docs
    (doc_id, text). The edited text has its last half replaced by the start of the next document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    edited = _edited(F.col("own.text"), F.col("following.text"))
    pairs = _with_following(docs, _digest(canonical(F.col("text")), bits))
    pairs = pairs.select("own.doc_id", F.col("following.doc_id").alias("next_id"), F.char_length("own.text").cast("long").alias("n_chars"), F.col("own.digest").alias("digest"), F.col("following.digest").alias("next_digest"), edited.alias("edited"))
    table = stage(pairs.select("doc_id", "next_id", "n_chars", "digest", "next_digest", F.sha2("edited", 256).alias("edited_sha256"), _digest(canonical(F.col("edited")), bits).alias("edited_digest")), "digests")
    split = _split(docs, table, bits)
    hex_ = lambda d: F.lower(F.concat(*[F.lpad(F.hex(F.col(f"{d}.{k}")), 16, "0") for k in "xy"]))
    if split is None:
        named = table.withColumns({"fingerprint": hex_("digest"), "edited_fingerprint": hex_("edited_digest"), "next_fingerprint": hex_("next_digest")})
    else:
        named = table
        for name, digest, edited_kind, ids in (("fingerprint", "digest", False, ("doc_id",)), ("edited_fingerprint", "edited_digest", True, ("doc_id", "next_id")), ("next_fingerprint", "next_digest", False, ("next_id",))):
            of = split.where(F.col("is_edited") == edited_kind).select(*[F.col(k).alias(f"_{k}") for k in ("doc_id", "next_id")], F.col("digest").alias("_digest"), "number").distinct()
            if not edited_kind:
                of = of.drop("_next_id").distinct()
            same = F.col(digest) == F.col("_digest")
            for column, key in zip(ids, ("_doc_id", "_next_id"), strict=False):
                same = same & F.col(column).eqNullSafe(F.col(key))
            number = F.when(F.col("number") > 1, F.concat(F.lit("-"), F.col("number") - 1)).otherwise("")
            named = named.join(of, same, "left").withColumn(name, F.concat(hex_(digest), number)).select(*named.columns, name)
    like = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    return named.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"))


def _split(docs: DataFrame, table: DataFrame, bits: int) -> DataFrame | None:
    """Buckets whose members' canonical bytes differ: is_edited, doc_id, next_id, digest, number of the bytes. None: no such bucket."""
    kinds = F.array(F.struct(F.lit(False).alias("is_edited"), F.col("digest")), F.struct(F.lit(True).alias("is_edited"), F.col("edited_digest").alias("digest")))
    every = table.select("doc_id", "next_id", F.explode(kinds).alias("k")).select("doc_id", "next_id", "k.*")
    shared = every.groupBy("digest").count().where("count > 1").select("digest")
    members = stage(every.join(shared, "digest"), "members")
    own = small(stage(members.where("not is_edited").select("doc_id", "digest").distinct(), "own")).alias("m")
    edited = small(stage(members.where("is_edited").select("doc_id", "next_id", "digest").distinct(), "edited")).alias("m")
    d, e = docs.alias("d"), docs.alias("e")
    # of repeated ids those whose hash is the member's are meant
    plain = d.join(own, F.col("d.doc_id").eqNullSafe(F.col("m.doc_id"))).select(F.lit(False).alias("is_edited"), "d.doc_id", F.lit(None).cast("long").alias("next_id"), "digest", canonical(F.col("d.text")).alias("canon"))
    half = d.join(edited, F.col("d.doc_id").eqNullSafe(F.col("m.doc_id"))).select("m.doc_id", "m.next_id", "digest", "text").alias("h")
    changed = e.join(half, F.col("e.doc_id").eqNullSafe(F.col("h.next_id"))).select(F.lit(True).alias("is_edited"), "h.doc_id", "h.next_id", "digest", canonical(_edited(F.col("h.text"), F.col("e.text"))).alias("canon"))
    texts = plain.unionByName(changed).where(_digest(F.col("canon"), bits) == F.col("digest"))
    # grouping by the bytes compares them; copies are one row after each task's own aggregation
    differ = stage(texts.groupBy("digest", "canon").agg(F.lit(1).alias("one")).groupBy("digest").count().where("count > 1").select("digest"), "differ")
    if differ.isEmpty():
        return None
    numbered = texts.join(small(differ), "digest").withColumn("number", F.dense_rank().over(Window.partitionBy("digest").orderBy("canon")))
    return stage(numbered.select("is_edited", "doc_id", "next_id", "digest", "number").distinct(), "split")
