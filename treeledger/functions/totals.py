"""Byte totals that saturate, digests of slices, ranges."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = Decimal(18446744073709551615)


def at_least_0(x: Column) -> Column:
    return F.greatest(x, F.lit(0).cast("long"))


def saturating_sum(x: Column) -> Column:
    """Sum of what is over 0, at most the largest unsigned 64-bit number; 0 over no rows."""
    return F.least(F.coalesce(F.sum(at_least_0(x).cast("decimal(20,0)")), F.lit(0)), F.lit(U64)).cast("decimal(20,0)")


def slice_md5(content: Column, offset: Column, length: Column) -> Column:
    """MD5 of the bytes there; a short slice digests what is there."""
    return F.md5(F.substring(content, (offset + 1).cast("int"), length.cast("int")))


def slice_matches(content: Column, wanted: Column) -> Column:
    """Whether the bytes (of a text: the characters) at a struct(offset, length, md5) have that digest; past the end, of no content
    or no struct: no."""
    inside = wanted["offset"] + wanted["length"] <= F.length(content)
    return F.coalesce(inside & (slice_md5(content, wanted["offset"], wanted["length"]) == F.lower(wanted["md5"])), F.lit(False))


def range_end(start: Column, length: Column) -> Column:
    """Null when it overflows."""
    return F.try_add(start, length)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_start) & (b_end <= a_end)


def gap_between(a_end: Column, b_start: Column) -> Column:
    return F.when(b_start > a_end, b_start - a_end)


def is_inverted(start: Column, end: Column) -> Column:
    return end < start


def is_empty(start: Column, end: Column) -> Column:
    """Holds nothing; an inverted range holds nothing either."""
    return end <= start


def gzipped(size: Column, threshold: int) -> Column:
    """Whether a document of that size is stored compressed."""
    return size > threshold


def capped(text: Column, most: int) -> Column:
    """The longest start of a text that has at most so many UTF-8 bytes; no character is cut in two."""
    data = F.encode(text, "utf-8")
    # a character ends at byte n unless the byte after it goes on with it; it has four bytes at most
    goes_on = lambda n: F.hex(F.substring(data, n + 1, 1)).between("80", "BF")
    end = F.lit(max(0, most - 3))
    for n in range(max(0, most - 2), most + 1):
        end = F.when(~goes_on(n), F.lit(n)).otherwise(end)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(data, F.lit(1), end), "utf-8"))
