"""Path, name and address expressions. All of them stay inside the JVM."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that open a device on some hosts whatever their extension.
DEVICES = ["CON", "PRN", "AUX", "NUL", "CONIN$", "CONOUT$"]
_NUMBERED = r"(?i)^(COM|LPT)[1-9]$"


def path_key(rel: Column) -> Column:
    """ASCII fold only: lower() would also fold letters that the tools keep apart."""
    return F.translate(rel, string.ascii_uppercase, string.ascii_lowercase)


def _parts(rel: Column) -> Column:
    return F.split(rel, "/", -1)


def is_device(part: Column, trimmed: bool = True) -> Column:
    """Whether a name's stem, with or without the blanks at its end, is a reserved device."""
    stem = F.split_part(part, F.lit("."), F.lit(1))
    stem = F.rtrim(stem) if trimmed else stem
    return F.upper(stem).isin(DEVICES) | stem.rlike(_NUMBERED)


def bad_rel(rel: Column) -> Column:
    """Why a relative path is refused, or null."""
    slashed = F.replace(rel, F.lit("\\"), F.lit("/"))
    part = lambda test: F.exists(_parts(slashed), test)
    rules = [
        ("empty", slashed == ""),
        ("trailing separator", slashed.endswith("/")),
        ("drive prefix", slashed.rlike("^[A-Za-z]:")),
        ("absolute", slashed.startswith("/")),
        ("parent", part(lambda p: p == "..")),
        ("trailing dot or space", part(lambda p: (p != ".") & p.rlike(r"[. ]$"))),
        ("stream", slashed.contains(":")),
        ("device name", part(lambda p: is_device(p))),
        ("names nothing", F.size(F.filter(_parts(slashed), lambda p: ~p.isin("", "."))) == 0),
    ]
    return reduce(lambda rest, rule: F.when(rule[1], rule[0]).otherwise(rest), reversed(rules), F.lit(None).cast("string"))


def clean_rel(rel: Column) -> Column:
    """The plain form of a path that bad_rel() accepts: forward slashes, no `.` parts."""
    parts = F.filter(_parts(F.replace(rel, F.lit("\\"), F.lit("/"))), lambda p: ~p.isin("", "."))
    return F.when(bad_rel(rel).isNull(), F.array_join(parts, "/"))


def path_rule(path: Column, allow_device: bool = False) -> Column:
    """Id of the first rule that a bundle path breaks, or null."""
    part = lambda test: F.exists(_parts(path), test)
    rules = [
        ("path.empty", path == ""),
        ("path.control", path.rlike(r"\p{Cc}")),
        ("path.backslash", path.contains("\\")),
        ("path.absolute", path.startswith("/")),
        ("path.drive", path.contains(":")),
        ("path.parent", part(lambda p: p == "..")),
        ("path.dot-component", part(lambda p: p == ".")),
        ("path.windows-fold", part(lambda p: p.rlike(r"[. ]$"))),
        *([] if allow_device else [("path.device", part(lambda p: is_device(p, trimmed=False)))]),
        ("path.empty-component", part(lambda p: p == "")),
    ]
    return reduce(lambda rest, rule: F.when(rule[1], rule[0]).otherwise(rest), reversed(rules), F.lit(None).cast("string"))


def escape_devices(path: Column) -> Column:
    """A spelling of the path that opens no device: such a part gets a % before it, and in all others each % is doubled.
    unescape_devices() undoes it."""
    one = lambda p: F.when(is_device(p, trimmed=False), F.concat(F.lit("%"), p)).otherwise(F.replace(p, F.lit("%"), F.lit("%%")))
    return F.array_join(F.transform(_parts(path), one), "/")


def unescape_devices(path: Column) -> Column:
    one = lambda p: F.when(p.rlike("^%(?!%)"), F.substring(p, F.lit(2), F.length(p))).otherwise(F.replace(p, F.lit("%%"), F.lit("%")))
    return F.array_join(F.transform(_parts(path), one), "/")


def percent_encode(text: Column) -> Column:
    """Only what would break a line or a field: % first, then blank, tab, CR and LF."""
    return reduce(lambda s, r: F.replace(s, F.lit(r[0]), F.lit(r[1])), [("%", "%25"), (" ", "%20"), ("\t", "%09"), ("\r", "%0D"), ("\n", "%0A")], text)


def percent_decode(text: Column) -> Column:
    return reduce(lambda s, r: F.replace(s, F.lit(r[1]), F.lit(r[0])), [(" ", "%20"), ("\t", "%09"), ("\r", "%0D"), ("\n", "%0A"), ("%", "%25")], text)


def encode_component(text: Column) -> Column:
    """RFC 3986: unreserved characters stay, every other byte is %XX."""
    return reduce(lambda s, r: F.replace(s, F.lit(r[0]), F.lit(r[1])), [("+", "%20"), ("*", "%2A"), ("%7E", "~")], F.url_encode(text))


def join_address(prefix: Column, name: Column) -> Column:
    """prefix/name with one slash between."""
    return F.concat(F.rtrim(prefix, F.lit("/")), F.lit("/"), name)


def ancestors(rel: Column) -> Column:
    """All proper prefixes of a path, shortest first."""
    depth = F.size(_parts(rel)) - 1
    return F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(_parts(rel), F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def depth(rel: Column) -> Column:
    return F.size(_parts(rel))


def within(child: Column, parent: Column, fold: bool = False) -> Column:
    """Containment by component; fold: on a disk that matches ASCII case."""
    child, parent = (path_key(child), path_key(parent)) if fold else (child, parent)
    return (child == parent) | child.startswith(F.concat(F.rtrim(parent, F.lit("/")), F.lit("/")))


def field_rule(value: Column) -> Column:
    """Rule that a manifest field breaks, or null: a bundle path of one part."""
    return F.coalesce(path_rule(value), F.when(value.contains("/"), "field.multi-component"))


def chunk_id_rule(value: Column) -> Column:
    """Rule that a chunk id breaks, or null: <16 hex digits>_<32 hex digits>."""
    return F.when(value == "", "chunk-id.empty").when(~value.rlike(r"\A[0-9A-Fa-f]{16}_[0-9A-Fa-f]{32}\z"), "chunk-id.shape")


def tag_rule(value: Column, allow_device: bool = False) -> Column:
    """Id of the first rule that a version tag breaks, or null. Tags from a server may name a device, which is escaped on disk."""
    rules = [
        ("tag.empty", value == ""),
        ("tag.too-long", F.octet_length(value) > 32),
        ("tag.control", value.rlike(r"\p{Cc}")),
        ("tag.separator", value.rlike(r"[/\\ ]")),
        ("tag.drive", value.contains(":")),
        ("tag.windows-character", value.rlike(r'[*?"<>|]')),
        ("tag.edge-dot", value.startswith(".") | value.endswith(".")),
        *([] if allow_device else [("tag.device", is_device(value, trimmed=False))]),
    ]
    return reduce(lambda rest, rule: F.when(rule[1], rule[0]).otherwise(rest), reversed(rules), F.lit(None).cast("string"))


def split_manifest_id(value: Column) -> Column:
    """struct(prefix, checksum) of <16 hex>_<32 hex>, null when it has another shape."""
    found = value.rlike("^[0-9A-Fa-f]{16}_[0-9A-Fa-f]{32}$")
    return F.when(found, F.struct(F.lower(F.split_part(value, F.lit("_"), F.lit(1))).alias("prefix"), F.lower(F.split_part(value, F.lit("_"), F.lit(2))).alias("checksum")))


def staleness(branch: Column, legacy: Column) -> Column:
    """Difference of major versions; null if negative or not numeric."""
    major = lambda v: F.split_part(v, F.lit("."), F.lit(1)).try_cast("bigint")
    d = major(branch) - major(legacy)
    return F.when(d >= 0, d)


def audio_token(text: Column) -> Column:
    return F.replace(path_key(F.trim(text)), F.lit("_"), F.lit("-"))


def field_rank(field: Column) -> Column:
    """Sort key: the field `game` first, then by name."""
    return F.struct((field != "game").alias("other"), field.alias("name"))


def hex_digest(text: Column) -> Column:
    """Bytes of a hex digest of either case; null when it isn't one."""
    return F.try_to_binary(text, F.lit("hex"))
