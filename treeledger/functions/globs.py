"""Globs as anchored regular expressions, compiled on the driver and matched by rlike."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeledger.functions.paths import ancestors


def to_regex(glob: str, fold: bool = True, escapes: bool = False) -> str:
    """`*` crosses `/`, `?` is one character, [..] a set. escapes: a backslash quotes, otherwise it separates."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while glob[i : i + 2] == "**":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end]
            negated = body[:1] in "!^"
            out.append("[" + "^" * negated + body[negated:].replace("\\", r"\\").replace("[", r"\[").replace("&", r"\&") + "]")
            i = end
        elif c == "\\":
            if escapes and i + 1 < len(glob):
                i += 1
                out.append(re.escape(glob[i]))
            else:
                out.append("/")
        else:
            out.append(re.escape(c))
        i += 1
    return f"{'(?i)' * fold}(?s)^{''.join(out)}$"


def _any(path: Column, globs: list[str], **how: bool) -> Column:
    found = F.lit(False)
    for g in globs:
        found = found | path.rlike(to_regex(g, **how))
    return found


def in_scope(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Visible: an include matches or there is none, and no exclude matches."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    return (_any(path, include) if include else F.lit(True)) & ~_any(path, exclude)


def kept_by_filter(path: Column, include: list[str], exclude: list[str], fold: bool = True) -> Column:
    """As in_scope(), but an excluded ancestor hides what is below it; includes match the path itself."""
    how = {"fold": fold, "escapes": True}
    hidden = _any(path, exclude, **how) | F.exists(ancestors(path), lambda a: _any(a, exclude, **how))
    return (_any(path, include, **how) if include else F.lit(True)) & ~hidden
