"""Grammars of identifiers and paths, and replay-safe parameters, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNRECOGNIZED = "~unrecognized"
#: The whole value must match. Paths have no empty, "." or ".." segment, code points are no surrogates and at most 10FFFF.
GRAMMARS = {
    "slug": "[a-z0-9][a-z0-9-]*",
    "dotted-slug": "[a-z0-9][a-z0-9.-]*",
    "fixture-path": "(?!\\.{1,2}(?:/|\\z))[A-Za-z0-9_.-]+(?:/(?!\\.{1,2}(?:/|\\z))[A-Za-z0-9_.-]+)*",
    "release-tag": "[A-Za-z0-9][A-Za-z0-9._-]*",
    "git-revision": "[0-9a-f]{40}",
    "code-point": "U\\+(?:(?!D[89A-F])[0-9A-F]{4}|0D[0-7][0-9A-F]{2}|0(?!D)[0-9A-F]{4}|[1-9A-F][0-9A-F]{4}|0{2}(?!D[89A-F])[0-9A-F]{4}|0[1-9A-F][0-9A-F]{4}|10[0-9A-F]{4})",
    "native-label": "~unrecognized|[A-Za-z0-9][A-Za-z0-9_.:-]*",
    "sha256": "sha256:[0-9a-f]{64}",
}


def fits(value: Column, grammar: str) -> Column:
    """Whether a value is of a grammar; null for null."""
    return value.rlike(f"\\A(?:{GRAMMARS[grammar]})\\z")


def safe_parameters(parameters: Column) -> Column:
    """Of a map of names to JSON values those with an alphanumeric name and a boolean or number."""
    number = r"\A(?:true|false|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\z"
    return F.map_filter(parameters, lambda k, v: k.rlike(r"\A[a-zA-Z][a-zA-Z0-9]*\z") & F.coalesce(v.rlike(number), F.lit(False)))
