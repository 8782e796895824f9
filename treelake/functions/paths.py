"""Path expressions and glob patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a pattern must escape in a regular expression.
REGEX_SPECIAL = ".\\*?[](){}^$+"


def parts(path: Column) -> Column:
    return F.split(path, "/")


def ancestors(path: Column) -> Column:
    """A path's ancestors and itself, from the root '': '/a/b' gives '', '/a', '/a/b'."""
    return F.transform(F.sequence(F.lit(1), F.size(parts(path))), lambda i: F.array_join(F.slice(parts(path), F.lit(1), i), "/"))


def parent(path: Column) -> Column:
    return F.when(path == "", None).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def depth(path: Column) -> Column:
    return F.size(parts(path)) - 1


def below(path: Column, top: Column) -> Column:
    """Whether path is top or lies below it, on whole components."""
    return F.startswith(F.concat(path, F.lit("/")), F.concat(top, F.lit("/")))


def glob_regex(pattern: str, relaxed: bool = False, prefix: bool = False) -> str:
    """Anchored regular expression of a glob: '*' stays within a component unless relaxed, '?' always does."""
    out, literal = "^", False
    for c in pattern:
        if literal:
            out, literal = out + ("\\" + c if c in REGEX_SPECIAL else c), False
        elif c == "\\":
            literal = True
        elif c == "*":
            out += ".*" if relaxed else "[^/]*"
        elif c == "?":
            out += "[^/]"
        else:
            out += "\\" + c if c in REGEX_SPECIAL else c
    return out + ("($|/.*$)" if prefix else "/?$")
