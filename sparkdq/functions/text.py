"""Small string helpers shared by the column functions (all native expressions)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK_RE = r"^\s*$"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Strip leading/trailing white space (Spark ``trim`` strips spaces only)."""
    return F.regexp_replace(as_col(c), r"^\s+|\s+$", "")


def is_blank(c: Column | str) -> Column:
    """True for null or white-space-only strings."""
    c = as_col(c)
    return c.isNull() | c.rlike(BLANK_RE)


def python_repl_to_java(repl: str) -> str:
    """Translate a Python ``re.sub`` replacement into a Java one.

    ``\\1``, ``\\12`` and ``\\g<1>`` become ``$`` references, ``\\g<name>`` a
    named one; a digit that follows a reference stays a character of its own
    and a literal ``$`` is escaped.
    """
    def one(m: re.Match) -> str:
        if m["name"]:
            return "${" + m["name"] + "}"
        number, digit = (m["number"], m["after"]) if m["number"] else (m["short"], m["behind"])
        return "\\$" if number is None else f"${number}" + (f"\\{digit}" if digit else "")

    return re.sub(r"\\g<(?P<number>\d+)>(?P<after>\d?)|\\g<(?P<name>[A-Za-z_]\w*)>|\\(?P<short>\d{1,2})(?P<behind>\d?)|\$", one, repl)


def python_pattern_to_java(pattern: str) -> str:
    """Named groups and references of a Python pattern in Java's spelling."""
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))
