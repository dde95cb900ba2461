"""Masking functions (M1-M5) as native column expressions.

Every function returns a string column; null stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col, is_blank

# Fixed output tokens.
REDACTED = "[REDACTED]"
MASKED = "[MASKED]"


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), F.greatest(n, F.lit(0)))


def mask_email(c: Column | str, mask_short: bool = False) -> Column:
    """M1: keep the first and last character of the local part, star the rest.

    Split at the first ``@``.  A local part of one or two characters keeps its
    first character (so a one-character local part is shown as is unless
    ``mask_short``).  Missing, blank, ``@``-less values and an empty local part
    are returned unchanged.
    """
    s = as_col(c).cast("string")
    local = F.substring_index(s, "@", 1)
    n = F.length(local)
    at = F.instr(s, "@")
    domain_with_at = F.substring(s, at, F.length(s))
    first = F.left(local, F.lit(1))
    short = F.concat(first, _stars(n - 1), domain_with_at)
    if mask_short:
        short = F.when(n == 1, F.concat(F.lit("*"), domain_with_at)).otherwise(short)
    long = F.concat(first, _stars(n - 2), F.right(local, F.lit(1)), domain_with_at)
    return (
        F.when(is_blank(s) | (at == 0) | (n == 0), s)
        .when(n <= 2, short)
        .otherwise(long)
    )


def mask_phone(c: Column | str) -> Column:
    """M2: keep digits and ``+``; show the first two and last two, star the rest.

    Four characters or fewer become all stars.  Missing or blank is unchanged.
    Only ASCII digits count as digits.
    """
    p = as_col(c).cast("string")
    s = F.regexp_replace(p, r"[^0-9+]", "")
    n = F.length(s)
    masked = F.when(n <= 4, _stars(n)).otherwise(
        F.concat(F.left(s, F.lit(2)), _stars(n - 4), F.right(s, F.lit(2)))
    )
    return F.when(is_blank(p), p).otherwise(masked)


def hash_value(c: Column | str, salt: str = "", hex_len: int = 12) -> Column:
    """M3: first ``hex_len`` hex digits of SHA-256 over ``str(value) + salt``.

    The default 12 digits (48 bits) collide from roughly 2**24 distinct values;
    raise ``hex_len`` (up to 64) for large identifier sets.
    """
    s = as_col(c).cast("string")
    return F.when(s.isNotNull(), F.substring(F.sha2(F.concat(s, F.lit(salt)), 256), 1, hex_len))


def redact(c: Column | str) -> Column:
    """M4: any non-blank value becomes ``[REDACTED]``."""
    s = as_col(c).cast("string")
    return F.when(is_blank(s), s).otherwise(F.lit(REDACTED))


def mask_column(c: Column | str) -> Column:
    """M5: any present value (blank included) becomes ``[MASKED]``."""
    s = as_col(c).cast("string")
    return F.when(s.isNotNull(), F.lit(MASKED))


def mask_domain_only(c: Column | str) -> Column:
    """Show only the e-mail domain."""
    s = as_col(c).cast("string")
    return F.when(s.contains("@"), F.substring_index(s, "@", -1)).otherwise(s)
