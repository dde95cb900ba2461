"""Validity predicates as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col

# Fixed values that must equal the reference's behaviour.
# E-mail shape: matched from the start of the value only (not anchored at the end).
EMAIL_RE = r"^[^@]+@[^@]+\.[^@]+"
# Re-aimed phone validity: after removing space, parentheses, dot and dash the
# value must be an E.164-shaped number (leading +, 7 to 15 digits).
PHONE_STRIP_RE = r"[\s().-]"
PHONE_E164_RE = r"^\+[1-9][0-9]{6,14}\z"
# Written-policy phone character set: digits, spaces, dashes, parentheses.  ``\z`` (not ``$``,
# which in Java also matches before a final line break) so a trailing newline fails.
PHONE_CHARS_RE = r"^[0-9 ()\-]+\z"


def email_valid(c: Column | str) -> Column:
    """V1: true when the value matches the e-mail shape; missing is invalid."""
    return F.coalesce(as_col(c).cast("string").rlike(EMAIL_RE), F.lit(False))


def phone_ok(c: Column | str) -> Column:
    """V3 (re-aimed): E.164-shaped after stripping separators; missing is invalid.

    Number-plan metadata (region validity) is not reproduced: a value passes when
    it has a leading ``+`` and 7-15 digits once separators are removed.
    """
    s = F.regexp_replace(as_col(c).cast("string"), PHONE_STRIP_RE, "")
    return F.coalesce(s.rlike(PHONE_E164_RE), F.lit(False))


def phone_chars_ok(c: Column | str) -> Column:
    """Only digits, spaces, dashes and parentheses; missing is not judged (null)."""
    return as_col(c).cast("string").rlike(PHONE_CHARS_RE)


def date_in_future(c: Column | str, as_of: str) -> Column:
    """The text parses as a date after ``as_of`` (unparsable -> null)."""
    return F.try_to_date(as_col(c).cast("string")) > F.lit(as_of).cast("date")


def not_numeric(c: Column | str) -> Column:
    """T4: present but not castable to double."""
    c = as_col(c)
    return c.isNotNull() & c.cast("string").try_cast("double").isNull()
