"""Registered queries: masking (M1-M6), phone validity (V3), domain-only view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import masks as M
from ..operators.masks import apply_masks
from ..sources.tables import fixture, fixture_ctes
from .registry import register

DC = fixture_ctes("dirty_customer")

BLANK = "regexp_matches({c}, '^\\s*$')"


def _mask_email_sql(c: str) -> str:
    local = f"split_part({c}, '@', 1)"
    n = f"length({local})"
    dom = f"substr({c}, strpos({c}, '@'))"
    return (f"CASE WHEN {c} IS NULL OR {BLANK.format(c=c)} OR strpos({c}, '@') = 0 OR {n} = 0 THEN {c} "
            f"WHEN {n} <= 2 THEN concat(left({local}, 1), repeat('*', {n} - 1), {dom}) "
            f"ELSE concat(left({local}, 1), repeat('*', {n} - 2), right({local}, 1), {dom}) END")


def _mask_phone_sql(c: str) -> str:
    s = f"regexp_replace({c}, '[^0-9+]', '', 'g')"
    return (f"CASE WHEN {c} IS NULL OR {BLANK.format(c=c)} THEN {c} "
            f"WHEN length({s}) <= 4 THEN repeat('*', length({s})) "
            f"ELSE concat(left({s}, 2), repeat('*', length({s}) - 4), right({s}, 2)) END")


def _dc(spark, sf_dir):
    return fixture(spark, sf_dir, "dirty_customer")


@register("m_mask_email", DC + f"SELECT id, email, {_mask_email_sql('email')} AS masked FROM dirty_customer")
def m_mask_email(spark, sf_dir):
    """M1 over every e-mail of dirty_customer."""
    return _dc(spark, sf_dir).select("id", "email", M.mask_email("email").alias("masked"))


@register("m_mask_phone", DC + f"SELECT id, phone, {_mask_phone_sql('phone')} AS masked FROM dirty_customer")
def m_mask_phone(spark, sf_dir):
    """M2 over every phone of dirty_customer."""
    return _dc(spark, sf_dir).select("id", "phone", M.mask_phone("phone").alias("masked"))


@register("m_hash_name", DC + """
SELECT id, name, substr(sha256(concat(name, 's1')), 1, 12) AS hashed,
       substr(sha256(CAST(id AS VARCHAR)), 1, 16) AS id_hash FROM dirty_customer""")
def m_hash_name(spark, sf_dir):
    """M3: salted 12-digit name hash; unsalted 16-digit hash of a numeric column."""
    return _dc(spark, sf_dir).select("id", "name", M.hash_value("name", "s1").alias("hashed"),
                                     M.hash_value("id", "", 16).alias("id_hash"))


@register("m_redact", DC + f"""
SELECT id, CASE WHEN signup_date IS NULL OR {BLANK.format(c='signup_date')} THEN signup_date
                ELSE '[REDACTED]' END AS redacted,
       CASE WHEN phone IS NULL THEN NULL ELSE '[MASKED]' END AS masked
FROM dirty_customer""")
def m_redact(spark, sf_dir):
    """M4 and M5."""
    return _dc(spark, sf_dir).select("id", M.redact("signup_date").alias("redacted"),
                                     M.mask_column("phone").alias("masked"))


@register("m_apply_masks", DC + f"""
SELECT id, substr(sha256(name), 1, 12) AS name, {_mask_email_sql('email')} AS email,
       {_mask_phone_sql('phone')} AS phone, signup_date, price
FROM dirty_customer""")
def m_apply_masks(spark, sf_dir):
    """M6: an action list with an unknown action, an absent column and a no-op strategy."""
    actions = [
        {"action": "hash_name", "params": {"column": "name"}},
        {"action": "mask_email", "params": {"column": "email"}},
        {"action": "mask_email", "params": {"column": "phone", "strategy": "keep"}},
        {"action": "mask_phone", "params": {"column": "phone"}},
        {"action": "redact_address", "params": {"column": "address"}},
        {"action": "drop_table", "params": {"column": "price"}},
    ]
    return apply_masks(_dc(spark, sf_dir), actions)


@register("v_phone_valid", DC + """
SELECT id, phone, coalesce(regexp_matches(regexp_replace(phone, '[\\s().-]', '', 'g'), '^\\+[1-9][0-9]{6,14}$'), false) AS phone_ok,
       regexp_matches(phone, '^[0-9 ()\\-]+$') AS phone_chars_ok
FROM dirty_customer""")
def v_phone_valid(spark, sf_dir):
    """V3 (re-aimed E.164 shape) and T1 (allowed characters)."""
    return _dc(spark, sf_dir).select("id", "phone", C.phone_ok("phone").alias("phone_ok"),
                                     C.phone_chars_ok("phone").alias("phone_chars_ok"))


@register("t_email_domain", DC + """
SELECT id, CASE WHEN strpos(email, '@') > 0 THEN split_part(email, '@', -1) ELSE email END AS email_shown
FROM dirty_customer""")
def t_email_domain(spark, sf_dir):
    """Show only the e-mail domain."""
    return _dc(spark, sf_dir).select("id", M.mask_domain_only("email").alias("email_shown"))
