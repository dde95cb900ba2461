"""Registered queries: profiling and validity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..sources.tables import TABLES, fixture, fixture_ctes, read_table
from .registry import register

DC_COLS = ("id", "name", "email", "phone", "signup_date", "price")


def _null_cond(c: str) -> str:
    return f"({c} IS NULL OR isnan({c}))" if c == "price" else f"{c} IS NULL"


def _profile_sql(rel: str) -> str:
    """The long profile of a relation with dirty_customer's columns."""
    aggs = ["count(*) AS n"]
    for c in DC_COLS:
        aggs.append(f"count(*) FILTER (WHERE {_null_cond(c)}) AS nn_{c}")
    aggs.append("count(*) FILTER (WHERE NOT coalesce(regexp_matches(email, '^[^@]+@[^@]+\\.[^@]+'), false)) AS inv_email")
    aggs.append("count(*) FILTER (WHERE price < 0) AS neg_price")
    parts = ["SELECT CAST(NULL AS VARCHAR) AS \"column\", 'num_rows' AS metric, CAST(n AS DOUBLE) AS value FROM agg"]
    for c in DC_COLS:
        parts.append(f"SELECT '{c}', 'null_count', CAST(nn_{c} AS DOUBLE) FROM agg")
        parts.append(f"SELECT '{c}', 'null_percent', CAST(nn_{c} AS DOUBLE) / n FROM agg")
    parts.append("SELECT 'email', 'email_invalid_count', CAST(inv_email AS DOUBLE) FROM agg")
    parts.append("SELECT 'price', 'negative_count', CAST(neg_price AS DOUBLE) FROM agg")
    parts.append("SELECT NULL, 'dup_rows', CAST(coalesce(sum(n - 1), 0) AS DOUBLE) FROM "
                 f"(SELECT *, count(*) AS n FROM {rel} GROUP BY ALL) g")
    return f"WITH agg AS (SELECT {', '.join(aggs)} FROM {rel})\n" + "\nUNION ALL ".join(parts)


def _profile_oracle() -> str:
    return fixture_ctes("dirty_customer") + f"SELECT * FROM ({_profile_sql('dirty_customer')}) p"


@register("p_profile", _profile_oracle())
def p_profile(spark, sf_dir):
    """Long profile of dirty_customer."""
    return P.profile(fixture(spark, sf_dir, "dirty_customer"))


def _pii_sql(rel: str) -> str:
    """The personal-data profile of a relation with dirty_customer's columns."""
    from ..operators.signals import DATE_RE, DEFAULT_GAZETTEER

    gaz = ", ".join(f"('{w}', '{c}')" for c, ws in DEFAULT_GAZETTEER.items() for w in ws)
    vals = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM {rel} "
                              f"WHERE {c} IS NOT NULL" for c in DC_COLS)
    date_re = DATE_RE.replace("'", "''")
    aggs = ["count(*) AS n"] + [f"count(*) FILTER (WHERE {_null_cond(c)}) AS nn_{c}" for c in DC_COLS]
    aggs.append("count(*) FILTER (WHERE NOT coalesce(regexp_matches(email, '^[^@]+@[^@]+\\.[^@]+'), false)) AS inv_email")
    aggs.append("count(*) FILTER (WHERE NOT coalesce(regexp_matches(regexp_replace(phone, '[\\s().-]', '', 'g'), "
                "'^\\+[1-9][0-9]{6,14}$'), false)) AS inv_phone")
    aggs.append("count(*) FILTER (WHERE price < 0) AS neg_price")
    parts = ["SELECT CAST(NULL AS VARCHAR) AS \"column\", 'num_rows' AS metric, CAST(n AS DOUBLE) AS value FROM agg"]
    parts += [f"SELECT '{c}', 'null_count', CAST(nn_{c} AS DOUBLE) FROM agg" for c in DC_COLS]
    parts.append("SELECT 'email', 'email_invalid_count', CAST(inv_email AS DOUBLE) FROM agg")
    parts.append("SELECT 'phone', 'phone_invalid_count', CAST(inv_phone AS DOUBLE) FROM agg")
    parts.append("SELECT 'price', 'negative_count', CAST(neg_price AS DOUBLE) FROM agg")
    parts.append("SELECT \"column\", concat('ner_', class), CAST(n AS DOUBLE) FROM ent")
    parts.append("SELECT \"column\", 'risk_score', CAST(least(p * 5 + (g + l) * 4 + d * 4 "
                 "+ CASE WHEN contains(\"column\", 'mail') THEN 10 ELSE 0 END, 100) AS DOUBLE) FROM risk")
    return ("WITH agg AS (SELECT " + ", ".join(aggs) + f" FROM {rel}),\n"
            f"v AS ({vals}),\n"
            "present AS (SELECT DISTINCT \"column\" FROM v WHERE NOT regexp_matches(value, '^\\s*$')),\n"
            f"dates AS (SELECT \"column\", 'DATE' AS class, sum(len(regexp_extract_all(value, '{date_re}'))) AS n FROM v GROUP BY 1),\n"
            "w AS (SELECT \"column\", unnest(regexp_extract_all(lower(value), '\\p{L}+')) AS word FROM v),\n"
            f"named AS (SELECT \"column\", gaz.class, count(*) AS n FROM w JOIN (VALUES {gaz}) AS gaz(word, class) "
            "ON w.word = gaz.word GROUP BY ALL),\n"
            "counts AS (SELECT * FROM dates UNION ALL SELECT * FROM named),\n"
            "ent AS (SELECT p.\"column\", c.class, coalesce(x.n, 0) AS n FROM present p "
            "CROSS JOIN (VALUES ('PERSON'), ('GPE'), ('LOC'), ('DATE')) AS c(class) "
            "LEFT JOIN counts x ON x.\"column\" = p.\"column\" AND x.class = c.class),\n"
            "cols AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}')" for c in DC_COLS) + ") AS t(\"column\")),\n"
            "risk AS (SELECT cols.\"column\", coalesce(sum(CASE WHEN class = 'PERSON' THEN n END), 0) AS p, "
            "coalesce(sum(CASE WHEN class = 'GPE' THEN n END), 0) AS g, coalesce(sum(CASE WHEN class = 'LOC' THEN n END), 0) AS l, "
            "coalesce(sum(CASE WHEN class = 'DATE' THEN n END), 0) AS d FROM cols LEFT JOIN ent ON ent.\"column\" = cols.\"column\" "
            "GROUP BY cols.\"column\")\n"
            + "\nUNION ALL ".join(parts))


def _pii_oracle() -> str:
    return fixture_ctes("dirty_customer") + f"SELECT * FROM ({_pii_sql('dirty_customer')}) p"


@register("p_profile_pii", _pii_oracle())
def p_profile_pii(spark, sf_dir):
    """P9 (with D1, D3): personal-data profile of dirty_customer in long form."""
    return P.profile_pii(fixture(spark, sf_dir, "dirty_customer"))
