"""Driver tables and derived fixture views.

The driver tables are Parquet files ``{sf_dir}/{name}.parquet``.  Fixture views
(``dirty_customer``, ``query_log``) are plain SQL over those tables; the same
SQL text is run by Spark here and by the oracle engine in
``sparkdq.plans.oracle`` so both sides start from identical rows.  Defects are
injected by expression over every row of the source table; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# dirty_customer: exact copies, near copies, missing values, malformed e-mails,
# odd phones, future / unparsable dates, negative and missing prices.
DC_BASE_SQL = """
SELECT c_custkey AS id,
       c_name AS name,
       CASE WHEN c_custkey % 11 = 0 THEN NULL
            WHEN c_custkey % 13 = 0 THEN concat('user', CAST(c_custkey AS STRING), '@example')
            WHEN c_custkey % 17 = 0 THEN '@no.local'
            ELSE concat(' User.', CAST(c_custkey AS STRING), '@Example.COM ') END AS email,
       CASE WHEN c_custkey % 9 = 0 THEN NULL
            WHEN c_custkey % 7 = 0 THEN concat('ext ', CAST(c_custkey % 100 AS STRING))
            WHEN c_custkey % 5 = 0 THEN concat('555-', lpad(CAST(c_custkey AS STRING), 7, '0'))
            ELSE concat('+1-202-', lpad(CAST(c_custkey AS STRING), 7, '0')) END AS phone,
       CASE WHEN c_custkey % 19 = 0 THEN '2999-01-01'
            WHEN c_custkey % 29 = 0 THEN 'not a date'
            ELSE concat('2023-', lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0'), '-15') END AS signup_date,
       CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_acctbal END AS price
FROM customer
"""

DIRTY_CUSTOMER_SQL = """
SELECT * FROM dc_base
UNION ALL SELECT * FROM dc_base WHERE id % 10 = 0
UNION ALL SELECT id, concat(name, ' II') AS name, email, phone, signup_date, price FROM dc_base WHERE id % 23 = 0
"""

# query_log: one SQL text per event, made of the event's own columns, a rewrite, and scan figures.
QUERY_LOG_SQL = """
SELECT event_id AS query_id,
       CASE WHEN user_id % 11 = 3 THEN '   '
         WHEN event_type = 'error' THEN concat('SELECT * FROM ', event_type, ' WHERE user_id > ', CAST(user_id AS STRING), ' ORDER BY props DESC')
         WHEN event_type = 'click' THEN concat('select a.x from ', event_type, ' a join b on a.k = b.k JOIN c on c.k = b.k where event_date = ', CAST(user_id AS STRING))
         WHEN event_type = 'view' THEN concat('SELECT props, Row_Number() OVER (ORDER BY x), percent_rank () OVER (ORDER BY x) FROM t WHERE props = ', props)
         WHEN event_type = 'signup' THEN concat('SELECT x FROM ', event_type, ' WHERE DATE(ts) = ', CAST(user_id AS STRING), ' AND CAST(z AS DATE) > 1 AND TO_DATE(y) = 2')
         ELSE concat('select  *', chr(10), 'from ', event_type, chr(10), 'inner join b on a.k = b.k', chr(10), 'where props = ', props, chr(10), 'and event_date > ', CAST(user_id AS STRING)) END AS original_sql,
       CASE WHEN event_type = 'error' THEN concat('SELECT user_id FROM error WHERE user_id > ', CAST(user_id AS STRING))
         WHEN event_type = 'purchase' THEN concat('select a.x', chr(10), 'from purchase', chr(10), 'inner join b on a.k = b.k', chr(10), 'where event_date > ', CAST(user_id AS STRING))
         WHEN event_type = 'signup' THEN NULL
         ELSE concat('SELECT x FROM t -- ', props) END AS rewritten_sql,
       event_id * 7777777 AS bytes_scanned,
       user_id * 1000 AS rows_read,
       CAST(length(props) * 10 AS BIGINT) AS slot_ms
FROM events
"""

# Fixture name -> (SQL body, fixtures it depends on), in dependency order.
FIXTURES = {
    "dc_base": (DC_BASE_SQL, ()),
    "dirty_customer": (DIRTY_CUSTOMER_SQL, ("dc_base",)),
    "query_log": (QUERY_LOG_SQL, ()),
}
# Driver tables each fixture reads.
FIXTURE_TABLES = {"dc_base": ("customer",), "dirty_customer": (), "query_log": ("events",)}

def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register driver tables as temporary views."""
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the driver tables of ``sf_dir`` (its dependencies registered first)."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in FIXTURES[n][1]:
            visit(d)
        if n not in order:
            order.append(n)

    visit(name)
    register_tables(spark, sf_dir, sorted({t for n in order for t in FIXTURE_TABLES[n]}))
    for n in order:
        spark.sql(FIXTURES[n][0]).createOrReplaceTempView(n)
    return spark.table(name)


def fixture_ctes(*names: str) -> str:
    """``WITH`` clause defining the given fixtures (and their dependencies)."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        for d in FIXTURES[n][1]:
            visit(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({FIXTURES[n][0]})" for n in ordered) + "\n"
