"""Query-log analytics (Q8, Q9, Q11, Q12, S9) over a table of SQL texts.

One row per query; every statistic is a native expression.  The per-line
changes are a grouped aggregate over exploded lines; the per-query summary is
a merge of the two sorted line arrays inside the row (no shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import querylog as QF
from ..functions.text import as_col, strip_ws

# Line breaks recognised when splitting SQL text into lines.
LINE_BREAK_RE = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x85\u2028\u2029]"
# Allowed complexity labels of a review.
COMPLEXITY_LEVELS = ("low", "medium", "high", "very_high")


def split_blank(df: DataFrame, sql_col: str = "sql") -> tuple[DataFrame, DataFrame]:
    """(valid, rejects); a missing or white-space-only text is rejected."""
    blank = F.coalesce(strip_ws(F.col(sql_col)) == "", F.lit(True))
    return df.where(~blank), df.where(blank).withColumn("reason", F.lit("SQL query cannot be empty"))


def with_stats(df: DataFrame, sql_col: str, bytes_col: str, prefix: str = "",
               partition_col: str = "event_date") -> DataFrame:
    """Add ``{prefix}query_text_stats`` (Q1-Q5) and ``{prefix}plan_stats`` (Q7)."""
    st = QF.static_stats(sql_col, partition_col)
    out = df.withColumn(f"{prefix}query_text_stats", F.when(F.col(sql_col).isNotNull(), st))
    return out.withColumn(f"{prefix}plan_stats",
                          F.when(F.col(sql_col).isNotNull(),
                                 QF.heuristics(f"{prefix}query_text_stats", bytes_col)))


def report(df: DataFrame, sql_col: str = "sql", bytes_col: str = "bytes_scanned",
           scan_cols: tuple[str, ...] = ("bytes_scanned",), partition_col: str = "event_date") -> DataFrame:
    """Q8: nested report ``{query_text_stats, scan_stats, plan_stats}`` per query."""
    out = with_stats(df, sql_col, bytes_col, "", partition_col)
    scan = F.struct(*[F.col(c) for c in scan_cols if c in df.columns])
    return out.withColumn("report", F.struct(F.col("query_text_stats"), scan.alias("scan_stats"),
                                             F.col("plan_stats"))).drop("query_text_stats", "plan_stats")


def compare(df: DataFrame, before_col: str, after_col: str, bytes_col: str,
            partition_col: str = "event_date") -> DataFrame:
    """Q9: statistics of the original and the rewritten SQL side by side, with deltas.

    A missing rewrite gives null statistics (and null deltas), not an error.
    """
    out = with_stats(df, before_col, bytes_col, "before_", partition_col)
    out = with_stats(out, after_col, bytes_col, "after_", partition_col)
    return out.withColumn(
        "delta_num_joins", F.col("after_query_text_stats.num_joins") - F.col("before_query_text_stats.num_joins")
    ).withColumn(
        "delta_shuffle_bytes", F.col("after_plan_stats.shuffle_bytes") - F.col("before_plan_stats.shuffle_bytes")
    )


def split_lines(c) -> "F.Column":
    """Lines of a text like Python ``splitlines`` (no trailing empty line)."""
    s = as_col(c)
    # ``\z``: only the very last line break; Java's ``$`` would also match before it and drop two.
    body = F.regexp_replace(s, f"({LINE_BREAK_RE})\\z", "")
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_BREAK_RE))


def line_changes(df: DataFrame, id_col: str, before_col: str, after_col: str) -> DataFrame:
    """Q11 (re-aimed): multiset line difference ``(id, line, delta)``.

    ``delta`` > 0: the line occurs that many more times after the rewrite;
    < 0: fewer times.  Rows whose rewrite is missing produce nothing.
    """
    both = df.where(F.col(after_col).isNotNull() & F.col(before_col).isNotNull()).select(
        F.col(id_col), split_lines(before_col).alias("_a"), split_lines(after_col).alias("_b"))
    # Both texts are in one row: occurrences are counted inside it, nothing is shuffled.
    count = lambda lines, x: F.size(F.filter(lines, lambda y: y == x))
    deltas = F.transform(F.array_union("_a", "_b"), lambda x: F.struct(
        x.alias("line"), (count(F.col("_b"), x) - count(F.col("_a"), x)).cast("int").alias("delta")))
    return both.select(id_col, F.inline(deltas)).where(F.col("delta") != 0)


def line_diff(df: DataFrame, id_col: str, before_col: str, after_col: str) -> DataFrame:
    """Q11 summary per query: lines added and removed (null when there is no rewrite).

    Both texts of a query are in one row, so the multiset difference needs no
    shuffle: the two line arrays are sorted and walked once in step, like a
    merge (O(L log L) per row, no row per line).  Equal to summing the
    positive and negative ``delta`` of ``line_changes``.
    """
    # Sorted arrays are projected first, so the merge steps read columns instead of re-splitting.
    a, b = F.col("_a"), F.col("_b")
    na, nb = F.col("_na"), F.col("_nb")

    def step(s, _):
        i, j, add, rem = s["i"], s["j"], s["add"], s["rem"]

        def st(i2, j2, add2, rem2):
            return F.struct(i2.alias("i"), j2.alias("j"), add2.alias("add"), rem2.alias("rem"))

        x, y = F.try_element_at(a, i), F.try_element_at(b, j)
        return (F.when((i > na) & (j > nb), s)
                .when(i > na, st(i, j + 1, add, rem + 1))
                .when(j > nb, st(i + 1, j, add + 1, rem))
                .when(x == y, st(i + 1, j + 1, add, rem))
                .when(x < y, st(i + 1, j, add + 1, rem))
                .otherwise(st(i, j + 1, add, rem + 1)))

    init = F.struct(F.lit(1).alias("i"), F.lit(1).alias("j"), F.lit(0).alias("add"), F.lit(0).alias("rem"))
    walk = F.aggregate(F.sequence(F.lit(1), F.greatest(na + nb, F.lit(1))), init, step)
    has = F.col(before_col).isNotNull() & F.col(after_col).isNotNull()
    lines = df.select(
        id_col, has.alias("_has"), F.array_sort(split_lines(after_col)).alias("_a"),
        F.array_sort(split_lines(before_col)).alias("_b"))
    counted = lines.select(id_col, "_has", "_a", "_b", F.size("_a").alias("_na"), F.size("_b").alias("_nb"))
    return counted.select(id_col, F.when(F.col("_has"), walk).alias("_w")).select(
        id_col, F.col("_w.add").cast("int").alias("lines_added"), F.col("_w.rem").cast("int").alias("lines_removed"))


REVIEW_SCHEMA = ("recommendations array<string>, risk_flags array<string>, "
                 "sql_quality_score double, complexity string")


def _strings(json_text, path: str):
    """The JSON value at ``path`` is a list whose items are all strings."""
    text = F.get_json_object(json_text, path)
    kinds = F.from_json(text, "array<variant>")
    return F.coalesce(F.json_array_length(text).isNotNull() & F.forall(kinds, lambda v: F.schema_of_variant(v) == "STRING"), F.lit(False))


def validate_reviews(df: DataFrame, review_col: str = "review") -> DataFrame:
    """Q12: parse a review and test the required shape.

    Valid when the text is a JSON object holding ``recommendations`` and
    ``risk_flags`` lists of strings, an integer ``sql_quality_score`` in 0..100 and a known
    ``complexity``.
    """
    r = F.col(review_col)
    parsed = F.from_json(r, REVIEW_SCHEMA)
    is_json = F.try_parse_json(r).isNotNull() & strip_ws(r).startswith("{")
    ok = (
        is_json
        & _strings(r, "$.recommendations")
        & _strings(r, "$.risk_flags")
        & F.coalesce(F.get_json_object(r, "$.sql_quality_score").rlike(r"^-?[0-9]+$"), F.lit(False))
        & parsed["sql_quality_score"].between(0, 100)
        & parsed["complexity"].isin(*COMPLEXITY_LEVELS)
    )
    return df.withColumn("review_parsed", F.when(is_json, parsed)).withColumn("review_valid", F.coalesce(ok, F.lit(False)))
