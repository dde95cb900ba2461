"""Repair actions (F1-F10) as DataFrame transformations.

An action is ``{"action": name, "params": {...}}``.  ``apply_fixes`` folds the
actions in order; an unknown action or an absent column is skipped silently.
Column-wise actions are plain projections that Catalyst collapses into one
``Project``; de-duplication is an aggregate; mean/median imputation computes
one scalar (an aggregate) and then projects.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import python_pattern_to_java, python_repl_to_java, strip_ws
from . import stats
from .profile import missing
from .util import col

FIX_ACTIONS = ("drop_duplicates", "impute_nulls", "normalize_email", "regex_clean", "remove_negative_values")


def _numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def _replace(df: DataFrame, c: str, expr: Column) -> DataFrame:
    return df.select(*[expr.alias(c) if x == c else col(x) for x in df.columns])


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None,
                    order_by: Sequence[str] | None = None) -> DataFrame:
    """F1 / F2.

    No subset: full-row distinct.  With a subset: unknown names are dropped; if
    none is left the frame is returned unchanged; otherwise one row per subset
    key is kept - the first by ``order_by`` (ascending, nulls first), ties
    broken by the remaining columns so the result is deterministic.

    The keep-first choice is an aggregate ``min(struct(order keys, row))`` per
    key, so its partial aggregation collapses a hot key before the shuffle
    instead of sorting all of its rows in one task.
    """
    if not subset:
        return df.dropDuplicates()
    subset = [c for c in subset if c in df.columns]
    if not subset:
        return df
    order_by = [c for c in (order_by or []) if c in df.columns]
    rest = [c for c in df.columns if c not in subset]
    keys = order_by + [c for c in rest if c not in order_by]
    packed = F.struct(*[col(c).alias(f"k{i}") for i, c in enumerate(keys)])
    agg = df.groupBy(*[col(c).alias(f"g{i}") for i, c in enumerate(subset)]).agg(F.min(packed).alias("_first"))
    return agg.select(*[F.col(f"g{subset.index(c)}" if c in subset else f"_first.k{keys.index(c)}").alias(c) for c in df.columns])


def impute_nulls(df: DataFrame, column: str, strategy: str = "constant", value=""):
    """Fill missing values (null, and NaN for floating columns)."""
    if column not in df.columns:
        return df
    miss = missing(df, column)
    if strategy in ("mean", "median") and _numeric(df, column):
        # The statistic is one value that the job itself reads; a column without values keeps its nulls.
        fill = stats.mean(df, column) if strategy == "mean" else F.lit(stats.exact_median(df, column))
        return _replace(df, column, F.when(miss, fill).otherwise(col(column).cast("double")))
    dt = df.schema[column].dataType
    if isinstance(dt, T.StringType):
        return _replace(df, column, F.when(miss, F.lit(str(value))).otherwise(col(column)))
    # Numeric / other column: only a value castable to the column type is used.
    lit = F.lit(value).cast("string").try_cast(dt) if not isinstance(value, (int, float)) else F.lit(value).cast(dt)
    return _replace(df, column, F.when(miss & lit.isNotNull(), lit).otherwise(col(column)))


def normalize_email(df: DataFrame, column: str = "email", missing_as_text: bool = False) -> DataFrame:
    """strip white space and lower-case; ``missing_as_text`` writes ``'nan'`` like the reference."""
    if column not in df.columns:
        return df
    s = col(column).cast("string")
    if missing_as_text:
        s = F.coalesce(s, F.lit("nan"))
    return _replace(df, column, F.lower(strip_ws(s)))


def regex_clean(df: DataFrame, column: str, pattern: str | None, repl: str = "",
                missing_as_text: bool = False) -> DataFrame:
    """regex replace-all; a Python-style replacement (``\\1``) is translated."""
    if column not in df.columns or not pattern:
        return df
    s = col(column).cast("string")
    if missing_as_text:
        s = F.coalesce(s, F.lit("nan"))
    return _replace(df, column, F.regexp_replace(s, python_pattern_to_java(pattern), python_repl_to_java(repl or "")))


def remove_negative_values(df: DataFrame, column: str) -> DataFrame:
    """F8: a negative value becomes missing; the row stays and the type is kept."""
    if column not in df.columns or not _numeric(df, column):
        return df
    c = col(column)
    return _replace(df, column, F.when(c < 0, F.lit(None).cast(df.schema[column].dataType)).otherwise(c))


def apply_fixes(df: DataFrame, actions: Iterable[Mapping], order_by: Sequence[str] | None = None,
                missing_as_text: bool = False, checkpoint_barriers: bool = False) -> DataFrame:
    """apply the actions in order.

    A mean / median fill needs a statistic of the frame as it is at that
    point.  With ``checkpoint_barriers`` the frame is checkpointed (reliably,
    into ``spark.checkpoint.dir``) before such a statistic when a
    de-duplication precedes it, so the shuffle is not recomputed for the
    statistic and again for the result, and lineage stays short.
    """
    out = df
    shuffled = False
    for a in actions:
        act = a.get("action")
        p = dict(a.get("params") or {})
        if act == "drop_duplicates":
            out = drop_duplicates(out, p.get("subset"), order_by)
            shuffled = True
        elif act == "impute_nulls":
            name = p.get("column")
            if name in out.columns:
                strategy = p.get("strategy") or "constant"
                if checkpoint_barriers and shuffled and strategy in ("mean", "median") and _numeric(out, name):
                    out = out.checkpoint(eager=True)
                    shuffled = False
                out = impute_nulls(out, name, strategy, p.get("value", ""))
        elif act == "normalize_email":
            out = normalize_email(out, p.get("column") or "email", missing_as_text)
        elif act == "regex_clean":
            name = p.get("column")
            if name in out.columns:
                out = regex_clean(out, name, p.get("pattern"), p.get("repl") or "", missing_as_text)
        elif act == "remove_negative_values":
            name = p.get("column")
            if name in out.columns:
                out = remove_negative_values(out, name)
    return out
