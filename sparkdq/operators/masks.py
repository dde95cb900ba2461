"""Masking action list (M6) over a DataFrame.

An action is ``{"action": name, "params": {"column": c, ...}}``.  Every action
is a native column expression, so the whole list folds into one projection.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

from ..functions import masks as M

MASK_ACTIONS = ("mask_email", "mask_phone", "hash_name", "redact_address", "mask_column")


def mask_expr(action: str, column: str, params: Mapping):
    """Column expression for one action, or None for an unknown / no-op action."""
    if action == "mask_email":
        if (params.get("strategy") or "mask_local") != "mask_local":
            return None
        return M.mask_email(column)
    if action == "mask_phone":
        return M.mask_phone(column)
    if action == "hash_name":
        return M.hash_value(column, params.get("salt") or "", int(params.get("hex_len") or 12))
    if action == "redact_address":
        return M.redact(column)
    if action == "mask_column":
        return M.mask_column(column)
    return None


def apply_masks(df: DataFrame, actions: Iterable[Mapping]) -> DataFrame:
    """M6: apply in order; missing/absent column or unknown action is skipped."""
    out = df
    for a in actions:
        p = dict(a.get("params") or {})
        col = p.get("column")
        if not col or col not in out.columns:
            continue
        e = mask_expr(a.get("action"), col, p)
        if e is not None:
            out = out.withColumn(col, e)
    return out
