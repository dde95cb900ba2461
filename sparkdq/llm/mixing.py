"""Mixing sources to target weights by hierarchical budgeting.

The tree domain - language - source has documents at its leaves.  A token budget
flows from the root: every node shares its budget among its children in
proportion to their weights, no child above its subtree's capacity.  What full
children can't take goes to their siblings first; what a whole subtree can't take
never reached it, so it went to that subtree's own siblings.  A leaf fills its
budget from seeded epochs: whole passes over its documents, then the longest
prefix of the next pass, in the order of a seeded hash, that fits.

Budgets are integers on one row per node.  Prefixes are found by summing tokens
per hash bucket, refined twice, so no leaf is sorted or summed in one task.  Rows
are staged where they are read; only ids of selected rows move, not texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import PART, POS, marked, stage, written

LEVELS = ("domain", "lang", "source")
BUCKET_BITS = 12  # a leaf is cut into 4096 buckets, and the one at the border into 4096 again


def words(text: Column) -> Column:
    """Tokens of a text: its runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x09-\x0D\x20]+")), F.lit(0)).cast("bigint")


def place(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A document's place in a pass: the first 48 bits of the MD5 of seed, epoch and id (null as empty)."""
    joined = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(joined), 1, 12), 16, 10).cast("bigint")


def share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Budget of each child of every parent: weighted shares, none above its ``cap``, shortages to the siblings.

    Needs ``given`` (the parent's budget), ``weight`` (positive) and ``cap``.  In the order of cap / weight a child is
    full when its cap is within its share of what the earlier ones leave; the others split the rest by differences of
    the floored running share, so a parent's budgets add up to its budget exactly.
    """
    order = [F.col("cap").cast("double") / F.col("weight").cast("double"), F.col(name)]
    by = Window.partitionBy(*parent)
    before = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = by.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    n = nodes.withColumns({"gone": F.coalesce(F.sum("cap").over(before), F.lit(0)), "open": F.sum("weight").over(onward)})
    n = n.withColumn("is_full", F.expr("CAST(cap AS DECIMAL(28,0)) * open <= CAST(given - gone AS DECIMAL(28,0)) * weight"))
    n = n.withColumns({"rest": F.col("given") - F.coalesce(F.sum(F.when(F.col("is_full"), F.col("cap"))).over(by), F.lit(0)),
                       "total": F.sum(F.when(~F.col("is_full"), F.col("weight"))).over(by)})
    running = Window.partitionBy(*parent, "is_full").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = n.withColumn("upto", F.sum("weight").over(running))
    split = F.expr("CAST(rest AS DECIMAL(28,0)) * upto DIV total - CAST(rest AS DECIMAL(28,0)) * (upto - weight) DIV total")
    return n.withColumn("budget", F.when(F.col("is_full"), F.col("cap")).otherwise(split)).drop("gone", "open", "is_full", "rest", "total", "upto")


def budgets(leaves: DataFrame, total: int, weights: dict[str, dict[str, int]], epochs: int) -> DataFrame:
    """``supply`` and ``budget`` of every leaf.  ``weights``: by level and name, 1 where none is given."""
    capped = leaves.withColumn("cap", F.col("supply") * epochs)
    level = above = None
    for i, name in enumerate(LEVELS):
        upper = list(LEVELS[:i])
        nodes = capped.groupBy(*LEVELS[: i + 1]).agg(F.sum("cap").alias("cap"))
        nodes = nodes.withColumn("given", F.lit(total).cast("bigint")) if above is None else nodes.join(above, upper)
        named = F.lit(None)
        for value, weight in weights.get(name, {}).items():
            named = F.when(F.col(name) == value, weight).otherwise(named)
        level = share(nodes.withColumn("weight", F.coalesce(named, F.lit(1)).cast("bigint")), upper or [F.lit(0)], name)
        above = level.select(*LEVELS[: i + 1], F.col("budget").alias("given"))
    return level.join(capped.select(*LEVELS, "supply"), list(LEVELS)).select(*LEVELS, "supply", "budget")


def border(sums: DataFrame, key: list[str], bucket: str) -> DataFrame:
    """Running token sums of a key's buckets against its ``room``: ``whole`` buckets fit, the first other is the border."""
    up = Window.partitionBy(*key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sums.withColumn("upto", F.sum("tokens").over(up))
    return run.select(*key, bucket, (F.col("upto") <= F.col("room")).alias("whole"),
                      ((F.col("upto") > F.col("room")) & (F.col("upto") - F.col("tokens") <= F.col("room"))).alias("cut"),
                      (F.col("room") - F.col("upto") + F.col("tokens")).alias("left"))


def prefixes(rows: DataFrame) -> DataFrame:
    """(_part, _pos) of the rows in the longest prefix, by ``at``, of every leaf whose tokens fit into ``room``."""
    leaf = list(LEVELS)
    rows = rows.withColumns({"a": F.shiftright("at", 48 - BUCKET_BITS), "b": F.shiftright("at", 48 - 2 * BUCKET_BITS)})
    first = written(border(rows.groupBy(*leaf, "a").agg(F.sum("tokens").alias("tokens"), F.max("room").alias("room")), leaf, "a"))
    whole = rows.join(first.filter("whole").select(*leaf, "a"), [*leaf, "a"], "left_semi")
    inner = rows.join(first.filter("cut").select(*leaf, "a", "left"), [*leaf, "a"])
    second = written(border(inner.groupBy(*leaf, "b").agg(F.sum("tokens").alias("tokens"), F.max("left").alias("room")), leaf, "b"))
    more = inner.join(second.filter("whole").select(*leaf, "b"), [*leaf, "b"], "left_semi")
    last = inner.drop("left").join(second.filter("cut").select(*leaf, "b", "left"), [*leaf, "b"])
    up = Window.partitionBy(*leaf).orderBy("at", PART, POS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = last.withColumn("upto", F.sum("tokens").over(up)).filter("upto <= left")
    return whole.select(PART, POS).unionByName(more.select(PART, POS)).unionByName(fits.select(PART, POS))


def mix(docs: DataFrame, domain: Column, share_of_tokens: float, weights: dict[str, dict[str, int]], epochs: int = 1, seed: int = 1,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """Selected rows: ``row`` (struct of ``carry``), the levels, ``tokens`` and ``copies`` (1 to ``epochs``).

    ``share_of_tokens`` of all tokens is the budget; ``epochs`` bounds how often a document may be used.  Null levels
    are ``unknown``.  Documents without tokens cost nothing and are in a prefix as long as nothing before them overran
    it.  Rows that share an id are ordered by their place in the staged table.  Empty tables give no rows.
    """
    col = lambda c: F.col(f"`{c}`")
    known = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    staged = stage(docs.select(F.struct(*[col(c) for c in carry or [id_col]]).alias("row"), col(id_col).alias("id"), known(domain).alias("domain"),
                               known(col(lang_col)).alias("lang"), known(col(source_col)).alias("source"), words(col(text_col)).alias("tokens")))
    leaves = written(staged.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply")))
    supply = leaves.agg(F.sum("supply")).first()[0] or 0
    total = min(int(supply * share_of_tokens), supply * epochs)
    plan = written(budgets(leaves, total, weights, epochs).select(
        *LEVELS, F.when(F.col("supply") > 0, F.expr("budget DIV supply")).otherwise(0).alias("passes"),
        F.when(F.col("supply") > 0, F.expr("budget % supply")).otherwise(0).alias("room")))
    slim = staged.select(PART, POS, "id", *LEVELS, "tokens").join(plan, list(LEVELS))
    slim = slim.withColumn("at", place(seed, F.col("passes"), F.col("id")))
    again = written(prefixes(slim.filter(F.col("passes") < epochs)))
    copies = F.lit(0)
    rows = staged
    for n in range(epochs):
        # Taken n + 1 times: leaves with more than n whole passes, and prefixes of leaves with n.
        at_least = slim.filter(F.col("passes") > n).select(PART, POS)
        at_least = at_least.unionByName(again.join(slim.filter(F.col("passes") == n).select(PART, POS), [PART, POS], "left_semi") if epochs > 1 else again)
        rows = marked(rows, at_least, f"_taken{n}")
        copies = copies + F.col(f"_taken{n}").cast("int")
    return rows.filter("_taken0").select("row", *LEVELS, "tokens", copies.alias("copies"))
