"""Substring-containment join: which documents contain which phrases.

Exact, and without comparing every document with every phrase.  Every phrase
gets an equi-join key that any containing document must also produce, and
only the candidate pairs sharing a key are verified with ``contains``:

* a phrase of three or more word tokens is keyed by its longest interior
  token, which occurs as a whole token in any document containing it (the
  first and last token may be fragments); documents are exploded into their
  distinct tokens;
* a phrase of one or two tokens is keyed by the first ``g`` characters
  (``g = min(3, length)``) of its longest token: that token lies inside some
  token of a containing document, so its leading ``g``-gram is a ``g``-gram of
  a document token; documents are exploded into the distinct ``g``-grams of
  their distinct tokens (only for the gram lengths that occur);
* a phrase without any word character is keyed by its first character;
  documents are exploded into their distinct characters.

Only (text digest, key) pairs meet the phrases; the candidate pairs are then
joined back to the documents by digest and verified.  Adaptive execution
broadcasts a side whose bytes are below its threshold and splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN_RE = r"[\p{L}\p{N}]+"
NON_TOKEN_RE = r"[^\p{L}\p{N}]+"
# Longest character gram used to key phrases of one or two tokens.
MAX_GRAM = 3


def _tokens(c):
    """Maximal runs of letters and digits, in order (splitting on the complement is faster than extracting)."""
    return F.array_remove(F.split(c, NON_TOKEN_RE), "")


def _longest(arr):
    return F.aggregate(arr, F.lit(""), lambda acc, t: F.when(F.length(t) > F.length(acc), t).otherwise(acc))


def _token_grams(text, g: int):
    """Distinct ``g``-character grams of the distinct word tokens of ``text``."""
    toks = F.filter(F.array_distinct(_tokens(text)), lambda u: F.length(u) >= g)
    grams = F.transform(toks, lambda u: F.transform(F.sequence(F.lit(1), F.length(u) - (g - 1)),
                                                    lambda i: F.substring(u, i, g)))
    return F.array_distinct(F.flatten(grams))


def contains_join(docs: DataFrame, text_col: str, phrases: DataFrame, phrase_col: str, ignore_case: bool = True) -> DataFrame:
    """Rows of ``docs`` x ``phrases`` where the document text contains the phrase.

    Empty phrases never match.  Output keeps every column of both sides
    (column names must not clash).
    """
    lower = F.lower if ignore_case else (lambda c: c)
    p = phrases.withColumn("_lp", lower(F.col(phrase_col))).where(F.length("_lp") > 0)
    toks = _tokens(F.col("_lp"))
    interior = F.slice(toks, 2, F.greatest(F.size(toks) - 2, F.lit(0)))
    longest = _longest(toks)
    g = F.least(F.length(longest), F.lit(MAX_GRAM))
    # _kind: 0 = interior token, 1..3 = leading gram of that length, 4 = first character.
    p = p.withColumn("_kind", F.when(F.size(toks) >= 3, 0).when(F.size(toks) >= 1, g).otherwise(4)).withColumn(
        "_key", F.when(F.col("_kind") == 0, _longest(interior))
                 .when(F.col("_kind") == 4, F.substring("_lp", 1, 1))
                 .otherwise(F.substring(longest, 1, g)))
    # Documents produce only the kinds of keys that some phrase has: one value, read while the join runs.
    kinds = p.agg(F.collect_set("_kind").alias("k")).scalar()
    d = docs.withColumn("_lt", lower(F.col(text_col))).withColumn("_h", F.sha2("_lt", 256))
    none = F.array().cast("array<string>")

    def keys(kind: int, made):
        return F.transform(F.when(F.array_contains(F.col("_kinds"), kind), made).otherwise(none),
                           lambda k: F.struct(F.lit(kind).alias("_kind"), k.alias("_key")))

    made = [keys(0, F.array_distinct(_tokens(F.col("_lt")))), keys(4, F.array_distinct(F.split(F.col("_lt"), "")))]
    made += [keys(n, _token_grams(F.col("_lt"), n)) for n in range(1, MAX_GRAM + 1)]
    pairs = d.select("_h", "_lt", kinds.alias("_kinds")).select("_h", F.inline(F.flatten(F.array(*made))))
    cand = pairs.join(p, ["_kind", "_key"]).drop("_kind", "_key").distinct()
    return d.join(cand, "_h").where(F.col("_lt").contains(F.col("_lp"))).drop("_h", "_lt", "_lp")


def phrases_found(docs: DataFrame, text_col: str, phrases: DataFrame, phrase_col: str, key_cols: list[str]) -> DataFrame:
    """Distinct ``key_cols`` of phrases contained in at least one document."""
    j = contains_join(docs.select(text_col), text_col, phrases.select(*key_cols, phrase_col), phrase_col)
    return j.select(*key_cols).distinct()
