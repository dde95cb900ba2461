"""Positional inverted index: which documents contain which phrases, without reading a text again.

A text, lower-cased, is an alternation of gaps and words (maximal runs of letters and digits)::

    gap 0, word 0, gap 1, word 1, ..., word m-1, gap m

``add`` writes one batch of documents, without a shuffle.  Every task inverts its documents in *parts* of bounded words:
one row per part and term, with the places of its occurrences as arrays ``doc``, ``pos``, and ``prev``, ``before``,
``after``, ``next`` (the words beside it and the gaps between), these four as numbers of terms of the same part.  A gap
is a term too (it can't be confused with a word); its row has the distinct documents.  Rows are laid out by a hash of
the term and sorted by it.  A second small table counts the occurrences of every term.  A batch is a folder named by its
id: adding it again replaces it, and later rounds read only these two tables.

A phrase is cut in the same way.  Its words with a gap on both sides are whole words of any document that contains it;
the outermost words may be fragments, which the neighbours ``prev`` and ``next`` of a whole word show.  The rarest whole
word gives the candidates (phrase, document, start); the other whole words must stand at their places, then the terms
beside them are looked up by their numbers and compared.  A phrase
without a whole word ("foo", "oo ba", ", ") is looked up in the vocabulary first.  The result is exact: a document is
found if and only if its lower-cased text contains the lower-cased phrase.

Documents without a key or a text, and empty texts, are never found; empty and null phrases find nothing.  A key names
one document: ``add`` refuses a batch that repeats a key, or has one that another batch has (``retrieval.ingest`` leaves
only what is new).
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.io import stored_batches
from .textjoin import NON_TOKEN_RE, TOKEN_RE, contains_join

PART_WORDS = 2_000_000  # words inverted at once, or one text
NONE = -1  # the number of a neighbour that is not there: an outer gap without characters, a word beyond the text
PLACES = ("pos", "prev", "before", "after", "next")


def _words(c: Column) -> Column:
    return F.array_remove(F.split(c, NON_TOKEN_RE), "")


def _gaps(c: Column) -> Column:
    """One more than there are words; the outer ones may be empty."""
    return F.split(c, TOKEN_RE)


class TextIndex:
    """The index below ``path``.  ``buckets`` is the number of folders the terms of a batch are dealt to: every task that reads
    documents writes its rows there, sorted, so nothing is shuffled and a very common word has no task of its own."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # ------------------------------------------------------------ building

    def add(self, docs: DataFrame, batch: str, text_col: str = "text", key: str = "doc_id") -> None:
        """Index a batch of documents; a batch of the same id is replaced."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"batch id {batch!r} can't name a folder")
        docs = docs.select(F.col(key).alias("doc"), F.lower(F.col(text_col)).alias("low")).where(F.col("doc").isNotNull())
        keys = docs.select("doc")
        if stored := [b for b in stored_batches(self.spark, f"{self.path}/docs") if b != batch]:
            keys = keys.unionByName(self.spark.read.parquet(*[f"{self.path}/docs/batch={b}" for b in stored]))
        if repeated := keys.groupBy("doc").count().where("count > 1").take(1):
            raise ValueError(f"document {repeated[0]['doc']!r} occurs twice")
        docs.select("doc").write.mode("overwrite").parquet(f"{self.path}/docs/batch={batch}")
        cut = docs.select("doc", _words(F.col("low")).alias("w"), _gaps(F.col("low")).alias("g")).where(F.col("w").isNotNull())
        rows = cut.mapInArrow(_inverted, self._schema()).withColumn("bucket", self._bucket(F.col("term")))
        (rows.sortWithinPartitions("bucket", "term").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket")
         .parquet(f"{self.path}/postings/batch={batch}"))
        (self._table("postings").where(F.col("batch") == batch).groupBy("term").agg(F.sum("n").alias("n"))
         .write.mode("overwrite").parquet(f"{self.path}/terms/batch={batch}"))

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    # ------------------------------------------------------------ reading

    def _schema(self) -> str:
        """Of a row of postings; the type of the keys is that of the stored documents."""
        key = self.spark.read.parquet(f"{self.path}/docs").schema["doc"].dataType.simpleString()
        return f"part bigint, id int, term string, n bigint, doc array<{key}>, " + ", ".join(f"{c} array<int>" for c in PLACES)

    def _table(self, name: str) -> DataFrame:
        """All batches; the types are given, as a batch without a word has no file to show them."""
        schema = "term string, n bigint, batch string" if name == "terms" else f"{self._schema()}, batch string, bucket int"
        return self.spark.read.option("basePath", f"{self.path}/{name}").schema(schema).parquet(f"{self.path}/{name}")

    def _written(self, rows: DataFrame) -> DataFrame:
        """``rows`` by way of files: their size is known to the joins that follow, so the index itself is shuffled only
        when what is looked for is too large to be sent to it."""
        path = scratch_path(self.spark, "textindex")
        rows.write.parquet(path)
        return self.spark.read.parquet(path)

    def terms(self, only: DataFrame | None = None) -> DataFrame:
        """``term, n``: words and gaps of all batches (of ``only``, if given) with the number of their rows."""
        t = self._table("terms").select("term", "n")
        return (t if only is None else t.join(only, "term", "left_semi")).groupBy("term").agg(F.sum("n").alias("n"))

    def find(self, phrases: DataFrame, phrase_col: str, key_cols: Sequence[str]) -> DataFrame:
        """Distinct ``doc`` and ``key_cols`` of ``phrases``: the document contains the phrase, case ignored."""
        low = F.lower(F.col(phrase_col))
        keyed = phrases.select(*key_cols, low.alias("_p")).withColumn("_id", F.sha2("_p", 256))
        hits = self._hits(keyed.select("_id", "_p").where(F.length("_p") > 0).distinct())
        return keyed.join(hits, "_id").select("doc", *key_cols).distinct()

    def phrases_found(self, phrases: DataFrame, phrase_col: str, key_cols: Sequence[str]) -> DataFrame:
        """Distinct ``key_cols`` of phrases that some document contains."""
        return self.find(phrases, phrase_col, key_cols).select(*key_cols).distinct()

    def _hits(self, phrases: DataFrame) -> DataFrame:
        postings = self._table("postings").drop("n", "id")
        places = self._written(_whole_words(phrases).unionByName(self._fragments(phrases)))
        # A phrase with a word that no document has finds nothing; otherwise its rarest word leads.
        known = places.join(self.terms(places.select("term").distinct()), "term")
        per = known.groupBy("_id", "option").agg(F.count(F.lit(1)).alias("_known"), F.min(F.struct("n", "at")).alias("_lead"))
        known = known.join(per, ["_id", "option"]).where(F.col("_known") == F.col("needed")).withColumn("bucket", self._bucket(F.col("term")))
        known = self._written(known.select("_id", "option", "needed", "at", "term", "bucket", "asked", (F.col("at") == F.col("_lead.at")).alias("leads")))
        lead = known.where("leads").select("bucket", "term", "_id", "option", "needed", "at", "asked")
        spot = ["batch", "part", "doc", "start"]
        starts = self._written(_occurrences(lead.join(postings, ["bucket", "term"]), ["_id", "option", "needed", "at", "asked"])
                               .withColumn("start", F.col("pos") - F.col("at")))
        # The other words: only occurrences in candidate documents are told apart, then meet the places asked for.
        others = known.where(~F.col("leads")).select("_id", "option", "at", "term", "asked")
        wanted = starts.where("needed > 1").select("_id", "option", "needed", *spot).join(others, ["_id", "option"])
        wanted = self._written(wanted.withColumn("pos", F.col("start") + F.col("at")))
        asked_for = known.where(~F.col("leads")).select("bucket", "term").distinct()
        within = self._written(wanted.select("batch", "part", "doc").distinct())
        there = _occurrences(postings.join(asked_for, ["bucket", "term"], "left_semi"), ["term"]).join(within, ["batch", "part", "doc"], "left_semi")
        held = wanted.join(there, ["batch", "part", "doc", "term", "pos"])
        stand = ["_id", "option", "needed", *spot, "at", "asked", *PLACES[1:]]
        stand = self._written(starts.select(*stand).unionByName(held.select(*stand)))
        every = (stand.groupBy("_id", "option", "needed", *spot)
                 .agg(F.count(F.lit(1)).alias("_stand"), F.sum(F.size("asked")).alias("_asked")).where("_stand = needed"))
        every = self._written(every.drop("needed", "_stand"))
        free = every.where("_asked = 0").select("_id", "doc")
        # The terms beside the words: known by their numbers within the part.
        beside = F.element_at(F.array(*PLACES[1:]), F.col("a.side"))
        asked = stand.where(F.size("asked") > 0).join(every.where("_asked > 0"), ["_id", "option", *spot])
        asked = self._written(asked.select("_id", "option", *spot, "_asked", F.explode("asked").alias("a"), beside.alias("id")).where(F.col("id") != NONE))
        numbers = self._written(asked.select("batch", "part", "id").distinct())
        names = self._written(self._table("postings").select("batch", "part", "id", F.col("term").alias("_beside")).join(numbers, ["batch", "part", "id"]))
        fits = (F.when(F.col("a.how") == "all", F.col("_beside") == F.col("a.wish")).when(F.col("a.how") == "end", F.col("_beside").endswith(F.col("a.wish")))
                .otherwise(F.col("_beside").startswith(F.col("a.wish"))))
        full = (asked.join(names, ["batch", "part", "id"]).where(fits).groupBy("_id", "option", *spot, "_asked").agg(F.count(F.lit(1)).alias("_fit"))
                .where("_fit = _asked").select("_id", "doc"))
        return free.unionByName(full).distinct()

    def _fragments(self, phrases: DataFrame) -> DataFrame:
        """Phrases without a whole word: one ``option`` for every term of the vocabulary that can hold their first word,
        or the whole phrase when it has no word."""
        p = _cut(phrases).where(F.col("needed") == 0)
        first = F.when(F.size("w") > 0, F.element_at("w", 1)).otherwise(F.col("_p")).alias("_first")
        p = p.select("_id", F.size("w").alias("_words"), first, F.element_at("g", 1).alias("_g0"),
                     F.when(F.size("w") > 0, F.element_at("g", 2)).alias("_g1"), F.when(F.size("w") > 1, F.element_at("w", 2)).alias("_second"))
        met = contains_join(self._table("terms").select("term").distinct(), "term", p, "_first", ignore_case=False)
        begins = (F.col("_g0") == "") | F.col("term").startswith(F.col("_first"))
        ends = (F.col("_g1") == "") | F.col("term").endswith(F.col("_first"))
        met = met.where((F.col("_words") == 0) | (begins & ends))
        one, two = F.col("_words") == 1, F.col("_words") == 2
        return met.select("_id", F.col("term").alias("option"), F.lit(1).alias("needed"), F.lit(0).alias("at"), "term", _asked(
            ("before", "end", one & (F.col("_g0") != ""), F.col("_g0")), ("after", "begin", one & (F.col("_g1") != ""), F.col("_g1")),
            ("after", "all", two, F.col("_g1")), ("next", "begin", two, F.col("_second"))))


def _inverted(batches):
    """Postings of the documents (``doc``, words ``w``, gaps ``g``) of a task, in parts of about PART_WORDS words."""
    number = itertools.count(TaskContext.get().partitionId() << 33)
    held, size = [], 0
    for b in batches:
        lens = pc.fill_null(pc.list_value_length(b.column("w")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        lo = 0
        for hi in range(1, len(b) + 1):
            size += int(lens[hi - 1])
            if size >= PART_WORDS:
                yield _part([*held, b.slice(lo, hi - lo)], next(number))
                held, size, lo = [], 0, hi
        if lo < len(b):
            held.append(b.slice(lo))
    if held:
        yield _part(held, next(number))


def _part(batches: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
    docs, words, gaps = (pa.Table.from_batches(batches).column(c).combine_chunks() for c in ("doc", "w", "g"))
    n_words = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    n, n_gaps = int(n_words.sum()), n_words + 1
    coded = pa.chunked_array([words.flatten(), gaps.flatten()]).dictionary_encode().unify_dictionaries()
    names = coded.chunk(0).dictionary
    code = np.concatenate([c.indices.to_numpy().astype(np.int32) for c in coded.chunks])
    word, gap = code[:n], code[n:]
    empty = pc.index(names, "").as_py()
    beside = np.where(gap == empty, np.int32(NONE), gap) if empty >= 0 else gap
    # Word i of document d stands between gaps i + d and i + d + 1.
    of, begin = np.repeat(np.arange(len(n_words)), n_words), np.cumsum(n_words) - n_words
    pos, at = np.arange(n) - begin[of], np.arange(n) + of
    prev = np.where(pos > 0, np.concatenate([word[:1], word[:-1]]), np.int32(NONE))
    following = np.where(pos < n_words[of] - 1, np.concatenate([word[1:], word[-1:]]), np.int32(NONE))
    order = np.argsort(word, kind="stable")
    places = [x[order].astype(np.int32) for x in (pos, prev, beside[at], beside[at + 1], following)]
    n_word = np.bincount(word, minlength=len(names))
    # Every gap once per document.
    shown = beside != NONE
    once = np.unique((beside[shown].astype(np.int64) << 32) | np.repeat(np.arange(len(n_gaps)), n_gaps)[shown])
    n_gap = np.bincount(once >> 32, minlength=len(names))
    word_ids, gap_ids = np.flatnonzero(n_word), np.flatnonzero(n_gap)
    ids, counts = np.concatenate([word_ids, gap_ids]), np.concatenate([n_word[word_ids], n_gap[gap_ids]])
    cut = np.concatenate([[0], np.cumsum(counts)])
    lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), docs.take(pa.array(np.concatenate([of[order], once & 0xFFFFFFFF]))))]
    lists += [pa.ListArray.from_arrays(pa.array(np.minimum(cut, n), pa.int32()), pa.array(x)) for x in places]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(ids), number), pa.int64()), pa.array(ids, pa.int32()), names.take(pa.array(ids)), pa.array(counts, pa.int64()), *lists],
        names=["part", "id", "term", "n", "doc", *PLACES])


def _occurrences(rows: DataFrame, kept: list[str]) -> DataFrame:
    """One row per occurrence of a word, or per document of a gap: ``kept``, ``batch``, ``part``, ``doc`` and its places.
    A gap has no places: its position is null, its start too."""
    return rows.select(*kept, "batch", "part", F.inline(F.arrays_zip("doc", *PLACES)))


def _asked(*wishes: tuple[str, str, Column, Column]) -> Column:
    """``asked``: what must stand beside a word, as structs of the ``side``, ``how`` it must fit (all, end, begin) and the ``wish``."""
    return F.array_compact(F.array(*[
        F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(PLACES.index(side)).alias("side"), F.lit(how).alias("how"), wish.alias("wish")))
        for side, how, when, wish in wishes])).alias("asked")


def _cut(phrases: DataFrame) -> DataFrame:
    """Words ``w``, gaps ``g`` and the number ``needed`` of words with a gap on both sides."""
    cut = phrases.withColumn("w", _words(F.col("_p"))).withColumn("g", _gaps(F.col("_p")))
    first, last = (F.element_at("g", 1) == "").cast("int"), (F.element_at("g", -1) == "").cast("int")
    return cut.withColumn("needed", F.greatest(F.size("w") - first - last, F.lit(0)))


def _whole_words(phrases: DataFrame) -> DataFrame:
    """One row per whole word of a phrase: its place ``at`` and what must stand beside it."""
    n, at = F.size("w"), F.col("at")
    word = lambda i: F.get("w", i)
    gap = lambda i: F.get("g", i)
    cut = _cut(phrases).where(F.col("needed") > 0)
    rows = cut.select("_id", "w", "g", "needed", F.posexplode("w").alias("at", "term"))
    open_first, open_last = gap(F.lit(0)) == "", gap(n) == ""
    rows = rows.where(~((at == 0) & open_first) & ~((at == n - 1) & open_last))
    # The gap between two whole words is asked for once.
    return rows.select("_id", F.lit("").alias("option"), "needed", "at", "term", _asked(
        ("before", "end", at == 0, gap(at)), ("before", "all", at > 0, gap(at)),
        ("after", "begin", at == n - 1, gap(at + 1)), ("after", "all", (at == n - 2) & open_last, gap(at + 1)),
        ("prev", "end", (at == 1) & open_first, word(at - 1)), ("next", "begin", (at == n - 2) & open_last, word(at + 1))))
