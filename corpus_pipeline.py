"""Corpus pipeline over ``documents``: five operators of ``sparkdq.llm`` in sequence.

1. language ID: documents that the model rejects go,
2. exact dedup: one document of each text stays,
3. MinHash near-dedup: one document of each class stays,
4. mixing: documents that fill the token budget of their leaf stay,
5. BPE: ids and decoded text, as digests, of what is left.

Every stage reads all that its predecessor kept.  ``run`` writes each result to the shared folder as Parquet and reads it
again, so a lost executor repeats one stage; what a stage has staged goes when its result is written, and a result goes
when the next one is.  A stage called by itself removes what the stage called before it over the same folder has staged,
so its ``docs`` must have been written and read again.

Every stage keeps rows with null or clashing values as its operator says: null and empty texts have no letter, so the
first stage rejects them; of rows that share an id, ties go to their place in the staged table; only the columns of
``documents`` are carried, so extra columns are dropped.  Empty tables give no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdq.llm import dart_minhash, exact_dedup, language_id, mixing, queries
from sparkdq.llm.samples import fold
from sparkdq.llm.stage import Scope, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Mixing: this share of the tokens that come in is the budget, and no document is used twice.
TOKEN_SHARE, EPOCHS, SEED = 0.8, 1, 23


#: What the stage called last has staged, by application and folder.
_open: dict[tuple[str, str], Scope] = {}


def _stage(work):
    @functools.wraps(work)
    def alone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key in _open:
            _open.pop(key).close()
        with _open.setdefault(key, Scope(spark)):
            return work(spark, docs, sf_dir)

    return alone


def _columns(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"row.{c}") for c in COLUMNS])


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, learned from the same folds as op9, does not reject."""
    model = language_id.train(docs.filter(fold(F.col("doc_id"), 4) != 2))
    return _columns(language_id.identify(docs, model, carry=COLUMNS).filter("NOT rejected"))


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text (white-space runs as one space) the smallest doc_id stays."""
    return _columns(exact_dedup.exact_dedup(docs, carry=COLUMNS).filter("kept"))


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle similarity the smallest doc_id stays."""
    return _columns(dart_minhash.near_duplicates(docs, carry=COLUMNS).kept_rows())


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen to fill the budget tree of domain, language and source."""
    return _columns(mixing.mix(docs, F.expr(queries.DOMAIN), TOKEN_SHARE, queries.WEIGHTS, epochs=EPOCHS, seed=SEED, carry=COLUMNS))


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every remaining document."""
    return queries.bpe_digests(docs)


STAGES = [("language ID", identify_language), ("exact dedup", drop_copies), ("MinHash near-dedup", drop_near_copies),
          ("mixing sources", mix_sources), ("BPE encoding", encode)]

#: A trained model and a tokenizer have no SQL form; the tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), None
    for _, stage in STAGES:
        with Scope(spark) as staged:
            result = stage.__wrapped__(spark, docs, sf_dir)
        with Scope(spark) as kept:
            docs = written(result)
        staged.close()
        if before:
            before.close()
        before = kept
    return docs
