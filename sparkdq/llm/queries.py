"""Registered queries opN_<name> and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdq.session import scratch_path

from . import dart_minhash, language_id, line_dedup, mixing, periodic_runs, quality, source_divergence, topk_search, toxicity, warc
from .bpe import encode_decode
from .exact_dedup import exact_dedup
from .samples import fold
from .token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return deco


@_register("op1_exact_dedup", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(_table(spark, sf_dir, "documents"))
    return found.selectExpr("id AS doc_id", "keep_id", "group_size", "kept", "digest AS text_sha256")


@_register("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    model = language_id.train(docs.filter(~held))
    found = language_id.identify(docs, model, carry=["doc_id"]).withColumn("doc_id", F.col("row.doc_id"))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


@_register("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    model = toxicity.train(docs.select("doc_id", "text"), labels=_table(spark, sf_dir, "labels").filter(~held))
    found = toxicity.rate(docs, model, carry=["doc_id"]).withColumn("doc_id", F.col("row.doc_id"))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_register("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 5) == 0
    model = quality.train(docs.select("doc_id", "text"), labels=_table(spark, sf_dir, "labels").filter(~held))
    found = quality.rate(docs, model, carry=["doc_id"]).withColumn("doc_id", F.col("row.doc_id"))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def tokenizer_json(name: str) -> str:
    """Definition of a public tokenizer, read on the driver and shipped to the executors (under 2 MB)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@_register("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(_table(spark, sf_dir, "documents"), tokenizer_json("word_bpe_49k.json"), carry=["doc_id"])
    return counted.select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    coded = encode_decode(docs, tokenizer_json("byte_bpe_50k.json"), carry=["doc_id"])
    return coded.select("row.doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@_register("op8_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents"))


@_register("op2_warc")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    facts = warc.payload_facts(warc.read_archives(spark, path))
    return facts.select(F.col("key").cast("bigint").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                        "record_type", F.col("refers_to").cast("bigint").alias("refers_to"), "problem")


@_register("op4_topk_search", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)
SELECT query_id, rn::INTEGER AS rank, vec_id, score FROM r WHERE rn <= 5
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")


#: Target weights of op3: domains are the last number in a source's name modulo 4 (the table has no domain column).
DOMAIN = "concat('domain', coalesce(cast(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int) % 4 AS string), ' unknown'))"
WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 6, "de": 2, "fr": 1, "es": 1}}


def _level_sql(i: int) -> str:
    """One level of the budget tree in SQL: children ``n``, their shares of the parent's budget."""
    names = list(mixing.LEVELS[: i + 1])
    keys, parent = ", ".join(names), ", ".join(names[:-1]) or "1"
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.get(names[-1], {}).items())
    weight = f"CASE {names[-1]} {cases} ELSE 1 END" if cases else "1"
    given = "JOIN b{0} USING ({1})".format(i - 1, ", ".join(names[:-1])) if i else "CROSS JOIN budget"
    upper = ", b%d.budget AS given" % (i - 1) if i else ", budget.total AS given"
    order = f"ORDER BY cap::DOUBLE / weight::DOUBLE, {names[-1]}"
    return f"""
n{i} AS (SELECT x.*{upper}, {weight} AS weight FROM (SELECT {keys}, sum(supply)::BIGINT * 2 AS cap FROM leaves GROUP BY ALL) x {given}),
f{i} AS (SELECT *, cap::HUGEINT * sum(weight) OVER (PARTITION BY {parent} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
       <= (given - coalesce(sum(cap) OVER (PARTITION BY {parent} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::HUGEINT * weight AS is_full FROM n{i}),
r{i} AS (SELECT *, given - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (PARTITION BY {parent}), 0) AS rest,
       sum(CASE WHEN NOT is_full THEN weight END) OVER (PARTITION BY {parent}) AS total,
       sum(weight) OVER (PARTITION BY {parent}, is_full {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM f{i}),
b{i} AS (SELECT {keys}, CASE WHEN is_full THEN cap ELSE rest::HUGEINT * upto // total - rest::HUGEINT * (upto - weight) // total END::BIGINT AS budget FROM r{i})"""


@_register("op3_mixing", """
WITH d AS (SELECT doc_id, 'domain' || coalesce((TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 4)::VARCHAR, ' unknown') AS domain,
       coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
       coalesce(len(regexp_extract_all(text, '[^\\x09-\\x0D\\x20]+')), 0)::BIGINT AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS supply FROM d GROUP BY ALL),
budget AS (SELECT floor(sum(supply) * 0.5::DOUBLE)::BIGINT AS total FROM leaves),""" + ",".join(_level_sql(i) for i in range(3)) + """,
p AS (SELECT domain, lang, source, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS passes,
       CASE WHEN supply > 0 THEN budget % supply ELSE 0 END AS room FROM b2 JOIN leaves USING (domain, lang, source)),
o AS (SELECT d.*, passes, room, ('0x' || substr(md5('17|' || passes || '|' || doc_id), 1, 12))::BIGINT AS place FROM d JOIN p USING (domain, lang, source)),
c AS (SELECT *, passes + (passes < 2 AND sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= room)::INTEGER AS copies FROM o)
SELECT doc_id, domain, lang, source, tokens AS n_tokens, copies::INTEGER AS copies FROM c WHERE copies > 0
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.mix(_table(spark, sf_dir, "documents"), F.expr(DOMAIN), 0.5, WEIGHTS, epochs=2, seed=17)
    return chosen.select("row.doc_id", "domain", "lang", "source", F.col("tokens").alias("n_tokens"), "copies")


@_register("op5_dart_minhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dart_minhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.verdict.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


@_register("op11_source_divergence", r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
v AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT k) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN v USING (lang, term) GROUP BY ALL),
w AS (SELECT lang, count(*) AS v FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT n.lang, n.source, v.term, coalesce(c.n, 0) AS c, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (n.n + w.v))::HUGEINT AS p
      FROM n JOIN w USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = v.term),
q AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (sum(c)::HUGEINT + 1) // (any_value(total) + any_value(v)))::HUGEINT AS q
      FROM p JOIN (SELECT lang, sum(n)::HUGEINT AS total FROM n GROUP BY lang) USING (lang) JOIN w USING (lang) GROUP BY lang, term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL
      SELECT p.lang, p.source, 'term', p.term, ((p.p - q.q) * (p.p - q.q) // q.q)::BIGINT FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 200
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(_table(spark, sf_dir, "documents"))


@_register("op12_line_dedup", r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS stays FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT doc_id, line, i, coalesce(doc_id <> stays, false) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(_table(spark, sf_dir, "documents")).applied()
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@_register("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_facts(_table(spark, sf_dir, "documents"))
