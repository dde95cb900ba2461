"""Registered queries: personal-data signals (D1-D6) and retrieval."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import phrases as PH
from ..operators import retrieval as R
from ..operators import signals as S
from ..sources.tables import read_table
from .registry import register

CLASS_NAMES = {"0": "name", "1": "email", "2": "phone", "3": "dob"}


#: The gazetteer of the queries: long words of the benchmark texts, their class by their length.
GAZETTEER_SQL = """SELECT word, CASE length(word) % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'GPE' ELSE 'LOC' END AS class
FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM benchmark) b WHERE length(word) >= 12"""
#: Terms of D5 that the texts hold.
TERMS = ("licensed under", "all rights reserved", "token", "password", "the", "c++")


def gazetteer(spark, sf_dir):
    words = read_table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), S.NON_WORD_RE)).alias("word"))
    n = F.length("word")
    return words.where(n >= 12).distinct().select("word", F.when(n % 3 == 0, "PERSON").when(n % 3 == 1, "GPE").otherwise("LOC").alias("class"))


def _gaz_sql():
    return f"({GAZETTEER_SQL}) AS gaz"


def _sq(s: str) -> str:
    return s.replace("'", "''")


def _entity_sql(values_sql: str, key: str, gaz: str | None = None) -> str:
    return f"""v AS ({values_sql}),
present AS (SELECT DISTINCT {key} FROM v WHERE NOT regexp_matches(value, '^\\s*$')),
dates AS (SELECT {key}, 'DATE' AS class, sum(len(regexp_extract_all(value, '{_sq(S.DATE_RE)}'))) AS n FROM v GROUP BY {key}),
w AS (SELECT {key}, unnest(regexp_extract_all(lower(value), '\\p{{L}}+')) AS word FROM v),
named AS (SELECT {key}, gaz.class, count(*) AS n FROM w JOIN {gaz or _gaz_sql()} ON w.word = gaz.word GROUP BY ALL),
counts AS (SELECT * FROM dates UNION ALL SELECT * FROM named),
ent AS (SELECT p.{key}, c.class, CAST(coalesce(x.n, 0) AS BIGINT) AS n
        FROM present p CROSS JOIN (VALUES ('PERSON'), ('GPE'), ('LOC'), ('DATE')) AS c(class)
        LEFT JOIN counts x ON x.{key} = p.{key} AND x.class = c.class)"""


ENTITY_SQL = "WITH " + _entity_sql(
    """SELECT 'text' AS "column", text AS value FROM documents WHERE text IS NOT NULL
       UNION ALL SELECT 'lang', lang FROM documents WHERE lang IS NOT NULL
       UNION ALL SELECT 'source', source FROM documents WHERE source IS NOT NULL""", '"column"') + "\nSELECT * FROM ent"


@register("d_entity_counts", ENTITY_SQL)
def d_entity_counts(spark, sf_dir):
    """D1 (re-aimed): DATE / PERSON / GPE / LOC counts per column over every document."""
    docs = read_table(spark, sf_dir, "documents")
    return S.entity_counts(docs, ["text", "lang", "source"], gazetteer(spark, sf_dir))


def _exemplar_cte(per_label: int) -> str:
    """The first ``per_label`` vectors of each label are its exemplars, a parameter of the method."""
    return f"""e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ex AS (SELECT label, v FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM e) t WHERE rn <= {per_label}),
sim AS (SELECT e.vec_id, CAST(ex.label AS VARCHAR) AS class,
               round(avg(list_dot_product(e.v, ex.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(ex.v, ex.v)))), 3) AS similarity
        FROM e CROSS JOIN ex GROUP BY e.vec_id, ex.label)"""



def label_exemplars(spark, sf_dir, per_label: int = 3):
    emb = read_table(spark, sf_dir, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    return (emb.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_label)
            .select(F.col("label").cast("string").alias("class"), "embedding"))


def exemplar_sims(spark, sf_dir, per_label: int = 3):
    emb = read_table(spark, sf_dir, "embeddings")
    return S.exemplar_similarity(emb, label_exemplars(spark, sf_dir, per_label))


@register("d_exemplar_similarity", f"WITH {_exemplar_cte(3)}\nSELECT * FROM sim")
def d_exemplar_similarity(spark, sf_dir):
    """Mean cosine of every vector with the first three vectors of each label."""
    return exemplar_sims(spark, sf_dir)


RISK_SQL = "WITH " + _entity_sql("SELECT doc_id, text AS value FROM documents WHERE text IS NOT NULL", "doc_id") + f""",
{_exemplar_cte(1)},
s AS (SELECT vec_id AS doc_id,
             max(CASE WHEN class = '0' THEN similarity END) AS s_name, max(CASE WHEN class = '1' THEN similarity END) AS s_email,
             max(CASE WHEN class = '2' THEN similarity END) AS s_phone, max(CASE WHEN class = '3' THEN similarity END) AS s_dob
      FROM sim GROUP BY vec_id),
en AS (SELECT doc_id, sum(CASE WHEN class = 'PERSON' THEN n END) AS p, sum(CASE WHEN class = 'GPE' THEN n END) AS g,
              sum(CASE WHEN class = 'LOC' THEN n END) AS l, sum(CASE WHEN class = 'DATE' THEN n END) AS d
       FROM ent GROUP BY doc_id),
sc AS (SELECT s.doc_id, CAST(least(coalesce(p, 0) * 5 + (coalesce(g, 0) + coalesce(l, 0)) * 4 + coalesce(d, 0) * 4
                  + CASE WHEN coalesce(s_name, 0) > 0.7 THEN 50 ELSE 0 END + CASE WHEN coalesce(s_email, 0) > 0.7 THEN 40 ELSE 0 END
                  + CASE WHEN coalesce(s_phone, 0) > 0.7 THEN 40 ELSE 0 END + CASE WHEN coalesce(s_dob, 0) > 0.7 THEN 45 ELSE 0 END
                  + CASE WHEN contains(CAST(s.doc_id AS VARCHAR), 'mail') THEN 10 ELSE 0 END, 100) AS INTEGER) AS risk_score
       FROM s LEFT JOIN en ON s.doc_id = en.doc_id)
SELECT doc_id, risk_score, CASE WHEN risk_score >= 70 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM sc"""


@register("d_risk_scores", RISK_SQL)
def d_risk_scores(spark, sf_dir):
    """Risk score and level per document (entities of its text, similarity of its vector)."""
    docs = read_table(spark, sf_dir, "documents")
    ent = S.entity_counts(docs, ["text"], gazetteer(spark, sf_dir), group_col="doc_id")
    sims = exemplar_sims(spark, sf_dir, 1).withColumnRenamed("vec_id", "doc_id")
    risk = S.risk_scores(ent, sims, key="doc_id", has_email_check=True, class_names=CLASS_NAMES)
    return risk.withColumn("risk_level", S.risk_level("risk_score"))


_TERMS_ALT = "|".join(re.escape(t) for t in sorted(TERMS, key=len, reverse=True) if t != "c++")


@register("d_term_hits", f"""
SELECT source, term, count(*) AS n
FROM (SELECT source, unnest(regexp_extract_all(lower(text), '\\b({_TERMS_ALT})\\b', 1)) AS term FROM documents) t
GROUP BY source, term""")
def d_term_hits(spark, sf_dir):
    """Sensitive-term occurrences per source over every document."""
    return S.term_hits(read_table(spark, sf_dir, "documents"), "text", ["source"], TERMS)


@register("d_phrase_hits")
def d_phrase_hits(spark, sf_dir):
    """Phrases of several words per source: the first three and first five words of every benchmark item."""
    items = F.split(F.col("text"), r"\s+")
    terms = read_table(spark, sf_dir, "benchmark").select(F.explode(F.array(*[F.array_join(F.slice(items, 1, n), " ") for n in (3, 5)])).alias("phrase"))
    return PH.phrase_counts(read_table(spark, sf_dir, "documents"), "text", ["source"], terms)


def _text_match_sql():
    parts = []
    for kind, pat in S.TEXT_PATTERNS.items():
        parts.append(f"SELECT source, '{kind}' AS kind, len(regexp_extract_all(text, '{_sq(pat)}')) AS m FROM documents")
    return ("SELECT source, kind, CAST(sum(m) AS BIGINT) AS n_matches, count(*) AS n_docs FROM ("
            + " UNION ALL ".join(parts) + ") t WHERE m > 0 GROUP BY source, kind")


@register("d_text_matches", _text_match_sql())
def d_text_matches(spark, sf_dir):
    """E-mail / phone pattern matches in free text per source."""
    return S.text_matches(read_table(spark, sf_dir, "documents"), "text", ["source"])


CENTROID_CTE = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT label, unnest(range(len(v))) AS i, unnest(v) AS val FROM e),
c AS (SELECT label, list(m ORDER BY i) AS cv FROM (SELECT label, i, avg(val) AS m FROM x GROUP BY label, i) t GROUP BY label),
d AS (SELECT c.label, e.vec_id,
             list_sum(list_transform(list_zip(e.v, c.cv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist FROM e CROSS JOIN c),
hits AS (SELECT label, CAST(rn AS INTEGER) AS rank, vec_id, dist
         FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS rn FROM d) t WHERE rn <= 6)"""


def centroid_hits(spark, sf_dir, k: int = 6):
    emb = read_table(spark, sf_dir, "embeddings")
    queries = R.centroids(emb, "label")
    return R.top_k(emb, queries, k=k, metric="l2", doc_id="vec_id", query_id="label")


@register("r_top_k", f"WITH {CENTROID_CTE}\nSELECT label, rank, vec_id, round(dist, 6) AS distance FROM hits")
def r_top_k(spark, sf_dir):
    """Six nearest vectors (squared L2) of every label centroid, exact."""
    return centroid_hits(spark, sf_dir).withColumn("distance", F.round("distance", 6))


@register("r_combined_text", f"""WITH {CENTROID_CTE}
SELECT label, string_agg(d.text, chr(10) || chr(10) ORDER BY rank) AS combined_text
FROM hits JOIN documents d ON d.doc_id = hits.vec_id GROUP BY label""")
def r_combined_text(spark, sf_dir):
    """The hit documents' texts joined in rank order per query."""
    hits = centroid_hits(spark, sf_dir).withColumnRenamed("vec_id", "doc_id")
    return R.combined_text(hits, read_table(spark, sf_dir, "documents"), query_id="label")


@register("r_flatten_dedupe", """
WITH x AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, source FROM documents UNION ALL SELECT doc_id, NULL FROM documents),
t AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM x)
SELECT min(doc_id) AS doc_id, text, count(*) AS n_copies FROM t WHERE text <> '' GROUP BY text""")
def r_flatten_dedupe(spark, sf_dir):
    """R2: nested texts flattened; distinct stripped texts, first-seen id and number of copies."""
    docs = read_table(spark, sf_dir, "documents")
    item = lambda c: F.struct(F.lit(None).cast("string").alias("document"), c.cast("string").alias("text"))
    nested = docs.select("doc_id", F.array(item(F.col("text")), item(F.col("source")), item(F.lit(None))).alias("text"))
    return R.flatten_dedupe(nested)


@register("s_ingest", """
SELECT doc_id, text FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def s_ingest(spark, sf_dir):
    """Insert-if-absent; the store already holds the labelled documents, and every new id comes twice."""
    docs = read_table(spark, sf_dir, "documents")
    store = docs.join(read_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    later = docs.withColumn("text", F.concat(F.lit("later: "), "text")).withColumn("version", F.lit(2))
    return R.ingest(docs.withColumn("version", F.lit(1)).unionByName(later), store, order_by=["version"]).select("doc_id", "text")
