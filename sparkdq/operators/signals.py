"""Personal-data signals.

D1 re-aims a named-entity model as regular expressions (DATE) plus a
gazetteer join (PERSON / GPE / LOC); D2 compares vectors with labelled
exemplars; D3 turns both into a 0-100 risk score and D4 into a level.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import dot, norm
from .util import col

ENTITY_CLASSES = ("PERSON", "GPE", "LOC", "DATE")

# Our own re-aimed patterns and word lists (not the model's behaviour).
DATE_RE = (r"\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|"
           r"(?:January|February|March|April|May|June|July|August|September|October|November|December)"
           r" (?:[0-9]{1,2}, )?[0-9]{4})\b")
WORD_RE = r"\p{L}+"
NON_WORD_RE = r"[^\p{L}]+"
DEFAULT_GAZETTEER = {
    "PERSON": ("john", "jane", "maria", "mary", "james", "robert", "michael", "david", "anna", "peter",
               "paul", "laura", "sarah", "thomas", "pierre", "jean", "juan", "carlos", "hans", "klaus"),
    "GPE": ("paris", "london", "berlin", "madrid", "rome", "vienna", "france", "germany", "spain", "italy",
            "england", "india", "china", "canada", "mexico", "texas", "california", "tokyo", "munich", "lyon"),
    "LOC": ("alps", "andes", "sahara", "amazon", "danube", "rhine", "seine", "thames", "pacific", "atlantic",
            "everest", "mediterranean", "himalaya", "pyrenees", "baltic"),
}
# Risk weights (fixed values of the scoring rule).
WEIGHT_PERSON = 5
WEIGHT_PLACE = 4
WEIGHT_DATE = 4
CLASS_BONUS = {"name": 50, "email": 40, "phone": 40, "dob": 45}
SIMILARITY_THRESHOLD = 0.7
EMAIL_CHECK_BONUS = 10
RISK_CAP = 100
# Sensitive terms named in the personal-data rules text.
SENSITIVE_TERMS = ("racial", "health", "biometric", "name", "email", "phone", "national id", "address",
                   "date of birth")
TEXT_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}",
}
# A literal every match of the pattern contains: texts without it skip the regex.
TEXT_PATTERN_MARKERS = {"email": "@", "phone": "+"}


def gazetteer_frame(spark: SparkSession, gazetteer: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    seen: dict[str, str] = {}
    for cls, words in (gazetteer or DEFAULT_GAZETTEER).items():
        for w in words:
            seen.setdefault(w.lower(), cls)
    return spark.createDataFrame(sorted(seen.items()), "word string, class string")


def unpivot_strings(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[Column] = (), skip: Sequence[str] = ()) -> DataFrame:
    """``(keep..., column, value)`` for every present value of the string columns (or of ``columns``)."""
    cols = list(columns) if columns is not None else [f.name for f in df.schema.fields
                                                        if f.dataType.simpleString() == "string"]
    cols = [c for c in cols if c in df.columns and c not in skip]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in cols])
    return df.select(*keep, F.inline(pairs)).where(F.col("value").isNotNull())


def entity_counts(df: DataFrame, columns: Sequence[str] | None = None, gazetteer: DataFrame | None = None,
                  group_col: str = "column", sample_rows: int | None = None,
                  order_by: Sequence[str] | None = None) -> DataFrame:
    """``(group, class, n)`` for PERSON, GPE, LOC, DATE.

    By default every value is read (``sample_rows=None``).  ``sample_rows=20``
    with an ``order_by`` reproduces the first-20-values reading; the order
    columns stay columns that are read.  A group whose text is blank gets no
    rows.  One pass: each value gives its date count and its words, the words
    meet the gazetteer, and the counts of a group are summed once.
    """
    spark = df.sparkSession
    gaz = gazetteer if gazetteer is not None else gazetteer_frame(spark)
    own = [group_col] if group_col != "column" else []
    order = [col(c).alias(f"_o{i}") for i, c in enumerate(order_by or [])]
    vals = unpivot_strings(df, columns, [col(c).alias(c) for c in own] + order, own)
    key = group_col
    if sample_rows is not None:
        from pyspark.sql import Window

        w = Window.partitionBy(col(key)).orderBy(*([F.col(f"_o{i}") for i in range(len(order))] or ["value"]))
        vals = vals.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= sample_rows)
    vals = vals.select(col(key).alias("_k"), "value")
    marks = F.array(F.struct(F.lit(None).cast("string").alias("word"), F.regexp_count("value", F.lit(DATE_RE)).alias("dates"),
                             (~F.col("value").rlike(r"^\s*$")).alias("present")))
    words = F.transform(F.array_remove(F.split(F.lower("value"), NON_WORD_RE), ""), lambda x: F.struct(
        x.alias("word"), F.lit(0).alias("dates"), F.lit(False).alias("present")))
    found = vals.select("_k", F.inline(F.concat(marks, words))).join(gaz, "word", "left")
    per_key = found.groupBy("_k").agg(
        F.max("present").alias("present"), F.sum("dates").alias("DATE"),
        *[F.count_if(F.col("class") == c).alias(c) for c in ENTITY_CLASSES if c != "DATE"])
    rows = F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).cast("bigint").alias("n")) for c in ENTITY_CLASSES])
    return per_key.where("present").select(F.col("_k").alias(key), F.inline(rows))


def entity_counts_with_model(df: DataFrame, extractor, columns: Sequence[str] | None = None,
                             group_col: str = "column") -> DataFrame:
    """D1 with a supplied entity model: ``extractor(pd.Series[str]) -> pd.Series[list[str]]`` of entity labels.

    The model runs in an Arrow-batched ``pandas_udf`` over each value (rows stay
    partitioned across executors); only PERSON / GPE / LOC / DATE labels are
    counted per group.
    """
    import warnings

    from pyspark.sql.functions import PandasUDFType, pandas_udf

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        labels = pandas_udf(lambda values: extractor(values), "array<string>", PandasUDFType.SCALAR)

    key_cols = [group_col] if group_col != "column" else []
    vals = unpivot_strings(df, columns, [col(c).alias(c) for c in key_cols], key_cols)
    key = group_col
    present = vals.where(~F.col("value").rlike(r"^\s*$")).select(key).distinct()
    found = (vals.select(key, F.explode(labels("value")).alias("class"))
             .where(F.col("class").isin(*ENTITY_CLASSES)).groupBy(key, "class").agg(F.count(F.lit(1)).alias("n")))
    grid = present.select(key, F.explode(F.array(*[F.lit(c) for c in ENTITY_CLASSES])).alias("class"))
    return grid.join(found, [key, "class"], "left").select(key, "class", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def exemplar_similarity(vectors: DataFrame, exemplars: DataFrame, id_col: str = "vec_id",
                        vec_col: str = "embedding", class_col: str = "class", digits: int = 3) -> DataFrame:
    """Mean cosine similarity of every vector with each class's exemplars.

    The mean cosine is linear in the normalised exemplars,
    ``mean_e cos(v, e) = (v . sum_e e/|e|) / (n |v|)``, so a distributed sum per
    (class, position) turns any number of exemplars into one vector per class,
    and the classes' vectors reach the rows as one value.  Exemplars without
    length (null, zero, or with a missing or NaN part) are left out; a vector
    without length has a null similarity.
    """
    v = F.col(vec_col).cast("array<double>")
    unit = exemplars.select(F.col(class_col).cast("string").alias("c"), v.alias("v"), norm(v).alias("l")).where("l > 0 AND l < double('Infinity')")
    unit = unit.select("c", F.transform("v", lambda x: F.try_divide(x, F.col("l"))).alias("u"))
    per_pos = unit.select("c", F.posexplode("u").alias("pos", "x")).groupBy("c", "pos").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    classes = per_pos.groupBy("c").agg(F.max("n").alias("n"), F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda t: t["s"]).alias("s"))
    every = classes.agg(F.array_sort(F.collect_list(F.struct("c", "n", "s"))).alias("e")).scalar()
    own = vectors.select(id_col, v.alias("_v"), norm(v).alias("_l"), every.alias("_e"))
    ok = (F.col("_l") > 0) & (F.col("_l") < float("inf"))
    sims = F.transform("_e", lambda e: F.struct(e["c"].alias("class"), F.when(
        ok, F.round(F.try_divide(dot(F.col("_v"), e["s"]), e["n"] * F.col("_l")), digits)).alias("similarity")))
    return own.select(id_col, F.inline(sims))


def risk_scores(entities: DataFrame, similarities: DataFrame, key: str = "column",
                has_email_check: bool = False, class_names: Mapping[str, str] | None = None,
                with_counts: bool = False) -> DataFrame:
    """D3: ``(key, risk_score)`` for every key of the similarity side (as the reference iterates).

    ``entities``: ``(key, class, n)`` from D1; ``similarities``: ``(key, class, similarity)``.
    ``with_counts`` adds the entity counts as ``e_<CLASS>``.
    ``class_names`` maps similarity classes to the bonus classes name/email/phone/dob.
    """
    sim = similarities
    if class_names:
        m = F.create_map(*[x for k, v in class_names.items() for x in (F.lit(k), F.lit(v))])
        sim = sim.withColumn("class", F.coalesce(m[F.col("class")], F.col("class")))
    s = sim.groupBy(key).agg(*[
        F.max(F.when(F.col("class") == c, F.col("similarity"))).alias(f"s_{c}") for c in CLASS_BONUS])
    e = entities.groupBy(key).agg(*[
        F.sum(F.when(F.col("class") == c, F.col("n"))).alias(f"e_{c}") for c in ENTITY_CLASSES])
    j = s.join(e, key, "left")
    ent = lambda c: F.coalesce(F.col(f"e_{c}"), F.lit(0))
    score = (ent("PERSON") * WEIGHT_PERSON + (ent("GPE") + ent("LOC")) * WEIGHT_PLACE + ent("DATE") * WEIGHT_DATE)
    for c, bonus in CLASS_BONUS.items():
        score = score + F.when(F.coalesce(F.col(f"s_{c}"), F.lit(0.0)) > SIMILARITY_THRESHOLD, bonus).otherwise(0)
    if has_email_check:
        score = score + F.when(F.col(key).cast("string").contains("mail"), EMAIL_CHECK_BONUS).otherwise(0)
    counts = [F.col(f"e_{c}") for c in ENTITY_CLASSES] if with_counts else []
    return j.select(key, F.least(score, F.lit(RISK_CAP)).cast("int").alias("risk_score"), *counts)


def risk_level(score: Column | str) -> Column:
    """HIGH from 70, MEDIUM from 40, else LOW."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= 70, "HIGH").when(s >= 40, "MEDIUM").otherwise("LOW")


def term_hits(df: DataFrame, text_col: str, group_cols: Sequence[str], terms: Sequence[str] = SENSITIVE_TERMS
              ) -> DataFrame:
    """``(group..., term, n)`` case-insensitive whole-word occurrences of each term."""
    alt = "|".join(re.escape(t.lower()) for t in sorted(terms, key=len, reverse=True))
    pat = rf"(?<!\w)({alt})(?!\w)"
    hits = df.select(*group_cols, F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(pat), F.lit(1))).alias("term"))
    return hits.groupBy(*group_cols, "term").agg(F.count(F.lit(1)).alias("n"))


def text_matches(df: DataFrame, text_col: str, group_cols: Sequence[str],
                 patterns: Mapping[str, str] | None = None) -> DataFrame:
    """``(group..., kind, n_matches, n_docs)`` for e-mail / phone patterns over free text."""
    pats = patterns or TEXT_PATTERNS
    markers = TEXT_PATTERN_MARKERS if patterns is None else {}

    def n_matches(kind: str, pat: str) -> Column:
        m = F.size(F.regexp_extract_all(text_col, F.lit(pat), F.lit(0)))
        return F.when(F.col(text_col).contains(markers[kind]), m).otherwise(0) if kind in markers else m

    arr = F.array(*[F.struct(F.lit(k).alias("kind"), n_matches(k, p).alias("m")) for k, p in pats.items()])
    per_doc = df.select(*group_cols, F.inline(arr)).where(F.col("m") > 0)
    return per_doc.groupBy(*group_cols, "kind").agg(F.sum("m").cast("bigint").alias("n_matches"),
                                                    F.count(F.lit(1)).alias("n_docs"))
