"""The pipeline against a plain, Spark-free version of every stage's decision."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from oracle_compare import compare, duck_connect
from pyspark.sql import functions as F
from test_dart_minhash import classes, edited
from tokenizers import Tokenizer

import corpus_pipeline as cp
from sparkdq.llm import language_id, mixing, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_oracle(spark, name):
    ok, msg = compare(spark, duck_connect(SF), name, queries.QUERIES[name], queries.ORACLE[name], SF)
    assert ok, msg


def test_pipeline_equals_brute_force(spark, tmp_path):
    import random

    rnd = random.Random(1)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = [r for r in docs.collect() if len((r.text or "").split()) > 60]
    near = [(10_000 + i, edited(rnd, r.text.split(), 1), r.lang, r.source, r.n_chars) for i, r in enumerate(some[:8])]
    docs = docs.unionByName(spark.createDataFrame([*near, (20_000, None, None, None, None), (20_001, "1234 !!", "en", "src1", 7), (20_002, "", "en", "src1", 0)], docs.schema))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in cp.run(spark, str(tmp_path)).collect()}

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["language ID", "exact dedup", "MinHash near-dedup", "mixing sources", "BPE encoding"]
    model = language_id.train(docs.filter(cp.fold(F.col("doc_id"), 4) != 2))
    rejected = {r.row.doc_id for r in language_id.identify(docs, model, ["doc_id"]).filter("rejected").collect()}
    assert {20_000, 20_001, 20_002} <= rejected and len(rejected) < 10
    rows = sorted((r for r in docs.collect() if r.doc_id not in rejected), key=lambda r: r.doc_id)
    seen, unique = set(), []
    for r in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r.text)
        if norm not in seen:
            seen.add(norm)
            unique.append(r)
    kept = [r for r, c in zip(unique, classes([(r.doc_id, r.text) for r in unique]), strict=True) if r.doc_id == c]
    assert len(kept) < len(unique) < len(rows)
    leaf = lambda r: (f"domain{int(re.search('[0-9]+$', r.source)[0]) % 4}", r.lang, r.source)
    tokens = lambda r: len(r.text.split())
    supply = {}
    for r in kept:
        supply[leaf(r)] = supply.get(leaf(r), 0) + tokens(r)
    total = int(sum(supply.values()) * cp.TOKEN_SHARE)
    leaves = spark.createDataFrame([(*k, v) for k, v in supply.items()], "domain string, lang string, source string, supply long")
    mixed = []
    for b in mixing.budgets(leaves, total, queries.WEIGHTS, 1).collect():
        mine = [r for r in kept if leaf(r) == (b.domain, b.lang, b.source)]
        passes, room = divmod(b.budget, b.supply)
        place = lambda r: int(hashlib.md5(f"{cp.SEED}|{passes}|{r.doc_id}".encode()).hexdigest()[:12], 16)  # noqa: E731, B023
        for r in sorted(mine, key=place):
            room -= tokens(r)
            if passes or room >= 0:
                mixed.append(r)
    tokenizer, sha = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for r in mixed:
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(r.text.encode()))
    assert got == want


def test_stages_take_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
