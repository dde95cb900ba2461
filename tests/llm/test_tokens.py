import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkdq.llm import bpe, queries
from sparkdq.llm.token_counts import token_counts

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def mixed(spark, odd_docs):
    """Odd texts and random strings of awkward pieces, some shared between partitions."""
    rnd = random.Random(4)
    pieces = ["the", " of", ",", "\n", " ", "  ", "\t", "é", "中", "'s", "<|endoftext|>", "123", " x", ".\n\n", " ", "😀"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 6000))) for _ in range(20)]
    shared = " ".join("".join(rnd.choices("etaoinsh", k=5)) for _ in range(3000))
    texts += [f"{t[:50]} {shared} {i}" for i, t in enumerate(texts[:6])]
    more = spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string").repartition(4)
    return odd_docs.select("doc_id", "text").filter("doc_id IS NOT NULL").distinct().unionByName(more).cache()


def test_token_counts_equal_the_library(mixed):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(WORD))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(mixed, queries.tokenizer_json(WORD), ["doc_id"]).select("row.doc_id", "n_bytes", "n_tokens").collect()}
    for r in mixed.collect():
        t = r.text or ""
        assert got[r.doc_id] == (len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False).ids)), repr(t[:60])


def test_bpe_equals_the_library(mixed):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(BYTE))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.bpe_digests(mixed).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in mixed.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tokenizer.decode(ids, skip_special_tokens=False).encode())), repr(r.text)[:60]


def test_repeated_rows_and_clashing_columns(odd_docs, no_docs):
    carry = ["doc_id", "row", "_marked"]
    assert token_counts(odd_docs, queries.tokenizer_json(WORD), carry).count() == odd_docs.count()
    coded = bpe.encode_decode(odd_docs, queries.tokenizer_json(BYTE), carry)
    assert coded.count() == odd_docs.count() and coded.select("row.*").columns == carry
    assert token_counts(no_docs, queries.tokenizer_json(WORD), ["doc_id"]).count() == 0
    assert queries.bpe_digests(no_docs).count() == 0


def test_chunks_cover_the_text_and_do_not_depend_on_what_stands_before():
    rnd, table = random.Random(1), bpe.gear()
    passage = " ".join("".join(rnd.choices("etaoinsh", k=5)) for _ in range(4000)).encode()
    bodies = []
    for before in (b"", b"some other beginning " * 50):
        data = before + passage
        found = bpe.bodies(data, table)
        assert all(a < b <= c < d for (a, b), (c, d) in zip(found, found[1:], strict=False)) and b"".join(bpe.pieces_of(data)) == data
        bodies.append({data[x:y] for x, y in found})
    assert len(bodies[0] & bodies[1]) >= 0.8 * len(bodies[0]) > 5


def test_joins_are_repaired_until_they_agree():
    codec = bpe.Codec(queries.tokenizer_json(BYTE))
    text = ("something" * 5 + " of the reusable kind 12345, isn't it?   " * 3).encode()
    for cut in ([9, 13, 50, 71], [3], [45, 46, 47, 48, 49], list(range(1, len(text), 2)), []):
        pieces = [text[x:y] for x, y in zip([0, *cut], [*cut, len(text)], strict=True)]
        codec.pieces |= dict(zip(pieces, codec.whole(pieces), strict=True))
        joins = [i for i in range(1, len(pieces)) if codec.disagreeing({(pieces[i - 1], pieces[i])})]
        got = codec.repaired(pieces, list(range(1, len(pieces))))
        assert got == codec.whole([text])[0] and (joins or not cut or got)
    a, b = b" reus", b"able"
    codec.pieces |= {a: codec.whole([a])[0], b: codec.whole([b])[0]}
    assert codec.disagreeing({(a, b)}) == {(a, b)}


def test_false_borders_between_reused_bodies_are_found(spark, monkeypatch):
    """With borders inside words, joins of reused bodies disagree and the repair still gives the library's ids."""
    import pyarrow as pa

    codec = bpe.Lazy(queries.tokenizer_json(BYTE))
    data = b"prefix words unbelievable endings and more words"
    monkeypatch.setattr(bpe, "borders", lambda view: np.array([6, 12, 17, 25, 33]))
    body = data[12:17]
    k = bpe.key(body)
    docs = pa.table({"row": [1], "text": [data.decode()], "spans": [np.array([[12, 17]], "<u4").tobytes()], "keys": pa.array([[k]], pa.list_(pa.binary()))})
    ids = codec.get().whole([body])[0]
    got = bpe._assemble(codec)(docs, pa.table({"key": [k], "ids": [ids]})).to_pylist()[0]
    assert got["ids"] == codec.get().whole([data])[0] and got["decoded"] == data.decode()


def test_foreign_tokenizers_are_refused(spark, odd_docs):
    with pytest.raises(ValueError):
        bpe.encode_decode(odd_docs, queries.tokenizer_json(WORD), ["doc_id"])
    with pytest.raises(ValueError):
        token_counts(odd_docs, queries.tokenizer_json(BYTE), ["doc_id"])


def test_a_codec_serves_later_tasks_until_a_failure():
    text = queries.tokenizer_json(BYTE)
    codec = bpe.Lazy(text).get()
    assert bpe.Lazy(text).get() is codec

    def fails(docs, other):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        bpe._kept_clean(bpe.Lazy(text), fails)(None, None)
    assert bpe.Lazy(text).get() is not codec
