import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from sparkdq.llm import warc
from sparkdq.llm.queries import QUERIES
from sparkdq.session import scratch_path

TRICKY = [None, "", "é" * 20_000, "é" * 20_000, "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n0\r\n\r\n" * 900, "x" * warc.SEGMENT, "\r\n", "日" * 30_000, "0\r\n\r\n"]


def sha1(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_round_trip(spark):
    pages = spark.createDataFrame([(i, None if i == 2 else "http://a/\r\nWARC-Type: x", h, "c") for i, h in enumerate(TRICKY, 1)],
                                  "page_id long, url string, html string, payload string").repartition(3)
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path)
    read = warc.read_archives(spark, path).cache()
    texts = {int(r.key): bytes(r.payload).decode() for r in read.filter("record_type = 'response'").collect()}
    got = {int(r.key): r for r in warc.payload_facts(read).collect()}
    assert len(got) == len(TRICKY)
    for i, h in enumerate(TRICKY, 1):
        b = (h or "").encode()
        top = max(j for j, x in enumerate(TRICKY, 1) if (x or "") == (h or ""))
        assert (got[i]["size"], got[i].digest, got[i].problem) == (len(b), sha1(b), None)
        assert got[i].record_type == ("response" if top == i else "revisit")
        assert got[i].refers_to == (None if top == i else str(top))
        if top == i:
            assert texts[i] == (h or "")


def test_many_copies_repeated_rows_null_keys_and_no_pages(spark):
    pages = spark.range(900).select(F.when(F.col("id") != 5, F.col("id")).alias("page_id"), F.lit("u").alias("url"),
                                    F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("html"))
    pages = pages.unionByName(pages.filter("page_id = 897"))
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path)
    facts = warc.payload_facts(warc.read_archives(spark, path)).cache()
    assert facts.count() == 901 and facts.filter("problem IS NOT NULL").count() == 0
    assert facts.filter("record_type = 'revisit'").count() == 300 and facts.filter("refers_to = '897'").count() == 300
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path, min_bytes=3)
    facts = {int(r.key): r.record_type for r in warc.payload_facts(warc.read_archives(spark, path)).collect()}
    assert facts == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def parts(total=None, numbers=(1, 2, 3)):
    payload = b"p" * 40_000
    block = warc.HTTP_HEAD + warc.chunked(payload)
    cuts = [block[i : i + warc.SEGMENT] for i in range(0, len(block), warc.SEGMENT)]
    rows = [("o", n, (total or len(block)) if n == len(cuts) else None, "response", "1", sha1(payload), cuts[n - 1]) for n in numbers]
    return warc._table(rows, warc.SEGMENTS), payload


def test_reassembly_orders_segments_and_finds_faults():
    table, payload = parts(numbers=(3, 1, 2, 2))
    assert warc.reassemble(table).to_pylist()[0]["payload"] == payload
    assert warc.reassemble(parts(numbers=(1, 3))[0]).to_pylist()[0]["problem"] == "missing segment"
    assert warc.reassemble(parts(numbers=(1, 2))[0]).to_pylist()[0]["problem"] == "missing segment"
    assert warc.reassemble(parts(total=7)[0]).to_pylist()[0]["problem"] == "total length"
    assert isinstance(table, pa.Table)


def test_framing():
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n2\r\nde\r\n0\r\n\r\n") == b"abcde"
    assert warc.unchunked(b"3\r\nab") is None and warc.unchunked(b"zz\r\nab\r\n") is None and warc.unchunked(b"3\r\nabcde\r\n0\r\n\r\n") is None
    for size in (1, 7, warc.CHUNK, 3 * warc.CHUNK + 1):
        assert warc.unchunked(warc.chunked(b"q" * size)) == b"q" * size
    assert list(warc.parse(warc.record("response", b"block") + b"\r\n\r\nWARC/1.1\r\nContent-Length: 99\r\n\r\ntorn"))[0][1] == b"block"


def one(i, **fields):
    payload = b"page %d" % i
    return warc.record("response", warc.HTTP_HEAD + warc.chunked(payload), WARC_Record_ID=f"<r{i}>", Page_Key=str(i), WARC_Payload_Digest="sha1:" + sha1(payload), **fields)


END = b"\r\n\r\n"


def test_every_sound_record_around_a_broken_stretch_is_read():
    wrong = one(9).replace(b"Content-Length: ", b"Content-Length: 1")
    for broken in (b"foreign line", b"foreign\r\n\r\nlines\r\n", one(9)[:-3], one(9) + b"more", wrong, one(9).replace(b"Content-Length: ", b"Content-Length: x"),
                   one(9).replace(b"Content-Length", b"Content-Width"), one(9).replace(b"Content-Length: ", b"Content-Length: -"), b"WARC/1.1", b"\x00" * 500):
        got = list(warc.parse(one(1) + END + broken + END + one(2) + END))
        assert [f["page-key"] for f, _ in got if f] == ["1", "2"], broken
        assert [f for f, _ in got].count(None) == 1, broken
        torn = list(warc.parse(one(1) + END + broken))
        assert [f["page-key"] for f, _ in torn if f] == ["1"] and torn[-1][0] is None, broken
    assert list(warc.parse(b"")) == list(warc.parse(END)) == []


def test_damaged_archives(spark, tmp_path):
    whole = gzip.compress(one(1) + END) + gzip.compress(one(2) + END)  # a member per record
    packed = gzip.compress(one(3) + END + b"".join(one(i) + END for i in range(100, 400)))
    files = {"members": whole, "cut": packed[: len(packed) // 2], "foreign": one(4) + END + b"xx" + END + one(5), "empty": b"", "tail": gzip.compress(one(6)) + b"garbage",
             "segment": one(7, WARC_Segment_Number="two") + END + one(8, WARC_Segment_Number="1", WARC_Segment_Total_Length="5x") + END + one(10, WARC_Segment_Number="0")}
    for name, content in files.items():
        (tmp_path / f"{name}.txt").write_bytes(content)
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    sound = {r["key"]: bytes(r["payload"]) for r in rows if r["problem"] is None}
    assert {"1", "2", "3", "4", "5", "6"} <= set(sound) and not {"7", "8", "10"} & set(sound)
    assert all(v == b"page " + k.encode() for k, v in sound.items())
    problems = sorted(r["problem"] for r in rows if r["problem"])
    assert problems.count("segment number") == 3 and problems.count("damaged archive") == 2 and 1 <= problems.count("damaged") <= 2
    facts = {r["key"]: r["problem"] for r in warc.payload_facts(warc.read_archives(spark, str(tmp_path))).collect()}
    assert facts["7"] == "segment number" and facts["1"] is None and None not in facts


def test_registered_query_against_plain_python(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    top = pages.agg(F.max("page_id")).first()[0] + 1
    copies = pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + top)
    odd = spark.createDataFrame([(3 * top + i, "u", t) for i, t in enumerate([None, "", "x" * 70_000, "x" * 70_000])], "page_id long, url string, html string")
    every = pages.unionByName(copies).unionByName(odd).withColumn("key", F.lit("clash")).cache()
    every.write.parquet(str(tmp_path / "pages.parquet"))
    rows = {r["page_id"]: (r["html"] or "").encode() for r in every.collect()}
    last = {}
    for i in sorted(rows):
        last[rows[i]] = i
    want = {i: (len(b), sha1(b), "response" if last[b] == i else "revisit", None if last[b] == i else last[b]) for i, b in rows.items()}
    got = [(r["page_id"], (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in QUERIES["op2_warc"](spark, str(tmp_path)).collect()]
    assert len(got) == len(rows) and dict(got) == want
    assert sum(w[2] == "revisit" for w in want.values()) > copies.count()
