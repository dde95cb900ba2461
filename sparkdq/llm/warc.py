"""WARC archives: writing with revisits, segments and chunked framing; reading with segment reassembly.

Writing: pages are staged where they are read.  Of equal payloads one row, that
with the largest key, becomes a ``response``; the others become ``revisit``
records, which need no payload, so no page text is shuffled.  A block longer than
``SEGMENT`` bytes is cut into a first record and ``continuation`` records.

Reading: records without segments are decoded where their archive is parsed.
Segments are grouped by origin identifier, ordered by segment number, checked for
gaps and against the total length, and joined; then the HTTP block's chunked
transfer framing is decoded.  A group is one record, bounded by a page's size.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stage import PART, POS, marked, stage, written

SEGMENT = 16 * 1024  # block bytes per record
CHUNK = 4 * 1024  # bytes per transfer chunk
RECORDS_PER_FILE = 2000  # with SEGMENT bounds an archive, unpacked, to about 33 MB
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# One record -------------------------------------------------------------------------------------

def record(kind: str, block: bytes, **fields: str | None) -> bytes:
    """A WARC/1.1 record without its final empty lines; ``_`` in field names stands for ``-``."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}"]
    head += [f"{k.replace('_', '-')}: {one_line(v)}" for k, v in fields.items() if v is not None]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block


def one_line(value: str) -> str:
    """Line ends in a header value, percent-encoded."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """Payload of a chunked body; None when the framing is broken or cut off."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def segments(record_id: str, key: str | None, url: str | None, payload: bytes) -> list[bytes]:
    """The response record of a page, in one piece or as a first record and its continuations."""
    block = HTTP_HEAD + chunked(payload)
    fields = {"WARC_Record_ID": f"<{record_id}>", "WARC_Target_URI": url, "Page_Key": key, "WARC_Payload_Digest": "sha1:" + digest(payload),
              "Content_Type": "application/http; msgtype=response"}
    if len(block) <= SEGMENT:
        return [record("response", block, **fields)]
    cuts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    out = [record("response", cuts[0], **fields, WARC_Segment_Number="1")]
    for n, cut in enumerate(cuts[1:], 2):
        out.append(record("continuation", cut, WARC_Record_ID=f"<{record_id}:{n}>", WARC_Segment_Origin_ID=f"<{record_id}>",
                          WARC_Segment_Number=str(n), WARC_Segment_Total_Length=str(len(block)) if n == len(cuts) else None))
    return out


def parse(archive: bytes):
    """(fields by lower-case name, block) of every record, by content length.

    A record is sound when its header has a content length, and an empty line or the archive's end follows that many
    bytes.  Of anything else (foreign lines, a wrong or missing length, a torn end) one (None, bytes) is told per
    stretch, and reading goes on where a line that begins a record follows.
    """
    at = 0
    while (at := _skip_line_ends(archive, at)) < len(archive):
        found = _record_at(archive, at)
        if found is None:
            start = RECORD_START.search(archive, at + 1)
            end = start.start() if start else len(archive)
            yield None, archive[at:end]
            at = end
        else:
            fields, block, at = found
            yield fields, block


RECORD_START = re.compile(rb"(?m)^WARC/\d+\.\d+\r?$")


def _skip_line_ends(archive: bytes, at: int) -> int:
    while archive[at : at + 2] == b"\r\n":
        at += 2
    return at


def _record_at(archive: bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Fields, block and end of the record that begins here; None when it isn't sound."""
    end = archive.find(b"\r\n\r\n", at)
    if end < 0 or not RECORD_START.match(archive, at):
        return None
    lines = archive[at:end].decode("utf-8", "replace").split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = whole_number(fields.get("content-length"))
    if size is None or end + 4 + size > len(archive):
        return None
    stop = end + 4 + size
    if stop < len(archive) and archive[stop : stop + 4] != b"\r\n\r\n":
        return None
    return fields, archive[end + 4 : stop], stop


def whole_number(text: str | None) -> int | None:
    """A number of at most 18 decimal digits; None for any other text."""
    return int(text) if text and len(text) <= 18 and text.isascii() and text.isdecimal() else None


def unpacked(content: bytes) -> tuple[bytes, bool]:
    """The bytes of a file and whether it is whole; a gzip file may have many members, a damaged one gives what can be read."""
    if content[:2] != b"\x1f\x8b":
        return content, True
    out, at = [], 0
    while content[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = content[at : at + (1 << 16)]
            if not piece:
                return b"".join(out), False
            try:
                out.append(member.decompress(piece))
            except zlib.error:
                return b"".join(out), False
            at += len(piece) - len(member.unused_data)
    return b"".join(out), not content[at:].strip(b"\0")


def payload_of(block: bytes) -> bytes | None:
    """Payload of an HTTP response block, its transfer framing decoded."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    framed = any(x.lower().startswith(b"transfer-encoding:") and b"chunked" in x.lower() for x in head.split(b"\r\n"))
    return unchunked(body) if framed else body


# Writing ----------------------------------------------------------------------------------------

def _responses(batches):
    for b in batches:
        for lo in range(0, len(b), 500):
            rows = b.slice(lo, 500).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([x for r in rows for x in segments(r["rid"], r["key"], r["url"], (r["html"] or "").encode())], pa.binary())], names=["record"])


def _revisits(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([
            record("revisit", HTTP_HEAD, WARC_Record_ID=f"<{r['rid']}>", WARC_Target_URI=r["url"], Page_Key=r["key"], WARC_Refers_To=f"<{r['to']}>",
                   WARC_Profile=PROFILE, WARC_Payload_Digest="sha1:" + base64.b32encode(bytes.fromhex(r["sha1"])).decode()) for r in b.to_pylist()],
            pa.binary())], names=["record"])


def write_archives(pages: DataFrame, path: str, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> None:
    """One record per page in archives below ``path`` (a shared folder).

    Payload: the page in UTF-8, null as empty.  Of payloads of at least ``min_bytes`` that are equal, the row with the
    largest key is the response, null keys smallest; rows that share it too are told apart by their place in the staged
    table, so there is exactly one.  Equality is by SHA-256.  Null URLs get no target field.  Extra columns are not read,
    whatever their names; of no pages there are no records.
    """
    rows = pages.select(F.col(f"`{key_col}`").alias("id"), F.col(f"`{key_col}`").cast("string").alias("key"),
                        F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    binary = F.col("html").cast("binary")
    rows = stage(rows.withColumns({"sha256": F.sha2(binary, 256), "sha1": F.sha1(binary), "size": F.octet_length(binary)}))
    rid = lambda part, pos, sha: F.concat(F.lit("urn:sha256:"), F.sha2(F.concat_ws("|", sha, part, pos), 256))
    ids = rows.select("id", "key", "url", "sha1", "sha256", "size", PART, POS)
    who = F.struct("id", F.col(PART).alias("p"), F.col(POS).alias("q"))
    groups = ids.filter(F.col("size") >= min_bytes).groupBy("sha256").agg(F.max(who).alias("top"), F.count("*").alias("n")).filter("n > 1")
    again = ids.join(groups.select("sha256", "top"), "sha256").filter(~((F.col("top.p") == F.col(PART)) & (F.col("top.q") == F.col(POS))))
    revisits = again.select(rid(F.col(PART), F.col(POS), F.col("sha256")).alias("rid"), "key", "url", "sha1",
                            rid(F.col("top.p"), F.col("top.q"), F.col("sha256")).alias("to"))
    responses = marked(rows, again.select(PART, POS)).filter("NOT _marked").select(
        rid(F.col(PART), F.col(POS), F.col("sha256")).alias("rid"), "key", "url", "html")
    for records, to in ((responses.mapInArrow(_responses, "record binary"), "response"), (revisits.mapInArrow(_revisits, "record binary"), "revisit")):
        (records.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip")
         .text(f"{path}/kind={to}"))


# Reading ----------------------------------------------------------------------------------------

RECORD = "record_id string, record_type string, key string, refers_to_id string, declared string, problem string, payload binary"
SEGMENTS = "origin string, number int, total bigint, record_type string, key string, declared string, block binary"


def decoded(record_id, kind, key, refers, declared, block, problem=None) -> tuple:
    """One row of RECORD; ``problem`` names what is broken, and the payload is then null."""
    payload = None if problem or kind != "response" else payload_of(block)
    if kind == "response" and not problem:
        problem = "framing" if payload is None else "digest" if declared and declared != digest(payload) else None
    return record_id, kind, key, refers, declared, problem, None if problem else payload


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "bigint": pa.int64()}
    return pa.table({n: pa.array([r[i] for r in rows], kinds[t]) for i, (n, t) in enumerate(x.split() for x in ddl.split(", "))})


def _fields(f: dict[str, str]) -> tuple:
    ids = {k: f.get(k, "").strip("<>") or None for k in ("warc-record-id", "warc-refers-to", "warc-segment-origin-id")}
    return ids["warc-record-id"], f.get("warc-type"), f.get("page-key"), ids["warc-refers-to"], f.get("warc-payload-digest", "").removeprefix("sha1:") or None, ids["warc-segment-origin-id"]


def _reader(segmented: bool):
    """Rows of SEGMENTS, or of RECORD: records in one piece, and a row for all that can't be read."""
    ddl = SEGMENTS if segmented else RECORD

    def rows_of(content: bytes):
        archive, sound = unpacked(content)
        for fields, block in parse(archive):
            if fields is None:
                if not segmented:
                    yield (None, None, None, None, None, "damaged", None), len(block)
                continue
            rid, kind, key, refers, declared, origin = _fields(fields)
            number, total = (whole_number(fields.get(f"warc-segment-{x}")) for x in ("number", "total-length"))
            bad = ("warc-segment-number" in fields and not 0 < (number or 0) < 2**31) or ("warc-segment-total-length" in fields and total is None)
            if bad or "warc-segment-number" not in fields:
                if not segmented:
                    yield decoded(rid, kind, key, refers, declared, block, "segment number" if bad else None), len(block)
            elif segmented:
                yield (origin or rid, number, total, kind, key, declared, block), len(block)
        if not sound and not segmented:
            yield (None, None, None, None, None, "damaged archive", None), 0

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                rows, size = [], 0
                for row, n in rows_of(content.as_py()):
                    rows.append(row)
                    size += n
                    if size > 8_000_000:
                        yield from _table(rows, ddl).to_batches()
                        rows, size = [], 0
                yield from _table(rows, ddl).to_batches()

    return run


def reassemble(t: pa.Table) -> pa.Table:
    """The record of one origin from its segments; a segment that occurs twice counts once."""
    by_number = {r["number"]: r for r in t.to_pylist()}
    parts = [by_number[n] for n in sorted(by_number)]
    first, last = parts[0], parts[-1]
    block = b"".join(p["block"] for p in parts)
    problem = None
    if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or last["total"] is None:
        problem = "missing segment"
    elif last["total"] != len(block):
        problem = "total length"
    return _table([decoded(first["origin"], first["record_type"], first["key"], None, first["declared"], block, problem)], RECORD)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives below ``path``, segments joined and framing decoded.

    Archives may be gzip files of one or many members.  ``problem`` is null for sound records, else ``missing segment``,
    ``total length``, ``segment number``, ``framing`` or ``digest``; the payload of revisits and of broken records is null.
    Every stretch of an archive that is no record gives a row ``damaged`` without an id, a gzip file that breaks off one
    ``damaged archive``; the records around them are read (inside a damaged stretch, what looks like a record's first line
    is taken for one).  ``payload_facts`` leaves those rows out, for no key is known.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").option("recursiveFileLookup", "true").load(path).select("content")
    whole = files.mapInArrow(_reader(False), RECORD)
    joined = files.mapInArrow(_reader(True), SEGMENTS).groupBy("origin").applyInArrow(reassemble, RECORD)
    return whole.unionByName(joined)


def payload_facts(records: DataFrame) -> DataFrame:
    """Key, type, size and digest of every record's full payload; a revisit takes them from the record it refers to."""
    facts = written(records.select("record_id", "record_type", "key", "refers_to_id", "declared", "problem", F.octet_length("payload").cast("bigint").alias("size")))
    full = facts.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("size").alias("full_size"),
                                                          F.col("declared").alias("full_digest"), F.col("key").alias("refers_to"))
    own = facts.filter("record_type = 'response'").select("key", "size", F.col("declared").alias("digest"), "record_type", F.lit(None).cast("string").alias("refers_to"), "problem")
    other = facts.filter("record_type = 'revisit'").drop("size").join(full, "refers_to_id", "left").select(
        "key", F.col("full_size").alias("size"), F.col("full_digest").alias("digest"), "record_type", "refers_to",
        F.when(F.col("full_digest").isNull(), "dangling").when(F.col("full_digest") != F.col("declared"), "digest").alias("problem"))
    return own.unionByName(other)
