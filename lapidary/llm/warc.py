"""WARC archives: writing transactions and assembling them again.

Writing uses DataFrame functions only. Each page is a transaction of three records, which a
request and a metadata record tie together by naming the response in WARC-Concurrent-To. Of
equal payloads (at least ``min_bytes`` long) that with the largest page id is written in full
and the others are revisit records without payload. Spark's text writer puts the records into
gzip archives in the shared folder, of a number of transactions that their sizes bound; its line
separator is the end of a WARC record.

Reading takes whole archives as rows, parses their records by Content-Length, holds payloads
against their digests (one that differs stops the reading), joins records by the identifier that they are concurrent to, and gives one nested row a capture.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.llm.scratch import Scratch, small_batches

CRLF = "\r\n"
#: fixed values: the base32 alphabet
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in bare upper-case base32: 40 hexadecimal digits are 8 times 20 bits, each 4 letters."""
    digest = F.sha1(payload)
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add ``payload_bytes, payload_digest, record_type, refers_to`` to ``page_id, url, html``.

    A null html is empty. Rows that repeat the largest page id of a payload are responses too.
    A null page id revisits whatever id its payload has, and is a response if there is none.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "sha": F.sha1("html")})
    largest = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("sha", "payload_bytes").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.hint("merge").join(largest, ["sha", "payload_bytes"], "left")
    again = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return rows.select("page_id", "url", "html", "payload_bytes", base32_sha1(F.col("html")).alias("payload_digest"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("largest")).alias("refers_to"))


def _record(kind: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its closing two line ends; headers that are null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in headers]
    return F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "),
        kind,
        F.lit(CRLF),
        *(F.coalesce(x, F.lit("")) for x in lines),
        F.lit("Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(CRLF + CRLF),
        block,
    )


def write_archives(marked: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", transactions_per_file: int = 2000) -> None:
    """Write marked pages as gzip WARC files of at most ``transactions_per_file`` transactions."""
    clean = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20\\x7f]", "")
    rows = marked.withColumns({"uid": F.uuid(), "uri": clean})
    urn = lambda part: F.concat(F.lit("<urn:uuid:"), F.col("uid"), F.lit(f":{part}>"))
    digest = F.concat(F.lit("sha1:"), F.col("payload_digest"))
    uri = F.when(F.col("uri") != "", F.col("uri"))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri)]
    response = _record(
        F.col("record_type"),
        [
            ("WARC-Record-ID", urn("response")),
            *common,
            ("WARC-Payload-Digest", digest),
            ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To-Page", F.col("refers_to").cast("string")),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.when(revisit, http).otherwise(F.concat(http, F.col("html"))),
    )
    host = F.regexp_extract("uri", "^[A-Za-z]+://([^/]*)", 1)
    target = F.regexp_replace("uri", "^[A-Za-z]+://[^/]*", "")
    request = _record(
        F.lit("request"),
        [("WARC-Record-ID", urn("request")), *common, ("WARC-Concurrent-To", urn("response")), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2)),
    )
    facts = [F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.concat(F.lit("payload-bytes: "), F.col("payload_bytes").cast("string"), F.lit(CRLF))]
    metadata = _record(
        F.lit("metadata"),
        [("WARC-Record-ID", urn("metadata")), *common, ("WARC-Concurrent-To", urn("response")), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(*(F.coalesce(f, F.lit("")) for f in facts)),
    )
    transaction = F.concat(request, F.lit(CRLF * 2), response, F.lit(CRLF * 2), metadata)
    writer = rows.select(transaction.alias("value")).write.mode("overwrite").option("lineSep", CRLF * 2).option("compression", "gzip")
    writer.option("maxRecordsPerFile", transactions_per_file).text(path)


#: payloads up to so many bytes go to archives of so many transactions; larger ones have one each
SIZE_CLASSES = ((1 << 16, 2000), (1 << 21, 64), (None, 1))

RECORD = "record_id string, concurrent_to string, kind string, uri string, date string, payload_digest string, refers_to long, page_id long, payload_bytes long, intact boolean"


def read_records(spark, path: str | list[str], with_payload: bool = True, strict: bool = True) -> DataFrame:
    """The records of all archives under ``path``.

    A response's length and digest are those of the payload that was read; ``intact`` says that
    this is the digest its header names. With ``strict`` another is an error.
    """
    fields = [(f.split()[0], {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[f.split()[1]]) for f in RECORD.split(", ")] + [("payload", pa.binary())]
    schema = pa.schema(fields if with_payload else fields[:-1])

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for record in _records(content.as_buffer()):
                    if strict and record["intact"] is False:
                        raise ValueError(f"the payload of {record['record_id']} hasn't the digest that its record names")
                    if not with_payload:
                        record.pop("payload")
                    rows.append(record)
                    held += len(record.get("payload") or b"") + 500
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, RECORD + (", payload binary" if with_payload else ""))


def _inflated(buffer, step: int = 1 << 20):
    inflate, view = zlib.decompressobj(31), memoryview(buffer)
    for at in range(0, len(view), step):
        data = view[at : at + step]
        while len(data):
            yield inflate.decompress(data)
            data = inflate.unused_data
            if data:  # the next gzip member
                inflate = zlib.decompressobj(31)
    yield inflate.flush()


def _records(buffer):
    """Parsed records of one gzip archive, inflated as they are needed."""
    source, held = _inflated(buffer), bytearray()

    def fill(n: int) -> bool:
        for data in source:
            held.extend(data)
            if len(held) >= n:
                return True
        return len(held) >= n

    while True:
        while held[:2] == b"\r\n" or (len(held) < 2 and fill(2) and held[:2] == b"\r\n"):
            del held[:2]
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill(len(held) + 1):
                return
        lines = held[:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        length = int(headers["content-length"])
        if len(held) < end + 4 + length and not fill(end + 4 + length):
            raise ValueError("an archive ends inside a record")
        block = bytes(held[end + 4 : end + 4 + length])
        del held[: end + 4 + length]
        kind = headers["warc-type"]
        facts = dict(x.split(": ", 1) for x in block.decode("utf-8").split("\r\n") if x) if kind == "metadata" else {}
        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
        named = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        digest = named if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode()
        yield {
            "record_id": headers["warc-record-id"],
            "concurrent_to": headers.get("warc-concurrent-to"),
            "kind": kind,
            "uri": headers.get("warc-target-uri"),
            "date": headers.get("warc-date"),
            "payload_digest": digest,
            "refers_to": int(headers["warc-refers-to-page"]) if "warc-refers-to-page" in headers else None,
            "page_id": int(facts["page-id"]) if "page-id" in facts else None,
            "payload_bytes": len(payload) if payload is not None else int(facts["payload-bytes"]) if "payload-bytes" in facts else None,
            "intact": None if payload is None else digest == named,
            "payload": payload,
        }


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: ``capture_id, page_id, uri, date, request, response, metadata``.

    Records meet under the identifier that they are concurrent to, a response under its own.
    A capture without one of the three has null there.
    """
    whole = F.struct(*(c for c in records.columns if c not in ("concurrent_to", "uri", "date")))
    pick = lambda *kinds: F.first(F.when(F.col("kind").isin(*kinds), whole), ignorenulls=True)
    grouped = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        F.first("uri", ignorenulls=True).alias("uri"), F.first("date", ignorenulls=True).alias("date"), pick("request").alias("request"), pick("response", "revisit").alias("response"), pick("metadata").alias("metadata")
    )
    return grouped.select("capture_id", F.col("metadata.page_id").alias("page_id"), "uri", "date", "request", "response", "metadata")


def archive_and_assemble(pages: DataFrame, min_bytes: int = 0, with_payload: bool = True) -> DataFrame:
    """Write all ``pages`` to archives in the shared folder, read these back and assemble captures.

    Equal payloads have equal sizes, so each class of sizes is marked and written by itself. Null
    html is empty; repeated rows are transactions of their own; further columns of ``pages``,
    whatever their names, don't come back; an empty table gives no capture.
    """
    scratch = Scratch(pages.sparkSession)
    size, above, paths = F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit(""))), -1, []
    for upto, transactions in SIZE_CLASSES:
        own = pages.where((size > above) & (size <= upto) if upto else size > above)
        paths.append(scratch.path(f"archives-{transactions}"))
        write_archives(mark_revisits(own, min_bytes), paths[-1], transactions_per_file=transactions)
        above = upto
    return assemble(read_records(pages.sparkSession, paths, with_payload))
