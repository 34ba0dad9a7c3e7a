import base64
import gzip
import hashlib
import os

import pytest

from lapidary.llm.scratch import Scratch
from lapidary.llm.warc import archive_and_assemble, assemble, mark_revisits, read_records, write_archives

ROWS = [(1, "http://a.example/x y\r\nz", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (2, None, "<p>same</p>"), (3, "https://b.example", "<p>same</p>"), (3, "https://b.example", "<p>same</p>"), (4, "", None), (5, "x", ""), (None, "n", "<p>same</p>"), (9, "long", "ab\n" * 400_000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, kind string") if rows and len(rows[0]) == 4 else spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip(spark):
    got = archive_and_assemble(frame(spark, [(*r, "clash") for r in ROWS])).collect()
    assert len(got) == len(ROWS)
    for r in got:
        html = next((h or "" for p, _, h in ROWS if p == r.page_id))
        raw = html.encode()
        assert r.request.kind == "request" and r.metadata.payload_bytes == len(raw)
        assert r.response.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        largest = max(p for p, _, h in ROWS if (h or "") == html and p is not None)
        if r.page_id == largest:
            assert r.response.kind == "response" and r.response.payload == raw and r.response.intact and r.response.refers_to is None
        else:
            assert r.response.kind == "revisit" and r.response.payload is None and r.response.refers_to == largest


def test_a_changed_payload_is_noticed(spark, tmp_path):
    path = str(tmp_path / "a")
    write_archives(mark_revisits(frame(spark, [(1, "http://a.example", "<p>whole</p>")])), path)
    (name,) = [f for f in os.listdir(path) if f.endswith(".gz")]
    content = gzip.decompress(open(f"{path}/{name}", "rb").read()).replace(b"whole", b"other")
    os.mkdir(f"{path}2")
    with gzip.open(f"{path}2/part-0.txt.gz", "wb") as out:
        out.write(content)
    assert [r.intact for r in read_records(spark, f"{path}2", strict=False).where("kind = 'response'").collect()] == [False]
    with pytest.raises(Exception, match="digest"):
        read_records(spark, f"{path}2").collect()


def test_large_payloads_have_archives_of_their_own(spark):
    rows = [(i, f"http://a.example/{i}", "x" * n) for i, n in enumerate([10, 70_000, 3 << 20, 70_000, 10, 1 << 16])]
    got = {r.page_id: (r.response.kind, r.response.refers_to, r.metadata.payload_bytes) for r in archive_and_assemble(frame(spark, rows)).collect()}
    assert got == {0: ("revisit", 4, 10), 1: ("revisit", 3, 70_000), 2: ("response", None, 3 << 20), 3: ("response", None, 70_000), 4: ("response", None, 10), 5: ("response", None, 1 << 16)}


def test_short_payloads_stay_responses(spark):
    kinds = {(r.page_id, r.record_type) for r in mark_revisits(frame(spark, ROWS), min_bytes=100).collect()}
    assert {k for _, k in kinds} == {"response"}


def test_lone_records_and_no_rows(spark):
    assert archive_and_assemble(frame(spark, ROWS).limit(0)).collect() == []
    scratch = Scratch(spark)
    write_archives(mark_revisits(frame(spark, ROWS[:2])), scratch.path("a"), transactions_per_file=1)
    records = read_records(spark, scratch.path("a"), with_payload=False)
    assert records.count() == 6
    alone = assemble(records.where("kind = 'request'")).collect()
    assert len(alone) == 2 and all(r.response is None and r.page_id is None and r.request is not None for r in alone)
