"""WARC archives: round trips, odd payloads, transactions that are spread over files."""

import base64
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from tidemill.llm import warc

EMBEDDED = "x" * 10 + "\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\nrest"
PAGES = [
    (1, "http://a/b c", EMBEDDED), (2, None, None), (3, "u", ""), (None, "http://n", "dup"), (5, "http://d", "dup"),
    (5, "http://e\r\nX: y", "dup"), (6, "é/ü", "ünï\r\n\r\nWARC/1.0\r\n"), (7, "z", "big " * 100_000),
]
SCHEMA = "page_id bigint, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip_of_odd_pages(spark, tmp_path, compression):
    pages = spark.createDataFrame(PAGES, SCHEMA).withColumn("row", F.lit(1)).withColumn("id", F.lit("clash"))
    folder = str(tmp_path / "archive")
    warc.write_archives(pages, folder, compression=compression)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # records are split among tasks
    try:
        records = warc.read_archives(spark, folder)
        assert records.count() == 3 * len(PAGES) and records.filter("not whole or not intact").isEmpty()
        captures = warc.assemble(records)
        texts = sorted(r.payload.decode() for r in warc.with_payloads(captures).collect())
        assert texts == sorted(html or "" for _, _, html in PAGES)
        assert captures.filter("size(requests) != 1 or size(metadata) != 1").isEmpty()
        rows = warc.page_captures(captures).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((str(r.page_id), r.payload_digest, r.payload_bytes) for r in rows) == sorted((str(i), digest(h), len((h or "").encode())) for i, _, h in PAGES)
    assert sorted((str(r.page_id), r.refers_to) for r in rows if r.record_type == "revisit") == [("3", 2), ("5", 5), ("None", 5)]
    assert {r.url for r in rows} >= {"http://a/b%20c", "http://e%0D%0AX:%20y", None}


def test_small_payloads_stay_responses(spark, tmp_path):
    folder = str(tmp_path / "archive")
    warc.write_archives(spark.createDataFrame(PAGES, SCHEMA), folder, least_bytes=4)
    assert warc.read_archives(spark, folder).filter("type = 'revisit'").isEmpty()


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path / "archive")
    warc.write_archives(spark.createDataFrame([], SCHEMA), folder)
    assert warc.page_captures(warc.assemble(warc.read_archives(spark, folder))).count() == 0


def record(kind, own, block=b"", version=b"1.0", **headers):
    lines = [b"WARC/" + version, b"WARC-Type: " + kind.encode(), f"warc-record-id: <{own}>".encode()]
    lines += [f"{k.replace('_', '-')}: <{x}>".encode() for k, v in headers.items() for x in v.split()]
    lines += [b"Content-Length: " + str(len(block)).encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Links in either direction, over several records and files; bytes that are no text; a last record cut short."""
    raw = bytes(range(256)) * 3
    (tmp_path / "one.warc").write_bytes(
        record("warcinfo", "w") + record("response", "r1", raw, WARC_Concurrent_To="q1") + record("metadata", "m1", b"a", WARC_Concurrent_To="q1")
    )
    (tmp_path / "two.warc").write_bytes(
        record("request", "q1", version=b"1.1") + record("request", "q2", WARC_Concurrent_To="none r2") + record("request", "alone", WARC_Concurrent_To="w")
        + record("resource", "r2", b"12345") + record("response", "r3", b"lost end")[:-7]
    )
    records = warc.read_archives(spark, str(tmp_path))
    captures = {r.record_id: r for r in warc.assemble(records).collect()}
    assert set(captures) == {"<r1>", "<r2>", "<r3>"}
    assert bytes(captures["<r1>"].payload) == raw
    assert [x.record_id for x in captures["<r1>"].requests] == ["<q1>"] and [x.record_id for x in captures["<r1>"].metadata] == ["<m1>"]
    assert [x.record_id for x in captures["<r2>"].requests] == ["<q2>"] and captures["<r2>"].metadata == []
    assert captures["<r3>"].requests is None and not captures["<r3>"].whole and captures["<r1>"].whole


def test_identifiers_repeat(spark, tmp_path):
    """Reruns write the same records."""
    folders = [str(tmp_path / uuid.uuid4().hex) for _ in range(2)]
    found = []
    for folder in folders:
        warc.write_archives(spark.createDataFrame(PAGES, SCHEMA), folder)
        found.append(sorted(r[0] for r in warc.read_archives(spark, folder).select("record_id").collect()))
    assert found[0] == found[1]
