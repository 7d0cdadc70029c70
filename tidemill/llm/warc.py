"""WARC archives: pages written as capture transactions, and transactions assembled again from archives.

Writing: every page becomes three records: a request, a response (or a revisit, if an earlier page has
the same payload) and a metadata record. Request and metadata name the response or revisit by
WARC-Concurrent-To, a revisit names the response that holds its payload by WARC-Refers-To. Spark's text
writer puts the bytes down, one page for each line, with the blank line that ends a record as line end.

Reading: Spark's text reader splits archives of any size at the version line, so that large archives are
read by many tasks. Content-Length tells whether a piece is a whole record. Where a payload holds a
version line itself, the pieces of that file are put together again by a walk over their lengths.

Assembly: each record other than a response, revisit or resource looks for its transaction along
concurrent-to identifiers, in either direction and over as many steps as needed; each round joins only
identifiers. Then each capture becomes one row with its requests and metadata nested.

Defined results: a null or empty html is a payload of 0 bytes; rows with a null or repeated id are pages of
their own, in the order of id (nulls last) and then of place; control characters and blanks in a URL are
percent-encoded in the archive, a null URL stands in none; bytes of an archive that belong to no record
are left out, a record that is cut short has `whole` false; records without a transaction (warcinfo,
requests without an answer) are in no capture; an empty table gives archives without records; extra
columns are not looked at. All records of a transaction are one row, and so must fit into a task.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import cut, ensure_checkpoint_dir, small, with_row_key

#: What stands between the pieces of an archive when it is read.
BETWEEN = "\r\nWARC/1."
LINE, BLANK = "\r\n", "\r\n\r\n"
PRINCIPALS = ("response", "revisit", "resource")
#: Fixed value of the WARC standard.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base 32: five hexadecimal digits are four digits to the base of 32."""
    code = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(code, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), DIGITS32, BASE32)


def _record_id(kind: str, row: Column) -> Column:
    """An identifier that reruns repeat."""
    code = F.md5(F.concat(F.lit(f"{kind}:"), row.cast("string")))
    at = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(code, a, n) for a, n in at]), F.lit(">"))


def _lines(*lines: Column | str | None) -> Column:
    """Header lines that are not null, each with its line end."""
    return F.concat(*[F.coalesce(F.concat(F.lit(x) if isinstance(x, str) else x, F.lit(LINE)), F.lit("")) for x in lines])


def _record(kind: Column | str, own: Column, date: str, uri: Column, content_type: str, headers: Column, block: Column) -> Column:
    """A whole record without its last line end."""
    head = _lines(
        "WARC/1.1", F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), F.concat(F.lit("WARC-Record-ID: "), own),
        f"WARC-Date: {date}", F.concat(F.lit("WARC-Target-URI: "), uri), f"Content-Type: {content_type}",
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(head, headers, F.lit(LINE), block, F.lit(LINE))


def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages (row, id, url, html) with payload_bytes, payload_digest, and first_row, first_id, which are null for responses.

    Of pages with equal payloads of at least `least_bytes` bytes the first is the response. Payloads
    are equal if length and SHA-1 are. Only payloads that occur twice or more are joined back.
    """
    known = pages.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": base32_sha1(F.col("html"))})
    first = known.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min_by(F.struct("row", "id"), "row").alias("first"), F.count("*").alias("n"))
    repeated = cut(first.filter("n > 1").select("payload_digest", "payload_bytes", F.col("first.row").alias("first_row"), F.col("first.id").alias("first_id")))
    found = known.join(small(repeated), ["payload_digest", "payload_bytes"], "left")
    other = F.col("first_row") != F.col("row")
    return found.withColumns({c: F.when(other, F.col(c)) for c in ("first_id", "first_row")})


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip", most_records: int = 100_000) -> None:
    """Write pages as archives into a folder; a file holds at most `most_records` pages.

    With `compression` (gzip by default) a file is compressed as a whole.
    """
    chosen = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    found = roles(with_row_key(chosen, "id", "row"), least_bytes)
    revisit = F.col("first_row").isNotNull()
    odd = r"[\x00-\x20\x7F]"
    coded = F.array_join(F.transform(F.split("url", ""), lambda c: F.when(c.rlike(odd), F.concat(F.lit("%"), F.hex(c))).otherwise(c)), "")
    uri = F.when(F.col("url") != "", F.when(F.col("url").rlike(odd), coded).otherwise(F.col("url")))
    own, digest = _record_id("capture", F.col("row")), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"))
    beside = _lines(F.concat(F.lit("WARC-Concurrent-To: "), own))
    http = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), F.col("payload_bytes").cast("string")), "")
    headers = F.when(revisit, _lines(digest, f"WARC-Profile: {IDENTICAL}", F.concat(F.lit("WARC-Refers-To: "), _record_id("capture", F.col("first_row"))))).otherwise(_lines(digest))
    request = _record("request", _record_id("request", F.col("row")), date, uri, "application/http; msgtype=request", beside, F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{BLANK}")))
    capture = _record(F.when(revisit, "revisit").otherwise("response"), own, date, uri, "application/http; msgtype=response", headers, F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html"))))
    fields = _lines(F.concat(F.lit("id: "), F.url_encode(F.col("id").cast("string"))))
    metadata = _record("metadata", _record_id("metadata", F.col("row")), date, uri, "application/warc-fields", beside, fields)
    page = F.concat(request, F.lit(LINE), capture, F.lit(LINE), metadata)
    found.select(page.alias("value")).write.option("lineSep", LINE).option("compression", compression).option("maxRecordsPerFile", most_records).text(folder)


def _field(head: str, name: str) -> Column:
    """The value of a header line, null if there is none."""
    found = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(\S[^\r\n]*?)?[ \t]*\r?$", 1)
    return F.when(found != "", found)


def _starts(pieces: DataFrame) -> DataFrame:
    """Add the head of the record that may start with a piece, and the bytes that it needs from there."""
    head = F.substring_index("value", BLANK, 1)
    length = F.regexp_extract("head", r"(?im)^Content-Length:[ \t]*([0-9]{1,18})[ \t]*\r?$", 1)
    starts = F.col("head").rlike(r"^(WARC/1\.)?[01]\r\n")
    return pieces.withColumn("head", head).withColumn("need", F.when(starts & (length != ""), F.octet_length("head") + 4 + length.cast("long")))


def _owners(frame: pd.DataFrame) -> pd.DataFrame:
    """Which record each piece of one file belongs to: a walk over the lengths."""
    frame = frame.sort_values(["block", "place"], ignore_index=True)
    size, need = frame["size"].tolist(), frame["need"].astype("Int64").tolist()
    record, first = [], 0
    while first < len(size):
        last, have = first, size[first]
        while need[first] is not pd.NA and have < need[first] and last + 1 < len(size):
            last += 1
            have += len(BETWEEN) + size[last]
        record += [first] * (last - first + 1)
        first = last + 1
    frame["record"] = record
    return frame[["file", "block", "place", "record"]]


def _whole_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """(value, head, need): a row for each record of the archives."""
    lines = spark.read.option("lineSep", BETWEEN).text(folder)
    pieces = _starts(lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")))
    over = F.octet_length("value") - F.col("need")
    odd = F.coalesce(~over.between(0, 4), F.lit(True))
    broken = cut(pieces.filter(odd).select("file").distinct())
    if broken.isEmpty():
        return pieces.select("value", "head", "need")
    broken = small(broken)
    held = cut(pieces.join(broken, "file", "left_semi").select("file", "block", "place", "value", "need", F.octet_length("value").alias("size")))
    slim = held.select("file", "block", "place", "size", "need")
    owner = slim.groupBy("file").applyInPandas(_owners, "file string, block bigint, place bigint, record bigint")
    parts = held.join(owner, ["file", "block", "place"]).groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "place", "value"))).alias("parts"))
    mended = _starts(parts.select(F.array_join(F.transform("parts", lambda x: x["value"]), BETWEEN).alias("value"))).filter("need is not null")
    return pieces.join(broken, "file", "left_anti").select("value", "head", "need").union(mended.select("value", "head", "need"))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of archives: identifiers, headers, HTTP head, payload, and `whole` (not cut short).

    payload_bytes and payload_digest are of the payload that is there; for revisits, which hold none,
    they are what their HTTP head and WARC head say.
    """
    found = _whole_pieces(spark, folder)
    start = F.octet_length("head") + 5
    raw = F.col("value").cast("binary")
    records = found.select(
        _field("head", "WARC-Record-ID").alias("record_id"), _field("head", "WARC-Type").alias("type"), _field("head", "WARC-Date").alias("date"),
        _field("head", "WARC-Target-URI").alias("target_uri"), _field("head", "WARC-Refers-To").alias("refers_to"), _field("head", "Content-Type").alias("content_type"),
        F.regexp_extract_all("head", F.lit(r"(?im)^WARC-Concurrent-To:[ \t]*(\S+)"), 1).alias("concurrent_to"), _field("head", "WARC-Payload-Digest").alias("said"),
        (F.octet_length("value") >= F.col("need")).alias("whole"), F.substring(raw, start, F.col("need").cast("int") + 1 - start).alias("block"),
    )
    http = F.col("content_type").startswith("application/http")
    records = records.withColumn("http", F.when(http, F.substring_index(F.col("block").cast("string"), BLANK, 1)))
    records = records.withColumn("payload", F.when(http, F.substring(F.col("block"), F.octet_length("http") + 5, F.octet_length("block"))).otherwise(F.col("block")))
    revisit = F.col("type") == "revisit"
    return records.select(
        *[c for c in records.columns if c not in ("said", "block", "payload")],
        F.when(revisit, _field("http", "Content-Length").cast("long")).otherwise(F.octet_length("payload")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("said", "(?i)^sha1:", "")).otherwise(base32_sha1(F.col("payload"))).alias("payload_digest"),
        (revisit | (F.coalesce(F.regexp_replace("said", "(?i)^sha1:", ""), base32_sha1(F.col("payload"))) == base32_sha1(F.col("payload")))).alias("intact"),
        F.when(F.col("content_type").startswith("application/warc-fields"), F.col("block").cast("string")).alias("fields"),
        "payload",
    )


def _transactions(heads: DataFrame) -> DataFrame:
    """(record_id, capture) for records that belong to a capture, by joins along the identifiers."""
    said = heads.select("record_id", F.explode("concurrent_to").alias("beside"))
    links = cut(said.union(said.select("beside", "record_id")).filter("record_id is not null and record_id != beside").distinct())
    known = heads.filter(F.col("type").isin(*PRINCIPALS)).select("record_id", F.col("record_id").alias("capture")).distinct()
    every = fresh = cut(known)
    while True:
        reached = links.join(fresh.withColumnRenamed("record_id", "beside"), "beside").groupBy("record_id").agg(F.min("capture").alias("capture"))
        fresh = cut(reached.join(every, "record_id", "left_anti"))
        if fresh.isEmpty():
            return every
        every = every.union(fresh)


def assemble(records: DataFrame) -> DataFrame:
    """One row for each response, revisit or resource, with its requests and metadata nested.

    Pass records without `payload` if payloads are not wanted: they go through the joins otherwise.
    """
    records = cut(records)
    heads = records.select("record_id", "type", "concurrent_to")
    principal = F.col("type").isin(*PRINCIPALS)
    nested = F.struct(*[c for c in records.columns if c not in ("type", "concurrent_to")])
    rest = records.filter(~principal).join(_transactions(heads), "record_id").groupBy("capture").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("type") == kind, nested))).alias(name) for kind, name in (("request", "requests"), ("metadata", "metadata"))]
    )
    found = records.filter(principal).withColumnRenamed("record_id", "capture").join(rest, "capture", "left")
    return found.withColumnRenamed("capture", "record_id").drop("concurrent_to")


def with_payloads(captures: DataFrame) -> DataFrame:
    """Revisits get the payload of the response that they refer to (null if it isn't there)."""
    captures = cut(captures)
    held = captures.filter("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload").alias("_held"))
    revisits = captures.filter("type = 'revisit'").join(held, "refers_to", "left").withColumn("payload", F.col("_held"))
    return captures.filter("type != 'revisit'").unionByName(revisits.select(*captures.columns))


def page_captures(captures: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): captures by the ids of their pages."""
    page = F.regexp_extract(F.col("metadata")[0]["fields"], r"(?m)^id: ([^\r\n]*)", 1)
    found = cut(captures.select("record_id", F.col("refers_to").alias("target"), F.when(page != "", F.url_decode(page)).cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("target_uri").alias("url")))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type")
    targets = found.filter("record_type = 'response'").select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"))
    revisits = found.filter("record_type = 'revisit'").join(targets, "target", "left")
    plain = found.filter("record_type != 'revisit'").withColumn("refers_to", F.lit(None).cast(id_type))
    return plain.select(*columns, "refers_to", "url").union(revisits.select(*columns, "refers_to", "url"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return page_captures(assemble(read_archives(spark, folder).drop("payload"))).drop("url")


SQL = """
WITH payloads AS (
    SELECT page_id, COALESCE(html, '') AS html, sha1(COALESCE(html, '')) AS code FROM pages
), firsts AS (
    SELECT *, MIN(page_id) OVER (PARTITION BY html) AS first_id FROM payloads
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
    translate(array_to_string(list_transform(range(8), lambda k: lpad(to_base(('0x' || substr(code, (1 + 5 * k)::INT, 5))::BIGINT, 32), 4, '0')), ''),
        '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM firsts
"""
