"""WARC records in a content-addressed archive.

An archive is two Parquet tables below one folder:

* ``payloads``: digest and payload. Every distinct payload is stored once, under its SHA-256.
* ``records``: one row for each WARC record in file order: its number, the exact bytes of its header
  block (WARC headers, blank line, HTTP headers, blank line), digest and type.

Of records with equal payloads of at least ``least`` bytes that with the smallest page_id is a
``response`` and the others are ``revisit`` records, whose headers name it; a revisit record has no
payload of its own. Smaller payloads are always responses, yet stored once too. The
records as they stand in a WARC file come back by joining both tables by digest (``read_records``), and
``export`` writes them as files: a record ends in two line ends, so Spark's text writer with that
separator makes WARC files. ``import_files`` reads such files.

A digest is verified three times: payloads that share one must agree in length and in a second
hash, stored bytes are digested again when they are read, and a record's headers must state the
digest and length of what was found. A difference is an error.

Where many rows share a payload: copies are counted on the map side, and a digest that holds more
than a thousandth of all rows (there are fewer than a thousand such) is broadcast, so its copies are
settled where they are read and only one of its rows is shuffled; the way back salts such digests
by row. Payloads are shuffled once, to their address.

Cases: a null html is an empty payload; a null url gives no target header, and control characters and
blanks in a url are escaped. A row with a null page_id is a response that nothing refers to. Rows that
share page_id and payload are all responses if they hold the smallest page_id, else all revisits.
Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import cut, salted

CRLF = "\r\n"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "number long, page_id long, record_type string, header binary, digest string"


def payload() -> Column:
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def digests(pages: DataFrame) -> DataFrame:
    """page_id, url, digest, length and a second hash of every page's payload."""
    read = pages.select(F.col("page_id").cast("long"), "url", payload().alias("payload"))
    return read.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"), F.xxhash64("payload").alias("check"))


def contents(found: DataFrame) -> DataFrame:
    """One row for each distinct payload: its digest, how many rows have it, and the smallest page_id.

    Rows without a page_id count, but are named only where no other row has the payload.
    """
    same = (F.min("bytes") == F.max("bytes")) & (F.min("check") == F.max("check"))
    found = found.groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"), same.alias("same"))
    return found.withColumn("first", F.when(F.col("same"), F.col("first")).otherwise(F.raise_error(F.concat(F.lit("two payloads with the digest "), "digest")).cast("long"))).drop("same")


def escaped(url: Column) -> Column:
    """A url that fits into one header line."""
    for char in [" ", *map(chr, range(0x20)), "\x7f"]:
        url = F.replace(url, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return url


def uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def header(date: str) -> Column:
    """The header block of a record with page_id, url, digest, bytes, record_type and first."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    block = F.concat(F.lit(HTTP), line("Content-Length", F.col("bytes").cast("string")), F.lit(CRLF))
    again = F.col("record_type") == "revisit"
    length = F.octet_length(block).cast("long") + F.when(again, F.lit(0)).otherwise(F.col("bytes"))
    revisit = F.concat(line("WARC-Refers-To", uri(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", uri(F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("row:"), F.col("number").cast("string"))))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", escaped(F.col("url"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(again, revisit).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(CRLF),
        block,
    ).cast("binary")


def write(spark: SparkSession, pages: DataFrame, path: str, least: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archive a WARC record for every row of ``pages`` (page_id, url, html) below ``path``."""
    found = cut(spark, digests(pages).withColumn("number", F.monotonically_increasing_id()), "digests")
    classes = cut(spark, contents(found), "contents")
    again = (F.col("bytes") >= least) & (F.col("page_id") > F.col("first"))
    typed = salted(found, classes, "digest").withColumn("record_type", F.when(again, "revisit").otherwise("response"))
    typed.select("number", "page_id", "record_type", header(date).alias("header"), "digest").write.parquet(f"{path}/records")
    # digest and owner are the key, so the copies of one payload do not meet
    owner = lambda page_id: F.coalesce(page_id.cast("string"), F.lit("none")).alias("owner")
    read = pages.select(payload().alias("payload"), owner(F.col("page_id").cast("long"))).withColumn("digest", F.sha2("payload", 256))
    kept = read.join(classes.select("digest", owner(F.col("first"))), ["digest", "owner"])
    kept.dropDuplicates(["digest", "owner"]).select("digest", "payload").write.parquet(f"{path}/payloads")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """digest, payload and its length; every payload is digested again."""
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    wrong = F.raise_error(F.concat(F.lit("a stored payload differs from its digest "), "digest")).cast("string")
    digest = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(wrong)
    return stored.select(digest.alias("digest"), "payload", F.octet_length("payload").cast("long").alias("bytes"))


def _with_counts(spark: SparkSession, records: DataFrame, addressed: DataFrame) -> DataFrame:
    """What the records' digests address, with the number of records; a record without payload is an error."""
    counts = records.groupBy("digest").agg(F.count("*").alias("n"))
    lost = F.raise_error(F.concat(F.lit("no payload is stored for "), "digest")).cast("long")
    both = counts.join(addressed, "digest", "left")
    return cut(spark, both.withColumn("bytes", F.coalesce("bytes", lost)), "addressed")


def stated(name: str, value: str) -> Column:
    """What a header line states; an empty text where there is none."""
    return F.regexp_extract(F.col("header").cast("string"), f"\r\n{name}: {value}\r\n", 1)


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as the archive's records state them.

    Every record meets its payload's digest and length, which were computed from the stored bytes.
    """
    records = spark.read.schema(RECORDS).parquet(f"{path}/records")
    addressed = _with_counts(spark, records, payloads(spark, path).select("digest", "bytes"))
    read = salted(records, addressed, "digest").select(
        "number",
        "digest",
        "bytes",
        stated("WARC-Type", "([a-z]+)").alias("record_type"),
        stated("WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("payload_digest"),
        stated("WARC-Record-ID", "<urn:page:(-?[0-9]+)>").alias("page"),
        stated("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").alias("refers"),
        F.regexp_extract(F.col("header").cast("string"), "\r\n\r\nHTTP/1.1 [^\r]*\r\n(?:[^\r]+\r\n)*?Content-Length: ([0-9]+)\r\n", 1).alias("length"),
    )
    agrees = (F.col("payload_digest") == F.col("digest")) & (F.col("length") == F.col("bytes").cast("string"))
    differs = F.raise_error(F.concat(F.lit("headers of a record differ from its payload: "), "digest")).cast("long")
    number = lambda text: F.when(F.col(text) != "", F.col(text)).cast("long")
    return read.select(
        number("page").alias("page_id"),
        F.when(agrees, F.col("bytes")).otherwise(differs).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        number("refers").alias("refers_to"),
    )


def read_records(spark: SparkSession, path: str, originals: bool = False) -> DataFrame:
    """number, page_id, record_type, header and block of every record.

    A revisit record's block ends with its headers; with ``originals`` it gets the payload it stands for.
    """
    records = spark.read.schema(RECORDS).parquet(f"{path}/records")
    wanted = records if originals else records.where("record_type <> 'revisit'")
    full = salted(wanted, _with_counts(spark, wanted, payloads(spark, path)), "digest").drop("bytes")
    bare = records.where("record_type = 'revisit'").withColumn("payload", F.lit("").cast("binary"))
    both = full if originals else full.unionByName(bare)
    return both.select("number", "page_id", "record_type", "header", "payload")


def export(spark: SparkSession, path: str, out: str, records_a_file: int = 20_000, compression: str = "none") -> None:
    """Write the archive's records as WARC files; a record is its header, its payload and two line ends."""
    whole = F.concat("header", "payload").cast("string").alias("value")
    writer = read_records(spark, path).select(whole).write.option("lineSep", CRLF * 2)
    writer.option("maxRecordsPerFile", records_a_file).option("compression", compression).text(out)


def split_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Header block (with the HTTP headers, where there are any) and payload of each record of a file."""
    at, blank = 0, b"\r\n\r\n"
    while at < len(data):
        end = data.index(blank, at) + 4
        length = re.search(rb"\r\nContent-Length:[ \t]*([0-9]+)\r\n", data[at:end], re.I)
        if not data.startswith(b"WARC/", at) or not length:
            raise ValueError(f"no WARC record at byte {at}")
        last = end + int(length[1])
        if data[last : last + 4] != blank:
            raise ValueError(f"the record at byte {at} is cut off")
        body = data.find(blank, end, last) + 4 if data.startswith(b"HTTP/", end) else end
        body = body if body > 3 else last
        yield data[at:body], data[body:last]
        at = last + 4


def import_files(spark: SparkSession, files: str) -> DataFrame:
    """file, place in it, header and payload of every record of WARC files; a file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = list(split_records(data.as_py()))
                for low in range(0, len(found), 1000):
                    part = found[low : low + 1000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * len(part)), pa.array(range(low, low + len(part)), pa.int64()), *(pa.array(x, pa.binary()) for x in zip(*part))],
                        names=["file", "place", "header", "payload"],
                    )

    # a row is a whole file
    read = spark.read.format("binaryFile").load(files).select("path", "content")
    return read.mapInArrow(run, "file string, place long, header binary, payload binary")
