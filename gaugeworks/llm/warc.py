"""WARC archives: writing captures as request, response and metadata records, and assembling them again.

Archives are gzip files of one member per record (WARC 1.1). A capture is a response (or, where an equal
payload is stored elsewhere, a revisit), the request that led to it and a metadata record; the latter two
name the former in ``WARC-Concurrent-To``. Reading gives one row per record; ``assemble`` joins the records
of a capture through that name into one nested row.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import remember, saved, ship, shuffle_parts
from gaugeworks.llm.token_records import place_of
from gaugeworks.session import fresh_path

#: Payloads of fewer bytes are stored each time.
LEAST_SHARED = 1000
#: Fixed value: the time that all synthetic captures bear, as the table holds none.
DATE = "2024-01-01T00:00:00Z"
LEVEL = 4
RECORD = """record_id string, record_type string, concurrent_to string, target_uri string, refers_to string,
block_bytes long, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"""


def record_name(kind: int, page_id: int | None, url: str | None, digest: str, serial: int = 0) -> str:
    """Name of a record: its kind, a hash of the capture and its serial number, and the page's id in the last 64 bits."""
    seed = f"{page_id is None}|{url is None}|{serial}|{digest}|{url}".encode("utf-8", "surrogatepass")
    seed = hashlib.blake2b(seed, digest_size=7).digest()
    number = (kind << 120) | (int.from_bytes(seed, "big") << 64) | ((page_id or 0) & (1 << 64) - 1)
    return f"<urn:uuid:{uuid.UUID(int=number)}>"


def page_of(name: str) -> int:
    low = uuid.UUID(name.strip("<>")).int & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def _plain(value: str) -> str:
    """A header's value without line breaks, which would end it."""
    return " ".join(value.splitlines()) if value else ""


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}", "", ""]
    plain = "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(plain) + packer.flush()


def sha1_name(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def capture_records(page_id, url, payload: bytes, original_name: str | None, serial: int = 0) -> list[bytes]:
    """The three records of a page; ``original_name`` is the response that a revisit refers to."""
    digest = sha1_name(payload)
    name = record_name(1, page_id, url, digest, serial)
    parts = urlsplit(_plain(url)) if url and "[" not in url and "]" not in url else urlsplit("")
    common = [("WARC-Date", DATE), ("WARC-Target-URI", _plain(url))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    revisit = original_name is not None
    first = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name), *common,
             ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        first += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", original_name)]
    request = f"GET {parts.path or '/'} HTTP/1.1\r\nHost: {parts.netloc}\r\n\r\n".encode("utf-8", "surrogatepass")
    known = "" if page_id is None else f"page-id: {page_id}\r\n"
    about = f"{known}has-uri: {int(url is not None)}\r\npayload-bytes: {len(payload)}\r\n".encode()

    def second(kind: int, label: str, content: str) -> list[tuple[str, str]]:
        own = record_name(kind, page_id, url, digest, serial)
        return [("WARC-Type", label), ("WARC-Record-ID", own), ("WARC-Concurrent-To", name), *common, ("Content-Type", content)]

    return [
        record_bytes(second(2, "request", "application/http; msgtype=request"), request),
        record_bytes(first, http if revisit else http + payload),
        record_bytes(second(3, "metadata", "application/warc-fields"), about),
    ]


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_SHARED) -> DataFrame:
    """Write a capture for every page (page_id, url, html); returns the manifest, a row for each archive.

    Of pages with equal payloads of at least ``least`` bytes, that with the largest page_id becomes the
    response and the others revisit it; smaller ones and those without an equal are responses. A null html
    is an empty payload; null ids and urls are written as absent. Rows equal in id, url and html are one
    capture. The choice needs only digests: the largest id per digest is combined before the shuffle, and
    the pages join it by digest, where adaptive execution splits a digest that many share.
    """
    spark = pages.sparkSession
    ship(spark)
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload"))
    keyed = keyed.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload"), "serial": F.monotonically_increasing_id()})
    shared = (
        keyed.filter(F.col("size") >= least).groupBy(F.col("digest").alias("of"))
        .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    )
    # the response that a revisit names: one page of that id, whose url and serial number are part of its name
    named = (
        keyed.filter(F.col("size") >= least).select("digest", "page_id", "url", "serial")
        .join(shared, (F.col("digest") == F.col("of")) & (F.col("page_id") == F.col("original")))
        .groupBy("of", "original").agg(F.min(F.struct("serial", "url")).alias("at"))
        .select("of", "original", F.col("at.url").alias("original_url"), F.col("at.serial").alias("original_serial"))
    )
    marked = keyed.join(named, (F.col("digest") == F.col("of")) & (F.col("size") >= least), "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    marked = marked.select(
        "page_id", "url", "payload", F.col("serial").cast("string").alias("serial"), F.when(revisit, F.col("original")).alias("original"),
        "original_url", F.col("original_serial").cast("string").alias("original_serial"),
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        files, path = place_of(folder)
        files.create_dir(path)
        out, count, size = None, 0, 0
        for batch in batches:
            for page_id, url, payload, serial, original, original_url, original_serial in batch.itertuples(index=False):
                out = out or files.open_output_stream(f"{path}/{name}", compression=None)
                page_id, original = (None if pd.isna(x) else int(x) for x in (page_id, original))
                target = None if original is None else record_name(1, original, original_url, sha1_name(payload), int(original_serial))
                for record in capture_records(page_id, url, payload, target, int(serial)):
                    out.write(record)
                    count, size = count + 1, size + len(record)
        if out is not None:
            out.close()
            yield pd.DataFrame({"file": [name], "n_records": [count], "n_bytes": [size]})

    ids = marked.withColumns({c: F.col(c).cast("decimal(20,0)") for c in ("page_id", "original")})
    return saved(ids.mapInPandas(write, "file string, n_records long, n_bytes long"), "archives")


def parse_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, read as a stream; damage raises ValueError."""
    unpack, rest, plain = zlib.decompressobj(31), b"", bytearray()
    while True:
        data = rest or source.read(1 << 20)
        if not data:
            if plain:
                raise ValueError("an archive ends within a record")
            return
        try:
            plain += unpack.decompress(data)
        except zlib.error as broken:
            raise ValueError("an archive does not decompress") from broken
        rest = unpack.unused_data
        if not unpack.eof:
            continue
        head, _, block = bytes(plain).partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(headers.get("content-length", -1))
        if not version.startswith("WARC/") or len(block) != length + 4 or not block.endswith(b"\r\n\r\n"):
            raise ValueError("a record is not as long as it says")
        yield headers, block[:length]
        unpack, plain = zlib.decompressobj(31), bytearray()


def record_row(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind = headers.get("warc-type", "")
    fields, payload = dict(headers), None
    size = digest = None
    if kind in ("response", "revisit"):
        payload = block.partition(b"\r\n\r\n")[2]
        if kind == "response":
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
            if sha1_name(payload) != headers.get("warc-payload-digest", sha1_name(payload)):
                raise ValueError("a payload does not match its digest")
        else:
            digest = base64.b32decode(headers["warc-payload-digest"].partition(":")[2]).hex()
    elif kind == "metadata":
        fields |= {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode().split("\r\n") if x)}
    return (
        headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-target-uri"),
        headers.get("warc-refers-to"), len(block), size, digest, fields, payload if with_payload and kind == "response" else None,
    )


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives named in the manifest."""
    ship(spark)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = place_of(folder)
        names = [f.split()[0] for f in RECORD.replace("\n", " ").split(", ")]
        for batch in batches:
            for name in batch["file"]:
                with files.open_input_stream(f"{path}/{name}", compression=None) as source:
                    rows, size = [], 0
                    for headers, block in parse_records(source):
                        rows.append(record_row(headers, block, with_payload))
                        size += len(block)
                        if len(rows) >= 2000 or size > 16 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, size = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=names)

    return manifest.select("file").repartition(shuffle_parts(spark), "file").mapInPandas(read, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: ``capture_id`` and the nested ``request``, ``response`` and ``metadata``.

    Requests and metadata join the response or revisit that they name as concurrent; a capture without one of
    them has null there. Records of the same name are one record. Requests and metadata that name no record
    of the archives, and records of other kinds, belong to no capture.
    """
    main = records.filter(F.col("record_type").isin("response", "revisit")).dropDuplicates(["record_id"])

    def named(kind: str) -> DataFrame:
        own = records.filter(F.col("record_type") == kind).dropDuplicates(["concurrent_to"])
        return own.select(
            F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "target_uri", "block_bytes", "fields").alias(kind)
        )

    parts = [c for c in records.columns if c != "concurrent_to"]
    response = main.select(F.col("record_id").alias("capture_id"), F.struct(*parts).alias("response"))
    return response.join(named("request"), "capture_id", "left").join(named("metadata"), "capture_id", "left")


def page_rows(captures: DataFrame) -> DataFrame:
    """Per capture: page_id, payload_bytes, payload_digest, record_type and refers_to (the id of the page referred to)."""
    low = F.substring(F.regexp_replace("response.refers_to", "[^0-9a-f]", ""), -16, 16)
    high_half = F.conv(F.substring(low, 1, 8), 16, 10).cast("long")
    high_half = F.when(high_half >= 2**31, high_half - 2**32).otherwise(high_half)
    target = high_half * F.lit(2**32).cast("long") + F.conv(F.substring(low, 9, 8), 16, 10).cast("long")
    return captures.select(
        F.col("metadata.fields")["page-id"].cast("long").alias("page_id"),
        F.col("metadata.fields")["payload-bytes"].cast("long").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.when(F.col("response.record_type") == "revisit", target).alias("refers_to"),
    )


def fresh_folder(spark: SparkSession) -> str:
    folder = fresh_path(spark, "warc")
    remember(folder)
    return folder


#: The same in the checking engine's SQL.
ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM m
"""
