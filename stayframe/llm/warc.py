"""WARC archives compressed record by record with a Zstandard dictionary (``.warc.zst``).

An archive is one file of a folder that Spark's own text writer commits, so it lies wherever Spark can write
and a lost executor only repeats its files. Its bytes are a sequence of Zstandard frames:

1. a skippable frame with the magic number 0x184D2A5D whose content is the dictionary, built from the first
   ``TRAIN_BYTES`` of the archive's own records (their raw bytes where they are too few to train on);
2. one frame for each WARC record, compressed by itself with that dictionary, so that any record can be read alone;
3. after each of them an empty skippable frame (8 bytes): it is the line end of Spark's text writer, and decoders skip it.

A page is a ``response`` record (``application/http`` with a status line and the payload), or a ``revisit``
(identical-payload-digest) with the HTTP head alone. Payloads of at least ``least`` bytes that are equal (by their
SHA-256) are written once: the row with the smallest id is the response, the others refer to it; rows that share this
smallest id are responses all. Shorter ones are always responses. Rows are dealt to archives by their digests, about
``archive_bytes`` of payload to each, so a payload's rows meet in one task; one that more than ``1 / HOT`` of all rows
share is looked up in a broadcast of at most ``HOT`` such payloads instead, and its rows are dealt by their ids. The
payloads are moved once.

Results: a null payload is an empty one; a null id is written without the field that holds it, reads back as null,
and comes behind all others (its payload is a revisit if a row with an id has the same); a null URL has no target field;
control characters and blanks of a URL are percent-encoded in its header. Very long payloads are records like others
(rows are encoded one by one; an archive is read whole, so it holds one record beyond ``archive_bytes`` at most, give or
take the chance of the deal). Repeated rows are records of their own. An empty table writes no record. Columns other
than id, URL and payload are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the formats.
DICTIONARY_MAGIC, SKIPPABLE, EMPTY_FRAME = 0x184D2A5D, 0x184D2A50, b"P*M\x18\0\0\0\0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of an archive; bytes of records that a dictionary is built from, and its size; the compression level.
ARCHIVE_BYTES, TRAIN_BYTES, DICTIONARY_BYTES, LEVEL = 32 << 20, 2 << 20, 64 << 10, 5
#: A payload that more than one in so many rows share is hot.
HOT = 1000
#: Bytes of one output batch of frames.
OUT_BYTES = 4 << 20


def with_references(pages: DataFrame, least: int = 100, archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id",
                    url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, url, payload, digest, refers_to), dealt to archives: every page with its payload's SHA-256 and the id of
    the response it repeats (null: it is a response itself)."""
    payload = F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit("").cast("binary"))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    size = F.octet_length("payload").cast("bigint")
    rows, total = base.agg(F.count("*"), F.sum(size)).first()
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("_long", size >= least)
    hot = base.filter("_long").groupBy("digest").agg(F.count("*").alias("_rows"), F.min("id").alias("_hot_first")).filter(F.col("_rows") > rows / HOT)
    base = base.join(F.broadcast(hot.select(F.col("digest").alias("_hot"), "_hot_first")), F.col("digest") == F.col("_hot"), "left")
    alone = F.concat(F.lit("#"), F.xxhash64("id", "url", "digest").cast("string"))
    grouped = F.col("_long") & F.col("_hot").isNull()
    dealt = base.withColumn("_key", F.when(grouped, F.col("digest")).otherwise(alone))
    dealt = dealt.repartition(max(1, math.ceil((total or 0) / archive_bytes)), "_key")
    first = F.min("id").over(Window.partitionBy("_key"))
    first = F.when(F.col("_long"), F.when(F.col("_hot").isNull(), first).otherwise(F.col("_hot_first")))
    return dealt.withColumn("_first", first).select("id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))


def record_id(page, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def record(page, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record: headers, an empty line, the block, two line ends."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        fields += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    fields.append(f"WARC-Payload-Digest: sha256:{digest}")
    if page is not None:
        fields.append(f"Page-ID: {page}")
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(fields).encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict, bytes, bytes]:
    """(fields of the WARC head, HTTP head, payload) of a record."""
    top, _, rest = data.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """A dictionary built from records; of a few short ones (which cannot be trained on) their last bytes as they are."""
    try:
        return zstandard.train_dictionary(size, records, k=256, d=8)
    except zstandard.ZstdError:
        raw = b"".join(records)[-size:]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def frames(data: memoryview) -> Iterator[tuple[int, int, int]]:
    """(magic number, start, end) of the frames of an archive; of a skippable one, the place of its content."""
    at = 0
    while at < len(data):
        magic, = struct.unpack_from("<I", data, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            size, = struct.unpack_from("<I", data, at + 4)
            yield magic, at + 8, at + 8 + size
            at += 8 + size
            continue
        start, flags = at, data[at + 4]
        at += zstandard.frame_header_size(data[at:at + 18])
        last = False
        while not last:  # blocks: a 3-byte head (last, type, size), then the content (one byte if repeated)
            head = int.from_bytes(data[at:at + 3], "little")
            last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
            at += 3 + (1 if kind == 1 else size)
        at += 4 if flags & 4 else 0
        yield magic, start, at


def write_archives(pages: DataFrame, path: str, least: int = 100, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z",
                   id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write a record per row of ``pages`` to the archives of a new folder ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["frame"])
        held, size, pack, out, out_size = [], 0, None, [], 0

        def opened() -> zstandard.ZstdCompressor:
            own = dictionary(held)
            data = own.as_bytes()
            out.append(struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=True)

        for b in batches:
            columns = [b.column(k) for k in range(5)]
            for k in range(b.num_rows):
                page, url, payload, digest, refers_to = (c[k].as_py() for c in columns)
                whole = record(page, url, payload, digest, refers_to, date)
                if pack is None:
                    held.append(whole)
                    size += len(whole)
                    if size < TRAIN_BYTES:
                        continue
                    pack = opened()
                    ready, held = held, []
                else:
                    ready = [whole]
                for r in ready:
                    out.append(pack.compress(r))
                    out_size += len(out[-1])
                    if out_size >= OUT_BYTES:
                        yield batch(out)
                        out, out_size = [], 0
        if held:
            pack = opened()
            out += [pack.compress(r) for r in held]
        if out:
            yield batch(out)

    rows = with_references(pages, least, archive_bytes, id_col, url_col, payload_col)
    encoded = rows.mapInArrow(run, "frame binary").select(F.col("frame").cast("string"))  # the bytes as they are
    encoded.write.option("lineSep", EMPTY_FRAME.decode()).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str, kind: str = "bigint", payloads: bool = False) -> DataFrame:
    """Every record of the archives in ``path``: page_id, url, record_type, payload_bytes and payload_digest (of the full
    payload), refers_to and, if ``payloads``, the payload (null of a revisit). A payload that does not have the digest
    its record states is an error."""
    schema = f"page_id string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to string{', payload binary' if payloads else ''}"

    def rows(content: memoryview) -> Iterator[tuple]:
        unpack = None
        for magic, start, end in frames(content):
            if magic == DICTIONARY_MAGIC:
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(content[start:end])))
            elif magic & 0xFFFFFFF0 != SKIPPABLE:
                fields, http, payload = parsed(unpack.decompress(content[start:end]))
                digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"] == "revisit"
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"the payload of record {fields['WARC-Record-ID']} is not what its digest states")
                yield (fields.get("Page-ID"), fields.get("WARC-Target-URI"), fields["WARC-Type"], size, digest,
                       fields.get("Refers-To-Page-ID"), *([None if revisit else payload] if payloads else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out_type)
        batch = lambda rs: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rs), arrow)], schema=arrow)
        for b in batches:
            for content in b.column(0):
                out, size = [], 0
                for r in rows(memoryview(content.as_buffer())):
                    out.append(r)
                    size += 200 + (r[3] if payloads else 0)
                    if size >= OUT_BYTES:
                        yield batch(out)
                        out, size = [], 0
                if out:
                    yield batch(out)

    out_type = spark.createDataFrame([], schema).schema
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, schema).withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
