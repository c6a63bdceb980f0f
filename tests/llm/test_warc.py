"""WARC archives: exact round trips, the bytes of the files, revisits, odd rows."""

import glob
import hashlib
import random
import uuid

import pytest
import zstandard

from stayframe.llm import warc as W
from stayframe.llm._stage import new_path

PAGES = "page_id bigint, url string, html string, digest string, refers_to string"
LONG = "<html>" + "x" * 200 + "</html>"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "other", "column") for r in rows], PAGES)


def written(spark, rows, **more):
    path = new_path(spark, f"warc-test-{uuid.uuid4().hex}")
    W.write_archives(pages(spark, rows), path, **more)
    return path


def wanted(rows, least=100):
    out, first = [], {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= least and i is not None:
            first[data] = min(i, first.get(data, i))
    for i, _, html in rows:
        data = (html or "").encode()
        other = first.get(data)
        revisit = other is not None and other != i
        out.append((i, "revisit" if revisit else "response", len(data), hashlib.sha256(data).hexdigest(), other if revisit else None, None if revisit else data))
    return sorted(out, key=repr)


def read(spark, path):
    rows = W.read_archives(spark, path, payloads=True).collect()
    return sorted(((r["page_id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in rows), key=repr)


def corpus(seed=1, n=300):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "<p>", "</p>", "\r\n\r\n", "WARC/1.1", "ü", "漢字", "\x00", "P*M\x18\0\0\0\0"]
    return [(i, f"https://example.com/{i}", " ".join(r.choice(words) for _ in range(r.randint(0, 200)))) for i in range(n)]


ODD = [(1000, None, None), (1001, "http://a/ b\r\nWARC-Type: x", ""), (1002, "http://a", "short"), (1003, "http://a", "short"), (None, "http://n", LONG), (None, None, None),
       (1005, "http://b", LONG), (1004, "http://c", LONG), (1004, "http://d", LONG), (1006, "ü://é", "y" * 99), (1007, "", "y" * 99), (1008, "http://e", "z" * 100), (1009, "http://e", "z" * 100),
       (-5, "http://big", "long text " * 300_000)]


def test_round_trip(spark):
    rows = corpus() + ODD + [(2000 + i, "http://hot", LONG + "hot") for i in range(400)]
    path = written(spark, rows, archive_bytes=1 << 19)
    assert read(spark, path) == wanted(rows)
    assert len([f for f in glob.glob(path + "/part-*")]) > 3


def test_files_are_plain_frames(spark):
    rows = corpus(2, 2000)
    path = written(spark, rows, archive_bytes=1 << 20)
    seen = 0
    for name in glob.glob(path + "/part-*"):
        data = open(name, "rb").read()
        if not data:
            continue
        places = list(W.frames(memoryview(data)))
        magic, start, end = places[0]
        assert magic == W.DICTIONARY_MAGIC and start == 8
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[start:end]))
        bodies = [(s, e) for m, s, e in places[1:] if m & 0xFFFFFFF0 != W.SKIPPABLE]
        assert all(e - s == 0 for m, s, e in places[1:] if m & 0xFFFFFFF0 == W.SKIPPABLE)
        for s, e in bodies:  # any record alone
            fields, http, payload = W.parsed(unpack.decompress(data[s:e]))
            assert http.startswith(b"HTTP/1.1 200 OK") and fields["WARC-Record-ID"] == W.record_id(int(fields["Page-ID"]), fields["WARC-Payload-Digest"].removeprefix("sha256:"))
            assert fields["WARC-Type"] == "revisit" or hashlib.sha256(payload).hexdigest() == fields["WARC-Payload-Digest"].removeprefix("sha256:")
        seen += len(bodies)
    assert seen == len(rows)


def test_fields(spark):
    got = {(r["page_id"], r["record_type"]): r["url"] for r in W.read_archives(spark, written(spark, ODD)).collect()}
    assert got[1001, "response"] == "http://a/%20b%0D%0AWARC-Type:%20x"
    assert got[1000, "response"] is None and got[1007, "response"] == "" and got[1006, "response"] == "ü://é"
    assert got[1004, "response"] in ("http://c", "http://d") and got[1005, "revisit"] == "http://b"


def test_empty_table(spark):
    assert read(spark, written(spark, [])) == []


def test_only_null_ids(spark):
    rows = [(None, None, LONG), (None, None, LONG)]
    assert read(spark, written(spark, rows)) == wanted(rows)


def test_damage_is_an_error(spark):
    path = written(spark, [(1, "http://a", LONG)])
    name = next(f for f in glob.glob(path + "/part-*") if open(f, "rb").read())
    data = bytearray(open(name, "rb").read())
    data[-12] ^= 1  # in the last record's checksum
    copy = new_path(spark, f"warc-damaged-{uuid.uuid4().hex}")
    spark.createDataFrame([(bytes(data),)], "frame binary").selectExpr("cast(frame as string)").coalesce(1).write.option("lineSep", W.EMPTY_FRAME.decode()).text(copy)
    with pytest.raises(Exception, match="[Cc]hecksum"):
        read(spark, copy)
