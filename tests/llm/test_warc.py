import gzip
import hashlib
import io
import os
import zlib

import pytest

from lociframe.llm import warc


def rows_of(spark, data, folder, **how):
    df = spark.createDataFrame(data, "page_id long, url string, html string, digest string").repartition(3)
    files = warc.settle(warc.write(warc.plan(df), folder, **how))
    return files, warc.read(files, folder).collect()


BIG = "x" * 1200
DATA = [
    (1, "http://a/", BIG, "d"), (5, "http://b/", BIG, "d"), (5, "http://b2/", BIG, "d"), (3, None, None, "d"), (4, "http://c/\r\nX: y", "ä" * 400, "d"), (7, "u", "ä" * 400, "d"),
    (8, "u", "ä" * 600, "d"), (9, "u", "ä" * 600, "d"), (None, "u", BIG, "d"), (10, "", "", "d"), (11, "u", "\r\n\r\nWARC/1.1\r\n" * 300, "d"), (12, "u", "z" * 3_000_000, "d"),
]


def test_round_trip(spark, tmp_path):
    folder = str(tmp_path / "w")
    files, got = rows_of(spark, DATA, folder, roll_bytes=300)
    assert len(files.collect()) > 2 and sum(r.records for r in files.collect()) == len(got) == len(DATA)
    heads = {}
    for i, _, h, _ in DATA:
        if h and len(h.encode()) >= 1000 and i is not None:
            heads[h] = max(heads.get(h, i), i)
    want = sorted(((str(i) if i is not None else None, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), str(heads[h]) if heads.get(h, i) != i else None) for i, _, h, _ in DATA), key=str)
    assert sorted(((r.id, r.payload_bytes, r.payload_digest, r.refers_to) for r in got), key=str) == want
    for r in got:
        assert r.digest_ok and (r.record_type == "revisit") == (r.refers_to is not None)
        if r.record_type == "response":
            assert hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest
    assert {r.url for r in got if r.id == "4"} == {"http://c/%0D%0AX:%20y"} and {r.url for r in got if r.id == "3"} == {None}
    # one gzip member per record: every offset starts a member of its own
    for r in got:
        with open(os.path.join(folder, r.path), "rb") as f:
            f.seek(r.offset)
            assert zlib.decompressobj(wbits=31).decompress(f.read()).startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())


def test_empty(spark, tmp_path):
    files, got = rows_of(spark, [(1, "u", "t", "d")], str(tmp_path / "e"))
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(warc.plan(none), str(tmp_path / "n")), str(tmp_path / "n")).count() == 0


def test_damage_is_found():
    good = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, "d", 6)
    assert [b for _, _, b in warc.records(io.BytesIO(good * 3), "f")][2].endswith(b"\r\n\r\nabc")
    assert [o for o, _, _ in warc.records(io.BytesIO(good * 3), "f")] == [0, len(good), 2 * len(good)]
    plain = gzip.decompress(good)
    for bad in (good[:-9], good + b"junk", gzip.compress(plain + b"more"), gzip.compress(plain[:-4]), gzip.compress(plain.replace(b"WARC/1.1", b"XARC/1.1")), good[:40] + b"\0\0" + good[42:]):
        with pytest.raises(warc.Damaged):
            list(warc.records(io.BytesIO(bad), "f"))


def test_wrong_digest_is_told(spark, tmp_path):
    body = warc.record(1, "u", b"abc", hashlib.sha1(b"abd").hexdigest(), None, "d", 6)
    (tmp_path / "x.warc.gz").write_bytes(body)
    files = spark.createDataFrame([("x.warc.gz",)], "path string")
    assert [r.digest_ok for r in warc.read(files, str(tmp_path)).collect()] == [False]
