import random

from tidemark.llm.warc import build_record, read_warc, salvage, write_warc
import hashlib
import zlib


def record(i, body, refers=None):
    return build_record(i, f"http://x/{i}", body, hashlib.sha256(body).hexdigest(), refers)


def test_salvage_recovers_later_members():
    rng = random.Random(3)
    bodies = [bytes(rng.randrange(32, 120) for _ in range(rng.randrange(0, 4000))) for _ in range(30)]
    parts = [record(i, b) for i, b in enumerate(bodies)]
    good = b"".join(parts)
    assert [f.block for f in salvage(good)] == bodies
    broken = bytearray(good)
    at = sum(map(len, parts[:5])) + len(parts[5]) // 2
    broken[at] ^= 0xFF
    found = list(salvage(bytes(broken)))
    gaps = [f for f in found if f.headers is None]
    assert [(g.offset, g.length) for g in gaps] == [(sum(map(len, parts[:5])), len(parts[5]))]
    assert [f.block for f in found if f.headers is not None] == bodies[:5] + bodies[6:]
    assert sum(f.length for f in found) == len(broken)
    cut = list(salvage(good[: len(good) - 3] + b""))
    assert cut[-1].reason and len(cut) == 30


def test_salvage_of_plain_archives():
    parts = [zlib.decompress(record(i, b"body %d WARC/1.0\r\n not a record" % i), 31) for i in range(6)]
    data = bytearray(b"".join(parts))
    at = len(parts[0]) + len(parts[1]) + parts[2].index(b"body") + 1
    data[at] ^= 1
    found = list(salvage(b"junk" + bytes(data)))
    assert [f.offset for f in found if f.headers is None] == [0, 4 + len(parts[0]) + len(parts[1])]
    assert sum(f.headers is not None for f in found) == 5


def test_round_trip_with_nulls_ties_and_repeats(spark):
    big = "é" * 60
    rows = [(3, "u\r\n1", big, "x"), (1, None, big, "y"), (1, None, big, "y"), (2, "b", None, "z"), (4, "c", "", "z"), (None, "d", big, "z"), (5, "e", "short", "w"), (6, "f", "short", "w")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = read_warc(write_warc(df)).filter("kind = 'record'").collect()
    assert len(got) == len(rows)
    assert sorted((r.page_id or "", r.record_type, r.refers_to or "", r.payload_bytes) for r in got) == sorted(
        [("3", "revisit", "1", 120), ("1", "response", "", 120), ("1", "response", "", 120), ("2", "response", "", 0), ("4", "response", "", 0), ("", "revisit", "1", 120), ("5", "response", "", 5), ("6", "response", "", 5)]
    )
    assert {r.page_id: r.url for r in got}["3"] == "u\r\n1"
    assert read_warc(write_warc(df.limit(0))).count() == 0


def test_headers_of_other_writers_are_read():
    a = b"WARC/1.0\r\nWARC-Type:response\r\nwarc-record-id:\t<urn:page:7> \r\nCONTENT-LENGTH: 3\r\n\r\nabc\r\n\r\n"
    b = b"WARC/1.1\r\nContent-Length:0\r\nWARC-Type: warcinfo\r\nX-Long: one\r\n two\r\n\r\n\r\n\r\n"
    found = list(salvage(a + b + zlib.compress(a, wbits=31)))
    assert [f.block for f in found] == [b"abc", b"", b"abc"] and found[0].headers["warc-type"] == "response" and found[0].headers["warc-record-id"] == "<urn:page:7>"
    assert found[1].headers["x-long"] == "one two"
    bad = [b"WARC/1.0\r\nno colon\r\nContent-Length: 0\r\n\r\n\r\n\r\n", b"WARC/1.0\r\nContent-Length: -1\r\n\r\n\r\n\r\n"]
    assert [f.reason for x in bad for f in salvage(x)] == ["headers not readable", "no content length"]


def test_every_record_has_a_date():
    assert all(b"\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n" in zlib.decompress(record(i, b"x", r), 31) for i, r in ((1, None), (2, 1)))


def test_salvage_is_linear_and_inflates_no_more_than_is_announced():
    import time

    began = time.perf_counter()
    (gap,) = salvage(b"\x1f\x8b\x08" * 350_000)
    assert gap.length == 1_050_000 and time.perf_counter() - began < 10
    bomb = zlib.compress(b"WARC/1.0\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" + bytes(50_000_000), 9, wbits=31)
    good = record(1, b"kept")
    found = list(salvage(bomb + good))
    assert found[0].reason == "trailing bytes in member" and found[-1].block == b"kept" and sum(f.length for f in found) == len(bomb) + len(good)
    no_end = zlib.compress(b"WARC/1.0\r\n" + b"x" * 5_000_000, 9, wbits=31)
    assert next(salvage(no_end)).reason == "headers not ended"
    big = random.Random(1).randbytes(3_000_000)
    assert [f.block for f in salvage(record(1, big) + good)] == [big, b"kept"]
