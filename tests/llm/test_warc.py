"""Long headers, and damage inside gzip members of several records."""

import base64
import hashlib
import os
import time
import zlib

import pytest

from corvane.llm import warc

DATE = "2000-01-01T00:00:00Z"


def made(n):
    return [warc.record(i, f"http://x/{i}", os.urandom(3000).hex().encode(), None, DATE) for i in range(n)]


def pages(data):
    return [warc._page(r[b"warc-record-id"]) for _, _, r, _ in warc.salvage(bytes(data)) if r]


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("url", ["http://x/" + "a" * 70_000, "http://x/" + "\u4e2d" * 7_400])
def test_long_addresses(spark, tmp_path, compressed, url):
    rows = spark.createDataFrame([(1, url, "one"), (2, "http://x/2", "two")], "page_id long, url string, html string")
    warc.write_archives(rows, str(tmp_path / "a"), compressed=compressed)
    found = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert {(r.kind, r.page_id) for r in found} == {("record", 1), ("record", 2)}


def test_a_bad_record_inside_a_whole_member():
    records = made(9)
    records[4] = records[4][:-20] + b"!" + records[4][-19:]
    data = warc.member(b"".join(records), 5)
    found = list(warc.salvage(data))
    assert [warc._page(r[b"warc-record-id"]) if r else None for _, _, r, _ in found] == [0, 1, 2, 3, None, 5, 6, 7, 8]
    assert {x[:2] for x in found} == {(0, len(data))} and found[4][3] == "digest"


@pytest.mark.parametrize("level", [0, 5])
def test_broken_members_give_what_came_out(level):
    first, tail = warc.member(b"".join(made(30)), level), warc.member(warc.record(99, None, b"x", None, DATE), level)
    assert pages(first[: len(first) * 2 // 3]) in ([*range(19)], [*range(20)])
    wrong = bytearray(first)
    wrong[-6] ^= 0xFF
    assert pages(wrong + tail) == [*range(30), 99]
    assert pages(first[: len(first) * 2 // 3] + tail)[-1] == 99
    got = list(warc.salvage(bytes(wrong + tail)))
    gaps = [x for x in got if x[2] is None]
    assert len(gaps) == 1 and gaps[0][3] == "member" and gaps[0][0] + gaps[0][1] == len(first)


def test_records_of_a_broken_member_need_their_digest():
    bare = b"WARC/1.1\r\nWARC-Type: x\r\nWARC-Record-ID: <urn:page:7>\r\nWARC-Date: x\r\nContent-Length: 1\r\n\r\ny\r\n\r\n"
    data = warc.member(bare + b"".join(made(2)), 5)
    assert pages(data) == [7, 0, 1] and pages(data[:-4]) == [0, 1]


def test_many_version_lines_before_one_end():
    data = b"WARC/1.1\r\n" * 300_000 + b"Content-Length: 5\r\n\r\n" + made(1)[0]
    assert pages(data) == [0]


@pytest.mark.parametrize("level", [0, 5, 9])
def test_what_came_out_before_an_error_is_whole(level):
    """As byte by byte."""
    content = b"".join(made(12)) + b"\0" * 100_000
    data = bytearray(warc.member(content, level))
    for hit in (len(data) // 3, len(data) * 2 // 3, len(data) - 7):
        bad = data.copy()
        bad[hit : hit + 3] = bytes(x ^ 0xFF for x in bad[hit : hit + 3])
        d, want = zlib.decompressobj(31), b""
        try:
            for i in range(len(bad)):
                want += d.decompress(bad[i : i + 1])
        except zlib.error:
            pass
        got, _, whole = warc.inflate(memoryview(bytes(bad)), 0)
        assert not whole and got == want


def test_damage_in_every_member_is_read_in_linear_time():
    took = {}
    for n in (2_000, 8_000):
        data, at = bytearray(), []
        for r in (warc.member(warc.record(i, f"http://x/{i}", os.urandom(500).hex().encode(), None, DATE), 5) for i in range(n)):
            at.append(len(data) + len(r) // 2)
            data += r
        for k in at:
            data[k] ^= 0xFF
        began = time.perf_counter()
        found = list(warc.salvage(bytes(data)))
        took[n] = time.perf_counter() - began
        # a byte of a header that no digest covers may change without harm to its record
        assert len([x for x in found if x[2]]) < n / 200 and sum(x[1] for x in found) == len(data)
    assert took[8_000] < 10 * took[2_000] + 1


@pytest.mark.parametrize("compressed", [True, False])
def test_files_are_bounded_by_bytes(spark, tmp_path, compressed):
    sizes = [10, 200_000, 30, 40_000, 5, 700_000] * 5
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else f"http://x/{i}", os.urandom(n // 2).hex() if n > 5 else None) for i, n in enumerate(sizes)] + [(None, "http://x/none", "no id")], "page_id long, url string, html string").coalesce(1)
    rows = rows.cache()
    warc.write_archives(rows, str(tmp_path / "a"), compressed=compressed, file_bytes=400_000, row_bytes=50_000)
    files = [p.stat().st_size for p in (tmp_path / "a").iterdir() if p.name.startswith("part")]
    assert len(files) > 5 and max(files) <= 400_000 + 750_000
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    want = {r.page_id: r for r in rows.collect()}
    assert got.keys() == want.keys() and {r.kind for r in got.values()} == {"record"}
    for i, r in want.items():
        x = (r.html or "").encode()
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(x).digest()).decode() and got[i].payload_bytes == len(x) and got[i].url == r.url


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
