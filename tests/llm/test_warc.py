import hashlib
import io
import random

import pytest
import zstandard

from emberline.llm.warc import ArchiveWriter, WarcError, parse, read_archives, read_records, record, write_archives

SCHEMA = "page_id long, url string, html string, payload string, digest string"


def expected(rows):
    by = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            by[h] = max(by.get(h, i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        lead = by.get(h) if len(raw) >= 1000 else None
        refers = lead if lead is not None and lead != i else None
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return out


def test_round_trip(spark):
    rng = random.Random(4)
    big = ["x" * 1000, "é" * 500, "y" * 999, "<p>" + "word " * 40000, "\r\n\r\nWARC/1.1\r\n" * 100]
    rows = [(i, rng.choice(["http://a.example/ü", None, "bad\r\nX: y"]), rng.choice([*big, None, "", f"page {i} " * 200])) for i in range(200)]
    rows += [(3, "u", big[0]), (3, "u", big[0]), (None, "u", big[1]), (-5, "u", big[2])]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(5)
    manifest = write_archives(pages, records_per_archive=17)
    out = read_archives(manifest, payloads=True).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)
    html = {}
    for i, _, h in rows:
        html.setdefault(i, set()).add((h or "").encode())
    assert all((r.payload is None) == (r.record_type == "revisit") and (r.payload is None or bytes(r.payload) in html[r.page_id]) for r in out)
    assert {r.url for r in out} == {"http://a.example/ü", None, "bad%0D%0AX: y", "u"}


def test_empty_table(spark):
    assert read_archives(write_archives(spark.createDataFrame([], SCHEMA))).count() == 0


def test_a_reader_refuses_damage():
    out = io.BytesIO()
    writer = ArchiveWriter(out, b"some dictionary of plain content")
    writer.add(record(1, "u", b"payload one", None, "2024-01-01T00:00:00Z"))
    writer.add(record(2, "u", b"payload two", 1, "2024-01-01T00:00:00Z"))
    raw = out.getvalue()
    assert [parse(r)["page_id"] for r in read_records(io.BytesIO(raw))] == [1, 2]
    for broken in (b"", raw[:6], raw[:-5], b"\0" * 8 + raw[8:], raw[:-40] + b"\xff" * 40):
        with pytest.raises((WarcError, zstandard.ZstdError)):
            [parse(r) for r in read_records(io.BytesIO(broken))]
    good = record(1, "u", b"payload", None, "2024-01-01T00:00:00Z")
    for wrong in (good.replace(b"payload\r", b"payloae\r"), good + b"x", good.replace(b"WARC/1.1", b"WARD/1.1"), good.replace(b"WARC-Date: ", b"WARC-Day: "), good.replace(b"Length: 7", b"Length: 8")):
        with pytest.raises(WarcError):
            parse(wrong)
