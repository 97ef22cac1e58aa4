import gzip
import hashlib
import zlib

import pyarrow as pa
import pytest

from tallyforge.llm import queries, warc

SCHEMA = "page_id long, url string, html string, `path` string, payload string"
PAGES = [
    (0, "http://x/0", "a" * 1000), (1, "http://x/1\r\nX: y", "a" * 1000), (2, None, "b" * 999), (3, "http://x/3", "b" * 999),
    (4, "u", None), (5, "u", ""), (6, "u", "é" * 500), (7, "u", "é" * 500), (8, "u", "a" * 1000), (8, "u", "a" * 1000),
    (None, None, "a" * 1000), (9, "u", "WARC/1.1\r\n\r\n" * 300_000),
]


def expected(pages):
    largest = {}
    for i, _, html in pages:
        raw = (html or "").encode()
        if len(raw) >= 1000 and i is not None:
            largest[raw] = max(i, largest.get(raw, i))
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        best = largest.get(raw)
        revisit = best is not None and best != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=str)


def archives(spark, pages=PAGES):
    rows = [(*p, "clash", "clash") for p in pages]
    return warc.write_archives(warc.classify(spark.createDataFrame(rows, SCHEMA)))


def test_query_over_awkward_pages(spark, tmp_path):
    spark.createDataFrame([(*p, "c", "c") for p in PAGES], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    rows = queries.op3_warc_normaliser(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows), key=str) == expected(PAGES)


def test_archives_are_one_member_and_normalised_ones_are_not(spark):
    written = archives(spark)
    for r in written.collect():
        inflater = zlib.decompressobj(wbits=31)
        content = inflater.decompress(open(r.path, "rb").read())
        assert inflater.eof and not inflater.unused_data and content.count(b"WARC-Record-ID") == r.records
    index = warc.normalise(written)
    rows = sorted(map(tuple, index.collect()), key=lambda r: (r[0], r[1]))
    assert len(rows) == len(PAGES)
    for path in {r[0] for r in rows}:
        raw = open(path, "rb").read()
        own = [r for r in rows if r[0] == path]
        assert [r[2] for r in own] == [sum(x[3] for x in own[:i]) for i in range(len(own))]
        assert sum(r[3] for r in own) == len(raw)
        for r in own:
            inflater = zlib.decompressobj(wbits=31)
            record = inflater.decompress(raw[r[2] : r[2] + r[3]])
            assert inflater.eof and not inflater.unused_data and record.startswith(b"WARC/1.1\r\n")
            head = record.split(b"\r\n\r\n")[0].decode().split("\r\n")[1:]
            assert all(": " in line for line in head) and not any(line.startswith("X: ") for line in head)
        with pa.ipc.open_file(f"{path}.idx") as sidecar:
            assert sidecar.read_all().column("offset").to_pylist() == [r[2] for r in own]


def test_small_pieces_and_many_members(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 7)
    record = b"WARC/1.0\r\nWARC-Type: x\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    path = tmp_path / "a.gz"
    path.write_bytes(gzip.compress(record * 2) + gzip.compress(record))
    with open(path, "rb") as file:
        assert [b for _, _, b in warc.records_of(warc.Inflated(file, "a"))] == [b"ab\r\nc"] * 3
    path.write_bytes(gzip.compress(record)[:-12])
    with open(path, "rb") as file, pytest.raises(ValueError, match="ends within"):
        list(warc.records_of(warc.Inflated(file, "a")))


def test_no_pages(spark):
    written = archives(spark, [])
    assert written.count() == 0
    assert warc.read_records(warc.normalise(written)).count() == 0


def test_query_is_brute_force(spark, small):
    pages = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, queries.op3_warc_normaliser(spark, small).collect()), key=str) == expected(pages)
