import hashlib
from pathlib import Path

import pytest

from genolith.llm import warc
from genolith.llm.common import Scratch

LONG = "x" * 60 + "é" * 20
ODD = [
    (5, "http://a/1", LONG), (3, "http://a/2", LONG), (9, "http://a/3", LONG), (3, "http://a/4", LONG), (3, "http://a/4", LONG), (None, "http://a/5", LONG),
    (10, "http://b", "y" * 99), (11, "http://b", "y" * 99), (12, None, "z" * 100), (13, "", "z" * 100), (14, "http://c", None), (15, "http://c", ""),
    (16, "http://d/\r\nWARC-Type: revisit\r\n\r\n x: y", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3),
    (17, "http://é.example/ü", "a\x00b\n" * 40), (-4, "http://e", "long " * 300_000), (None, "http://f", "n" * 120), (None, "http://g", "n" * 120), (None, "http://g", "n" * 120),
]


def frame(spark, rows):
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, first int").repartition(3)
    return df.withColumn("payload", df.html.cast("binary"))


def written(spark, rows, scratch, name="a"):
    folder = f"{scratch.root}/{name}"
    warc.write_archive(warc.resolve(frame(spark, rows), scratch), folder)
    return folder


def brute(rows):
    out, by = [], {}
    for page, _, html in rows:
        raw = (html or "").encode()
        by.setdefault(raw, []).append(page)
    for raw, pages in by.items():
        digest = hashlib.sha256(raw).hexdigest()
        order = sorted(pages, key=lambda p: (p is None, p or 0))
        for i, page in enumerate(order):
            again = len(raw) >= 100 and i > 0
            out.append((page, len(raw), digest, "revisit" if again else "response", order[0] if again else None))
    return sorted(out, key=str)


def test_read_back(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")  # splits begin inside records
    try:
        scratch = Scratch(spark, "t")
        got = warc.read_payloads(spark, written(spark, ODD, scratch), scratch)
        assert sorted(map(tuple, got.collect()), key=str) == brute(ODD)
        pages = warc.read_archive(spark, f"{scratch.root}/a").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r.record_id for r in pages}) == len(ODD)
    assert {r.refers_to_id for r in pages if r.record_type == "revisit"} <= {r.record_id for r in pages if r.record_type == "response"}
    assert sorted(bytes(r.payload) for r in pages if r.record_type == "response") == sorted((h or "").encode() for _, _, h in _kept(ODD))
    urls = {r.page_id: r.url for r in pages}
    assert urls[17] == "http://é.example/ü" and urls[12] is None and urls[13] is None and "\r" not in urls[16] and urls[16].startswith("http://d/%0D%0A")


def _kept(rows):
    seen = set()
    for r in rows:
        if len((r[2] or "").encode()) < 100 or r[2] not in seen:
            seen.add(r[2])
            yield r


def test_files_are_warc(spark):
    """A reader that goes by Content-Length only finds the same records."""
    scratch = Scratch(spark, "t")
    folder = Path(written(spark, ODD, scratch).removeprefix("file://"))
    types = []
    for path in folder.glob("part-*"):
        data, at = path.read_bytes(), 0
        while at < len(data):
            head, _, _ = data[at:].partition(b"\r\n\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n") and {b"WARC-Record-ID", b"WARC-Date", b"WARC-Type", b"Content-Length"} <= set(fields)
            types.append((at, fields[b"WARC-Type"]))
            at += len(head) + 4 + int(fields[b"Content-Length"])
            assert data[at : at + 4] == b"\r\n\r\n"
            at += 4
    assert sum(t != b"warcinfo" for _, t in types) == len(ODD)
    assert all((at == 0) == (t == b"warcinfo") for at, t in types)


def test_archives_are_merged(spark):
    scratch = Scratch(spark, "t")
    a, b = ODD[:9], [(1, "http://a/0", LONG), *ODD[9:]]
    folders = [written(spark, a, scratch, "a"), written(spark, b, scratch, "b")]
    warc.merge_archives(spark, folders, f"{scratch.root}/c", scratch)
    got = warc.read_payloads(spark, f"{scratch.root}/c", scratch)
    assert sorted(map(tuple, got.collect()), key=str) == brute(a + b)
    # an archive of revisits alone
    lone = warc.resolve(frame(spark, a), scratch).where("record_type = 'revisit'")
    warc.write_archive(lone, f"{scratch.root}/d")
    with pytest.raises(Exception, match="in none of the archives"):
        warc.merge_archives(spark, [f"{scratch.root}/d"], f"{scratch.root}/e", scratch)
    missing = warc.read_payloads(spark, f"{scratch.root}/d", scratch).collect()
    assert len(missing) == lone.count() and all(r.payload_bytes is None and r.refers_to is None for r in missing)


def test_no_rows_and_damage(spark):
    scratch = Scratch(spark, "t")
    assert warc.read_payloads(spark, written(spark, [], scratch), scratch).count() == 0
    folder = written(spark, ODD[:3], scratch, "b")
    path = next(p for p in Path(folder.removeprefix("file://")).glob("part-*") if "xé".encode() in p.read_bytes())
    path.write_bytes(path.read_bytes().replace("xé".encode(), b"x", 1))
    for crc in path.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="not as long as its header says"):
        warc.read_payloads(spark, folder, scratch).collect()
