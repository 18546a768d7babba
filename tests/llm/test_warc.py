"""WARC round trips, pushed filters, split archives and duplicate payloads against plain Python."""
import glob
import os

from pyspark.sql import functions as F

from qualitas.llm import queries, warc
from qualitas.session import work_folder


def expected(rows, min_bytes=0):
    first = {}
    for page, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    out = []
    for page, html in rows:
        raw = (html or "").encode()
        f = first.get(html or "")
        revisit = len(raw) >= min_bytes and f is not None and f != page
        out.append((page, len(raw), warc.base32_sha1(raw), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=repr)


def test_op4_on_pages(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op4_warc(spark, sf).collect()), key=repr) == expected(rows)


def test_odd_pages_filters_and_splits(spark):
    warc.register(spark)
    rows = ([(9, "same"), (4, "same"), (4, "same"), (7, None), (8, ""), (None, "same"), (None, "alone"),
             (1, "a\r\n\r\nb"), (2, "é" * 70_000), (3, "HTTP/1.1 200 OK\r\n\r\nx"), (5, "WARC/1.1\r\n\r\n")]
            + [(100 + i, f"page {i % 40} " * 50) for i in range(400)])
    pages = spark.createDataFrame([(*r, "http://x/\r\nWARC-Type: evil%41é", "n", 1) for r in rows],
                                  "page_id long, html string, url string, record_type string, sha1 int")
    for min_bytes in (0, 5):
        folder = work_folder(spark, "warc")
        warc.deduplicated(pages, min_bytes).repartition(3).write.format("warc").mode("append").save(folder)
        for split in (1 << 10, 1 << 26):
            read = spark.read.format("warc").option("splitBytes", split).load(folder)
            got = read.select(warc.page_of(F.col("record_id")), "payload_bytes", "payload_digest", "record_type",
                              warc.page_of(F.col("refers_to")))
            assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows, min_bytes)
    html = {(p, (h or "")) for p, h in rows}
    for r in read.where("record_type = 'response'").collect():
        page = r.record_id.removeprefix("urn:page:")
        assert (int(page) if page else None, r.payload.decode()) in html
        assert r.target_uri == "http://x/\r\nWARC-Type: evil%41é" and r.payload_digest == warc.base32_sha1(r.payload)
    n = sum(r[3] == "revisit" for r in expected(rows, 5))
    assert read.where("record_type = 'revisit'").count() == n
    assert read.where("payload_bytes > 100000 and record_id like 'urn:page:%'").count() == 1
    assert {r.payload for r in spark.read.format("warc").option("payload", "false").load(folder).collect()} == {None}


def test_unwanted_payloads_are_not_inflated(spark, tmp_path, monkeypatch):
    rows = [{"record_id": f"urn:page:{i}", "record_type": "response", "target_uri": None, "refers_to": None,
             "payload_digest": "x", "payload_bytes": 1 << 20, "payload": os.urandom(1 << 20)} for i in range(5)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(map(warc.member, rows)))
    whole = []
    monkeypatch.setattr(warc._Member, "whole", lambda self, f=warc._Member.whole: whole.append(1) or f(self))
    got = list(warc.members(str(path), 0, path.stat().st_size, lambda r: r["record_id"] == "urn:page:3", True))
    assert len(got) == len(whole) == 1 and got[0]["payload"] == rows[3]["payload"]


def test_pushdown_reaches_the_reader():
    reader = warc.WarcReader({"path": "/nowhere"})
    kept = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload",), b"")]))
    assert [f.attribute for f in kept] == [("payload",)] and len(reader.filters) == 1


def test_empty_and_aborted(spark):
    warc.register(spark)
    folder = work_folder(spark, "warc")
    pages = spark.createDataFrame([], "page_id long, html string, url string")
    warc.deduplicated(pages).write.format("warc").mode("append").save(folder)
    assert spark.read.format("warc").load(folder).count() == 0
    assert not glob.glob(f"{warc.local_path(folder)}/*.warc.gz")
