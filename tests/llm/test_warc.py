import base64
import hashlib

import duckdb

from newsloom.llm import queries, warc
from newsloom.session import scratch_path
from tests.llm.conftest import SF

ROWS = [(5, "http://a.com/x", "same"), (3, "http://www.b.org/y z", "same"), (9, None, None), (7, "http://a.com/x", ""),
        (None, "http://q.com", "same"), (3, "http://www.b.org/y z", "same"), (11, "ünï://x\ny", "<p>é\r\n\r\nx</p>"),
        (None, "u", "w"), (None, "u", "w"), (12, "http://[bad", "z" * 100_000)]


def pages(spark):
    return spark.createDataFrame([(i, u, h, "c", 1) for i, u, h in ROWS], "page_id long, url string, html string, digest string, first long")


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip_of_edge_pages(spark):
    path = scratch_path(spark, "warc-test")
    got = sorted(((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or -1)
                  for r in warc.archive_round_trip(pages(spark), path).collect()))
    want = []
    for i, _, h in ROWS:
        ids = [j for j, _, x in ROWS if (x or "") == (h or "") and j is not None]
        revisit = bool(ids) and i != min(ids)
        want.append((i or -1, len((h or "").encode()), b32(h), "revisit" if revisit else "response", min(ids) if revisit else -1))
    assert got == sorted(want)
    payloads = {r["page_id"]: r["payload"] for r in warc.read_records(spark, path).collect() if r["record_type"] == "response"}
    assert payloads["11"].decode() == ROWS[6][2] and len(payloads["12"]) == 100_000


def test_look_up_reads_only_wanted_records(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 600)
    path = scratch_path(spark, "warc-test")
    warc.write_collection(pages(spark), path)
    assert spark.read.parquet(f"{path}/blocks").count() >= 5
    got = warc.read_records(spark, path, ["http://www.b.org/y z", "http://a.com/x", "http://nope.com", "http://[bad"]).collect()
    assert sorted(r["page_id"] for r in got) == ["12", "3", "3", "5", "7"]


def test_small_payloads_can_stay_responses(spark):
    rows = warc.archive_round_trip(pages(spark), scratch_path(spark, "warc-test"), min_bytes=5).collect()
    assert {r["record_type"] for r in rows} == {"response"}


def test_archive_is_a_plain_gzip_file(spark):
    import gzip

    data = b"".join(r["data"] for r in warc.archives(pages(spark)).collect())
    raw = gzip.decompress(bytes(data))
    assert raw.startswith(b"WARC/1.1\r\n") and raw.count(b"WARC/1.1\r\n") == len(ROWS)


def test_no_pages(spark):
    assert warc.archive_round_trip(pages(spark).limit(0), scratch_path(spark, "warc-test")).count() == 0


def test_url_keys():
    assert warc.url_key("http://www.example.com:80/a?b") == "com,example)/a?b"
    assert warc.url_key("https://m.example.org") == "org,example,m)/"
    assert " " not in warc.url_key("http://a.b/c d")


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = con.execute(queries.OP7_SQL).fetchall()
    assert sorted(tuple(r[n] for n in names) for r in queries.op7_warc(spark, SF).collect()) == sorted(want)
