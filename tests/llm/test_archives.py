import base64
import gzip
import hashlib
import io
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

from verdictlab.llm import archives

PAGES = [
    (5, "http://a.example/x y", "<p>same</p>"),
    (3, "http://b.example/é", "<p>same</p>"),
    (9, None, None),
    (7, "", ""),
    (1, "http://c.example", "two\r\n\r\nWARC/1.1\r\n\r\nlines\n\n" * 3),
    (2, "http://d.example", "漢字 " * 50_000),
    (3, "http://b.example/again", "<p>same</p>"),
    (None, "http://n.example", "no id"),
    (11, "http://n.example", "no id"),
]
SCHEMA = "page_id long, url string, html string"


def test_records_equal_brute_force(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], SCHEMA + ", digest string").repartition(4)
    rows = archives.archived(pages, f"file://{tmp_path}/w").collect()
    want = defaultdict(list)
    for page, _, html in PAGES:
        want[html or ""].append(page)
    got = defaultdict(list)
    for r in rows:
        got[(r["payload_digest"], r["payload_bytes"])].append(r)
    assert len(rows) == len(PAGES)
    for html, ids in want.items():
        raw = html.encode()
        group = got[(base64.b32encode(hashlib.sha1(raw).digest()).decode(), len(raw))]
        assert Counter(r["page_id"] for r in group) == Counter(ids)
        first = min(i for i in ids if i is not None)
        kinds = Counter(r["record_type"] for r in group)
        assert kinds["response"] == 1 and next(r for r in group if r["record_type"] == "response")["page_id"] == first
        assert all(r["refers_to"] == (None if r["record_type"] == "response" else first) for r in group)
    assert len({r["record_id"] for r in rows}) == len(rows)
    files = list(Path(tmp_path, "w", "warc").glob("*.gz"))
    text = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert text.count(b"WARC/1.1\r\nWARC-Type: re") == len(PAGES)
    assert archives.archived(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_records_a_file(spark, monkeypatch):
    pages = spark.range(4500).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "concat('p', id % 3000) AS html").coalesce(1)
    rows = archives.archived(pages)
    assert rows.count() == 4500 and rows.filter("record_type = 'revisit'").count() == 1500


def test_query_equals_sql(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = archives.archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    want = duckdb.sql(archives.SQL.replace("FROM pages", f"FROM '{sf_dir}/pages.parquet'")).fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted((tuple(r) for r in want), key=repr)


@pytest.mark.parametrize("version", [1, 2])
def test_versions(version):
    blocks = [b"", b"plain\n\nbytes", archives.http_block(b"<p>", {"A": "b"})]
    data = archives.arc_version_block(version, "x.arc") + b"".join(archives.arc_record(version, f"http://h/{i} z", "1.2.3.4", "20010203", "text/html", b) + b"\n" for i, b in enumerate(blocks))
    got = list(archives.read_arc(io.BytesIO(data)))
    assert [b for _, b in got] == blocks and got[1][0]["URL"] == "http://h/1%20z"
    assert ("Checksum" in got[0][0]) == (version == 2)


def test_broken_archives():
    good = archives.arc_version_block(1, "x.arc")
    for bad in (b"http://x 1 2 3 4\n", good + b"http://x 0.0.0.0 2001 text/html\n", good + b"http://x 0.0.0.0 2001 text/html 99\nshort", good.replace(b"1 0 ", b"7 0 ")):
        with pytest.raises(ValueError):
            list(archives.read_arc(io.BytesIO(bad)))
    assert list(archives.read_arc(io.BytesIO(b""))) == []


def test_dates():
    assert archives.warc_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert archives.warc_date("2001") == "2001-01-01T00:00:00Z"
    assert archives.warc_date("none") == "1970-01-01T00:00:00Z"


def test_files_end_by_bytes_and_records(monkeypatch):
    monkeypatch.setattr(archives, "FILE_BYTES", 100)
    monkeypatch.setattr(archives, "FILE_RECORDS", 4)
    roll, sizes = archives._Roll(b"\n"), []
    for n in (40, 40, 40, 500, 1, 1, 1, 1, 1):
        if roll.full(n):
            sizes.append(len(roll.close().column(0)[0].as_py()))
        roll.add(b"x" * n)
    sizes.append(len(roll.close().column(0)[0].as_py()))
    # two of 40 bytes, one, the long one alone, four short ones, the last
    assert sizes == [81, 40, 500, 7, 1]


def test_payloads_that_very_many_pages_share(spark):
    pages = spark.range(3000).selectExpr("id + 10 AS page_id", "'http://h' AS url", "IF(id % 3 = 0, 'same', concat('p', id)) AS html").repartition(3)
    rows = archives.archived(pages)
    same = rows.filter("payload_bytes = 4 AND (record_type = 'revisit' OR page_id = 10)")
    assert same.filter("record_type = 'revisit' AND refers_to = 10").count() == 999 and rows.filter("record_type = 'response'").count() == 2001
