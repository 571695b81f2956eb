import base64
import hashlib

import pytest

from quillmark.llm.shared import scratch
from quillmark.llm.warc import archived_pages, original_records, parse, read_archive, write_archive

SCHEMA = "page_id long, url string, html string, sha256 string, header string"
PAGES = [
    (1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>two\r\n\r\nWARC/1.1</p>"), (3, None, "<p>one</p>"), (4, "x\r\ny", None),
    (5, "http://e/", ""), (6, "http://f/", "é€😀" * 50000), (7, "http://g/", "<p>one</p>"), (8, "http://h/", "\r\n\r\n"), (9, "", "a\x00b"),
]


def rows(extra=()):
    return [(*p, "clash", "clash") for p in [*PAGES, *extra]]


def test_query_matches_brute_force(spark):
    got = {r["id"]: tuple(r)[1:] for r in archived_pages(spark.createDataFrame(rows(), SCHEMA)).collect()}
    last = {}
    for i, _, h in PAGES:
        last[h or ""] = max(i, last.get(h or "", 0))
    want = {}
    for i, _, h in PAGES:
        raw, top = (h or "").encode(), last[h or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want[i] = (len(raw), digest, "response" if i == top else "revisit", None if i == top else top)
    assert got == want


def test_round_trip_and_single_storage(spark):
    path = scratch(spark, "test-warc")
    write_archive(spark.createDataFrame(rows([(8, "http://h/", "\r\n\r\n"), (None, "n", "<p>one</p>"), (None, "m", "alone")]), SCHEMA), path)
    back = original_records(spark, path).collect()
    want = sorted([(i or -1, h or "") for i, _, h in PAGES] + [(8, "\r\n\r\n"), (-1, "<p>one</p>"), (-1, "alone")])
    assert sorted((r["id"] or -1, r["payload"]) for r in back) == want
    stored = [r["sha256"] for r in read_archive(spark, path).where("record_type = 'response'").collect()]
    assert len(stored) == len(set(stored)) == len({h for _, h in want})


def test_empty_table_and_damage(spark):
    assert archived_pages(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises((ValueError, Exception)):
        list(parse(b"\x1f\x8b\x08damaged"))
