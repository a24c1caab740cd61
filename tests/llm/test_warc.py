import hashlib
import base64

import pytest
from tessera.llm.warc import END, MAGIC, op8_warc, plan_records, read_archives, write_archives
from tessera.sources.shared import fresh_path


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def round_trip(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = fresh_path(spark, "warc-test")
    write_archives(plan_records(pages).coalesce(2), path)
    return {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_archives(spark, path).collect()}


def test_magic_inside_payloads_and_copies(spark):
    fake = f"{MAGIC}WARC-Type: response{END[:2]}Content-Length: 5{END}hello{END}"
    texts = ["", None, "a", f"x{fake}y", fake * 3, "ü" * 50, f"{MAGIC}", "a", f"x{fake}y", "tail\r\n\r\n", "Content-Length: 7\r\n\r\n"]
    rows = [(i, f"http://x/{i}", t) for i, t in enumerate(texts)]
    top = {}
    for i, t in enumerate(texts):
        top[t or ""] = i
    want = set()
    for i, t in enumerate(texts):
        last = top[t or ""]
        want.add((i, len((t or "").encode()), digest(t), "response" if last == i else "revisit", None if last == i else last))
    assert round_trip(spark, rows) == want


def test_null_ids_and_repeated_rows(spark):
    got = round_trip(spark, [(None, None, "p"), (3, "u", "p"), (3, "u", "p"), (None, "u", "q")])
    assert got == {(None, 1, digest("p"), "revisit", 3), (3, 1, digest("p"), "response", None), (None, 1, digest("q"), "response", None)}


def test_empty(spark):
    assert round_trip(spark, []) == set()


@pytest.mark.parametrize("size", ["300", "700"])
def test_small_splits(spark, size):
    """Records, and false ones in payloads, that lie across many splits."""
    fake = f"{MAGIC}WARC-Type: response{END[:2]}Content-Length: 5{END}hello{END}"
    texts = [("word " * (k % 90)) + (fake * (k % 4)) + "end" * (k % 7) for k in range(60)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = round_trip(spark, [(k, f"u{k}", t) for k, t in enumerate(texts)])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    last = {t: k for k, t in enumerate(texts)}
    assert got == {(k, len(t.encode()), digest(t), "response" if last[t] == k else "revisit", None if last[t] == k else last[t]) for k, t in enumerate(texts)}


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "u", "p", 5), (2, None, "p", 6), (3, "u", None, None)], "page_id long, url string, html string, extra long").write.parquet(f"{tmp_path}/pages.parquet")
    got = op8_warc(spark, str(tmp_path))
    assert [c for c in got.dtypes if c[0] != "digest_holds"] == [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")]
    assert {(r.page_id, r.record_type, r.refers_to) for r in got.collect()} == {(1, "revisit", 2), (2, "response", None), (3, "response", None)}
