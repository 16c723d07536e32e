import base64
import hashlib
import zlib

import pytest

from cladeforge.llm import warc


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def run(spark, rows, lines=2):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, payload int")
    folder = warc.archive_folder(spark)
    index = warc.build_index(warc.write_archives(pages, folder), folder, lines)
    return pages, index


def test_round_trip_with_nulls_ties_and_repeats(spark):
    rows = [(3, "http://a.b/x", "<p>é", "d", 1), (1, None, "<p>é", None, None), (2, "http://a.b/x", None, "d", 1), (None, "u\\t\t\n", "", "d", 1), (5, "http://[bad", "q", "d", 1), (5, "http://[bad", "q", "d", 1), (6, "http://a.b/x", "z" * 300_000, "d", 1)]
    pages, index = run(spark, rows)
    got = sorted(((r.page_id, bytes(r.payload), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index.fetch(index.lookup(pages)).collect()), key=str)
    first = {b"": 2, "<p>é".encode(): 1, b"q": 5, b"z" * 300_000: 6}
    expected = []
    for page_id, _, html, _, _ in rows:
        body = (html or "").encode()
        again = page_id != first[body]
        expected.append((page_id, b"" if again else body, len(body), digest(body), "revisit" if again else "response", first[body] if again else None))
    assert got == sorted(expected, key=str)


def test_lookup_of_one_key_reads_only_its_captures(spark):
    rows = [(i, f"http://h{i % 7}.org/p", f"page {i}", None, None) for i in range(40)]
    _, index = run(spark, rows)
    asked = spark.createDataFrame([("http://h3.org/p",), ("http://none.org/",)], "url string")
    assert sorted(r.page_id for r in index.fetch(index.lookup(asked)).collect()) == [i for i in range(40) if i % 7 == 3]
    assert index.keys == sorted(index.keys) and len(index.keys) > 7


def test_small_payloads_below_the_limit_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "v", "ab"), (3, "w", "abcd"), (4, "x", "abcd")], "page_id long, url string, html string")
    folder = warc.archive_folder(spark)
    index = warc.build_index(warc.write_archives(pages, folder, min_revisit_bytes=3), folder)
    assert {r.page_id: r.refers_to for r in index.fetch(index.lookup(pages)).collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_many_revisits_are_joined_by_id(spark, monkeypatch):
    monkeypatch.setattr(warc, "MAX_REVISITS", 0)
    test_round_trip_with_nulls_ties_and_repeats(spark)


def test_many_unknown_keys_and_keys_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEAST_FETCH_BYTES", 64)
    _, index = run(spark, [(i, f"http://m.org/{i % 3}", f"page {i}", None, None) for i in range(30)])
    asked = spark.createDataFrame([(f"http://a.org/{i}",) for i in range(500)] + [("http://m.org/1",)] * 3, "url string")
    records = index.fetch(index.lookup(asked))
    assert sorted(r.page_id for r in records.collect()) == list(range(1, 30, 3)) and records.rdd.getNumPartitions() > 1
    assert warc.span(["b", "b", "c"], "b") == [0, 1] and warc.span(["b", "c"], "a") == [] and warc.span([], "a") == []


def test_empty_table(spark):
    pages, index = run(spark, [])
    assert index.fetch(index.lookup(pages)).collect() == []


def test_keys_and_damage():
    assert warc.url_key("http://www.Ex.org:8080/a?b=1") == "org,ex,www:8080)/a?b=1"
    raw = warc.record(1, "u", b"body", digest(b"body"), None, None, "2000-01-01T00:00:00Z")
    assert warc.parse(raw)["payload"] == b"body"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"body", b"bodx"))
    with pytest.raises(ValueError):
        warc.parse(raw[:-3])
    assert zlib.decompress(zlib.compress(raw)) == raw


def test_query_on_the_tables(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: r for r in warc.op1_warc_index(spark, sf_dir).collect()}
    assert set(got) == set(pages)
    for i, html in pages.items():
        body = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), digest(body))
