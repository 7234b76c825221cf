import base64
import gzip
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from lorespark.llm import bpe, warc

from .cases import SCHEMA, documents


@pytest.mark.parametrize("leaf", [2, 7, 64])
def test_tree_encodes_as_the_library_does(leaf):
    codec = bpe.Codec(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN, leaf)
    rng = random.Random(leaf)
    texts = [r[1] or "" for r in documents(2, 20) if len(r[1] or "") < 5000]
    texts += ["".join(rng.choice(["a", " ", "  ", "\n", "1", "é", "'s", "'", "'ll", "!", "漢", " " * 30, "\n" * 9, "😀"]) for _ in range(150)) for _ in range(150)]
    for text in texts:
        ids = codec.encode(text)
        assert ids.tolist() == codec.whole.encode_ordinary(text)
        assert codec.decode(ids).decode() == text


def test_ids_and_texts_round_trip(spark):
    df = spark.createDataFrame(documents(), SCHEMA)
    whole = bpe.codec(bpe.VOCABULARY).whole
    for r in bpe.with_text(bpe.with_ids(df)).collect():
        assert r["decoded"].decode() == (r["text"] or "")
        if len(r["text"] or "") < 10_000:
            assert np.frombuffer(r["token_ids"], "<u4").tolist() == whole.encode_ordinary(r["text"] or "")
    assert bpe.with_text(bpe.with_ids(df.limit(0))).count() == 0


PAGES = [
    (1, "http://b.example.com/x", "<p>one</p>"),
    (2, "https://A.example.com/y?q=1#frag", "<p>one</p>"),
    (3, "http://b.example.com/x", None),
    (4, None, ""),
    (5, "http://b.example.com/x", "a WARC/1.1\r\nWARC-Type: response\r\n\r\nWARC/1.1\r\n\r\n\r\n"),
    (6, "http://b.example.com:80/x", "WARC/1\r\nab\r\n.1\r\n é漢 WARC/1.1\r\n"),
    (7, "http://b.example.com", "x" * 300_000),
    (7, "http://b.example.com", "x" * 300_000),
    (None, "http://b.example.com/x", "<p>one</p>"),
]


def test_archives_round_trip_and_merge(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages")
    pages = spark.read.parquet(f"{tmp_path}/pages")
    path = f"file://{tmp_path}/warc"
    warc.write_archives(warc.with_record_types(pages), path)
    read = warc.read_archives(spark, path).collect()
    assert len(read) == len(PAGES)
    by_payload = {}
    for i, _, html in PAGES:
        by_payload.setdefault(html or "", []).append(i)
    for r in read:
        group = next(p for p, ids in by_payload.items() if base64.b32encode(hashlib.sha1(p.encode()).digest()).decode() == r["payload_digest"])
        assert r["payload_bytes"] == len(group.encode())
        last = max(i for i in by_payload[group] if i is not None)
        if r["record_type"] == "response":
            assert r["payload"] == group and r["page_id"] == last and r["refers_to"] is None
        else:
            assert r["refers_to"] == last
    for ids in by_payload.values():
        assert sum(r["record_type"] == "response" for r in read if r["page_id"] in ids) >= 1
    merged = warc.merged_histories(warc.index_runs(warc.read_archives(spark, path)), ways=2)
    history = [(r["timestamp"], r["capture"]) for r in merged.collect() if r["url_key"] == "com,example,b)/x"]
    assert [c for _, c in sorted(history)] == list(range(1, len(history) + 1))
    one = [r["url_key"] for r in merged.filter("page_id = 2").collect()]
    assert one == ["com,example,a)/y?q=1"]


def test_pages_that_end_in_the_version(spark, tmp_path):
    urls = [f"http://a.example.com/WARC/1{end}" for end in (".1", "%2E1", "%252E1", ".1#", "")]
    htmls = ["<p>see WARC/1.1", "WARC/1.1", "é WARC/1.1\r\nWARC/1.1", "WARC/1.1WARC/1.1", "WARC/1.1\r", "WARC/1.1\n", "WARC/1", ".1\r\nWARC/1.1\r\n.1", "plain"]
    rows = [(i, urls[i % len(urls)], html) for i, html in enumerate(htmls)] + [(20 + i, url, f"page {i}") for i, url in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages")
    warc.write_archives(warc.with_record_types(spark.read.parquet(f"{tmp_path}/pages")), f"file://{tmp_path}/warc")
    read = warc.read_archives(spark, f"file://{tmp_path}/warc").collect()
    assert sorted((r["page_id"], r["url"], r["payload"]) for r in read) == sorted(rows)
    for r in read:
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(r["payload"].encode()).digest()).decode()


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(warc.with_record_types(pages), f"file://{tmp_path}/none")
    assert warc.merged_histories(warc.index_runs(warc.read_archives(spark, f"file://{tmp_path}/none"))).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 8])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
    assert list(warc.LoserTree(map(iter, runs))) == sorted(x for r in runs for x in r)


def test_record_ids_are_unique_and_urls_may_be_missing(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages")
    path = f"file://{tmp_path}/warc"
    warc.write_archives(warc.with_record_types(spark.read.parquet(f"{tmp_path}/pages")), path)
    records = warc.read_foreign_archives(spark, path).collect()
    ids = [r["record_id"] for r in records]
    assert len(set(ids)) == len(ids) == len(PAGES)
    assert {r["refers_to"] for r in records if r["record_type"] == "revisit"} <= {r["record_id"] for r in records if r["record_type"] == "response"}
    assert {r["url"] for r in warc.read_archives(spark, path).filter("page_id = 4").collect()} == {None}
    own = {(r["payload_digest"], r["record_type"]) for r in warc.read_archives(spark, path).collect()}
    assert {(r["payload_digest"], r["record_type"]) for r in records} == own


def foreign(version, kind, uri, block, **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uri}>", "WARC-Date": "2020-01-01T00:00:00Z", "WARC-Target-URI": uri, "Content-Length": str(len(block)), **more}
    return f"{version}\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_archives_of_others_are_read_by_length(spark, tmp_path):
    binary = bytes(range(256)) + b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc"
    records = [
        foreign("WARC/1.0", "warcinfo", "info", b"software: other\r\n"),
        foreign("WARC/1.0", "response", "http://a/1", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + binary),
        foreign("WARC/1.0", "response", "http://a/2", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2;x=y\r\nde\r\n0\r\n\r\n"),
        foreign("WARC/1.1", "resource", "http://a/3", binary),
        foreign("WARC/1.1", "revisit", "http://a/4", b"HTTP/1.1 200 OK\r\n\r\n", **{"WARC-Payload-Digest": "sha1:ABC", "WARC-Refers-To": "<urn:uuid:http://a/1>"}),
    ]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "packed.warc.gz").write_bytes(b"".join(map(gzip.compress, records)) + gzip.compress(records[3])[:-9])
    found = warc.read_foreign_archives(spark, f"file://{tmp_path}").collect()
    want = {"http://a/1": binary, "http://a/2": b"abcde", "http://a/3": binary, "http://a/4": None}
    for archive in ("plain.warc", "packed.warc.gz"):
        own = [r for r in found if r["archive"].endswith(archive)]
        assert {r["url"]: None if r["payload"] is None else bytes(r["payload"]) for r in own} == want and len(own) <= 5
        assert [r["payload_digest"] for r in own if r["record_type"] == "revisit"] == ["ABC"]


def test_histories_are_in_one_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"http://{rng.choice('abc')}.example.com/{rng.randrange(5)}", f"p{i}") for i in range(400)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5).write.parquet(f"{tmp_path}/pages")
    warc.write_archives(warc.with_record_types(spark.read.parquet(f"{tmp_path}/pages")), f"file://{tmp_path}/warc")
    merged = warc.merged_histories(warc.index_runs(warc.read_archives(spark, f"file://{tmp_path}/warc")), ways=2).collect()
    by_range = sorted({r["range"] for r in merged})
    for n in by_range:
        own = [(r["url_key"], r["timestamp"]) for r in merged if r["range"] == n]
        assert own == sorted(own)
    ends = [(min(k), max(k)) for k in ([(r["url_key"], r["timestamp"]) for r in merged if r["range"] == n] for n in by_range)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    counts = {}
    for r in sorted(merged, key=lambda r: (r["url_key"], r["timestamp"])):
        counts[r["url_key"]] = counts.get(r["url_key"], 0) + 1
        assert r["capture"] == counts[r["url_key"]]
