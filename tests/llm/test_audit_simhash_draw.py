"""Divergence audit, SimHash and resampling against brute force, on small documents with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorespark.llm import divergence, resampling
from lorespark.llm.common import placed
from lorespark.llm.divergence import Audit, galloped, shares, source_divergence
from lorespark.llm.resampling import Draw, kth_key, resampled
from lorespark.llm.simhash import Near, fingerprint, fingerprint_links, simhash_components
from lorespark.llm.words import pieces

from .cases import SCHEMA, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bits_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_fingerprints_of_long_texts(monkeypatch):
    texts = [r[1] for r in documents()] + ["word", "two words", " tab\tand\x0bmore \n", "ÄB ä漢字 é", "\x1c\x1d a b\x85c d e"]
    assert [fingerprint(t) for t in texts] == [bits_of(t) for t in texts]
    monkeypatch.setattr("lorespark.llm.words.STEP", 10)
    assert [fingerprint(t) for t in texts[:60]] == [bits_of(t) for t in texts[:60]]


def test_simhash_components(spark):
    rows = documents()
    got = simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()
    prints = {(r[0], r[1]): bits_of(r[1]) for r in rows}
    root = components(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    least, size = {}, Counter(root[prints[r[0], r[1]]] for r in rows)
    for (doc, _), p in prints.items():
        if doc is not None:
            least[root[p]] = min(least.get(root[p], doc), doc)
    copies = Counter(prints[r[0], r[1]] for r in rows)
    expected = [(r[0], f"{prints[r[0], r[1]]:016x}", least.get(root[prints[r[0], r[1]]]), copies[prints[r[0], r[1]]], size[root[prints[r[0], r[1]]]]) for r in rows]
    assert Counter(map(tuple, got)) == Counter(expected)
    assert not simhash_components(spark.createDataFrame([], SCHEMA)).collect()


def test_links_of_frequent_blocks(spark):
    """One group of fingerprints that agree in most bits: more than the short lists hold, in every choice of blocks."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = {0, 1 << 63, 3}
    while len(prints) < 300:
        p = base
        for _ in range(rng.choice([1, 2, 3, 4])):
            p ^= 1 << rng.choice([*range(14), 40, 41, 62, 63])
        prints.add(p)
    signed = [(p - (1 << 64) if p >> 63 else p) for p in prints]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    for short in (1, 8, 1000):
        got = fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"), Near(short=short)).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_finer_choices_leave_few_bits_open():
    masks = [m for _, finer in Near().choices() for m in finer]
    assert len(masks) == 150 and max(64 - m.bit_count() for m in masks) <= 10


@given(st.sets(st.integers(0, 300)), st.sets(st.integers(0, 3000)), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_galloped_meets_where_sets_meet(small, large, stride):
    a, b = np.array(sorted(small), np.int64), np.array(sorted(large), np.int64)
    for x, y in ((a, b), (b, a)):
        i, j = galloped(x, y, stride)
        assert x[i].tolist() == y[j].tolist() == sorted(small & large)


@given(st.lists(st.integers(0, 10**14), min_size=1, max_size=9), st.integers(1, 10**6))
@settings(max_examples=100, deadline=None)
def test_shares_are_exact(counts, terms):
    total = sum(counts)
    want = [1 + 10**9 * (n + 5) // (total + 5 * terms) for n in counts]
    assert shares(np.array(counts, np.int64), total, terms, Audit()).tolist() == want


def divergence_of(rows, least_docs, top):
    groups, found, docs = set(), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups.add((lang, source))
        found[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(found[g])

        def share(counts, term):
            return 1 + 10**9 * (counts[term] + 5) // (sum(counts[t] for t in kept) + 5 * len(kept))

        for g in [g for g in groups if g[0] == lang]:
            pairs = [(-sum(abs(share(found[g], t) - share(found[o], t)) for t in kept), o[1].encode()) for o in groups if o[0] == lang and o != g]
            terms = [(share(whole, t) - share(found[g], t), t.encode()) for t in kept if found[g][t] > 0 and share(found[g], t) > share(whole, t)]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(*g, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(sorted(items)[:most])]
    return Counter(out)


def test_source_divergence(spark, monkeypatch):
    rows = documents(2, 120) + [(500 + i, "only here Only" if i % 2 else None, "xx", f"s{i % 5}", 0, 0, 0, "") for i in range(9)]
    rows.append((600, "1 2 3", "zz", "lone", 0, 0, 0, ""))
    monkeypatch.setattr(divergence, "BLOCK", 4)
    for least, top in ((3, 4), (30, 50), (10**6, 50)):
        got = source_divergence(spark.createDataFrame(rows, SCHEMA), Audit(least_docs=least, top=top)).collect()
        assert Counter(map(tuple, got)) == divergence_of(rows, least, top)
    assert not source_divergence(spark.createDataFrame([], SCHEMA)).collect()


def resampled_rows(rows, target, how):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % how.buckets for n in range(1, how.order + 1) for i in range(len(words) - n + 1)]

    s, t = Counter(), Counter()
    for side, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            side.update(features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    scored = []
    for i, r in enumerate(rows):
        words, buckets = features(r[1])
        gains = [math.floor(1000 * math.log((t[b] + 1) * (all_s + how.buckets) / ((s[b] + 1) * (all_t + how.buckets)))) for b in buckets]
        weight = math.floor(Fraction(sum(gains), len(gains))) if gains else 0
        h = int(hashlib.sha256(f"{how.seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        scored.append((r[0], len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words, i))
    fit = sorted((x for x in scored if x[4] >= how.least_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[5]))
    rank = {x[5]: i + 1 for i, x in enumerate(fit[: how.percent * len(fit) // 100])}
    return Counter((*x[:4], rank.get(x[5])) for x in scored)


def test_resampled(spark, monkeypatch):
    rows, target = documents(4, 150), ["the general public license", None, "MIT license of alpha", "word word"]
    docs, texts = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(t,) for t in target], "text string")
    for how in (Draw(), Draw(percent=60, least_words=3, buckets=97, order=3, seed=1), Draw(percent=100), Draw(percent=0)):
        assert Counter(map(tuple, resampled(docs, texts, how).collect())) == resampled_rows(rows, target, how)
    assert Counter(map(tuple, resampled(docs, texts.limit(0)).collect())) == resampled_rows(rows, [], Draw())
    assert not resampled(docs.limit(0), texts).collect()
    monkeypatch.setattr("lorespark.llm.words.STEP", 9)
    for text in [r[1] for r in rows[:40]]:
        whole = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        found = list(resampling.feature_buckets(text, Draw(order=3)))
        want = Counter(zlib.crc32(" ".join(whole[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(whole) - n + 1))
        assert sum(k for k, _ in found) == len(whole) and Counter(x for _, b in found for x in b.tolist()) == want


def test_quickselect_and_places_with_ties(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0, 1, 1, 1, 2, 50]), rng.choice([None, 3, 3, 7])) for _ in range(700)] + [(1, 3)] * 200
    df = spark.createDataFrame(rows, "a long, b long").repartition(5).withColumn("key", F.struct("a", F.col("b").isNull().alias("unknown"), "b"))
    order = sorted((a, b is None, b or 0) for a, b in rows)
    for k in (1, 2, 350, 899, 900):
        key = kth_key(df, "key", k)
        assert (key["a"], key["unknown"], key["b"] or 0) == order[k - 1]
    distinct = spark.range(5000).withColumn("key", F.struct(F.xxhash64("id").alias("h"), "id"))
    want = sorted((r["key"]["h"], r["key"]["id"]) for r in distinct.collect())
    assert tuple(kth_key(distinct, "key", 1234)) == want[1233]
    got = placed(distinct.select("id", "key"), [F.col("key")], "place", 5000).collect()
    assert sorted((r["place"], r["id"]) for r in got) == [(i, ident) for i, (_, ident) in enumerate(want)]


def test_pieces_lose_nothing(monkeypatch):
    monkeypatch.setattr("lorespark.llm.words.STEP", 4)
    data = "a bcdef ghijklmnop q  rs".encode()
    assert b"".join(pieces(data, re.compile(rb" "))) == data
    assert b" ".join(pieces(data, re.compile(rb" "))).split() == data.split()


