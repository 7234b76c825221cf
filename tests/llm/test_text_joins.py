import math
import random
import re
from collections import Counter, defaultdict

import pytest

from lorespark.llm import lm_scores, mixing, ngram_join
from lorespark.llm.common import LOWER, UPPER

from .cases import SCHEMA, documents


def shingles(text, width=4):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)] if words else [])


def brute_components(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for i, (ident, _) in enumerate(sets):
        least[find(i)].append(ident)
    return [(ident, len(s), min((k for k in least[find(i)] if k is not None), default=None) if s else ident) for i, (ident, s) in enumerate(sets)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rows = documents(seed)
    rng = random.Random(seed)
    base = [f"w{rng.randrange(300)}" for _ in range(150)]
    for k in range(12):  # a chain: each differs a little from the one before
        base = base.copy()
        base[(11 * k) % 140] = f"c{k}"
        base[(17 * k + 5) % 140] = f"d{k}"
        rows.append((400 + k, " ".join(base), "en", "a", 1, 1, 1, "x"))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    want = Counter(brute_components([(r[0], r[1]) for r in rows]))
    assert Counter((g["doc_id"], g["n_shingles"], g["component_id"]) for g in got) == want


def test_hash_sets_follow_words():
    texts = ["", None, "one two", "A b C d e", "a  b\tc\nd e", "x" * 3_000_000 + " tail of it all", "é ü ß ñ ø"]
    found = list(ngram_join.shingle_sets(texts, 4))
    assert [len(x) for x in found] == [len(shingles(t)) for t in texts]
    assert (found[3] == found[4]).all()
    assert len(found[5]) == 2


def test_near_dedup_stage(spark):
    df = spark.createDataFrame(documents(), SCHEMA)
    left = ngram_join.one_of_each_group(df)
    assert left.columns == df.columns
    ids = {r["doc_id"] for r in left.collect()}
    assert len(ids & set(range(100, 106))) <= 1
    assert {200, 201, 300, 301} <= ids
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0


def test_rows_go_by_id_and_text(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text), (5, text + " x"), (5, "quite other words here and there"), (None, text), (7, text), (7, text), (8, ""), (8, None)]
    df = spark.createDataFrame(rows, "doc_id smallint, text string")
    left = sorted((r["doc_id"], r["text"] or "") for r in ngram_join.one_of_each_group(df).collect())
    assert left == [(3, text), (5, "quite other words here and there"), (8, ""), (8, "")]


def test_all_links_match_brute_force(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(300)}" for _ in range(150)]
    rows = [(1, " ".join(base)), (2, " ".join(base))]
    for k in range(20):
        rows.append((10 + k, " ".join(w if rng.random() > 0.01 * (k % 3) else f"n{k}" for w in base)))
    sets = {}
    for i, t in rows:
        sets.setdefault(shingles(t), []).append(i)
    want = set()
    for x, a in sets.items():
        for y, b in sets.items():
            if min(a) < min(b) and 100 * len(x & y) >= 85 * len(x | y):
                want.add((min(a), min(b), len(a), len(b)))
    got = ngram_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(want) > 10 and len(got) == len(want)
    assert {(x, y, p, q) if x < y else (y, x, q, p) for x, y, p, q in got} == want


def test_mix_meets_targets(spark):
    rows = documents(5, 200)
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_sources(df).collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= 3 * sizes[s]
            free.discard(s)
        if not free:
            break
    taken = defaultdict(int)
    for g in got:
        assert g["size"] * 3 >= g["taken"] >= 0
        assert g["source_size"] == sizes[g["source"]]
        assert math.isclose(g["target"], target[g["source"]], rel_tol=1e-9, abs_tol=1e-9)
        taken[g["source"]] += g["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 0.5
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_sources(df.repartition(3)).collect()))
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r["source"]] += size(r["text"])
    for s in order:
        assert words[s] == taken[s]
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_repeated_rows_lose_no_words(spark):
    rows = [(1, "one two three four five", "a")] * 3 + [(2, " ".join("w" * 97), "b"), (None, "x y", "a"), (None, "x z", "a"), (3, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = {r["source"]: round(r["target"]) for r in mixing.mix_sources(df).select("source", "target").distinct().collect()}
    for how in (df, df.repartition(3)):
        words = Counter()
        for r in mixing.mixed_documents(how).collect():
            words[r["source"]] += len(r["text"].split())
        assert words["a"] == targets["a"] and words["b"] == targets["b"]


def brute_scores(texts, order, held_out):
    """(n_words, n_seen, log_score) of each text."""
    docs = []
    for t in texts:
        words = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(str.maketrans(UPPER, LOWER)))
        row = [None] * (order - 1) * bool(words) + words
        grams = Counter(tuple(row[max(0, i + 1 - n) : i + 1]) for n in range(1, order + 1) for i in range(order - 1 if n == order else order - 2, len(row)) if i >= 0)
        docs.append((words, row, grams))
    all_grams = sum((g for _, _, g in docs), Counter())
    total = sum(len(w) for w, _, _ in docs)
    out = []
    for words, row, grams in docs:
        known = lambda gram, own=grams: all_grams[tuple(gram)] - own[tuple(gram)] * held_out
        rest, score, seen = max(1, total - len(words) * held_out), 0.0, 0
        for i in range(order - 1, len(row)):
            for n in range(order, 0, -1):
                if (c := known(row[i + 1 - n : i + 1])) > 0:
                    score += math.log(lm_scores.BACKOFF ** (order - n) * c / (known(row[i + 1 - n : i]) if n > 1 else rest))
                    seen += n == order
                    break
            else:
                score += math.log(lm_scores.BACKOFF**order / rest)
        out.append((len(words), seen, score))
    return out


@pytest.mark.parametrize(("order", "held_out", "words"), [(3, True, 1 << 19), (3, True, 50), (2, False, 300), (1, True, 300), (4, True, 7)])
def test_scores_match_brute_force(spark, monkeypatch, order, held_out, words):
    """Also with chunks so small that most n-grams stand in several, and documents longer than a chunk."""
    monkeypatch.setattr(lm_scores, "CHUNK_WORDS", words)
    monkeypatch.setattr(lm_scores, "BUCKET", 1 << (6 if words < 100 else 20))
    rng = random.Random(9)
    texts = [r[1] for r in documents(6) if len(r[1] or "") < 5000]
    texts += [" ".join(f"r{rng.randrange(2000)}" for _ in range(rng.choice([3, 90]))) for _ in range(40)]
    texts += [texts[-1], texts[-1], "", None, "one", "the " * 300]
    got = lm_scores.backoff_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), order, held_out).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    want = brute_scores(texts, order, held_out)
    for r in got:
        n, seen, score = want[r["doc_id"]]
        assert (r["n_words"], r["n_seen"]) == (n, seen)
        assert math.isclose(r["log_score"], score, rel_tol=1e-9, abs_tol=1e-9)
        assert r["mean_log_score"] is None if n == 0 else math.isclose(r["mean_log_score"], score / n, rel_tol=1e-9, abs_tol=1e-9)


def test_scores_of_odd_tables(spark):
    df = spark.createDataFrame(documents(6), SCHEMA)
    assert Counter(r["doc_id"] for r in lm_scores.backoff_scores(df).collect()) == Counter(r[0] for r in documents(6))
    assert lm_scores.backoff_scores(df.limit(0)).count() == 0
    assert [r["log_score"] for r in lm_scores.backoff_scores(spark.createDataFrame([("a", None)], "doc_id string, text string")).collect()] == [0.0]
