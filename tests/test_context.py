"""What expands, what is delivered: against plain replays over sets of places."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorespark.operators import context
from lorespark.operators.context import Delivered, Limits, longest_start

CHUNKS = "chunk_id string, document_id long, kind string, parent_id string, prev_id string, next_id string, start long, end long, content string, header string, source_name string, page long"


def largest(places):
    """The longest run of a set of integers, the first of equals."""
    best, run = None, []
    for p in sorted(places):
        run = [*run, p] if run and run[-1] == p - 1 else [p]
        if best is None or len(run) > len(best):
            best = run
    return (best[0], best[-1] + 1) if best else None


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 15)), max_size=12))
@settings(max_examples=300, deadline=None)
def test_pieces_against_sets(spans):
    seen, told = Delivered(), set()
    for start, size in spans:
        piece = seen.largest_left(start, start + size)
        assert piece == largest(set(range(start, start + size)) - told)
        if piece:
            seen.add(*piece)
            told |= set(range(*piece))
    assert {p for a, b in zip(seen.starts, seen.ends, strict=True) for p in range(a, b)} == told
    assert all(b < a for b, a in zip(seen.ends, seen.starts[1:]))


def test_a_trimmed_span_hides_only_what_it_gave(spark):
    rows = [(1, 1, 1, 10, 20), (1, 1, 2, 0, 40), (1, 1, 3, 0, 10), (1, 2, 4, 0, 10), (1, 1, 5, 12, 18), (2, 1, 1, 0, 5), (2, 1, 2, None, 5), (2, 1, 3, 5, 5)]
    got = context.undelivered(spark.createDataFrame(rows, "query_id long, document_id long, place long, start long, end long")).collect()
    assert {(r["query_id"], r["place"]): (r["start"], r["end"]) for r in got} == {(1, 1): (10, 20), (1, 2): (20, 40), (1, 3): (0, 10), (1, 4): (0, 10), (2, 1): (0, 5)}


def world(seed):
    """Documents of two pages with overlapping leaves, some under parents, pointers that may lead to another page or nowhere."""
    rng, rows = random.Random(seed), []
    for d in range(4):
        text = "".join(rng.choice("abcdé漢 ") for _ in range(400))
        spans = [(a, min(400, a + rng.choice([40, 60, 90]))) for a in range(0, 400, 40)]
        for i, (a, b) in enumerate(spans):
            up = f"{d}:p{i // 4}" if d != 1 and i // 4 != 1 else ("gone" if i == 5 else None)
            rows.append((f"{d}:{i}", d if d < 3 or i else None, rng.choice(["leaf", None]), up, f"{d}:{i - 1}" if i else None, f"{d}:{i + 1}", a, b, text[a:b], rng.choice([None, "", "head"]), f"doc {d}", i // 6))
        for g in (0, 2):
            a, b = spans[4 * g][0], spans[min(len(spans), 4 * g + 4) - 1][1]
            rows.append((f"{d}:p{g}", d, "parent", None, None, None, a, b, text[a:b], None, f"doc {d}", 0))
        rows.append((f"{d}:bare", d, "leaf", None, None, None, None, None, "no span " * 3, None, "x", 0))
    return rows


def replay(rows, candidates, limits):
    """One query, step by step: spans as sets of places, cuts by trying every length."""
    by = {r[0]: r for r in rows}

    def alike(a, b):
        return a[1] is not None and a[1] == b[1] and a[11] == b[11]

    main, side = {}, {}
    for c in candidates:
        leaf, up = by[c], by.get(by[c][3])
        row = up if up and up[2] == "parent" and alike(leaf, up) else leaf
        main.setdefault(row[0], c)
        if row is leaf:
            for pointer in (4, 5):
                at = leaf
                for _ in range(limits.window):
                    at = by.get(at[pointer])
                    if at is None or at[2] == "parent" or not alike(leaf, at) or len(main) + len(side) >= limits.chunks:
                        break
                    side.setdefault(at[0], c)
        if len(main) >= limits.chunks:
            break
    chosen = list({**main, **{k: v for k, v in side.items() if k not in main}}.items())[: limits.chunks]
    parents = {k for k, _ in chosen if by[k][2] == "parent"}
    chosen = [(k, c) for k, c in chosen if by[k][3] not in parents]
    out, told, spans, chars, octets = [], set(), set(), 0, 0
    for place, (key, match) in enumerate(chosen, 1):
        _, doc, _, _, _, _, start, end, content, header, source, _ = by[key]
        if len(out) == limits.top or doc is not None and (doc, start, end) in spans:
            continue
        piece, body = (start, end), content
        if doc is not None and start is not None:
            piece = largest({p for p in range(start, end) if (doc, p) not in told})
            if piece is None:
                continue
            body = content[piece[0] - start : piece[1] - start]
        frame = ("\n\n" if out else "") + f"[来源 {key}: {source}]\n" + (f"{header}\n\n" if header else "")
        fits = [n for n in range(len(body) + 1) if (limits.chars is None or chars + len(frame) + n <= limits.chars) and (limits.octets is None or octets + len((frame + body[:n]).encode()) <= limits.octets)]
        if not fits or fits[-1] < min(len(body), limits.least):
            continue
        n = fits[-1]
        at = (piece[0], piece[0] + n) if start is not None else (None, None)
        out.append((place, key, match, *at, (f"{header}\n\n" if header else "") + body[:n], doc is not None and start is not None and piece != (start, end), n < len(body)))
        chars, octets = chars + len(frame) + n, octets + len((frame + body[:n]).encode())
        if doc is not None:
            spans.add((doc, start, end))
            told |= {(doc, p) for p in range(at[0], at[1])} if start is not None else set()
    return out


@pytest.mark.parametrize("limits", [Limits(), Limits(top=4, chars=300), Limits(top=9, chars=500, octets=350, window=3), Limits(top=9, chars=None, octets=400, chunks=5, window=2), Limits(chunks=1), Limits(top=9, chars=100, window=0, least=1)])
def test_context_against_replay(spark, limits):
    rng = random.Random(11)
    rows = world(1)
    leaves = [r[0] for r in rows if r[2] != "parent"]
    asked = {q: rng.sample(leaves, rng.choice([1, 3, 8])) for q in range(25)}
    candidates = spark.createDataFrame([(q, i, c) for q, found in asked.items() for i, c in enumerate(found, 1)], "query_id long, rank long, chunk_id string")
    got = context.context_passages(candidates, spark.createDataFrame(rows, CHUNKS).withColumn("extra", F.lit(1)), limits, ["page"]).collect()
    by_query = {q: [] for q in asked}
    for r in sorted(got, key=lambda r: (r["query_id"], r["place"])):
        by_query[r["query_id"]].append((r["place"], r["chunk_id"], r["match_id"], r["start"], r["end"], r["text"], r["trimmed"], r["truncated"]))
        assert r["match_id"] in r["matched"]
    for q, found in asked.items():
        assert by_query[q] == replay(rows, found, limits), q


@given(st.text(alphabet="aé漢😀", max_size=20), st.one_of(st.none(), st.integers(-2, 25)), st.one_of(st.none(), st.integers(-2, 60)))
@settings(max_examples=200, deadline=None)
def test_longest_start(text, chars, octets):
    fits = [n for n in range(len(text) + 1) if (chars is None or n <= chars) and (octets is None or len(text[:n].encode()) <= octets)]
    assert longest_start(text, chars, octets) == (fits[-1] if fits else None)


def test_statuses(spark):
    queries = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "query_id long, failed_lanes long")
    given_ = spark.createDataFrame([(1, 2, "b", "s", "second"), (1, 1, "a", "s", "first")], "query_id long, place long, chunk_id string, source_name string, text string")
    got = {r["query_id"]: (r["status"], r["context"], r["refused"]) for r in context.contexts(queries, given_, required=True).collect()}
    assert got == {1: ("hit", "[来源 a: s]\nfirst\n\n[来源 b: s]\nsecond", False), 2: ("degraded", "", True), 3: ("no_match", "", True)}
