import hashlib
import re
from collections import Counter

from lorespark.llm import exact_dedup, quality

from .cases import SCHEMA, documents

WS = re.compile("[\x20\x09-\x0d]+")


def test_exact_duplicates_match_brute_force(spark):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA)
    got = exact_dedup.exact_duplicates(df, digest_all=True).collect()
    norm = {}
    for r in rows:
        norm.setdefault(WS.sub(" ", r[1] or ""), []).append(r[0])
    assert len(got) == len(rows)
    kept = Counter()
    for g in got:
        text = WS.sub(" ", g["text"] or "")
        ids = norm[text]
        known = [i for i in ids if i is not None]
        assert g["group_size"] == len(ids)
        assert g["keep_id"] == (min(known) if known else None)
        assert g["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        kept[text] += g["kept"]
        if g["kept"]:
            assert g["doc_id"] == g["keep_id"]
    assert set(kept.values()) == {1}


def test_stage_keeps_columns_and_empty_tables_work(spark):
    df = spark.createDataFrame(documents(), SCHEMA)
    left = exact_dedup.without_exact_duplicates(df)
    assert left.columns == df.columns
    assert left.count() == len({WS.sub(" ", r[1] or "") for r in documents()})
    assert exact_dedup.without_exact_duplicates(df.limit(0)).count() == 0
    assert quality.of_good_quality(df.limit(0)).count() == 0
    assert quality.quality_report(df.limit(0)).count() == 0


def brute_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if counts[g] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_report_matches_brute_force(spark):
    df = spark.createDataFrame(documents(3), SCHEMA)
    for row in quality.quality_report(df).join(df.select("doc_id", "text"), "doc_id").collect():
        assert tuple(row)[1:7] == brute_counts(row["text"]), row["doc_id"]
        assert not (row["base_failed"] and row["kept"])


def test_cascade_verdicts_do_not_depend_on_order(spark):
    texts = [quality.Text(r[1]) for r in documents(4)]
    names = list(quality.RULES)
    one = [quality._first_failure(t, names, quality.RULES) is None for t in texts]
    other = [quality._first_failure(t, names[::-1], quality.RULES) is None for t in texts]
    assert one == other
    assert sorted(quality.cascade_order(spark.createDataFrame(documents(), SCHEMA))) == sorted(names)


def test_cascade_leaves_clean_prose():
    clean = "The committee met on Monday to discuss plans for a new library. Several members asked how the building would be paid for, and whether the old hall could be kept open meanwhile."
    assert quality._first_failure(quality.Text(clean), list(quality.RULES), quality.RULES) is None
    assert quality._first_failure(quality.Text("a | " * 40), list(quality.RULES), quality.RULES)


def test_the_sample_comes_from_all_over(spark):
    df = spark.range(0, 1000, 1, 100).selectExpr("cast(id as string) as text")
    found = quality.sampled_texts(df, "text", 64)
    assert 32 <= len(found) <= 64 and len({int(x) // 100 for x in found}) == 10
    assert quality.sampled_texts(df.limit(0), "text") == []
    assert len(quality.sampled_texts(spark.range(0, 10, 1, 2).selectExpr("cast(null as string) as text"), "text")) == 10


def test_lists_numbers_and_broken_off_lines_go():
    first = lambda text: quality._first_failure(quality.Text(text), list(quality.RULES), quality.RULES)
    words = [f"word{'abcdefghijklmnopqrst'[i]} other{'tsrqponmlkjihgfedcba'[i]}" for i in range(20)]
    assert first("\n".join(f"- {w}" for w in words)) == "bullets"
    assert first("\n".join(f"{w}..." for w in words)) == "ellipses"
    assert first(" ".join(str(10_000_019 * i) for i in range(1, 40))) == "digits"
    assert first("\n".join(words)) is None
