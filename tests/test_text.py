import random

from lorespark.functions import text


def test_forms():
    assert text.plain(" Ｆull  WIDTH\tSTRAẞE ") == "full width strasse"
    assert text.letters("A-b, ｃ１!") == "abc1"
    assert text.plain(None) == text.letters(None) == ""


def test_canonical_hashes():
    assert text.canonical({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    assert text.canonical_hash('{"b":1, "a":2}') == text.canonical_hash('{"a":2,"b":1}')
    assert text.canonical_hash("{") is None and text.canonical_hash(None) is None


def test_substring_error():
    assert text.substring_error("abc", "xxabcxx") == 0
    assert text.substring_error("abcd", "xxabxd") == 0.25
    assert text.substring_error("ab", "") == 1
    assert text.substring_error("", "x") is None


def test_likeness():
    assert text.likeness("abcd", "abcd") == 1 and text.likeness("abcd", "bcde") == 0.75 and text.likeness("", "a") == 0


def test_chapter_numbers():
    numbers = {"十": 10, "十二": 12, "二十": 20, "二十一": 21, "一百零五": 105, "三千": 3000, "一二": 12, "12": 12, "１２": 12, "第一": None, "": None}
    assert {k: text.chapter_number(k) for k in numbers} == numbers


def test_sql_functions(spark):
    text.register(spark)
    row = spark.sql("SELECT plain(x), letters(x), substring_error('abc', x), chapter_number(y) FROM VALUES ('  aBc d', '十二') AS t(x, y)").first()
    assert tuple(row) == ("abc d", "abcd", 1 / 3, 12)


def test_distances_scan_few_places_and_stay_the_same(monkeypatch):
    """All of each text was scanned, character by character, for every anchor that is not in it."""
    rng, scanned = random.Random(8), []
    whole = text.scanned_distance
    monkeypatch.setattr(text, "scanned_distance", lambda a, b: scanned.append(len(b)) or whole(a, b))
    for n in range(600):
        letters = "abcdefghij"[: rng.randrange(2, 11)]
        page = "".join(rng.choices(letters, k=rng.randrange(0, 300)))
        at = rng.randrange(len(page) + 1)
        part = list(page[at : at + rng.randrange(1, 70)]) or ["x"]
        for _ in range(rng.randrange(0, 20)):
            part[rng.randrange(len(part)) :][:1] = rng.choices(letters, k=rng.randrange(3))
            i = rng.randrange(len(part))
            part[i : i + rng.randrange(2)] = rng.choices(letters, k=rng.randrange(1, 3))
        expected = "".join(part)
        assert text.substring_distance(expected, page) == (0 if expected in page else whole(expected, page)), (expected, page)
    page, scanned[:] = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20_000)), []
    assert 0 < text.substring_distance(page[500:560].replace("e", ""), page) < 16 and sum(scanned) < 2_000
