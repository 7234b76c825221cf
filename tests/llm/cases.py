"""Small documents with what operators must stand: nulls, empty and long texts, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, group_size long, __row long, kept string"


def documents(seed=1, n=60):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta", "MIT", "license", "Apache", "café", "漢字", "x1", "the", "of", "general", "public", "under", "licensed", "2.0,"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 12, 40, 120])))
        rows.append([i, text, rng.choice(["en", None]), rng.choice(["a", "b", "ä", None])])
    base = rows[7][1] + " tail of a text that is long enough to have near copies " * 3 + " ".join(rng.choice(words) + str(rng.random()) for _ in range(80))
    for k in range(6):
        near = base.split(" ")
        near[5 + 9 * k] = f"new{k}"
        rows.append([100 + k, " ".join(near), "en", "a"])
    rows += [[200, None, "en", "b"], [201, "", None, None], [202, " \n\t ", "en", "a"], [203, base.replace(" ", "  \n"), "de", "b"], [204, base, "de", "b"], [204, base, "de", "b"], [None, base, "de", "b"], [None, None, None, None]]
    rows += [[300, "word " * 30_000, "en", "a"], [301, "a" * 50_000, "en", "b"], [302, "one\ntwo words\none\ntwo words\n\n", "en", "a"]]
    return [(*r, len(r[1] or ""), 5, 6, "x") for r in rows]
