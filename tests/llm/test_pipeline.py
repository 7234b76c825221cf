import hashlib
import re
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lorespark.llm import bpe, mixing, quality  # noqa: E402
from lorespark.llm.common import written  # noqa: E402

from .cases import SCHEMA, documents  # noqa: E402
from .test_dedup_quality import WS  # noqa: E402
from .test_text_joins import brute_components  # noqa: E402


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "tokens"]
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = written(stage(spark, docs, sf), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good = {i: t for i, t in rows.items() if quality._first_failure(quality.Text(t), list(quality.RULES), quality.RULES) is None}
    first = {}
    for i in sorted(good):
        first.setdefault(WS.sub(" ", good[i]), i)
    single = {i: good[i] for i in first.values()}
    want = {i for i, _, c in brute_components(single.items()) if i == c}
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == want
    decisions = [(r["doc_id"], r["taken"]) for r in mixing.mix_sources(docs).collect()]
    mixed = written(corpus_pipeline.mixing(spark, docs, sf), "mixing")
    want_texts = Counter()
    for i, taken in decisions:
        size = len(re.findall("[^\x20\x09-\x0d]+", single[i]))
        want_texts[i, single[i]] += taken // size if size else 0
        if size and taken % size:
            want_texts[i, " ".join(re.findall("[^\x20\x09-\x0d]+", single[i])[: taken % size])] += 1
    assert Counter((r["doc_id"], r["text"]) for r in mixed.collect()) == +want_texts
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t))
    total = sum(words(single[i]) for i in want)
    assert abs(sum(words(r["text"]) for r in mixed.collect()) - total) <= 50
    whole = bpe.codec(bpe.VOCABULARY).whole
    want_ids = Counter((r["doc_id"], tuple(whole.encode_ordinary(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()) for r in mixed.collect())
    for coded in (corpus_pipeline.tokens(spark, mixed, sf), corpus_pipeline.run(spark, sf)):
        rows = coded.collect()
        assert Counter((r["doc_id"], tuple(np.frombuffer(r["token_ids"], "<u4").tolist()), r["decoded_sha256"]) for r in rows) == want_ids
        assert all(r["n_tokens"] == len(r["token_ids"]) // 4 for r in rows)


def test_stages_stand_odd_rows(spark, sf):
    """Nulls in all columns, empty texts, repeated ids with other texts, an empty table, columns with clashing names."""
    df = spark.createDataFrame(documents(), SCHEMA).withColumnsRenamed({"group_size": "component_id", "__row": "token_ids"})
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, sf), name)
            assert docs.columns == df.columns
        coded = corpus_pipeline.tokens(spark, docs, sf)
        assert coded.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids", "decoded_sha256"]
        assert coded.count() == docs.count()
    assert docs.count() == 0
