"""Replacing and deleting documents of an index: readers see one version or the next."""

import pytest
from pyspark.sql import functions as F

from lorespark.sources.index import ChunkIndex, Conflict, index_rows

SCHEMA = "document_id long, chunk_id string, header string, content string"


def rows(spark, *items):
    return index_rows(spark.createDataFrame(list(items), SCHEMA))


def held(index, version=None):
    return sorted((r["document_id"], r["chunk_id"], r["content"]) for r in index.read(version).collect())


def test_replace_delete_and_old_readers(spark, tmp_path):
    index = ChunkIndex(spark, f"{tmp_path}/index")
    assert index.read() is None and index.delete(spark.createDataFrame([(1,)], "document_id long")) == 0
    index.replace(rows(spark, (1, "1:0", "h", "a"), (1, "1:1", None, "b"), (2, "2:0", "", "c")))
    before = index.read()
    index.replace(rows(spark, (1, "1:0", "h", "A"), (3, "3:0", "h", "d")))
    assert held(index) == [(1, "1:0", "A"), (2, "2:0", "c"), (3, "3:0", "d")]
    assert sorted(r["content"] for r in before.collect()) == ["a", "b", "c"] and held(index, 1)[0] == (1, "1:0", "a")
    index.replace(rows(spark, (9, "9:0", None, "x")).limit(0), spark.createDataFrame([(2,)], "document_id long"))
    assert held(index) == [(1, "1:0", "A"), (3, "3:0", "d")]
    index.delete(spark.createDataFrame([(3,), (77,)], "document_id long"))
    assert held(index) == [(1, "1:0", "A")]
    index.vacuum()
    assert index.versions() == [4] and held(index) == [(1, "1:0", "A")]
    index.delete(spark.createDataFrame([(1,)], "document_id long"))
    assert held(index) == []


def test_a_failed_replace_leaves_the_index(spark, tmp_path):
    index = ChunkIndex(spark, f"{tmp_path}/index")
    index.replace(rows(spark, (1, "1:0", None, "a")))
    broken = rows(spark, (1, "1:0", None, "b")).withColumn("content", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        index.replace(broken)
    assert index.versions() == [1] and held(index) == [(1, "1:0", "a")]


def test_of_two_writers_one_starts_again(spark, tmp_path):
    one, two = ChunkIndex(spark, f"{tmp_path}/index"), ChunkIndex(spark, f"{tmp_path}/index")
    one.replace(rows(spark, (1, "1:0", None, "a")))
    base = two.versions()[-1]
    one.replace(rows(spark, (1, "1:0", None, "b")))
    with pytest.raises(Conflict):
        two._switch(two.documents(base), base)
    assert held(two) == [(1, "1:0", "b")]


def test_texts_to_embed_and_search(spark):
    got = rows(spark, (1, "1:0", "Head", "Some  Text\nhere"), (2, "2:0", "", "Bare")).orderBy("document_id").collect()
    assert [r["embedding_text"] for r in got] == ["Head\n\nSome  Text\nhere", "Bare"]
    assert [r["search_text"] for r in got] == ["head some text here", "bare"]
