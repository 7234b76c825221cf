import pyarrow as pa

from lorespark.functions.arrow import MOST, PART, mapped, parted
from lorespark.operators import context, documents, relations, retrieval, structural, structure, tables


def test_parts_are_small_and_whole():
    batch = pa.RecordBatch.from_pydict({"i": list(range(1000)), "text": ["x" * (i * 7 % 3000) for i in range(1000)]})
    parts = list(parted(batch, 10_000))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict() and len(parts) > 100
    assert all(p.nbytes <= 10_000 or p.num_rows == 1 for p in parts)
    assert list(parted(batch.slice(0, 0))) == [] and len(list(parted(batch.slice(0, 1), 1))) == 1


def test_steps_over_texts_get_batches_of_bounded_size(spark):
    """Whole batches as Python rows took hundreds of MB of each worker."""
    rows = spark.range(0, 64, 1, 1).selectExpr("id as doc_id", "repeat('word ', 100000) as text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})

    got = mapped(rows, sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 64 and max(r["size"] for r in got) <= PART + 1000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= MOST
    for cut in (documents.chunks, documents.chunk_rows, documents.text_blocks, documents.tier_chunks):
        assert cut(rows.limit(2)).count() > 0


def _blocks(spark, docs):
    rows = [(d, n, "heading" if n % 3 == 0 else "paragraph", 1, f"block {n} of {d}", n * 20) for d in range(docs) for n in range(6)]
    return structure.structured(spark.createDataFrame(rows, "doc_id long, place long, kind string, depth int, text string, start long"))


def test_folds_end_each_group_in_the_same_pass(spark):
    rows = spark.createDataFrame([(k, n) for k in range(5) for n in range(k + 1)], "k long, n long")

    def step(state, row):
        state["sum"] = state.get("sum", 0) + row["n"]
        return []

    got = context.folded(rows, ["k"], ["n"], lambda s, r: [] if s.update(k=r["k"]) else step(s, r), "k long, sum long", lambda s: [s])
    assert {tuple(r) for r in got.collect()} == {(k, k * (k + 1) // 2) for k in range(5)}
    built = _blocks(spark, 3)
    plans = [df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") for df in (built, structural.structural_chunks(built))]
    assert plans == [1, 2]  # the structure that the chunks are made of was built twice


def test_bundles_search_only_documents_of_candidates(spark, monkeypatch):
    built, seen = tables.written(_blocks(spark, 20), "built"), []
    chunks = tables.written(structural.structural_chunks(built), "chunks")
    first = chunks.filter("kind = 'leaf' and doc_id = 7").orderBy("start").first()["chunk_id"]
    asked = spark.createDataFrame([(1, 1, first, 1)], "query_id long, rank int, chunk_id string, question_parts int")
    reach = relations.bounded_reach

    def spied(starts, ways, *more):
        seen.append(ways.select("source.doc_id").distinct().collect())
        return reach(starts, ways, *more)

    monkeypatch.setattr(relations, "bounded_reach", spied)
    got = relations.relation_context(asked, chunks, built, built.select("doc_id").distinct().selectExpr("doc_id", "'s' as source_name"))
    assert [r["doc_id"] for r in got.collect()] == [7]
    assert [[r["doc_id"] for r in s] for s in seen] == [[7]]


def test_recall_holds_bounded_matches_and_finds_the_same(spark, monkeypatch):
    """Matches of a whole batch of texts with all queries were held at once."""
    queries = spark.createDataFrame([(q, f"w{q % 7} v{q % 3}") for q in range(9)], "query_id long, text string").coalesce(1)
    docs = spark.createDataFrame([(f"d{i:03}", f"w{i % 7} v{i % 5} w{i % 4}") for i in range(200)], "doc_id string, text string").coalesce(1)
    whole = sorted(map(tuple, retrieval.keyword_recall(queries, docs, 4).collect()))
    monkeypatch.setattr(retrieval, "HELD", 5)
    assert sorted(map(tuple, retrieval.keyword_recall(queries, docs, 4).collect())) == whole and len(whole) > 20
    vectors = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    near = sorted(map(tuple, retrieval.vector_recall(vectors.filter("vec_id % 3 = 0"), vectors, 4).collect()))
    monkeypatch.setattr(retrieval, "ROWS", 3)
    assert sorted(map(tuple, retrieval.vector_recall(vectors.filter("vec_id % 3 = 0"), vectors, 4).collect())) == near and len(near) == 80
