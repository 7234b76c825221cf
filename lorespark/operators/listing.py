"""Scans with scope and roles, counts per document and job, and joins of calls with what they made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import count_where, in_scope, ratio


def page_of(rows: DataFrame, equal: dict[str, object], order: list[Column], size: int = 20, page: int = 1) -> DataFrame:
    """A page of the rows whose columns equal the given values, null being a value too; order must settle ties."""
    for name, value in equal.items():
        rows = rows.filter(F.col(name).eqNullSafe(F.lit(value)))
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def by_id(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of some ids, and whether each id is known: (id, found, then the row's other columns)."""
    return ids.select(key).distinct().join(rows.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    """(facet, name, n): the number of rows in all, and for each value of each key by itself, from one scan."""
    sums = rows.groupingSets([[], *[[k] for k in keys]], *keys).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    facet, name = F.lit("total"), F.lit(None).cast("string")
    every = (1 << len(keys)) - 1
    for i, k in enumerate(keys):
        of = F.col("g") == every - (1 << (len(keys) - 1 - i))
        facet, name = F.when(of, k).otherwise(facet), F.when(of, F.col(k).cast("string")).otherwise(name)
    return sums.select(facet.alias("facet"), name.alias("name"), "n")


def foreign_rows(rows: DataFrame, own: str | None, *keys: str) -> DataFrame:
    """Per group how many rows are of another tenant than one's own, and whether a caller of that tenant may read the group."""
    foreign = count_where(~in_scope(F.col("tenant_id"), own))
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), foreign.alias("foreign"), (foreign == 0).alias("readable"))


def visible(items: DataFrame, role: str) -> DataFrame:
    """Viewers see what is published only, all other roles see everything."""
    return items.filter("status = 'published'") if role == "viewer" else items


def permitted(users: DataFrame, matrix: DataFrame) -> DataFrame:
    """(user_id, permission) by the users' roles; the matrix is a small dimension of (role, permission)."""
    return users.join(matrix, "role").select("user_id", "permission")


def is_leaf(kind: Column) -> Column:
    """Whether a chunk is no parent; chunks without a kind are leaves."""
    return F.coalesce(kind != "parent", F.lit(True))


def retrieval_scope(chunks: DataFrame, documents: list[int] | None = None, source: str | None = None, section: tuple[str, ...] = (), points: tuple[str, ...] = (), labels: tuple[str, ...] = ()) -> DataFrame:
    """Leaf chunks of the given documents and source, under a section path, and of one of the knowledge points.

    Points match if a chunk has all of them; labels, in lower case, if its own label or one of its further labels is among them.
    """
    wanted = is_leaf(F.col("chunk_type"))
    if documents is not None:
        wanted = wanted & F.col("document_id").isin(documents)
    if source:
        wanted = wanted & (F.col("source_name") == source)
    for i, title in enumerate(section):
        wanted = wanted & (F.get("section_path", F.lit(i)) == title)
    if points or labels:
        known = F.lower(F.trim("knowledge_point")).isin(*labels) if labels else F.lit(False)
        overlap = F.arrays_overlap(F.transform("labels", F.lower), F.array(*map(F.lit, labels))) if labels else F.lit(False)
        all_points = F.size(F.array_intersect("point_ids", F.array(*map(F.lit, points)))) == len(points) if points else F.lit(False)
        wanted = wanted & (F.coalesce(known, F.lit(False)) | F.coalesce(overlap, F.lit(False)) | F.coalesce(all_points, F.lit(False)))
    return chunks.filter(wanted)


def calls_with_content(calls: DataFrame, items: DataFrame, template: str) -> DataFrame:
    """Calls with the item that they made, if any; those whose item or which themselves are of the template."""
    made = items.select(F.col("id").alias("item_id"), F.col("template_id").alias("item_template"), F.col("status").alias("item_status"))
    joined = calls.join(made, "item_id", "left")
    return joined.filter((F.col("item_template") == template) | (F.col("template_id") == template))


def document_summary(chunks: DataFrame) -> DataFrame:
    """Per document: leaves, parents, and the distinct embedding models of its leaves in order."""
    leaf = is_leaf(F.col("chunk_type"))
    models = F.array_join(F.sort_array(F.collect_set(F.when(leaf, F.col("embedding_model")))), ",")
    return chunks.groupBy("document_id").agg(count_where(leaf).alias("leaves"), count_where(~leaf).alias("parents"), models.alias("models"))


PAGE_STATES = ("pending", "running", "succeeded", "failed", "blank")


def job_summary(pages: DataFrame) -> DataFrame:
    """Per job: pages in each state, cached ones, and the share that is done."""
    states = [count_where(F.col("status") == s).alias(s) for s in PAGE_STATES]
    done = count_where(F.col("status").isin("succeeded", "failed", "blank"))
    return pages.groupBy("job_id").agg(F.count("*").alias("pages"), *states, count_where(F.col("cached")).alias("cached"), F.round(ratio(done, F.count("*")), 4).alias("progress"))


def page_gaps(pages: DataFrame) -> DataFrame:
    """(job_id, page_no, missing): pages before which some are missing, and how many. Page numbers start at 1."""
    before = F.lag("page_no", 1, 0).over(Window.partitionBy("job_id").orderBy("page_no"))
    return pages.withColumn("missing", F.col("page_no") - before - 1).filter("missing > 0").select("job_id", "page_no", "missing")


def chunk_families(chunks: DataFrame, *same: str) -> DataFrame:
    """Each leaf with its parent, and with the leaves before and after it in the document if they agree in all the given columns."""
    leaves = chunks.filter(is_leaf(F.col("chunk_type")))
    parents = chunks.filter(~is_leaf(F.col("chunk_type"))).select("document_id", F.col("id").alias("parent_id"), *[F.col(c).alias(f"p_{c}") for c in same])
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    neighbour = lambda step: F.when(_all_same(*[F.lag(c, step).over(order).eqNullSafe(F.col(c)) for c in same]), F.lag("id", step).over(order))
    rows = leaves.withColumn("previous_id", neighbour(1)).withColumn("next_id", neighbour(-1))
    rows = rows.join(parents, "document_id", "left")
    agrees = _all_same(*[F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in same])
    return rows.select("id", "document_id", F.when(agrees, F.col("parent_id")).alias("parent_id"), "previous_id", "next_id")


def _all_same(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def without_leaf(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """What is left of documents when some leaves go: their parents go too, the others' neighbours are linked anew, and
    documents that lost a leaf are partial."""
    lost = gone.select("id").withColumn("gone", F.lit(True))
    rows = chunks.join(lost, "id", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    touched = F.max(F.when(F.col("gone"), 1).otherwise(0)).over(Window.partitionBy("document_id"))
    rows = rows.withColumn("partial", touched == 1)
    rows = rows.filter(~F.col("gone") & (is_leaf(F.col("chunk_type")) | ~F.col("partial")))
    order = Window.partitionBy("document_id", is_leaf(F.col("chunk_type"))).orderBy("chunk_index")
    return rows.select("id", "document_id", "partial", F.lag("id").over(order).alias("previous_id"), F.lead("id").over(order).alias("next_id"))


def gold_candidates(items: DataFrame, records: DataFrame, calls: DataFrame) -> DataFrame:
    """Items with their latest judgement, and the last successful call that made them, for annotators to label."""
    latest = records.filter("source = 'auto'").groupBy("item_id").agg(F.max_by("score", F.struct("created_at", "record_id")).alias("score"))
    made = calls.filter("success").groupBy("item_id").agg(F.max_by("trace_id", F.struct("created_at", "id")).alias("trace_id"))
    rows = items.select(F.col("id").alias("item_id"), "template_id").join(latest, "item_id").join(made, "item_id", "left")
    return rows.select("item_id", "template_id", "score", "trace_id")
