"""Exact n-gram Jaccard join: prefix filters under several global orders, met before verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import attach, dropped, fresh, group_map, map_bits, map_place, returned, table, with_flag, written
from .components import component_roots
from .words import ORDERS, STEP, lowered, mixed, word_hashes

#: Counters of the sketch that orders shingles by how many texts have them, and slots of the map of wanted texts.
#: Both have the same size for any input.
SKETCH_BITS, BLOCK_BITS, SLOT_BITS = 22, 17, 22
#: Heads of lists that a node is held against before all pairs that are left; it bounds work done early, no result.
HEADS = 4
#: Nodes up to which a list is short.
SHORT = 8


@dataclass(frozen=True)
class Join:
    """Texts link when 100 * intersection >= percent * union of their sets of width-word shingles."""

    width: int = 4
    percent: int = 85

    def prefix(self, n: int) -> int:
        """So many first shingles of a set of n in any order hold one of every set that it links with."""
        return n + (-self.percent * n // 100) + 1

    def overlap(self, sizes: str) -> str:
        """SQL for the least intersection of linked sets, by the sum of their sizes."""
        return f"ceil({self.percent}L * ({sizes}) / {100 + self.percent})"


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles; of all its words at once if they are fewer than width."""
    held: list[bytes] = []
    for text in texts:
        held.append(lowered(text))
        if sum(map(len, held[-64:])) > STEP or len(held) >= 64:
            yield from _shingled(held, width)
            held = []
    yield from _shingled(held, width)


def _shingled(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    starts, h = word_hashes(b"\n".join(texts))
    ends = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in texts])) if texts else []
    n = max(0, len(h) - width + 1)
    runs = np.full(n, width, np.uint64)
    for i in range(width):
        runs = mixed(runs * np.uint64(0x100000001B3) + h[i : n + i], ORDERS[0])
    begin = 0
    for end in ends:
        if end - begin >= width:
            yield np.unique(runs[begin : end - width + 1])
        else:
            whole = np.full(min(1, end - begin), end - begin, np.uint64)
            for i in range(begin, end):
                whole = mixed(whole * np.uint64(0x100000001B3) + h[i], ORDERS[0])
            yield whole
        begin = end


def _counter(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _ordered(tokens: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
    """Shingles in a global order: in order 0 what few texts have comes first, ties by hash; the others are hash orders of their own."""
    rank = mixed(tokens, ORDERS[order])
    if order == 0:
        rank = counts[_counter(tokens)].astype(np.uint64) << np.uint64(48) | rank >> np.uint64(16)
    return tokens[np.argsort(rank, kind="stable")]


def _slot(ident: object) -> int:
    return xxhash.xxh3_64_intdigest(repr(ident).encode()) >> (64 - SLOT_BITS)


def _signed(docs: DataFrame, how: Join) -> DataFrame:
    """A row (id, key, n, node, slot) for each text, and blocks (block, part, counts) of each task's sketch.

    node, 16 bytes, stands for the set of shingles: texts with equal sets are one node from here on.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, part = np.zeros(1 << SKETCH_BITS, np.uint16), set(), 0
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for ident, tokens in zip(ids, shingle_sets(batch.column(2).to_pylist(), how.width), strict=True):
                node = xxhash.xxh3_128_digest(tokens.tobytes())
                rows.append((len(tokens), node, _slot(ident)))
                part ^= rows[-1][2]
                if node not in seen:
                    seen.add(node)
                    at = _counter(tokens)
                    counts[at] += counts[at] < 65_535
            k = len(rows)
            n, node, slot = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(slot, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        blocks = counts.reshape(-1, 1 << BLOCK_BITS)
        for i, block in enumerate(blocks):
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.array([i], pa.int32()), pa.array([part % 64], pa.int32()), pa.array([block.tobytes()], pa.binary())], names)

    names = ["id", "key", "n", "node", "slot", "block", "part", "counts"]
    kind = docs.schema["id"].dataType
    id_type = to_arrow_type(kind)
    return docs.select("id", "key", "text").mapInArrow(returned(sign), f"id {kind.simpleString()}, key long, n long, node binary, slot int, block int, part int, counts binary")


def _summed(blocks: DataFrame, kind: type, use: Callable[[np.ndarray], np.ndarray] = np.asarray) -> DataFrame:
    """One row per block and partition, with use(sums); the sums stream, so that a task holds one sketch at most."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                new = np.frombuffer(counts.as_buffer(), kind)
                sums[block] = sums[block] + new if block in sums else new.astype(np.int64)
        for block, counts in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": pa.array([use(counts).tobytes()], pa.binary())})

    return blocks.select("block", "counts").mapInArrow(returned(add), "block int, counts binary")


def _sketch(signed: DataFrame) -> np.ndarray:
    """The rank by number of sets that each counter's shingles get: 8 MB on the driver for any input, added up in two steps.

    Ranks are 1,024 to a doubling, so that two bytes hold them at any size and differences stay.
    """
    first = _summed(signed.filter("block is not null").repartition("block", "part"), np.uint16)
    out = np.zeros((1 << (SKETCH_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.uint16)
    ranked = _summed(first.repartition("block"), np.int64, lambda sums: np.round(1024 * np.log2(sums + 1.0)).astype(np.uint16))
    for row in ranked.toLocalIterator():
        out[row["block"]] = np.frombuffer(row["counts"], np.uint16)
    return out.ravel()


def _postings(docs: DataFrame, how: Join, counts) -> DataFrame:
    """(token, node, n, pos) for the prefix of each set under the first order."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            tokens, nodes, sizes, places = [], [], [], []
            for found in shingle_sets(batch.column(0).to_pylist(), how.width):
                node = xxhash.xxh3_128_digest(found.tobytes())
                if len(found) and node not in seen:
                    seen.add(node)
                    head = _ordered(found, counts.value, 0)[: how.prefix(len(found))]
                    tokens.append(head.view(np.int64))
                    nodes += [node] * len(head)
                    sizes.append(np.full(len(head), len(found), np.int32))
                    places.append(np.arange(len(head), dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(nodes, pa.binary()), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], ["token", "node", "n", "pos"])

    return docs.select("text").mapInArrow(returned(post), "token long, node binary, n int, pos int")


def _sets(docs: DataFrame, how: Join, counts, wanted) -> DataFrame:
    """(node, n, second, third, full) of the texts whose slot is wanted: prefixes under the other orders, cut to 32 bits
    as a filter may, and the set."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            slots, rows = map(_slot, batch.column(0).to_pylist()), []
            texts = [x for x, slot in zip(batch.column(1).to_pylist(), slots, strict=True) if wanted.value[slot >> 6] >> np.uint64(slot & 63) & np.uint64(1)]
            for found in shingle_sets(texts, how.width):
                node = xxhash.xxh3_128_digest(found.tobytes())
                if len(found) and node not in seen:
                    seen.add(node)
                    k = how.prefix(len(found))
                    rows.append((node, len(found), *(np.unique(_ordered(found, counts.value, o)[:k] >> np.uint64(32)).astype(np.uint32).tobytes() for o in (1, 2)), found.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["node", "n", "second", "third", "full"])

    return docs.select("id", "text").mapInArrow(returned(fetch), "node binary, n int, second binary, third binary, full binary")


def _shared(a: pa.Scalar, b: pa.Scalar, kind: type = np.uint64) -> int:
    return len(np.intersect1d(np.frombuffer(a.as_buffer(), kind), np.frombuffer(b.as_buffer(), kind), assume_unique=True))


def _met(pairs: DataFrame, sets: DataFrame, columns: list[str], keep) -> DataFrame:
    """The pairs (x, y) whose sets' columns satisfy keep."""
    left = sets.select(F.col("node").alias("x"), *[F.col(c).alias(f"x_{c}") for c in columns])
    right = sets.select(F.col("node").alias("y"), *[F.col(c).alias(f"y_{c}") for c in columns])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            good = [keep([named[f"x_{c}"][i] for c in columns], [named[f"y_{c}"][i] for c in columns]) for i in range(batch.num_rows)]
            yield batch.select(["x", "y"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(left, "x").join(right, "y")
    return joined.select("x", "y", *[f"x_{c}" for c in columns], *[f"y_{c}" for c in columns]).mapInArrow(returned(test), "x binary, y binary")


def _links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, how: Join, counts) -> DataFrame:
    """The pairs that share a shingle in the prefixes under each further order, then verified on whole sets.

    The sets are those of the row with the least id of each node in a pair. Rows whose slot such a row has in a
    map of fixed size are read again; what else the map lets through meets no pair.
    """
    if pairs.isEmpty():
        return pairs
    nodes = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()
    slots = nodes.join(classes, "node").groupBy(F.expr("slot div 64").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, slot % 64))").alias("bits"))
    wanted = np.zeros(1 << (SLOT_BITS - 6), np.uint64)
    for cell, bits in slots.toLocalIterator():
        wanted[cell] = np.uint64(bits & (1 << 64) - 1)
    wanted = docs.sparkSession.sparkContext.broadcast(wanted)
    sets = written(_sets(docs, how, counts, wanted), "sets")
    wanted.destroy()
    met = _met(pairs, sets, ["second", "third"], lambda a, b: all(_shared(p, q, np.uint32) > 0 for p, q in zip(a, b, strict=True)))
    candidates = written(met.distinct(), "candidates")

    def linked(a: list, b: list) -> bool:
        common = _shared(a[1], b[1])
        return 100 * common >= how.percent * (a[0].as_py() + b[0].as_py() - common)

    links = written(_met(candidates, sets, ["n", "full"], linked).distinct(), "links")
    dropped(sets, candidates)
    return links


def jaccard_components(docs: DataFrame, how: Join | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class_size, text_key, is_first) for each row: component_id is the least id that
    links lead to, class_size how many rows have the same set, text_key a hash of the text, and is_first holds for one
    row of each component, the one with the least id, null last, then the least text_key; for rows that repeat its id and
    text too.

    Texts with equal sets are one node, so copies are never paired. Shingles are ordered by the number of sets
    that have them, by a sketch over all texts, ties by hash; a set's prefix in that order is posted. Nodes that
    share a posted shingle and whose sizes and places allow it are candidates: all pairs of short lists; in long
    ones first each node with a few heads of its lists, then with heads of its lists' largest components. Candidates must also share a shingle in the
    prefixes under two further orders before whole sets are compared. What links forms components, and at last
    each pair of nodes of one long list that are in different components follows; pairs inside a component could not
    change the result. No link is lost.

    Null and empty texts have no shingles and link with nothing: each is its own component. Null ids count
    only where a component has no other. Repeated rows get equal results; an empty table gives no rows.
    """
    how = how or Join()
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    signed = written(_signed(docs, how), "signed")
    counts = docs.sparkSession.sparkContext.broadcast(_sketch(signed))
    classes = written(_classes(signed), "classes")

    postings = written(_postings(docs, how, counts), "postings")
    lists = postings.groupBy("token").agg(F.count("*").alias("posted")).filter("posted > 1")
    shared = written(attach(postings, lists, ["token"], "posted", postings.count()).filter("posted > 1"), "shared")
    dropped(postings)

    possible = partial(_possible, how)
    # Short lists give all their pairs at once; of long ones nodes meet a few heads first. A list's head is the node
    # that has the shingle earliest, so the fewest rare shingles of its own: copies differ from it least.
    a, b = (shared.filter(F.col("posted") <= SHORT).alias(n) for n in "ab")
    pairs = a.join(b, F.expr(f"a.token = b.token and a.node < b.node and {possible('a', 'b')}")).select(F.col("a.node").alias("x"), F.col("b.node").alias("y")).distinct()
    long = shared.filter(F.col("posted") > SHORT)
    heads = long.groupBy("token").agg(F.min(F.struct("pos", "node", "n")).alias("b"))
    first = written(pairs.unionByName(_closest(long, heads, possible).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))).distinct(), "pairs")
    links = _links(first, docs, classes, how, counts)
    roots = component_roots(links)
    second = written(_open_lists(long, roots), "open")
    heads = second.filter("root = major").groupBy("token").agg(F.max(F.struct("node", "n", "pos")).alias("b"))
    second = _closest(second.filter("root <> major"), heads, possible)
    links = written(links.unionByName(_links(second, docs, classes, how, counts)), "links")
    roots = component_roots(links)
    rows = written(_open_lists(long, roots), "open")
    a, b = rows.filter("root <> major").alias("a"), rows.alias("b")
    # A pair of two minor components comes from both sides; the order of nodes keeps one of them.
    rest = a.join(b, F.expr(f"a.token = b.token and a.root <> b.root and (b.root = b.major or a.node < b.node) and {possible('a', 'b')}"))
    rest = rest.select(F.least("a.node", "b.node").alias("x"), F.greatest("a.node", "b.node").alias("y")).distinct()
    met = first.unionByName(second).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    rest = written(rest.join(met, ["x", "y"], "left_anti"), "pairs")
    dropped(shared, rows)
    if not rest.isEmpty():
        links = written(links.unionByName(_links(rest, docs, classes, how, counts)), "links")
        roots = component_roots(links)

    counts.destroy()  # nothing that is left to compute needs the order
    named = attach_roots(classes.drop("slot"), roots)
    least = named.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("nodes"))
    final = attach(named.select("node", "class_size", "root"), least, ["root"], "nodes", classes.count()).select("node", "class_size", "first")
    rows = attach(signed.filter("block is null").select("id", "key", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")), final, ["node"], "class_size", signed.count())
    alone = F.col("first").isNull()
    return rows.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("component_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        F.col("key").alias("text_key"),
        (alone | (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key")))).alias("is_first"),
    )


def jaccard_links(docs: DataFrame, how: Join | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(x, y, x_size, y_size): every link between different sets, by the least ids of the rows that have them (x, y) and
    how many rows those are.

    The same filters as in jaccard_components(), but for all pairs of nodes of a list, those within one component
    too: the answer itself has as many rows as a group of near copies has pairs, so this is for tables without large
    ones, or for what is left of a component.
    """
    how = how or Join()
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    signed = written(_signed(docs, how), "signed")
    counts = docs.sparkSession.sparkContext.broadcast(_sketch(signed))
    classes = written(_classes(signed), "classes")
    postings = written(_postings(docs, how, counts).dropDuplicates(["token", "node"]), "postings")
    a, b = postings.alias("a"), postings.alias("b")
    pairs = a.join(b, F.expr(f"a.token = b.token and a.node < b.node and {_possible(how, 'a', 'b')}")).select(F.col("a.node").alias("x"), F.col("b.node").alias("y"))
    links = _links(written(pairs.distinct(), "pairs"), docs, classes, how, counts)
    side = lambda n: classes.select(F.col("node").alias(n), F.col("least.id").alias(f"{n}_id"), F.col("class_size").alias(f"{n}_size"))
    return links.join(side("x"), "x").join(side("y"), "y").select(F.col("x_id").alias("x"), F.col("y_id").alias("y"), "x_size", "y_size")


def _classes(signed: DataFrame) -> DataFrame:
    """(node, least, slot, class_size): the first row of each set, in the order of ids, null last, then of texts' hashes."""
    least = F.struct(F.col("id").isNull().alias("unknown"), "id", "key")
    found = signed.filter("block is null and n > 0").groupBy("node").agg(F.min(F.struct(least.alias("least"), "slot")).alias("first"), F.count("*").alias("class_size"))
    return found.select("node", "first.least", "first.slot", "class_size")


def _possible(how: Join, a: str, b: str) -> str:
    """SQL for whether two rows of one list, by their sizes and places, can be of linked sets."""
    least = how.overlap(f"{a}.n + {b}.n")
    return f"least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {least} and least({a}.n, {b}.n) >= {least}"


def _closest(rows: DataFrame, heads: DataFrame, possible: Callable[[str, str], str]) -> DataFrame:
    """Pairs (x, y) of each node with the heads of its lists, the HEADS that it shares most of its rows with."""
    met = rows.join(heads.withColumnRenamed("token", "t"), F.col("token") == F.col("t")).alias("a").filter(f"a.node <> a.b.node and {possible('a', 'a.b')}")
    votes = met.groupBy(F.col("a.node").alias("x"), F.col("a.b.node").alias("y")).agg(F.count("*").alias("votes"))
    place = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("votes"), "y"))
    return written(votes.withColumn("place", place).filter(F.col("place") <= HEADS).select("x", "y"), "pairs")


def _open_lists(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of lists whose nodes are in more than one component, with root and major, the list's largest component."""
    placed = attach_roots(shared.drop("posted"), roots)
    by = placed.groupBy("token", "root").agg(F.count("*").alias("k"))
    found = by.groupBy("token").agg(F.max_by("root", F.struct("k", "root")).alias("major"), F.count("*").alias("roots")).filter("roots > 1")
    return placed.join(found.select(F.col("token").alias("t"), "major"), F.col("token") == F.col("t")).drop("t")


def attach_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with the root of their node, which is the node itself where it has no links."""
    named = roots.toDF("__node", "__root")
    joined = rows.join(named, rows["node"] == named["__node"], "left")
    return joined.withColumn("root", F.coalesce("__root", "node")).drop("__node", "__root")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """docs with the first row of each component alone: rows go by their id and text, so that an unlinked text stays
    even if its id is also that of a linked one. Texts without words all stay; rows that repeat the first one's id and text stay with it.

    A map of the rows that go, small enough to broadcast, tells in the scan which rows may be among them; only those move.
    """
    doc, key, maybe = fresh(docs, "__doc", "__key", "__maybe")
    gone = written(jaccard_components(docs).filter("not is_first").select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct(), "gone")
    bits = map_bits(max(1, gone.count()))
    rows = with_flag(docs, map_place(bits, F.col("doc_id"), F.xxhash64("text")), group_map(gone, bits, doc, key), maybe)
    held = rows.filter(maybe).join(gone, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key)), "left_anti")
    return rows.filter(~F.col(maybe)).drop(maybe).unionByName(held.drop(maybe))


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_size")
