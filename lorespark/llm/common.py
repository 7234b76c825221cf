"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space as the contracts name it: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and all run in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lorespark/{name}-{uuid.uuid4().hex}"


#: While a table is written: shuffle files go when the job ends, not when the driver collects garbage, and the driver
#: makes no long descriptions of each change that adaptive execution makes to a plan.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.ui.explainMode": "simple", "spark.sql.maxPlanStringLength": "20000"}
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and survives lost executors. options: those of the writer."""
    spark = df.sparkSession
    small_batches(spark)
    path, before = new_path(spark, name), {k: spark.conf.get(k) for k in WHILE_WRITING}
    for key, value in WHILE_WRITING.items():
        spark.conf.set(key, value)
    try:
        df.write.options(**options).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def written_and_seen(df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, tuple]:
    """written(df), and aggregates of df that the same job takes."""
    seen = Observation()
    named = [m.alias(f"m{i}") for i, m in enumerate(measures)]
    out = written(df.observe(seen, *named), name)
    return out, tuple(seen.get.get(f"m{i}") for i in range(len(measures)))


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that written() made and that no later job reads."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/lorespark/" in path:
                target = spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df does not have yet, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def extended(df: DataFrame | StructType, name: str, kind: str) -> StructType:
    """df's schema with one more column; df.schema itself is left alone."""
    fields = df.fields if isinstance(df, StructType) else df.schema.fields
    return StructType([*fields, *StructType.fromDDL(f"`{name}` {kind}").fields])


def small_batches(spark: SparkSession) -> None:
    """From here on Python workers get batches of 8 MB at most, also when a caller runs the plan later."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_BYTES)) > 1 << 23:
        spark.conf.set(BATCH_BYTES, str(1 << 23))


def returned(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, after which the Python worker gives freed memory back: it lives on and serves later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(text, UPPER, LOWER)


def placed(df: DataFrame, keys: list[Column], name: str, rows: int) -> DataFrame:
    """df with name, the place of each row from 0 in the order of keys: rows go to ranges of keys, each range is sorted by
    itself, and sums of the ranges' sizes tell where each begins. rows: about how many df has; a range gets about a
    million. keys should tell rows apart, or the places of equal ones are any. The starts, one row a range, are broadcast.
    """
    (at,) = fresh(df, "__at")
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (rows >> 20) + 1)
    ranged = written(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()), "ranged")
    sizes = ranged.groupBy(F.shiftright(at, 33).alias("__range")).agg(F.count("*").alias("__size"))
    starts = sizes.select("__range", F.coalesce(F.sum("__size").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    joined = ranged.join(F.broadcast(starts), F.shiftright(at, 33) == F.col("__range"))
    return joined.select(*df.columns, (F.col("__start") + F.col(at).bitwiseAND((1 << 33) - 1)).alias(name))


def map_bits(groups: int) -> int:
    """The bits of a map of so many groups: 16 for each, at least 65,536 and at most 2 ** 26: a million rows to broadcast.

    Beyond 4 million groups the map lets through more rows that no group has; no result depends on it.
    """
    return 1 << min(26, max(16, (16 * groups - 1).bit_length()))


def map_place(bits: int, *keys: Column) -> Column:
    """The bit of a group in a map."""
    return F.pmod(F.xxhash64(*keys), F.lit(bits))


def group_map(groups: DataFrame, bits: int, *keys: str) -> DataFrame:
    """A map (cell, bits) of the groups, small enough to broadcast. Groups may share a bit."""
    places = groups.select(map_place(bits, *map(F.col, keys)).alias("place"))
    return places.groupBy(F.expr("place div 64").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits"))


def with_flag(rows: DataFrame, place: Column, groups: DataFrame, name: str) -> DataFrame:
    """rows with a flag that is true where place is set in the map, and so for all rows of its groups and few others."""
    at, cell, bits = fresh(rows, "__place", "__cell", "__bits")
    joined = rows.withColumn(at, place).join(F.broadcast(groups.toDF(cell, bits)), F.expr(f"`{at}` div 64") == F.col(cell), "left")
    return joined.withColumn(name, F.coalesce(F.expr(f"getbit(`{bits}`, cast(`{at}` % 64 as int)) = 1"), F.lit(False))).drop(at, cell, bits)


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, total: int, top: int = 4096) -> DataFrame:
    """rows with the columns that groups has for their keys (null where it has none).

    groups has one row per key, and total is at least the sum of its column weight. Keys with more than 1/top of
    the total, of which there are fewer than top, are joined by broadcast, so that a key with a third of all rows
    moves nothing; all others go by a shuffle. Keys compare null-safe.
    """
    values = [c for c in groups.columns if c not in keys]
    names = [f"__k{i}" for i in range(len(keys))]

    def side(df: DataFrame, as_: str) -> DataFrame:
        return df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.struct(*values).alias(as_))

    def same(left: DataFrame, right: DataFrame) -> Column:
        out = F.lit(True)
        for k, n in zip(keys, names, strict=True):
            out = out & left[k].eqNullSafe(right[n])
        return out

    hot = side(groups.filter(F.col(weight) * top > total), "__hot")
    half = rows.join(F.broadcast(hot), same(rows, hot), "left").drop(*names)
    half = half.withColumn("__salt", F.when(F.col("__hot").isNull(), F.lit(-1)).otherwise(F.monotonically_increasing_id() % 65536))
    cold = side(groups, "__cold").withColumn("__none", F.lit(-1).cast("long"))
    full = half.join(cold, same(half, cold) & (half["__salt"] == cold["__none"]), "left")
    return full.select(*[rows[c] for c in rows.columns], *[F.coalesce(F.col(f"__hot.{v}"), F.col(f"__cold.{v}")).alias(v) for v in values])
