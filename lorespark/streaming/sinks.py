"""A stream to several sinks at once, each independent of the others, and what none of them kept to a spool that is replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Sink = Callable[[DataFrame, str], None]


class Lost(RuntimeError):
    """No durable sink and no spool kept a batch."""


def table_sink(path: str) -> Sink:
    """Rows as files under path, those of one batch in a folder of their own: a batch that runs again replaces what it wrote."""

    def write(rows: DataFrame, batch: str) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """What table_sink() wrote, without the number of the batch."""
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


def fan_out(sinks: dict[str, Sink], durable: list[str], spool: str | None, log: str, label: str = "stream") -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that gives each batch to all sinks.

    A sink that fails is noted and holds up no other. If none of the durable ones took the batch, it goes to the spool; if
    that fails too, or there is none, the batch fails and the stream runs it again. Batches are known by label and number,
    so what ran before is replaced. log gets a row for each sink and batch: (batch, sink, kept, error).
    """

    def write(rows: DataFrame, number: int) -> None:
        batch, outcomes = f"{label}-{number}", []
        rows = rows.persist()
        try:
            for name, sink in sinks.items():
                try:
                    sink(rows, batch)
                    outcomes.append((batch, name, True, None))
                except Exception as error:  # noqa: BLE001 - whatever a sink does, others go on
                    outcomes.append((batch, name, False, type(error).__name__))
            kept = any(ok for _, name, ok, _ in outcomes if name in durable)
            if not kept and spool is not None:
                try:
                    table_sink(spool)(rows, batch)
                    kept = True
                    outcomes.append((batch, "spool", True, None))
                except Exception as error:  # noqa: BLE001 - noted first, then the batch fails
                    outcomes.append((batch, "spool", False, type(error).__name__))
            rows.sparkSession.createDataFrame(outcomes, "batch string, sink string, kept boolean, error string").coalesce(1).write.mode("overwrite").parquet(f"{log}/of={batch}")
        finally:
            rows.unpersist()
        if not kept:
            raise Lost(batch)

    return write


def run(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """The stream through a function of batches, to the end of what is there."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replay(spark: SparkSession, spool: str, schema, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """What lies in the spool and was not replayed yet, as a stream of its files. A batch that fails again stays for the next
    replay, as its checkpoint does not move on. A spool that is not there has nothing."""
    root = spark._jvm.org.apache.hadoop.fs.Path(spool)
    if root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        files = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 64).parquet(spool)
        run(files, checkpoint, write)


def durability(spark: SparkSession, log: str) -> DataFrame:
    """(sink, kept, failed, healthy) over all batches; healthy if the last one was kept."""
    rows = spark.read.parquet(f"{log}/of=*").withColumn("number", F.regexp_extract("batch", r"(\d+)$", 1).cast("long"))
    return rows.groupBy("sink").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("failed"), F.max_by("kept", "number").alias("healthy"))
