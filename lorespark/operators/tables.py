"""Tables in the shared folder, which cut lineage between rounds of joins and survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..streaming.runs import shared_path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() made and no later job reads."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
