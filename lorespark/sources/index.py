"""An index of chunks whose documents are replaced and deleted at once for all readers."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import lower_plain


class Conflict(RuntimeError):
    """Another writer has switched the index since this one read it."""


def index_rows(chunks: DataFrame) -> DataFrame:
    """chunks of (document_id, chunk_id, header, content, ...) with what an index needs: the text to embed, which is the content
    under its header, hashes of both, and the text to search, in lower case with single spaces."""
    embedded = F.when(F.coalesce(F.length("header"), F.lit(0)) > 0, F.concat_ws("\n\n", "header", "content")).otherwise(F.col("content"))
    rows = chunks.withColumn("embedding_text", embedded).withColumn("content_hash", F.sha2("content", 256))
    return rows.withColumn("embedding_hash", F.sha2("embedding_text", 256)).withColumn("search_text", lower_plain(F.col("embedding_text")))


class ChunkIndex:
    """Chunks by document under a folder that driver and executors share.

    Rows lie in segments that are never changed; a version is a table that names the segment of each document. Versions are
    numbered, and one comes to be by a single rename, which fails if its number is taken: readers see the version
    before or the one after, a writer that fails leaves the index as it was, and of two writers at once one has to
    start again. A version's readers keep it until vacuum() lets it go.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at("versions")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("versions"))]
        return sorted(int(n) for n in names if re.fullmatch(r"\d+", n))

    def documents(self, version: int | None = None) -> DataFrame | None:
        """(document_id, segment) of a version, the last by default; null for an index without any."""
        known = self.versions()
        if not known:
            return None
        return self.spark.read.parquet(f"{self.path}/versions/{known[-1] if version is None else version}")

    def _switch(self, documents: DataFrame, base: int) -> int:
        staged = f"staged/{uuid.uuid4().hex}"
        documents.write.parquet(f"{self.path}/{staged}")
        self._fs.mkdirs(self._at("versions"))
        number = base + 1
        # A rename onto a folder that is there moves into it on some stores, so what is taken is looked at first too.
        if self._fs.exists(self._at("versions", str(number))) or not self._fs.rename(self._at(staged), self._at("versions", str(number))):
            self._fs.delete(self._at(staged), True)
            raise Conflict(f"version {number} is taken")
        return number

    def replace(self, rows: DataFrame, documents: DataFrame | None = None) -> int:
        """A new version in which the documents of rows have these rows and no others. documents: (document_id) that are replaced
        too, so that one without rows loses those it had. Returns the number of the version."""
        known = self.versions()
        base, segment = known[-1] if known else 0, uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/segments/{segment}")
        stored = self.spark.read.schema(rows.schema).parquet(f"{self.path}/segments/{segment}")
        own = stored.select("document_id").distinct().withColumn("segment", F.lit(segment))
        if base:
            gone = own.select("document_id") if documents is None else own.select("document_id").unionByName(documents.select("document_id"))
            own = self.documents(base).join(gone.distinct(), "document_id", "left_anti").unionByName(own)
        return self._switch(own, base)

    def delete(self, documents: DataFrame) -> int:
        """A new version without these documents (document_id)."""
        known = self.versions()
        if not known:
            return 0
        return self._switch(self.documents(known[-1]).join(documents.select("document_id").distinct(), "document_id", "left_anti"), known[-1])

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; null for an index without any."""
        named = self.documents(version)
        if named is None:
            return None
        segments = [r["segment"] for r in named.select("segment").distinct().collect()]
        if not segments:  # all documents were deleted
            segments = [s.getPath().getName() for s in self._fs.listStatus(self._at("segments"))]
        found = self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/segments/{s}" for s in segments])
        where = found.withColumn("segment", F.regexp_extract(F.col("_metadata.file_path"), r"segments/([0-9a-f]{32})/", 1))
        return where.join(named, ["document_id", "segment"]).drop("segment")

    def vacuum(self, keep: int = 1) -> None:
        """Deletes versions but for the last ones, and segments that none of those names."""
        kept = self.versions()[-keep:]
        for number in self.versions()[:-keep]:
            self._fs.delete(self._at("versions", str(number)), True)
        used = {r["segment"] for v in kept for r in self.documents(v).select("segment").distinct().collect()}
        for s in self._fs.listStatus(self._at("segments")) if self._fs.exists(self._at("segments")) else []:
            if s.getPath().getName() not in used:
                self._fs.delete(s.getPath(), True)
