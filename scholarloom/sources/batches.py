"""Tables that grow by batches, each of which appears whole or not at all.

A batch writes its rows into folders of its own and, last, one manifest row per table that names them. Readers take the folders that a
manifest names and nothing else: a batch that dies before its manifest leaves files nobody reads, and one that is run again
writes new folders and a new manifest, of which the newest counts. So a table, its refused rows and its counts always belong together.

A manifest is a handful of rows; the list of all manifests is the list of folders a reader opens. ``compact`` writes all batches into one.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "batch bigint, attempt string, written_at timestamp, name string, folder string, row_count bigint, replaces bigint"


class BatchTables:
    """Named tables below ``path``. ``schemas``: DDL of each; ``parts``: columns each is partitioned by, if any."""

    def __init__(self, spark: SparkSession, path: str, schemas: Mapping[str, str], parts: Mapping[str, Sequence[str]] | None = None) -> None:
        self.spark, self.path, self.schemas, self.parts = spark, path.rstrip("/"), dict(schemas), dict(parts or {})

    def manifests(self) -> DataFrame:
        """The rows of the newest attempt of every batch that ended and that no later batch replaced."""
        try:
            found = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/*")
        except Exception as error:  # the folder appears with the first batch
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], MANIFEST)
        newest = found.groupBy("batch").agg(F.max_by("attempt", F.struct("written_at", "attempt")).alias("attempt"))
        last = found.agg(F.coalesce(F.max("replaces"), F.lit(-(2**63))).alias("_last"))
        return found.join(newest, ["batch", "attempt"]).crossJoin(F.broadcast(last)).filter("batch > _last OR replaces = _last").drop("_last")

    def ended(self, batch: int) -> bool:
        return not self.manifests().filter(F.col("batch") == batch).isEmpty()

    def read(self, name: str, *, before: int | None = None) -> DataFrame:
        """All rows of a table with their ``batch``; those of batches below ``before``, if it is given."""
        rows = self.manifests().filter(F.col("name") == name)
        if before is not None:
            rows = rows.filter(F.col("batch") < before)
        folders = [r.folder for r in rows.select("folder").collect()]
        schema = f"{self.schemas[name]}, batch bigint"
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/rows/{name}").parquet(*folders).drop("attempt")

    def write_rows(self, batch: int, tables: Mapping[str, DataFrame]) -> dict[str, str]:
        """Write the rows of a batch where no reader looks yet; returns the folder of each table."""
        attempt, folders = uuid.uuid4().hex, {}
        for name, frame in tables.items():
            folders[name] = f"{self.path}/rows/{name}/attempt={attempt}/batch={batch}"
            parts = self.parts.get(name, ())
            (frame.write.partitionBy(*parts) if parts else frame.write).parquet(folders[name])
        return folders

    def seal(self, batch: int, folders: Mapping[str, str], *, replaces: int | None = None) -> None:
        """Make the folders of a batch the ones that count, all at once. Counts are taken from what was written."""
        attempt, manifest = uuid.uuid4().hex, None
        for name, folder in folders.items():
            row = self.spark.read.schema(self.schemas[name]).parquet(folder).agg(F.count("*").alias("row_count")).select(
                F.lit(batch).cast("bigint").alias("batch"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("written_at"), F.lit(name).alias("name"),
                F.lit(folder).alias("folder"), "row_count", F.lit(replaces).cast("bigint").alias("replaces"))
            manifest = row if manifest is None else manifest.unionByName(row)
        manifest.coalesce(1).write.parquet(f"{self.path}/manifests/{attempt}")

    def write(self, batch: int, tables: Mapping[str, DataFrame], *, replaces: int | None = None) -> None:
        self.seal(batch, self.write_rows(batch, tables), replaces=replaces)

    def compact(self, batch: int) -> None:
        """One batch ``batch``, above all others, with the rows of all of them; readers see the old batches or the new one."""
        self.write(batch, {name: self.read(name).drop("batch") for name in self.schemas}, replaces=batch)
