"""A stored term index that is kept up by batches: segments of postings sorted by term, tombstones, merge on read, compaction.

A batch holds the postings and the texts of the entities it rebuilds, and one tombstone for every entity it rebuilds or deletes. A tombstone
puts out the rows of that entity in earlier batches, so a batch is as large as what it changes, and a reader sees

    the rows of a batch whose entity has no tombstone of a later batch.

Texts are written first, each row with a number of its own in the batch. Postings are cut from what was written and hold the number, not the id, which as a
hash would be most of a posting; readers get the ids back by one join of the postings they keep with the numbers of the rows that are in.
Postings are range-partitioned by (term, entity), so that the postings of a frequent term are spread over many files, and each file is
listed with its first and last term. A prefix opens the files whose range it can fall into, whatever the number of segments and files.
Rows, tombstones, texts and file ranges of a batch appear together, with its manifest (``sources/batches.py``); a batch that is run again replaces itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarloom.operators.search import field_terms, matching_ids, query_tokens
from scholarloom.session import durable
from scholarloom.sources.batches import BatchTables

STORED = "term string, field string, entity bigint"


def may_hold(prefix: str) -> Column:
    """Whether a file between ``first_term`` and ``last_term`` can hold a term that starts with ``prefix``; order is that of code points."""
    return (F.col("last_term") >= prefix) & (F.substring("first_term", 1, len(prefix)) <= prefix)


class TermIndex:
    """Index below ``path`` of entities with the text columns ``fields``."""

    def __init__(self, spark: SparkSession, path: str, fields: Sequence[str]) -> None:
        self.spark, self.fields = spark, list(fields)
        texts = ", ".join(f"{name} string" for name in self.fields)
        self.tables = BatchTables(spark, path, {
            "postings": STORED, "texts": f"entity bigint, entity_id string, {texts}", "tombstones": "entity_id string",
            "ranges": "file string, first_term string, last_term string, posting_count bigint"})

    def _write(self, batch: int, texts: DataFrame, tombstones: DataFrame, *, replaces: int | None = None) -> None:
        numbered = texts.select(F.monotonically_increasing_id().alias("entity"), "entity_id", *self.fields)
        folders = self.tables.write_rows(batch, {"texts": numbered, "tombstones": tombstones})
        stored = self.spark.read.schema(self.tables.schemas["texts"]).parquet(folders["texts"])
        # Range partitioning reads its rows twice, first for the ranges, so the words are cut once and written.
        cut = durable(field_terms(stored, "entity", self.fields))
        postings = cut.select(F.explode("terms").alias("term"), "field", F.col("entity_id").alias("entity"))
        folders |= self.tables.write_rows(batch, {"postings": postings.repartitionByRange("term", "entity").sortWithinPartitions("term", "entity", "field")})
        written = self.spark.read.schema(self.tables.schemas["postings"]).parquet(folders["postings"])
        at, name = F.col("_metadata.row_index"), F.col("_metadata.file_name").alias("name")
        # A file is sorted by term, so its first and last row have its first and last term.
        counts = written.groupBy(name).agg(F.count("*").alias("posting_count"))
        ends = written.select(name, at.alias("at"), "term").join(F.broadcast(counts), "name").filter("at = 0 OR at = posting_count - 1")
        ranges = ends.groupBy("name", "posting_count").agg(F.min("term").alias("first_term"), F.max("term").alias("last_term"))
        named = ranges.select(F.concat(F.lit(folders["postings"] + "/"), "name").alias("file"), "first_term", "last_term", "posting_count")
        self.tables.seal(batch, folders | self.tables.write_rows(batch, {"ranges": named.coalesce(1)}), replaces=replaces)

    def refresh(self, batch: int, rebuilt: DataFrame, changed: DataFrame) -> None:
        """Batch ``batch``: the entities of ``changed`` (entity_id) are put out, those of ``rebuilt`` (entity_id and texts) are in from now on.

        An entity of ``changed`` without a row in ``rebuilt`` is deleted. Entities of ``rebuilt`` need not be listed in ``changed``.
        """
        out = changed.select("entity_id").unionByName(rebuilt.select("entity_id")).filter("entity_id IS NOT NULL").distinct()
        self._write(batch, rebuilt.filter("entity_id IS NOT NULL"), out)

    def _alive(self) -> DataFrame:
        """The rows of all batches (with ``batch`` and the number ``entity``) without those that a later tombstone puts out. The first batch has nothing to put out."""
        first = self.tables.manifests().agg(F.min("batch")).first()[0]
        later = self.tables.read("tombstones").filter(F.col("batch") > F.lit(first)).groupBy("entity_id").agg(F.max("batch").alias("_out"))
        return self.tables.read("texts").join(later, "entity_id", "left").filter("_out IS NULL OR batch >= _out").drop("_out")

    def texts(self) -> DataFrame:
        """(entity_id, fields) as they are now."""
        return self._alive().select("entity_id", *self.fields)

    def files(self, prefixes: Sequence[str]) -> list[str]:
        """The posting files that can hold a term with one of ``prefixes``."""
        fits = F.lit(False)
        for prefix in prefixes:
            fits = fits | may_hold(prefix)
        return sorted(r.file for r in self.tables.read("ranges").filter(fits).select("file").collect())

    def postings(self, prefixes: Sequence[str] = ("",)) -> DataFrame:
        """(term, field, entity_id) as they are now; terms without any of ``prefixes`` are left out. Only files that can hold them are opened."""
        files, schema = self.files(prefixes), f"{self.tables.schemas['postings']}, batch bigint"
        if not files:
            return self.spark.createDataFrame([], "term string, field string, entity_id string")
        starts = F.lit(False)
        for prefix in prefixes:
            starts = starts | F.col("term").startswith(prefix)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.tables.path}/rows/postings").parquet(*files)
        names = self._alive().select("batch", "entity", "entity_id")
        return rows.filter(starts).select("term", "field", "entity", "batch").join(names, ["batch", "entity"]).select("term", "field", "entity_id")

    def matching(self, text: str) -> DataFrame:
        """(entity_id): every token of ``text`` starts some term of the entity."""
        return matching_ids(self.postings(query_tokens(text)), text)

    def compact(self, batch: int) -> None:
        """One segment in place of all, as batch ``batch`` (above all others): rows that were put out and tombstones are left behind."""
        self._write(batch, self.texts(), self.spark.createDataFrame([], self.tables.schemas["tombstones"]), replaces=batch)
