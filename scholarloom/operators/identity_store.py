"""Identity resolution batch after batch, on top of what earlier batches stored.

Works, their labels and their external ids are kept in partitions: works and labels by a hash of author and year, ids by a hash of the identity. A
batch reads the partitions its own authors, years and identities fall into, and of these only the works it can meet: those of its blocks and those
that own one of its identities. Titles of other blocks are not read. New works, changed titles, labels, ids, decisions and
review candidates of a batch appear together, with its manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarloom import settings
from scholarloom.operators.identity import BLOCK, Resolution, resolve_identities
from scholarloom.operators.ordered import latest_by
from scholarloom.session import durable
from scholarloom.sources.batches import BatchTables

PARTS = 64
SCHEMAS = {
    "works": "work_id string, title string, author string, year int, part int",
    "labels": "work_id string, label string, part int",
    "ids": "identity string, work_id string, work_part int, part int",
    "decisions": "record_id string, status string, work_id string, version_label string",
    "review": "record_id string, candidate_work_id string, matched_on string",
}


def identity_tables(spark: SparkSession, path: str) -> BatchTables:
    return BatchTables(spark, path, SCHEMAS, {name: ["part"] for name in ("works", "labels", "ids")})


def block_part(work_id: Column) -> Column:
    """Partition of a work: of its author and year, or of its id where it has no block."""
    blocked = F.col("author").isNotNull() & F.col("year").isNotNull()
    return F.pmod(F.when(blocked, F.xxhash64(*BLOCK)).otherwise(F.xxhash64(work_id)), F.lit(PARTS)).cast("int")


def identity_part(identity: Column) -> Column:
    return F.pmod(F.xxhash64(identity), F.lit(PARTS)).cast("int")


def _parts(frame: DataFrame, part: Column) -> list[int]:
    """The partitions that rows fall into, at most ``PARTS``."""
    return [r[0] for r in frame.select(part).distinct().collect()]


def met_state(tables: BatchTables, batch: int, records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(works, ids, labels) of earlier batches that ``records`` can meet; works with the title they show."""
    named = durable(records.select(F.explode("identities").alias("identity")).distinct())
    blocks = durable(records.filter("author IS NOT NULL AND year IS NOT NULL").select(*BLOCK).distinct())
    owned = tables.read("ids", before=batch).filter(F.col("part").isin(_parts(named, identity_part(F.col("identity")))))
    ids = durable(owned.join(named, "identity").select("identity", "work_id", "work_part"))
    parts = sorted({*_parts(blocks, block_part(F.lit(None).cast("string"))), *_parts(ids, F.col("work_part"))})
    rows = tables.read("works", before=batch).filter(F.col("part").isin(parts))
    wanted = rows.join(blocks, BLOCK, "left_semi").select("work_id").unionByName(ids.select("work_id")).distinct()
    works = durable(latest_by(rows.join(wanted, "work_id", "left_semi"), ["work_id"], [F.col("batch")]).select("work_id", "title", "author", "year"))
    labels = tables.read("labels", before=batch).filter(F.col("part").isin(parts)).join(works.select("work_id"), "work_id", "left_semi")
    return works, ids.select("identity", "work_id"), durable(labels.select("work_id", "label"))


def resolve_batch(tables: BatchTables, batch: int, records: DataFrame, *, threshold: float = settings.FUZZY_TITLE_THRESHOLD) -> Resolution:
    """Resolve the records of a batch, which come after those of all earlier ones, and store what they change. A batch that is run again replaces itself."""
    works, ids, labels = met_state(tables, batch, records)
    found = resolve_identities(records, existing_works=works, existing_ids=ids, existing_labels=labels, threshold=threshold)
    now = durable(found.works.select("work_id", "title", F.col("first_author").alias("author"), F.col("year").cast("int").alias("year")).withColumn("part", block_part(F.col("work_id"))))
    changed = now.join(works.select("work_id", "title"), ["work_id", "title"], "left_anti")
    own = now.select("work_id", "part")
    new_labels = found.versions.select("work_id", F.col("version_label").alias("label")).join(labels, ["work_id", "label"], "left_anti").join(own, "work_id")
    new_ids = found.external_ids.select("identity", "work_id").join(ids, ["identity", "work_id"], "left_anti").join(own.withColumnRenamed("part", "work_part"), "work_id")
    frames = {"works": changed, "labels": new_labels, "ids": new_ids.withColumn("part", identity_part(F.col("identity"))), "decisions": found.decisions, "review": found.review}
    tables.write(batch, {name: frame.select(*[c.split()[0] for c in SCHEMAS[name].split(", ")]) for name, frame in frames.items()})
    return found
