"""Micro-batch ingestion of landed payload files, idempotent by content.

The checkpoint is the cursor: it moves only when the batch it covers is stored. Landed rows, refused rows and counts of a batch become visible together, with its
manifest; a batch that died half-way is run again and leaves nothing twice. There is no watermark: records of any age are accepted, so
dedup is done against the table, not against streaming state.

Most re-reads are told by their keys. A batch first reduces its rows to keys, one per payload, and compares these with the stored keys;
a Bloom filter of the batch's keys, as large as the batch needs, drops stored keys before that join. Only rows whose key is new
are joined back with their payloads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarloom.session import durable
from scholarloom.sources.batches import BatchTables
from scholarloom.sources.landing import PAYLOAD_KEY, address, split_refused

DIGITS = 2
LANDED = ("source_key string, upstream_id string, payload_sha256 string, upstream_version string, canonical_url string, observed_at timestamp, media_type string, payload binary, "
          "byte_size int, observed_date date, extension string, prefix string")
REFUSED = "source_key string, upstream_id string, payload_sha256 string, observed_at timestamp, refused string, payload binary"
COUNTS = "source_key string, seen bigint, created bigint, duplicates bigint, refused bigint"
KEYS = "source_key string, upstream_id string, payload_sha256 string, prefix string"
#: Words of the key sketch, of 64 bits each: ten bits a key for a batch of 400 000 keys. Larger batches only let more stored keys through.
SKETCH_WORDS = 1 << 16


def landed_tables(spark: SparkSession, path: str) -> BatchTables:
    """Landed rows, their keys, refused rows with their reason, and counts per source and batch."""
    return BatchTables(spark, path, {"landed": LANDED, "keys": KEYS, "refused": REFUSED, "counts": COUNTS}, {"landed": ["prefix"]})


def _sketch_bits() -> list[tuple[Column, Column]]:
    """(word, bit) of each of three hashes of a payload key."""
    return [(F.pmod(h, F.lit(SKETCH_WORDS)).cast("int"), F.pmod(F.shiftright(h, 20), F.lit(64)).cast("int"))
            for h in (F.xxhash64(*PAYLOAD_KEY, F.lit(seed)) for seed in range(3))]


def possible_hits(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``stored`` whose key may be among ``keys``. The sketch has at most ``SKETCH_WORDS`` rows and is broadcast, so stored keys are read but not moved."""
    bits = keys.select(F.explode(F.array(*[F.struct(w.alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), b).alias("bit")) for w, b in _sketch_bits()])).alias("b"))
    words = durable(bits.groupBy("b.word").agg(F.bit_or("b.bit").alias("bits")))
    for word, bit in _sketch_bits():
        sketch = F.broadcast(words.select(F.col("word").alias("_word"), F.col("bits").alias("_bits")))
        stored = stored.join(sketch, word == F.col("_word")).filter(F.getbit("_bits", bit) == 1).drop("_word", "_bits")
    return stored


def new_keys(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """(prefix, payload key, first arrival, n, stored): the keys of ``rows``, how often each comes, and whether it is stored; payloads take no part."""
    arrival = F.struct("observed_at", "upstream_version", "canonical_url")
    seen = durable(rows.groupBy("prefix", *PAYLOAD_KEY).agg(F.min(arrival).alias("first"), F.count("*").alias("n")))
    if stored.isEmpty():
        return seen.withColumn("stored", F.lit(False))
    hits = possible_hits(stored, seen).withColumn("stored", F.lit(True))
    return durable(seen.join(hits, ["prefix", *PAYLOAD_KEY], "left").withColumn("stored", F.coalesce("stored", F.lit(False))))


def batch_rows(batch: DataFrame, batch_id: int, tables: BatchTables) -> dict[str, DataFrame]:
    """The rows a batch adds to each of ``tables``: new payloads, their keys, refused rows, counts per source."""
    rows, refused = split_refused(address(batch))
    rows = rows.withColumn("prefix", F.substring("payload_sha256", 1, DIGITS))
    key = ["prefix", *PAYLOAD_KEY]
    keys = new_keys(rows, tables.read("keys", before=batch_id).select(*key))
    fresh = durable(keys.filter("NOT stored").select(*key, "first.*"))
    # The new keys are stored by now: where they are few, as in a batch of repeats, they are broadcast and no payload moves.
    same = [F.col(f"r.{n}").eqNullSafe(F.col(f"f.{n}")) for n in [*key, "observed_at", "upstream_version", "canonical_url"]]
    found = rows.alias("r").join(fresh.alias("f"), same, "left_semi").repartition("prefix")
    one = Window.partitionBy(*key).orderBy("media_type")  # by prefix already, so nothing moves again
    landed = found.withColumn("_copy", F.row_number().over(one)).filter("_copy = 1")
    kept = keys.groupBy("source_key").agg(F.sum("n").alias("seen"), F.count_if(~F.col("stored")).alias("created"), F.lit(0).cast("bigint").alias("refused"))
    turned = refused.groupBy("source_key").agg(F.count("*").alias("seen"), F.lit(0).cast("bigint").alias("created"), F.count("*").alias("refused"))
    counts = kept.unionByName(turned).groupBy("source_key").agg(F.sum("seen").alias("seen"), F.sum("created").alias("created"), F.sum("refused").alias("refused"))
    frames = {"landed": landed, "keys": fresh, "refused": refused,
              "counts": counts.withColumn("duplicates", F.col("seen") - F.col("created") - F.col("refused"))}
    return {name: frame.select(*[c.split()[0] for c in tables.schemas[name].split(", ")]) for name, frame in frames.items()}


def store_batch(batch: DataFrame, batch_id: int, table: str) -> None:
    """Store the rows of a batch that are not stored yet, its refused rows and its counts, as one batch of ``landed_tables``. A batch that has ended is not stored again."""
    tables = landed_tables(batch.sparkSession, table)
    if not tables.ended(batch_id):
        tables.write(batch_id, batch_rows(batch, batch_id, tables))


def ingest_files(
    source: DataFrame, table: str, checkpoint: str, *, prepare: Callable[[DataFrame], DataFrame] = lambda frame: frame,
    store: Callable[[DataFrame, int, str], None] = store_batch,
):
    """Start a run over the files that have arrived; ``source`` is a streaming frame."""
    return (
        source.writeStream.foreachBatch(lambda batch, batch_id: store(prepare(batch), batch_id, table))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
