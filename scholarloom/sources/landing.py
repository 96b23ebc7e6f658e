"""Landing raw payloads: content address, limits, verification, dedup and merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAYLOAD_KEY = ["source_key", "upstream_id", "payload_sha256"]
# The file type a media type is stored under.
EXTENSIONS = {
    "application/atom+xml": ".xml", "application/json": ".json", "application/xml": ".xml", "text/xml": ".xml",
}


def address(payloads: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Add payload_sha256, byte_size, observed_date, extension and the reason a row cannot be landed."""
    media = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    size = F.octet_length("payload")
    return payloads.select(
        "*",
        F.sha2("payload", 256).alias("payload_sha256"),
        size.alias("byte_size"),
        F.to_date("observed_at").alias("observed_date"),
        F.coalesce(F.try_element_at(media, F.lower("media_type")), F.lit(".bin")).alias("extension"),
        # Fixed value: the pattern of a source key.
        F.when(~F.coalesce(F.col("source_key").rlike("^[a-z0-9][a-z0-9_-]{0,127}$"), F.lit(False)), "unsafe source key")
        .when(F.lit(False) if max_bytes is None else size > max_bytes, "payload too large").alias("refused"),
    )


def split_refused(addressed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to land, refused rows)."""
    return addressed.filter("refused IS NULL").drop("refused"), addressed.filter("refused IS NOT NULL")


def write_landed(landed: DataFrame, path: str) -> None:
    """Append below ``source_key=/observed_date=``; files of a hot source are split by size."""
    landed.write.mode("append").partitionBy("source_key", "observed_date").parquet(path)


def verify(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(intact rows, rows whose payload no longer has its stored hash)."""
    checked = landed.withColumn("_intact", F.sha2("payload", 256) == F.col("payload_sha256"))
    return checked.filter("_intact").drop("_intact"), checked.filter("NOT _intact").drop("_intact")


def first_of_key(rows: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """First row of each key in arrival order, and how many rows the key had, as ``sightings``."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*arrival)).alias("_row"), F.count("*").alias("sightings")
    )
    return first.select(*keys, "_row.*", "sightings")


def only_new(batch: DataFrame, existing: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """Rows of ``batch`` whose key is not stored yet, one per key."""
    return first_of_key(batch, keys, arrival).drop("sightings").join(existing.select(*keys), keys, "left_anti")


def ingest_totals(batch: DataFrame, existing: DataFrame, by: list[str]) -> DataFrame:
    """Seen, created and duplicate counts; ``by`` must be part of the payload key."""
    seen = batch.groupBy(*PAYLOAD_KEY).agg(F.count("*").alias("n"))
    stored = existing.select(*PAYLOAD_KEY).distinct().withColumn("stored", F.lit(True))
    marked = seen.join(stored, PAYLOAD_KEY, "left")
    created = F.count_if(F.col("stored").isNull())
    return marked.groupBy(*by).agg(
        F.sum("n").alias("seen"), created.alias("created"), (F.sum("n") - created).alias("duplicates")
    )


def merge_rows(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Table after ``incoming`` (unique on ``keys``) replaced the rows with the same key."""
    return existing.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def within_window(records: DataFrame, since: Column, until: Column) -> DataFrame:
    """Records updated in the window; undated ones are kept."""
    updated = F.col("updated_at")
    return records.filter(updated.isNull() | ((updated >= since) & (updated <= until)))


def route_documents(
    files: DataFrame, *, signature: bytes = b"%PDF-", media_types: tuple[str, ...] = ("application/pdf",),
    max_bytes: int | None = None,
) -> DataFrame:
    """Content hash, error code and outcome (``succeeded``, ``failed``, ``quarantined``) per fetched file.

    Media type is checked first, then size, then the signature; only the last one quarantines.
    """
    media = F.lower(F.trim(F.split("media_type", ";")[0]))
    size = F.octet_length("content")
    start = F.substring(F.col("content"), 1, len(signature)) == F.lit(signature)
    code = (
        F.when(~F.coalesce(media.isin(*media_types), F.lit(False)), "INVALID_MEDIA_TYPE")
        .when(F.lit(False) if max_bytes is None else size > max_bytes, "DOCUMENT_TOO_LARGE")
        .when(~start, "INVALID_PDF_SIGNATURE")
    )
    return files.withColumn("sha256", F.sha2("content", 256)).withColumn("byte_size", size).withColumn(
        "error_code", code
    ).withColumn(
        "status",
        F.when(F.col("error_code").isNull(), "succeeded")
        .when(F.col("error_code") == "INVALID_PDF_SIGNATURE", "quarantined").otherwise("failed"),
    )


def stored_documents(routed: DataFrame) -> DataFrame:
    """One row per distinct accepted content and version."""
    kept = routed.filter("status = 'succeeded'")
    return first_of_key(kept, ["version_id", "sha256"], ["acquired_at", "source_url"]).drop("sightings")
