"""User-supplied social exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarloom import settings
from scholarloom.functions.dates import any_timestamp
from scholarloom.functions.mentions import paper_mentions, repository_mentions
from scholarloom.sources.feeds import url_host
from scholarloom.sources.records import (
    finish, identity, json_kind, json_text, paper_identities, payload_text,
)


def exported_items(payloads: DataFrame) -> DataFrame:
    """Items that may be landed: id, text and an https URL on an allowed host; the others are left out."""
    doc = F.try_parse_json(payload_text())
    read = payloads.withColumn("_doc", doc)
    item = F.col("_doc")
    number = F.when(
        json_kind(item, "$.created_at").isin("BIGINT", "DOUBLE") | json_kind(item, "$.created_at").startswith("DECIMAL"),
        F.try_variant_get(item, "$.created_at", "double"))
    created = any_timestamp(json_text(item, "$.created_at"), number)
    keyed = read.select(
        *payloads.columns, json_text(item, "$.id").alias("upstream_id"), json_text(item, "$.url").alias("canonical_url"),
        json_text(item, "$.text").alias("_text"), created.alias("published_at"), created.alias("updated_at"),
    )
    allowed = F.col("canonical_url").startswith("https://") & url_host(F.col("canonical_url")).isin(settings.SOCIAL_HOSTS)
    return keyed.filter(allowed & F.col("upstream_id").isNotNull() & F.col("_text").isNotNull()).drop("_text")


def normalize_social(landed: DataFrame) -> DataFrame:
    """Posts whose title is their first 160 characters and whose body is the whole text."""
    read = landed.withColumn("doc", F.try_parse_json(payload_text()))
    doc = F.col("doc")
    read = read.withColumn("_text", F.when(json_kind(doc, "$.text") != "VOID", F.try_variant_get(doc, "$.text", "string")))
    text = F.col("_text")
    read = read.withColumn("_papers", paper_mentions(text))
    papers = F.col("_papers")
    url = F.col("canonical_url")
    fields = {
        "source_key": F.lit("x-watchlist"),
        "upstream_id": F.col("upstream_id"),
        "work_type": F.lit("article"),
        "title": F.substring(text, 1, 160),
        "abstract": text,
        "canonical_url": url,
        "publication_status": F.lit("published"),
        "published_at": F.col("published_at"),
        "updated_at": F.col("updated_at"),
        "identities": F.concat(F.array(identity("url", url, url)), paper_identities(papers)),
        "repository_urls": repository_mentions(text),
        "extra": F.create_map(F.lit("origin"), F.lit("user_supplied_export"), F.lit("author"), json_text(doc, "$.author")),
    }
    return finish(read, fields, F.when(text.isNull(), "export item has no text"), [
        (~url_host(F.col("canonical_url")).isin(settings.SOCIAL_HOSTS), "URL is not on an allowed social host")])
