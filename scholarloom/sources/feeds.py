"""Feed posts (RSS items and Atom entries)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarloom.functions.mentions import paper_mentions, repository_mentions, transcript_mentions
from scholarloom.functions.text import clean
from scholarloom.sources.records import finish, identity, paper_identities, payload_text

VIDEO_SOURCE = "youtube"


def _element(xml: Column, local: str) -> Column:
    """Text of the first element with that local name, at any depth."""
    return clean(F.xpath_string(xml, F.lit(f"(//*[local-name()='{local}'])[1]")))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def normalize_posts(landed: DataFrame, allowed_hosts: list[str], kind: str = "official_post") -> DataFrame:
    """Posts with their paper, repository and (for video feeds) transcript mentions."""
    options = {"columnNameOfCorruptRecord": "_corrupt", "ignoreNamespace": "true"}
    probe = F.from_xml(payload_text(), "_corrupt string, _probe string", options)
    read = landed.withColumn("_read", probe)
    broken = F.col("_read").isNull() | F.col("_read._corrupt").isNotNull()
    # XPath fails on broken XML, so it only sees what the parser has accepted.
    read = read.withColumn("xml", F.when(~broken, payload_text()))
    xml = F.col("xml")
    read = read.select(
        *landed.columns, "xml", _element(xml, "title").alias("_title"),
        F.coalesce(_element(xml, "description"), _element(xml, "summary"), _element(xml, "content")).alias("_body"),
    )
    text = F.concat_ws(" ", "_title", "_body")
    read = read.withColumn("_papers", paper_mentions(text))
    papers = F.col("_papers")
    video = F.col("source_key") == VIDEO_SOURCE
    url = F.col("canonical_url")
    fields = {
        "source_key": F.col("source_key"),
        "upstream_id": F.col("upstream_id"),
        "upstream_version": F.col("upstream_version"),
        "work_type": F.lit("article"),
        "title": F.col("_title"),
        "abstract": F.col("_body"),
        "canonical_url": url,
        "publication_status": F.lit("published"),
        "published_at": F.col("published_at"),
        "updated_at": F.col("updated_at"),
        "identities": F.concat(F.array(identity("url", url, url)), paper_identities(papers)),
        "document_urls": F.when(video, transcript_mentions(text)),
        "repository_urls": repository_mentions(text),
        "extra": F.create_map(
            F.lit("arxiv_ids"), F.array_join(papers, ","), F.lit("kind"), F.lit(kind),
            F.lit("transcript_policy"), F.when(video, "publisher_linked_only")),
    }
    return finish(read, fields, F.when(F.col("xml").isNull(), "post is not readable XML"), [
        (~url_host(F.col("canonical_url")).isin(allowed_hosts), "post URL is outside the feed's own hosts")])
