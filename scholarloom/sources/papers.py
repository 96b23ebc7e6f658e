"""Atom paper entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarloom.functions.dates import iso_timestamp
from scholarloom.functions.identifiers import normalized_identity
from scholarloom.functions.mentions import repository_links
from scholarloom.functions.text import clean
from scholarloom.sources.records import author_list, finish, identity, payload_text

ENTRY = (
    "id string, updated string, published string, title string, summary string, "
    "author array<struct<name:string>>, category array<struct<_term:string>>, "
    "primary_category struct<_term:string>, doi string, comment string, journal_ref string, license string, "
    "link array<struct<_href:string,_title:string,_type:string>>, _corrupt string"
)
ROOT = "https://arxiv.org/abs/"


def _parsed(payloads: DataFrame) -> DataFrame:
    options = {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}
    read = payloads.withColumn("entry", F.from_xml(payload_text(), ENTRY, options)).withColumn("_id", clean(F.col("entry.id")))
    return read.withColumn("paper", normalized_identity(F.lit("arxiv"), F.coalesce("_id", F.lit(""))))


def landing_identity(payloads: DataFrame) -> DataFrame:
    """Key raw entries: stable id and version, or ``malformed:<hash>`` so that the row is kept."""
    stable = F.col("paper.normalized_value")
    digest = F.substring(F.sha2("payload", 256), 1, 16)
    return _parsed(payloads).select(
        *payloads.columns,
        F.coalesce(stable, F.concat(F.lit("malformed:"), digest)).alias("upstream_id"),
        F.when(stable.isNotNull(), F.coalesce("paper.version_label", F.lit("v1"))).alias("upstream_version"),
        F.coalesce(F.concat(F.lit(ROOT), stable), F.lit("https://arxiv.org/")).alias("canonical_url"),
        iso_timestamp(F.col("entry.published"), strict=True).alias("published_at"),
        iso_timestamp(F.col("entry.updated"), strict=True).alias("updated_at"),
    )


def normalize_papers(landed: DataFrame) -> DataFrame:
    """Papers from landed Atom entries. A DOI that does not parse is dropped, not the record."""
    read = _parsed(landed)
    read = read.withColumns({
        "_doi": clean(F.col("entry.doi")), "_summary": clean(F.col("entry.summary")), "_comment": clean(F.col("entry.comment"))})
    raw_doi = F.col("_doi")
    doi = normalized_identity(F.lit("doi"), F.coalesce(raw_doi, F.lit("")))
    stable = F.col("paper.normalized_value")
    published = iso_timestamp(F.col("entry.published"), strict=True)
    identities = F.filter(
        F.array(
            identity("arxiv", F.col("_id"), stable), identity("doi", raw_doi, doi["normalized_value"])
        ),
        lambda i: i["normalized_value"].isNotNull(),
    )
    links = F.filter(
        "entry.link", lambda k: (k["_title"] == "pdf") | (k["_type"] == "application/pdf")
    )
    summary, comment = F.col("_summary"), F.col("_comment")
    slots = F.transform("entry.author", lambda a: clean(a["name"]))
    fields = {
        "source_key": F.lit("arxiv"),
        "upstream_id": stable,
        "upstream_version": F.coalesce("paper.version_label", "upstream_version", F.lit("v1")),
        "work_type": F.lit("paper"),
        "title": clean(F.col("entry.title")),
        "abstract": summary,
        "canonical_url": F.concat(F.lit(ROOT), stable),
        "publication_status": F.lit("preprint"),
        "published_at": published,
        "updated_at": iso_timestamp(F.col("entry.updated"), strict=True),
        "identities": identities,
        "authors": author_list(slots),
        "source_topics": F.array_distinct(
            F.filter(F.transform("entry.category", lambda c: clean(c["_term"])), lambda t: t.isNotNull())),
        "document_urls": F.filter(F.transform(links, lambda k: clean(k["_href"])), lambda h: h.isNotNull()),
        "repository_urls": repository_links(summary, comment),
        "license_hint": clean(F.col("entry.license")),
        "extra": F.create_map(
            F.lit("primary_category"), clean(F.col("entry.primary_category._term")),
            F.lit("comment"), comment, F.lit("journal_reference"), clean(F.col("entry.journal_ref"))),
    }
    problem = (
        F.when(F.col("entry").isNull() | F.col("entry._corrupt").isNotNull(), "entry is not readable XML")
        .when(stable.isNull(), "missing or malformed preprint id")
        .when(published.isNull(), "missing or invalid published date")
    )
    rules = [
        (F.size("authors") == 0, "at least one author is required"),
        (~F.exists("identities", lambda i: i["id_type"] == "arxiv"), "a preprint identity is required"),
    ]
    return finish(read, fields, problem, rules, broken_status="failed")
