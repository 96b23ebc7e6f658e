"""Review-platform notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarloom.functions.mentions import paper_mentions, repository_mentions
from scholarloom.functions.text import casefold, clean
from scholarloom.sources.records import (
    author_list, finish, identity, json_flag, json_kind, json_text, paper_identities, payload_text,
)


def _field(note: Column, name: str) -> Column:
    """Text of a content field, plain or wrapped as ``{"value": ...}``."""
    return F.coalesce(json_text(note, f"$.content.{name}.value"), json_text(note, f"$.content.{name}"))


def normalize_notes(landed: DataFrame) -> DataFrame:
    """Papers from review notes. Blind notes keep no author; acceptance needs a public decision."""
    read = landed.withColumn("note", F.try_parse_json(payload_text()))
    note = F.col("note")
    read = read.withColumns({"_title": _field(note, "title"), "_abstract": _field(note, "abstract")})
    title, abstract = F.col("_title"), F.col("_abstract")
    venue = F.coalesce(_field(note, "venue"), _field(note, "venueid"))
    decision = _field(note, "decision")
    wrapped = json_kind(note, "$.content.authors.value").startswith("ARRAY")
    listed = wrapped | json_kind(note, "$.content.authors").startswith("ARRAY")
    blind = json_flag(note, "$.nonreaders") | ~listed
    raw = F.when(wrapped, F.try_variant_get(note, "$.content.authors.value", "array<variant>")).otherwise(
        F.try_variant_get(note, "$.content.authors", "array<variant>"))
    names = F.transform(raw, lambda a: clean(
        F.when(F.schema_of_variant(a) == "STRING", F.try_variant_get(a, "$", "string"))))
    public = F.transform(names, lambda n: F.when(~casefold(n).contains("anonymous"), n))
    outcome = casefold(F.concat_ws(" ", venue, decision))
    text = F.concat_ws(" ", title, abstract)
    read = read.withColumn("_papers", paper_mentions(text))
    papers = F.col("_papers")
    own = F.array(identity("openreview", F.col("upstream_id"), F.col("upstream_id")))
    fields = {
        "source_key": F.lit("openreview"),
        "upstream_id": F.col("upstream_id"),
        "upstream_version": F.col("upstream_version"),
        "work_type": F.lit("paper"),
        "title": title,
        "abstract": abstract,
        "canonical_url": F.col("canonical_url"),
        "publication_status": F.when(outcome.contains("accept"), "accepted").otherwise("submitted"),
        "published_at": F.col("published_at"),
        "updated_at": F.col("updated_at"),
        "identities": F.concat(own, paper_identities(papers)),
        "authors": F.when(~blind, author_list(public)),
        "source_topics": F.when(venue.isNotNull(), F.array(venue)),
        "repository_urls": repository_mentions(text),
        "extra": F.create_map(
            F.lit("venue"), venue, F.lit("decision"), decision, F.lit("blind"), blind.cast("string"),
            F.lit("arxiv_ids"), F.array_join(papers, ",")),
    }
    problem = F.when(~json_kind(note, "$").startswith("OBJECT"), "note is not a JSON object")
    rules = [
        (~F.col("canonical_url").startswith("https://openreview.net/forum?id="),
         "canonical URL must be on the review platform"),
        ((F.col("publication_status") == "accepted") & F.col("extra")["decision"].isNull(),
         "accepted status requires public decision evidence"),
    ]
    return finish(read, fields, problem, rules)
