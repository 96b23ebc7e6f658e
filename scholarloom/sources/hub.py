"""Model-hub items (models, datasets, spaces)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarloom import settings
from scholarloom.functions.text import casefold
from scholarloom.sources.records import (
    finish, identity, json_integer, json_kind, json_strings, json_text, paper_identities, payload_text,
)


def normalize_hub(landed: DataFrame) -> DataFrame:
    """Items wrapped as ``{"kind", "item"}``; ``arxiv:`` tags become identities."""
    read = landed.withColumn("doc", F.try_parse_json(payload_text()))
    doc = F.col("doc")
    kind = F.try_variant_get(doc, "$.kind", "string")
    item = F.when(json_kind(doc, "$.item.id") != "VOID", F.try_variant_get(doc, "$.item.id", "string"))
    tags = json_strings(doc, "$.item.tags")
    marked = F.filter(tags, lambda t: casefold(t).startswith("arxiv:"))
    papers = F.array_distinct(F.transform(marked, lambda t: casefold(F.regexp_replace(t, "^[^:]*:", ""))))
    types = F.create_map(*[F.lit(x) for pair in settings.HUB_KINDS.items() for x in pair])
    name = F.concat_ws(":", kind, item)
    fields = {
        "source_key": F.lit("huggingface"),
        "upstream_id": F.col("upstream_id"),
        "upstream_version": F.col("upstream_version"),
        "work_type": F.try_element_at(types, kind),
        "title": item,
        "canonical_url": F.col("canonical_url"),
        "publication_status": F.lit("published"),
        "published_at": F.col("published_at"),
        "updated_at": F.col("updated_at"),
        "identities": F.concat(F.array(identity("huggingface", name, casefold(name))), paper_identities(papers)),
        "source_topics": tags,
        "extra": F.create_map(
            F.lit("kind"), kind, F.lit("arxiv_ids"), F.array_join(papers, ","),
            F.lit("pipeline_tag"), json_text(doc, "$.item.pipeline_tag"),
            F.lit("downloads"), json_integer(doc, "$.item.downloads").cast("string")),
    }
    problem = (
        F.when(~json_kind(doc, "$.item").startswith("OBJECT"), "hub item is not an object")
        .when(F.try_element_at(types, kind).isNull(), "unknown kind of hub item")
        .when(item.isNull(), "hub item has no id")
    )
    return finish(read, fields, problem, [
        (~F.col("canonical_url").startswith("https://huggingface.co/"), "canonical URL must be on the model hub")])
