"""Keyword search: every query token must start some token of the entity, in any field."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarloom.functions.text import fold_accents_text, search_tokens

_TOKEN = re.compile(r"[^\W_]+")


def search_documents(works: DataFrame, authors: DataFrame, work_topics: DataFrame, topics: DataFrame) -> DataFrame:
    """(work_id, title, body, topics) of every paper; body is the abstract and the authors in order."""
    papers = works.filter("work_type = 'paper'").select("work_id", "title", "abstract")
    names = authors.groupBy("work_id").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("author_order", "display_name"))), lambda a: a["display_name"]),
        " ").alias("_names"))
    labels = work_topics.select("work_id", "topic_key").distinct().join(
        F.broadcast(topics.select("topic_key", F.col("display_name").alias("_label"))), "topic_key"
    ).groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_list("_label")), " ").alias("topics"))
    body = F.trim(F.concat_ws(" ", F.coalesce("abstract", F.lit("")), F.coalesce("_names", F.lit(""))))
    return (
        papers.join(names, "work_id", "left").join(labels, "work_id", "left")
        .select("work_id", "title", body.alias("body"), F.coalesce("topics", F.lit("")).alias("topics"))
    )


def field_terms(documents: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(entity_id, field, terms): the distinct words of each text."""
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    rows = documents.select(F.col(key).alias("entity_id"), F.explode(texts).alias("t"))
    return rows.select("entity_id", "t.field", search_tokens(F.col("t.text")).alias("terms"))


def search_terms(documents: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(term, field, entity_id): the inverted frame. Write it sorted by term, so prefixes prune files."""
    return field_terms(documents, key, fields).select("entity_id", "field", F.explode("terms").alias("term"))


def query_tokens(text: str) -> list[str]:
    """Distinct folded tokens of a query; an error when there are none."""
    folded = fold_accents_text(text.casefold())
    tokens = list(dict.fromkeys(_TOKEN.findall(folded)))
    if not tokens:
        raise ValueError("the search text has no searchable token")
    return tokens


def matching_ids(terms: DataFrame, text: str) -> DataFrame:
    """Entities of which every query token is a prefix of some term; one scan, prefixes pushed down."""
    tokens = query_tokens(text)
    any_prefix = F.col("term").startswith(tokens[0])
    for token in tokens[1:]:
        any_prefix = any_prefix | F.col("term").startswith(token)
    hits = [F.max(F.col("term").startswith(t).cast("int")).alias(f"_{i}") for i, t in enumerate(tokens)]
    found = terms.filter(any_prefix).groupBy("entity_id").agg(*hits)
    total = sum((F.col(f"_{i}") for i in range(1, len(tokens))), F.col("_0"))
    return found.filter(total == len(tokens)).select("entity_id")


def refresh(documents: DataFrame, rebuilt: DataFrame, changed: DataFrame) -> DataFrame:
    """Index documents after the works in ``changed`` were rebuilt; deleted works just disappear."""
    return documents.join(changed.select("work_id"), "work_id", "left_anti").unionByName(
        rebuilt.join(changed.select("work_id"), "work_id", "left_semi"))
