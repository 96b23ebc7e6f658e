"""The normalised record, and what all normalisers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarloom.functions.text import clean, normal_form

IDENTITIES = "array<struct<id_type:string,raw_value:string,normalized_value:string>>"
AUTHORS = "array<struct<display_name:string,normalized_name:string,order:int>>"
COLUMNS = {
    "source_key": "string", "upstream_id": "string", "upstream_version": "string", "work_type": "string",
    "title": "string", "normalized_title": "string", "abstract": "string", "canonical_url": "string",
    "publication_status": "string", "published_at": "timestamp", "updated_at": "timestamp",
    "identities": IDENTITIES, "authors": AUTHORS, "source_topics": "array<string>",
    "document_urls": "array<string>", "repository_urls": "array<string>", "license_hint": "string",
    "extra": "map<string,string>",
}
CARRIED = ["record_id", "observed_at", "payload_sha256"]


def payload_text() -> Column:
    """Payload as text; NULL when it is not valid UTF-8."""
    return F.try_validate_utf8(F.col("payload").cast("string"))


def json_text(value: Column, path: str) -> Column:
    """String at ``path``, cleaned; NULL for every other JSON type."""
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    return clean(F.when(kind == "STRING", F.try_variant_get(value, path, "string")))


def json_kind(value: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(value, path, "variant")), F.lit("VOID"))


def json_strings(value: Column, path: str) -> Column:
    """String elements of the list at ``path``; empty when there is no list."""
    items = F.try_variant_get(value, path, "array<variant>")
    strings = F.filter(items, lambda x: F.schema_of_variant(x) == "STRING")
    return F.coalesce(
        F.transform(strings, lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>")
    )


def json_integer(value: Column, path: str) -> Column:
    """Integer at ``path``; 0 for anything else, booleans included."""
    whole = json_kind(value, path) == "BIGINT"
    return F.coalesce(F.when(whole, F.try_variant_get(value, path, "bigint")), F.lit(0))


def json_flag(value: Column, path: str) -> Column:
    """Truth value of what is stored at ``path``."""
    kind = json_kind(value, path)
    text = F.try_variant_get(value, path, "string")
    return (
        F.when(kind == "BOOLEAN", text == "true").when(kind == "VOID", False)
        .when(kind == "BIGINT", text != "0").when(kind == "STRING", text != "")
        .when(kind.startswith("ARRAY"), text != "[]").when(kind.startswith("OBJECT"), text != "{}")
        .otherwise(True)
    )


def identity(id_type: str, raw: Column, normalized: Column) -> Column:
    return F.struct(
        F.lit(id_type).alias("id_type"), raw.alias("raw_value"), normalized.alias("normalized_value")
    )


def paper_identities(ids: Column) -> Column:
    return F.transform(ids, lambda i: identity("arxiv", i, i))


def author_list(names: Column) -> Column:
    """Authors with their place in ``names`` (1-based); NULL names leave a gap."""
    slots = F.transform(names, lambda n, i: F.struct(
        n.alias("display_name"), normal_form(n, exact=False).alias("normalized_name"), (i + 1).alias("order")
    ))
    return F.filter(slots, lambda s: s["display_name"].isNotNull())


def finish(
    frame: DataFrame, fields: dict[str, Column], problem: Column, rules: list[tuple[Column, str]],
    *, broken_status: str = "rejected",
) -> DataFrame:
    """Normalised rows with ``status``, ``error_code``, ``error_detail``.

    ``problem`` is why the payload could not be read. ``rules`` are (violated, message) pairs over
    the output columns. Bad rows are kept beside the good ones, so that one never blocks another.
    """
    missing = {name: F.lit(None).cast(kind) for name, kind in COLUMNS.items() if name not in fields}
    arrays = {n for n, k in COLUMNS.items() if k.startswith("array")}
    columns = []
    for name, kind in COLUMNS.items():
        value = fields.get(name, missing.get(name)).cast(kind)
        columns.append((F.coalesce(value, F.array().cast(kind)) if name in arrays else value).alias(name))
    read = frame.select(*columns, *[c for c in CARRIED if c in frame.columns], problem.alias("_problem"))
    read = read.withColumn("normalized_title", normal_form(F.col("title")))
    problem_found = F.coalesce(
        F.col("_problem"), F.when(F.col("title").isNull(), "missing title"),
        F.when(F.col("normalized_title").isNull(), "title is empty after normalization"),
    )
    messages = F.filter(F.array(*[F.when(bad, text) for bad, text in rules]), lambda m: m.isNotNull())
    invalid = F.size("errors") > 0
    return (
        read.withColumn("_problem", problem_found)
        .withColumn("errors", messages if rules else F.array().cast("array<string>"))
        .withColumn("status", F.when(F.col("_problem").isNotNull(), broken_status)
                    .when(invalid, "rejected").otherwise("normalized"))
        .withColumn("error_code", F.when(F.col("_problem").isNotNull(), "NORMALIZATION_FAILED")
                    .when(invalid, "VALIDATION_FAILED"))
        .withColumn("error_detail", F.coalesce("_problem", F.when(invalid, F.array_join("errors", "; "))))
        .drop("_problem")
    )


def status_totals(normalized: DataFrame, review: DataFrame | None = None) -> DataFrame:
    """Normalised, rejected, failed (and review) counts of a batch, one row."""
    review_count = 0 if review is None else None
    totals = normalized.agg(
        F.count_if(F.col("status") == "normalized").alias("normalized"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    if review_count == 0:
        return totals.withColumn("manual_review", F.lit(0).cast("bigint"))
    waiting = review.agg(F.count_distinct("record_id").alias("manual_review"))
    return totals.join(waiting)
