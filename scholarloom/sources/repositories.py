"""Code-host repository and release metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarloom.functions.identifiers import canonical_repository
from scholarloom.functions.text import casefold
from scholarloom.sources.records import (
    finish, identity, json_flag, json_integer, json_kind, json_strings, json_text, payload_text,
)


def normalize_repositories(landed: DataFrame) -> DataFrame:
    """A JSON object is a repository, a JSON list a release history whose first element counts."""
    read = landed.withColumn("doc", F.try_parse_json(payload_text()))
    doc = F.col("doc")
    kind = json_kind(doc, "$")
    is_release = kind.startswith("ARRAY")
    home = canonical_repository(F.col("canonical_url"))
    full_name = F.when(json_kind(doc, "$.full_name") != "VOID", F.try_variant_get(doc, "$.full_name", "string"))
    tag = json_text(doc, "$[0].tag_name")
    path = F.split(F.btrim(F.regexp_extract("canonical_url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), F.lit("/")), "/")
    owner, name = F.try_element_at(path, F.lit(1)), F.try_element_at(path, F.lit(2))
    place = F.concat_ws("/", owner, name)
    release_id = casefold(F.concat(place, F.lit("@"), tag))
    license_hint = json_text(doc, "$.license.spdx_id")

    def pick(release, repository):
        return F.when(is_release, release).otherwise(repository)

    fields = {
        "source_key": F.lit("github"),
        "upstream_id": pick(F.col("upstream_id"), casefold(full_name)),
        "upstream_version": pick(tag, F.col("upstream_version")),
        "work_type": pick(F.lit("release"), F.lit("repository")),
        "title": pick(F.concat(place, F.lit(" "), tag), full_name),
        "abstract": pick(F.coalesce(json_text(doc, "$[0].name"), json_text(doc, "$[0].body")),
                         json_text(doc, "$.description")),
        "canonical_url": pick(F.col("canonical_url"), home),
        "publication_status": F.lit("published"),
        "published_at": F.col("published_at"),
        "updated_at": F.col("updated_at"),
        "identities": F.array(pick(identity("github", release_id, release_id),
                                   identity("github", full_name, casefold(full_name)))),
        "source_topics": F.when(~is_release, json_strings(doc, "$.topics")),
        "repository_urls": F.array(pick(F.concat(F.lit("https://github.com/"), place), home)),
        "license_hint": F.when(~is_release, license_hint),
        "extra": pick(
            F.create_map(F.lit("tag"), tag, F.lit("prerelease"), json_flag(doc, "$[0].prerelease").cast("string")),
            F.create_map(
                F.lit("archived"), json_flag(doc, "$.archived").cast("string"),
                F.lit("fork"), json_flag(doc, "$.fork").cast("string"),
                F.lit("default_branch"), json_text(doc, "$.default_branch"),
                F.lit("pushed_at"), json_text(doc, "$.pushed_at"),
                F.lit("open_issues_count"), json_integer(doc, "$.open_issues_count").cast("string"),
                F.lit("has_downloads"), json_flag(doc, "$.has_downloads").cast("string"),
                F.lit("license"), license_hint)),
    }
    problem = (
        F.when(~kind.startswith("ARRAY") & ~kind.startswith("OBJECT"), "metadata is neither object nor list")
        .when(is_release & tag.isNull(), "release has no tag")
        .when(is_release & (F.size(path) < 2), "release URL has no owner and repository")
        .when(~is_release & full_name.isNull(), "repository has no full name")
        .when(~is_release & home.isNull(), "repository URL has no owner and repository")
    )
    return finish(read, fields, problem, [
        (~F.col("canonical_url").startswith("https://github.com/"), "canonical URL must be on the code host")])
