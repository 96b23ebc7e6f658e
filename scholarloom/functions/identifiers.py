"""Identifier normalisation with a reject reason, version labels, canonical and public URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholarloom import settings
from scholarloom.functions.text import SPACE, casefold


def _strip(text: Column) -> Column:
    """Whitespace of any kind off both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _doi(raw: Column) -> Column:
    return casefold(_strip(F.regexp_replace(raw, settings.DOI_PREFIX, "")))


def _paper_parts(raw: Column) -> tuple[Column, Column]:
    """(stable id, version label) of a preprint id; both NULL when it is malformed."""
    bare = _strip(F.regexp_replace(raw, settings.ARXIV_PREFIX, ""))
    bare = F.regexp_replace(bare, r"(?i)\.pdf$", "")
    stable = F.nullif(F.regexp_extract(bare, settings.ARXIV_PATTERN, 1), F.lit(""))
    version = F.nullif(F.regexp_extract(bare, settings.ARXIV_PATTERN, 2), F.lit(""))
    return casefold(stable), casefold(version)


def _review(raw: Column) -> tuple[Column, Column]:
    """(id, reason) of a review-platform id given bare or as a URL with one ``id`` parameter."""
    is_url = raw.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)")
    host = F.lower(F.regexp_extract(raw, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    query = F.regexp_extract(raw, r"^[^?#]*\?([^#]*)", 1)
    ids = F.filter(F.split(query, "&"), lambda p: p.rlike("^id=."))
    one = F.try_url_decode(F.replace(F.substring(ids[0], F.lit(4), F.length(ids[0])), F.lit("+"), F.lit(" ")))
    value = F.when(~is_url, raw).otherwise(F.when(F.size(ids) == 1, one))
    reason = (
        F.when(is_url & ~host.isin(settings.REVIEW_HOSTS), "foreign host")
        .when(is_url & (F.size(ids) != 1), "one id parameter expected")
        .when(~F.coalesce(value.rlike(settings.REVIEW_ID_PATTERN), F.lit(False)), "malformed review id")
    )
    return value, reason


def normalized_identity(id_type: Column, raw_value: Column) -> Column:
    """struct<id_type, raw_value, normalized_value, version_label, reason>; reason NULL when valid."""
    raw = _strip(raw_value)
    doi = _doi(raw)
    paper, version = _paper_parts(raw)
    review, review_reason = _review(raw)
    reason = (
        F.when(id_type == "doi", F.when(~doi.rlike(settings.DOI_PATTERN) | doi.rlike(SPACE), "malformed doi"))
        .when(id_type == "arxiv", F.when(paper.isNull(), "malformed preprint id"))
        .when(id_type == "openreview", review_reason)
        .otherwise(F.lit("unsupported identity type"))
    )
    value = F.when(id_type == "doi", doi).when(id_type == "arxiv", paper).when(id_type == "openreview", review)
    return F.struct(
        id_type.alias("id_type"),
        raw_value.alias("raw_value"),
        F.when(reason.isNull(), value).alias("normalized_value"),
        F.when(reason.isNull() & (id_type == "arxiv"), version).alias("version_label"),
        reason.alias("reason"),
    )


def version_label(upstream_version: Column, paper_version: Column, content_sha256: Column) -> Column:
    """Explicit label (prefixed with ``v``), else the preprint version, else the content hash."""
    explicit = F.nullif(casefold(_strip(upstream_version)), F.lit(""))
    return F.coalesce(
        F.when(explicit.startswith("v"), explicit).otherwise(F.concat(F.lit("v"), explicit)),
        paper_version,
        F.concat(F.lit("sha256:"), casefold(content_sha256)),
    )


def version_number(label: Column) -> Column:
    """Number in ``vN``, 0 for every other label."""
    digits = F.nullif(F.regexp_extract(label, r"^[vV](\d+)$", 1), F.lit(""))
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def canonical_repository(url: Column) -> Column:
    """``https://github.com/owner/name`` without ``.git``; NULL for every other URL."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^https://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    name = F.regexp_replace(F.try_element_at(parts, F.lit(2)), r"\.git$", "")
    joined = F.concat(F.lit("https://github.com/"), F.try_element_at(parts, F.lit(1)), F.lit("/"), name)
    return F.when(host == "github.com", joined)


def repository_match_form(url: Column) -> Column:
    """Form in which two repository URLs count as the same."""
    return F.regexp_replace(F.regexp_replace(casefold(url), r"\.git$", ""), "/+$", "")


def public_url(id_type: Column, value: Column) -> Column:
    """Public address of a preprint id or DOI, percent-encoded; NULL for other kinds."""
    def keep(text: Column, safe: str) -> Column:
        out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
        out = F.replace(F.replace(out, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
        for mark in safe:
            out = F.replace(out, F.lit(f"%{ord(mark):02X}"), F.lit(mark))
        return out

    return F.when(id_type == "arxiv", F.concat(F.lit("https://arxiv.org/abs/"), keep(value, ""))).when(
        id_type == "doi", F.concat(F.lit("https://doi.org/"), keep(value, "/():"))
    )
