"""Catalog views: base relation, filters, orders, pages, nested details, derived columns.

Tables are passed as a ``Tables`` mapping from name to DataFrame; every function only touches the
ones it names, so Catalyst prunes the rest.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarloom import settings
from scholarloom.functions.identifiers import public_url
from scholarloom.operators.ordered import latest_by
from scholarloom.operators.search import matching_ids
from scholarloom.session import durable

Tables = Mapping[str, DataFrame]
MAX_PAGE, MAX_OFFSET = 50, 100_000


@dataclass(frozen=True)
class CatalogQuery:
    """Filters, order and page of a catalog listing; unset filters do nothing."""

    q: str | None = None
    topic: str | None = None
    source: str | None = None
    source_type: str | None = None
    minimum_authority: float | None = None
    minimum_corroboration: float | None = None
    linked_only: bool = False
    published_from: date | None = None
    published_to: date | None = None
    sort: str = "newest"
    limit: int | None = 20
    offset: int = 0

    def __post_init__(self) -> None:
        if self.limit is not None and not 1 <= self.limit <= MAX_PAGE:
            raise ValueError("limit must be between 1 and 50")
        if not 0 <= self.offset <= MAX_OFFSET:
            raise ValueError("offset must be between 0 and 100000")
        if self.sort not in SORTS:
            raise ValueError(f"unknown order: {self.sort}")


#: Columns of each order and whether each runs downwards; null comes last either way.
ORDER_KEYS = {
    "newest": [("publication_date", True), ("work_id", False)],
    "oldest": [("publication_date", False), ("work_id", False)],
    "title": [("normalized_title", False), ("work_id", False)],
    "updated": [("updated_at", True), ("work_id", False)],
    **{kind: [(f"{kind}_score", True), ("publication_date", True), ("work_id", False)] for kind in ("technical", "commercial", "priority")},
}


def _order(keys: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_last() for name, down in keys]


SORTS = {name: (lambda keys=keys: _order(keys)) for name, keys in ORDER_KEYS.items()}


def beyond(keys: list[tuple[str, bool]], boundary: Mapping[str, object]) -> Column:
    """Whether a row comes after the row with the values ``boundary`` in the order of ``keys``; a plain filter, so the rows before it are not sorted."""
    after = F.lit(False)
    for name, down in reversed(keys):
        value, column = boundary[name], F.col(name)
        if value is None:
            after = column.isNull() & after
        else:
            later = column < F.lit(value) if down else column > F.lit(value)
            after = column.isNull() | later | ((column == F.lit(value)) & after)
    return F.coalesce(after, F.lit(False))


def base_papers(t: Tables) -> DataFrame:
    """Open papers with their current version and its source; one row per work."""
    works = t["works"].filter(
        (F.col("work_type") == "paper") & ~F.col("lifecycle_state").isin(settings.CLOSED_STATES)
    ).select("work_id", "normalized_title", "publication_status", "first_published_at", "created_at", "updated_at",
             "current_version_id")
    versions = t["versions"].filter("is_current").select(
        F.col("version_id").alias("current_version_id"), "title", "abstract", "version_label", "record_id",
        "published_at",
    )
    records = t["records"].select("record_id", "source_key", "observed_at", "updated_at_upstream")
    sources = t["sources"].select("source_key", "display_name", "trust_tier")
    return (
        works.join(versions, "current_version_id").join(records, "record_id").join(sources, "source_key")
        .withColumn("publication_date", F.coalesce("published_at", "first_published_at"))
    )


def linked_artifacts(t: Tables, *, active_only: bool) -> DataFrame:
    """(work_id, event_id, artifact columns) through the event bridge."""
    events = t["events"].filter("primary_work_id IS NOT NULL").select(
        "event_id", F.col("primary_work_id").alias("work_id"))
    links = t["links"].filter("active") if active_only else t["links"]
    return (
        events.join(links.select("event_id", "artifact_id", "relationship"), "event_id")
        .join(t["artifacts"].select(
            "artifact_id", "source_key", "artifact_type", "source_type", "authority", "novelty", "title",
            "canonical_url"), "artifact_id")
    )


def filter_papers(papers: DataFrame, t: Tables, query: CatalogQuery) -> DataFrame:
    """Each set filter is one semi-join; a work with many links is never multiplied."""
    out = papers
    if query.q is not None:
        out = out.join(matching_ids(t["search_terms"], query.q).withColumnRenamed("entity_id", "work_id"), "work_id", "left_semi")
    if query.topic is not None:
        tagged = t["work_topics"].filter(F.col("topic_key") == query.topic).select("work_id")
        out = out.join(tagged, "work_id", "left_semi")
    if query.source is not None:
        linked = linked_artifacts(t, active_only=True).filter(F.col("source_key") == query.source).select("work_id")
        own = papers.filter(F.col("source_key") == query.source).select("work_id")
        out = out.join(own.unionByName(linked), "work_id", "left_semi")
    conditions = []
    if query.source_type is not None:
        conditions.append(F.col("source_type") == query.source_type)
    if query.minimum_authority is not None:
        conditions.append(F.col("authority") >= query.minimum_authority)
    for condition in conditions:
        hits = linked_artifacts(t, active_only=True).filter(condition).select("work_id")
        out = out.join(hits, "work_id", "left_semi")
    if query.minimum_corroboration is not None:
        hits = t["events"].filter(F.col("corroboration") >= query.minimum_corroboration)
        out = out.join(hits.select(F.col("primary_work_id").alias("work_id")), "work_id", "left_semi")
    if query.linked_only:
        hits = t["events"].join(t["links"].filter("active").select("event_id"), "event_id", "left_semi")
        out = out.join(hits.select(F.col("primary_work_id").alias("work_id")), "work_id", "left_semi")
    if query.published_from is not None:
        out = out.filter(F.col("publication_date") >= F.lit(query.published_from).cast("timestamp"))
    if query.published_to is not None:
        end = query.published_to + timedelta(days=1)
        out = out.filter(F.col("publication_date") < F.lit(end).cast("timestamp"))
    return out


def match_reason(query: CatalogQuery) -> str | None:
    """Which kinds of filter a listing was made with."""
    linked_evidence = query.source_type or query.minimum_authority is not None
    linked_event = query.minimum_corroboration is not None or query.linked_only
    reasons = [
        (query.q, "keyword match"), (query.topic, "topic filter"), (query.source, "source filter"),
        (linked_evidence, "linked evidence filter"), (linked_event, "linked event filter"),
        (query.published_from or query.published_to, "publication date filter"),
    ]
    return ", ".join(text for active, text in reasons if active) or None


def with_scores(papers: DataFrame, results: DataFrame) -> DataFrame:
    """Scores of the active profile, one column per kind."""
    kinds = {"technical": "technical_score", "commercial": "commercial_score", "deep_dive_priority": "priority_score"}
    wide = results.filter(F.col("score_kind").isin(list(kinds))).groupBy("work_id").agg(
        *[F.max(F.when(F.col("score_kind") == k, F.col("total_score"))).alias(c) for k, c in kinds.items()])
    return papers.join(wide, "work_id", "left")


def document_status(versions: DataFrame, documents: DataFrame, attempts: DataFrame) -> DataFrame:
    """(version_id, document_status): newest parse status, else newest attempt, else not_acquired."""
    parsed = latest_by(
        documents.filter("document_role = 'paper_pdf'").select("version_id", "parse_status", "acquired_at", "document_id"),
        ["version_id"], [F.col("acquired_at"), F.col("document_id")])
    tried = latest_by(
        attempts.select("version_id", "status", "attempted_at", "attempt_id"),
        ["version_id"], [F.col("attempted_at"), F.col("attempt_id")])
    return (
        versions.select("version_id")
        .join(parsed.select("version_id", "parse_status"), "version_id", "left")
        .join(tried.select("version_id", "status"), "version_id", "left")
        .select("version_id", F.coalesce("parse_status", "status", F.lit("not_acquired")).alias("document_status"))
    )


def evidence_counts(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(version_id, evidence_count); spans are counted per document before they meet the versions."""
    per_document = spans.groupBy("document_id").agg(F.count("*").alias("n"))
    return per_document.join(documents.select("document_id", "version_id"), "document_id").groupBy("version_id").agg(
        F.sum("n").alias("evidence_count"))


def page(rows: DataFrame, order: list[Column], limit: int | None, offset: int = 0) -> DataFrame:
    """One page; a limit keeps only ``offset + limit`` rows per task before the final merge."""
    ordered = rows.orderBy(*order)
    ordered = ordered.offset(offset) if offset else ordered
    return ordered if limit is None else ordered.limit(limit)


def page_summary(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """(total, limit, offset, has_more) of a listing."""
    total = F.count("*").alias("total")
    shown = F.least(F.lit(limit), F.greatest(F.lit(0), F.col("total") - offset))
    return rows.agg(total).select(
        "total", F.lit(limit).cast("bigint").alias("limit"), F.lit(offset).cast("bigint").alias("offset"),
        (F.col("total") > shown + offset).alias("has_more"))


def _sortable(t: Tables, query: CatalogQuery) -> DataFrame:
    return _scored(filter_papers(base_papers(t), t, query), t, query)


def _scored(papers: DataFrame, t: Tables, query: CatalogQuery) -> DataFrame:
    return with_scores(papers, t["results"]) if query.sort in {"technical", "commercial", "priority"} else papers


def seek_page(t: Tables, query: CatalogQuery, after: Mapping[str, object] | None = None) -> tuple[DataFrame, dict[str, object] | None]:
    """The page that follows the boundary ``after`` (None: the first) and the boundary of the next one (None: there is none).

    A page at any depth costs what the first one costs: a filter and the ``limit`` smallest rows, so there is no bound on the depth. A row that is
    put in before the boundary meanwhile moves nothing. The boundary holds the order columns of the last row shown.
    The page is chosen by its order columns alone; titles and abstracts are read for its rows only, by their ids, which filter every table before it is joined.
    """
    if query.limit is None or query.offset:
        raise ValueError("a page by boundary has a limit and no offset")
    keys = ORDER_KEYS[query.sort]
    papers = _sortable(t, query)
    rest = papers if after is None else papers.filter(beyond(keys, after))
    names = [name for name, _ in keys]
    rows = page(rest.select(*names, "current_version_id"), _order(keys), query.limit).collect()  # at most MAX_PAGE
    boundary = {name: rows[-1][name] for name in names} if len(rows) == query.limit else None
    works, versions = ([r[name] for r in rows] for name in ("work_id", "current_version_id"))
    own = ChainMap({"works": t["works"].filter(F.col("work_id").isin(works) & F.col("current_version_id").isin(versions)),
                    "versions": t["versions"].filter(F.col("version_id").isin(versions))}, t)
    shown = durable(page(_scored(base_papers(own), own, query), _order(keys), query.limit))
    return shown.withColumn("match_reason", F.lit(match_reason(query)).cast("string")), boundary


def catalog_page(t: Tables, query: CatalogQuery) -> DataFrame:
    """Page of papers; details are attached to the page only, after the limit."""
    shown = page(_sortable(t, query), SORTS[query.sort](), query.limit, query.offset)
    return shown.withColumn("match_reason", F.lit(match_reason(query)).cast("string"))


def paper_detail(t: Tables, wanted: DataFrame) -> DataFrame:
    """The open papers among the works of ``wanted`` (work_id)."""
    return base_papers(t).join(wanted.select("work_id"), "work_id", "left_semi")


def authors_of(page_ids: DataFrame, t: Tables) -> DataFrame:
    """(work_id, authors): structs in author order."""
    rows = t["authors"].join(page_ids.select("work_id"), "work_id", "left_semi")
    item = F.struct("author_order", "author_id", "display_name")
    return rows.groupBy("work_id").agg(F.array_sort(F.collect_list(item)).alias("authors"))


def topics_of(page_ids: DataFrame, t: Tables) -> DataFrame:
    """(work_id, topics): active topics by label; at most as many as the taxonomy has."""
    active = F.broadcast(t["topics"].filter("active").select("topic_key", F.col("display_name").alias("topic_name")))
    rows = t["work_topics"].select("work_id", "topic_key").join(page_ids.select("work_id"), "work_id", "left_semi").join(active, "topic_key")
    item = F.struct("topic_name", "topic_key")
    return rows.groupBy("work_id").agg(F.array_sort(F.collect_set(item)).alias("topics"))


def identities_of(page_ids: DataFrame, t: Tables) -> DataFrame:
    """(work_id, id_type, value, external_url), long form: a work may own any number of them."""
    rows = t["external_ids"].join(page_ids.select("work_id"), "work_id", "left_semi")
    return rows.select("work_id", "id_type", "value", public_url(F.col("id_type"), F.col("value")).alias("external_url"))


def linked_sources_of(page_ids: DataFrame, t: Tables, *, active_only: bool = False) -> DataFrame:
    """Linked artifacts of the page, long form; shown by authority desc, source, id."""
    return linked_artifacts(t, active_only=active_only).join(page_ids.select("work_id"), "work_id", "left_semi")


def primary_links(identities: DataFrame) -> DataFrame:
    """(work_id, external_url): the preprint page if there is one, else the first URL by type and value."""
    url = F.col("external_url")
    return identities.filter(url.isNotNull()).groupBy("work_id").agg(
        F.min_by(url, F.struct(F.col("id_type") != "arxiv", "id_type", "value")).alias("external_url"))


def topic_options(t: Tables) -> DataFrame:
    """Active topics that some paper carries."""
    papers = t["works"].filter("work_type = 'paper'").select("work_id")
    used = t["work_topics"].join(papers, "work_id", "left_semi").select("topic_key").distinct()
    return t["topics"].filter("active").join(used, "topic_key", "left_semi").select("topic_key", "display_name")


def source_options(t: Tables) -> DataFrame:
    """Sources of the catalog and sources that delivered artifacts, without repeats."""
    catalog = base_papers(t).select("source_key", "display_name").distinct()
    delivering = t["artifacts"].select("source_key").distinct()
    linked = t["sources"].select("source_key", "display_name").join(delivering, "source_key", "left_semi")
    return catalog.union(linked).distinct()


def works_without_documents(t: Tables) -> DataFrame:
    """Papers no version of which has a parsed document."""
    done = t["documents"].filter(F.col("parse_status").isin(settings.PARSED_STATES)).select("version_id")
    covered = t["versions"].join(done, "version_id", "left_semi").select("work_id")
    return t["works"].filter("work_type = 'paper'").select("work_id").join(covered, "work_id", "left_anti")


def documents_to_process(t: Tables, limit: int | None = 5) -> DataFrame:
    """Newest current papers with a preprint id and no parsed document of that version."""
    done = t["documents"].filter(
        (F.col("document_role") == "paper_pdf") & F.col("parse_status").isin(settings.PARSED_STATES)).select("version_id")
    papers = t["works"].filter("work_type = 'paper'").select("work_id", "first_published_at", F.col("current_version_id").alias("version_id"))
    versions = t["versions"].filter("is_current").select("version_id", "version_label", "published_at")
    ids = t["external_ids"].filter("id_type = 'arxiv'").select("work_id", F.col("value").alias("arxiv_id"))
    rows = papers.join(versions, "version_id").join(done, "version_id", "left_anti").join(ids, "work_id")
    rows = rows.withColumn("publication_date", F.coalesce("published_at", "first_published_at"))
    return page(rows, [F.col("publication_date").desc_nulls_last(), F.col("work_id").asc()], limit)


def evidence_listing(t: Tables, wanted: DataFrame, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Spans of the current version of the works of ``wanted`` (work_id), in reading order."""
    version = t["works"].join(wanted.select("work_id"), "work_id", "left_semi").select(F.col("current_version_id").alias("version_id"))
    documents = t["documents"].join(version, "version_id", "left_semi").select("document_id")
    rows = t["spans"].join(documents, "document_id", "left_semi")
    return page(rows, [F.col("page"), F.col("char_start"), F.col("span_id")], limit, offset)


def listing(rows: DataFrame, equal: Mapping[str, object], order: list[Column], limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Equality-filtered, ordered page of any entity table."""
    for name, value in equal.items():
        rows = rows.filter(F.col(name).eqNullSafe(F.lit(value)))
    return page(rows, order, limit, offset)
