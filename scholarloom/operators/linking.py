"""Attaching records to works, artifact and event upserts, corroboration and event views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarloom import settings
from scholarloom.functions.identifiers import repository_match_form
from scholarloom.functions.scoring import corroboration, linear_freshness
from scholarloom.functions.text import stable_key
from scholarloom.operators.catalog import page
from scholarloom.operators.ordered import top_per_key
from scholarloom.session import durable

FACTS_SCHEMA = (
    "source_key string, authority double, content_class string, fixed_artifact_type string, "
    "fixed_source_type string, linked_relationship string, free_relationship string"
)
_NAMED_IDS = "array<struct<id_type:string,normalized_value:string>>"
REVIEW_SOURCE, CODE_SOURCE, HUB_SOURCE = "openreview", "github", "huggingface"


def source_facts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(settings.SOURCE_FACTS, FACTS_SCHEMA)


def with_source_facts(records: DataFrame, facts: DataFrame) -> DataFrame:
    """Authority, content class, artifact and source type of each record, by a broadcast lookup."""
    joined = records.join(F.broadcast(facts), "source_key", "left")
    release = F.col("work_type") == "release"
    decided = (
        F.when(F.col("source_key") == CODE_SOURCE, F.when(release, "release").otherwise("repository"))
        .when(F.col("source_key") == HUB_SOURCE, F.regexp_replace(F.coalesce("kind", F.lit("model")), "s$", ""))
        .otherwise("paper")
    )
    return (
        joined.withColumn("artifact_type", F.coalesce("fixed_artifact_type", decided))
        .withColumn("source_type", F.coalesce("fixed_source_type", "artifact_type"))
        .withColumn("authority", F.coalesce("authority", F.lit(settings.DEFAULT_AUTHORITY)))
        .withColumn("content_class", F.coalesce("content_class", F.lit("fact")))
        .drop("fixed_artifact_type", "fixed_source_type")
    )


def attach_by_identity(records: DataFrame, external_ids: DataFrame) -> DataFrame:
    """(record_id, work_id): owner of the first listed identity that is known."""
    listed = records.select("record_id", F.posexplode("identities").alias("at", "i")).filter(
        F.col("i.id_type").isin(settings.LINKING_ID_TYPES)
    ).select("record_id", "at", F.col("i.id_type").alias("id_type"), F.col("i.normalized_value").alias("value"))
    found = listed.join(external_ids.select("id_type", "value", "work_id"), ["id_type", "value"])
    return found.groupBy("record_id").agg(F.min_by("work_id", "at").alias("work_id"))


def attach_by_repository(records: DataFrame, versions: DataFrame) -> DataFrame:
    """(record_id, work_id): smallest work whose current version names one of the record's repositories.

    Works are reduced to one per URL before the join, so a URL everyone shares is not multiplied.
    """
    owners = versions.filter("is_current").select(
        "work_id", F.explode("repository_urls").alias("url")
    ).groupBy(repository_match_form(F.col("url")).alias("url")).agg(F.min("work_id").alias("work_id"))
    wanted = records.select("record_id", F.explode("repository_urls").alias("url")).select(
        "record_id", repository_match_form(F.col("url")).alias("url")).distinct()
    return wanted.join(owners, "url").groupBy("record_id").agg(F.min("work_id").alias("work_id"))


def attach_records(records: DataFrame, external_ids: DataFrame, versions: DataFrame) -> DataFrame:
    """Records with ``work_id``: exact identity, else a shared repository, else NULL.

    Review notes never attach by repository; what they create comes from identity resolution.
    What records name is reduced to its distinct combinations before anything is joined. Those that lead to a work are stored and joined
    back once: by a broadcast where they are few, so that records do not move, else by one shuffle. URLs are compared as they stand
    there; their match form is worked out once for a combination, not for every record.
    """
    ids = F.transform(F.filter("identities", lambda i: i["id_type"].isin(settings.LINKING_ID_TYPES)), lambda i: F.struct(i["id_type"].alias("id_type"), i["normalized_value"].alias("normalized_value")))
    urls = F.when(F.col("source_key") != REVIEW_SOURCE, F.col("repository_urls"))
    named = records.withColumn("_named", F.struct(
        F.coalesce(ids, F.array().cast(_NAMED_IDS)).alias("identities"), F.coalesce(urls, F.array().cast("array<string>")).alias("repository_urls")))
    distinct = durable(named.select(F.col("_named").alias("record_id")).distinct().select("record_id", "record_id.*"))
    exact = attach_by_identity(distinct, external_ids).withColumnRenamed("work_id", "_exact")
    shared = attach_by_repository(distinct, versions).withColumnRenamed("work_id", "_shared")
    owned = durable(exact.join(shared, "record_id", "full").select(F.col("record_id").alias("_named"), F.coalesce("_exact", "_shared").alias("work_id")))
    return named.join(owned, "_named", "left").drop("_named")


def upsert_artifacts(sightings: DataFrame, as_of: Column, existing: DataFrame | None = None) -> DataFrame:
    """One artifact per (source_key, upstream_id): newest content, first type and publication date.

    ``sightings`` must carry ``arrival`` (a total order). Novelty is 1 on the first sight and 0 after.
    Existing artifacts count as seen before, whatever their arrival; one that is not seen again keeps its novelty and sightings.
    """
    keys = ["source_key", "upstream_id"]
    kept = ["artifact_type", "published_at"]
    fresh = ["record_id", "source_type", "title", "summary", "canonical_url", "content_class", "authority", "updated_at"]
    rows = sightings.select(*keys, *kept, *fresh, "observed_at", F.lit(1).alias("_age"), "arrival", F.lit(1).cast("long").alias("_seen"), F.lit(None).cast("double").alias("_novelty"))
    rows = rows.withColumn("freshness", linear_freshness(as_of, F.col("updated_at"), F.col("published_at"), F.col("observed_at")))
    if existing is not None:
        old = existing.select(*keys, *kept, *fresh, "freshness", F.lit(None).cast(rows.schema["observed_at"].dataType).alias("observed_at"),
                              F.lit(0).alias("_age"), F.lit(None).cast(rows.schema["arrival"].dataType).alias("arrival"),
                              F.col("sightings").cast("long").alias("_seen"), F.col("novelty").cast("double").alias("_novelty"))
        rows = rows.unionByName(old)
    order = F.struct("_age", "arrival")
    first = F.min_by(F.struct(*kept), order)
    last = F.max_by(F.struct(*fresh, "freshness"), order)
    merged = rows.groupBy(*keys).agg(first.alias("_first"), last.alias("_last"), 
        F.sum("_seen").alias("sightings"), F.max("_age").alias("_age"), F.max("_novelty").alias("_novelty"))
    return merged.select(
        stable_key(F.col("source_key"), F.col("upstream_id")).alias("artifact_id"), *keys, "_first.*", "_last.*",
        F.when(F.col("_age") == 0, F.col("_novelty")).when(F.col("sightings") == 1, 1.0).otherwise(0.0).alias("novelty"), "sightings")


def link_rows(records: DataFrame) -> DataFrame:
    """Event key, link basis, confidence, relationship and matching evidence of each attached record."""
    ids = F.filter("identities", lambda i: i["id_type"].isin(settings.LINKING_ID_TYPES))
    linked = F.col("work_id").isNotNull()
    basis = (
        F.when(linked & (F.size(ids) > 0), "external_id").when(linked, "explicit_url").otherwise("canonical_work"))
    release = (F.col("source_key") == CODE_SOURCE) & (F.col("work_type") == "release")
    relationship = (
        F.when(release, "release").when(linked, F.col("linked_relationship")).otherwise(F.col("free_relationship")))
    evidence = (
        F.when(F.col("basis") == "external_id", F.transform(ids, lambda i: F.concat(i["id_type"], F.lit(":"), i["normalized_value"])))
        .when(F.col("basis") == "explicit_url", F.col("repository_urls"))
        .otherwise(F.array("canonical_url")))
    own_key = F.concat(F.lit("artifact:"), F.col("source_key"), F.lit(":"), F.col("upstream_id"))
    return (
        records.withColumn("basis", basis)
        .withColumn("canonical_key", F.coalesce(F.concat(F.lit("work:"), "work_id"), own_key))
        .withColumn("confidence", F.when(F.col("basis") == "explicit_url", 0.95).otherwise(1.0))
        .withColumn("relationship", F.coalesce(relationship, F.lit("community_reference")))
        .withColumn("matching_evidence", evidence)
    ).withColumns(link_ids())


def link_ids() -> dict[str, Column]:
    """Event and artifact id of rows that have their event key, source and upstream id."""
    return {"event_id": F.sha2("canonical_key", 256), "artifact_id": stable_key(F.col("source_key"), F.col("upstream_id"))}


def upsert_events(linked: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One event per canonical key: newest title, newest known moment. ``linked`` is from ``link_rows``.

    ``existing``: stored events with the columns of the result. They count as earlier than every record; a stored
    event that no record names stays as it is, and a moment is kept when the new records have none.
    """
    keys = ["canonical_key"] if existing is None else ["event_id", "canonical_key"]  # the id, a hash of the key, is made after the shuffle
    rows = linked.select(
        *keys, "title", F.col("work_id").alias("primary_work_id"), F.coalesce("updated_at", "published_at").alias("occurred_at"),
        F.col("observed_at").alias("updated_at"), F.lit(1).alias("_age"), "arrival")
    if existing is not None:
        types = {f.name: f.dataType for f in rows.schema}
        rows = rows.unionByName(existing.select(
            *keys, *[F.col(n).cast(types[n]).alias(n) for n in ("title", "primary_work_id", "occurred_at", "updated_at")],
            F.lit(0).alias("_age"), F.lit(None).cast(types["arrival"]).alias("arrival")))
    order = F.struct("_age", "arrival")
    events = rows.groupBy(*keys).agg(
        F.max_by("title", order).alias("title"), F.min("primary_work_id").alias("primary_work_id"),
        F.max_by("occurred_at", F.when(F.col("occurred_at").isNotNull(), order)).alias("occurred_at"),
        F.max("updated_at").alias("updated_at"))
    return events if existing is not None else events.select(link_ids()["event_id"].alias("event_id"), *events.columns)


def upsert_links(linked: DataFrame, corrections: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """One link per (event, artifact), from its newest record; a correction made later switches it off.

    ``corrections``: event_id, artifact_id, corrected_at, reason. A record that arrives after the
    correction brings the link back. ``existing``: stored links as this function returns them; a record brings
    a stored link back, and a stored link without a record keeps its state unless a correction later than its ``observed_at`` names it. For runs in any order use
    ``link_log`` and ``fold_links``.
    """
    keys = ["event_id", "artifact_id"]
    link = F.struct("relationship", "basis", "confidence", "matching_evidence", "observed_at")
    own = ["canonical_key", "source_key", "upstream_id"]
    if set(own) <= set(linked.columns):  # rows of ``link_rows``, whose ids are hashes of these: longer, and of no use to compression on the way
        rows = linked.groupBy(*own).agg(F.max_by(link, "arrival").alias("l")).withColumns(link_ids()).select(*keys, "l.*")
    else:
        rows = linked.groupBy(*keys).agg(F.max_by(link, "arrival").alias("l")).select(*keys, "l.*")
    if existing is not None:
        stored = existing.join(rows.select(*keys), keys, "left_anti")
        off = {n: F.col(n).cast(t) if n in existing.columns else F.lit(None).cast(t) for n, t in (("corrected_at", "timestamp"), ("correction_reason", "string"))}
        seen = F.col("observed_at") if "observed_at" in existing.columns else F.lit(None)
        kept = stored.select(*keys, "relationship", "basis", "confidence", "matching_evidence", seen.cast(rows.schema["observed_at"].dataType).alias("observed_at"),
                             F.col("active").alias("_active"), off["corrected_at"].alias("_at"), off["correction_reason"].alias("_why"))
        rows = rows.select("*", F.lit(True).alias("_active"), F.lit(None).cast("timestamp").alias("_at"), F.lit(None).cast("string").alias("_why")).unionByName(kept)
    elif corrections is None:
        return rows.withColumn("active", F.lit(True))
    else:
        rows = rows.select("*", F.lit(True).alias("_active"), F.lit(None).cast("timestamp").alias("_at"), F.lit(None).cast("string").alias("_why"))
    if corrections is None:
        return rows.select(*keys, "relationship", "basis", "confidence", "matching_evidence", "observed_at", F.col("_active").alias("active"),
                           F.col("_at").alias("corrected_at"), F.col("_why").alias("correction_reason"))
    newest = corrections.groupBy(*keys).agg(F.max(F.struct("corrected_at", "reason")).alias("c"))
    joined = rows.join(newest, keys, "left")
    off = F.col("c").isNotNull() & F.coalesce(F.col("c.corrected_at") >= F.col("observed_at"), F.col("observed_at").isNull())
    return joined.select(
        *keys, "relationship", "basis", "confidence", "matching_evidence", "observed_at", (F.col("_active") & ~off).alias("active"),
        F.when(off, F.col("c.corrected_at")).otherwise(F.col("_at")).alias("corrected_at"),
        F.when(off, F.col("c.reason")).otherwise(F.col("_why")).alias("correction_reason"))


LINK_LOG = ["event_id", "artifact_id", "kind", "moment", "arrival", "relationship", "basis", "confidence", "matching_evidence", "reason"]


def link_log(linked: DataFrame | None = None, corrections: DataFrame | None = None) -> DataFrame:
    """What happened to links, as rows that are only ever added: a record that names a link at its ``observed_at``, a correction at its ``corrected_at``.

    A batch adds one row per link and moment, so a link that a feed repeats costs one row a batch.
    """
    parts = []
    keys = ["event_id", "artifact_id"]
    if linked is not None:
        newest = linked.groupBy(*keys).agg(F.max_by(F.struct("observed_at", "arrival", "relationship", "basis", "confidence", "matching_evidence"), F.struct("observed_at", "arrival")).alias("l"))
        parts.append(newest.select(*keys, F.lit("record").alias("kind"), F.col("l.observed_at").alias("moment"), F.col("l.arrival").cast("bigint").alias("arrival"), "l.relationship", "l.basis",
                                   "l.confidence", "l.matching_evidence", F.lit(None).cast("string").alias("reason")))
    if corrections is not None:
        empty = lambda kind: F.lit(None).cast(kind)
        parts.append(corrections.select(*keys, F.lit("correction").alias("kind"), F.col("corrected_at").alias("moment"), empty("bigint").alias("arrival"), empty("string").alias("relationship"),
                                        empty("string").alias("basis"), empty("double").alias("confidence"), empty("array<string>").alias("matching_evidence"), "reason").distinct())
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def fold_links(log: DataFrame) -> DataFrame:
    """State of every link from its log: the newest record's link, off since the first correction that is not before that record.

    Only moments count, so rows may come in any order, in any number of runs, and more than once. A correction of a link that no record names gives no link.
    """
    keys = ["event_id", "artifact_id"]
    record = F.col("kind") == "record"
    last = log.filter(record).groupBy(*keys).agg(
        F.max_by(F.struct("relationship", "basis", "confidence", "matching_evidence"), F.struct("moment", "arrival")).alias("l"), F.max("moment").alias("observed_at"))
    off = log.filter(~record).select(*keys, "moment", "reason").join(last.select(*keys, "observed_at"), keys).filter("moment >= observed_at")
    first = off.groupBy(*keys).agg(F.min(F.struct("moment", "reason")).alias("c"))
    return last.join(first, keys, "left").select(
        *keys, "l.*", "observed_at", F.col("c").isNull().alias("active"), F.col("c.moment").alias("corrected_at"), F.col("c.reason").alias("correction_reason"))


def per_source(links: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Active links reduced to one row per (event, source); what all event measures start from."""
    facts = artifacts.select("artifact_id", "source_key", (
        (F.col("authority") >= settings.AUTHORITATIVE) & (F.col("content_class") == "fact")).alias("_fact"))
    return links.filter("active").join(facts, "artifact_id").groupBy("event_id", "source_key").agg(
        F.max("_fact").alias("authoritative"), F.sum("confidence").alias("confidence"), F.count("*").alias("n"))


def event_measures(events: DataFrame, links: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Source count, corroboration, classification, status and mean confidence per event."""
    measured = per_source(links, artifacts).groupBy("event_id").agg(
        F.count("*").alias("source_count"), F.count_if("authoritative").alias("authoritative_sources"),
        (F.sum("confidence") / F.sum("n")).alias("association_confidence"))
    sources = F.coalesce("source_count", F.lit(0))
    several = F.col("authoritative_sources") >= 2
    return events.join(measured, "event_id", "left").select(
        *events.columns, sources.alias("source_count"),
        F.coalesce("authoritative_sources", F.lit(0)).alias("authoritative_sources"),
        F.coalesce("association_confidence", F.lit(0.0)).alias("association_confidence"),
        corroboration(F.col("source_count")).alias("corroboration"),
        F.when(sources <= 1, "artifact").when(several, "corroborated_event").otherwise("associated_event").alias("classification"),
        F.when(sources <= 1, "single_source").when(several, "corroborated").otherwise("associated").alias("corroboration_status"))


def linkage_reasons(events: DataFrame, links: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(event_id, linkage_reason): first three distinct evidence and relationship texts.

    Texts are made distinct and cut to three per event before anything is collected.
    """
    shown = links.filter("active").join(artifacts.select("artifact_id", "source_key", "authority"), "artifact_id")
    texts = F.concat("matching_evidence", F.array(F.replace("relationship", F.lit("_"), F.lit(" "))))
    listed = shown.select("event_id", "authority", "source_key", "artifact_id", F.posexplode(texts).alias("at", "reason"))
    place = F.struct((-F.col("authority")).alias("a"), "source_key", "artifact_id", "at")
    distinct = listed.filter("reason <> ''").groupBy("event_id", "reason").agg(F.min(place).alias("place"))
    kept = top_per_key(distinct, ["event_id"], [F.col("place")], 3)
    joined = kept.groupBy("event_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "reason"))), lambda r: r["reason"]), "; ").alias("linkage_reason"))
    return events.select("event_id").join(joined, "event_id", "left").select(
        "event_id", F.coalesce("linkage_reason", F.lit(settings.TEXTS["no_link"])).alias("linkage_reason"))


def event_sources(page_ids: DataFrame, links: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Sources of the events on a page, long form; shown by authority desc, source, artifact."""
    chosen = links.filter("active").join(page_ids.select("event_id"), "event_id", "left_semi")
    return chosen.join(artifacts.select(
        "artifact_id", "source_key", "artifact_type", "source_type", "title", "authority", "novelty", "content_class"), "artifact_id")


def events_page(events: DataFrame, links: DataFrame, artifacts: DataFrame, source: str | None = None, limit: int | None = 20, offset: int = 0) -> DataFrame:
    """Newest events first, undated ones last; ``source`` keeps those with an active link from it."""
    if source is not None:
        wanted = artifacts.filter(F.col("source_key") == source).select("artifact_id")
        hits = links.filter("active").join(wanted, "artifact_id", "left_semi").select("event_id")
        events = events.join(hits, "event_id", "left_semi")
    return page(events, [F.col("occurred_at").desc_nulls_last(), F.col("event_id").asc()], limit, offset)


def newest_event_per_work(events: DataFrame) -> DataFrame:
    """(work_id, event_id) of the event updated last."""
    return events.filter("primary_work_id IS NOT NULL").groupBy(F.col("primary_work_id").alias("work_id")).agg(
        F.max_by("event_id", F.struct("updated_at", "event_id")).alias("event_id"))


def repository_seeds(versions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Distinct code-host URLs named by current versions or artifacts."""
    urls = versions.filter("is_current").select(F.explode("repository_urls").alias("url")).unionByName(
        artifacts.select(F.explode("repository_urls").alias("url")))
    return urls.filter(F.col("url").startswith("https://github.com/")).distinct()
