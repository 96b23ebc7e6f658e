"""Report parts: event sentences, launches, updates, gaps, learning focus, opportunities, digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarloom import settings
from scholarloom.operators.catalog import Tables, works_without_documents
from scholarloom.operators.linking import per_source
from scholarloom.operators.ordered import top_per_key
from scholarloom.operators.ranking import ranked
from scholarloom.session import durable

#: Documents whose ids may stand in a filter; more are joined.
FEW_DOCUMENTS = 1000


def event_sentences(t: Tables, limit: int = 8) -> DataFrame:
    """Newest events with their number of active sources, one sentence each."""
    newest = t["events"].orderBy(F.col("occurred_at").desc_nulls_last(), "event_id").limit(limit)
    chosen = t["links"].join(F.broadcast(newest.select("event_id")), "event_id", "left_semi")
    counts = per_source(chosen, t["artifacts"]).groupBy("event_id").agg(F.count("*").alias("n"))
    joined = newest.join(counts, "event_id", "left").withColumn("sources", F.coalesce("n", F.lit(0)))
    sentence = F.when(F.col("sources") > 1, F.format_string(settings.TEXTS["event_linked"], "title", "sources")).otherwise(
        F.format_string(settings.TEXTS["event_single"], "title"))
    return joined.select("event_id", "occurred_at", "sources", sentence.alias("sentence"))


def _newest_artifacts(artifacts: DataFrame, limit: int) -> DataFrame:
    moment = F.coalesce("updated_at", "published_at", "created_at")
    return artifacts.withColumn("moment", moment).orderBy(F.col("moment").desc_nulls_last(), "artifact_id").limit(limit).select(
        "artifact_id", "title", "moment")


def recent_launches(artifacts: DataFrame, limit: int = 8) -> DataFrame:
    return _newest_artifacts(artifacts.filter(F.col("artifact_type").isin(settings.LAUNCH_TYPES)), limit)


def community_signals(artifacts: DataFrame, limit: int = 8) -> DataFrame:
    return _newest_artifacts(artifacts.filter((F.col("content_class") == "community_reaction") | (F.col("authority") < 0.5)), limit)


def revision_updates(t: Tables, limit: int = 10) -> DataFrame:
    """Works with an earlier version, newest observation first."""
    several = t["versions"].groupBy("work_id").agg(F.count("*").alias("versions")).filter("versions > 1")
    current = t["versions"].filter("is_current").select("work_id", "version_id", "title", "observed_at")
    return current.join(several, "work_id").orderBy(F.col("observed_at").desc(), "work_id").limit(limit)


def coverage_gaps(t: Tables) -> DataFrame:
    """(position, gap): one sentence per gap that exists."""
    missing = works_without_documents(t).agg(F.count("*").alias("missing"))
    deep = t["runs"].agg(F.count_if((F.col("analysis_type") == "deep_dive") & (F.col("status") == "succeeded")).alias("deep"))
    both = missing.join(deep)
    gaps = F.array(
        F.when(F.col("missing") > 0, F.format_string(settings.TEXTS["gap_documents"], "missing")),
        F.when(F.col("deep") == 0, F.lit(settings.TEXTS["gap_deep"])))
    return both.select(F.posexplode(F.filter(gaps, lambda g: g.isNotNull())).alias("position", "gap"))


def learning_focus(reports: DataFrame, limit: int = 10, newest: int = 2) -> DataFrame:
    """Distinct concepts of the newest deep reports (run_id, completed_at, report), in order."""
    top = reports.orderBy(F.col("completed_at").desc(), F.col("run_id").desc()).limit(newest)
    numbered = top.withColumn("place", F.row_number().over(Window.orderBy(F.col("completed_at").desc(), F.col("run_id").desc())))
    steps = numbered.select("place", F.posexplode("report.learning_path").alias("at", "step"))
    first = steps.groupBy(F.col("step.concept").alias("concept")).agg(F.min(F.struct("place", "at")).alias("first"))
    return first.orderBy("first").limit(limit).select("concept", F.col("first.place").alias("place"), F.col("first.at").alias("at"))


def engineering_opportunities(reports: DataFrame) -> DataFrame:
    """Applications backed by evidence of their supported claims (run_id, work_id, title, report)."""
    r = F.col("report")
    apps = reports.select("run_id", "work_id", "title", F.posexplode(r["production_applications"]).alias("app_no", "app"),
                          F.least(r["method"]["confidence"], r["evaluation"]["confidence"]).alias("confidence"))
    refs = apps.select("run_id", "app_no", F.posexplode("app.claim_ids").alias("ref_no", "claim_ref"))
    claims = reports.select("run_id", F.explode(r["claims"]).alias("c")).filter("c.verification_status = 'supported'").select(
        "run_id", F.col("c.id").alias("claim_ref"), "c.evidence_ids")
    cited = refs.join(claims, ["run_id", "claim_ref"]).select("run_id", "app_no", "ref_no", F.posexplode("evidence_ids").alias("at", "span_id"))
    first = cited.groupBy("run_id", "app_no", "span_id").agg(F.min(F.struct("ref_no", "at")).alias("first"))
    ids = first.groupBy("run_id", "app_no").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("first", "span_id"))), lambda x: x["span_id"]).alias("evidence_ids"))
    return apps.join(ids, ["run_id", "app_no"]).select(
        F.lit("engineering").alias("kind"), F.lit("build_opportunity").alias("label"), "work_id", "title",
        F.col("app.name").alias("headline"), F.col("app.expected_value").alias("detail"), "evidence_ids", "confidence")


def commercial_opportunities(reports: DataFrame) -> DataFrame:
    """Hypotheses of deep reports that cite evidence."""
    rows = reports.select("work_id", "title", F.explode("report.commercial_hypotheses").alias("h")).filter(F.size("h.evidence_ids") > 0)
    return rows.select(
        F.lit("commercial").alias("kind"), F.lit("commercial_hypothesis").alias("label"), "work_id", "title",
        F.col("h.problem").alias("headline"), F.concat_ws(": ", "h.buyer", "h.pilot").alias("detail"), "h.evidence_ids", "h.confidence")


def opportunities(reports: DataFrame, daily: DataFrame) -> DataFrame:
    """All opportunities; daily hypotheses join unless the same (kind, work, headline) is there already."""
    found = engineering_opportunities(reports).unionByName(commercial_opportunities(reports))
    key = ["kind", "work_id", "headline"]
    return found.unionByName(daily.join(found.select(*key), key, "left_anti").select(*found.columns))


def commercial_hypotheses(t: Tables, signals: DataFrame, limit: int = 3, pool: int = 10) -> DataFrame:
    """Daily hypotheses from the best commercial works that have evidence: the ids of the work's model
    signal, else its first three spans."""
    top = durable(ranked(t, "commercial", pool).select("work_id", "title", "total_score"))
    versions = t["versions"].join(F.broadcast(top.select("work_id")), "work_id", "left_semi").select("work_id", "version_id")
    # Stored, so that its size is known before spans are joined; where it is short, spans are filtered by its ids, a filter that goes down to what spans are made of.
    documents = durable(t["documents"].join(versions, "version_id").select("document_id", "work_id"))
    few = [row[0] for row in documents.select("document_id").limit(FEW_DOCUMENTS + 1).collect()]
    made = t["spans"].filter(F.col("document_id").isin(few)) if len(few) <= FEW_DOCUMENTS else t["spans"]
    spans = made.join(documents, "document_id").select("work_id", "page", "span_id")
    first = top_per_key(spans, ["work_id"], [F.col("page"), F.col("span_id")], 3).groupBy("work_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "span_id"))), lambda s: s["span_id"]).alias("_spans"))
    cited = signals.filter(F.size("evidence_ids") > 0).select("work_id", F.col("evidence_ids").alias("_cited"))
    backed = top.join(cited, "work_id", "left").join(first, "work_id", "left").withColumn("evidence_ids", F.coalesce("_cited", "_spans"))
    return backed.filter("evidence_ids IS NOT NULL").orderBy(F.col("total_score").desc(), "work_id").limit(limit).select(
        F.lit("commercial").alias("kind"), F.lit("commercial_hypothesis").alias("label"), "work_id", "title",
        F.format_string(settings.TEXTS["hypothesis_problem"], "title").alias("headline"), F.lit("").alias("detail"), "evidence_ids",
        F.least(F.lit(0.75), 0.35 + F.col("total_score") / 250).alias("confidence"))


def daily_report(report_date: str, parts: dict[str, DataFrame]) -> DataFrame:
    """One row for the date: every part as an ordered array of structs, with a payload fingerprint.

    Each part is a top-N list already (its first column is the order), so the row stays small.
    """
    spark = next(iter(parts.values())).sparkSession
    out = spark.range(1).select(F.lit(report_date).cast("date").alias("report_date"))
    for name, part in parts.items():
        items = part.agg(F.array_sort(F.collect_list(F.struct(*part.columns))).alias(name))
        out = out.join(items)
    payload = F.to_json(F.struct("report_date", *parts))
    return out.withColumn("report_json", payload).withColumn("input_fingerprint", F.sha2("report_json", 256)).select(
        "report_date", "input_fingerprint", "report_json")


def write_daily_report(report: DataFrame, path: str) -> None:
    """Replace the stored report of the same date, keep all other dates."""
    report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("report_date").parquet(path)


def executive_briefing(happened: Column, technical: Column, hypotheses: Column) -> Column:
    return F.format_string(settings.TEXTS["briefing"], happened, technical, hypotheses)
