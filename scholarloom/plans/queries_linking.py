"""Linking, aggregation, ranking and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarloom import settings
from scholarloom.functions.scoring import rounded
from scholarloom.operators import linking, metrics, ranking, reports
from scholarloom.operators.listings import daily_budget, first_writer
from scholarloom.plans.corpus import as_of, at, sql_time
from scholarloom.plans.registry import query, shown


@query("a1_event_corroboration", "SELECT event_id, source_count, corroboration FROM linked_events")
def a1(t):
    return t["events"].select("event_id", "source_count", "corroboration")


@query("a2_event_classification", "SELECT canonical_key, authoritative_sources, classification, corroboration_status FROM linked_events")
def a2(t):
    return t["events"].select("canonical_key", "authoritative_sources", "classification", "corroboration_status")


@query("a3_association_confidence", "SELECT event_id, round(CAST(association_confidence AS DOUBLE), 6) AS association_confidence FROM linked_events")
def a3(t):
    return t["events"].select("event_id", F.round("association_confidence", 6).alias("association_confidence"))


@query("a4_linkage_reason", f"""SELECT b.event_id, coalesce(r.reason, '{settings.TEXTS['no_link']}') AS linkage_reason FROM event_base b LEFT JOIN (
    SELECT event_id, string_agg(text, '; ' ORDER BY n) AS reason FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY place) AS n FROM (
        SELECT event_id, text, min((-authority, source_key, artifact_id, slot)) AS place FROM (
            SELECT l.event_id, a.authority, a.source_key, a.artifact_id, 0 AS slot, l.evidence AS text FROM links l JOIN artifacts a USING (artifact_id)
            UNION ALL SELECT l.event_id, a.authority, a.source_key, a.artifact_id, 1, replace(l.relationship, '_', ' ') FROM links l JOIN artifacts a USING (artifact_id))
        GROUP BY 1, 2)) WHERE n <= 3 GROUP BY 1) r USING (event_id)""")
def a4(t):
    return linking.linkage_reasons(t["events"], t["links"], t["artifacts"])


@query("a5_linked_maxima", """SELECT e.work_id, round(g.authority, 6) AS linked_authority, round(g.novelty, 6) AS linked_novelty, e.corroboration AS linked_corroboration FROM
    (SELECT primary_work_id AS work_id, CAST(max(corroboration) AS DOUBLE) AS corroboration FROM linked_events WHERE primary_work_id IS NOT NULL GROUP BY 1) e
    LEFT JOIN (SELECT work_id, CAST(max(authority) AS DOUBLE) AS authority, CAST(max(novelty) AS DOUBLE) AS novelty FROM work_artifacts GROUP BY 1) g USING (work_id)""")
def a5(t):
    return ranking.linked_signals(t).select(
        "work_id", F.round("linked_authority", 6).alias("linked_authority"), F.round("linked_novelty", 6).alias("linked_novelty"), "linked_corroboration")


@query("a10_daily_budget", """SELECT k.analysis_type, coalesce(n, 0) AS generated, greatest(0, k.daily_limit - coalesce(n, 0)) AS remaining FROM (VALUES ('fast_brief', 10), ('deep_dive', 200)) k(analysis_type, daily_limit)
    LEFT JOIN (SELECT analysis_type, count(*) AS n FROM runs WHERE status = 'succeeded' AND created_at >= TIMESTAMP '2024-02-01' GROUP BY 1) USING (analysis_type)""")
def a10(t):
    return daily_budget(t["runs"], as_of(), {"fast_brief": 10, "deep_dive": 200})


@query("a12_processing_totals", """SELECT count(*) AS requested, count(CASE WHEN status = 'succeeded' THEN 1 END) AS succeeded, count(CASE WHEN status = 'failed' THEN 1 END) AS failed,
    count(CASE WHEN status = 'quarantined' THEN 1 END) AS quarantined FROM attempts""")
def a12(t):
    from scholarloom.operators.evidence import processing_totals

    return processing_totals(t["attempts"])


@query("a15_event_sentences", f"""SELECT event_id, source_count AS sources, CASE WHEN source_count > 1 THEN 'event_linked|' || title || '|' || source_count
    ELSE 'event_single|' || title END AS sentence FROM linked_events ORDER BY occurred_at DESC NULLS LAST, event_id LIMIT 8""")
def a15(t):
    return reports.event_sentences(t).select("event_id", "sources", "sentence")


@query("a17_coverage_gaps", """SELECT gap FROM (SELECT 'gap_documents|' || (SELECT count(*) FROM works WHERE work_type = 'paper' AND work_id NOT IN (SELECT work_id FROM with_docs)) AS gap
    UNION ALL SELECT 'gap_deep' WHERE NOT EXISTS (SELECT 1 FROM runs WHERE analysis_type = 'deep_dive' AND status = 'succeeded'))""")
def a17(t):
    return reports.coverage_gaps(t).select("gap")


@query("e5_topic_assignment", "SELECT work_id, topic_key FROM work_topics")
def e5(t):
    return t["work_topics"]


@query("e6_artifact_upsert", f"""SELECT artifact_id, artifact_type, source_type, title, novelty, sightings, round(freshness, 6) AS freshness, {sql_time('published_at')} AS published,
    {sql_time('updated_at')} AS updated FROM artifacts""")
def e6(t):
    return t["artifacts"].select("artifact_id", "artifact_type", "source_type", "title", "novelty", "sightings", F.round("freshness", 6).alias("freshness"),
                                 shown("published_at").alias("published"), shown("updated_at").alias("updated"))


@query("e7_attach_records", "SELECT record_id, work_id, basis FROM linked_rows")
def e7(t):
    return t["linked_rows"].select("record_id", "work_id", "basis")


@query("e8_event_upsert", f"SELECT event_id, canonical_key, title, primary_work_id, {sql_time('occurred_at')} AS occurred FROM event_base")
def e8(t):
    return t["events"].select("event_id", "canonical_key", "title", "primary_work_id", shown("occurred_at").alias("occurred"))


@query("e8_links", "SELECT event_id, artifact_id, relationship, basis, confidence, evidence FROM links")
def e8_links(t):
    return t["links"].select("event_id", "artifact_id", "relationship", "basis", "confidence", F.array_join("matching_evidence", "|").alias("evidence"))


_STORED = "SELECT * FROM linked_rows WHERE epoch_us(observed_at) // 3600000000 % 3 <> 0"
_BATCH = "SELECT * FROM linked_rows WHERE epoch_us(observed_at) // 3600000000 % 3 = 0"


def _two_batches(t):
    """Linked rows of two thirds of the hours as stored, the others as the batch that follows."""
    late = F.floor(F.unix_micros("observed_at") / 3_600_000_000) % 3 == 0
    return t["linked_rows"].filter(~late), t["linked_rows"].filter(late)


@query("e6_artifact_merge", f"""SELECT artifact_id, title, CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END AS novelty, n AS sightings FROM (
    SELECT artifact_id, coalesce(max_by(title, arrival) FILTER (WHERE late), max_by(title, arrival)) AS title, count(*) AS n FROM (
        SELECT *, sha256(source_key || chr(0) || upstream_id) AS artifact_id, epoch_us(observed_at) // 3600000000 % 3 = 0 AS late FROM faced) GROUP BY 1)""")
def e6_merge(t):
    facts = linking.with_source_facts(t["sightings"], linking.source_facts(t.spark))
    late = F.floor(F.unix_micros("observed_at") / 3_600_000_000) % 3 == 0
    stored = linking.upsert_artifacts(facts.filter(~late), as_of())
    return linking.upsert_artifacts(facts.filter(late), as_of(), existing=stored).select("artifact_id", "title", "novelty", "sightings")


@query("e8_event_merge", f"""SELECT event_id, title, primary_work_id, {sql_time('occurred_at')} AS occurred, {sql_time('updated_at')} AS updated FROM (
    SELECT sha256(canonical_key) AS event_id, coalesce(max_by(title, arrival) FILTER (WHERE late), max_by(title, arrival)) AS title, min(work_id) AS primary_work_id,
        coalesce(max_by(m, arrival) FILTER (WHERE late AND m IS NOT NULL), max_by(m, arrival) FILTER (WHERE m IS NOT NULL)) AS occurred_at, max(observed_at) AS updated_at
    FROM (SELECT *, coalesce(updated_at, published_at) AS m, epoch_us(observed_at) // 3600000000 % 3 = 0 AS late FROM linked_rows) GROUP BY canonical_key)""")
def e8_merge(t):
    before, batch = _two_batches(t)
    return linking.upsert_events(batch, existing=linking.upsert_events(before)).select(
        "event_id", "title", "primary_work_id", shown("occurred_at").alias("occurred"), shown("updated_at").alias("updated"))


@query("e8_link_merge", f"""SELECT event_id, artifact_id, coalesce(n.basis, s.basis) AS basis, n.event_id IS NOT NULL OR coalesce(s.source_key, '') <> 'reddit' AS active,
    CASE WHEN n.event_id IS NULL AND s.source_key = 'reddit' THEN 'mistaken' END AS reason FROM
    (SELECT sha256(canonical_key) AS event_id, artifact_id, any_value(source_key) AS source_key, max_by(basis, arrival) AS basis FROM ({_STORED}) GROUP BY canonical_key, artifact_id) s FULL JOIN
    (SELECT sha256(canonical_key) AS event_id, artifact_id, max_by(basis, arrival) AS basis FROM ({_BATCH}) GROUP BY canonical_key, artifact_id) n USING (event_id, artifact_id)""")
def e8_link_merge(t):
    """Stored links to the community source were switched off; those that the batch names again are back."""
    before, batch = _two_batches(t)
    wrong = before.filter("source_key = 'reddit'").select("event_id", "artifact_id").distinct()
    stored = linking.upsert_links(before, wrong.withColumn("corrected_at", at(90)).withColumn("reason", F.lit("mistaken")))
    return linking.upsert_links(batch, existing=stored).select("event_id", "artifact_id", "basis", "active", F.col("correction_reason").alias("reason"))


@query("e8_link_three_runs", f"""SELECT * FROM (WITH r AS (SELECT sha256(canonical_key) AS event_id, artifact_id, source_key, observed_at, arrival, basis FROM linked_rows),
    l AS (SELECT event_id, artifact_id, any_value(source_key) AS source_key, max(observed_at) AS seen, max_by(basis, (observed_at, arrival)) AS basis FROM r GROUP BY 1, 2),
    c AS (SELECT event_id, artifact_id, least(CASE WHEN source_key = 'reddit' AND TIMESTAMP '2024-01-10' >= seen THEN TIMESTAMP '2024-01-10' ELSE TIMESTAMP '2999-01-01' END,
        CASE WHEN source_key = 'reddit' AND TIMESTAMP '2024-01-27' >= seen THEN TIMESTAMP '2024-01-27' ELSE TIMESTAMP '2999-01-01' END) AS off FROM l)
    SELECT l.event_id, l.artifact_id, l.basis, c.off = TIMESTAMP '2999-01-01' AS active, CASE c.off WHEN TIMESTAMP '2024-01-10' THEN 'early' WHEN TIMESTAMP '2024-01-27' THEN 'late' END AS reason
    FROM l JOIN c USING (event_id, artifact_id))""")
def e8_three_runs(t):
    """Records in three runs, newest hours first, and two corrections of the community links, the later one before the earlier and both repeated: the log is folded to one state."""
    rows = t["linked_rows"]
    wrong = rows.filter("source_key = 'reddit'").select("event_id", "artifact_id").distinct()
    late, early = (wrong.withColumn("corrected_at", at(day)).withColumn("reason", F.lit(name)) for day, name in ((26, "late"), (9, "early")))
    third = F.floor(F.unix_micros("observed_at") / 3_600_000_000) % 3
    log = linking.link_log(rows.filter(third == 2), late)
    for part, corrections in ((rows.filter(third == 0), early), (rows.filter(third == 1), late.unionByName(early))):
        log = log.unionByName(linking.link_log(part, corrections))
    return linking.fold_links(log).select("event_id", "artifact_id", "basis", "active", F.col("correction_reason").alias("reason"))


@query("e9_manual_unlink", """SELECT b.event_id, count(DISTINCT a.source_key) AS source_count, least(1.0, greatest(0, count(DISTINCT a.source_key) - 1) / 2) AS corroboration FROM event_base b
    LEFT JOIN (SELECT event_id, source_key FROM links JOIN artifacts USING (artifact_id) WHERE source_key <> 'reddit') a USING (event_id) GROUP BY 1""")
def e9(t):
    """Every link to the community source is corrected; corroboration follows."""
    wrong = t["linked_rows"].filter("source_key = 'reddit'").select("event_id", "artifact_id").distinct()
    corrections = wrong.withColumn("corrected_at", at(90)).withColumn("reason", F.lit("mistaken"))
    links = linking.upsert_links(t["linked_rows"], corrections)
    base = linking.upsert_events(t["linked_rows"])
    return linking.event_measures(base, links, t["artifacts"]).select("event_id", "source_count", "corroboration")


@query("e10_event_sources", """SELECT l.event_id, a.artifact_id, a.source_key, a.authority, l.relationship FROM (SELECT event_id FROM linked_events ORDER BY occurred_at DESC NULLS LAST, event_id LIMIT 20) p
    JOIN links l USING (event_id) JOIN artifacts a USING (artifact_id)""")
def e10(t):
    chosen = linking.events_page(t["events"], t["links"], t["artifacts"])
    return linking.event_sources(chosen, t["links"], t["artifacts"]).select("event_id", "artifact_id", "source_key", "authority", "relationship")


@query("f17_source_facts", "SELECT record_id, authority, content_class, artifact_type, coalesce(fixed_source_type, artifact_type) AS source_type FROM faced")
def f17(t):
    return linking.with_source_facts(t["sightings"], linking.source_facts(t.spark)).select("record_id", "authority", "content_class", "artifact_type", "source_type")


@query("l6_launches_and_community", """SELECT 'launch' AS kind, artifact_id FROM (SELECT * FROM artifacts WHERE artifact_type IN ('repository', 'release', 'model', 'dataset', 'space') ORDER BY coalesce(updated_at, published_at) DESC NULLS LAST, artifact_id LIMIT 8)
    UNION ALL SELECT 'community', artifact_id FROM (SELECT * FROM artifacts WHERE content_class = 'community_reaction' OR authority < 0.5 ORDER BY coalesce(updated_at, published_at) DESC NULLS LAST, artifact_id LIMIT 8)""")
def l6(t):
    made = t["artifacts"].withColumn("created_at", F.lit(None).cast("timestamp"))
    return reports.recent_launches(made).select(F.lit("launch").alias("kind"), "artifact_id").unionByName(
        reports.community_signals(made).select(F.lit("community").alias("kind"), "artifact_id"))


@query("l7_events_page", """SELECT event_id, title FROM linked_events WHERE event_id IN (SELECT event_id FROM links JOIN artifacts USING (artifact_id) WHERE source_key = 'github')
    ORDER BY occurred_at DESC NULLS LAST, event_id LIMIT 20 OFFSET 5""")
def l7(t):
    return linking.events_page(t["events"], t["links"], t["artifacts"], "github", 20, 5).select("event_id", "title")


@query("l8_newest_event_per_work", "SELECT primary_work_id AS work_id, max_by(event_id, (updated_at, event_id)) AS event_id FROM event_base WHERE primary_work_id IS NOT NULL GROUP BY 1")
def l8(t):
    return linking.newest_event_per_work(t["events"])


@query("s12_repository_seeds", "SELECT DISTINCT repository_url AS url FROM versions WHERE is_current AND repository_url IS NOT NULL UNION SELECT DISTINCT repository_url FROM sightings WHERE repository_url IS NOT NULL")
def s12(t):
    return linking.repository_seeds(t["versions"], t["sightings"])


@query("u2_repository_mentions", "SELECT url, count(*) AS mentions FROM (SELECT repository_url AS url FROM versions UNION ALL SELECT repository_url FROM sightings) WHERE url IS NOT NULL GROUP BY 1")
def u2(t):
    urls = t["versions"].select(F.explode("repository_urls").alias("url")).unionByName(t["sightings"].select(F.explode("repository_urls").alias("url")))
    return urls.groupBy("url").agg(F.count("*").alias("mentions"))


@query("w10_first_writer", """SELECT work_id, author_order, min_by(version_id, version_id) AS version_id FROM (SELECT work_id, version_id, 1 + version_id % 3 AS author_order FROM versions) GROUP BY 1, 2""")
def w10(t):
    rows = t["versions"].select("work_id", "version_id", (1 + F.col("version_id") % 3).alias("author_order"),
                                F.lit(False).alias("stored"), F.col("version_id").alias("arrival"))
    return first_writer(rows).select("work_id", "author_order", "version_id")


@query("r1_feature_frame", """SELECT work_id, relevance, round(least(1.0, 0.5 + 0.2 * novelty + 0.1 * corroboration), 6) AS n, round(greatest(quality, authority), 6) AS q, round(freshness, 6) AS f,
    CASE WHEN has_document AND has_code THEN 0.9 WHEN has_document THEN 0.55 ELSE 0.25 END AS p FROM features""")
def r1(t):
    return ranking.feature_frame(t, as_of()).select(
        "work_id", "relevance", rounded(F.col("technical.N"), 6).alias("n"), rounded(F.col("technical.Q"), 6).alias("q"), rounded(F.col("technical.F"), 6).alias("f"), F.col("technical.P").alias("p"))


@query("r2_technical_score", "SELECT work_id, c_r, c_n, c_e, c_p, c_q, c_f, round(technical_score, 3) AS technical_score FROM scores")
def r2(t):
    c = "technical_components"
    return ranking.score(ranking.feature_frame(t, as_of())).select(
        "work_id", *[F.col(f"{c}.{k}").alias(f"c_{k.lower()}") for k in "RNEPQF"], rounded(F.col("technical_score"), 3).alias("technical_score"))


@query("r3_commercial_score", "SELECT work_id, c_b, c_x, round(commercial_score, 3) AS commercial_score FROM scores")
def r3(t):
    return ranking.score(ranking.feature_frame(t, as_of())).select(
        "work_id", F.col("commercial_components.B").alias("c_b"), F.col("commercial_components.X").alias("c_x"), rounded(F.col("commercial_score"), 3).alias("commercial_score"))


@query("r4_priority_score", "SELECT work_id, critical AS critical_topic, analyzed, round(priority_score, 3) AS priority_score FROM scores")
def r4(t):
    return ranking.score(ranking.feature_frame(t, as_of())).select("work_id", "critical_topic", "analyzed", rounded(F.col("priority_score"), 3).alias("priority_score"))


@query("r5_result_rows", """SELECT CAST(count(*) / 3 AS BIGINT) AS works_ranked, count(CASE WHEN work_id < 'w8' THEN NULL ELSE 1 END) AS results_created, count(CASE WHEN work_id < 'w8' THEN 1 END) AS results_reused FROM results""")
def r5(t):
    """Results of part of the works are stored already; the others are new."""
    return ranking.insert_summary(t["results"], t["results"].filter("work_id < 'w8'"))


@query("r5_new_results", "SELECT work_id, score_kind, round(total_score, 3) AS total_score FROM results WHERE work_id >= 'w8'")
def r5_new(t):
    return ranking.insert_results(t["results"], t["results"].filter("work_id < 'w8'")).select("work_id", "score_kind", rounded(F.col("total_score"), 3).alias("total_score"))


@query("r5_results_long", "SELECT work_id, score_kind, round(total_score, 3) AS total_score FROM results")
def r5_long(t):
    return t["results"].select("work_id", "score_kind", rounded(F.col("total_score"), 3).alias("total_score"))


@query("r7_topic_weight", "SELECT w.work_id, CAST(max(t.user_weight) AS DOUBLE) AS relevance FROM work_topics w JOIN topics t USING (topic_key) GROUP BY 1")
def r7(t):
    weights = F.broadcast(t["topics"].select("topic_key", "user_weight"))
    return t["work_topics"].join(weights, "topic_key").groupBy("work_id").agg(F.max("user_weight").alias("relevance"))


_LABELLED = "(SELECT d.doc_id AS id, CAST(d.n_chars AS DOUBLE) AS score, l.quality + (1 - l.toxic) AS relevance FROM labels l JOIN documents d USING (doc_id))"


def _labelled(t):
    return t.raw("labels").join(t.raw("documents").select("doc_id", "n_chars"), "doc_id").select(
        F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), (F.col("quality") + 1 - F.col("toxic")).alias("relevance"))


@query("q1_precision_at_10", f"SELECT count(CASE WHEN relevance > 0 THEN 1 END) / 10 AS precision FROM (SELECT * FROM {_LABELLED} ORDER BY score DESC, id LIMIT 10)")
def q1(t):
    return metrics.precision_at(_labelled(t))


@query("q2_ndcg_at_10", f"""SELECT round(d.g / i.g, 6) AS ndcg FROM
    (SELECT sum((pow(2, relevance) - 1) / log2(n + 1)) AS g FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS n FROM {_LABELLED}) WHERE n <= 10) d,
    (SELECT sum((pow(2, relevance) - 1) / log2(n + 1)) AS g FROM (SELECT *, row_number() OVER (ORDER BY relevance DESC, id) AS n FROM {_LABELLED}) WHERE n <= 10) i""")
def q2(t):
    return metrics.ndcg_at(_labelled(t)).select(F.round("ndcg", 6).alias("ndcg"))


@query("q3_completeness_and_repetition", r"""SELECT (SELECT round(avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 ELSE 0.0 END), 6) FROM labels) AS completeness,
    (SELECT round(1 - count(DISTINCT trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))) / count(*), 6) FROM documents) AS repetition_rate""")
def q3(t):
    fields = F.create_map(F.lit("good"), F.col("quality") == 1, F.lit("clean"), F.col("toxic") == 0)
    complete = metrics.completeness(t.raw("labels").select(fields.alias("fields"))).select(F.round("completeness", 6).alias("completeness"))
    return complete.join(metrics.repetition(t.raw("documents")).select(F.round("repetition_rate", 6).alias("repetition_rate")))


@query("q3_claim_rates", """SELECT round(count(CASE WHEN f AND len(evidence_ids) > 0 THEN 1 END) / greatest(1, count(CASE WHEN f THEN 1 END)), 6) AS citation_coverage,
    round(count(CASE WHEN NOT s AND r THEN 1 END) / greatest(1, count(CASE WHEN NOT s THEN 1 END)), 6) AS unsupported_rejection
    FROM (SELECT *, claim_type IN ('fact', 'interpretation') AS f, verification_status = 'supported' AS s, verification_status = 'rejected' AS r FROM claims)""")
def q3_rates(t):
    rows = t["claims"].select(
        F.col("claim_type").isin(settings.FACTUAL_TYPES).alias("factual"), (F.size("evidence_ids") > 0).alias("cited"),
        (F.col("verification_status") == "supported").alias("supported"), (F.col("verification_status") == "rejected").alias("rejected"))
    return metrics.claim_rates(rows).select(F.round("citation_coverage", 6).alias("citation_coverage"), F.round("unsupported_rejection", 6).alias("unsupported_rejection"))


@query("q4_quality_gate", f"""SELECT (SELECT count(CASE WHEN relevance > 0 THEN 1 END) / 10 FROM (SELECT * FROM {_LABELLED} ORDER BY score DESC, id LIMIT 10)) >= 0.9 AND
    (SELECT avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 ELSE 0.0 END) FROM labels) >= 0.98 AS passed""")
def q4(t):
    fields = F.create_map(F.lit("good"), F.col("quality") == 1, F.lit("clean"), F.col("toxic") == 0)
    scores = metrics.precision_at(_labelled(t)).withColumnRenamed("precision", "precision_at_10").join(
        metrics.completeness(t.raw("labels").select(fields.alias("fields"))))
    limits = {k: settings.QUALITY_THRESHOLDS[k] for k in ("precision_at_10", "completeness")}
    return metrics.quality_gate(scores, limits).select("passed")
