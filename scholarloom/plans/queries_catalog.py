"""Catalog, search, join and ordering queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from scholarloom import settings
from scholarloom.operators import catalog, linking, ranking, search, topics
from scholarloom.operators.catalog import CatalogQuery
from scholarloom.operators.listings import preferred_run
from scholarloom.operators.ordered import latest_by, top_per_key
from scholarloom.plans.corpus import as_of, sql_time
from scholarloom.plans.registry import listed, query, shown


@query("p1_catalog_base", "SELECT work_id, source_key, trust_tier, version_label, publication_status FROM papers")
def p1(t):
    return catalog.base_papers(t).select("work_id", "source_key", "trust_tier", "version_label", "publication_status")


@query("p2_search_documents", "SELECT work_id, title, body, topics FROM search_docs")
def p2(t):
    return search.search_documents(t["works"], t["authors"], t["work_topics"], t["topics"])


@query("p2b_index_refresh", """SELECT work_id, title, body, CASE WHEN work_id IN (SELECT work_id FROM works WHERE first_doc % 10 = 0) THEN topics || ' !' ELSE topics END AS topics
    FROM search_docs WHERE work_id NOT IN (SELECT work_id FROM works WHERE first_doc % 100 = 0)""")
def p2b(t):
    """Every tenth work changes, every hundredth is deleted; only those are rebuilt."""
    documents = search.search_documents(t["works"], t["authors"], t["work_topics"], t["topics"])
    changed = t["works"].filter("first_doc % 10 = 0").select("work_id")
    alive = t["works"].filter("first_doc % 100 <> 0")
    rebuilt = search.search_documents(alive.join(changed, "work_id", "left_semi"), t["authors"], t["work_topics"], t["topics"])
    return search.refresh(documents, rebuilt.withColumn("topics", F.concat("topics", F.lit(" !"))), changed)


@query("p3_keyword_search", """SELECT entity_id FROM search_terms GROUP BY entity_id
    HAVING count(CASE WHEN starts_with(term, 'th') THEN 1 END) > 0 AND count(CASE WHEN starts_with(term, 'ne') THEN 1 END) > 0 AND count(CASE WHEN starts_with(term, 'au') THEN 1 END) > 0""")
def p3(t):
    return search.matching_ids(t["search_terms"], "Th né au")


@query("p3_inverted_index", "SELECT field, term, count(*) AS entities FROM search_terms GROUP BY 1, 2")
def p3_index(t):
    return t["search_terms"].groupBy("field", "term").agg(F.count("*").alias("entities"))


@query("p3b_evidence_search", r"""SELECT DISTINCT span_id AS entity_id FROM (SELECT span_id, unnest(string_split_regex(strip_accents(replace(lower(text), 'ß', 'ss')), '[^\p{L}\p{N}]+')) AS term FROM spans)
    WHERE starts_with(term, 'ere')""")
def p3b(t):
    return search.matching_ids(search.search_terms(t["spans"], "span_id", ["text"]), "ère")


@query("p4_topic_filter", "SELECT work_id, title FROM papers WHERE work_id IN (SELECT work_id FROM work_topics WHERE topic_key = 'local-models')")
def p4(t):
    return catalog.filter_papers(catalog.base_papers(t), t, CatalogQuery(topic="local-models")).select("work_id", "title")


@query("p5_source_filter", """SELECT work_id FROM papers WHERE source_key = 'src3' OR work_id IN (SELECT work_id FROM work_artifacts WHERE source_key = 'src3')
    UNION ALL SELECT work_id FROM papers WHERE work_id IN (SELECT work_id FROM work_artifacts WHERE source_key = 'github')""")
def p5(t):
    own = catalog.filter_papers(catalog.base_papers(t), t, CatalogQuery(source="src3"))
    linked = catalog.filter_papers(catalog.base_papers(t), t, CatalogQuery(source="github"))
    return own.select("work_id").unionByName(linked.select("work_id"))


@query("p6_linked_filters", """SELECT work_id FROM papers WHERE work_id IN (SELECT work_id FROM work_artifacts WHERE source_type = 'release')
    AND work_id IN (SELECT work_id FROM work_artifacts WHERE authority >= 0.9)
    AND work_id IN (SELECT primary_work_id FROM linked_events WHERE corroboration >= 1.0)
    AND work_id IN (SELECT primary_work_id FROM linked_events)""")
def p6(t):
    wanted = CatalogQuery(source_type="release", minimum_authority=0.9, minimum_corroboration=1.0, linked_only=True)
    return catalog.filter_papers(catalog.base_papers(t), t, wanted).select("work_id")


@query("p7_publication_range", f"""SELECT work_id, {sql_time('publication_date')} AS published FROM papers
    WHERE publication_date >= TIMESTAMP '2023-06-01' AND publication_date < TIMESTAMP '2023-09-01'""")
def p7(t):
    wanted = CatalogQuery(published_from=date(2023, 6, 1), published_to=date(2023, 8, 31))
    return catalog.filter_papers(catalog.base_papers(t), t, wanted).select("work_id", shown("publication_date").alias("published"))


@query("p8_match_reason", """SELECT work_id, 'topic filter, publication date filter' AS match_reason FROM papers
    WHERE work_id IN (SELECT work_id FROM work_topics WHERE topic_key = 'multimodal-systems') AND publication_date >= TIMESTAMP '2023-01-01'
    ORDER BY publication_date DESC NULLS LAST, work_id LIMIT 20""")
def p8(t):
    wanted = CatalogQuery(topic="multimodal-systems", published_from=date(2023, 1, 1))
    return catalog.catalog_page(t, wanted).select("work_id", "match_reason")


@query("p9_paper_detail", "SELECT work_id, title, version_label, source_key FROM papers WHERE work_id = (SELECT min(work_id) FROM papers)")
def p9(t):
    first = catalog.base_papers(t).agg(F.min("work_id").alias("work_id"))
    return catalog.paper_detail(t, first).select("work_id", "title", "version_label", "source_key")


@query("p10_document_status", """SELECT v.version_id, coalesce(d.parse_status, a.status, 'not_acquired') AS document_status FROM versions v
    LEFT JOIN (SELECT version_id, max_by(parse_status, (acquired_at, document_id)) AS parse_status FROM pdfs GROUP BY 1) d USING (version_id)
    LEFT JOIN (SELECT version_id, max_by(status, (attempted_at, attempt_id)) AS status FROM attempts GROUP BY 1) a USING (version_id)""")
def p10(t):
    return catalog.document_status(t["versions"], t["documents"], t["attempts"])


@query("p11_primary_links", """SELECT work_id, CASE id_type WHEN 'arxiv' THEN 'https://arxiv.org/abs/' || value ELSE 'https://doi.org/' || value END AS external_url FROM (
    SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY CASE WHEN id_type = 'arxiv' THEN 0 ELSE 1 END, id_type, value) AS n FROM external_ids WHERE id_type IN ('arxiv', 'doi')) WHERE n = 1""")
def p11(t):
    return catalog.primary_links(catalog.identities_of(t["works"], t))


@query("p12_entity_listing", "SELECT run_id, work_id, status FROM runs WHERE analysis_type = 'deep_dive' AND status = 'succeeded' ORDER BY created_at DESC, run_id DESC LIMIT 25 OFFSET 5")
def p12(t):
    wanted = {"analysis_type": "deep_dive", "status": "succeeded"}
    return catalog.listing(t["runs"], wanted, [F.col("created_at").desc(), F.col("run_id").desc()], 25, 5).select("run_id", "work_id", "status")


@query("p13_documents_to_process", """SELECT w.work_id, v.version_id, x.value AS arxiv_id FROM works w JOIN versions v ON v.version_id = w.current_version_id
    JOIN external_ids x ON x.work_id = w.work_id AND x.id_type = 'arxiv' WHERE w.work_type = 'paper'
    AND v.version_id NOT IN (SELECT version_id FROM pdfs WHERE parse_status IN ('parsed', 'partial'))""")
def p13(t):
    return catalog.documents_to_process(t, None).select("work_id", "version_id", "arxiv_id")


@query("p15_fetch_window", "SELECT version_id, work_id FROM versions WHERE published_at IS NULL OR (published_at >= TIMESTAMP '2023-03-01' AND published_at <= TIMESTAMP '2023-10-01')")
def p15(t):
    from scholarloom.sources.landing import within_window

    dated = t["versions"].withColumn("updated_at", F.col("published_at"))
    since, until = F.lit("2023-03-01").cast("timestamp"), F.lit("2023-10-01").cast("timestamp")
    return within_window(dated, since, until).select("version_id", "work_id")


@query("p17_evidence_listing", """SELECT page, char_start, span_id, text FROM spans WHERE document_id IN (SELECT document_id FROM pdfs WHERE version_id IN (
    SELECT current_version_id FROM works WHERE work_id = (SELECT min(work_id) FROM works w JOIN pdfs d ON d.version_id = w.current_version_id)))
    ORDER BY page, char_start, span_id LIMIT 50""")
def p17(t):
    """Evidence of the first work whose current version has a document."""
    current = t["works"].select("work_id", F.col("current_version_id").alias("version_id"))
    first = current.join(t["documents"], "version_id", "left_semi").agg(F.min("work_id").alias("work_id"))
    return catalog.evidence_listing(t, first).select("page", "char_start", "span_id", "text")


@query("j1_star_join", "SELECT trust_tier, publication_status, count(*) AS papers FROM papers GROUP BY 1, 2")
def j1(t):
    return catalog.base_papers(t).groupBy("trust_tier", "publication_status").agg(F.count("*").alias("papers"))


@query("j2_existence_flags", "SELECT work_id, has_document, has_code, analyzed FROM features")
def j2(t):
    return ranking.feature_frame(t, as_of()).select("work_id", "has_document", "has_code", "analyzed")


@query("j3_papers_without_documents", "SELECT work_id FROM works WHERE work_type = 'paper' AND work_id NOT IN (SELECT work_id FROM with_docs)")
def j3(t):
    return catalog.works_without_documents(t)


@query("j5_latest_brief", """SELECT w.work_id, b.run_id FROM works w LEFT JOIN (SELECT work_id, max_by(run_id, (completed_at, run_id)) AS run_id FROM runs
    WHERE analysis_type = 'fast_brief' AND status = 'succeeded' GROUP BY 1) b USING (work_id) WHERE w.work_type = 'paper'""")
def j5(t):
    return ranking.newest_briefs(t).select("work_id", "run_id")


@query("j6_identifier_lookup", "SELECT s.record_id, x.work_id FROM sightings s JOIN external_ids x ON x.id_type = 'arxiv' AND x.value = s.paper_id")
def j6(t):
    return linking.attach_by_identity(t["sightings"], t["external_ids"])


@query("j8_shared_repository", r"SELECT s.record_id, r.work_id FROM sightings s JOIN repo_owners r ON r.url = regexp_replace(lower(s.repository_url), '\.git$', '')")
def j8(t):
    return linking.attach_by_repository(t["sightings"], t["versions"])


@query("j9_page_details", """SELECT p.work_id, a.names AS authors, t.keys AS topics FROM (SELECT work_id FROM papers ORDER BY publication_date DESC NULLS LAST, work_id LIMIT 50) p
    LEFT JOIN (SELECT work_id, string_agg(display_name, '|' ORDER BY author_order) AS names FROM authors GROUP BY 1) a USING (work_id)
    LEFT JOIN (SELECT work_id, string_agg(topic_key, '|' ORDER BY display_name, topic_key) AS keys FROM work_topics JOIN topics USING (topic_key) GROUP BY 1) t USING (work_id)""")
def j9(t):
    ids = catalog.catalog_page(t, CatalogQuery(limit=50)).select("work_id")
    return (
        ids.join(catalog.authors_of(ids, t), "work_id", "left").join(catalog.topics_of(ids, t), "work_id", "left")
        .select("work_id", listed(F.transform("authors", lambda a: a["display_name"])).alias("authors"),
                listed(F.transform("topics", lambda x: x["topic_key"])).alias("topics")))


@query("j9_page_linked_sources", """SELECT p.work_id, a.artifact_id, a.source_key, a.artifact_type, a.relationship FROM (SELECT work_id FROM papers ORDER BY normalized_title NULLS LAST, work_id LIMIT 50) p
    JOIN work_artifacts a USING (work_id)""")
def j9_linked(t):
    ids = catalog.catalog_page(t, CatalogQuery(limit=50, sort="title")).select("work_id")
    return catalog.linked_sources_of(ids, t).select("work_id", "artifact_id", "source_key", "artifact_type", "relationship")


@query("j12_event_bridge", "SELECT source_key, relationship, count(*) AS links, count(DISTINCT work_id) AS works FROM work_artifacts GROUP BY 1, 2")
def j12(t):
    rows = catalog.linked_artifacts(t, active_only=True).groupBy("source_key", "relationship", "work_id").agg(F.count("*").alias("n"))
    return rows.groupBy("source_key", "relationship").agg(F.sum("n").alias("links"), F.count("*").alias("works"))


@query("j10_topics_zero_filled", """SELECT t.topic_key, count(w.work_id) AS paper_count, count(CASE WHEN CAST(v.observed_at AS DATE) = DATE '2024-01-15' THEN 1 END) AS daily_change
    FROM topics t LEFT JOIN work_topics w USING (topic_key) LEFT JOIN works k USING (work_id) LEFT JOIN versions v ON v.version_id = k.current_version_id GROUP BY 1""")
def j10(t):
    day = F.lit("2024-01-15").cast("date")
    return topics.topic_counts(t["topics"], t["work_topics"], t["works"], t["versions"], day).select("topic_key", "paper_count", "daily_change")


@query("w1_latest_order_per_customer", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def w1(t):
    return latest_by(t.raw("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select(
        "o_custkey", "o_orderkey")


@query("w2_preferred_run", """SELECT work_id, analysis_type, max_by(run_id, (CASE WHEN status = 'succeeded' THEN 1 ELSE 0 END, created_at, run_id)) AS run_id
    FROM runs GROUP BY 1, 2""")
def w2(t):
    return preferred_run(t["runs"]).select("work_id", "analysis_type", "run_id")


@query("w3_top_works_per_topic", """SELECT topic_key, work_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic_key ORDER BY score DESC, work_id) AS rank FROM (
    SELECT w.topic_key, w.work_id, coalesce(s.technical_score, 0.0) AS score FROM work_topics w LEFT JOIN scores s USING (work_id))) WHERE rank <= 5""")
def w3(t):
    return topics.top_works_per_topic(t["work_topics"], t["works"], t["versions"], t["results"]).select("topic_key", "work_id", "score", "rank")


@query("w3_top_lineitems_per_part", """SELECT l_partkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey, l_quantity) AS rank
    FROM lineitem) WHERE rank <= 3""")
def w3_lines(t):
    rows = t.raw("lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_quantity")]
    return top_per_key(rows, ["l_partkey"], order, 3).select("l_partkey", "l_orderkey", "l_linenumber", "rank")


@query("w4_current_version", "SELECT work_id, version_id, version_label FROM versions WHERE is_current")
def w4(t):
    return t["versions"].filter("is_current").select("work_id", "version_id", "version_label")


@query("w13_revised_works", """SELECT v.work_id, v.version_id, c.n AS versions FROM versions v JOIN (SELECT work_id, count(*) AS n FROM versions GROUP BY 1) c USING (work_id)
    WHERE v.is_current AND c.n > 1 ORDER BY v.observed_at DESC, v.work_id LIMIT 10""")
def w13(t):
    from scholarloom.operators.reports import revision_updates

    return revision_updates(t).select("work_id", "version_id", "versions")


_ORDERS = {
    "newest": "publication_date DESC NULLS LAST, work_id", "oldest": "publication_date NULLS LAST, work_id", "title": "normalized_title NULLS LAST, work_id",
    "updated": "updated_at DESC NULLS LAST, work_id", "technical": "technical_score DESC NULLS LAST, publication_date DESC NULLS LAST, work_id",
    "commercial": "commercial_score DESC NULLS LAST, publication_date DESC NULLS LAST, work_id",
    "priority": "priority_score DESC NULLS LAST, publication_date DESC NULLS LAST, work_id",
}


def _register_orders() -> None:
    for name, order in _ORDERS.items():
        scored = name in ("technical", "commercial", "priority")
        source = f"(SELECT p.*, s.{name}_score FROM papers p LEFT JOIN scores s USING (work_id))" if scored else "papers"

        @query(f"l1_order_{name}", f"SELECT work_id, title FROM {source} ORDER BY {order} LIMIT 30 OFFSET 10")
        def ordered(t, name=name):
            return catalog.catalog_page(t, CatalogQuery(sort=name, limit=30, offset=10)).select("work_id", "title")


_register_orders()


@query("l2_page_summary", "SELECT count(*) AS total, CAST(50 AS BIGINT) AS \"limit\", CAST(100 AS BIGINT) AS \"offset\", count(*) > 150 AS has_more FROM papers")
def l2(t):
    return catalog.page_summary(catalog.base_papers(t), 50, 100)


@query("l3_ranked_list", f"""SELECT s.work_id, s.technical_score AS total_score, CASE WHEN analyzed THEN 'analyzed' ELSE 'unreviewed' END AS status,
    coalesce(CASE WHEN length(sentence) > 240 THEN rtrim(substr(sentence, 1, 237)) || '…' ELSE sentence END, '{settings.TEXTS['no_abstract']}') AS reason FROM (
    SELECT *, regexp_replace(nullif(trim(regexp_replace(abstract, '\\s+', ' ', 'g')), ''), '^(.*?[.!?])\\s.*$', '\\1') AS sentence FROM scores) s
    ORDER BY technical_score DESC, work_id LIMIT 10""")
def l3(t):
    return ranking.ranked(t, "technical").select("work_id", "total_score", "status", "reason")


@query("l4_ranking_candidates", "SELECT work_id FROM papers ORDER BY coalesce(first_published_at, created_at) DESC NULLS LAST, work_id LIMIT 100")
def l4(t):
    return ranking.feature_frame(t, as_of(), limit=100).select("work_id")


@query("l5_tiered_selection", """SELECT work_id, min(tier) AS tier FROM (
    SELECT work_id, 1 AS tier, row_number() OVER (ORDER BY completed_at DESC, run_id DESC) AS n FROM runs WHERE analysis_type = 'deep_dive' AND status = 'succeeded' AND created_at >= TIMESTAMP '2024-02-08'
    UNION ALL SELECT j.work_id, 2, row_number() OVER (ORDER BY s.priority_score DESC, j.updated_at, j.job_id) FROM jobs j JOIN scores s USING (work_id) WHERE j.status IN ('failed', 'rejected')
    UNION ALL SELECT s.work_id, 3, row_number() OVER (ORDER BY s.priority_score DESC, s.work_id) FROM scores s WHERE s.work_id IN (SELECT w.work_id FROM works w JOIN pdfs p ON p.version_id = w.current_version_id
        JOIN spans e ON e.document_id = p.document_id WHERE p.parse_status IN ('parsed', 'partial'))) WHERE n <= 3 GROUP BY work_id ORDER BY min((tier, n)) LIMIT 3""")
def l5(t):
    return ranking.tiered_selection(t, F.lit("2024-02-08").cast("timestamp")).select("work_id", "tier")


@query("u1_filter_options", """SELECT 'topic' AS kind, topic_key AS key, display_name AS label FROM topics WHERE topic_key IN (SELECT topic_key FROM work_topics JOIN works USING (work_id) WHERE work_type = 'paper')
    UNION ALL SELECT 'source', source_key, display_name FROM (SELECT source_key, display_name FROM papers UNION SELECT source_key, display_name FROM sources WHERE source_key IN (SELECT source_key FROM artifacts))""")
def u1(t):
    options = catalog.topic_options(t).select(F.lit("topic").alias("kind"), F.col("topic_key").alias("key"), F.col("display_name").alias("label"))
    sources = catalog.source_options(t).select(F.lit("source").alias("kind"), F.col("source_key").alias("key"), F.col("display_name").alias("label"))
    return options.unionByName(sources)


@query("a7_evidence_counts", "SELECT version_id, count(*) AS evidence_count FROM spans GROUP BY 1")
def a7(t):
    documents = t["text_pages"].select("document_id", "version_id").distinct()
    return catalog.evidence_counts(documents, t["spans"])


@query("a13_ordered_names", "SELECT work_id, string_agg(display_name, ' ' ORDER BY author_order) AS names FROM authors GROUP BY 1")
def a13(t):
    return t["authors"].groupBy("work_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("author_order", "display_name"))), lambda a: a["display_name"]), " ").alias("names"))
