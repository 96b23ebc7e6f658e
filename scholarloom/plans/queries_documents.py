"""Landing, normalising, evidence, gate, report, identity and ingestion queries."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from scholarloom import settings
from scholarloom.functions.dates import any_timestamp, iso_timestamp
from scholarloom.functions.identifiers import (
    canonical_repository, normalized_identity, public_url, repository_match_form, version_label,
)
from scholarloom.functions.mentions import paper_mentions, repository_mentions, transcript_mentions
from scholarloom.functions.scoring import clamp, half_life_freshness, linear_freshness, tier_quality
from scholarloom.functions.text import (
    casefold, clean, comparison_form, first_sentence, is_heading, label_form, normal_form, sorted_json,
    stable_key,
)
from scholarloom.operators import evidence, gates, identity_store, invariants, ranking, reports
from scholarloom.operators.identity import resolve_identities
from scholarloom.operators.ordered import global_position
from scholarloom.operators.retention import retention_plan
from scholarloom.operators.similar import similar_titles, titles_near
from scholarloom.plans.corpus import EPOCH, as_of, at, first_line, pick, preprint, sql_at, sql_collapse, sql_normal, sql_pick, sql_preprint, sql_published, sql_time, work_key
from scholarloom.plans.registry import listed, query, shown
from scholarloom.session import durable, shared_dir
from scholarloom.sources import landing
from scholarloom.sources.feeds import normalize_posts
from scholarloom.sources.hub import normalize_hub
from scholarloom.sources.notes import normalize_notes
from scholarloom.sources.papers import landing_identity, normalize_papers
from scholarloom.sources.records import status_totals
from scholarloom.sources.repositories import normalize_repositories
from scholarloom.sources.social import exported_items, normalize_social
from scholarloom.streaming.ingest import batch_rows, ingest_files, landed_tables, store_batch

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


# --- payloads built from the documents -----------------------------------------------------------


def _payloads(t, payload: Column, upstream: Column, url: Column, source: str, version: Column | None = None) -> DataFrame:
    """Documents as landed payloads of one source."""
    doc = F.col("doc_id")
    return t.raw("documents").select(
        doc.alias("record_id"), F.lit(source).alias("source_key"), upstream.alias("upstream_id"),
        (F.lit(None).cast("string") if version is None else version).alias("upstream_version"), url.alias("canonical_url"),
        at(doc % 31).alias("observed_at"), at(doc % 29).alias("published_at"), at(doc % 30).alias("updated_at"),
        F.lit("application/json").alias("media_type"), payload.cast("binary").alias("payload"))


def _xml(text: Column) -> Column:
    safe = F.regexp_replace(text, CONTROL, " ")
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(mark), F.lit(entity))
    return safe


def _element(name: str, text: Column) -> Column:
    """Element, or nothing when the text is NULL."""
    return F.coalesce(F.concat(F.lit(f"<{name}>"), _xml(text), F.lit(f"</{name}>")), F.lit(""))


def _rest(text: Column) -> Column:
    return F.nullif(F.substring(text, F.length(first_line(text)) + 2, F.length(text)), F.lit(""))


def _entries(t) -> DataFrame:
    """Atom entries: every eleventh without an id, every nineteenth without a usable date."""
    doc, text = F.col("doc_id"), F.col("text")
    identity = F.when(doc % 11 != 0, F.concat(F.lit("http://arxiv.org/abs/"), preprint(doc), F.lit("v"), doc % 3 + 1))
    doi = F.when(doc % 3 == 0, F.concat(F.lit("https://doi.org/10.5555/D."), doc)).when(doc % 3 == 1, F.lit("bad doi"))
    entry = F.concat(
        F.lit('<a:entry xmlns:a="http://www.w3.org/2005/Atom" xmlns:p="http://arxiv.org/schemas/atom">'),
        _element("a:id", identity), _element("a:title", first_line(text)),
        _element("a:published", F.when(doc % 19 != 0, F.lit("2024-01-02T03:04:05Z")).otherwise(F.lit("soon"))),
        _element("a:updated", F.lit("2024-01-05T00:00:00+01:00")),
        _element("a:summary", F.concat(F.coalesce(_rest(text), F.lit("")), F.lit(" code at https://github.com/own/r"), doc, F.lit("."))),
        F.lit("<a:author><a:name>"), F.concat(F.lit("Ann "), F.col("lang")), F.lit("</a:name></a:author>"),
        F.when(doc % 2 == 0, F.lit("<a:author><a:name>Bob  B</a:name></a:author>")).otherwise(F.lit("")),
        F.lit('<a:category term="cs.AI"/><a:category term="cs.AI"/><a:category term="'), F.col("lang"), F.lit('"/>'),
        _element("p:doi", doi), F.lit("</a:entry>"))
    raw = _payloads(t, entry, F.lit(""), F.lit(""), "arxiv")
    return landing_identity(raw.drop("upstream_id", "upstream_version", "canonical_url", "published_at", "updated_at"))


_TITLE = sql_collapse(r"regexp_replace(split_part(text, chr(10), 1), '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g')")
_ENTRY_STATUS = f"CASE WHEN doc_id % 11 = 0 OR doc_id % 19 = 0 OR {_TITLE} = '' OR {sql_normal(_TITLE)} IS NULL THEN 'failed' ELSE 'normalized' END"


@query("s3_normalize_papers", f"""SELECT doc_id AS record_id, {_ENTRY_STATUS} AS status, nullif({_TITLE}, '') AS title,
    CASE WHEN doc_id % 11 <> 0 THEN {sql_preprint('doc_id')} END AS upstream_id,
    CASE WHEN doc_id % 11 <> 0 THEN 'v' || (doc_id % 3 + 1) ELSE 'v1' END AS upstream_version, 2 - doc_id % 2 AS authors, 'cs.AI|' || lang AS topics,
    CASE WHEN doc_id % 3 = 0 THEN '10.5555/d.' || doc_id END AS doi, 'https://github.com/own/r' || doc_id AS repositories FROM documents""")
def s3(t):
    doi = F.filter("identities", lambda i: i["id_type"] == "doi")
    return normalize_papers(_entries(t)).select(
        "record_id", "status", "title", "upstream_id", "upstream_version", F.size("authors").alias("authors"), listed("source_topics").alias("topics"),
        F.try_element_at(doi, F.lit(1))["normalized_value"].alias("doi"), listed("repository_urls").alias("repositories"))


@query("s3b_landing_identity", f"""SELECT doc_id AS record_id, CASE WHEN doc_id % 11 <> 0 THEN {sql_preprint('doc_id')} ELSE 'malformed' END AS upstream_id,
    CASE WHEN doc_id % 11 <> 0 THEN 'v' || (doc_id % 3 + 1) END AS upstream_version FROM documents""")
def s3b(t):
    return _entries(t).select("record_id", F.regexp_replace("upstream_id", "^malformed:[0-9a-f]{16}$", "malformed").alias("upstream_id"), "upstream_version")


@query("s4_normalize_notes", f"""SELECT doc_id AS record_id, nullif({sql_collapse('split_part(text, chr(10), 1)')}, '') AS title,
    CASE WHEN {sql_normal("split_part(text, chr(10), 1)")} IS NULL OR doc_id % 13 = 0 THEN 'rejected' ELSE 'normalized' END AS status,
    CASE WHEN doc_id % 5 = 0 OR doc_id % 13 = 0 THEN 'accepted' ELSE 'submitted' END AS publication_status, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 1 END AS authors FROM documents""")
def s4(t):
    """Every fifth note has a decision, every thirteenth claims acceptance without one."""
    doc, text = F.col("doc_id"), F.col("text")
    note = F.to_json(F.struct(
        F.when(doc % 7 == 0, F.array(F.lit("all"))).alias("nonreaders"),
        F.struct(
            F.struct(first_line(text).alias("value")).alias("title"), _rest(text).alias("abstract"),
            F.struct(F.array(F.concat(F.lit("Ann "), F.col("lang")), F.lit("Anonymous 7")).alias("value")).alias("authors"),
            F.when(doc % 13 == 0, F.lit("Accepted papers")).otherwise(F.lit("Conf")).alias("venue"),
            F.struct(F.when((doc % 5 == 0) & (doc % 13 != 0), F.lit("Accept")).alias("value")).alias("decision")).alias("content")))
    url = F.concat(F.lit("https://openreview.net/forum?id=n"), doc)
    rows = normalize_notes(_payloads(t, note, F.concat(F.lit("n"), doc), url, "openreview"))
    return rows.select("record_id", "title", "status", "publication_status", F.size("authors").alias("authors"))


@query("s5_normalize_repositories", """SELECT doc_id AS record_id, lower('Own/' || source || '-' || doc_id) AS upstream_id, 'https://github.com/Own/' || source AS canonical_url, 'normalized' AS status,
    CASE WHEN doc_id % 2 = 0 THEN 'MIT' END AS license_hint, doc_id % 50 AS open_issues, lang AS topics FROM documents""")
def s5(t):
    doc = F.col("doc_id")
    body = F.to_json(F.struct(
        F.concat(F.lit("Own/"), F.col("source"), F.lit("-"), doc).alias("full_name"), first_line(F.col("text")).alias("description"), F.array("lang").alias("topics"),
        F.when(doc % 2 == 0, F.struct(F.lit("MIT").alias("spdx_id"))).alias("license"), (doc % 50).alias("open_issues_count"), F.lit(False).alias("archived")))
    url = F.concat(F.lit("https://github.com/Own/"), F.col("source"), F.lit(".git"))
    rows = normalize_repositories(_payloads(t, body, F.lit(""), url, "github"))
    return rows.select("record_id", "upstream_id", "canonical_url", "status", "license_hint", F.col("extra")["open_issues_count"].cast("bigint").alias("open_issues"),
                       listed("source_topics").alias("topics"))


@query("s6_normalize_releases", """SELECT doc_id AS record_id, CASE WHEN doc_id % 9 = 0 THEN 'rejected' ELSE 'normalized' END AS status, CASE WHEN doc_id % 9 <> 0 THEN 'own/' || source || '@v' || doc_id END AS identity,
    CASE WHEN doc_id % 9 <> 0 THEN 'Own/' || source || ' V' || doc_id END AS title FROM documents""")
def s6(t):
    doc = F.col("doc_id")
    body = F.to_json(F.array(F.struct(F.when(doc % 9 != 0, F.concat(F.lit("V"), doc)).alias("tag_name"), first_line(F.col("text")).alias("body"))))
    url = F.concat(F.lit("https://github.com/Own/"), F.col("source"), F.lit("/releases"))
    rows = normalize_repositories(_payloads(t, body, F.concat(F.lit("r"), doc), url, "github"))
    return rows.select("record_id", "status", F.col("identities")[0]["normalized_value"].alias("identity"), "title")


@query("s7_normalize_hub", """SELECT doc_id AS record_id, CASE WHEN doc_id % 10 = 9 THEN 'rejected' ELSE 'normalized' END AS status, CASE doc_id % 3 WHEN 0 THEN 'model' WHEN 1 THEN 'dataset' ELSE 'space' END AS work_type,
    'org/' || source || '-' || doc_id AS title, '2401.' || doc_id % 7 AS papers FROM documents""")
def s7(t):
    doc = F.col("doc_id")
    body = F.to_json(F.struct(
        pick(doc % 3, ["models", "datasets", "spaces"]).alias("kind"),
        F.struct(F.concat(F.lit("org/"), F.col("source"), F.lit("-"), doc).alias("id"),
                 F.array(F.col("lang"), F.concat(F.lit("arXiv:2401."), doc % 7)).alias("tags"), doc.alias("downloads")).alias("item")))
    url = F.concat(F.when(doc % 10 == 9, "https://elsewhere.example/").otherwise("https://huggingface.co/"), doc)
    rows = normalize_hub(_payloads(t, body, F.concat(F.lit("h"), doc), url, "huggingface"))
    papers = F.filter("identities", lambda i: i["id_type"] == "arxiv")
    return rows.select("record_id", "status", "work_type", "title", listed(F.transform(papers, lambda i: i["normalized_value"])).alias("papers"))


@query("s8_normalize_posts", f"""SELECT doc_id AS record_id, nullif({_TITLE}, '') AS title, CASE WHEN {sql_normal(_TITLE)} IS NULL OR doc_id % 5 = 0 THEN 'rejected' ELSE 'normalized' END AS status,
    {sql_preprint('doc_id', 1)} AS papers, 'https://github.com/post/r' || doc_id % 100 AS repositories FROM documents""")
def s8(t):
    doc, text = F.col("doc_id"), F.col("text")
    mention = F.concat(F.lit(" see arXiv:"), preprint(doc, 1), F.lit("v2 and https://github.com/post/r"), doc % 100)
    body = F.concat(F.lit("<item>"), _element("title", first_line(text)), _element("description", F.concat(F.coalesce(_rest(text), F.lit("")), mention)), F.lit("</item>"))
    url = F.concat(F.when(doc % 5 == 0, "https://other.example.org/").otherwise("https://blog.example.com/"), doc)
    rows = normalize_posts(_payloads(t, body, F.concat(F.lit("p"), doc), url, "official-rss"), ["blog.example.com"])
    papers = F.filter("identities", lambda i: i["id_type"] == "arxiv")
    return rows.select("record_id", "title", "status", listed(F.transform(papers, lambda i: i["normalized_value"])).alias("papers"), listed("repository_urls").alias("repositories"))


@query("s9_normalize_social", f"""SELECT conv_id || '-' || turn AS upstream_id, substr(text, 1, 160) AS title, length(text) AS characters, {sql_time("TIMESTAMP '2024-01-01' + to_seconds(conv_id)")} AS published
    FROM conversations WHERE turn % 3 <> 0 AND {sql_collapse('text')} <> ''""")
def s9(t):
    conv, turn = F.col("conv_id"), F.col("turn")
    item = F.to_json(F.struct(
        F.concat_ws("-", conv, turn).alias("id"), "text", (F.lit(EPOCH) + conv).alias("created_at"),
        F.concat(F.when(turn % 3 == 0, "https://elsewhere.example/").otherwise("https://x.com/a/"), conv).alias("url")))
    items = exported_items(t.raw("conversations").select(item.cast("binary").alias("payload"), at(conv % 31).alias("observed_at")))
    rows = normalize_social(items)
    return rows.select("upstream_id", "title", F.length("abstract").alias("characters"), shown("published_at").alias("published"))


@query("s10_validation_errors", """SELECT 'accepted status requires public decision evidence' AS error, count(*) AS records FROM documents WHERE doc_id % 13 = 0
    UNION ALL SELECT 'canonical URL must be on the review platform', count(*) FROM documents WHERE doc_id % 17 = 0""")
def s10(t):
    doc = F.col("doc_id")
    note = F.to_json(F.struct(F.struct(F.lit("T").alias("title"), F.when(doc % 13 == 0, F.lit("Accepted")).alias("venue")).alias("content")))
    url = F.concat(F.when(doc % 17 == 0, "https://elsewhere.example/").otherwise("https://openreview.net/forum?id="), doc)
    rows = normalize_notes(_payloads(t, note, F.concat(F.lit("n"), doc), url, "openreview"))
    return rows.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("records"))


@query("e11_batch_status", f"SELECT count(CASE WHEN s = 'normalized' THEN 1 END) AS normalized, CAST(0 AS BIGINT) AS rejected, count(CASE WHEN s = 'failed' THEN 1 END) AS failed, CAST(0 AS BIGINT) AS manual_review FROM (SELECT {_ENTRY_STATUS} AS s FROM documents)")
def e11(t):
    return status_totals(normalize_papers(_entries(t)))


def _text_payloads(t) -> DataFrame:
    return _payloads(t, F.col("text"), F.concat(F.lit("d"), F.floor(F.col("doc_id") / 2)), F.lit("https://example.org"), "feed")


@query("s1_landed_payloads", """SELECT doc_id AS record_id, sha256(text) AS payload_sha256, strlen(text) AS byte_size, strftime(TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 31 AS INT)), '%Y-%m-%d') AS observed_date,
    CASE WHEN strlen(text) > 20000 THEN 'payload too large' END AS refused FROM documents""")
def s1(t):
    rows = landing.address(_text_payloads(t), max_bytes=20_000)
    return rows.select("record_id", "payload_sha256", "byte_size", F.col("observed_date").cast("string").alias("observed_date"), "refused")


@query("s2_verify_payloads", "SELECT CASE WHEN doc_id % 50 = 0 THEN 'corrupt' ELSE 'intact' END AS state, count(*) AS n FROM documents GROUP BY 1")
def s2(t):
    stored = landing.address(_text_payloads(t)).withColumn(
        "payload_sha256", F.when(F.col("record_id") % 50 == 0, F.lit("0")).otherwise(F.col("payload_sha256")))
    intact, corrupt = landing.verify(stored)
    both = intact.select(F.lit("intact").alias("state")).unionByName(corrupt.select(F.lit("corrupt").alias("state")))
    return both.groupBy("state").agg(F.count("*").alias("n"))


@query("a11_ingest_totals", """SELECT count(*) AS seen, count(DISTINCT CASE WHEN NOT stored THEN k END) AS created, count(*) - count(DISTINCT CASE WHEN NOT stored THEN k END) AS duplicates FROM (
    SELECT *, bool_or(doc_id % 3 = 0) OVER (PARTITION BY k) AS stored FROM (SELECT doc_id, doc_id // 2 || sha256(text) AS k FROM documents))""")
def a11(t):
    batch = landing.address(_text_payloads(t))
    return landing.ingest_totals(batch, batch.filter("record_id % 3 = 0"), ["source_key"]).drop("source_key")


@query("s14_table_merge", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS state FROM documents WHERE doc_id % 2 = 0 OR doc_id % 4 = 0")
def s14_merge(t):
    ids = t.raw("documents").select("doc_id")
    old = ids.filter("doc_id % 2 = 0").withColumn("state", F.lit("old"))
    return landing.merge_rows(old, ids.filter("doc_id % 4 = 0").withColumn("state", F.lit("new")), ["doc_id"])


# --- scalar families as bulk columns ---------------------------------------------------------------


@query("f1_normal_form", f"SELECT doc_id, {sql_normal('text')} AS form FROM documents")
def f1(t):
    return t.raw("documents").select("doc_id", normal_form(F.col("text")).alias("form"))


@query("f2_identifiers", """SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN '10.1234/ab.' || doc_id END AS doi, CASE WHEN doc_id % 5 <> 4 THEN 'math/' || lpad(CAST(doc_id % 10000000 AS VARCHAR), 7, '0') END AS paper,
    CASE WHEN doc_id % 5 <> 4 THEN 'v' || (doc_id % 9 + 1) END AS paper_version, CASE WHEN doc_id % 6 < 4 THEN 'n_' || doc_id END AS review FROM documents""")
def f2(t):
    doc = F.col("doc_id")
    doi = F.when(doc % 4 == 3, F.concat(F.lit("10.12/"), doc)).otherwise(F.concat(pick(doc % 3, ["doi: ", "https://doi.org/", ""]), F.lit("10.1234/AB."), doc))
    paper = F.concat(pick(doc % 3, ["arXiv:", "https://arxiv.org/abs/", ""]), F.when(doc % 5 == 4, "bad").otherwise("math"), F.lit("/"),
                     F.when(doc % 5 == 4, "x").otherwise(F.lpad((doc % 10_000_000).cast("string"), 7, "0")), F.lit("V"), doc % 9 + 1, F.when(doc % 2 == 0, ".pdf").otherwise(""))
    review = F.concat(pick(doc % 6, ["https://openreview.net/forum?id=", "https://www.openreview.net/pdf?x=1&id=", "", "https://OpenReview.net/forum?id=", "https://example.org/forum?id=", "openreview:"]), F.lit("n_"), doc)
    rows = t.raw("documents").select("doc_id", *[normalized_identity(F.lit(k), v).alias(n) for k, n, v in (("doi", "d", doi), ("arxiv", "p", paper), ("openreview", "r", review))])
    return rows.select("doc_id", F.col("d.normalized_value").alias("doi"), F.col("p.normalized_value").alias("paper"), F.col("p.version_label").alias("paper_version"), F.col("r.normalized_value").alias("review"))


@query("f3_version_label", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'v' || doc_id WHEN 1 THEN 'v7' ELSE 'sha256:' || sha256(text) END AS label FROM documents")
def f3(t):
    doc = F.col("doc_id")
    explicit = F.when(doc % 3 == 0, F.concat(F.when(doc % 2 == 0, " V").otherwise(""), doc)).otherwise(" ")
    return t.raw("documents").select("doc_id", version_label(explicit, F.when(doc % 3 == 1, "v7"), F.sha2("text", 256)).alias("label"))


@query("f4_repository_urls", r"""SELECT page_id, 'https://github.com/' || host || '/' || regexp_replace(name, '\.git$', '') AS canonical, rtrim(regexp_replace(lower(url), '\.git$', ''), '/') AS match_form FROM (
    SELECT page_id, url, split_part(split_part(split_part(rest, '#', 1), '?', 1), '/', 1) AS host, nullif(split_part(split_part(split_part(rest, '#', 1), '?', 1), '/', 2), '') AS name
    FROM (SELECT page_id, url, regexp_replace(url, '^[a-z]+://', '') AS rest FROM pages))""")
def f4(t):
    """Every page as a repository: the host is the owner, the first part of the path the name."""
    hosted = F.concat(F.lit("https://GitHub.com/"), F.regexp_replace("url", "^[a-z]+://", ""))
    return t.raw("pages").select("page_id", canonical_repository(hosted).alias("canonical"), repository_match_form(F.col("url")).alias("match_form"))


@query("f5_mentions", f"""SELECT doc_id, {sql_preprint('doc_id')} || '|math/0000001' AS papers, 'https://github.com/Own/r' || doc_id || '|https://github.com/x/y' AS repositories,
    'https://v.example/' || doc_id || '.vtt' AS transcripts FROM documents""")
def f5(t):
    doc = F.col("doc_id")
    number = preprint(doc)
    text = F.concat("text", F.lit(" ArXiv:"), number, F.lit("v3 https://arxiv.org/pdf/"), number, F.lit(" arxiv:MATH/0000001 https://github.com/Own/r"), doc,
                    F.lit(".git https://github.com/x/y https://v.example/"), doc, F.lit(".vtt end"))
    return t.raw("documents").select("doc_id", listed(paper_mentions(text)).alias("papers"), listed(repository_mentions(text)).alias("repositories"), listed(transcript_mentions(text)).alias("transcripts"))


@query("f6_timestamps", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE strftime(o_orderdate + to_seconds(CASE WHEN o_orderkey % 6 = 2 THEN -7200 ELSE 0 END), '%Y-%m-%d %H:%M:%S') END AS moment FROM orders")
def f6(t):
    key, moment = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")

    def text(pattern: str) -> Column:
        return F.date_format(moment, pattern)

    value = (
        F.when(key % 6 == 0, text("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(key % 6 == 1, text("yyyy-MM-dd HH:mm:ss.SSS")).when(key % 6 == 2, text("yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .when(key % 6 == 3, text("EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(key % 6 == 5, F.lit("not a date")))
    number = F.when(key % 6 == 4, F.unix_millis(moment).cast("double"))
    return t.raw("orders").select("o_orderkey", shown(any_timestamp(value, number)).alias("moment"))


@query("f7_strict_timestamps", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS moment FROM orders")
def f7(t):
    text = F.concat(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("o_orderkey") % 2 == 0, "Z").otherwise(""))
    return t.raw("orders").select("o_orderkey", shown(iso_timestamp(text, strict=True)).alias("moment"))


@query("f8_clean_text", f"SELECT doc_id, nullif({sql_collapse('text')}, '') AS text FROM documents")
def f8(t):
    return t.raw("documents").select("doc_id", clean(F.col("text")).alias("text"))


@query("f9_json_values", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def f9(t):
    from scholarloom.sources.records import json_integer

    return t.raw("events").select("event_id", json_integer(F.try_parse_json("props"), "$.k").alias("k"))


@query("f10_freshness", f"""SELECT event_id, round(exp(-ln(2) * (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000 / 30.0), 6) AS half_life, round(greatest(0.0, 1 - (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000 / 30), 6) AS linear FROM events""")
def f10(t):
    ts = F.col("ts").cast("timestamp")
    return t.raw("events").select("event_id", F.round(half_life_freshness(as_of(), ts), 6).alias("half_life"), F.round(linear_freshness(as_of(), ts), 6).alias("linear"))


@query("f12_weighted_sum", "SELECT l_orderkey, l_linenumber, l_partkey, round(least(100.0, greatest(0.0, l_quantity * 0.5 + l_discount * 100 - l_tax * 50)), 4) AS score FROM lineitem")
def f12(t):
    total = F.col("l_quantity") * 0.5 + F.col("l_discount") * 100 - F.col("l_tax") * 50
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(clamp(total), 4).alias("score"))


@query("f13_first_sentence", rf"""SELECT doc_id, coalesce(CASE WHEN length(s) > 240 THEN rtrim(substr(s, 1, 237)) || '…' ELSE s END, 'none') AS sentence FROM (
    SELECT doc_id, regexp_replace(nullif({sql_collapse('text')}, ''), '^(.*?[.!?])\s.*$', '\1') AS s FROM documents)""")
def f13(t):
    return t.raw("documents").select("doc_id", first_sentence(F.col("text"), "none").alias("sentence"))


@query("f14_label_forms", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'strong' WHEN 1 THEN 'moderate' WHEN 2 THEN 'weak' WHEN 3 THEN 'Weakly' ELSE 'unknown' END AS label FROM orders")
def f14(t):
    raw = pick(F.col("o_orderkey") % 5, [" Strong", "MODERATE: some", "weak - thin", "Weakly", "unknown yet"])
    return t.raw("orders").select("o_orderkey", label_form(raw, settings.LABELS["evidence_state"]).alias("label"))


@query("f15_stable_keys", "SELECT doc_id, sha256(source || chr(0) || 'doc-' || doc_id) AS key FROM documents")
def f15(t):
    return t.raw("documents").select("doc_id", stable_key(F.col("source"), F.concat(F.lit("doc-"), "doc_id")).alias("key"))


@query("f16_headings", r"""SELECT doc_id, line, regexp_matches(t, '^(?:\d+(?:\.\d+)*\s+)?[A-Z][A-Za-z0-9 ,:()/-]{2,80}$') AND len(string_split(t, ' ')) <= 12 AS heading FROM (
    SELECT doc_id, generate_subscripts(l, 1) - 1 AS line, rtrim(unnest(l), '.') AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""")
def f16(t):
    lines = t.raw("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    return lines.select("doc_id", "line", is_heading(F.rtrim("raw", F.lit("."))).alias("heading"))


@query("f18_tier_quality", "SELECT record_id, round((CASE trust_tier WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.75 WHEN 'C' THEN 0.5 ELSE 0.25 END) * CASE WHEN record_id % 2 = 0 THEN 0.9 ELSE 1.0 END, 6) AS quality FROM records JOIN sources USING (source_key)")
def f18(t):
    status = F.when(F.col("record_id") % 2 == 0, "preprint").otherwise("accepted")
    return t["records"].join(t["sources"], "source_key").select("record_id", F.round(tier_quality(F.col("trust_tier"), status), 6).alias("quality"))


@query("f19_comparison_form", f"SELECT span_id, trim(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')), ' .,:;-') AS form FROM spans")
def f19(t):
    return t["spans"].select("span_id", comparison_form(F.col("text")).alias("form"))


@query("f20_public_urls", "SELECT work_id, id_type, value, CASE id_type WHEN 'arxiv' THEN 'https://arxiv.org/abs/' || value WHEN 'doi' THEN 'https://doi.org/' || value END AS url FROM external_ids")
def f20(t):
    return t["external_ids"].select("work_id", "id_type", "value", public_url(F.col("id_type"), F.col("value")).alias("url"))


@query("f21_sorted_json", """SELECT event_type, '{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}' AS json FROM (SELECT event_type, 'd' || (event_id % 7) AS k, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def f21(t):
    counts = t.raw("events").groupBy("event_type", F.concat(F.lit("d"), F.col("event_id") % 7).alias("k")).agg(F.count("*").alias("n"))
    return counts.groupBy("event_type").agg(sorted_json(F.map_from_entries(F.collect_list(F.struct("k", "n")))).alias("json"))


@query("u3_ordered_distinct", "SELECT conv_id, string_agg(role, '|' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY 1")
def u3(t):
    first = t.raw("conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    return first.groupBy("conv_id").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("first", "role"))), lambda r: r["role"])), "|").alias("roles"))


# --- documents to evidence -------------------------------------------------------------------------

_HTML = r"""regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>|<nav\b.*?</nav>|<!--.*?-->', ' ', 'g')"""
_BLOCK_TAG = r"(?i)</?(?:h[1-6]|p|br|li|ul|ol|td|th|tr|table|pre|blockquote|figcaption|article|section|div|body|html)\b[^>]*>"
_CLEAN_BLOCK = "regexp_replace(raw, '<[^>]+>', ' ', 'g')"
for _entity, _mark in evidence.ENTITIES:
    _CLEAN_BLOCK = "replace({}, '{}', '{}')".format(_CLEAN_BLOCK, _entity, _mark.replace("'", "''"))
_HTML_TEXTS = f"""(SELECT host, page, block, text FROM (SELECT host, page, block, {sql_collapse(_CLEAN_BLOCK)} AS text FROM (
    SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, page_id AS page, unnest(string_split_regex({_HTML}, '{_BLOCK_TAG}')) AS raw,
    generate_subscripts(string_split_regex({_HTML}, '{_BLOCK_TAG}'), 1) - 1 AS block FROM pages)) WHERE text <> '')"""
_SEGMENTS = rf"""(SELECT *, last_value(CASE WHEN regexp_matches(text, '^(?:\d+(?:\.\d+)*\s+)?[A-Z][A-Za-z0-9 ,:()/-]{{2,80}}$') AND len(string_split(text, ' ')) <= 12 THEN text END IGNORE NULLS)
    OVER (PARTITION BY host ORDER BY page, block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_path,
    coalesce(sum(length(text) + 1) OVER (PARTITION BY host, page ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start FROM {_HTML_TEXTS})"""


def _html_pages(t) -> DataFrame:
    """Web pages as pages of one document per host."""
    html = F.col("html")
    return t.raw("pages").select(
        F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("document_id"), F.col("page_id").cast("int").alias("page"),
        evidence.html_blocks(html).alias("blocks"), F.regexp_count(html, F.lit(r"<img\b")).alias("image_count"))


@query("d1_segment_html", f"SELECT host, page, block, char_start, char_start + length(text) AS char_end, text, section_path FROM {_SEGMENTS}")
def d1(t):
    rows = evidence.segment(_html_pages(t))
    return rows.select(F.col("document_id").alias("host"), "page", "block", "char_start", "char_end", "text", "section_path")


@query("w7_sections_and_offsets", rf"""SELECT document_id, page, block, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY document_id, page ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start,
    last_value(CASE WHEN regexp_matches(text, '^(?:\d+(?:\.\d+)*\s+)?[A-Z][A-Za-z0-9 ,:()/-]{{2,80}}$') AND len(string_split(text, ' ')) <= 12 THEN text END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page, block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_path
    FROM (SELECT document_id, page, block, {sql_collapse('raw')} AS text FROM lines) WHERE text <> ''""")
def w7(t):
    return evidence.segment(t["text_pages"]).select("document_id", "page", "block", "text", "char_start", "section_path")


_TRIAGE = f"""(SELECT p.host, p.page, images, coalesce(n, 0) AS n FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, page_id AS page,
    (length(html) - length(regexp_replace(html, '<img\\b', '', 'g'))) // 4 AS images FROM pages) p
    LEFT JOIN (SELECT host, page, sum(length(text) + 1) AS n FROM {_HTML_TEXTS} GROUP BY 1, 2) x ON x.host = p.host AND x.page = p.page)"""


@query("d2_page_triage", f"""SELECT host, page, greatest(0, n - 1) AS native_character_count, images AS image_count,
    CASE WHEN n = 0 THEN CASE WHEN images > 0 THEN 'ocr_required' ELSE 'empty' END WHEN n < 2000 THEN 'suspicious' ELSE 'native_text' END AS extraction_class FROM {_TRIAGE}""")
def d2(t):
    """The threshold is raised, so that both classes occur in this corpus."""
    rows = evidence.page_triage(_html_pages(t), suspicious=2000)
    return rows.select(F.col("document_id").alias("host"), "page", "native_character_count", "image_count", "extraction_class")


@query("d3_document_outcome", f"SELECT host, count(*) AS page_count, count(CASE WHEN n <= 1 THEN 1 END) AS empty_pages, CASE WHEN count(*) > 5 OR count(CASE WHEN n <= 1 THEN 1 END) > 0 THEN 'partial' ELSE 'parsed' END AS parse_status FROM {_TRIAGE} GROUP BY 1")
def d3(t):
    pages = _html_pages(t)
    counts = pages.groupBy("document_id").agg(F.count("*").alias("page_count"))
    rows = evidence.document_outcome(evidence.page_triage(pages), counts, max_pages=5)
    return rows.withColumnRenamed("document_id", "host")


@query("d4_new_spans", """SELECT text_sha256, page, char_start FROM spans WHERE document_id % 3 <> 0 EXCEPT SELECT text_sha256, page, char_start FROM spans WHERE document_id % 3 = 0""")
def d4(t):
    """All spans seen as one document, so that copies of a passage meet."""
    one = t["spans"].withColumn("seen", F.col("document_id") % 3 == 0).withColumn("document_id", F.lit("all"))
    return evidence.new_spans(one.filter("NOT seen"), one.filter("seen")).select("text_sha256", "page", "char_start")


@query("d5_route_documents", """SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 'INVALID_MEDIA_TYPE' WHEN strlen(body) > 6000 THEN 'DOCUMENT_TOO_LARGE' WHEN page_id % 4 = 2 THEN 'INVALID_PDF_SIGNATURE' END AS error_code, sha256(body) AS sha256 FROM (
    SELECT page_id, CASE WHEN page_id % 4 = 2 THEN html ELSE '%PDF-' || html END AS body FROM pages)""")
def d5(t):
    page = F.col("page_id")
    files = t.raw("pages").select(
        "page_id", F.when(page % 4 == 3, "text/html").otherwise("Application/PDF; v=1").alias("media_type"),
        F.concat(F.when(page % 4 == 2, "").otherwise("%PDF-"), "html").cast("binary").alias("content"))
    return evidence_route(files)


def evidence_route(files: DataFrame) -> DataFrame:
    return landing.route_documents(files, max_bytes=6_000).select("page_id", "error_code", "sha256")


@query("d5_stored_documents", "SELECT sha256(html) AS sha256, min(page_id) AS page_id FROM pages GROUP BY 1")
def d5_stored(t):
    files = t.raw("pages").select(
        "page_id", F.lit("one").alias("version_id"), F.lit("application/pdf").alias("media_type"), F.col("html").cast("binary").alias("content"),
        F.col("page_id").alias("acquired_at"), F.col("url").alias("source_url"))
    routed = landing.route_documents(files, signature=b"<!DOC")
    return landing.stored_documents(routed).select("sha256", "page_id")


_PACKING = """SELECT version_id, span_id, place, slot FROM (SELECT *, row_number() OVER w AS slot, sum(least(length(text), 1800)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chars FROM (
    SELECT *, count(*) OVER (PARTITION BY version_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY page, char_start, span_id) AS place FROM SPANS))
    WHERE (place - 1) % greatest(1, n // 28) = 0 WINDOW w AS (PARTITION BY version_id ORDER BY place)) WHERE chars <= 20000 AND slot <= 28"""


@query("w6_evidence_packing", _PACKING.replace("SPANS", "spans"))
def w6(t):
    return evidence.pack_evidence(t["spans"]).select("version_id", "span_id", "place", "slot")


@query("w6_readable_evidence", _PACKING.replace("SPANS", "spans WHERE document_id IN (SELECT document_id FROM pdfs WHERE parse_status IN ('parsed', 'partial'))"))
def w6_readable(t):
    return evidence.pack_evidence(t["spans"], t["documents"]).select("version_id", "span_id", "place", "slot")


@query("a14_evidence_fingerprint", """SELECT version_id, sha256(version_id || '|' || string_agg(h, '|' ORDER BY c)) AS evidence_fingerprint FROM (
    SELECT version_id, substr(span_id, 1, 2) AS c, sha256(string_agg(text_sha256, '|' ORDER BY span_id)) AS h FROM spans GROUP BY 1, 2) GROUP BY 1""")
def a14(t):
    return evidence.evidence_fingerprint(t["spans"])


@query("a14_chunked_fingerprint", """SELECT version_id, sha256(version_id || '|' || string_agg(h, '|' ORDER BY c)) AS evidence_fingerprint FROM (
    SELECT version_id, substr(span_id, 1, 1) AS c, sha256(string_agg(text_sha256, '|' ORDER BY span_id)) AS h FROM spans GROUP BY 1, 2) GROUP BY 1""")
def a14_chunked(t):
    return evidence.evidence_fingerprint(t["spans"], digits=1)


@query("w5_revision_order", "SELECT doc_id, row_number() OVER (ORDER BY doc_id // 4, doc_id % 3, doc_id) - 1 AS pos FROM documents")
def w5(t):
    doc = F.col("doc_id")
    rows = t.raw("documents").select("doc_id", F.floor(doc / 4).alias("upstream_id"), (doc % 3).alias("version_no"))
    return global_position(rows, ["upstream_id", "version_no", "doc_id"]).select("doc_id", "pos")


@query("w9_retention_plan", f"""SELECT doc_id AS path, 'age' AS rule FROM documents WHERE (doc_id % 10 = 0 AND doc_id % 31 < 20) OR (doc_id % 10 = 1 AND doc_id % 31 < 10) OR (doc_id % 10 > 1 AND doc_id % 31 < 2)
    UNION ALL SELECT doc_id, 'budget' FROM (SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY doc_id % 31, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM documents WHERE doc_id % 10 > 1 AND doc_id % 31 >= 2)
    WHERE prior < (SELECT sum(n_chars) - 500000 FROM documents WHERE NOT ((doc_id % 10 = 0 AND doc_id % 31 < 20) OR (doc_id % 10 = 1 AND doc_id % 31 < 10) OR (doc_id % 10 > 1 AND doc_id % 31 < 2)))""")
def w9(t):
    doc = F.col("doc_id")
    area = F.when(doc % 10 == 0, "temporary").when(doc % 10 == 1, "quarantine").otherwise("raw")
    files = t.raw("documents").select(doc.alias("path"), area.alias("area"), F.col("n_chars").alias("size"), at(doc % 31).alias("modified_at"), at(doc % 31).alias("observed_at"), doc.alias("record_id"))
    return retention_plan(files, {"temporary": at(20), "quarantine": at(10), "raw": at(2)}, 500_000).select("path", "rule")


# --- structured outputs ------------------------------------------------------------------------------


def _brief_outputs(t) -> DataFrame:
    """A stored brief per document; some break a rule."""
    doc, title = F.col("doc_id"), first_line(F.col("text"))
    cited = F.when(doc % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("e"), doc % 100)))
    body = F.to_json(F.struct(
        F.lit("1.0").alias("schema_version"), work_key(F.col("text")).alias("work_id"), title.alias("change"),
        F.concat(F.lit("Problem of "), title).alias("problem"), F.concat(F.lit("Contribution: "), F.coalesce(_rest(F.col("text")), F.lit("none"))).alias("contribution"),
        pick(doc % 5, ["Strong: yes", "weak", "moderate - some", "unsure", "unknown"]).alias("evidence_state"), F.lit("official").alias("code_state"), F.lit("Track").alias("recommended_action"),
        F.when(doc % 29 == 0, F.array().cast("array<string>")).when(doc % 14 == 0, F.array(F.col("lang"), F.upper("lang"))).otherwise(F.array("lang", "source")).alias("limitations"),
        F.concat(F.lit("Technical "), "source").alias("technical_relevance"), F.when(doc % 21 == 0, F.concat(F.lit("technical  "), "source", F.lit("."))).otherwise(F.concat(F.lit("Commercial "), "lang")).alias("commercial_relevance"),
        F.array(F.struct(F.concat(F.lit("Claim "), doc).alias("text"), F.lit("Fact").alias("type"), cited.alias("evidence_ids"))).alias("claims"),
        F.when(doc % 33 == 0, F.lit("x")).alias("note")))
    return t.raw("documents").select(doc.alias("run_id"), work_key(F.col("text")).alias("work_id"), title.alias("title"), F.lit("succeeded").alias("status"), body.alias("output_json"))


_B = """(SELECT doc_id, split_part(text, chr(10), 1) AS title, length(split_part(text, chr(10), 1)) AS tl,
    length('Contribution: ' || coalesce(nullif(substr(text, length(split_part(text, chr(10), 1)) + 2), ''), 'none')) AS cl, text, lang, source FROM documents)"""
_BAD = "CASE WHEN doc_id % 33 = 0 THEN 'unknown field|' ELSE '' END || CASE WHEN tl NOT BETWEEN 1 AND 320 THEN 'change|' ELSE '' END || CASE WHEN tl + 11 > 800 THEN 'problem|' ELSE '' END || CASE WHEN cl > 800 THEN 'contribution|' ELSE '' END || CASE WHEN doc_id % 5 = 3 THEN 'evidence_state|' ELSE '' END || CASE WHEN doc_id % 29 = 0 THEN 'limitations|' ELSE '' END"


@query("g1_brief_schema", f"SELECT doc_id AS run_id, {_BAD} AS reasons FROM {_B}")
def g1(t):
    return gates.read_briefs(_brief_outputs(t)).select("run_id", F.concat_ws("", F.transform("reasons", lambda r: F.concat(r, F.lit("|")))).alias("reasons"))


@query("g1_nested_schema", f"""SELECT doc_id AS run_id, {_BAD} || CASE doc_id % 4 WHEN 1 THEN 'nested unknown field|' WHEN 2 THEN 'field kind|' WHEN 3 THEN 'claim evidence|' ELSE '' END AS reasons FROM {_B}""")
def g1_nested(t):
    """The same briefs with a field too many inside a claim, a number for a text, or NULL for an evidence id."""
    rows, run, body = _brief_outputs(t), F.col("run_id"), F.col("output_json")
    spoilt = (F.when(run % 4 == 1, F.replace(body, F.lit('"type":"Fact"'), F.lit('"type":"Fact","weight":1')))
              .when(run % 4 == 2, F.regexp_replace(body, '"work_id":"[^"]*"', '"work_id":5'))
              .when(run % 4 == 3, F.regexp_replace(body, r'"evidence_ids":\[[^\]]*\]', '"evidence_ids":[null]')).otherwise(body))
    return gates.read_briefs(rows.withColumn("output_json", spoilt)).select("run_id", F.concat_ws("", F.transform("reasons", lambda r: F.concat(r, F.lit("|")))).alias("reasons"))


@query("g1_outdated_outputs", f"SELECT CASE WHEN {_BAD} <> '' THEN 'rejected' ELSE 'succeeded' END AS shown_status, count(*) AS n FROM {_B} GROUP BY 1")
def g1_outdated(t):
    return gates.outdated_outputs(gates.read_briefs(_brief_outputs(t))).groupBy("shown_status").agg(F.count("*").alias("n"))


@query("g2_brief_quality", f"""SELECT doc_id AS run_id, CASE WHEN doc_id % 21 = 0 THEN 'NARRATIVE_NOT_DISTINCT' WHEN trim(trim(regexp_replace(title, '\\s+', ' ', 'g')), ' .,:;-') = '' THEN 'NARRATIVE_NOT_DISTINCT'
    ELSE 'NARRATIVE_IS_TITLE' END AS quality_error FROM {_B}""")
def g2(t):
    """The change text of these briefs is the title, so every brief fails one of the first two rules."""
    return gates.brief_quality(gates.read_briefs(_brief_outputs(t))).select("run_id", "quality_error")


@query("g2_limitations", """SELECT doc_id AS run_id, CASE WHEN doc_id % 21 = 0 THEN 'NARRATIVE_NOT_DISTINCT' WHEN doc_id % 14 = 0 AND doc_id % 29 <> 0 THEN 'LIMITATIONS_NOT_DISTINCT' END AS quality_error FROM documents WHERE length(regexp_replace(split_part(text, chr(10), 1), '[ .,:;-]', '', 'g')) > 0""")
def g2_limits(t):
    rows = gates.read_briefs(_brief_outputs(t)).filter(F.length(F.regexp_replace("title", "[ .,:;-]", "")) > 0)
    return gates.brief_quality(rows.withColumn("title", F.lit("another title"))).select("run_id", "quality_error")


@query("r6_model_signals", f"""SELECT doc_id AS run_id, NOT ok AS fallback, round(CASE WHEN ok THEN least(1.0, 0.4 + cl / 1600) ELSE 0.5 END, 6) AS novelty, CASE WHEN ok AND doc_id % 9 <> 0 THEN 1.0 ELSE 0.0 END AS confidence,
    round(CASE WHEN ok AND doc_id % 9 <> 0 THEN least(2.5, greatest(-2.5, ((least(1.0, 0.4 + cl / 1600) + least(1.0, 0.35 + length('Technical ' || source) / 1600) + least(1.0, 0.35 + tl / 640)
      + least(1.0, 0.35 + length(CASE WHEN doc_id % 21 = 0 THEN 'technical  ' || source || '.' ELSE 'Commercial ' || lang END) / 1600)) / 4 - 0.5) * 5)) ELSE 0.0 END, 6) AS refinement FROM (SELECT *, {_BAD} = '' AS ok FROM {_B})""")
def r6(t):
    rows = gates.read_briefs(_brief_outputs(t))
    signals = ranking.model_signals(rows, F.size("reasons") == 0)
    return signals.select("run_id", "fallback", F.round("novelty", 6).alias("novelty"), "confidence", F.round("refinement", 6).alias("refinement"))


def _deep_outputs(t) -> DataFrame:
    """A stored deep report per document."""
    doc, title = F.col("doc_id"), F.col("source")
    def section(name: str) -> Column:
        text = F.when(doc % 31 == 0, F.concat(F.lit("Same text "), title)).otherwise(F.concat(F.lit(f"{name} of "), title))
        refs = F.when(doc % 37 == 0, F.array(F.lit("c9"))).otherwise(F.array(F.lit("c1")))
        return F.struct(text.alias("markdown"), ((doc % 10) / 10).alias("confidence"), refs.alias("claim_ids"))

    none = F.array().cast("array<string>")
    span = F.concat(F.lit("e"), doc)
    report = F.struct(
        F.lit("1.0").alias("schema_version"), work_key(F.col("text")).alias("work_id"), title.alias("title"), F.lit("Preprint: v1").alias("publication_status"),
        *[section(s).alias(s) for s in gates.SECTIONS],
        F.struct(F.lit("partial").alias("status"), F.array(F.lit("https://x.example")).alias("repository_urls"), none.alias("assets"),
                 F.when(doc % 41 == 0, F.lit("maybe")).otherwise(F.lit("fits")).alias("hardware_fit"), none.alias("steps"), none.alias("risks")).alias("reproducibility"),
        F.array(F.struct(F.concat(F.lit("App "), "lang").alias("name"), F.lit("s").alias("system_change"), F.concat(F.lit("value "), doc).alias("expected_value"), none.alias("risks"),
                         F.array(F.lit("c2"), F.lit("c1")).alias("claim_ids"))).alias("production_applications"),
        F.array(F.struct(F.concat(F.lit("Problem "), doc % 50).alias("problem"), F.lit("buyer").alias("buyer"), F.lit("w").alias("workflow"), F.lit("pilot").alias("pilot"), F.lit("v").alias("value_metric"),
                         F.lit(0.5).alias("confidence"), F.when(doc % 4 == 0, none).otherwise(F.array(span)).alias("evidence_ids"), none.alias("unknowns"))).alias("commercial_hypotheses"),
        F.array(F.struct(F.concat(F.lit("Concept "), doc % 7).alias("concept"), F.lit("r").alias("reason"), F.lit(1).alias("sequence")),
                F.struct(F.col("lang").alias("concept"), F.lit("r").alias("reason"), F.lit(2).alias("sequence"))).alias("learning_path"),
        F.array(F.struct(F.when(doc % 6 == 0, "Critical: x").otherwise("info").alias("severity"), F.lit("f").alias("finding"), none.alias("affected_claim_ids"),
                         F.when(doc % 12 == 0, "unresolved").otherwise("accepted").alias("resolution"))).alias("skeptic_findings"),
        F.array(F.struct(F.lit("c1").alias("id"), F.lit("t").alias("text"), F.lit("fact").alias("type"), F.lit("major").alias("importance"),
                         F.when(doc % 8 == 0, "conflicted").otherwise("supported").alias("verification_status"), F.when(doc % 9 == 0, none).otherwise(F.array(span)).alias("evidence_ids")),
                F.struct(F.lit("c2").alias("id"), F.lit("t2").alias("text"), F.lit("hypothesis").alias("type"), F.lit("minor").alias("importance"), F.lit("supported").alias("verification_status"),
                         F.array(F.concat(F.lit("h"), doc)).alias("evidence_ids"))).alias("claims"))
    return t.raw("documents").select(doc.alias("run_id"), work_key(F.col("text")).alias("work_id"), title.alias("title"), at(doc % 40).alias("completed_at"), F.to_json(report).alias("output_json"))


def _reports(t) -> DataFrame:
    return gates.read_deep_reports(_deep_outputs(t))


@query("g1_deep_schema", "SELECT doc_id AS run_id, CASE WHEN doc_id % 41 = 0 THEN 'reproducibility' ELSE '' END AS reasons FROM documents")
def g1_deep(t):
    return _reports(t).select("run_id", listed("reasons").alias("reasons"))


@query("g2_deep_quality", "SELECT doc_id AS run_id, CASE WHEN doc_id % 31 = 0 THEN 'SECTIONS_NOT_DISTINCT' END AS quality_error FROM documents")
def g2_deep(t):
    return gates.deep_quality(_reports(t)).select("run_id", "quality_error")


@query("g3_deep_citations", """SELECT doc_id AS run_id, CASE WHEN doc_id % 43 = 0 THEN 'METADATA_MISMATCH' WHEN doc_id % 37 = 0 THEN 'DANGLING_CLAIM_REFERENCE' WHEN doc_id % 9 = 0 THEN 'UNCITED_CLAIM' WHEN doc_id % 10 = 7 THEN 'FOREIGN_EVIDENCE' END AS reason,
    CASE WHEN doc_id % 9 = 0 THEN 0.0 ELSE 1.0 END AS citation_coverage, 2 - CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS citations_verified FROM documents""")
def g3_deep(t):
    rows = durable(_reports(t))  # five branches read it
    doc = F.col("run_id")
    runs = rows.select("run_id", (F.col("report.work_id") == F.col("work_id")).alias("identity_matches"),
                       ((F.col("report.title") == F.col("title")) & (doc % 43 != 0)).alias("metadata_matches"))
    allowed = rows.select("run_id", F.explode(F.array(F.when(doc % 10 != 7, F.concat(F.lit("e"), doc)), F.concat(F.lit("h"), doc))).alias("span_id"))
    claims = gates.claim_rows(rows, "report")
    return gates.verify_citations(runs, claims, allowed, deep=True, section_refs=gates.report_section_refs(rows)).select("run_id", "reason", "citation_coverage", "citations_verified")


@query("g3_brief_citations", """SELECT r.run_id, CASE WHEN f.failure IS NOT NULL THEN f.failure.r WHEN coalesce(req, 0) > 0 AND sup / req < 0.9 THEN 'COVERAGE_BELOW_THRESHOLD' END AS reason,
    round(CASE WHEN coalesce(req, 0) = 0 THEN 1.0 ELSE sup / req END, 6) AS citation_coverage, coalesce(v, 0) AS citations_verified FROM runs r LEFT JOIN (
    SELECT run_id, min(CASE WHEN foreign_n > 0 THEN {'n': claim_no, 'c': 1, 'r': 'FOREIGN_EVIDENCE'} WHEN factual AND n = 0 THEN {'n': claim_no, 'c': 2, 'r': 'UNCITED_CLAIM'} END) AS failure,
        count(CASE WHEN factual THEN 1 END) AS req, count(CASE WHEN factual AND n > 0 THEN 1 END) AS sup, sum(n) AS v FROM (
        SELECT c.run_id, c.claim_no, c.claim_type IN ('fact', 'interpretation') AS factual, count(x.span_id) AS n, count(CASE WHEN x.span_id IS NOT NULL AND a.span_id IS NULL THEN 1 END) AS foreign_n
        FROM claims c LEFT JOIN cites x USING (run_id, claim_no) LEFT JOIN allowed a ON a.run_id = x.run_id AND a.span_id = x.span_id GROUP BY 1, 2, 3) GROUP BY 1) f USING (run_id)""")
def g3(t):
    runs = t["runs"].select("run_id", F.lit(True).alias("identity_matches"), F.lit(True).alias("metadata_matches"))
    rows = gates.verify_citations(runs, t["claims"], t["allowed"])
    return rows.select("run_id", "reason", F.round("citation_coverage", 6).alias("citation_coverage"), "citations_verified")


@query("a8_citation_coverage", """SELECT run_id, round(count(CASE WHEN len(evidence_ids) > 0 THEN 1 END) / count(*), 6) AS citation_coverage FROM claims WHERE claim_type IN ('fact', 'interpretation') GROUP BY 1""")
def a8(t):
    runs = t["claims"].filter(F.col("claim_type").isin(settings.FACTUAL_TYPES)).select("run_id").distinct().select(
        "run_id", F.lit(True).alias("identity_matches"), F.lit(True).alias("metadata_matches"))
    return gates.verify_citations(runs, t["claims"], t["allowed"]).select("run_id", F.round("citation_coverage", 6).alias("citation_coverage"))


@query("j11_citations_contained", """SELECT run_id, bool_and(a.span_id IS NOT NULL) AS contained FROM cites x LEFT JOIN allowed a USING (run_id, span_id) GROUP BY 1""")
def j11(t):
    cited = t["claims"].select("run_id", F.explode("evidence_ids").alias("span_id"))
    known = t["allowed"].withColumn("known", F.lit(True))
    return cited.join(known, ["run_id", "span_id"], "left").groupBy("run_id").agg(F.bool_and(F.col("known").isNotNull()).alias("contained"))


@query("u4_set_overlap", "SELECT claim_id, count(a.span_id) AS shared, count(*) - count(a.span_id) AS foreign_ids FROM cites x LEFT JOIN allowed a USING (run_id, span_id) GROUP BY 1")
def u4(t):
    cited = t["claims"].select("run_id", "claim_id", F.explode("evidence_ids").alias("span_id")).distinct()
    known = t["allowed"].withColumn("known", F.lit(True))
    return cited.join(known, ["run_id", "span_id"], "left").groupBy("claim_id").agg(
        F.count("known").alias("shared"), F.count_if(F.col("known").isNull()).alias("foreign_ids"))


@query("s13_claim_evidence", "SELECT claim_id, span_id, 'supports' AS relation, 1.0 AS relevance FROM edges")
def s13(t):
    return gates.claim_evidence(t["claims"], t["allowed"])


@query("s13_claim_rows", """SELECT doc_id || '-claim-' || n AS claim_id, CASE n WHEN 1 THEN 'fact' ELSE 'hypothesis' END AS claim_type, CASE n WHEN 1 THEN 'major' ELSE 'minor' END AS importance FROM documents, (VALUES (1), (2)) k(n)""")
def s13_rows(t):
    return gates.claim_rows(_reports(t), "report").select("claim_id", "claim_type", "importance")


@query("s13_section_rows", f"SELECT doc_id AS run_id, 'brief' AS section_key, 1 AS section_order, 'verified' AS status, title AS content_markdown, 1.0 AS confidence FROM {_B}")
def s13_sections(t):
    return gates.section_rows(gates.read_briefs(_brief_outputs(t)), "brief")


@query("j4_unsupported_claims", "SELECT claim_id FROM claims WHERE claim_type IN ('fact', 'interpretation') AND claim_id NOT IN (SELECT claim_id FROM edges)")
def j4(t):
    return gates.unsupported_claims(t["claims"], gates.claim_evidence(t["claims"], t["allowed"])).select("claim_id")


@query("g4_publication_gate", """SELECT doc_id AS run_id, CASE WHEN doc_id % 12 = 0 THEN 'CRITICAL_SKEPTIC_FINDING' WHEN doc_id % 8 = 0 OR doc_id % 9 = 0 THEN 'UNSUPPORTED_CLAIMS' END AS error_code,
    CASE WHEN doc_id % 12 = 0 OR doc_id % 8 = 0 OR doc_id % 9 = 0 THEN 'rejected' ELSE 'published' END AS decision FROM documents""")
def g4(t):
    return gates.publication_gate(_reports(t)).select("run_id", "error_code", "decision")


@query("g5_cached_runs", """SELECT run_id, CASE WHEN input_fingerprint IN (SELECT input_fingerprint FROM runs s WHERE s.status = 'succeeded' AND s.analysis_type = r.analysis_type) THEN 'cached' ELSE 'to do' END AS state FROM runs r""")
def g5(t):
    cached, todo = gates.split_cached(t["runs"], t["runs"].filter("status = 'succeeded'"))
    return cached.select("run_id", F.lit("cached").alias("state")).unionByName(todo.select("run_id", F.lit("to do").alias("state")))


@query("g6_learning_focus", """SELECT concept FROM (SELECT concept, min((p, s)) AS f FROM (SELECT p, s, CASE s WHEN 0 THEN 'Concept ' || (doc_id % 7) ELSE lang END AS concept FROM (
    SELECT *, row_number() OVER (ORDER BY doc_id % 40 DESC, doc_id DESC) AS p FROM documents) d, (VALUES (0), (1)) k(s) WHERE p <= 2) GROUP BY 1) ORDER BY f LIMIT 10""")
def g6(t):
    return reports.learning_focus(_reports(t)).select("concept")


@query("g7_opportunities", """SELECT kind, work_id, headline, detail, ids FROM (
    SELECT 'engineering' AS kind, doc_id, 'App ' || lang AS headline, 'value ' || doc_id AS detail, 'h' || doc_id || CASE WHEN doc_id % 8 = 0 OR doc_id % 9 = 0 THEN '' ELSE '|e' || doc_id END AS ids FROM documents
    UNION ALL SELECT 'commercial', doc_id, 'Problem ' || (doc_id % 50), 'buyer: pilot', 'e' || doc_id FROM documents WHERE doc_id % 4 <> 0) JOIN docs USING (doc_id)""")
def g7(t):
    """Daily hypotheses repeat those of the reports, so none of them is added."""
    rows = _reports(t)
    daily = reports.commercial_opportunities(rows)
    return reports.opportunities(rows, daily).select("kind", "work_id", "headline", "detail", listed("evidence_ids").alias("ids"))


@query("g8_commercial_hypotheses", f"""SELECT p.work_id, 'hypothesis_problem|' || v.title AS headline, round(least(0.75, 0.35 + p.commercial_score / 250), 5) AS confidence, e.ids FROM
    (SELECT * FROM scores ORDER BY commercial_score DESC, work_id LIMIT 10) p JOIN works w USING (work_id) JOIN versions v ON v.version_id = w.current_version_id
    JOIN (SELECT work_id, string_agg(span_id, '|' ORDER BY page, span_id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY page, span_id) AS n FROM (
        SELECT v.work_id, s.page, s.span_id FROM spans s JOIN pdfs d USING (document_id) JOIN versions v ON v.version_id = d.version_id)) WHERE n <= 3 GROUP BY 1) e ON e.work_id = p.work_id
    ORDER BY p.commercial_score DESC, p.work_id LIMIT 3""")
def g8(t):
    none = t["works"].select("work_id", F.array().cast("array<string>").alias("evidence_ids"))
    return reports.commercial_hypotheses(t, none).select("work_id", "headline", F.round("confidence", 5).alias("confidence"), listed("evidence_ids").alias("ids"))


@query("g9_daily_report")
def g9(t):
    """One row with every part of the day's report; JSON text, whose parts g9_report_parts checks."""
    made = t["artifacts"].withColumn("created_at", F.lit(None).cast("timestamp"))
    parts = {
        "top_technical": ranking.ranked(t, "technical").select((-F.col("total_score")).alias("order"), "work_id", "title", "total_score", "reason", "status"),
        "top_commercial": ranking.ranked(t, "commercial").select((-F.col("total_score")).alias("order"), "work_id", "title", "total_score", "reason", "status"),
        "what_happened": reports.event_sentences(t).select((-F.unix_micros("occurred_at")).alias("order"), "event_id", "sentence"),
        "launches": reports.recent_launches(made).select((-F.unix_micros("moment")).alias("order"), "artifact_id", "title"),
        "community_signals": reports.community_signals(made).select((-F.unix_micros("moment")).alias("order"), "artifact_id", "title"),
        "important_updates": reports.revision_updates(t).select((-F.unix_micros("observed_at")).alias("order"), "work_id", "title"),
        "learning_focus": reports.learning_focus(_reports(t)).select("place", "at", "concept"),
        "coverage_gaps": reports.coverage_gaps(t),
    }
    return reports.daily_report("2024-02-01", parts)


_REPORT_IDS = {
    "top_technical": "work_id", "top_commercial": "work_id", "what_happened": "event_id", "launches": "artifact_id", "community_signals": "artifact_id",
    "important_updates": "work_id", "learning_focus": "concept", "coverage_gaps": "gap"}
_NEWEST = "coalesce(updated_at, published_at) DESC NULLS LAST, artifact_id"


def _sql_part(part: str, key: str, order: str, rows: str, limit: int) -> str:
    return f"SELECT '{part}' AS part, row_number() OVER (ORDER BY {order}) - 1 AS position, {key} AS id FROM (SELECT * FROM {rows} ORDER BY {order} LIMIT {limit})"


@query("g9_report_parts", " UNION ALL ".join([
    _sql_part("top_technical", "work_id", "total_score DESC, work_id", "results WHERE score_kind = 'technical'", 10),
    _sql_part("top_commercial", "work_id", "total_score DESC, work_id", "results WHERE score_kind = 'commercial'", 10),
    _sql_part("what_happened", "event_id", "occurred_at DESC NULLS LAST, event_id", "linked_events", 8),
    _sql_part("launches", "artifact_id", _NEWEST, "artifacts WHERE artifact_type IN ('repository', 'release', 'model', 'dataset', 'space')", 8),
    _sql_part("community_signals", "artifact_id", _NEWEST, "artifacts WHERE content_class = 'community_reaction' OR authority < 0.5", 8),
    _sql_part("important_updates", "work_id", "observed_at DESC, work_id", "versions WHERE is_current AND work_id IN (SELECT work_id FROM versions GROUP BY 1 HAVING count(*) > 1)", 10),
    _sql_part("learning_focus", "concept", "f", """(SELECT concept, min((p, s)) AS f FROM (SELECT p, s, CASE s WHEN 0 THEN 'Concept ' || (doc_id % 7) ELSE lang END AS concept FROM (
        SELECT *, row_number() OVER (ORDER BY doc_id % 40 DESC, doc_id DESC) AS p FROM documents) d, (VALUES (0), (1)) k(s) WHERE p <= 2) GROUP BY 1)""", 10),
    """SELECT 'coverage_gaps', 0, 'gap_documents|' || (SELECT count(*) FROM works WHERE work_type = 'paper' AND work_id NOT IN (SELECT work_id FROM with_docs))
        WHERE EXISTS (SELECT 1 FROM works WHERE work_type = 'paper' AND work_id NOT IN (SELECT work_id FROM with_docs))"""]))
def g9_parts(t):
    """The stored report taken apart again: part, position and id. The corpus has verified deep reports, so one gap is left."""
    kinds = ", ".join(f"{part} array<struct<{key}:string>>" for part, key in _REPORT_IDS.items())
    report = g9(t).select(F.from_json("report_json", kinds).alias("r"))

    def rows(part: str, key: str) -> Column:
        return F.transform(F.col("r")[part], lambda x, i: F.struct(F.lit(part).alias("part"), i.alias("position"), x[key].alias("id")))

    return report.select(F.inline(F.concat(*[rows(part, key) for part, key in _REPORT_IDS.items()])))


@query("g10_claim_audit", "SELECT (SELECT count(DISTINCT span_id) FROM edges) AS cited, (SELECT count(*) FROM claims WHERE claim_type IN ('fact', 'interpretation') AND claim_id NOT IN (SELECT claim_id FROM edges)) AS unsupported")
def g10(t):
    edges = gates.claim_evidence(t["claims"], t["allowed"])
    cited = gates.cited_evidence(edges).agg(F.count("*").alias("cited"))
    return cited.join(gates.unsupported_claims(t["claims"], edges).agg(F.count("*").alias("unsupported")))


# --- identity ------------------------------------------------------------------------------------------


def _identity_records(t) -> DataFrame:
    """Web pages as records: four pages make one upstream item, copies share an identity, and pages with the
    same language and year may have near titles."""
    page, html = F.col("page_id"), F.col("html")
    title = normal_form(evidence.unescape(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)), exact=False)
    ids = F.array(F.concat(F.lit("doi:"), F.substring(F.sha2(F.coalesce(title, F.lit("")), 256), 1, 2)),
                  F.when(page % 2 == 0, F.concat(F.lit("arxiv:"), F.floor(page / 4))), F.when(page % 3 == 0, F.concat(F.lit("openreview:"), page)))
    wanted = F.when(page % 5 == 0, F.slice(ids, 1, 2)).otherwise(F.slice(ids, 2, 2))
    return t.raw("pages").select(
        page.cast("string").alias("record_id"), F.lpad(F.floor(page / 4).cast("string"), 12, "0").alias("upstream_id"), (page % 4).alias("version_no"), at(page % 31).alias("observed_at"),
        F.coalesce(title, F.lit("untitled")).alias("title"), F.concat(F.lit("author "), F.regexp_extract(html, '<html lang="([a-z]+)"', 1)).alias("author"),
        (2023 + F.floor(page / 4) % 2).cast("int").alias("year"), F.concat(F.lit("v"), page % 3).alias("label"),
        F.concat(F.filter(wanted, lambda i: i.isNotNull()), F.array(F.concat(F.lit("url:"), page))).alias("identities"))


def _resolved(t, records):
    """The resolution of all records of one kind, worked out once for the corpus."""
    if records not in t.resolutions:
        t.resolutions[records] = resolve_identities(records(t))
    return t.resolutions[records]


@query("e1_identity_resolution")
def e1(t):
    return _resolved(t, _identity_records).decisions


@query("e2_resolved_versions")
def e2(t):
    return _resolved(t, _identity_records).versions


@query("e4_review_queue")
def e4(t):
    return _resolved(t, _identity_records).review


@query("e3_resolution_invariants", "SELECT 'current_versions' AS rule, 0 AS violations UNION ALL SELECT 'external_ids', 0")
def e3_invariants(t):
    """Every resolved work has one current version, and no external id names two works."""
    found = _resolved(t, _identity_records)
    ids = found.external_ids.select(F.lit("any").alias("id_type"), F.col("identity").alias("value"), "work_id")
    return invariants.violations({"versions": found.versions, "external_ids": ids}).groupBy("rule").agg(F.count("key").alias("violations"))


@query("c1_invariants", """SELECT 'current_versions' AS rule, count(*) AS violations FROM (SELECT work_id FROM versions GROUP BY 1 HAVING count(CASE WHEN is_current THEN 1 END) <> 1)
    UNION ALL SELECT 'external_ids', count(*) FROM (SELECT id_type, value FROM external_ids GROUP BY 1, 2 HAVING count(DISTINCT work_id) > 1)
    UNION ALL SELECT 'results', count(*) FROM (SELECT work_id, score_kind FROM results GROUP BY 1, 2 HAVING count(*) > 1)""")
def c1(t):
    return invariants.violations(t).groupBy("rule").agg(F.count("key").alias("violations"))


@query("j7_similar_titles")
def j7(t):
    titles = _identity_records(t).select("author", "year", "title").distinct()
    return similar_titles(titles, ["author", "year"], settings.FUZZY_TITLE_THRESHOLD).filter("title <> other")


# Series: all documents of a source are numbered volumes of one author, with near titles. The first founds the work, every fifth names its DOI, the others are refused.
_VOLUME = "'collected observations of the standing committee on periodical literature and related matters for ' || source || ' volume number '"


def _series(t) -> DataFrame:
    doc = F.col("doc_id")
    rows = t.raw("documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("digest"))
    first = rows.groupBy("source").agg(F.min("doc_id").alias("first"))
    return rows.join(first, "source").select(
        doc.cast("string").alias("record_id"), F.lpad(doc.cast("string"), 12, "0").alias("upstream_id"), F.lit(0).cast("bigint").alias("version_no"), at(doc % 31).alias("observed_at"),
        F.concat(F.expr(_VOLUME), F.lpad(doc.cast("string"), 7, "0")).alias("title"), F.col("source").alias("author"), F.lit(2024).alias("year"), F.concat(F.lit("v"), doc % 3).alias("label"),
        F.concat(F.array(F.concat(F.lit("sha:"), "digest", F.lit(":"), doc)), F.when((doc == F.col("first")) | (doc % 5 == 0), F.array(F.concat(F.lit("doi:"), "source"))).otherwise(F.array().cast("array<string>"))).alias("identities"),
        F.array(F.concat(F.lit("author of "), "source"), F.concat(F.lit("second "), "lang")).alias("authors"))


_SERIES = """SELECT *, sha256(CAST(first AS VARCHAR)) AS work, doc_id = first OR doc_id % 5 = 0 AS member, 'v' || (doc_id % 3) AS label FROM (SELECT doc_id, source, lang, min(doc_id) OVER (PARTITION BY source) AS first FROM documents)"""
_SERIES_LABELS = f"SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY doc_id) AS turn FROM ({_SERIES}) WHERE member"
_SERIES_DECIDED = f"""SELECT CAST(s.doc_id AS VARCHAR) AS record_id, CASE WHEN NOT s.member THEN 'manual_review' WHEN s.doc_id = s.first THEN 'created' WHEN turn = 1 THEN 'revision_created' ELSE 'already_known' END AS status,
    CASE WHEN s.member THEN s.work END AS work_id, s.label AS version_label FROM ({_SERIES}) s LEFT JOIN ({_SERIES_LABELS}) l USING (doc_id)"""


@query("e1_series", _SERIES_DECIDED)
def e1_series(t):
    return _resolved(t, _series).decisions


@query("e1_series_in_batches", _SERIES_DECIDED)
def e1_series_batches(t):
    """The records in three batches, each on top of the stored state of those before it; the decisions are those of one run."""
    tables = identity_store.identity_tables(t.spark, f"{shared_dir(t.spark)}/identity-{os.urandom(8).hex()}")
    records = _series(t)
    most = t.raw("documents").agg(F.max("doc_id")).first()[0] or 0
    for number in range(3):
        low, high = number * most // 3, (number + 1) * most // 3
        part = F.col("record_id").cast("bigint")
        identity_store.resolve_batch(tables, number, records.filter((part >= low) & ((part < high) | F.lit(number == 2))))
    return tables.read("decisions").drop("batch")


@query("e4_series_review", f"SELECT CAST(doc_id AS VARCHAR) AS record_id, work AS candidate_work_id, 'title:first_author:year' AS matched_on FROM ({_SERIES}) WHERE NOT member")
def e4_series(t):
    return _resolved(t, _series).review


@query("e2_series_versions", f"""SELECT work AS work_id, label AS version_label, CAST(doc_id AS VARCHAR) AS record_id, doc_id = max(doc_id) OVER (PARTITION BY source) AS is_current FROM ({_SERIES_LABELS}) WHERE turn = 1""")
def e2_series(t):
    return _resolved(t, _series).versions.drop("title")


@query("e3_series_authors", f"""SELECT work AS work_id, k.n AS author_order, CASE k.n WHEN 1 THEN 'author of ' || source ELSE 'second ' || lang END AS author FROM ({_SERIES}), (VALUES (1), (2)) k(n) WHERE doc_id = first""")
def e3_series(t):
    return _resolved(t, _series).authors


@query("w4_current_versions_resolved", f"""SELECT work AS work_id, CAST(max(doc_id) AS VARCHAR) AS record_id, count(*) AS versions FROM ({_SERIES_LABELS}) WHERE turn = 1 GROUP BY 1""")
def w4_resolved(t):
    versions = _resolved(t, _series).versions
    return versions.groupBy("work_id").agg(F.max(F.when(F.col("is_current"), F.col("record_id"))).alias("record_id"), F.count("*").alias("versions"))


@query("j7_titles_near_works", f"""SELECT source AS author, {_VOLUME} || lpad(CAST(doc_id AS VARCHAR), 7, '0') AS title, {_VOLUME} || lpad(CAST(first AS VARCHAR), 7, '0') AS other FROM ({_SERIES})""")
def j7_near(t):
    """Every volume against the first of its series: one row a volume, whatever the length of the series."""
    titles = _series(t).select("author", "title")
    return titles_near(titles, titles.groupBy("author").agg(F.min("title").alias("title")), ["author"], settings.FUZZY_TITLE_THRESHOLD)


# --- incremental ingestion -------------------------------------------------------------------------------


def _ingest(t, folder: str, store=store_batch, bad_key: str = "feed") -> None:
    """Stream the documents file into the tables of ``folder``; documents whose id is divisible by 97 come under ``bad_key``."""
    def prepare(batch: DataFrame) -> DataFrame:
        doc = F.col("doc_id")
        return batch.select(
            F.when(doc % 97 == 0, bad_key).otherwise("feed").alias("source_key"), F.concat(F.lit("d"), F.floor(doc / 2)).alias("upstream_id"), F.lit(None).cast("string").alias("upstream_version"),
            F.lit("https://example.org").alias("canonical_url"), at(doc % 31).alias("observed_at"), F.lit("text/plain").alias("media_type"), F.col("text").cast("binary").alias("payload"))

    # A pattern, since a stream takes a plain path for a folder: the table may be one file or a folder of files.
    source = t.spark.readStream.schema(t.raw("documents").schema).parquet(f"{t.sf_dir}/documents.parque[t]")
    ingest_files(source, f"{folder}/table", f"{folder}/checkpoint", prepare=prepare, store=store).awaitTermination()


def _folder(t) -> str:
    return f"{shared_dir(t.spark)}/ingest-{os.urandom(8).hex()}"


@query("t1_incremental_ingest", "SELECT DISTINCT 'd' || (doc_id // 2) AS upstream_id, sha256(text) AS payload_sha256 FROM documents")
def t1(t):
    """Streams the documents file into a table; copies within and across batches are stored once."""
    folder = _folder(t)
    _ingest(t, folder)
    return landed_tables(t.spark, f"{folder}/table").read("landed").select("upstream_id", "payload_sha256")


@query("t2_resumed_batch", """WITH k AS (SELECT 'd' || (doc_id // 2) AS upstream_id, sha256(text) AS h, count(*) AS n FROM documents WHERE doc_id % 97 <> 0 GROUP BY 1, 2)
    SELECT 'feed' AS source_key, CAST(sum(n) AS BIGINT) AS seen, count(*) AS created, CAST(sum(n) AS BIGINT) - count(*) AS duplicates, 0 AS refused, count(*) AS landed, 0 AS kept_aside FROM k
    UNION ALL SELECT 'Not A Key', count(*), 0, 0, count(*), 0, count(*) FROM documents WHERE doc_id % 97 = 0""")
def t2(t):
    """A batch dies after its rows are written and before its manifest is; nothing of it is seen. Run again, rows, refused rows and counts appear together, once."""
    folder = _folder(t)
    tables = landed_tables(t.spark, f"{folder}/table")

    def dies(batch: DataFrame, batch_id: int, table: str) -> None:
        own = landed_tables(batch.sparkSession, table)
        own.write_rows(batch_id, batch_rows(batch, batch_id, own))
        raise RuntimeError("stopped before the manifest")

    try:
        _ingest(t, folder, dies, "Not A Key")
    except StreamingQueryException:
        pass
    seen_early = tables.read("landed").select("source_key")
    _ingest(t, folder, bad_key="Not A Key")
    rows = lambda name, label: tables.read(name).select("source_key").unionByName(seen_early).groupBy("source_key").agg(F.count("*").alias(label))
    told = tables.read("counts").drop("batch").join(rows("landed", "landed"), "source_key", "left").join(rows("refused", "kept_aside"), "source_key", "left")
    return told.fillna(0, ["landed", "kept_aside"])


@query("t5_batches_compacted", """SELECT 'landed' AS name, count(*) AS n, 1 AS batches FROM (SELECT DISTINCT doc_id // 2 AS d, sha256(text) AS h FROM documents WHERE doc_id % 97 <> 0)
    UNION ALL SELECT 'refused', count(*), 1 FROM documents WHERE doc_id % 97 = 0""")
def t5(t):
    """Late documents in a second run, repeats of the first in a third; all batches compacted into one."""
    tables = landed_tables(t.spark, f"{_folder(t)}/table")
    doc = F.col("doc_id")
    payloads = t.raw("documents").select(
        "doc_id", F.when(doc % 97 == 0, "Not A Key").otherwise("feed").alias("source_key"), F.concat(F.lit("d"), F.floor(doc / 2)).alias("upstream_id"), F.lit(None).cast("string").alias("upstream_version"),
        F.lit("https://example.org").alias("canonical_url"), at(doc % 31).alias("observed_at"), F.lit("text/plain").alias("media_type"), F.col("text").cast("binary").alias("payload"))
    for number, part in enumerate(("doc_id % 3 <> 0", "doc_id % 3 = 0", "doc_id % 97 <> 0")):
        tables.write(number, batch_rows(payloads.filter(part).drop("doc_id"), number, tables))
    tables.compact(10)
    found = tables.read("landed").select(F.lit("landed").alias("name"), "batch").unionByName(tables.read("refused").select(F.lit("refused").alias("name"), "batch"))
    return found.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("batch").alias("batches"))
