"""Corpus tables derived from the driver's parquet tables, and the same tables as SQL.

Every view is a pure expression over the given tables, so it grows with them. ``Corpus`` builds the
Spark side, each view when it is first asked for; views that others start from are written out once. ``VIEWS`` holds the SQL a reference engine runs to check the results.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarloom import settings
from scholarloom.functions.text import collapse_space, normal_form
from scholarloom.operators import linking
from scholarloom.operators.ranking import feature_frame, result_rows, score
from scholarloom.operators.topics import assign_topics, category_map, taxonomy
from scholarloom.session import durable

AS_OF_TEXT = "2024-02-01 00:00:00"
EPOCH = 1_704_067_200  # 2024-01-01 UTC
LINES_PER_PAGE = 8
EVENT_SOURCES = {"click": "github", "view": "official-rss", "purchase": "openreview", "signup": "huggingface", "error": "reddit"}
LANG_CATEGORIES = {"en": ["cs.AI", "zz.none"], "fr": ["cs.CL"], "de": ["cs.CV", "cs.AI"], "es": ["xx.none"]}
#: What events, links and the views over linked rows read; the rest of a record stays in ``sightings``.
LINKED_COLUMNS = ["record_id", "arrival", "source_key", "upstream_id", "title", "observed_at", "published_at", "updated_at", "work_id", "basis", "canonical_key", "confidence",
                  "relationship", "matching_evidence"]
CLAIM_TYPES = settings.LABELS["claim_type"]


def as_of() -> Column:
    return F.lit(AS_OF_TEXT).cast("timestamp")


def at(days: Column | int, hours: Column | int = 0) -> Column:
    """2024-01-01 plus days and hours."""
    d = days if isinstance(days, Column) else F.lit(days)
    h = hours if isinstance(hours, Column) else F.lit(hours)
    return F.timestamp_seconds(F.lit(EPOCH) + d * 86_400 + h * 3_600)


def pick(index: Column, options: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))


def work_key(text: Column) -> Column:
    return F.concat(F.lit("w"), F.substring(F.sha2(text, 256), 1, 20))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def preprint(number: Column, first_month: int = 0) -> Column:
    """Preprint id of a number: the month grows by one for each 100 000, so that no two numbers share an id."""
    month = F.floor(number / 100_000) + first_month
    return F.concat((F.floor(month / 12) + 24).cast("string"), F.lpad((month % 12 + 1).cast("string"), 2, "0"), F.lit("."),
                    F.lpad((number % 100_000).cast("string"), 5, "0"))


def published(doc: Column) -> Column:
    return F.when(doc % 17 != 0, at(-(doc % 400)))


class Corpus(Mapping):
    """The tables the jobs name, by name; each is built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir
        self.resolutions: dict = {}  # by the function that makes the records

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        return getattr(self, name)

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)

    @cached_property
    def sources(self) -> DataFrame:
        number = F.substring("source", 4, 9).cast("int")
        return self.raw("documents").select("source").distinct().select(
            F.col("source").alias("source_key"), F.concat(F.lit("Source "), F.substring("source", 4, 9)).alias("display_name"),
            F.substring(F.lit("ABCD"), number % 4 + 1, F.lit(1)).alias("trust_tier"))

    @cached_property
    def records(self) -> DataFrame:
        doc = F.col("doc_id")
        return self.raw("documents").select(
            doc.alias("record_id"), F.col("source").alias("source_key"), F.concat(F.lit("doc-"), doc).alias("upstream_id"),
            F.sha2("text", 256).alias("payload_sha256"), at(doc % 31).alias("observed_at"), at(doc % 29).alias("updated_at_upstream"))

    @cached_property
    def _keys(self) -> DataFrame:
        """(doc_id, work_id, lang, source): hashing the texts is done once and written out."""
        return durable(self.raw("documents").select("doc_id", work_key(F.col("text")).alias("work_id"), "lang", "source"))

    @cached_property
    def _titles(self) -> DataFrame:
        title = first_line(F.col("text"))
        return self.raw("documents").select(
            F.col("doc_id").alias("version_id"), title.alias("title"),
            F.nullif(F.substring("text", F.length(title) + 2, F.length("text")), F.lit("")).alias("abstract"))

    @cached_property
    def _grouped(self) -> DataFrame:
        """One row per work; all texts of a work are equal, so any document of it will do. Copies may name other languages: the first document that names one counts."""
        return self._keys.groupBy("work_id").agg(
            F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("current_version_id"), F.min_by("lang", F.when(F.col("lang").isNotNull(), F.col("doc_id"))).alias("lang"),
            F.max_by("source", "doc_id").alias("source"))

    @cached_property
    def works(self) -> DataFrame:
        first, last = F.col("first_doc"), F.col("current_version_id")
        titled = self._grouped.join(self._titles.withColumnRenamed("version_id", "current_version_id"), "current_version_id")
        return titled.select(
            "work_id", "first_doc", "current_version_id", "title", "abstract", "lang", "source",
            normal_form(F.col("title"), exact=False).alias("normalized_title"),
            F.when(first % 13 == 0, "article").otherwise("paper").alias("work_type"),
            F.when(first % 23 == 0, "rejected").otherwise("parsed").alias("lifecycle_state"),
            F.when(first % 3 == 0, "accepted").otherwise("preprint").alias("publication_status"),
            published(first).alias("first_published_at"), at(first % 31).alias("created_at"), at(last % 31).alias("updated_at"))

    @cached_property
    def versions(self) -> DataFrame:
        doc = F.col("version_id")
        keyed = self._keys.withColumnRenamed("doc_id", "version_id").join(
            self._grouped.select("work_id", F.col("current_version_id").alias("_last")), "work_id")
        url = F.concat(F.lit("https://github.com/"), F.col("lang"), F.lit("/"), F.col("source"), F.when(doc % 8 == 0, ".git").otherwise(""))
        none = F.array().cast("array<string>")
        return keyed.join(self._titles, "version_id").select(
            "work_id", "version_id", doc.alias("record_id"), F.concat(F.lit("v"), doc).alias("version_label"), "title", "abstract",
            "lang", "source", published(doc).alias("published_at"), at(doc % 31).alias("observed_at"),
            F.when(doc % 4 == 0, F.array(url)).otherwise(none).alias("repository_urls"), (doc == F.col("_last")).alias("is_current"))

    @cached_property
    def external_ids(self) -> DataFrame:
        first = F.col("first_doc")
        ids = F.array(
            F.when(first % 2 == 0, F.struct(F.lit("arxiv").alias("t"), preprint(first).alias("v"))),
            F.when(first % 5 == 0, F.struct(F.lit("github").alias("t"), F.concat(F.lit("own/r"), first).alias("v"))),
            F.when(first % 3 == 0, F.struct(F.lit("doi").alias("t"), F.concat(F.lit("10.5555/d."), first).alias("v"))))
        return self._grouped.select("work_id", F.explode(F.filter(ids, lambda i: i.isNotNull())).alias("i")).select(
            "work_id", F.col("i.t").alias("id_type"), F.col("i.v").alias("value"))

    @cached_property
    def authors(self) -> DataFrame:
        first = F.col("first_doc")
        slots = F.array(
            F.struct(F.lit(1).alias("o"), F.concat(F.lit("Author "), first % 97).alias("n")),
            F.when(first % 3 != 0, F.struct(F.lit(2).alias("o"), F.concat(F.lit("Coauthor "), first % 11).alias("n"))),
            F.when(first % 7 == 0, F.struct(F.lit(3).alias("o"), F.concat(F.lit("Editor "), F.col("lang")).alias("n"))))
        return self._grouped.select("work_id", F.explode(F.filter(slots, lambda s: s.isNotNull())).alias("a")).select(
            "work_id", F.col("a.o").alias("author_order"), F.concat_ws("-", "work_id", "a.o").alias("author_id"), F.col("a.n").alias("display_name"))

    @cached_property
    def topics(self) -> DataFrame:
        return taxonomy(self.spark)

    @cached_property
    def work_topics(self) -> DataFrame:
        table = F.create_map(*[x for k, v in LANG_CATEGORIES.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
        rows = self._grouped.select(
            "work_id", F.col("work_id").alias("record_id"), F.lit("arxiv").alias("source_key"), table[F.col("lang")].alias("categories"))
        return assign_topics(rows, category_map(self.spark))

    @cached_property
    def documents(self) -> DataFrame:
        doc, n = F.col("doc_id"), F.col("n")
        good, bad = F.col("quality") == 1, F.col("toxic") == 1
        rows = self.raw("labels").withColumn("n", F.explode(F.sequence(F.lit(0).cast("bigint"), doc % 2)))
        status = F.when(n == 0, F.when(good, "parsed").when(bad, "failed").otherwise("partial")).otherwise(F.when(bad, "pending").otherwise("parsed"))
        return rows.select(
            (doc * 10 + n).alias("document_id"), doc.alias("version_id"), F.lit("paper_pdf").alias("document_role"), status.alias("parse_status"),
            at(doc % 20, n * (doc % 5 - 2)).alias("acquired_at"))

    @cached_property
    def attempts(self) -> DataFrame:
        doc, n = F.col("doc_id"), F.col("n")
        rows = self.raw("documents").select("doc_id").filter(doc % 3 != 0).withColumn("n", F.explode(F.sequence(F.lit(0).cast("bigint"), doc % 3)))
        return rows.select(
            (doc * 10 + n).alias("attempt_id"), doc.alias("version_id"), pick((doc + n) % 3, ["succeeded", "failed", "quarantined"]).alias("status"),
            at(doc % 25, n).alias("attempted_at"))

    @cached_property
    def text_pages(self) -> DataFrame:
        """Pages of eight lines of all documents."""
        lines = self.raw("documents").filter("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("lines"))
        count = F.ceil(F.size("lines") / LINES_PER_PAGE).cast("int")
        return lines.select(
            (F.col("doc_id") * 10).alias("document_id"), F.col("doc_id").alias("version_id"), "lines",
            F.explode(F.sequence(F.lit(1), count)).alias("page"),
        ).select("document_id", "version_id", "page", F.slice("lines", (F.col("page") - 1) * LINES_PER_PAGE + 1, F.lit(LINES_PER_PAGE)).alias("blocks"))

    @cached_property
    def spans(self) -> DataFrame:
        """Non-empty lines of all documents as spans, addressed by page and line."""
        rows = self.text_pages.select("document_id", "version_id", "page", F.posexplode("blocks").alias("char_start", "raw"))
        text = collapse_space(F.col("raw"))
        return rows.withColumn("text", text).filter("text <> ''").select(
            "document_id", "version_id", "page", "char_start", "text",
            F.sha2(F.concat_ws("|", "document_id", "page", "char_start"), 256).alias("span_id"), F.sha2("text", 256).alias("text_sha256"))

    @cached_property
    def sightings(self) -> DataFrame:
        """Events as sightings of artifacts of five sources."""
        e, user = F.col("event_id"), F.col("user_id")
        table = F.create_map(*[F.lit(x) for pair in EVENT_SOURCES.items() for x in pair])
        upstream = F.concat(F.lit("u"), user, F.lit("-"), e % 5)
        paper = preprint(user)
        identity = F.struct(F.lit("arxiv").alias("id_type"), paper.alias("raw_value"), paper.alias("normalized_value"))
        empty_ids = F.array().cast("array<struct<id_type:string,raw_value:string,normalized_value:string>>")
        urls = F.array(F.concat(F.lit("https://github.com/EN/src"), user % 20, F.lit(".git")))
        ts = F.col("ts").cast("timestamp")
        return self.raw("events").select(
            e.alias("record_id"), e.alias("arrival"), table[F.col("event_type")].alias("source_key"), upstream.alias("upstream_id"),
            F.when(e % 10 == 0, "release").otherwise("repository").alias("work_type"), pick(e % 3, ["models", "datasets", "spaces"]).alias("kind"),
            F.concat_ws(" ", "event_type", user, e).alias("title"), F.lit(None).cast("string").alias("summary"),
            F.concat(F.lit("https://example.org/"), upstream).alias("canonical_url"), ts.alias("observed_at"),
            F.when(e % 3 != 0, F.timestamp_micros(F.unix_micros(ts) - 2 * 86_400_000_000)).alias("published_at"),
            F.when(e % 2 == 0, F.timestamp_micros(F.unix_micros(ts) - 86_400_000_000)).alias("updated_at"),
            F.when(user % 4 != 3, F.array(identity)).otherwise(empty_ids).alias("identities"),
            F.when(e % 3 == 0, urls).otherwise(F.array().cast("array<string>")).alias("repository_urls"))

    @cached_property
    def linked_rows(self) -> DataFrame:
        attached = linking.attach_records(self.sightings, self.external_ids, self.versions)
        # Events and links both start from these rows, so they are written out once; their ids, long hashes of what is written, are made when they are read.
        return durable(linking.link_rows(linking.with_source_facts(attached, linking.source_facts(self.spark))).select(LINKED_COLUMNS)).withColumns(linking.link_ids())

    @cached_property
    def artifacts(self) -> DataFrame:
        facts = linking.with_source_facts(self.sightings, linking.source_facts(self.spark))
        return durable(linking.upsert_artifacts(facts, as_of()))

    @cached_property
    def links(self) -> DataFrame:
        return durable(linking.upsert_links(self.linked_rows))

    @cached_property
    def events(self) -> DataFrame:
        events = linking.upsert_events(self.linked_rows)
        return durable(linking.event_measures(events, self.links, self.artifacts))

    @cached_property
    def runs(self) -> DataFrame:
        run = F.col("run_id")
        convs = self.raw("conversations").groupBy(F.col("conv_id").alias("run_id")).agg(F.count("*").alias("turns"))
        works = self._keys.select(F.col("doc_id").alias("run_id"), "work_id")
        ok = run % 5 != 0
        return convs.join(works, "run_id").select(
            "run_id", "work_id", "turns", F.when(run % 2 == 0, "deep_dive").otherwise("fast_brief").alias("analysis_type"),
            F.when(ok, "succeeded").otherwise("failed").alias("status"), at(run % 40).alias("created_at"), at(run % 40, 1).alias("completed_at"),
            F.when(ok, F.lit("{}")).alias("output_json"), F.concat(F.lit("f"), run % 60).alias("input_fingerprint"),
            F.lit("m1").alias("model_profile"), F.lit("p1").alias("prompt_version"))

    @cached_property
    def jobs(self) -> DataFrame:
        run = F.col("run_id")
        return self.runs.filter("analysis_type = 'deep_dive'").select(
            run.alias("job_id"), "work_id", pick(run % 3, ["failed", "rejected", "succeeded"]).alias("status"), F.col("completed_at").alias("updated_at"))

    @cached_property
    def claims(self) -> DataFrame:
        """Assistant turns as claims that cite the user turn before them."""
        run, turn = F.col("conv_id"), F.col("turn")
        own = F.array(F.concat_ws(":", run, turn - 1))
        foreign = F.array(F.concat_ws(":", run + 100_000_000, turn))
        cited = F.when(run % 7 == 3, F.array().cast("array<string>")).when(run % 11 == 5, F.concat(own, foreign)).otherwise(own)
        return self.raw("conversations").filter("role = 'assistant'").select(
            run.alias("run_id"), turn.alias("claim_no"), F.concat_ws("-claim-", run, turn).alias("claim_id"), F.col("text").alias("claim_text"),
            pick((run + turn) % 4, CLAIM_TYPES).alias("claim_type"), pick((run + turn) % 3, settings.LABELS["importance"]).alias("importance"),
            pick(run % 4, settings.LABELS["verification_status"]).alias("verification_status"), F.concat_ws("-", run, turn).alias("local_id"),
            cited.alias("evidence_ids"))

    @cached_property
    def allowed(self) -> DataFrame:
        return self.raw("conversations").filter("role = 'user'").select(F.col("conv_id").alias("run_id"), F.concat_ws(":", "conv_id", "turn").alias("span_id"))

    @cached_property
    def results(self) -> DataFrame:
        return durable(result_rows(score(feature_frame(self, as_of())), "default-1"))

    @cached_property
    def search_terms(self) -> DataFrame:
        from scholarloom.operators.search import search_documents, search_terms

        documents = search_documents(self.works, self.authors, self.work_topics, self.topics)
        return search_terms(documents, "work_id", ["title", "body", "topics"])


TABLES = [
    "sources", "records", "works", "versions", "external_ids", "authors", "topics", "work_topics", "documents", "attempts", "text_pages",
    "spans", "sightings", "linked_rows", "artifacts", "links", "events", "runs", "jobs", "claims", "allowed", "results", "search_terms",
]

# ------------------------------------------------------------------------------------------------
# The same tables in SQL.


def sql_at(days: str, hours: str = "0") -> str:
    return f"(TIMESTAMP '2024-01-01' + to_days(CAST({days} AS INT)) + to_hours(CAST({hours} AS INT)))"


def sql_preprint(number: str, first_month: int = 0) -> str:
    month = f"({number} // 100000 + {first_month})"
    return f"(({month} // 12 + 24) || lpad(CAST({month} % 12 + 1 AS VARCHAR), 2, '0') || '.' || lpad(CAST({number} % 100000 AS VARCHAR), 5, '0'))"


def sql_pick(index: str, options: list[str]) -> str:
    return f"list_extract([{', '.join(repr(o) for o in options)}], CAST({index} AS INT) + 1)"


def sql_published(doc: str) -> str:
    return f"(CASE WHEN {doc} % 17 <> 0 THEN {sql_at(f'-({doc} % 400)')} END)"


def sql_collapse(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


def sql_normal(text: str) -> str:
    return rf"nullif(trim(regexp_replace(replace(lower({text}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), '')"


def sql_time(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d %H:%M:%S')"


def _sql_values(rows: list[tuple]) -> str:
    def cell(x) -> str:
        if x is None:
            return "NULL"
        return repr(x) if isinstance(x, str) else str(x)

    return "VALUES " + ", ".join("(" + ", ".join(cell(c) for c in r) + ")" for r in rows)


_TOPIC_ROWS = [(k, n, p, w) for k, n, p, w in settings.TOPICS]
_LANG_TOPICS = [
    (lang, topic) for lang, cats in LANG_CATEGORIES.items() for cat in cats
    for _, known, topics in settings.CATEGORY_TOPICS if known == cat for topic in topics]
_FACTS = [tuple(r) for r in settings.SOURCE_FACTS]

VIEWS: dict[str, str] = {
    "sources": "SELECT DISTINCT source AS source_key, 'Source ' || substr(source, 4) AS display_name, "
               "substr('ABCD', CAST(substr(source, 4) AS INT) % 4 + 1, 1) AS trust_tier FROM documents",
    "records": f"SELECT doc_id AS record_id, source AS source_key, 'doc-' || doc_id AS upstream_id, sha256(text) AS payload_sha256, "
               f"{sql_at('doc_id % 31')} AS observed_at, {sql_at('doc_id % 29')} AS updated_at_upstream FROM documents",
    "docs": "SELECT doc_id, lang, source, 'w' || substr(sha256(text), 1, 20) AS work_id, split_part(text, chr(10), 1) AS title, "
            "nullif(substr(text, length(split_part(text, chr(10), 1)) + 2), '') AS abstract FROM documents",
    "works": f"""SELECT *, {sql_normal('title')} AS normalized_title,
        CASE WHEN first_doc % 13 = 0 THEN 'article' ELSE 'paper' END AS work_type,
        CASE WHEN first_doc % 23 = 0 THEN 'rejected' ELSE 'parsed' END AS lifecycle_state,
        CASE WHEN first_doc % 3 = 0 THEN 'accepted' ELSE 'preprint' END AS publication_status,
        {sql_published('first_doc')} AS first_published_at, {sql_at('first_doc % 31')} AS created_at,
        {sql_at('current_version_id % 31')} AS updated_at
        FROM (SELECT work_id, min(doc_id) AS first_doc, max(doc_id) AS current_version_id, any_value(title) AS title,
              any_value(abstract) AS abstract, any_value(lang) AS lang, max_by(source, doc_id) AS source FROM docs GROUP BY work_id)""",
    "versions": f"""SELECT work_id, doc_id AS version_id, doc_id AS record_id, 'v' || doc_id AS version_label, title, abstract, lang, source,
        {sql_published('doc_id')} AS published_at, {sql_at('doc_id % 31')} AS observed_at,
        CASE WHEN doc_id % 4 = 0 THEN 'https://github.com/' || lang || '/' || source || CASE WHEN doc_id % 8 = 0 THEN '.git' ELSE '' END END AS repository_url,
        doc_id = max(doc_id) OVER (PARTITION BY work_id) AS is_current FROM docs""",
    "external_ids": f"""SELECT work_id, 'arxiv' AS id_type, {sql_preprint('first_doc')} AS value FROM works WHERE first_doc % 2 = 0
        UNION ALL SELECT work_id, 'github', 'own/r' || first_doc FROM works WHERE first_doc % 5 = 0
        UNION ALL SELECT work_id, 'doi', '10.5555/d.' || first_doc FROM works WHERE first_doc % 3 = 0""",
    "authors": """SELECT work_id, 1 AS author_order, 'Author ' || (first_doc % 97) AS display_name FROM works
        UNION ALL SELECT work_id, 2, 'Coauthor ' || (first_doc % 11) FROM works WHERE first_doc % 3 <> 0
        UNION ALL SELECT work_id, 3, 'Editor ' || lang FROM works WHERE first_doc % 7 = 0""",
    "topics": f"SELECT * FROM ({_sql_values(_TOPIC_ROWS)}) t(topic_key, display_name, parent_key, user_weight)",
    "work_topics": f"""SELECT DISTINCT w.work_id, coalesce(m.topic_key, 'unknown') AS topic_key FROM works w
        LEFT JOIN ({_sql_values(_LANG_TOPICS)}) m(lang, topic_key) ON m.lang = w.lang""",
    "pdfs": f"""SELECT doc_id * 10 + n AS document_id, doc_id AS version_id,
        CASE WHEN n = 0 THEN CASE WHEN quality = 1 THEN 'parsed' WHEN toxic = 1 THEN 'failed' ELSE 'partial' END
             WHEN toxic = 1 THEN 'pending' ELSE 'parsed' END AS parse_status,
        {sql_at('doc_id % 20', 'n * (doc_id % 5 - 2)')} AS acquired_at
        FROM labels, (VALUES (0), (1)) k(n) WHERE n <= doc_id % 2""",
    "attempts": f"""SELECT doc_id * 10 + n AS attempt_id, doc_id AS version_id, {sql_pick('(doc_id + n) % 3', ['succeeded', 'failed', 'quarantined'])} AS status,
        {sql_at('doc_id % 25', 'n')} AS attempted_at FROM documents, (VALUES (0), (1), (2)) k(n) WHERE doc_id % 3 <> 0 AND n <= doc_id % 3""",
    "lines": f"""SELECT doc_id * 10 AS document_id, doc_id AS version_id, i, i // {LINES_PER_PAGE} + 1 AS page, i % {LINES_PER_PAGE} AS block, raw FROM (
        SELECT d.doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
        FROM documents d)""",
    "spans": f"""SELECT document_id, version_id, page, block AS char_start, text, sha256(document_id || '|' || page || '|' || block) AS span_id,
        sha256(text) AS text_sha256 FROM (SELECT *, {sql_collapse('raw')} AS text FROM lines) WHERE text <> ''""",
    "sightings": f"""SELECT event_id AS record_id, event_id AS arrival, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_SOURCES.items())} END AS source_key,
        'u' || user_id || '-' || (event_id % 5) AS upstream_id, CASE WHEN event_id % 10 = 0 THEN 'release' ELSE 'repository' END AS work_type,
        {sql_pick('event_id % 3', ['model', 'dataset', 'space'])} AS kind, event_type || ' ' || user_id || ' ' || event_id AS title,
        'https://example.org/u' || user_id || '-' || (event_id % 5) AS canonical_url, ts AS observed_at,
        CASE WHEN event_id % 3 <> 0 THEN ts - to_days(2) END AS published_at, CASE WHEN event_id % 2 = 0 THEN ts - to_days(1) END AS updated_at,
        CASE WHEN user_id % 4 <> 3 THEN {sql_preprint('user_id')} END AS paper_id,
        CASE WHEN event_id % 3 = 0 THEN 'https://github.com/EN/src' || (user_id % 20) || '.git' END AS repository_url FROM events""",
    "facts": f"SELECT * FROM ({_sql_values(_FACTS)}) t(source_key, authority, content_class, fixed_artifact_type, fixed_source_type, linked_relationship, free_relationship)",
    "faced": """SELECT s.*, f.authority, f.content_class, f.linked_relationship, f.free_relationship,
        coalesce(f.fixed_artifact_type, CASE s.source_key WHEN 'github' THEN s.work_type WHEN 'huggingface' THEN s.kind ELSE 'paper' END) AS artifact_type,
        f.fixed_source_type FROM sightings s JOIN facts f USING (source_key)""",
    "repo_owners": r"SELECT regexp_replace(lower(repository_url), '\.git$', '') AS url, min(work_id) AS work_id FROM versions WHERE is_current AND repository_url IS NOT NULL GROUP BY 1",
    "linked_rows": r"""SELECT *, coalesce('work:' || work_id, 'artifact:' || source_key || ':' || upstream_id) AS canonical_key,
        sha256(source_key || chr(0) || upstream_id) AS artifact_id,
        CASE WHEN work_id IS NULL THEN 'canonical_work' WHEN paper_id IS NOT NULL THEN 'external_id' ELSE 'explicit_url' END AS basis,
        CASE WHEN source_key = 'github' AND work_type = 'release' THEN 'release' WHEN work_id IS NOT NULL THEN linked_relationship ELSE free_relationship END AS relationship
        FROM (SELECT s.*, coalesce(x.work_id, CASE WHEN s.source_key <> 'openreview' THEN r.work_id END) AS work_id FROM faced s
              LEFT JOIN external_ids x ON x.id_type = 'arxiv' AND x.value = s.paper_id
              LEFT JOIN repo_owners r ON r.url = regexp_replace(lower(s.repository_url), '\.git$', ''))""",
    "artifacts": f"""SELECT sha256(source_key || chr(0) || upstream_id) AS artifact_id, source_key, upstream_id,
        min_by(artifact_type, arrival) AS artifact_type, arg_min_null(published_at, arrival) AS published_at,
        max_by(record_id, arrival) AS record_id, max_by(coalesce(fixed_source_type, artifact_type), arrival) AS source_type, max_by(title, arrival) AS title,
        max_by(canonical_url, arrival) AS canonical_url, any_value(content_class) AS content_class, any_value(authority) AS authority,
        arg_max_null(updated_at, arrival) AS updated_at,
        max_by(greatest(0.0, 1 - greatest(0.0, epoch_us(TIMESTAMP '{AS_OF_TEXT}') - epoch_us(coalesce(updated_at, published_at, observed_at))) / 86400000000 / 30), arrival) AS freshness,
        CASE WHEN count(*) = 1 THEN 1.0 ELSE 0.0 END AS novelty, count(*) AS sightings FROM faced GROUP BY source_key, upstream_id""",
    "links": """SELECT sha256(canonical_key) AS event_id, canonical_key, artifact_id, max_by(relationship, arrival) AS relationship, max_by(basis, arrival) AS basis,
        CASE WHEN max_by(basis, arrival) = 'explicit_url' THEN 0.95 ELSE 1.0 END AS confidence,
        max_by(CASE basis WHEN 'external_id' THEN 'arxiv:' || paper_id WHEN 'explicit_url' THEN repository_url ELSE canonical_url END, arrival) AS evidence
        FROM linked_rows GROUP BY canonical_key, artifact_id""",
    "event_base": """SELECT sha256(canonical_key) AS event_id, canonical_key, max_by(title, arrival) AS title, min(work_id) AS primary_work_id,
        max_by(coalesce(updated_at, published_at), CASE WHEN coalesce(updated_at, published_at) IS NOT NULL THEN arrival END) AS occurred_at,
        max(observed_at) AS updated_at FROM linked_rows GROUP BY canonical_key""",
    "event_measures": """SELECT event_id, count(DISTINCT source_key) AS source_count,
        count(DISTINCT CASE WHEN authority >= 0.7 AND content_class = 'fact' THEN source_key END) AS authoritative_sources, avg(confidence) AS association_confidence
        FROM links JOIN artifacts USING (artifact_id) GROUP BY event_id""",
    "linked_events": """SELECT b.*, m.source_count, m.authoritative_sources, m.association_confidence,
        least(1.0, greatest(0, m.source_count - 1) / 2) AS corroboration,
        CASE WHEN source_count <= 1 THEN 'artifact' WHEN authoritative_sources >= 2 THEN 'corroborated_event' ELSE 'associated_event' END AS classification,
        CASE WHEN source_count <= 1 THEN 'single_source' WHEN authoritative_sources >= 2 THEN 'corroborated' ELSE 'associated' END AS corroboration_status
        FROM event_base b JOIN event_measures m USING (event_id)""",
    "runs": f"""SELECT c.run_id, d.work_id, c.turns, CASE WHEN run_id % 2 = 0 THEN 'deep_dive' ELSE 'fast_brief' END AS analysis_type,
        CASE WHEN run_id % 5 <> 0 THEN 'succeeded' ELSE 'failed' END AS status, {sql_at('run_id % 40')} AS created_at, {sql_at('run_id % 40', '1')} AS completed_at,
        CASE WHEN run_id % 5 <> 0 THEN '{{}}' END AS output_json, 'f' || (run_id % 60) AS input_fingerprint
        FROM (SELECT conv_id AS run_id, count(*) AS turns FROM conversations GROUP BY 1) c JOIN docs d ON d.doc_id = c.run_id""",
    "jobs": f"SELECT run_id AS job_id, work_id, {sql_pick('run_id % 3', ['failed', 'rejected', 'succeeded'])} AS status, completed_at AS updated_at FROM runs WHERE analysis_type = 'deep_dive'",
    "claims": f"""SELECT conv_id AS run_id, turn AS claim_no, conv_id || '-claim-' || turn AS claim_id, text AS claim_text,
        {sql_pick('(conv_id + turn) % 4', CLAIM_TYPES)} AS claim_type, {sql_pick('(conv_id + turn) % 3', settings.LABELS['importance'])} AS importance,
        {sql_pick('conv_id % 4', settings.LABELS['verification_status'])} AS verification_status,
        CASE WHEN conv_id % 7 = 3 THEN CAST([] AS VARCHAR[]) WHEN conv_id % 11 = 5 THEN [conv_id || ':' || (turn - 1), (conv_id + 100000000) || ':' || turn]
             ELSE [conv_id || ':' || (turn - 1)] END AS evidence_ids FROM conversations WHERE role = 'assistant'""",
    "allowed": "SELECT conv_id AS run_id, conv_id || ':' || turn AS span_id FROM conversations WHERE role = 'user'",
    "cites": "SELECT DISTINCT run_id, claim_no, claim_id, unnest(evidence_ids) AS span_id FROM claims",
    "edges": "SELECT claim_id, span_id FROM cites JOIN allowed USING (run_id, span_id)",
    "papers": """SELECT w.work_id, w.normalized_title, w.publication_status, w.first_published_at, w.created_at, w.updated_at, w.current_version_id, v.title, v.abstract,
        v.version_label, v.record_id, v.published_at, r.source_key, r.observed_at, r.updated_at_upstream, s.display_name, s.trust_tier,
        coalesce(v.published_at, w.first_published_at) AS publication_date
        FROM works w JOIN versions v ON v.version_id = w.current_version_id JOIN records r ON r.record_id = v.record_id JOIN sources s USING (source_key)
        WHERE w.work_type = 'paper' AND w.lifecycle_state NOT IN ('failed', 'rejected', 'superseded')""",
    "with_docs": "SELECT DISTINCT work_id FROM versions JOIN pdfs USING (version_id) WHERE parse_status IN ('parsed', 'partial')",
    "analyzed": "SELECT DISTINCT work_id FROM runs WHERE status = 'succeeded'",
    "work_artifacts": "SELECT e.primary_work_id AS work_id, e.event_id, l.relationship, a.* FROM linked_events e JOIN links l USING (event_id) JOIN artifacts a USING (artifact_id) WHERE e.primary_work_id IS NOT NULL",
    "features": f"""SELECT p.work_id, p.title, p.abstract, coalesce(r.w, 0.0) AS relevance, d.work_id IS NOT NULL AS has_document, c.work_id IS NOT NULL AS has_code,
        a.work_id IS NOT NULL AS analyzed, coalesce(g.authority, 0.0) AS authority, coalesce(g.novelty, 0.0) AS novelty, coalesce(e.corroboration, 0.0) AS corroboration,
        (CASE p.trust_tier WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.75 WHEN 'C' THEN 0.5 WHEN 'D' THEN 0.25 ELSE 0.5 END)
          * (CASE WHEN p.publication_status = 'preprint' THEN 0.9 ELSE 1.0 END) AS quality,
        exp(-ln(2) * coalesce(greatest(0.0, (epoch(TIMESTAMP '{AS_OF_TEXT}') - epoch(p.first_published_at)) / 86400.0), 365.0) / 30.0) AS freshness
        FROM papers p
        LEFT JOIN (SELECT work_id, CAST(max(user_weight) AS DOUBLE) AS w FROM work_topics JOIN topics USING (topic_key) GROUP BY 1) r USING (work_id)
        LEFT JOIN with_docs d USING (work_id) LEFT JOIN (SELECT DISTINCT work_id FROM external_ids WHERE id_type = 'github') c USING (work_id)
        LEFT JOIN analyzed a USING (work_id)
        LEFT JOIN (SELECT work_id, CAST(max(authority) AS DOUBLE) AS authority, CAST(max(novelty) AS DOUBLE) AS novelty FROM work_artifacts GROUP BY 1) g USING (work_id)
        LEFT JOIN (SELECT primary_work_id AS work_id, CAST(max(corroboration) AS DOUBLE) AS corroboration FROM linked_events GROUP BY 1) e USING (work_id)""",
    "components": """SELECT work_id, title, abstract, has_document, has_code, analyzed, relevance, CASE WHEN relevance >= 0.95 THEN 1 ELSE 0 END AS critical,
        round(relevance * 0.20 * 100, 4) AS c_r, round(least(1.0, 0.5 + 0.2 * novelty + 0.1 * corroboration) * 0.15 * 100, 4) AS c_n,
        round(CASE WHEN has_document THEN 0.65 ELSE 0.25 END * 0.15 * 100, 4) AS c_e,
        round(CASE WHEN has_document AND has_code THEN 0.9 WHEN has_document THEN 0.55 ELSE 0.25 END * 0.12 * 100, 4) AS c_p,
        6.0 AS c_i, 5.0 AS c_m, round(greatest(quality, authority) * 0.08 * 100, 4) AS c_q, round(freshness * 0.08 * 100, 4) AS c_f,
        round(CASE WHEN has_document THEN 0.6 ELSE 0.45 END * 0.13 * 100, 4) AS c_b, round(relevance * 0.5 * 0.08 * 100, 4) AS c_x FROM features""",
    "scores": """SELECT *, round(least(100.0, greatest(0.0, 0.55 * t + 0.30 * c + 15 * critical - 20 * CASE WHEN analyzed THEN 1 ELSE 0 END)), 4) AS priority_score,
        round(t, 4) AS technical_score, round(c, 4) AS commercial_score FROM (
        SELECT *, CAST(least(100.0, greatest(0.0, c_r + c_n + c_e + c_p + c_i + c_m + c_q + c_f)) AS DOUBLE) AS t,
               CAST(least(100.0, greatest(0.0, 9.0 + 8.0 + 7.0 + c_b + 6.0 + 5.0 + 4.5 + c_x)) AS DOUBLE) AS c FROM components)""",
    "results": """SELECT work_id, 'technical' AS score_kind, technical_score AS total_score FROM scores
        UNION ALL SELECT work_id, 'commercial', commercial_score FROM scores UNION ALL SELECT work_id, 'deep_dive_priority', priority_score FROM scores""",
    "search_docs": """SELECT w.work_id, w.title, trim(coalesce(w.abstract, '') || ' ' || coalesce(a.names, '')) AS body, coalesce(t.labels, '') AS topics
        FROM works w LEFT JOIN (SELECT work_id, string_agg(display_name, ' ' ORDER BY author_order) AS names FROM authors GROUP BY 1) a USING (work_id)
        LEFT JOIN (SELECT work_id, string_agg(display_name, ' ' ORDER BY display_name) AS labels FROM work_topics JOIN topics USING (topic_key) GROUP BY 1) t USING (work_id)
        WHERE w.work_type = 'paper'""",
    "search_terms": r"""SELECT DISTINCT work_id AS entity_id, field, term FROM (
        SELECT work_id, 'title' AS field, unnest(string_split_regex(strip_accents(replace(lower(title), 'ß', 'ss')), '[^\p{L}\p{N}]+')) AS term FROM search_docs
        UNION ALL SELECT work_id, 'body', unnest(string_split_regex(strip_accents(replace(lower(body), 'ß', 'ss')), '[^\p{L}\p{N}]+')) FROM search_docs
        UNION ALL SELECT work_id, 'topics', unnest(string_split_regex(strip_accents(replace(lower(topics), 'ß', 'ss')), '[^\p{L}\p{N}]+')) FROM search_docs) WHERE term <> ''""",
}


def sql_with(body: str) -> str:
    """``body`` with the views it uses, directly or not, put before it."""
    import re

    def names_in(text: str) -> set[str]:
        return {m for m in re.findall(r"\b[a-z_]+\b", text) if m in VIEWS}

    ordered: list[str] = []

    def add(name: str, path: tuple[str, ...]) -> None:
        if name in ordered or name in path:
            return
        for used in sorted(names_in(VIEWS[name]) - {name}):
            add(used, (*path, name))
        ordered.append(name)

    for name in sorted(names_in(body)):
        add(name, ())
    if not ordered:
        return body
    return "WITH " + ", ".join(f"{name} AS ({VIEWS[name]})" for name in ordered) + " " + body
