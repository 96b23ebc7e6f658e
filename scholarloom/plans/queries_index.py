"""Queries on the stored term index and on listings read by boundary."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from scholarloom.operators import catalog, search
from scholarloom.operators.catalog import CatalogQuery
from scholarloom.operators.term_index import TermIndex
from scholarloom.plans.queries_catalog import _ORDERS
from scholarloom.plans.registry import query
from scholarloom.session import shared_dir

FIELDS = ["title", "body", "topics"]


def _index(t, fields) -> TermIndex:
    return TermIndex(t.spark, f"{shared_dir(t.spark)}/terms-{os.urandom(8).hex()}", fields)


def _papers(t):
    return search.search_documents(t["works"], t["authors"], t["work_topics"], t["topics"]).withColumnRenamed("work_id", "entity_id")


def _refreshed(t) -> TermIndex:
    """All papers, then a batch in which every tenth work gets another title, then one that deletes every hundredth; only those are read and written again."""
    index = _index(t, FIELDS)
    index.refresh(0, _papers(t), t["works"].filter("false").select(F.col("work_id").alias("entity_id")))
    changed = t["works"].filter("first_doc % 10 = 0")
    rebuilt = search.search_documents(changed, t["authors"], t["work_topics"], t["topics"]).withColumnRenamed("work_id", "entity_id")
    index.refresh(1, rebuilt.withColumn("title", F.lit("Renéwed")), changed.select(F.col("work_id").alias("entity_id")))
    deleted = t["works"].filter("first_doc % 100 = 0").select(F.col("work_id").alias("entity_id"))
    index.refresh(2, rebuilt.filter("false"), deleted)
    return index


_NOW = """(SELECT entity_id, field, term FROM search_terms WHERE entity_id NOT IN (SELECT work_id FROM works WHERE first_doc % 100 = 0)
    AND (field <> 'title' OR entity_id NOT IN (SELECT work_id FROM works WHERE first_doc % 10 = 0))
    UNION ALL SELECT work_id, 'title', 'renewed' FROM works WHERE work_type = 'paper' AND first_doc % 10 = 0 AND first_doc % 100 <> 0)"""


def _starts(*prefixes: str) -> str:
    return " AND ".join(f"count(CASE WHEN starts_with(term, '{p}') THEN 1 END) > 0" for p in prefixes)


_SEARCHES = {"Th né au": ("th", "ne", "au"), "RENEW": ("renew",), "renewed th": ("renewed", "th")}


@query("p2b_stored_texts", """SELECT work_id AS entity_id, CASE WHEN work_id IN (SELECT work_id FROM works WHERE first_doc % 10 = 0) THEN 'Renéwed' ELSE title END AS title, body, topics
    FROM search_docs WHERE work_id NOT IN (SELECT work_id FROM works WHERE first_doc % 100 = 0)""")
def p2b_stored(t):
    return _refreshed(t).texts()


@query("p3_stored_search", " UNION ALL ".join(
    f"SELECT '{text}' AS search, entity_id FROM {_NOW} GROUP BY entity_id HAVING {_starts(*prefixes)}" for text, prefixes in _SEARCHES.items()))
def p3_stored(t):
    """Searches on the segments as they lie, merged on read."""
    index, out = _refreshed(t), None
    for text in _SEARCHES:
        found = index.matching(text).select(F.lit(text).alias("search"), "entity_id")
        out = found if out is None else out.unionByName(found)
    return out


@query("p3_compacted_index", f"SELECT field, term, count(*) AS entities FROM {_NOW} GROUP BY 1, 2")
def p3_compacted(t):
    """The whole index after its three segments became one."""
    index = _refreshed(t)
    index.compact(3)
    return index.postings().groupBy("field", "term").agg(F.count("*").alias("entities"))


@query("p3b_stored_evidence", r"""SELECT DISTINCT span_id AS entity_id FROM (SELECT span_id, unnest(string_split_regex(strip_accents(replace(lower(text), 'ß', 'ss')), '[^\p{L}\p{N}]+')) AS term
    FROM spans WHERE document_id % 50 <> 0) WHERE starts_with(term, 'ere')""")
def p3b_stored(t):
    """Spans of two halves of the documents in two batches; then the spans of every fiftieth document are taken out."""
    index, spans = _index(t, ["text"]), t["spans"].select("document_id", F.col("span_id").cast("string").alias("entity_id"), "text")
    for batch in (0, 1):
        index.refresh(batch, spans.filter(F.col("document_id") % 2 == batch), spans.filter("false"))
    index.refresh(2, spans.filter("false"), spans.filter("document_id % 50 = 0"))
    return index.matching("ère")


def _register_seeks() -> None:
    for name, order in _ORDERS.items():
        scored = name in ("technical", "commercial", "priority")
        source = f"(SELECT p.*, s.{name}_score FROM papers p LEFT JOIN scores s USING (work_id))" if scored else "papers"

        @query(f"l2_seek_{name}", f"SELECT work_id, title FROM {source} ORDER BY {order} LIMIT 30 OFFSET 20")
        def seek(t, name=name):
            """The third page of ten and two more, each read from where the page before ended."""
            wanted, after, out = CatalogQuery(sort=name, limit=10), None, None
            for number in range(5):
                shown, after = catalog.seek_page(t, wanted, after)
                if number >= 2:
                    out = shown if out is None else out.unionByName(shown)
                if after is None:
                    break
            return out.select("work_id", "title")


_register_seeks()
