"""Documents to citable evidence: segmentation, page triage, packing, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarloom import settings
from scholarloom.functions.text import collapse_space, is_heading, text_hash
from scholarloom.operators.ordered import carry_forward, sum_before

INVISIBLE = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>|<nav\b.*?</nav>|<!--.*?-->"
BLOCK_TAG = (
    r"(?i)</?(?:h[1-6]|p|br|li|ul|ol|td|th|tr|table|pre|blockquote|figcaption|article|section|div|body|html)\b[^>]*>"
)
ANY_TAG = r"<[^>]+>"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
PAGES_PER_CHUNK = 64


def unescape(text: Column) -> Column:
    for entity, mark in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return text


def html_blocks(html: Column) -> Column:
    """Texts between block-level tags, in order; script, style, head, navigation and comments are left out."""
    visible = F.regexp_replace(html, INVISIBLE, " ")
    return F.transform(F.split(visible, BLOCK_TAG), lambda b: unescape(F.regexp_replace(b, ANY_TAG, " ")))


def segment(pages: DataFrame, *, max_page_chars: int | None = None) -> DataFrame:
    """Evidence spans of ``pages`` (document_id, page, blocks array<string>).

    Offsets run within the page, each block one character after the previous one. The last heading
    seen applies to the blocks after it, across pages. All pages take part, and all characters unless the caller
    sets ``max_page_chars``.
    """
    texts = pages.select("document_id", "page", F.posexplode("blocks").alias("block", "raw"))
    texts = texts.withColumn("text", collapse_space(F.col("raw"))).filter("text <> ''").drop("raw")
    inside = Window.partitionBy("document_id", "page").orderBy("block")
    before = F.coalesce(F.sum(F.length("text") + 1).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = texts.withColumn("char_start", before)
    if max_page_chars is not None:  # a cut text is the last of its page: the next one would start beyond the limit
        placed = placed.filter(F.col("char_start") < max_page_chars).withColumn("text", F.substring("text", F.lit(1), F.lit(max_page_chars) - F.col("char_start")))
    placed = placed.withColumn("char_end", F.col("char_start") + F.length("text"))
    heading = F.when(is_heading(F.col("text")), F.col("text"))
    sectioned = carry_forward(
        placed, ["document_id"], F.floor(F.col("page") / PAGES_PER_CHUNK), ["page", "block"], heading, "section_path")
    return sectioned.withColumn("text_sha256", text_hash(F.col("text"))).withColumn(
        "span_id", F.sha2(F.concat_ws("|", "document_id", "text_sha256", "page", "char_start"), 256))


def page_triage(pages: DataFrame, *, suspicious: int = settings.SUSPICIOUS_PAGE_CHARS) -> DataFrame:
    """Extraction class of each page of (document_id, page, blocks, image_count)."""
    texts = F.filter(F.transform("blocks", collapse_space), lambda t: t != "")
    length = F.aggregate(texts, F.lit(0), lambda acc, t: acc + F.length(t) + 1)
    return pages.select("document_id", "page", "image_count", length.alias("_end")).select(
        "document_id", "page", "image_count",
        F.greatest(F.lit(0), F.col("_end") - 1).alias("native_character_count"),
        F.when(F.col("_end") == 0, F.when(F.col("image_count") > 0, "ocr_required").otherwise("empty"))
        .when(F.col("_end") < suspicious, "suspicious").otherwise("native_text").alias("extraction_class"))


def document_outcome(triage: DataFrame, page_counts: DataFrame, *, max_pages: int | None = None) -> DataFrame:
    """(document_id, page_count, empty_pages, parse_status); an empty page makes a document partial, as does
    a page count above ``max_pages``, for callers whose parser stops there."""
    empty = F.count_if(F.col("native_character_count") == 0).alias("empty_pages")
    per_document = triage.groupBy("document_id").agg(empty)
    joined = page_counts.join(per_document, "document_id", "left")
    none = F.coalesce("empty_pages", F.lit(0))
    return joined.select(
        "document_id", "page_count", none.alias("empty_pages"),
        F.when((F.lit(False) if max_pages is None else F.col("page_count") > max_pages) | (none > 0), "partial").otherwise("parsed").alias("parse_status"))


def new_spans(spans: DataFrame, existing: DataFrame) -> DataFrame:
    """Spans not stored yet, one per (document, text hash, page, start)."""
    key = ["document_id", "text_sha256", "page", "char_start"]
    return spans.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def pack_evidence(
    spans: DataFrame, documents: DataFrame | None = None, *, target: int = settings.PACK_TARGET,
    span_chars: int = settings.PACK_SPAN_CHARS, total_chars: int = settings.PACK_TOTAL_CHARS,
) -> DataFrame:
    """The evidence an analysis is given: evenly spread spans of each version within a character budget.

    ``spans``: version_id, span_id, page, char_start, text, text_sha256. The stride runs over all spans of a
    version, numbered chunk by chunk, so its end can be cited like its beginning. With ``documents`` (document_id, parse_status)
    only spans of parsed and partly parsed documents count. A span counts with at most ``span_chars`` towards the budget; its text stays whole.
    """
    if documents is not None:
        readable = documents.filter(F.col("parse_status").isin("parsed", "partial")).select("document_id")
        spans = spans.join(readable, "document_id", "left_semi")
    order = [F.col("page"), F.col("char_start"), F.col("span_id")]
    sizes = spans.groupBy("version_id").agg(F.greatest(F.lit(1), F.floor(F.count("*") / target)).alias("_stride"))
    whole = Window.partitionBy("version_id")
    placed = sum_before(spans, ["version_id"], "page", F.lit(1), "place", ties=order[1:], chunk=PAGES_PER_CHUNK).withColumn("place", F.col("place") + 1)
    chosen = placed.join(sizes, "version_id").filter((F.col("place") - 1) % F.col("_stride") == 0).drop("_stride")
    running = whole.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    kept = chosen.withColumn("characters", F.sum(F.least(F.length("text"), F.lit(span_chars))).over(running)).withColumn(
        "slot", F.row_number().over(whole.orderBy("place")))
    return kept.filter((F.col("characters") <= total_chars) & (F.col("slot") <= target))


def evidence_fingerprint(spans: DataFrame, *, digits: int = 2) -> DataFrame:
    """(version_id, evidence_fingerprint): hash of the version id and its span hashes in id order.

    Every version is digested in chunks first, by the leading digits of the (hexadecimal) span id, whose order is
    the id order; so no row holds all hashes of a large one, and one more span never changes the scheme.
    """
    def joined(item: str, by: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), F.col(item).alias("v"))))
        return F.array_join(F.transform(pairs, lambda p: p["v"]), "|")

    chunks = spans.groupBy("version_id", F.substring("span_id", 1, digits).alias("chunk")).agg(joined("text_sha256", "span_id").alias("_hashes"))
    parts = chunks.withColumn("_part", F.sha2("_hashes", 256))
    return parts.groupBy("version_id").agg(joined("_part", "chunk").alias("_j")).select(
        "version_id", F.sha2(F.concat_ws("|", F.col("version_id").cast("string"), "_j"), 256).alias("evidence_fingerprint"))


def processing_totals(attempts: DataFrame) -> DataFrame:
    """Requested, succeeded, failed and quarantined counts of a processing run."""
    def count(status: str) -> Column:
        return F.count_if(F.col("status") == status).alias(status)

    return attempts.agg(F.count("*").alias("requested"), count("succeeded"), count("failed"), count("quarantined"))
