"""Quality rules in DataFrame functions only: text measures, and lines that too many documents of a host share.

Measures are worked out within a row by array functions, in n log n at most. The line rule hashes normalised lines, counts the
distinct documents of every line per host, takes away lines above the limit, and rejects documents of which too little is left.
A line is above the limit when more than ``least_docs`` documents of the host hold it and these are more than ``share`` of the host's documents or
more than ``many``: the low floor and the share judge small hosts too, the number alone is enough on large ones.

- Null text: no words; such a document fails the base rule. Empty text likewise.
- Null host: one host of its own. Repeated rows of one doc_id count once for a line, and each gets its row.
- A null doc_id counts as one document. Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarloom.llm.common import document_id, stored, unused

BLANKS = r"[\x20\x09-\x0D]+"
TRIMMED = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20  # words; percent
LEAST_DOCS, SHARE, MANY, LEFT = 2, 0.05, 100, 0.5


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """Words between blanks. Texts whose only blanks are spaces and line ends, nearly all, are split without a regular expression."""
    rare = F.lit(False)
    for blank in "\t\x0b\x0c\r":
        rare = rare | F.contains(text, F.lit(blank))
    return F.array_remove(F.when(rare, F.split(text, BLANKS)).otherwise(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")), "")


def window_hashes(words: Column, window: int) -> Column:
    """64-bit hash of every run of ``window`` words, from hashes of shorter runs: arrays are walked side by side, never by index."""
    def joined(left: Column, right: Column, by: int) -> Column:
        """Hash of ``left`` at each place with ``right`` at ``by`` places on."""
        n = F.size(right) - by
        return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(by + 1), n), lambda a, b: F.xxhash64(a, b))

    def grow(ones: Column, run: Column, size: int) -> Column:
        if size == window:
            return run
        if 2 * size <= window:
            return bound(joined(run, run, size), lambda longer: grow(ones, longer, 2 * size))
        return bound(joined(run, ones, size), lambda longer: grow(ones, longer, size + 1))

    return bound(F.transform(words, lambda word: F.xxhash64(word)), lambda ones: grow(ones, ones, 1))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words within a window of ``window`` words that occurs twice or more in ``words``, the first occurrence included.

    Windows are 64-bit hashes of their words. Most texts repeat none, which one pass over a hash set tells. Else (hash, place) pairs are
    sorted, the places of repeated hashes are sorted, and each covers the words up to the next place or to its own end.
    """
    def covered(places: Column) -> Column:
        def own(place: Column, k: Column) -> Column:
            return F.least(F.lit(window), F.coalesce(F.get(places, k + 1) - place, F.lit(window))).cast("long")
        return F.aggregate(F.transform(places, own), F.lit(0).cast("long"), lambda a, b: a + b)

    def repeated(pairs: Column) -> Column:
        def twice(pair: Column, k: Column) -> Column:
            return F.coalesce(F.get(pairs, k - 1)["h"] == pair["h"], F.lit(False)) | F.coalesce(F.get(pairs, k + 1)["h"] == pair["h"], F.lit(False))
        return bound(F.array_sort(F.transform(F.filter(pairs, twice), lambda p: p["i"])), covered)

    def told(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), bound(pairs, repeated)).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(bound(window_hashes(words, window), told))


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, any others) with the base measures and ``base_failed``; the text is left out."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rest = [c for c in docs.columns if c != "text"]
    cut = docs.select(*rest, text.alias("text"), words_of(text).alias("words"))
    filled = F.filter(F.split("text", "\n"), lambda line: F.length(F.btrim(line, F.lit(TRIMMED))) > 0)
    told = cut.select(
        *rest, F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        bound(filled, lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")).alias("n_dup_lines"),
        bound(F.col("words"), lambda words: repeat_words(words)).alias("n_repeat_words"))
    return told.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def host_of(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit(""))


def marked_lines(docs: DataFrame, host: str = "source", least_docs: int = LEAST_DOCS, share: float = SHARE, many: int = MANY) -> DataFrame:
    """(doc_id, host, line, size, places, common): every different line of a document, its characters, and whether it is above the host's limit (else null).

    ``places``: (row_key, pos) of the line in the rows of the document, the first line being 0. A query that does not read them does not gather them.
    """
    own = docs.select(document_id().alias("doc_id"), F.xxhash64("text").alias("row_key"), host_of(host).alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    normal = F.transform(F.split("text", "\n"), lambda line, pos: F.struct(F.lower(F.btrim(line, F.lit(TRIMMED))).alias("line"), pos.alias("pos")))
    lines = own.select("doc_id", "row_key", "host", F.explode(F.transform(F.filter(normal, lambda x: x["line"] != ""), lambda x: F.struct(F.xxhash64(x["line"]).alias("line"), F.length(x["line"]).alias("size"), x["pos"].alias("pos")))).alias("l"))
    lines = lines.select("doc_id", "row_key", "host", "l.line", "l.size", "l.pos").groupBy("host", "line", "doc_id").agg(
        F.sum("size").alias("size"), F.collect_set(F.struct("row_key", "pos")).alias("places"))
    hosts = own.groupBy("host").agg(F.count_distinct("doc_id").alias("docs"))
    common = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("holders")).where(F.col("holders") > least_docs)
    common = common.join(hosts, "host").where((F.col("holders") > share * F.col("docs")) | (F.col("holders") > many)).select("host", "line", F.lit(True).alias("common"))
    return lines.join(common, ["host", "line"], "left")


def without_common_lines(docs: DataFrame, host: str = "source", least_docs: int = LEAST_DOCS, share: float = SHARE, many: int = MANY) -> DataFrame:
    """``docs`` whose ``text`` (and ``n_chars``) is without the lines above the host's limit; columns as given."""
    return _cut(docs, host, marked_lines(docs, host, least_docs, share, many))


def _cut(docs: DataFrame, host: str, marked: DataFrame) -> DataFrame:
    doc, place, key, listed = unused(docs, "llm_doc", "llm_host", "llm_key", "llm_gone")
    gone = marked.where("common").select("doc_id", "host", F.explode("places").alias("p")).groupBy("doc_id", "host", "p.row_key").agg(F.collect_list("p.pos").alias(listed))
    gone = gone.select(F.col("doc_id").alias(doc), F.col("host").alias(place), F.col("row_key").alias(key), listed)
    own = docs.withColumns({doc: document_id(), place: host_of(host), key: F.xxhash64("text")})
    lines = F.split(F.col("text"), "\n")

    def left(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(listed))
        return F.array_join(F.transform(places, lambda k: F.get(lines, k)), "\n")

    cut = own.join(gone, [doc, place, key], "left").withColumn("text", F.when(F.col(listed).isNull(), F.col("text")).otherwise(bound(lines, left)))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(listed).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def kept_texts(docs: DataFrame, host: str = "source", least_docs: int = LEAST_DOCS, share: float = SHARE, left: float = LEFT, many: int = MANY) -> DataFrame:
    """``without_common_lines`` of the documents that are not depleted; columns as given. One table of marked lines settles both."""
    marked = stored(marked_lines(docs, host, least_docs, share, many), "marked-lines")
    (doc,) = unused(docs, "llm_doc")
    gone = depleted_of(marked, left).select(F.col("doc_id").alias(doc))
    return _cut(docs, host, marked).withColumn(doc, document_id()).join(gone, doc, "left_anti").select(*docs.columns)


def depleted(docs: DataFrame, host: str = "source", least_docs: int = LEAST_DOCS, share: float = SHARE, left: float = LEFT, many: int = MANY) -> DataFrame:
    """Ids of documents of whose characters in lines less than ``left`` is outside lines above the host's limit."""
    return depleted_of(marked_lines(docs, host, least_docs, share, many), left)


def depleted_of(marked: DataFrame, left: float = LEFT) -> DataFrame:
    kept = F.when(F.col("common").isNull(), F.col("size")).otherwise(0)
    return marked.groupBy("doc_id").agg(F.sum("size").alias("whole"), F.sum(kept).alias("rest")).where(
        F.col("rest") < left * F.col("whole")).select("doc_id")


def judged(docs: DataFrame, host: str = "source") -> DataFrame:
    """Per document: the base measures, ``base_failed``, and ``kept``: neither that nor depleted."""
    told = measures(docs.select("doc_id", document_id().alias("llm_doc"), "text"))
    gone = depleted(docs, host).select(F.col("doc_id").alias("llm_doc"), F.lit(True).alias("gone"))
    return told.join(gone, "llm_doc", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("gone").isNull()).alias("kept"))
