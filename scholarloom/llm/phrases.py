"""Benchmark decontamination over a positional inverted index of the corpus.

The index is a table of segments of about 4 MB of text. A segment holds its terms (64-bit hashes, sorted), how often each
occurs, and the positions of all occurrences, term after term, plus where its documents begin. Nothing is left out:
every token of every document has a posting.

A query is a set of phrases. In each segment a phrase whose terms are not all present is out; otherwise the lists are
taken from the rarest term on, shifted by the term's place in the phrase, and intersected until none is left.
With ``slop`` 0 this is the exact phrase; with more, each term may stand up to ``slop`` places from its own (proximity).

Phrases reach the segments by broadcast in blocks of at most ``BLOCK_CHARS`` of item text each, so a larger query set
means more passes over the index, not a larger broadcast.

- Null or empty text: no words, no hits. Null, empty or wordless items: no phrase.
- Items with a null item_id still mark words; they are listed as ``null``. Items that repeat an id count once.
- Repeated documents and null doc_ids: one result row each. Empty tables: no documents, no rows; no items, no hits.
- Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark import TaskContext

from scholarloom.llm.common import ALNUM, LOWER, columns, document_id, integers, keyed, real_id, small_batches, split_words, stored, texts, unused, utf8, word_hashes

WINDOW = 10
BLOCK_CHARS = 4_000_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
INDEX = pa.schema([("segment", pa.int64()), ("docs", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("first", pa.list_(pa.int32())), ("terms", pa.list_(pa.int64())),
                   ("counts", pa.list_(pa.int32())), ("positions", pa.binary())])
INDEX_DDL = "segment long, docs array<long>, keys array<long>, first array<int>, terms array<long>, counts array<int>, positions binary"
FOUND = pa.schema([("segment", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_words", pa.int64()), ("spans", pa.binary()), ("items", pa.list_(pa.string()))])
FOUND_DDL = "segment long, place int, doc_id long, row_key long, n_words long, spans binary, items array<string>"


def _listed(values: list[np.ndarray], kind) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, values)]).astype(np.int32), pa.array(np.concatenate(values), kind))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        data = LOWER[data]
        starts, ends, first = split_words(data, offsets, ALNUM)
        hashes = word_hashes(data, starts, ends).view(np.int64)
        order = np.argsort(hashes, kind="stable")
        terms, at, counts = np.unique(hashes[order], return_index=True, return_counts=True)
        gaps = np.diff(order, prepend=0)  # positions rise within a term; the first of each is whole
        gaps[at] = order[at]
        yield pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), _listed([integers(batch.column("doc_id"))], pa.int64()), _listed([integers(batch.column("row_key"))], pa.int64()), _listed([first.astype(np.int32)], pa.int32()),
            _listed([terms], pa.int64()), _listed([counts.astype(np.int32)], pa.int32()), pa.array([gaps.astype("<i4").tobytes()], pa.binary())], schema=INDEX)
        number += 1


def positional_index(docs: DataFrame) -> DataFrame:
    """Postings of every token of ``docs`` (doc_id, text), stored in the shared folder."""
    small_batches(docs.sparkSession)
    return stored(keyed(docs).mapInArrow(_segments, INDEX_DDL), "postings")


class Phrases:
    """Distinct phrases of equal-length rows of term hashes (0 beyond the phrase's end) and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        held: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            text = text.lower()
            words = WORD.findall(text)
            if not words:
                continue
            data, ends = np.frombuffer(b" ".join(words), np.uint8), np.cumsum([len(w) + 1 for w in words]) - 1
            hashes = word_hashes(data, ends - np.array([len(w) for w in words]), ends).view(np.int64).tolist()
            for at in range(max(1, len(words) - window + 1)):
                held.setdefault(tuple(hashes[at:at + window]), set()).add(name)
        rows = list(held)
        self.items = [sorted(held[r]) for r in rows]
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.table = np.zeros((len(rows), window), np.int64)
        for k, row in enumerate(rows):
            self.table[k, :len(row)] = row
        self.used = np.arange(window) < self.sizes[:, None]
        self.terms, self.place = np.unique(self.table, return_inverse=True)
        self.place = self.place.reshape(self.table.shape)


def _starts(phrase: np.ndarray, at: np.ndarray, counts: np.ndarray, gaps: np.ndarray, slop: int) -> np.ndarray:
    """Token positions at which the phrase begins. ``phrase``: index of each of its terms among the segment's terms."""
    rarest = np.argsort(counts[phrase], kind="stable")
    lists: dict[int, np.ndarray] = {}

    def postings(k: int) -> np.ndarray:
        term = phrase[k]
        if term not in lists:
            lists[term] = np.cumsum(gaps[at[term]:at[term] + counts[term]])
        return lists[term]

    left = postings(rarest[0]) - rarest[0]
    for k in rarest[1:].tolist():
        if not len(left):
            break
        shifted = postings(k) - k
        near = np.searchsorted(shifted, left - slop)
        left = left[(near < len(shifted)) & (shifted[np.minimum(near, len(shifted) - 1)] <= left + slop)]
    return left


def _search(phrases, slop: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query: Phrases = phrases.value
        for batch in batches:
            for row in range(batch.num_rows):
                docs, keys, first, terms, counts = (np.asarray(batch.column(n)[row].values) for n in ("docs", "keys", "first", "terms", "counts"))
                gaps = np.frombuffer(batch.column("positions")[row].as_buffer(), "<i4").astype(np.int64)
                at = np.cumsum(counts, dtype=np.int64) - counts
                spans: list[list[int]] = [[] for _ in docs]
                items: list[set[str]] = [set() for _ in docs]
                if len(terms) and len(query.terms):
                    where = np.minimum(np.searchsorted(terms, query.terms), len(terms) - 1)
                    there = terms[where] == query.terms
                    for k in np.flatnonzero((there[query.place] | ~query.used).all(axis=1)).tolist():
                        size = int(query.sizes[k])
                        starts = _starts(where[query.place[k, :size]], at, counts, gaps, slop)
                        if len(starts):
                            owners = np.searchsorted(first, starts, side="right") - 1
                            inside = (starts >= 0) & (starts + size <= first[np.minimum(owners + 1, len(first) - 1)])
                            for start, doc in zip(starts[inside].tolist(), owners[inside].tolist(), strict=True):
                                spans[doc] += [start - int(first[doc]), size]
                                items[doc].update(query.items[k])
                yield columns(FOUND, segment=np.full(len(docs), batch.column("segment")[row].as_py()), place=np.arange(len(docs), dtype=np.int32), doc_id=docs, row_key=keys,
                              n_words=np.diff(first).astype(np.int64), spans=[np.array(s, "<i4").tobytes() for s in spans], items=[sorted(i) for i in items])
    return work


def item_blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items as (name, text) in blocks of about ``block_chars``; each block is read on its own."""
    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    size = own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = -(-size // block_chars)
    for k in range(blocks):
        part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k)
        yield [(r.name, r.text.encode()) for r in part.toLocalIterator()]


def phrase_matches(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(segment, place, doc_id, row_key, n_words, spans, items) for every document of the index.

    ``spans`` holds (first word, words) of every match as little-endian 32-bit integers; ``items`` the items matched.
    """
    spark = index.sparkSession
    found = [index.mapInArrow(_search(spark.sparkContext.broadcast(Phrases(block, window)), slop), FOUND_DDL) for block in item_blocks(items, block_chars)]
    if not found:
        return index.mapInArrow(_search(spark.sparkContext.broadcast(Phrases([], window)), slop), FOUND_DDL)
    if len(found) == 1:
        return found[0]
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionAll(part)
    joined = F.array_join(F.transform(F.collect_list("spans"), F.hex), "")
    return whole.groupBy("segment", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("row_key").alias("row_key"), F.max("n_words").alias("n_words"), F.unhex(joined).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def covered(spans: np.ndarray, n_words: int) -> int:
    """Words within at least one (first word, words) pair."""
    if not len(spans):
        return 0
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, spans[0::2], 1)
    np.add.at(change, np.minimum(spans[0::2] + spans[1::2], n_words), -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


@F.arrow_udf(T.LongType())
def _covered(spans: pa.Array, n_words: pa.Array) -> pa.Array:
    return pa.array([covered(np.frombuffer(s, "<i4").astype(np.int64), n) for s, n in zip(texts(spans), integers(n_words).tolist(), strict=True)], pa.int64())


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, words hit, items found, SHA-256 of their ids, and whether any word is hit."""
    found = phrase_matches(positional_index(docs), items, window).withColumn("n_hit", _covered("spans", "n_words"))
    return found.select(
        real_id("doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def uncontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, by_row: bool = False) -> DataFrame:
    """Rows of ``docs`` without a hit; columns as given. Rows that share a doc_id go together when one of them is hit, with ``by_row`` only those of the same text."""
    hit = phrase_matches(positional_index(docs), items, window).where(F.octet_length("spans") > 0)
    doc, key = unused(docs, "llm_doc", "llm_key")
    hit = hit.select(F.col("doc_id").alias(doc), *([F.col("row_key").alias(key)] if by_row else [])).distinct()
    own = docs.withColumns({doc: document_id(), key: F.xxhash64("text")})
    return own.join(hit, hit.columns, "left_anti").select(*docs.columns)


