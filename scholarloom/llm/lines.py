"""Line deduplication: range-partitioned line hashes, sorted by document and position, streamed for first occurrences.

A line's key is the line without blanks at both ends, A-Z lower-cased. A key of at least ``MIN_CHARS`` code points that
several documents hold loses all its lines except in the smallest document holding it. The result is a compressed
bitmap of the kept lines per text; texts do not travel with the hashes.

- Null or empty text: one empty line, kept. Empty table: no rows.
- Rows that repeat a doc_id are one document: none of them is a copy of another.
- A null doc_id comes after all ids. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarloom.llm.common import BLANKS, columns, document_id, integers, keyed, runs, stored, texts, unused

MIN_CHARS = 10
LINES_AT_ONCE = 200_000
TEXT, ASKING, DROPPED, PENDING, OWNER = range(5)
ROWS = pa.schema([("kind", pa.int8()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("pos", pa.int32())])
ROWS_DDL = "kind byte, h1 long, h2 long, doc_id long, row_key long, pos int"
BITMAPS = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("bitmap", pa.binary())])


def line_key(line: bytes, least: int) -> bytes | None:
    key = line.strip(BLANKS).lower()
    if len(key) < least or not key.isascii() and len(key.decode("utf-8", "replace")) < least:
        return None
    return key


def _settle(digests: list[bytes], docs: list[int], keys: list[int], places: list[int]) -> pa.RecordBatch:
    """What can be decided here is: of each key only the lines of the smallest document met so far go on asking.

    A key that a third of all lines share thus leaves a batch once, whatever the number of its lines.
    """
    smallest: dict[bytes, int] = {}
    for digest, doc in zip(digests, docs, strict=True):
        if doc < smallest.get(digest, doc + 1):
            smallest[digest] = doc
    kinds = np.fromiter((ASKING if smallest[h] == d else DROPPED for h, d in zip(digests, docs, strict=True)), np.int8, len(docs))
    halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return columns(ROWS, kind=kinds, h1=halves[:, 0], h2=halves[:, 1], doc_id=docs, row_key=keys, pos=np.array(places, np.int32))


def _hashed(least: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, docs, keys, places = [], [], [], []
        for batch in batches:
            ids, row_keys, counts = integers(batch.column("doc_id")), integers(batch.column("row_key")), []
            for doc, row_key, text in zip(ids.tolist(), row_keys.tolist(), texts(batch.column("text")), strict=True):
                lines = text.split(b"\n")
                counts.append(len(lines))
                for place, line in enumerate(lines):
                    if (key := line_key(line, least)) is not None:
                        digests.append(xxhash.xxh3_128_digest(key))
                        docs.append(doc)
                        keys.append(row_key)
                        places.append(place)
                if len(docs) >= LINES_AT_ONCE:
                    yield _settle(digests, docs, keys, places)
                    digests, docs, keys, places = [], [], [], []
            zero = np.zeros(len(counts), np.int64)
            yield columns(ROWS, kind=np.full(len(counts), TEXT, np.int8), h1=zero, h2=zero, doc_id=ids, row_key=row_keys, pos=np.array(counts, np.int32))
        if docs:
            yield _settle(digests, docs, keys, places)
    return work


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk one sorted range. The key's first document owns it; lines of later documents are dropped.

    The range's first key may have begun in an earlier range: its rows are left pending, and the owners
    seen here of the first and of the last key are told (two rows a range).
    """
    current, owner, first = None, 0, None
    for batch in batches:
        h1, h2, docs, row_keys = (integers(batch.column(n)) for n in ("h1", "h2", "doc_id", "row_key"))
        if not len(h1):
            continue
        bounds = runs([h1, h2])
        owners = docs[bounds[:-1]].copy()
        if current == (h1[0], h2[0]):
            owners[0] = owner
        if first is None:
            first = (h1[0], h2[0])
            yield columns(ROWS, kind=[OWNER], h1=h1[:1], h2=h2[:1], doc_id=docs[:1], row_key=[0], pos=[0])
        current, owner = (h1[-1], h2[-1]), int(owners[-1])
        kinds = np.where(docs != np.repeat(owners, np.diff(bounds)), DROPPED, ASKING).astype(np.int8)
        kinds[(h1 == first[0]) & (h2 == first[1])] = PENDING
        out = np.flatnonzero(kinds != ASKING)
        yield columns(ROWS, kind=kinds[out], h1=h1[out], h2=h2[out], doc_id=docs[out], row_key=row_keys[out], pos=integers(batch.column("pos"))[out].astype(np.int32))
    if current is not None:
        yield columns(ROWS, kind=[OWNER], h1=[current[0]], h2=[current[1]], doc_id=[owner], row_key=[0], pos=[0])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, lists = integers(batch.column("n_lines")), batch.column("places")
        packed, dropped = [], []
        for n, places in zip(n_lines.tolist(), lists, strict=True):
            keep = np.ones(n, np.uint8)
            keep[np.asarray(places.values, np.int64) if len(places.values) else []] = 0
            packed.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            dropped.append(n - int(keep.sum()))
        yield columns(BITMAPS, doc_id=batch.column("doc_id"), row_key=batch.column("row_key"), n_lines=n_lines, n_dropped=dropped, bitmap=packed)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row_key, n_lines, n_dropped, bitmap) for every text; ``bitmap`` is zlib of one bit a line, 1 kept."""
    rows = stored(keyed(docs).mapInArrow(_hashed(min_chars), ROWS_DDL), "line-hashes")
    order = ["h1", "h2", "doc_id", "row_key", "pos"]
    asking = rows.where(F.col("kind") == ASKING).drop("kind")
    walked = stored(asking.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_first_occurrences, ROWS_DDL), "line-owners")
    owners = walked.where(F.col("kind") == OWNER).groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"))
    pending = walked.where(F.col("kind") == PENDING).join(owners, ["h1", "h2"]).where(F.col("doc_id") > F.col("owner"))
    place = ["doc_id", "row_key", "pos"]
    dropped = rows.where(F.col("kind") == DROPPED).select(place).unionAll(walked.where(F.col("kind") == DROPPED).select(place)).unionAll(pending.select(place))
    marked = rows.where(F.col("kind") == TEXT).select("doc_id", "row_key", F.col("pos").alias("n_lines"), F.lit(None).cast("int").alias("pos")).unionAll(
        dropped.select("doc_id", "row_key", F.lit(None).cast("int").alias("n_lines"), "pos"))
    return marked.groupBy("doc_id", "row_key").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("places")).mapInArrow(
        _bitmaps, "doc_id long, row_key long, n_lines long, n_dropped long, bitmap binary")


def kept_lines(text: bytes, bitmap: bytes) -> bytes:
    lines = text.split(b"\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines)).tolist()
    return b"\n".join([line for line, k in zip(lines, keep, strict=True) if k])


def _joined(docs: DataFrame, min_chars: int) -> tuple[DataFrame, str]:
    """``docs`` with its ``doc_id``, ``row_key``, ``n_lines``, ``n_dropped`` and ``bitmap`` as one struct, whose name is the second value."""
    doc, key, name = unused(docs, "llm_doc", "llm_key", "llm_marks")
    marks = keep_bitmaps(docs, min_chars).select(F.col("doc_id").alias(doc), F.col("row_key").alias(key), F.struct("n_lines", "n_dropped", "bitmap").alias(name))
    return docs.withColumns({doc: document_id(), key: F.xxhash64("text")}).join(marks, [doc, key]).drop(doc, key), name


@F.arrow_udf(T.StringType())
def _digest(text: pa.Array, bitmap: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(kept_lines(t, b.as_py()) if b.is_valid else t).hexdigest() for t, b in zip(texts(text), bitmap, strict=True)], pa.string())


@F.arrow_udf(T.StringType())
def _kept(text: pa.Array, bitmap: pa.Array) -> pa.Array:
    return pa.array([kept_lines(t, b.as_py()).decode() if b.is_valid else None for t, b in zip(texts(text), bitmap, strict=True)], pa.string())


def _cutting(marks: str) -> Column:
    """Null where nothing is dropped: such texts stay as they are."""
    return F.when(F.col(marks)["n_dropped"] > 0, F.col(marks)["bitmap"])


def kept_digests(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document: lines before dropping, lines dropped, SHA-256 of what stays."""
    found, marks = _joined(docs.select("doc_id", "text"), min_chars)
    return found.select("doc_id", F.col(marks)["n_lines"].alias("n_lines"), F.col(marks)["n_dropped"].alias("n_dropped"), _digest("text", _cutting(marks)).alias("kept_sha256"))


def kept_texts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the kept lines as ``text`` and their length as ``n_chars``; a text that loses nothing, or is null, stays as it is."""
    found, marks = _joined(docs, min_chars)
    (kept,) = unused(found, "llm_kept")
    cut = found.withColumn(kept, _kept("text", _cutting(marks)))
    changed = {"text": F.coalesce(kept, "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(kept).isNotNull(), F.length(kept)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.withColumns(changed).select(*docs.columns)
