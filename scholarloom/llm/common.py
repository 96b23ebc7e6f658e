"""What the operators of this package share: stored tables, Arrow columns as byte arrays, word and hash arrays.

Row identity: an operator that returns a decision to the text keys it by ``(doc_id, row_key)``, where
``row_key`` is the XXH64 of the text. Rows that repeat both are one text of one document and get the same decision.
A null ``doc_id`` is one document that comes after all others; ids are held as integers with ``NO_ID`` for null.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarloom.session import shared_dir

NO_ID = 2**63 - 1
BATCH_BYTES = 4_000_000
SLICE_BYTES = 1_000_000
LONG_WORD = 4_096

#: Byte classes. All bytes of characters outside ASCII are from 0x80 up, so word classes can be told by the byte.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACE
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
BLANKS = b" \t\n\x0b\x0c\r"

_BYTE_VALUES = np.random.default_rng(20_240_101).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E37_79B9_7F4A_7C15)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(LONG_WORD, _BASE)]), dtype=np.uint64)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, so that a worker holds a few MB of text whatever the length of the rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` as Parquet in the shared folder and read it back: lineage is cut, and lost executors lose nothing."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def unused(frame: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``frame`` does not have, whatever the case."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def document_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def real_id(name: str) -> Column:
    """The id as given: ``NO_ID`` is null again."""
    return F.when(F.col(name) != NO_ID, F.col(name))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, text); other columns are left in the scan."""
    small_batches(docs.sparkSession)
    return docs.select(document_id().alias("doc_id"), F.xxhash64("text").alias("row_key"), F.col("text").cast("string").alias("text"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values behind each other, and where each begins (one more entry than values). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return values[offsets[0]:offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> Iterator[bytes]:
    data, offsets = utf8(column)
    whole = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield whole[a:b]


def integers(column: pa.Array) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False), np.int64)


def split_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte range of every word, and the number of words before each value.

    A word is a longest run of bytes of the class ``inside`` within one value.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    member = inside[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = member[:-1]
    after[:-1] = member[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58_476D_1CE4_E5B9)
    return values ^ (values >> np.uint64(29))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word: a polynomial of its bytes, worked out over slices of the words."""
    out, lengths = np.empty(len(starts), np.uint64), ends - starts
    long = np.flatnonzero(lengths > LONG_WORD)
    short = np.where(lengths > LONG_WORD, 1, lengths)
    cuts = np.searchsorted(np.cumsum(short), np.arange(0, int(short.sum()) + SLICE_BYTES, SLICE_BYTES)) if len(short) else np.zeros(1, np.int64)
    cuts = np.unique(np.append(cuts, len(starts)))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        size = short[lo:hi]
        at = np.cumsum(size) - size
        within = np.arange(int(size.sum())) - np.repeat(at, size)
        values = _BYTE_VALUES[data[np.repeat(starts[lo:hi], size) + within]]
        values *= _POWERS[within]
        out[lo:hi] = np.add.reduceat(values, at)
    for k in long.tolist():
        out[k] = xxhash.xxh64_intdigest(data[starts[k]:ends[k]].tobytes())
    return mixed(out + lengths.astype(np.uint64))


def runs(sorted_keys: list[np.ndarray]) -> np.ndarray:
    """Where each run of equal keys begins, and the end as last entry."""
    n = len(sorted_keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return np.append(np.flatnonzero(new), n)


def columns(schema: pa.Schema, **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) for f in schema], schema=schema)
