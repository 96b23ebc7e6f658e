"""Substring deduplication by super-k-mers.

The minimiser of a window of ``WINDOW`` words is the ``MMER`` words within it whose hash is smallest, the leftmost on a tie.
Consecutive windows of a text mostly share it; together they are one run of words, a super-k-mer, that travels as one packed
string to the bucket of the minimiser. Equal windows have equal minimisers, so a bucket sees all copies of its windows;
there they are sorted, and every window's smallest document is known exactly.

Before anything travels, each batch of a task settles what it can: a window that also starts in a smaller document of the batch
is decided, and only the batch's smallest document sends it. A passage in a third of all documents thus reaches its
bucket once per batch, not once per document. A minimiser that many batches hold makes its bucket grow with the corpus all the same: the load of the buckets is
estimated on one document in ``ESTIMATED``, and a bucket of more than ``SPLIT_BYTES`` is dealt further by the hash of the whole window. Estimates
only decide where windows meet; equal windows always do.

- Null or empty texts, and texts under ``WINDOW`` words: nothing is removed.
- Rows that repeat a doc_id are one document: none of them is a copy of another. They are told apart by the 64-bit hash of the text.
- A null doc_id comes after all ids. Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarloom.llm.common import NOT_SPACE, columns, integers, keyed, mixed, real_id, runs, split_words, texts, utf8, word_hashes

WINDOW, MMER = 13, 3
BUCKETS_PER_PARTITION = 4
SPLIT_BYTES, ESTIMATED = 64_000_000, 64
SETTLED_BYTES = 2_000_000
TRAVELLING = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("about", pa.binary()), ("packed", pa.binary())])
TRAVELLING_DDL = "bucket long, doc_id long, row_key long, about binary, packed binary"
RANGES = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("ranges", pa.binary())])
RANGES_DDL = "doc_id long, row_key long, ranges binary"
_WEIGHTS = np.random.default_rng(7_202).integers(1, 2**63, (3, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sums(hashes: np.ndarray, size: int, weights: np.ndarray) -> np.ndarray:
    """Hash of the ``size`` words from each word on; the last ``size - 1`` places hold none."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k:k + n] * weights[k]
    return mixed(out)


class Windows:
    """The windows of a batch of texts: where they begin, their hashes, and their text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int) -> None:
        self.data = data
        self.starts, self.ends, self.first = split_words(data, offsets, NOT_SPACE)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hashes = word_hashes(data, self.starts, self.ends)
        words = np.arange(len(self.starts))
        self.at = np.flatnonzero(words + window <= self.first[self.text + 1]) if len(words) else words
        self.one = _sums(self.hashes, window, _WEIGHTS[0])[self.at]
        self.two = _sums(self.hashes, window, _WEIGHTS[1])[self.at]

    def copies(self, docs: np.ndarray) -> np.ndarray:
        """For every window: whether it also starts in a smaller document here. ``docs``: document of each text."""
        return later_copies(self.one, self.two, docs[self.text[self.at]])

    def minimisers(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place) of every window's minimiser."""
        grams = _sums(self.hashes, MMER, _WEIGHTS[2])
        best, place = grams[self.at], self.at.copy()
        for k in range(1, window - MMER + 1):
            other = grams[self.at + k]
            less = other < best
            best[less] = other[less]
            place[less] = self.at[less] + k
        return best, place


def later_copies(one: np.ndarray, two: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For every window, given by two hashes and its document: whether the same window has a smaller document."""
    later = np.zeros(len(one), bool)
    order = np.argsort(one, kind="stable")
    keys = one[order]
    same = np.zeros(len(keys), bool)
    same[1:] = keys[1:] == keys[:-1]
    same[:-1] |= same[1:]
    some = order[same]
    if len(some):
        some = some[np.lexsort((docs[some], two[some], one[some]))]
        owner = docs[some]
        bounds = runs([one[some], two[some]])
        later[some] = owner > np.repeat(owner[bounds[:-1]], np.diff(bounds))
    return later


def _stretches(at: np.ndarray, *alike: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch of consecutive places that are alike."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(at), bool)
    new[1:] = np.logical_or.reduce([at[1:] != at[:-1] + 1, *(x[1:] != x[:-1] for x in alike)])
    begin = np.flatnonzero(new)
    return begin, np.append(begin[1:], len(at)) - 1


def _planes(values: np.ndarray) -> bytes:
    """Bytes of the integers, plane by plane, which compresses far better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _from_planes(raw: bytes, kind: str, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, n).T).reshape(-1).view(kind)


def _by_text(texts_of: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(text, ranges) for every text that has some; a range is its first word and the word after it."""
    bounds = runs([texts_of])
    both = np.stack([begin, end], axis=1).astype("<i4")
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield int(texts_of[lo]), both[lo:hi].tobytes()


def _super_k_mers(w: Windows, later: np.ndarray, window: int, buckets: int, splits: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, first word, word after the last) of the stretches of windows that travel together, by bucket. ``splits``: buckets that are dealt further, and into how many."""
    best, place = w.minimisers(window)
    at, place = w.at[~later], place[~later]
    bucket = (best[~later] % np.uint64(buckets)).astype(np.int64)
    if splits:
        parts = np.ones(buckets, np.int64)
        parts[list(splits)] = list(splits.values())
        bucket += buckets * (w.two[~later] % parts[bucket].astype(np.uint64)).astype(np.int64)
    begin, end = _stretches(at, place, bucket)
    order = np.argsort(bucket[begin], kind="stable")
    return bucket[begin[order]], at[begin[order]], at[end[order]] + window


def _loaded(window: int, buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = Windows(*utf8(batch.column("text")), window)
            bucket, lo, hi = _super_k_mers(w, w.copies(integers(batch.column("doc_id"))), window, buckets, {})
            sums = np.bincount(bucket, w.ends[hi - 1] - w.starts[lo], minlength=buckets) if len(bucket) else np.zeros(buckets)
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some].astype(np.int64))], names=["bucket", "bytes"])
    return work


def _splits(docs: DataFrame, window: int, buckets: int) -> dict[int, int]:
    """Buckets of more than ``SPLIT_BYTES``, as estimated, and how many parts each is dealt into; at most as many rows as there are buckets."""
    some = keyed(docs).where(F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(ESTIMATED)) == 0)
    loads = some.mapInArrow(_loaded(window, buckets), "bucket long, bytes long").groupBy("bucket").agg((F.sum("bytes") * ESTIMATED).alias("bytes"))
    return {r.bucket: -(-r.bytes // SPLIT_BYTES) for r in loads.where(F.col("bytes") > SPLIT_BYTES).collect()}


def _cut(window: int, buckets: int, splits: dict[int, int]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            docs, keys = integers(batch.column("doc_id")), integers(batch.column("row_key"))
            w = Windows(*utf8(batch.column("text")), window)
            later = w.copies(docs)
            out: list[tuple] = []
            gone = w.at[later]
            begin, end = _stretches(gone, w.text[gone])
            of = w.text[gone[begin]]
            for text, ranges in _by_text(of, gone[begin] - w.first[of], gone[end] + window - w.first[of]):
                out.append((int(docs[text]) % buckets, int(docs[text]), int(keys[text]), ranges, None))
            bucket, lo, hi = _super_k_mers(w, later, window, buckets, splits)
            if len(lo):
                sizes = w.ends - w.starts
                spaced = np.cumsum(sizes + 1) - (sizes + 1)  # where each word begins once all are one space apart
                joined = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
                member = np.repeat(w.starts - spaced, sizes + 1) + np.arange(len(joined))
                inside = np.ones(len(joined), bool)
                inside[spaced + sizes] = False
                joined[inside] = w.data[member[inside]]
                whole, last = joined.tobytes(), spaced[hi - 1] + sizes[hi - 1]
                packed = [whole[a:b] for a, b in zip(spaced[lo].tolist(), last.tolist(), strict=True)]
                of = w.text[lo]
                bounds = runs([bucket])
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    about = b"".join([_planes(docs[of[a:b]]), _planes(keys[of[a:b]]), _planes((lo[a:b] - w.first[of[a:b]]).astype(np.int32))])
                    out.append((int(bucket[a]), b - a, 0, squeeze(about), squeeze(b"\n".join(packed[a:b]))))
            if out:
                yield columns(TRAVELLING, **{f.name: [r[k] for r in out] for k, f in enumerate(TRAVELLING)})
    return work


def _settle(blobs: list[tuple[int, bytes, bytes]], window: int) -> Iterator[tuple[int, int, bytes]]:
    """Ranges of the windows of one bucket that also start in a smaller document. Strings are opened ``SETTLED_BYTES`` at a time; only the windows' hashes and places are held together."""
    open_up = zstandard.ZstdDecompressor().decompress
    docs, keys, ones, twos, texts_of, places = [], [], [], [], [], []
    packed, first, held, before = [], [], 0, 0

    def taken_in() -> None:
        nonlocal packed, first, held, before
        data = np.frombuffer(b"\n".join(packed), np.uint8)
        offsets = np.concatenate([[0], np.flatnonzero(data == 10) + 1, [len(data)]])
        w = Windows(data, offsets, window)
        of = w.text[w.at]
        ones.append(w.one)
        twos.append(w.two)
        texts_of.append((of + before).astype(np.int32))
        places.append((np.concatenate(first)[of] + w.at - w.first[of]).astype(np.int32))
        packed, first, held, before = [], [], 0, before + len(offsets) - 1

    for n, about, strings in blobs:
        raw = open_up(about)
        docs.append(_from_planes(raw[:8 * n], "<i8", n))
        keys.append(_from_planes(raw[8 * n:16 * n], "<i8", n))
        first.append(_from_planes(raw[16 * n:], "<i4", n))
        packed.append(open_up(strings))
        held += len(packed[-1])
        if held >= SETTLED_BYTES:
            taken_in()
    if packed:
        taken_in()
    doc, key, of, at = np.concatenate(docs), np.concatenate(keys), np.concatenate(texts_of), np.concatenate(places)
    gone = np.flatnonzero(later_copies(np.concatenate(ones), np.concatenate(twos), doc[of]))
    if len(gone):
        of, at = of[gone], at[gone].astype(np.int64)
        lo, hi = _stretches(at, of)
        for text, ranges in _by_text(of[lo], at[lo], at[hi] + window):
            yield int(doc[text]), int(key[text]), ranges


def _count(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            out = []
            for b, doc, key, about, packed in zip(*(batch.column(n).to_pylist() for n in TRAVELLING.names), strict=True):
                if packed is None:
                    out.append((doc, key, about))
                    continue
                if b != bucket and held:
                    out += _settle(held, window)
                    held = []
                bucket = b
                held.append((doc, about, packed))
            if out:
                yield columns(RANGES, **{f.name: [r[k] for r in out] for k, f in enumerate(RANGES)})
        if held and (out := list(_settle(held, window))):
            yield columns(RANGES, **{f.name: [r[k] for r in out] for k, f in enumerate(RANGES)})
    return work


def repeated_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, row_key, ranges): ranges of words covered by windows that also start in a smaller document.

    ``ranges`` holds pairs of little-endian 32-bit integers, the first word and the word after the last; a text may have several rows,
    whose ranges may overlap. The number of buckets follows ``spark.sql.shuffle.partitions``, which a user sets to the size of the shuffle.
    """
    if window < MMER:
        raise ValueError(f"a window needs at least {MMER} words")
    buckets = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = keyed(docs).mapInArrow(_cut(window, buckets, _splits(docs, window, buckets)), TRAVELLING_DDL)
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count(window), RANGES_DDL)


@F.arrow_udf(T.BinaryType())
def _squeezed(text: pa.Array) -> pa.Array:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return pa.array([squeeze(t) for t in texts(text)], pa.binary())


def kept_words(text: bytes, ranges: list[bytes]) -> tuple[int, int, bytes]:
    """Words, words removed, and the words that stay, one space apart."""
    words = text.split()
    if not ranges:
        return len(words), 0, b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for pairs in ranges:
        both = np.frombuffer(pairs, "<i4")
        np.add.at(change, both[0::2], 1)
        np.add.at(change, both[1::2], -1)
    kept = np.cumsum(change[:-1]) == 0
    return len(words), len(words) - int(kept.sum()), b" ".join([words[k] for k in np.flatnonzero(kept).tolist()])


def _joined(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, squeezed, ranges): the texts travel compressed to their ranges."""
    ranges = repeated_ranges(docs, window).groupBy("doc_id", "row_key").agg(F.collect_list("ranges").alias("ranges"))
    return keyed(docs).select("doc_id", "row_key", _squeezed("text").alias("squeezed")).join(ranges, ["doc_id", "row_key"], "left")


def kept_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, words removed, SHA-256 of the words that stay."""
    @F.arrow_udf("struct<n_words: long, n_removed: long, kept_sha256: string>")
    def digests(squeezed: pa.Array, ranges: pa.Array) -> pa.Array:
        open_up, rows = zstandard.ZstdDecompressor().decompress, []
        for raw, own in zip(squeezed, ranges, strict=True):
            n, removed, kept = kept_words(open_up(raw.as_py()), own.as_py() or [])
            rows.append((n, removed, hashlib.sha256(kept).hexdigest()))
        parts = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
        return pa.StructArray.from_arrays(parts, names=["n_words", "n_removed", "kept_sha256"])

    found = _joined(docs, window).select("doc_id", digests("squeezed", "ranges").alias("d"))
    return found.select(real_id("doc_id").alias("doc_id"), "d.n_words", "d.n_removed", "d.kept_sha256")


def kept_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text): the words that stay of every document, one space apart."""
    @F.arrow_udf("string")
    def kept(squeezed: pa.Array, ranges: pa.Array) -> pa.Array:
        open_up = zstandard.ZstdDecompressor().decompress
        return pa.array([kept_words(open_up(raw.as_py()), own.as_py() or [])[2].decode() for raw, own in zip(squeezed, ranges, strict=True)], pa.string())

    return _joined(docs, window).select(real_id("doc_id").alias("doc_id"), kept("squeezed", "ranges").alias("text"))
