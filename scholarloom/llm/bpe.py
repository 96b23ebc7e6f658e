"""Byte-level BPE by a hierarchical-bitmap rank queue, and decoding.

A pre-token is a linked list of byte pieces. Every adjacent pair whose join is in the vocabulary waits in the bucket of its
rank, as the position of its left piece; three levels of 64-bit words mark the buckets in use, so find-first-set gives the
lowest rank in three steps. Entries whose pair has changed since are skipped. Short pre-tokens share one queue and are
merged a bucket at a time; long ones have a queue of their own, in which each merge costs a constant number of queue
steps, so a pre-token of a million bytes takes as many steps as a million short ones.

- Null and empty texts: no ids, empty decoded bytes. Special tokens are ordinary text.
- Rows are independent: repeated rows, null ids and extra columns change nothing.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarloom.llm.common import small_batches, texts

CACHED, PAIRS = 300_000, 400_000
SHORT, TOGETHER = 64, 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes and its rank, one a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class RankQueue:
    """Positions by rank; ``pop`` gives the leftmost position of the lowest rank."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.middle: dict[int, int] = {}
        self.top = 0

    def mark(self, rank: int) -> None:
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.middle[b] = self.middle.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self.mark(rank)
        else:
            heappush(bucket, position)

    def lowest(self) -> int:
        """The lowest rank in use, or -1."""
        if not self.top:
            return -1
        b = (self.top & -self.top).bit_length() - 1
        word = self.middle[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = self.low[a]
        return a << 6 | (word & -word).bit_length() - 1

    def drop(self, rank: int) -> None:
        del self.buckets[rank]
        a, b = rank >> 6, rank >> 12
        self.low[a] &= ~(1 << (rank & 63))
        if not self.low[a]:
            self.middle[b] &= ~(1 << (a & 63))
            if not self.middle[b]:
                self.top &= ~(1 << b)


def merged(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    if (whole := ranks.get(token)) is not None:
        return [whole]
    n = len(token)
    end = list(range(1, n + 1))  # of the piece that begins here
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    waits = [-1] * n  # rank under which the pair that begins here waits
    queue, get = RankQueue(), ranks.get
    for p in range(n - 1):
        if (rank := get(token[p:p + 2])) is not None:
            waits[p] = rank
            bucket = queue.buckets.get(rank)
            if bucket is None:
                queue.push(rank, p)
            else:
                bucket.append(p)  # positions rise, so the bucket stays a heap
    while (rank := queue.lowest()) >= 0:
        bucket, lower = queue.buckets[rank], False
        while bucket and not lower:
            p = heappop(bucket)
            if waits[p] != rank:
                continue  # stale
            right = after[p]
            end[p] = end[right]
            after[p] = after[right]
            waits[right] = waits[p] = -1
            if after[p] < n:
                before[after[p]] = p
                pair = get(token[p:end[after[p]]])
                if pair is not None:
                    waits[p] = pair
                    queue.push(pair, p)
                    lower = pair < rank
            left = before[p]
            if left >= 0:
                pair = get(token[left:end[p]])
                waits[left] = -1 if pair is None else pair
                if pair is not None:
                    queue.push(pair, left)
                    lower = lower or pair < rank
        if not bucket:
            queue.drop(rank)
    ids, p = [], 0
    while p < n:
        ids.append(ranks[token[p:end[p]]])
        p = after[p]
    return ids


class PairRanks(dict):
    """Rank of the join of two tokens, by ``left << 32 | right``; -1 where the vocabulary has none."""

    def __init__(self, ranks: dict[bytes, int], tokens: dict[int, bytes]) -> None:
        super().__init__()
        self.ranks, self.tokens = ranks, tokens

    def __missing__(self, key: int) -> int:
        if len(self) >= PAIRS:
            self.clear()
        found = self[key] = self.ranks.get(self.tokens[key >> 32] + self.tokens[key & 0xFFFF_FFFF], -1)
        return found


def merged_together(words: list[bytes], ranks: dict[bytes, int], pairs: PairRanks) -> list[bytes]:
    """Ids of many short pre-tokens as little-endian bytes: one queue and one linked list hold all of them.

    A bucket's positions are merged as arrays, at each visit the leftmost of every pre-token only, so each
    pre-token sees the same merges in the same order as on its own.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    data, first = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
    n, own = len(data), np.repeat(np.arange(len(words)), sizes)
    ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)[data]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[first + sizes - 1] = before[first] = -1
    waits = np.full(n, -1, np.int64)
    queue = RankQueue()
    buckets: dict[int, list[np.ndarray]] = queue.buckets

    def push(at: np.ndarray, found: np.ndarray) -> None:
        waits[at] = found
        at, found = at[found >= 0], found[found >= 0]
        if not len(at):
            return
        order = np.argsort(found, kind="stable")
        at, found = at[order], found[order]
        cuts = np.flatnonzero(np.diff(found, prepend=-1)).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(at)], strict=True):
            rank = int(found[lo])
            if rank in buckets:
                buckets[rank].append(at[lo:hi])
            else:
                buckets[rank] = [at[lo:hi]]
                queue.mark(rank)

    def joins(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (ids[left] << 32 | ids[right]).tolist()
        return np.fromiter((pairs[k] for k in keys), np.int64, len(keys))

    start = np.flatnonzero(after >= 0)
    push(start, joins(start, after[start]))
    while (rank := queue.lowest()) >= 0:
        held = buckets[rank]
        at = held[0] if len(held) == 1 else np.sort(np.concatenate(held))
        at = at[waits[at] == rank]  # the others are stale
        if len(at) > 1:
            lead = np.diff(own[at], prepend=-1) != 0
            rest, at = at[~lead], at[lead]
        else:
            rest = at[:0]
        if len(rest):
            buckets[rank] = [rest]
        else:
            queue.drop(rank)
        if not len(at):
            continue
        right = after[at]
        following = after[right]
        ids[at], after[at] = rank, following
        waits[right] = waits[at] = -1
        ids[right] = -1
        more = following >= 0
        before[following[more]] = at[more]
        left = before[at]
        less = left >= 0
        push(np.concatenate([left[less], at[more]]), joins(np.concatenate([left[less], at[more]]), np.concatenate([at[less], following[more]])))
    kept = ids >= 0
    whole, stops = ids[kept].astype("<u4").tobytes(), np.cumsum(np.bincount(own[kept], minlength=len(words))) * 4
    return [whole[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]


class Codec:
    """Encoder and decoder of one vocabulary; made once in each worker.

    Ids of short pre-tokens are kept: the ``CACHED`` latest, and as many before them.
    """

    made: dict[str, Codec] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.tokens = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.pairs = PairRanks(ranks, self.tokens)
        self.latest: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of all of ``words``."""
        known = {}
        for word in words:
            if (found := self.latest.get(word) or self.older.get(word)) is not None:
                known[word] = found
        asked = [w for w in words if w not in known]
        raw = [w.encode() for w in asked]
        short = [k for k, r in enumerate(raw) if len(r) <= SHORT]
        for k, r in enumerate(raw):
            if len(r) > SHORT:
                known[asked[k]] = np.array(merged(r, self.ranks), "<u4").tobytes()
        if short:
            for k, found in zip(short, merged_together([raw[k] for k in short], self.ranks, self.pairs), strict=True):
                known[asked[k]] = self.latest[asked[k]] = found
        if len(self.latest) >= CACHED:
            self.older, self.latest = self.latest, {}
        return known

    def encode_all(self, whole: list[bytes]) -> Iterator[bytes]:
        """Ids of every text; the texts' pre-tokens are learnt together, some MB of text at a time."""
        lo = 0
        while lo < len(whole):
            hi, size = lo, 0
            while hi < len(whole) and (hi == lo or size + len(whole[hi]) <= TOGETHER):
                size += len(whole[hi])
                hi += 1
            pieces = [self.split(text.decode()) for text in whole[lo:hi]]
            ids = self.learn(set().union(*pieces))
            for own in pieces:
                yield b"".join(map(ids.__getitem__, own))
            lo = hi

    def encode(self, text: bytes) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes | np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist() if isinstance(ids, bytes) else ids.tolist()))


def _codec(vocabulary) -> Codec:
    ranks, pattern, name = vocabulary.value
    if name not in Codec.made:
        Codec.made.clear()
        Codec.made[name] = Codec(ranks, pattern)
    return Codec.made[name]


def share_vocabulary(spark: SparkSession, path: str, pattern: str):
    """Broadcast of the rank file, which is of fixed size (a few MB at most) whatever the data."""
    ranks = read_ranks(path)
    name = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    return spark.sparkContext.broadcast((ranks, pattern, name))


def encoded(docs: DataFrame, path: str, pattern: str, into: str = "ids") -> DataFrame:
    """``docs`` with the ids of every whole text as an array of integers."""
    small_batches(docs.sparkSession)
    vocabulary = share_vocabulary(docs.sparkSession, path, pattern)

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        codec = _codec(vocabulary)
        found = [np.frombuffer(ids, "<i4") for ids in codec.encode_all(list(texts(column)))]
        return pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32), np.concatenate([*found, np.zeros(0, np.int32)]))

    return docs.withColumn(into, ids(F.col("text").cast("string")))


def decoded(frame: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``frame`` with the bytes that the ids stand for; null ids are no ids. An id outside the vocabulary is an error."""
    vocabulary = share_vocabulary(frame.sparkSession, path, pattern)

    @F.arrow_udf("binary")
    def whole(column: pa.Array) -> pa.Array:
        codec = _codec(vocabulary)
        return pa.array([codec.decode(np.asarray(row.values, np.int64)) if row.is_valid else b"" for row in column], pa.binary())

    return frame.withColumn(into, whole(ids))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids (little-endian, 32 bits) and of the bytes decoded from them.

    Encoding and decoding run in one pass, so that neither the ids nor the decoded bytes leave the worker.
    """
    small_batches(docs.sparkSession)
    vocabulary = share_vocabulary(docs.sparkSession, path, pattern)

    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def digests(column: pa.Array) -> pa.Array:
        codec, rows = _codec(vocabulary), []
        for ids in codec.encode_all(list(texts(column))):
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
        kinds = (pa.int64(), pa.string(), pa.string())
        parts = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.StructArray.from_arrays(parts, names=["n_tokens", "ids_sha256", "decoded_sha256"])

    found = docs.select("doc_id", digests(F.col("text").cast("string")).alias("d"))
    return found.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")
