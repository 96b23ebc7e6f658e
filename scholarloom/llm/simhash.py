"""SimHash near-duplicates: pigeonhole blocks, an equality join on blocks, Hamming distance checked.

A 64-bit fingerprint is cut into six blocks. Fingerprints that differ in three bits or fewer agree on three whole
blocks at least, so the twenty choices of three blocks are twenty keys of 31 to 33 bits, and every close pair shares one.
Equal fingerprints are one node from the start. Within a bucket no pairs are listed: a walk over the fingerprints
not yet reached gives one link for each of them. Buckets above ``TILE`` fingerprints are dealt out as pairs of tiles
to many tasks, each of at most ``2 * TILE`` fingerprints, so no link is lost and no task holds a whole bucket.

- Null or empty text, or blanks only: fingerprint zero, linked like any other.
- Null doc_id: such rows get a fingerprint and a component; the component's id is the smallest id that is not null, or null.
- Repeated rows: one row each, of one component. Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarloom.llm.common import columns, document_id, integers, real_id, runs, small_batches, stored, texts, unused
from scholarloom.llm.components import component_of

WORDS, SEED, DISTANCE = 3, 42, 3
EDGES = (0, 11, 22, 33, 44, 54, 64)
TILE = 4_096
AT_ONCE = 100_000


def signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


MASKS = [signed(sum((2**b - 1) ^ (2**a - 1) for a, b in chosen)) for chosen in combinations(list(zip(EDGES[:-1], EDGES[1:], strict=True)), 3)]


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included; of the whole sequence when it is shorter."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, sizes = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts, digest = ends - sizes, xxhash.xxh64_intdigest
    if len(found) > words:
        starts, ends = starts[:1 - words], ends[words - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(text: bytes, words: int = WORDS) -> int:
    hashes = shingle_hashes(text, words)
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), AT_ONCE):
        bits = np.unpackbits(hashes[lo:lo + AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def _fingerprints(column: pa.Array) -> pa.Array:
    return pa.array([signed(fingerprint(text)) for text in texts(column)], pa.int64())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed integer."""
    small_batches(docs.sparkSession)
    return docs.select(document_id().alias("doc_id"), _fingerprints(F.col("text").cast("string")).alias("fp"))


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def forest(values: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """One link for each value reached from another over steps of at most ``distance`` bits."""
    links, waiting, left = [], [], values
    while len(left) or waiting:
        if not waiting:
            waiting, left = [int(left[0])], left[1:]
        here = waiting.pop()
        close = np.bitwise_count((left ^ np.int64(here)).view(np.uint64)) <= distance
        if close.any():
            reached = left[close].tolist()
            links += [(here, x) for x in reached]
            waiting += reached
            left = left[~close]
    return links


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within every bucket of one sorted range; buckets of two are compared in one go."""
    held: pa.Table | None = None
    for batch in _with_end(batches):
        table = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if table is None or not table.num_rows:
            continue
        keys = [integers(table.column(n).combine_chunks()) for n in ("place", "key", "low", "high")]
        bounds, fps = runs(keys), integers(table.column("fp").combine_chunks())
        whole = len(bounds) - 1 if batch is None else len(bounds) - 2
        held = None if batch is None else table.slice(int(bounds[whole]))
        sizes = np.diff(bounds[:whole + 1])
        two = bounds[:whole][sizes == 2]
        near = two[np.bitwise_count((fps[two] ^ fps[two + 1]).view(np.uint64)) <= DISTANCE]
        links = [np.stack([fps[near], fps[near + 1]], axis=1)]
        for k in np.flatnonzero(sizes > 2).tolist():
            if found := forest(fps[bounds[k]:bounds[k + 1]]):
                links.append(np.array(found, np.int64))
        pairs = np.concatenate(links)
        yield columns(LINKS, a=pairs[:, 0], b=pairs[:, 1])


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def close_links(nodes: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints of ``nodes`` (column fp, each once) that connect all close ones."""
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in MASKS])).alias("place", "key"))
    shared = keyed.groupBy("place", "key").count().where(F.col("count") > 1)
    tiles = F.ceil(F.col("count") / TILE).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    dealt = keyed.join(shared, ["place", "key"]).withColumn("tiles", tiles).withColumn("own", own).select(
        "place", "key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    order = ["place", "key", "low", "high"]
    tiled = dealt.select("place", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    return tiled.repartition(*order).sortWithinPartitions(*order).mapInArrow(_bucket_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): every row with its fingerprint and the smallest doc_id reachable over close fingerprints."""
    prints = stored(fingerprints(docs), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = component_of(close_links(nodes.select("fp")))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row of the smallest doc_id of every group, of several such rows that of the smallest text hash; one row a group. Columns as given."""
    small_batches(docs.sparkSession)
    text, (doc, key) = F.col("text").cast("string"), unused(docs, "llm_doc", "llm_key")
    prints = stored(docs.select(document_id().alias("doc_id"), F.xxhash64(text).alias("row_key"), _fingerprints(text).alias("fp")), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "row_key")).alias("least"))
    roots = component_of(close_links(nodes.select("fp")))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(F.coalesce("root", "fp").alias("root"), "least")
    chosen = placed.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias(doc), F.col("least.row_key").alias(key))
    own = docs.withColumns({doc: document_id(), key: F.xxhash64(text)})
    return own.join(chosen, [doc, key], "left_semi").dropDuplicates([doc, key]).select(*docs.columns)
