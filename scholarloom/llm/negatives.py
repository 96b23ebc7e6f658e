"""Hard negatives of labelled vectors by vertical (BOND) scans.

Rows are packed into blocks that hold one array per dimension. An anchor reads a block's dimensions in descending order of its own magnitudes, a few
at a time, and adds them to partial inner products. The least and greatest of each unread dimension bound what is still to come: rows whose
bounds cannot reach the anchor's windows leave the candidate bitmap, the rest end in exact scores. A scan answers either the first
positives of the same label, or the first rows of other labels within each positive's window of scores.

Components are scaled and floored to whole numbers, so scores are exact: in single or double precision where sums are small enough for it, as Python
integers beyond. Anchors are a stated query set; they meet all rows in blocks of at most about ``ANCHOR_BYTES``, two scans of all blocks for each.
A task keeps only its best rows per anchor and window; the best of all tasks are ranked by Spark.

- Rows with a null label or vector, or with a null or non-finite component, take no part. Empty table, or no anchor: no rows.
- A null vec_id comes after all ids on ties and is returned as null; its row is an anchor only if ``is_anchor`` says so.
- Ties: smaller vec_id first. Repeated rows count as rows of their own: a copy of an anchor is another row of its label.
- Vectors of different lengths: missing components count as zero. Scores must fit 64 bits, or the job fails. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholarloom.llm.common import NO_ID, columns, integers, small_batches, stored, texts
from scholarloom.session import shared_dir

MOST_ROWS, LEAST_ROWS = 16_384, 1_024
ANCHOR_BYTES = 16_000_000
FIRST_STEP, STEP = 24, 8
BLOCK = pa.schema([("n", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary()), ("anchors", pa.binary()), ("values", pa.binary())])
BLOCK_DDL = "n int, rows binary, ids binary, labels binary, anchors binary, values binary"
ANCHOR_DDL = "anchor_row long, anchor_id long, label long, vector array<double>"
BEST = pa.schema([("anchor_row", pa.int64()), ("window", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
BEST_DDL = "anchor_row long, window long, row long, vec_id long, score long"


def _packed(scale: float, most: int):
    def block(parts: list[tuple]) -> pa.RecordBatch:
        dims = max(v.shape[1] for *_, v in parts)
        values = np.concatenate([np.pad(v, ((0, 0), (0, dims - v.shape[1]))) for *_, v in parts])
        rows, ids, labels, anchors = (np.concatenate([p[k] for p in parts]) for k in range(4))
        order = np.lexsort((rows, ids, labels))
        return columns(BLOCK, n=[len(rows)], rows=[rows[order].tobytes()], ids=[ids[order].tobytes()], labels=[labels[order].tobytes()],
                       anchors=[anchors[order].tobytes()], values=[np.ascontiguousarray(values[order].T).tobytes()])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            lists = batch.column("vector")
            offsets, flat = np.asarray(lists.offsets), np.floor(scale * np.asarray(lists.values, np.float64))
            sizes = np.diff(offsets)
            values = np.zeros((len(sizes), int(sizes.max(initial=0))))
            within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            values[np.repeat(np.arange(len(sizes)), sizes), within] = flat[offsets[0]:offsets[-1]]
            told = [integers(batch.column(name)) for name in ("row", "vec_id", "label")] + [np.asarray(batch.column("anchor").to_numpy(zero_copy_only=False), bool)]
            for lo in range(0, len(sizes), most):
                parts.append((*(t[lo:lo + most] for t in told), values[lo:lo + most]))
                held += len(parts[-1][0])
                if held >= most:
                    yield block(parts)
                    parts, held = [], 0
        if held:
            yield block(parts)
    return work


class Block:
    """Vertical block, its rows sorted by label."""

    def __init__(self, n: int, rows: bytes, ids: bytes, labels: bytes, anchors: bytes, values: bytes) -> None:
        self.rows, self.ids, self.labels = (np.frombuffer(x, np.int64) for x in (rows, ids, labels))
        self.anchors = np.frombuffer(anchors, bool)
        self.values = np.frombuffer(values, np.float64).reshape(-1, n)
        self.least, self.greatest = self.values.min(axis=1), self.values.max(axis=1)

    def of_kind(self, most: float) -> np.ndarray:
        """The values in the narrowest kind of number that adds products with components up to ``most`` exactly."""
        bound = len(self.values) * most * max(np.abs(self.least).max(initial=0), np.abs(self.greatest).max(initial=0))
        if bound < 2**24:
            return self.values.astype(np.float32)
        return self.values if bound < 2**53 else _whole(self.values)


def _whole(values: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in values.reshape(-1)], object).reshape(values.shape)


def blocks_of(batch: pa.RecordBatch) -> Iterator[Block]:
    for n, *parts in zip(batch.column("n").to_pylist(), *(texts(batch.column(name)) for name in BLOCK.names[1:]), strict=True):
        yield Block(n, *parts)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks_of(batch):
            at = np.flatnonzero(block.anchors)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.rows[at]), pa.array(block.ids[at]), pa.array(block.labels[at]), pa.array(list(block.values[:, at].T), pa.list_(pa.float64()))],
                names=["anchor_row", "anchor_id", "label", "vector"])


def survivors(anchor: np.ndarray, values: np.ndarray, least: np.ndarray, greatest: np.ndarray, possible: np.ndarray | None, judge) -> tuple[np.ndarray, np.ndarray]:
    """(places, exact scores) of the rows that stay candidates to the end.

    ``possible``: bitmap of rows to begin with, or all. ``judge(partial, below, above)`` is the bitmap of rows still open when their scores lie
    between ``partial + below`` and ``partial + above``.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    one, other = anchor * least, anchor * greatest
    below = np.append(np.cumsum(np.minimum(one, other)[order][::-1])[::-1], 0)
    above = np.append(np.cumsum(np.maximum(one, other)[order][::-1])[::-1], 0)
    places = None if possible is None else np.flatnonzero(possible)
    partial = np.zeros(values.shape[1] if places is None else len(places), values.dtype)
    done, size = 0, FIRST_STEP
    while done < len(order) and len(partial):
        dims = order[done:done + size]
        partial = partial + anchor[dims] @ (values[dims] if places is None else values[np.ix_(dims, places)])
        done, size = done + len(dims), STEP
        if done < len(order):
            open_ = judge(partial, below[done].item() if below.dtype != object else below[done], above[done].item() if above.dtype != object else above[done])
            if open_.sum() < 0.9 * len(open_):
                places = np.flatnonzero(open_) if places is None else places[open_]
                partial = partial[open_]
    return np.arange(len(partial)) if places is None else places, partial


def _kth(values: np.ndarray, k: int):
    """The ``k``-th greatest value."""
    return np.sort(values)[-k] if values.dtype == object else np.partition(values, len(values) - k)[len(values) - k].item()


class Best:
    """The first ``k`` rows by descending score, then id, of what has been offered."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids, self.rows = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def floor(self) -> float:
        return float("-inf") if len(self.scores) < self.k else int(self.scores[-1])

    def offer(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(scores) > self.k:
            some = scores >= _kth(scores, self.k)
            scores, ids, rows = scores[some], ids[some], rows[some]
        scores = np.array([int(s) for s in scores], np.int64) if scores.dtype == object else scores.astype(np.int64)
        scores, ids, rows = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.rows, rows])
        first = np.lexsort((rows, ids, -scores))[:self.k]
        self.scores, self.ids, self.rows = scores[first], ids[first], rows[first]

    def told(self, anchor_row: int, window: int) -> pa.RecordBatch | None:
        n = len(self.scores)
        return columns(BEST, anchor_row=np.full(n, anchor_row), window=np.full(n, window), row=self.rows, vec_id=self.ids, score=self.scores) if n else None


class Anchors:
    """A bounded set of anchors, by rising row; ``windows``: for each anchor its positives' scores with the least and greatest score of a negative."""

    def __init__(self, found: pa.Table) -> None:
        found = found.combine_chunks().sort_by("anchor_row")
        self.rows, self.labels = integers(found.column("anchor_row")), integers(found.column("label"))
        self.vectors = [np.asarray(v.values, np.float64) for v in found.column("vector")]
        self.most = max((float(np.abs(v).max(initial=0)) for v in self.vectors), default=0.0)
        self.windows: list[list[tuple[int, int, int]]] = [[] for _ in self.rows]

    def add_windows(self, positives: pa.Table, low: int, high: int) -> None:
        for row, score in sorted(set(zip(positives.column("anchor_row").to_pylist(), positives.column("score").to_pylist(), strict=True))):
            self.windows[int(np.searchsorted(self.rows, row))].append((score, -(-low * score // 100), high * score // 100))

    def fitted(self, k: int, values: np.ndarray) -> np.ndarray:
        """The anchor's vector as long as the block's and of its kind of number."""
        vector = self.vectors[k][:len(values)]
        vector = np.pad(vector, (0, len(values) - len(vector)))
        return _whole(vector) if values.dtype == object else vector.astype(values.dtype)


def _span(block: Block, label: int) -> tuple[int, int]:
    return int(np.searchsorted(block.labels, label)), int(np.searchsorted(block.labels, label, "right"))


def _positives(shared, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = shared.value
        best = [Best(k) for _ in anchors.rows]
        for batch in batches:
            for block in blocks_of(batch):
                values = block.of_kind(anchors.most)
                for label in np.intersect1d(block.labels, anchors.labels).tolist():
                    lo, hi = _span(block, label)
                    own = values[:, lo:hi]
                    least, greatest = own.min(axis=1), own.max(axis=1)
                    for a in np.flatnonzero(anchors.labels == label).tolist():
                        def judge(partial, below, above, floor=best[a].floor):
                            if len(partial) > k:
                                floor = max(floor, _kth(partial, k + 1) + below)
                            return partial + above >= floor

                        places, scores = survivors(anchors.fitted(a, own), own, least, greatest, None, judge)
                        others = block.rows[lo + places] != anchors.rows[a]
                        places, scores = lo + places[others], scores[others]
                        best[a].offer(scores, block.ids[places], block.rows[places])
        yield from filter(None, (b.told(row, 0) for b, row in zip(best, anchors.rows.tolist(), strict=True)))
    return work


def _negatives(shared, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = shared.value
        best = [[Best(k) for _ in own] for own in anchors.windows]
        for batch in batches:
            for block in blocks_of(batch):
                values = block.of_kind(anchors.most)
                least, greatest = values.min(axis=1), values.max(axis=1)
                for a, windows in enumerate(anchors.windows):
                    if not windows:
                        continue
                    floors = [max(low, b.floor) for (_, low, _), b in zip(windows, best[a], strict=True)]

                    def judge(partial, below, above, windows=windows, floors=floors):
                        open_ = np.zeros(len(partial), bool)
                        for (_, low, high), floor in zip(windows, floors, strict=True):
                            sure = partial[(partial + below >= low) & (partial + above <= high)]
                            if len(sure) >= k:
                                floor = max(floor, _kth(sure, k) + below)
                            open_ |= (partial + above >= floor) & (partial + below <= high)
                        return open_

                    lo, hi = _span(block, int(anchors.labels[a]))
                    possible = np.ones(values.shape[1], bool)
                    possible[lo:hi] = False
                    places, scores = survivors(anchors.fitted(a, values), values, least, greatest, possible, judge)
                    for (_, low, high), own in zip(windows, best[a], strict=True):
                        inside = (scores >= low) & (scores <= high)
                        if inside.any():
                            own.offer(scores[inside], block.ids[places[inside]], block.rows[places[inside]])
        for row, windows, own in zip(anchors.rows.tolist(), anchors.windows, best, strict=True):
            yield from filter(None, (b.told(row, score) for (score, _, _), b in zip(windows, own, strict=True)))
    return work


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_row", "window").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vertical_blocks(rows: DataFrame, is_anchor: Column, scale: float) -> DataFrame:
    """The rows that take part, in stored vertical blocks."""
    spark = rows.sparkSession
    small_batches(spark)
    vector = F.col("embedding").cast("array<double>")
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    part = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole).select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), vector.alias("vector"))
    n = part.count()
    most = min(MOST_ROWS, max(LEAST_ROWS, n // (2 * spark.sparkContext.defaultParallelism)))
    part = part.coalesce(max(1, -(-n // most))).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "anchor", "vector")
    return stored(part.mapInArrow(_packed(scale, most), BLOCK_DDL), "vertical-blocks")


def hard_negatives(rows: DataFrame, is_anchor: Column, *, scale: float = 256.0, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over ``rows`` (vec_id, label, embedding).

    Every anchor has its first ``positives`` rows of the same label, and each of these the first ``negatives`` rows of other labels whose
    scores lie within ``low`` and ``high`` hundredths of the positive's score.
    """
    spark = rows.sparkSession
    blocks = vertical_blocks(rows, is_anchor, scale)
    anchors = stored(blocks.mapInArrow(_anchors, ANCHOR_DDL), "anchors")
    size = anchors.agg(F.sum(8 * F.size("vector") + 64)).first()[0] or 0
    buckets = int(-(-size // ANCHOR_BYTES))
    out = f"{shared_dir(spark)}/llm/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(out)
    real = lambda name: F.when(F.col(name) != NO_ID, F.col(name)).alias(name)
    for bucket in range(buckets):
        own = anchors.where(F.pmod(F.xxhash64("anchor_row"), F.lit(buckets)) == bucket)
        queries = Anchors(own.toArrow())
        if not len(queries.rows):
            continue
        shared = spark.sparkContext.broadcast(queries)
        near = stored(_first(blocks.mapInArrow(_positives(shared, positives), BEST_DDL), positives), "positives")
        queries.add_windows(near.select("anchor_row", "score").toArrow(), low, high)
        windowed = spark.sparkContext.broadcast(queries)
        far = _first(blocks.mapInArrow(_negatives(windowed, negatives), BEST_DDL), negatives).select(
            "anchor_row", F.col("window").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        pairs = near.select("anchor_row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(own.select("anchor_row", "anchor_id"), "anchor_row")
        found = far.join(pairs, ["anchor_row", "positive_score"])
        found.select(real("anchor_id"), real("positive_id"), "rank", real("negative_id"), "positive_score", "negative_score").write.mode("append").parquet(out)
        shared.unpersist()
        windowed.unpersist()
    return spark.read.schema(schema).parquet(out)
