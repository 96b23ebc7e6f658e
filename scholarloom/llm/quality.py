"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

Terms are words, pairs of neighbouring words, and what a word looks like. Words (runs of letters and digits, lower-cased) count if they are in the lexicon: the
``LEXICON`` words in most documents of the labelled sample, at least two; they and their pairs are hashed, all other words are one term. Beside them stand the
shape of each word (runs of letters, capitals and digits collapsed, each punctuation mark its own sign), its length, and whether it repeats the word before it.
Weighted by inverse document frequency and projected on the leading singular vectors of the labelled sample, every document is compared with every labelled
vector, in blocks, and the labels of the ``NEIGHBOURS`` nearest vote with weight cosine to the power ``SHARPNESS``, corrected for the share of each label.

A nearest neighbour can be far away, so the vote is lowered for texts in a language the sample does not know: by the share of words in the lexicon, against
what all but 1 % of the good documents of the sample have (their words being known from other documents). Short texts get the benefit of ``BENEFIT`` usual words.

The sample is bounded: at most ``PER_LABEL`` rows of each label, those with the smallest hash of the id, so what is broadcast is at most
``2 * PER_LABEL * RANK`` numbers and the lexicon. Only rows whose crc32(doc_id as text) mod 4 is not 2 are learnt from.

- Null or empty text, or one without letters and digits: 0. No vote: the share of good labels. No labelled rows: every score is 1. Very long texts are counted in
  slices of words. Ties at the last neighbour: either.
- A document with several labels counts with the lowest. Null labels are not used. Several texts of a labelled id: that with the smallest hash.
- Repeated rows: one result each. Null doc_id: never held out, never learnt from. Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarloom.llm.common import ALNUM, LOWER, NOT_SPACE, mixed, small_batches, split_words, stored, unused, utf8, word_hashes

PER_LABEL, RANK, NEIGHBOURS, SHARPNESS = 1_024, 32, 31, 8
HELD_OUT, KEEP_AT = 2, 0.7
SHAPES, LENGTHS = 512, 24
AGAIN = SHAPES + LENGTHS
WORDS, PAIRS, LEXICON = 512, 512, 65_536
FIRST_WORD = AGAIN + 2
FIRST_PAIR = FIRST_WORD + WORDS + 1
TERMS = FIRST_PAIR + PAIRS
BENEFIT, LEAST_KNOWN = 3, 0.01
BLOCK = 256
AT_ONCE = 500_000
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x80:] = 1, 2, 3, 3
_STEP = np.uint64(0x9E37_79B9_7F4A_7C15)


def word_shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Shape number of every word, below ``SHAPES``."""
    kinds = _CLASS[data]
    turn = np.ones(len(data), bool)
    turn[1:] = kinds[1:] != kinds[:-1]
    turn[starts] = True
    edges = np.zeros(len(data) + 1, np.int64)
    np.cumsum(turn, out=edges[1:])
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    inside = np.repeat(starts - at, lengths) + np.arange(int(lengths.sum()))
    rank = (edges[inside + 1] - np.repeat(edges[starts] + 1, lengths)).astype(np.uint64)
    values = np.where(turn[inside], mixed((kinds[inside] + np.uint64(1)) * _STEP + rank), np.uint64(0))
    return (mixed(np.add.reduceat(values, at)) % np.uint64(SHAPES)).astype(np.int64) if len(at) else np.zeros(0, np.int64)


def lexical_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): lower-cased runs of letters and digits, and the number of words before each text."""
    lower = LOWER[data]
    starts, ends, first = split_words(lower, offsets, ALNUM)
    return word_hashes(lower, starts, ends), first


def within(words: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Which words are in the sorted ``lexicon``."""
    if not len(lexicon):
        return np.zeros(len(words), bool)
    at = np.minimum(np.searchsorted(lexicon, words), len(lexicon) - 1)
    return lexicon[at] == words


def term_counts(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Term frequencies of every text: share of its words, one row a text."""
    n = len(offsets) - 1
    starts, ends, first = split_words(data, offsets, NOT_SPACE)
    text, hashes = np.repeat(np.arange(n), np.diff(first)), word_hashes(data, starts, ends)
    counts = np.zeros(n * TERMS, np.float64)
    for lo in range(0, len(starts), AT_ONCE):
        own = slice(lo, lo + AT_ONCE)
        base, since = text[own] * TERMS, starts[lo]
        shapes = word_shapes(data[since:ends[own][-1]], starts[own] - since, ends[own] - since)
        counts += np.bincount(base + shapes, minlength=n * TERMS)
        counts += np.bincount(base + SHAPES + np.minimum(ends[own] - starts[own], LENGTHS) - 1, minlength=n * TERMS)
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    counts += np.bincount(text * TERMS + AGAIN + again, minlength=n * TERMS)
    counts = counts.reshape(n, TERMS) / np.maximum(np.diff(first), 1)[:, None]
    words, begins = lexical_words(data, offsets)
    known, text = within(words, lexicon), np.repeat(np.arange(n), np.diff(begins))
    terms = np.where(known, FIRST_WORD + (words % np.uint64(WORDS)).astype(np.int64), FIRST_WORD + WORDS)
    lexical = np.bincount(text * TERMS + terms, minlength=n * TERMS).astype(np.float64)
    both = np.flatnonzero(known[1:] & known[:-1] & (text[1:] == text[:-1]))
    pairs = mixed(words[both] * _STEP + words[both + 1]) % np.uint64(PAIRS)
    lexical += np.bincount(text[both] * TERMS + FIRST_PAIR + pairs.astype(np.int64), minlength=n * TERMS)
    return counts + lexical.reshape(n, TERMS) / np.maximum(np.diff(begins), 1)[:, None]


def known_share(known: np.ndarray, total: np.ndarray, typical: float) -> np.ndarray:
    """Share of known words, with ``BENEFIT`` words of the typical share added."""
    return (known + BENEFIT * typical) / (total + BENEFIT)


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(size > 0, size, 1)


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # of terms
    axes: np.ndarray  # terms x rank
    vectors: np.ndarray  # labelled documents x rank, unit length
    votes: np.ndarray  # weight of each labelled document's label
    good: np.ndarray  # 1 where the label is 1, else 0
    share: float  # of label 1 among the labelled
    lexicon: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes of known words
    typical: float = 1.0  # share of known words of good documents
    low: float = 0.0  # share of known words below which votes are lowered

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return unit(unit(np.sqrt(counts) * self.weights) @ self.axes).astype(np.float32)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.share)
        if not len(self.vectors):
            return out
        rows, near = self.latent(counts), min(NEIGHBOURS, len(self.vectors))
        for lo in range(0, len(rows), BLOCK):
            cosines = rows[lo:lo + BLOCK] @ self.vectors.T
            best = np.argpartition(-cosines, near - 1, axis=1)[:, :near]
            weight = np.maximum(np.take_along_axis(cosines, best, axis=1), 0).astype(np.float64) ** SHARPNESS * self.votes[best]
            total = weight.sum(axis=1)
            some = total > 0
            out[lo:lo + BLOCK][some] = ((weight * self.good[best]).sum(axis=1)[some] / total[some]).clip(0, 1)
        return out

    def trust(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """What the votes for each text are worth: 0 without words, 1 where enough of them are known."""
        words, first = lexical_words(data, offsets)
        total = np.diff(first)
        known = np.bincount(np.repeat(np.arange(len(total)), total), within(words, self.lexicon), minlength=len(total))
        share = known_share(known, total, self.typical)
        return np.where(total > 0, np.minimum(1, share / self.low) if self.low > 0 else 1.0, 0.0)

    def judged(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of whole texts, ``BLOCK`` texts at a time."""
        out = np.ones(len(offsets) - 1)
        if not len(self.vectors):
            return out
        for lo in range(0, len(out), BLOCK):
            at = offsets[lo:lo + BLOCK + 1]
            own = data[at[0]:at[-1]]
            out[lo:lo + BLOCK] = self.scores(term_counts(own, at - at[0], self.lexicon)) * self.trust(own, at - at[0])
        return out


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Model of a bounded sample of ``labels`` (doc_id, quality) whose documents are in ``docs``."""
    small_batches(docs.sparkSession)
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    totals = {r.quality: r["count"] for r in own.groupBy("quality").count().collect()}
    chosen = [own.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_LABEL) for k in (0, 1)]
    sample = chosen[0].unionAll(chosen[1])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(
        F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    kept = stored(texts, "quality-sample")

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def words(text: pa.Array) -> pa.Array:
        hashes, first = lexical_words(*utf8(text))
        own = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
        return pa.ListArray.from_arrays(np.append(0, np.cumsum([len(o) for o in own])).astype(np.int32), np.concatenate([*own, np.zeros(0, np.int64)]))

    counted = kept.select(F.explode(words("text")).alias("word")).groupBy("word").count().where("count >= 2")
    listed = counted.orderBy(F.col("count").desc(), "word").limit(LEXICON).collect()
    lexicon = np.sort(np.array([r.word for r in listed], np.int64).view(np.uint64))
    thrice = np.sort(np.array([r.word for r in listed if r["count"] >= 3], np.int64).view(np.uint64))

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def features(text: pa.Array) -> pa.Array:
        data, offsets = utf8(text)
        found, first = lexical_words(data, offsets)
        total = np.diff(first)
        known = np.bincount(np.repeat(np.arange(len(total)), total), within(found, thrice), minlength=len(total))
        counts = np.column_stack([term_counts(data, offsets, lexicon), known, total]).astype(np.float32)
        return pa.ListArray.from_arrays(np.arange(0, counts.size + 1, TERMS + 2, dtype=np.int32), counts.reshape(-1))

    rows = kept.select("doc_id", "quality", features("text").alias("f")).collect()
    rows.sort(key=lambda r: r.doc_id)
    if not rows:
        return QualityModel(np.ones(TERMS), np.zeros((TERMS, 0)), np.zeros((0, 0), np.float32), np.zeros(0), np.zeros(0), 1.0)
    table, good = np.array([r.f for r in rows], np.float64), np.array([r.quality for r in rows], np.float64)
    counts, known, total = table[:, :TERMS], table[:, TERMS], table[:, TERMS + 1]
    usual = (good == 1) & (total > 0)
    typical = float(known[usual].sum() / total[usual].sum()) if usual.any() else 1.0
    low = float(np.quantile(known_share(known, total, typical)[usual], LEAST_KNOWN)) if usual.any() else 0.0
    weights = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1
    _, _, axes = np.linalg.svd(unit(np.sqrt(counts) * weights), full_matrices=False)
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    taken = np.array([max(1, (good == k).sum()) for k in (0, 1)])
    votes = np.where(good == 1, share / taken[1], (1 - share) / taken[0])
    model = QualityModel(weights, axes[:RANK].T, np.zeros((0, 0), np.float32), votes, good, share)
    return QualityModel(weights, model.axes, model.latent(counts), votes, good, share, lexicon, typical, low)


def scored(docs: DataFrame, model: QualityModel, name: str = "llm_score") -> DataFrame:
    """``docs`` with ``name``: 0 to 1, higher is likelier of label 1."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        return pa.array(shared.value.judged(*utf8(text)), pa.float64())

    return docs.withColumn(name, score(F.col("text").cast("string")))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    return scored(docs.select("doc_id", "text"), fit(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), F.col("llm_score").alias("score"), (F.col("llm_score") >= KEEP_AT).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not rejected; columns as given."""
    (name,) = unused(docs, "llm_score")
    return scored(docs, fit(docs, labels), name).where(F.col(name) >= KEEP_AT).select(*docs.columns)
