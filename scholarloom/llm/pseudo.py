"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy.

Words (A-Z lower-cased) are the tokens, all words of the corpus the vocabulary. The output is factored by classes: the ``FREQUENT`` most frequent words
have a class each, the others share ``CLASSES`` classes by their last two bytes. The network sees the classes at ``SIDE`` places on both sides of a place, adds
one embedding per place, and predicts the class in the middle. A word's log-probability is that of its class given the neighbours plus that of the word
within its class, its share of the class in the counts of all words, which are joined. A document's score is the sum over all its words.

All of the corpus counts: words are counted over all documents, and every document trains. Documents are dealt to shards of about ``SHARD`` tokens by a hash of id and
text and sorted within them, so the model depends on the table alone, not on its order or partitions. In each of ``ROUNDS`` rounds every shard
starts from the same weights and walks its documents, with every ``STRIDE``-th place as a target, another phase in each round; there are as many rounds as
phases, so every place of every document is a target once. After a round the weights are averaged over all shards by the number of targets, as sums in two steps. Only the network itself (about 60 kB)
and the shares of the ``USUAL`` most frequent words (1 MB) reach the driver; shares of all other words are joined.

- Null or empty text, or no words: no tokens, log-likelihood 0, null mean. Empty table: no rows.
- Rows that repeat id and text: one result each, all count as words, one of them trains. Null doc_id: scored like any other. Extra columns are not read.
- Very long texts: one row of one shard, whole.
- Ties in word frequency are broken by the hash of the word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarloom.llm.common import ALNUM, LOWER, columns, document_id, integers, runs, small_batches, split_words, stored, texts, utf8, word_hashes

FREQUENT, CLASSES, SIDE, WIDTH = 96, 32, 2, 16
VOCABULARY = FREQUENT + CLASSES
EDGE = VOCABULARY
ROUNDS = STRIDE = 4
MINIBATCH, RATE = 512, 0.1
SHARD = 1_000_000
USUAL = 65_536
SUMS = 16
AT_ONCE = 65_536
PLACES = [k for k in range(-SIDE, SIDE + 1) if k]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.int64()), ("class", pa.int32()), ("n", pa.int64())])
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        data = LOWER[data]
        starts, ends, _ = split_words(data, offsets, ALNUM)
        words, at, counts = np.unique(word_hashes(data, starts, ends).view(np.int64), return_index=True, return_counts=True)
        yield columns(schema, word=words, n=counts, **{"class": classes_of(data, starts[at], ends[at])})


def classes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Shared class of every word, by its last two bytes."""
    if not len(ends):
        return ends
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    return FREQUENT + (data[ends - 1].astype(np.int64) * 31 + before * 7) % CLASSES


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, class, n): the hash of every word of all documents, the class it would share, and how often it occurs."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(counted, "word long, class int, n long").groupBy("word").agg(F.min("class").alias("class"), F.sum("n").alias("n"))


def most_frequent(totals: DataFrame) -> np.ndarray:
    return np.array([r.word for r in totals.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()], np.int64)


def frequent_words(docs: DataFrame) -> np.ndarray:
    """Hashes of the most frequent words of all documents, the most frequent first."""
    return most_frequent(word_counts(docs))


def within_classes(totals: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(word, log_share): log-probability within its class of every word that shares one."""
    shared = totals.where(~F.col("word").isin(frequent.tolist())) if len(frequent) else totals
    sizes = shared.groupBy("class").agg(F.sum("n").alias("size"))
    return shared.join(F.broadcast(sizes), "class").select("word", (F.log(F.col("n").cast("double")) - F.log(F.col("size").cast("double"))).alias("log_share"))


def usual_shares(within: DataFrame, totals: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, log shares) of the ``USUAL`` most frequent words that share a class, sorted by hash."""
    rows = within.join(totals.select("word", "n"), "word").orderBy(F.desc("n"), "word").limit(USUAL).select("word", "log_share").toArrow()
    words, logs = integers(rows.column("word")), np.asarray(rows.column("log_share"), np.float64)
    order = np.argsort(words)
    return words[order], logs[order]


def tokens_of(data: np.ndarray, offsets: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, first): the token of every word, and the number of words before each text."""
    data = LOWER[data]
    starts, ends, first = split_words(data, offsets, ALNUM)
    return _tokens(data, starts, ends, word_hashes(data, starts, ends).view(np.int64), frequent), first


def _tokens(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    out = classes_of(data, starts, ends)
    if len(frequent) and len(starts):
        order = np.argsort(frequent)
        at = np.minimum(np.searchsorted(frequent[order], hashes), len(frequent) - 1)
        known = frequent[order][at] == hashes
        out[known] = order[at[known]]
    return out.astype(np.uint8)


TOKENS = T.StructType([T.StructField("tokens", T.BinaryType()), T.StructField("trains", T.BooleanType()), T.StructField("usual_log", T.DoubleType()), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])


def _listed(values: np.ndarray, first: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def tokenised(docs: DataFrame, frequent: np.ndarray, usual: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0))) -> DataFrame:
    """(row, doc_id, key, tokens, trains, usual_log, words, counts), stored: one byte a word; whether the row is the first of its batch with this id and text; the
    summed log shares of the ``usual`` words; each other word that shares a class, and how often the text holds it. ``row`` is a number of its own for each row."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, *usual))

    @F.arrow_udf(TOKENS)
    def cut(text: pa.Array, doc: pa.Array, key: pa.Array) -> pa.Array:
        frequent, known, logs = shared.value
        data, offsets = utf8(text)
        data, n = LOWER[data], len(offsets) - 1
        starts, ends, first = split_words(data, offsets, ALNUM)
        hashes = word_hashes(data, starts, ends).view(np.int64)
        found = _tokens(data, starts, ends, hashes, frequent)
        whole = found.tobytes()
        rare = found >= FREQUENT
        owner, hashes = np.repeat(np.arange(n), np.diff(first))[rare], hashes[rare]
        summed = np.zeros(n)
        if len(known):
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            usual = known[at] == hashes
            summed = np.bincount(owner[usual], logs[at[usual]], minlength=n)
            owner, hashes = owner[~usual], hashes[~usual]
        order = np.lexsort((hashes, owner))
        owner, hashes = owner[order], hashes[order]
        bounds = runs([owner, hashes])
        per_text = np.searchsorted(owner[bounds[:-1]], np.arange(n + 1))
        trains = np.zeros(n, bool)
        trains[np.unique(np.stack([integers(doc), integers(key)], axis=1), axis=0, return_index=True)[1]] = True
        return pa.StructArray.from_arrays([
            pa.array([whole[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary()), pa.array(trains), pa.array(summed),
            _listed(hashes[bounds[:-1]], per_text, pa.int64()), _listed(np.diff(bounds), per_text, pa.int32())], names=TOKENS.names)

    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    told = docs.select("doc_id", F.xxhash64(text).alias("key"), cut(text, document_id(), F.xxhash64(text)).alias("cut"))
    return stored(told.select(F.monotonically_increasing_id().alias("row"), "doc_id", "key", "cut.*"), "tokens")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a shard: its texts behind each other. Rows come sorted by shard, hash and id; repeated ones train once."""
    schema = pa.schema([("shard", pa.int64()), ("tokens", pa.binary()), ("first", pa.binary())])

    def packed(shard: int, held: list[bytes]) -> pa.RecordBatch:
        first = np.cumsum([0, *map(len, held)])
        return columns(schema, shard=[shard], tokens=[b"".join(held)], first=[first.astype(np.int64).tobytes()])

    current, last, held = None, None, []
    for batch in batches:
        for shard, key, doc, tokens in zip(*(integers(batch.column(n)).tolist() for n in ("shard", "key", "doc")), texts(batch.column("tokens")), strict=True):
            if shard != current and held:
                yield packed(current, held)
                held = []
            if (shard, key, doc) != last:
                held.append(tokens)
            current, last = shard, (shard, key, doc)
    if held:
        yield packed(current, held)


def sharded(tokens: DataFrame) -> DataFrame:
    """(shard, tokens, first), stored: all texts, dealt by a hash of id and text; ``first`` has the tokens before each text."""
    total = tokens.agg(F.sum(F.octet_length("tokens").cast("long"))).first()[0] or 0
    doc = document_id()
    dealt = tokens.where("trains AND octet_length(tokens) > 0").select(
        F.pmod(F.xxhash64(doc, "key"), F.lit(max(1, -(-total // SHARD)))).alias("shard"), "key", doc.alias("doc"), "tokens")
    order = ["shard", "key", "doc"]
    return stored(dealt.repartition("shard").sortWithinPartitions(*order).mapInArrow(_shards, "shard long, tokens binary, first binary"), "shards")


@dataclass
class Network:
    """``embed``: one table per place; ``hidden``: bias of the hidden layer; ``out`` and ``bias``: the output layer."""

    embed: np.ndarray
    hidden: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls) -> Network:
        draw = np.random.default_rng(4_096)
        return cls(draw.normal(0, 0.1, (len(PLACES), VOCABULARY + 1, WIDTH)).astype(np.float32), np.zeros(WIDTH, np.float32),
                   draw.normal(0, 0.1, (WIDTH, VOCABULARY)).astype(np.float32), np.zeros(VOCABULARY, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.hidden, self.out, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.reshape(-1) for p in self.parts()])

    @classmethod
    def from_flat(cls, values: np.ndarray) -> Network:
        parts, at = [], 0
        for like in cls.fresh().parts():
            parts.append(values[at:at + like.size].reshape(like.shape).astype(np.float32))
            at += like.size
        return cls(*parts)

    def forward(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hidden layer, output without its constant) for rows of neighbouring tokens."""
        h = self.hidden + self.embed[0][around[:, 0]]
        for k in range(1, len(PLACES)):
            h += self.embed[k][around[:, k]]
        h = np.tanh(h)
        logits = h @ self.out
        logits += self.bias
        logits -= logits.max(axis=1, keepdims=True)
        return h, logits

    def log_probability(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target given its neighbours."""
        _, logits = self.forward(around)
        own = logits[np.arange(len(target)), target]
        return own - np.log(np.exp(logits, out=logits).sum(axis=1))

    def step(self, around: np.ndarray, target: np.ndarray, memory: list[np.ndarray]) -> None:
        """One step of adaptive gradient descent on the mean negative log-probability."""
        h, error = self.forward(around)
        np.exp(error, out=error)
        error /= error.sum(axis=1, keepdims=True)
        error[np.arange(len(target)), target] -= 1
        error /= len(target)
        back = (error @ self.out.T) * (1 - h * h)
        embed = np.empty_like(self.embed)
        for k in range(len(PLACES)):
            chosen = np.zeros((len(target), VOCABULARY + 1), np.float32)
            chosen[np.arange(len(target)), around[:, k]] = 1
            embed[k] = chosen.T @ back
        for part, gradient, seen in zip(self.parts(), [embed, back.sum(axis=0), h.T @ error, error.sum(axis=0)], memory, strict=True):
            seen += gradient * gradient
            part -= RATE * gradient / (np.sqrt(seen) + 1e-6)


def padded(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts behind each other with ``SIDE`` edge tokens between them, and the places of the real tokens."""
    shift = np.repeat(np.arange(len(first) - 1) + 1, np.diff(first)) * SIDE
    out = np.full(len(tokens) + len(first) * SIDE, EDGE, np.int64)
    at = np.arange(len(tokens)) + shift
    out[at] = tokens
    return out, at


def neighbours(line: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([line[at + k] for k in PLACES], axis=1)


def _train(shared, phase: int):
    schema = pa.schema([("shard", pa.int64()), ("targets", pa.float64()), ("weights", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, tokens, first in zip(batch.column("shard").to_pylist(), texts(batch.column("tokens")), texts(batch.column("first")), strict=True):
                net = Network.from_flat(shared.value)
                memory = [np.full_like(p, 1e-4) for p in net.parts()]
                line, at = padded(np.frombuffer(tokens, np.uint8), np.frombuffer(first, np.int64))
                at = at[phase::STRIDE]
                for lo in range(0, len(at), MINIBATCH):
                    own = at[lo:lo + MINIBATCH]
                    net.step(neighbours(line, own), line[own], memory)
                yield columns(schema, shard=[shard], targets=[float(len(at))], weights=[(net.flat().astype(np.float64) * len(at)).tobytes()])
    return work


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("targets", pa.float64()), ("weights", pa.binary())])
    total, whole = 0.0, None
    for batch in batches:
        total += float(np.asarray(batch.column("targets")).sum())
        for weights in texts(batch.column("weights")):
            values = np.frombuffer(weights, np.float64)
            whole = values.copy() if whole is None else whole + values
    if whole is not None:
        yield columns(schema, targets=[total], weights=[whole.tobytes()])


def trained(tokens: DataFrame) -> Network:
    """Network trained on every document of ``tokens``; without any token it stays as it was made."""
    net, context = Network.fresh(), tokens.sparkSession.sparkContext
    shards = sharded(tokens)
    for k in range(ROUNDS):
        shared = context.broadcast(net.flat())
        own = shards.mapInArrow(_train(shared, k * STRIDE // ROUNDS), "shard long, targets double, weights binary")
        sums = own.repartition(SUMS, F.pmod("shard", F.lit(SUMS))).drop("shard").mapInArrow(_added, "targets double, weights binary").collect()
        if total := sum(r.targets for r in sums):
            net = Network.from_flat(sum(np.frombuffer(r.weights, np.float64) for r in sorted(sums, key=lambda r: bytes(r.weights))) / total)
    return net


def log_likelihoods(net: Network, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Summed log-probability of the classes of every text's words, each given its neighbours."""
    line, at = padded(tokens, first)
    sums = np.zeros(len(first) - 1, np.float64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for lo in range(0, len(at), AT_ONCE // 8):
        own = at[lo:lo + AT_ONCE // 8]
        sums += np.bincount(text[lo:lo + AT_ONCE // 8], net.log_probability(neighbours(line, own), line[own]), minlength=len(sums))
    return sums


def word_terms(tokens: DataFrame, within: DataFrame) -> DataFrame:
    """(row, word_log): summed log-probability within their classes of a row's words that share one."""
    pairs = tokens.select("row", F.explode(F.arrays_zip("words", "counts")).alias("p")).select("row", F.col("p.words").alias("word"), F.col("p.counts").alias("times"))
    return pairs.join(within, "word").groupBy("row").agg(F.sum(F.col("times") * F.col("log_share")).alias("word_log"))


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) of every whole document."""
    totals = stored(word_counts(docs), "words")
    frequent = most_frequent(totals)
    within = within_classes(totals, frequent)
    tokens = tokenised(docs, frequent, usual_shares(within, totals))
    shared = docs.sparkSession.sparkContext.broadcast(trained(tokens).flat())

    @F.arrow_udf(T.DoubleType())
    def score(column: pa.Array) -> pa.Array:
        return pa.array(log_likelihoods(Network.from_flat(shared.value), *utf8(column)), pa.float64())

    told = tokens.select("row", "doc_id", F.octet_length("tokens").cast("long").alias("n_tokens"), (score("tokens") + F.col("usual_log")).alias("class_log"))
    told = told.join(word_terms(tokens, within), "row", "left")
    told = told.select("doc_id", "n_tokens", (F.col("class_log") + F.coalesce("word_log", F.lit(0.0))).alias("log_likelihood"))
    return told.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
