"""Runs of repeated words (maximal periodic stretches) by longest common extensions over a difference cover.

A run is a stretch of consecutive words with smallest period ``q`` and at least ``max(LEAST_WORDS, LEAST_TURNS * q)`` words that neither
neighbouring word extends. Every run of period ``q`` covers a pair (i, i + q) whose ``i`` is a multiple of ``(LEAST_TURNS - 1) * q``: these grids, of harmonic
size in all, name the candidates. Where the two words of a pair agree, their common extension forwards and backwards gives the one maximal stretch.

Extensions compare a few words until both sides stand on places of the difference cover of ``MOD`` (some shift under ``MOD`` brings
any two places there). Only suffixes at cover places are sorted, by blocks of ``MOD`` words and doubling among those still tied;
a sparse table of minima over the common prefixes of neighbours answers the rest. Only texts with such a pair are sorted at all.

- Null, empty or blank text: no words, no runs, collapsed to the empty text. Empty table: no rows.
- Every row is judged by itself: repeated rows give equal results, a null doc_id is carried on, other columns are not read.
- Ties: of stretches found under several periods the smallest period stays.
- Very long texts: whole, in one task; memory is a multiple of the text, pairs are met in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarloom.llm.common import NOT_SPACE, small_batches, split_words, texts, utf8, word_hashes

LEAST_WORDS, LEAST_TURNS = 6, 4
MOD, COVER = 16, (0, 1, 2, 5, 8)
PAIRS_AT_ONCE = 1_000_000
_AT = np.full(MOD, -1, np.int64)
_AT[list(COVER)] = np.arange(len(COVER))
#: Smallest common shift of two places, by their remainders, that brings both onto the cover.
SHIFT = np.array([[min(d for d in range(MOD) if (a + d) % MOD in COVER and (b + d) % MOD in COVER) for b in range(MOD)] for a in range(MOD)], np.int64)


class SampledSuffixes:
    """Suffixes at cover places of some texts, sorted, with a sparse table over the common prefixes of neighbours.

    Each text begins at a multiple of ``MOD`` and ends in at least one word of its own, so no common prefix leaves a text.
    """

    def __init__(self, hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        room = (counts // MOD + 1) * MOD
        self.base = np.cumsum(room) - room
        within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        values, ids = np.unique(hashes[np.repeat(starts, counts) + within], return_inverse=True)
        line = np.repeat(len(values) + np.arange(len(counts)), room)
        line[np.repeat(self.base, counts) + within] = ids
        self.line = np.append(line, np.zeros(MOD, np.int64))
        self.places = (np.arange(0, len(line), MOD)[:, None] + np.array(COVER)).reshape(-1)
        levels = self._ranked(len(values) + len(counts))
        self.rank = levels[-1]
        self.table = self._minima(self._neighbours(levels))

    def _ranked(self, different: int) -> list[np.ndarray]:
        """Ranks by the first ``MOD``, 2 ``MOD``, 4 ``MOD``, ... words, until all differ. A rank is the number of smaller suffixes."""
        bits = max(1, int(different).bit_length())
        packed, per = [], 63 // bits
        for lo in range(0, MOD, per):
            value = np.zeros(len(self.places), np.int64)
            for k in range(lo, min(lo + per, MOD)):
                value = (value << bits) | self.line[self.places + k]
            packed.append(value)
        rank = self._refined(np.arange(len(self.places)), packed, np.zeros(len(self.places), np.int64))
        levels, step = [rank], len(COVER)
        while True:
            tied = np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)
            if not len(tied):
                return levels
            after = np.full(len(rank), -1, np.int64)
            after[:-step] = rank[step:]
            rank = self._refined(tied, [after[tied]], rank)
            levels.append(rank)
            step *= 2

    @staticmethod
    def _refined(those: np.ndarray, keys: list[np.ndarray], rank: np.ndarray) -> np.ndarray:
        """``rank`` with the tied suffixes ``those`` told apart by ``keys``, the first of which weighs most."""
        order = np.lexsort([*reversed(keys), rank[those]])
        old = rank[those][order]
        new_old = np.ones(len(order), bool)
        new_old[1:] = old[1:] != old[:-1]
        new = new_old.copy()
        for key in keys:
            sorted_key = key[order]
            new[1:] |= sorted_key[1:] != sorted_key[:-1]
        place = np.arange(len(order))
        out = rank.copy()
        out[those[order]] = old + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(new_old, place, 0))
        return out

    def _neighbours(self, levels: list[np.ndarray]) -> np.ndarray:
        """Number of words that each sorted suffix shares with the next one."""
        order = np.empty(len(self.rank), np.int64)
        order[self.rank] = np.arange(len(order))
        a, b = order[:-1].copy(), order[1:].copy()
        shared = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 2, -1, -1):
            equal = np.flatnonzero(levels[k][a] == levels[k][b])
            shared[equal] += MOD << k
            a[equal] += len(COVER) << k
            b[equal] += len(COVER) << k
        open_, a, b = np.arange(len(a)), self.places[a], self.places[b]
        for k in range(MOD):
            open_ = open_[self.line[a[open_] + k] == self.line[b[open_] + k]]
            shared[open_] += 1
        return shared.astype(np.int32)

    @staticmethod
    def _minima(values: np.ndarray) -> list[np.ndarray]:
        table = [values]
        while len(table[-1]) > (half := 1 << (len(table) - 1)):
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        return table

    def shared(self, text: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at two different cover places of one text each time."""
        a, b = (self.rank[(self.base[text] + x) // MOD * len(COVER) + _AT[x % MOD]] for x in (i, j))
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        width = np.log2(hi - lo).astype(np.int64)
        out = np.empty(len(lo), np.int64)
        for k in np.unique(width).tolist():
            at = width == k
            out[at] = np.minimum(self.table[k][lo[at]], self.table[k][hi[at] - (1 << k)])
        return out


class Extensions:
    """Common extensions of pairs of places within the texts of one batch, in one direction."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray) -> None:
        self.hashes, self.starts, self.counts = hashes, first[:-1], np.diff(first)
        self.sorted_texts, self.suffixes = np.zeros(0, np.int64), None

    def __call__(self, text: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` and ``j`` (``i`` < ``j``, counted within ``text``) on are equal, up to the end of the text."""
        out = np.zeros(len(i), np.int64)
        shift = SHIFT[i % MOD, j % MOD]
        asked, waiting = np.arange(len(i)), []
        for k in range(MOD):
            asked = asked[j[asked] + k < self.counts[text[asked]]]
            met = shift[asked] == k
            waiting.append(asked[met])
            asked = asked[~met]
            begin = self.starts[text[asked]] + k
            asked = asked[self.hashes[begin + i[asked]] == self.hashes[begin + j[asked]]]
            out[asked] = k + 1
            if not len(asked):
                break
        rest = np.concatenate(waiting)
        if len(rest):
            own = self._sorted(np.unique(text[rest]))
            out[rest] = shift[rest] + own.shared(np.searchsorted(self.sorted_texts, text[rest]), i[rest] + shift[rest], j[rest] + shift[rest])
        return out

    def _sorted(self, wanted: np.ndarray) -> SampledSuffixes:
        if not np.isin(wanted, self.sorted_texts).all():
            self.sorted_texts, self.suffixes = wanted, SampledSuffixes(self.hashes, self.starts[wanted], self.counts[wanted])
        return self.suffixes


def backwards(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    counts = np.diff(first)
    return hashes[np.repeat(first[1:] - 1, counts) - (np.arange(len(hashes)) - np.repeat(first[:-1], counts))]


def grid(first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, i, q) of the grid pairs of every text and period, in slices of about ``PAIRS_AT_ONCE``."""
    counts = np.diff(first)
    periods = np.where(counts >= LEAST_WORDS, counts // LEAST_TURNS, 0)
    text = np.repeat(np.arange(len(counts)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = (LEAST_TURNS - 1) * q
    pairs = (counts[text] - q + step - 1) // step
    before = np.concatenate([[0], np.cumsum(pairs)])
    cuts = np.unique(np.append(np.searchsorted(before, np.arange(0, int(before[-1]), PAIRS_AT_ONCE)), len(text)))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        n = pairs[lo:hi]
        at = np.repeat(np.arange(lo, hi), n)
        yield text[at], (np.arange(len(at)) - np.repeat(before[lo:hi] - before[lo], n)) * step[at], q[at]


def runs_of(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and length, for words given as hashes; ``first``: words before each text."""
    forwards, reverse = Extensions(hashes, first), Extensions(backwards(hashes, first), first)
    counts, found = np.diff(first), []
    for text, i, q in grid(first):
        begin = first[text] + i
        some = hashes[begin] == hashes[begin + q]
        text, i, q = text[some], i[some], q[some]
        ahead = forwards(text, i, i + q)
        behind = reverse(text, counts[text] - i - q, counts[text] - i)
        length = ahead + behind + q
        long = length >= np.maximum(LEAST_WORDS, LEAST_TURNS * q)
        found.append(np.stack([text, i - behind, length, q], axis=1)[long])
    rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    return rows[new]


RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
FOUND = T.StructType([T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])


@F.arrow_udf(FOUND)
def _found(column: pa.Array) -> pa.Array:
    data, offsets = utf8(column)
    starts, ends, first = split_words(data, offsets, NOT_SPACE)
    rows = runs_of(word_hashes(data, starts, ends), first)
    bounds = np.searchsorted(rows[:, 0], np.arange(len(first)))
    collapsed = []
    for text, lo, hi, n in zip(texts(column), bounds[:-1].tolist(), bounds[1:].tolist(), np.diff(first).tolist(), strict=True):
        words = text.split()
        if lo < hi:
            change = np.zeros(n + 1, np.int64)
            np.add.at(change, rows[lo:hi, 1] + rows[lo:hi, 3], 1)
            np.add.at(change, rows[lo:hi, 1] + rows[lo:hi, 2], -1)
            words = compress(words, (np.cumsum(change[:-1]) == 0).tolist())
        collapsed.append(b" ".join(words))
    each = pa.StructArray.from_arrays([pa.array(rows[:, k], pa.int64()) for k in (1, 2, 3)], names=["start", "length", "period"])
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), each), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) per row: all runs by start and length as (start, length, period) in words, and the text whose runs are cut to one period each."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", _found(F.col("text").cast("string")).alias("found")).select("doc_id", "found.runs", "found.collapsed")


def best_run(runs: Column) -> Column:
    """The run with the greatest exact length / period; ties go to the smallest start, then period. Null without runs."""
    def better(best: Column, run: Column) -> Column:
        more, same = run.length * best.period - best.length * run.period, (run.start < best.start) | ((run.start == best.start) & (run.period < best.period))
        return F.when(best.isNull() | (more > 0) | ((more == 0) & same), run).otherwise(best)

    return F.reduce(runs, F.lit(None).cast(RUN), better)


@F.arrow_udf(T.StringType())
def _with_repeated_tail(column: pa.Array, draw: pa.Array) -> pa.Array:
    out = []
    for text, g in zip(column, draw.to_pylist(), strict=True):
        words = text.as_py().encode().split() if text.is_valid and g is not None else []
        if words:
            a, n = g % len(words), len(words)
            period = 1 + (n - a) // (3 + g % 8)
            words[a:] = (words[a:a + period] * ((n - a) // period + 1))[:n - a]
        out.append(b" ".join(words).decode() if words else None)
    return pa.array(out, pa.string())


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where one text in ten, drawn by a hash of its id, repeats a stretch of its words up to its end: documents with known long runs."""
    draw = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = draw % 10 == 0
    changed = _with_repeated_tail(F.when(chosen, F.col("text").cast("string")), F.when(chosen, F.floor(draw / 10)))
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(changed, F.col("text").cast("string")).alias("text"))
