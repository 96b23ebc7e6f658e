"""Linear-chain conditional random field in numpy: fitted by gradient ascent on whole batches, decoded by Viterbi on whole batches.

Sequences are rows of feature numbers, one row a place; the score of a label at a place is the sum of its weights over the place's features, that of two
neighbouring labels is ``pairs``. Label 0 stands before and after every sequence. Pairs that are not ``allowed`` never occur.
"""

from __future__ import annotations

import numpy as np

ROUNDS, RATE, DECAY = 120, 0.15, 0.002
NEVER = -1e9


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.log(np.exp(values - top).sum(axis=axis)) + np.squeeze(top, axis)


class Chain:
    def __init__(self, weights: np.ndarray, pairs: np.ndarray, allowed: np.ndarray) -> None:
        self.weights, self.pairs, self.allowed = weights, pairs, allowed

    @property
    def scores(self) -> np.ndarray:
        return np.where(self.allowed, self.pairs, NEVER)

    def unary(self, features: np.ndarray) -> np.ndarray:
        """Scores of all labels at places given as rows of feature numbers."""
        out = np.zeros((len(features), self.weights.shape[1]))
        for k in range(features.shape[1]):
            out += self.weights[features[:, k]]
        return out

    def likelihood(self, features: np.ndarray, first: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(log-likelihood, its gradient by the label scores of every place, its gradient by ``pairs``), by forward and backward sums."""
        unary, pairs, lengths = self.unary(features), self.scores, np.diff(first)
        order = np.argsort(-lengths, kind="stable")
        begin, lengths = first[:-1][order], lengths[order]
        active = [int((lengths > t).sum()) for t in range(int(lengths.max(initial=0)))]
        ahead = []
        for t, n in enumerate(active):
            entering = pairs[0] if t == 0 else _log_sum(ahead[-1][:n, :, None] + pairs, 1)
            ahead.append(entering + unary[begin[:n] + t])
        total = np.zeros(len(lengths))
        behind: list[np.ndarray] = [None] * len(active)
        for t in range(len(active) - 1, -1, -1):
            n, more = active[t], active[t + 1] if t + 1 < len(active) else 0
            behind[t] = np.repeat(pairs[None, :, 0], n, axis=0)
            if more:
                behind[t][:more] = _log_sum(pairs + (unary[begin[:more] + t + 1] + behind[t + 1])[:, None, :], 2)
            total[more:n] = _log_sum(ahead[t][more:n] + pairs[:, 0], 1)
        by_place, by_pair, value = np.zeros_like(unary), np.zeros_like(pairs), -total.sum()
        for t, n in enumerate(active):
            at, own = begin[:n] + t, labels[begin[:n] + t]
            by_place[at] -= np.exp(ahead[t] + behind[t] - total[:n, None])
            by_place[at, own] += 1
            value += unary[at, own].sum()
            before = labels[at - 1] if t else np.zeros(n, np.int64)
            np.add.at(by_pair, (before, own), 1)
            value += pairs[before, own].sum()
            if t:
                by_pair -= np.exp(ahead[t - 1][:n, :, None] + pairs + (unary[at] + behind[t])[:, None, :] - total[:n, None, None]).sum(axis=0)
            else:
                by_pair[0] -= np.exp(pairs[0] + unary[at] + behind[t] - total[:n, None]).sum(axis=0)
            last = lengths[:n] == t + 1
            np.add.at(by_pair, (own[last], 0), 1)
            value += pairs[own[last], 0].sum()
            by_pair[:, 0] -= np.exp(ahead[t][last] + pairs[:, 0] - total[:n][last, None]).sum(axis=0)
        return float(value), by_place, np.where(self.allowed, by_pair, 0)

    @classmethod
    def fitted(cls, features: np.ndarray, first: np.ndarray, labels: np.ndarray, size: int, allowed: np.ndarray) -> Chain:
        """Weights of ``size`` features, with decaying squares; the same rows in the same order give the same weights."""
        chain = cls(np.zeros((size, len(allowed))), np.zeros(allowed.shape), allowed)
        if not len(features):
            return chain
        parts = [chain.weights, chain.pairs]
        mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        used, place = np.unique(features), np.argsort(features, axis=None, kind="stable")
        bounds = np.searchsorted(features.reshape(-1)[place], used)
        place //= features.shape[1]
        for turn in range(1, ROUNDS + 1):
            _, by_place, by_pair = chain.likelihood(features, first, labels)
            by_weight = np.zeros_like(chain.weights)
            by_weight[used] = np.add.reduceat(by_place[place], bounds)
            for part, gradient, m, s in zip(parts, [by_weight, by_pair], mean, square, strict=True):
                gradient = gradient / len(first) - DECAY * part
                m += 0.1 * (gradient - m)
                s += 0.01 * (gradient * gradient - s)
                part += RATE * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.99**turn)) + 1e-8)
        return chain

    def decoded(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best labels of all sequences. Ties go to the smaller label."""
        unary, pairs, lengths = self.unary(features), self.scores, np.diff(first)
        out = np.zeros(len(features), np.int64)
        order = np.argsort(-lengths, kind="stable")
        begin, lengths = first[:-1][order], lengths[order]
        lo = 0
        while lo < len(lengths) and lengths[lo]:
            hi = int(np.searchsorted(-lengths, -(lengths[lo] // 2), "left"))
            self._best_of(unary, pairs, begin[lo:hi], lengths[lo:hi], out)
            lo = hi
        return out

    @staticmethod
    def _best_of(unary: np.ndarray, pairs: np.ndarray, begin: np.ndarray, lengths: np.ndarray, out: np.ndarray) -> None:
        """Viterbi over sequences of falling length, all at a time."""
        score, back = pairs[0] + unary[begin], []
        label = np.zeros(len(begin), np.int64)
        done = len(begin)
        for t in range(1, int(lengths[0]) + 1):
            n = int(np.searchsorted(-lengths, -t, "left"))
            label[n:done] = (score[n:done] + pairs[:, 0]).argmax(axis=1)
            done = n
            if n:
                ways = score[:n, :, None] + pairs
                back.append(ways.argmax(axis=1).astype(np.int8))
                score = ways.max(axis=1) + unary[begin[:n] + t]
        for t in range(int(lengths[0]) - 1, -1, -1):
            n = int(np.searchsorted(-lengths, -t, "left"))
            out[begin[:n] + t] = label[:n]
            if t:
                label[:n] = back[t - 1][np.arange(n), label[:n]]
