"""A linear-chain conditional random field over sparse features, trained and decoded in numpy batches.

A sequence is a list of positions, a position a list of feature numbers. The score of a labelling is
the sum of the weights (feature, label) of all positions and of the transitions between neighbours.
Training maximises the regularised conditional likelihood with exact forward-backward gradients;
decoding is Viterbi over many padded sequences at once.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

#: Feature numbers are hashes of names below this bound.
WIDTH = 1 << 17
#: Steps of the padded sequences that are decoded at once; a longer sequence is decoded by itself.
PADDED_STEPS = 500_000


def feature(name: str) -> int:
    return zlib.crc32(name.encode()) % WIDTH


@dataclass
class Sequences:
    """Positions of many sequences in one row: features ids[starts[p]:starts[p + 1]], sequence s at bounds[s]:bounds[s + 1]."""

    ids: np.ndarray
    starts: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, sequences: list[list[list[int]]]) -> Sequences:
        positions = [p for s in sequences for p in s]
        return cls(
            np.fromiter((f for p in positions for f in p), dtype=np.int64),
            np.concatenate(([0], np.cumsum([len(p) for p in positions], dtype=np.int64))),
            np.concatenate(([0], np.cumsum([len(s) for s in sequences], dtype=np.int64))),
        )


class ChainCRF:
    def __init__(self, n_labels: int):
        self.weights = np.zeros((WIDTH, n_labels), dtype=np.float32)
        self.transitions = np.zeros((n_labels, n_labels), dtype=np.float32)
        self.first = np.zeros(n_labels, dtype=np.float32)

    def _scores(self, data: Sequences) -> np.ndarray:
        """Scores (position, label)."""
        sums = np.zeros((len(data.ids) + 1, self.weights.shape[1]))
        np.cumsum(self.weights[data.ids], axis=0, dtype=np.float64, out=sums[1:])
        return sums[data.starts[1:]] - sums[data.starts[:-1]]

    @staticmethod
    def _padded(bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each step of the sequences ``which`` in the row of positions, and which steps exist."""
        lengths = bounds[which + 1] - bounds[which]
        step = np.arange(lengths.max())
        real = step < lengths[:, None]
        return np.where(real, bounds[which][:, None] + step, 0), real

    def decode(self, data: Sequences, batch: int = 512) -> np.ndarray:
        """The best label of every position."""
        return self.best_labels(self._scores(data), data.bounds, batch)

    def best_labels(self, scores: np.ndarray, bounds: np.ndarray, batch: int = 512) -> np.ndarray:
        """The best label of every position by the scores (position, label) of sequences one after the other."""
        labels = np.zeros(len(scores), dtype=np.int64)
        lengths = np.diff(bounds)
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        lo = 0
        while lo < len(order):
            count = min(batch, len(order) - lo)
            while count > 1 and count * lengths[order[lo + count - 1]] > PADDED_STEPS:
                count //= 2
            which = order[lo : lo + count]
            lo += count
            at, real = self._padded(bounds, which)
            best = scores[at[:, 0]] + self.first
            back = np.zeros((at.shape[1], len(which), len(self.first)), dtype=np.int8)
            for t in range(1, at.shape[1]):
                paths = best[:, :, None] + self.transitions
                back[t] = paths.argmax(axis=1)
                best = np.where(real[:, t, None], paths.max(axis=1) + scores[at[:, t]], best)
                back[t][~real[:, t]] = np.arange(len(self.first))
            label = best.argmax(axis=1)
            for t in range(at.shape[1] - 1, -1, -1):
                labels[at[real[:, t], t]] = label[real[:, t]]
                label = back[t][np.arange(len(which)), label]
        return labels

    def undecided(self, scores: np.ndarray) -> np.ndarray:
        """Positions of one row of sequences at which a label other than 0 may be best; at all others 0 is. Exact: what a stretch of other labels
        can gain on the zeros in its place is at most the sum of what its positions and the steps to them gain, and the step back."""
        stay = self.transitions[0, 0]
        into = np.maximum(self.transitions.max(axis=0), self.first - self.first[0] + stay)[1:] - stay
        back = max(0.0, float((self.transitions[1:, 0] - stay).max()))
        gain = (scores[:, 1:] - scores[:, :1] + into).max(axis=1).astype(np.float64)
        so_far, to_come = np.cumsum(gain), np.cumsum(gain[::-1])
        low = lambda sums: np.minimum.accumulate(np.concatenate(([0.0], sums[:-1])))
        return so_far - low(so_far) + (to_come - low(to_come))[::-1] - gain + back > -1e-3

    def _gradient(self, scores: np.ndarray, at: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected label and transition counts under the model: marginals (sequence, step, label), transitions, first labels."""
        n, steps = at.shape
        k = len(self.first)
        forward, scale = np.zeros((n, steps, k)), np.ones((n, steps))
        emit = np.exp(scores[at] - scores[at].max(axis=2, keepdims=True))
        move = np.exp(self.transitions.astype(np.float64))
        forward[:, 0] = np.exp(self.first) * emit[:, 0]
        scale[:, 0] = forward[:, 0].sum(axis=1)
        forward[:, 0] /= scale[:, :1]
        for t in range(1, steps):
            forward[:, t] = np.where(real[:, t, None], (forward[:, t - 1] @ move) * emit[:, t], forward[:, t - 1])
            scale[:, t] = np.where(real[:, t], forward[:, t].sum(axis=1), 1)
            forward[:, t] /= scale[:, t, None]
        backward = np.ones((n, steps, k))
        pairs = np.zeros((k, k))
        for t in range(steps - 1, 0, -1):
            weighted = emit[:, t] * backward[:, t] / scale[:, t, None]
            on = real[:, t]
            pairs += (forward[on, t - 1].T @ weighted[on]) * move
            backward[:, t - 1] = np.where(on[:, None], weighted @ move.T, backward[:, t])
        marginals = forward * backward
        return marginals, pairs, marginals[:, 0].sum(axis=0)

    def fit(self, data: Sequences, labels: np.ndarray, epochs: int = 10, rate: float = 0.07, decay: float = 1e-6, batch: int = 200, seed: int = 5) -> ChainCRF:
        """Adam over batches of sequences with a falling rate; the same data give the same model."""
        every = np.flatnonzero(np.diff(data.bounds))
        k, rng = len(self.first), np.random.default_rng(seed)
        parts = [self.weights, self.transitions, self.first]
        moments = [(np.zeros(p.shape, np.float32), np.zeros(p.shape, np.float32)) for p in parts]
        step, steps = 0, epochs * -(-len(every) // batch)
        for _ in range(epochs):
            order = rng.permutation(every)
            for lo in range(0, len(order), batch):
                some, truth = self._part(data, labels, order[lo : lo + batch])
                at, real = self._padded(some.bounds, np.arange(len(some.bounds) - 1))
                marginals, pairs, first = self._gradient(self._scores(some), at, real)
                expected = np.zeros((len(truth), k))
                expected[at[real]] = marginals[real]
                off = (np.eye(k)[truth] - expected)[np.repeat(np.arange(len(truth)), np.diff(some.starts))]
                slope = np.stack([np.bincount(some.ids, weights=off[:, j], minlength=WIDTH) for j in range(k)], axis=1)
                true_pairs = np.zeros((k, k))
                follows = np.setdiff1d(np.arange(1, len(truth)), some.bounds)
                np.add.at(true_pairs, (truth[follows - 1], truth[follows]), 1)
                true_first = np.bincount(truth[some.bounds[:-1]], minlength=k)
                n, step = len(truth), step + 1
                pace = rate * (1 - (step - 1) / steps)
                for part, grad, (m, v) in zip(parts, (slope / n - decay * self.weights, (true_pairs - pairs) / n, (true_first - first) / n), moments):
                    m += 0.1 * (grad - m)
                    v += 0.01 * (grad * grad - v)
                    part += (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    @staticmethod
    def _part(data: Sequences, labels: np.ndarray, which: np.ndarray) -> tuple[Sequences, np.ndarray]:
        """The sequences ``which`` with their labels."""
        positions = np.concatenate([np.arange(data.bounds[s], data.bounds[s + 1]) for s in which])
        lengths = data.starts[positions + 1] - data.starts[positions]
        starts = np.concatenate(([0], np.cumsum(lengths)))
        ids = data.ids[np.repeat(data.starts[positions] - starts[:-1], lengths) + np.arange(starts[-1])]
        return Sequences(ids, starts, np.concatenate(([0], np.cumsum(data.bounds[which + 1] - data.bounds[which])))), labels[positions]
