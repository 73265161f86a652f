"""Hashed terms of texts, and a factorisation machine on them."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from tidemark.llm.flat import PUNCTUATION, Flat, words

PREFIXES = (4, 5, 6)


def terms(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) pairs of a slice: words, and starts of longer words; terms are 32-bit hashes. Repeats stay."""
    found = words(flat, PUNCTUATION + b"'", fold=True)
    texts, hashes = [found.text], [found.hash]
    for n in PREFIXES:
        long = np.flatnonzero(found.stop - found.start > n)
        start = found.start[long]
        texts.append(found.text[long])
        hashes.append(found.part(start, start + n) + np.uint64(n))
    return np.concatenate(texts), (np.concatenate(hashes) >> np.uint64(32)).astype(np.uint32)


@dataclass
class Vocabulary:
    """A bounded set of terms with fast tests: a bit table first, then a sorted list."""

    ids: np.ndarray
    bits: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.ids >> np.uint32(10)] = True

    def hits(self, text: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, place in the vocabulary) of the terms that belong to it, in order."""
        if not len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.flatnonzero(self.bits[term >> np.uint32(10)])
        place = np.searchsorted(self.ids, term[near])
        place[place == len(self.ids)] = 0
        own = self.ids[place] == term[near]
        pair = np.unique(text[near][own].astype(np.int64) * len(self.ids) + place[own])
        return pair // len(self.ids), pair % len(self.ids)


def choose_terms(text: np.ndarray, term: np.ndarray, label: np.ndarray, most: int, least_df: int = 3) -> np.ndarray:
    """The ``most`` terms that tell the labels apart best, by the z-score of their log odds."""
    ids = np.unique(term)
    place = np.searchsorted(ids, term).astype(np.int32)
    n1, n0 = label.sum(), (1 - label).sum()
    with_1 = np.bincount(place, weights=label[text], minlength=len(ids))
    df = np.bincount(place, minlength=len(ids))
    with_0 = df - with_1
    odds = np.log((with_1 + 0.5) / (n1 - with_1 + 0.5)) - np.log((with_0 + 0.5) / (n0 - with_0 + 0.5))
    score = np.abs(odds) / np.sqrt(1 / (with_1 + 0.5) + 1 / (with_0 + 0.5))
    score[df < least_df] = -1
    best = np.argsort(-score, kind="stable")[:most]
    return np.sort(ids[best[score[best] > 0]])


@dataclass
class Machine:
    """y = b + sum w_i + sum over pairs <v_i, v_j> for the terms i of a text; no factors: logistic regression."""

    vocabulary: Vocabulary
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, text: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(text, weights=self.weights[place], minlength=n)
        for v in self.factors.T:
            x = v[place]
            out += 0.5 * (np.bincount(text, weights=x, minlength=n) ** 2 - np.bincount(text, weights=x * x, minlength=n))
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(vocabulary: Vocabulary, text: np.ndarray, place: np.ndarray, label: np.ndarray, factors: int, epochs: int = 40, rate: float = 0.05,
        penalty: float = 1e-4, batch: int = 256, seed: int = 7) -> Machine:
    """Fit by minibatch AdaGrad on the logistic loss. (text, place) are sorted by text; ``label`` may be soft."""
    n, m = len(label), len(vocabulary.ids)
    rng = np.random.default_rng(seed)
    mean = np.clip(label.mean(), 1e-3, 1 - 1e-3) if n else 0.5
    machine = Machine(vocabulary, float(np.log(mean / (1 - mean))), np.zeros(m), rng.normal(0, 0.02, (m, factors)))
    g_w, g_v, g_b = np.full(m, 1e-2), np.full((m, factors), 1e-2), 1e-2
    bounds = np.searchsorted(text, np.arange(n + 1))
    for _ in range(epochs if m else 0):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            rows = order[at: at + batch]
            size = bounds[rows + 1] - bounds[rows]
            inside = np.repeat(np.arange(len(rows)), size)
            p = place[np.repeat(bounds[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            error = (sigmoid(machine.logits(inside, p, len(rows))) - label[rows]) / len(rows)
            used = np.unique(p)
            local = np.searchsorted(used, p)
            g = np.bincount(local, weights=error[inside], minlength=len(used)) + penalty * machine.weights[used]
            g_w[used] += g * g
            steps = []
            for f in range(factors):
                x = machine.factors[p, f]
                total = np.bincount(inside, weights=x, minlength=len(rows))
                steps.append(np.bincount(local, weights=error[inside] * (total[inside] - x), minlength=len(used)) + penalty * machine.factors[used, f])
            machine.weights[used] -= rate * g / np.sqrt(g_w[used])
            for f, d in enumerate(steps):
                g_v[used, f] += d * d
                machine.factors[used, f] -= rate * d / np.sqrt(g_v[used, f])
            b = error.sum()
            g_b += b * b
            machine.bias -= rate * b / np.sqrt(g_b)
    return machine
