"""A two-label linear-chain conditional random field over the words of texts, in NumPy.

All texts of a slice form one chain; a text's first word starts anew. With two labels the forward
and backward messages are ratios, and a step of either is a fraction of linear terms, that is a
2 x 2 matrix. The chain is folded into rows: the matrices of each row are multiplied for all rows
at once, the short chain of rows is followed, and a second pass gives the ratio at each word.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from .words import hash_spans, mix, seeds, text_bytes, word_spans
from .words import _LOWER

BITS = 20
PENALTY = 1.0
PREFIXES = (3, 4, 5, 6, 7, 8)
_U = np.uint64


@dataclass
class Chain:
    """Features of the words of some texts."""

    features: np.ndarray  # places in the weight table, one row per kind of feature
    first: np.ndarray  # True at a text's first word
    counts: np.ndarray  # words of each text
    starts: np.ndarray  # bytes from the start of its text
    ends: np.ndarray
    around: np.ndarray  # hash of the words before and after


def chain(texts: pa.Array) -> Chain:
    """Hashed features: the word and its first 3 to 8 bytes; neighbours count through the chain."""
    data, bounds = text_bytes(texts)
    low = _LOWER[data]
    starts, ends = word_spans(low, bounds)
    at = np.searchsorted(starts, bounds)
    counts = np.diff(at)
    first = np.zeros(len(starts), bool)
    first[at[:-1][counts > 0]] = True
    salts = seeds(len(PREFIXES) + 1, 4242)
    word = hash_spans(low, starts, ends)
    kinds = [word ^ salts[0]]
    for j, n in enumerate(PREFIXES):
        kinds.append(hash_spans(low, starts, np.minimum(ends, starts + n)) ^ salts[1 + j])
    places = np.stack([(mix(k) >> _U(64 - BITS)).astype(np.int32) for k in kinds]) if len(word) else np.zeros((len(kinds), 0), np.int32)
    base = np.repeat(bounds[:-1], counts)
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:], after[:-1] = np.where(first[1:], _U(0), word[:-1]), np.where(first[1:], _U(0), word[1:])
    return Chain(places, first, counts, starts - base, ends - base, mix(before * salts[0] + after))


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    bias: float = -3.0
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # log potentials of label pairs
    document: np.ndarray = field(default_factory=lambda: np.zeros(4))  # of the document score


def _ratios(e: np.ndarray, first: np.ndarray, m: np.ndarray) -> np.ndarray:
    """x[t] = e[t] (m01 + m11 x[t-1]) / (m00 + m10 x[t-1]); at a first word x[t] = e[t]."""
    n = len(e)
    if not n:
        return np.zeros(0)
    length = max(1, int(np.sqrt(n)))
    rows = -(-n // length)
    fill = rows * length - n
    e2 = np.concatenate((e, np.ones(fill))).reshape(rows, length).T.copy()
    f2 = np.concatenate((first, np.ones(fill, bool))).reshape(rows, length).T.copy()
    # The product of a row's matrices [[a, b], [c, d]]; x becomes (a x + b) / (c x + d).
    a, b, c, d = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for t in range(length):
        new, et = f2[t], e2[t]
        na = np.where(new, et * c, et * (m[1, 1] * a + m[0, 1] * c))
        nb = np.where(new, et * d, et * (m[1, 1] * b + m[0, 1] * d))
        nc = np.where(new, c, m[1, 0] * a + m[0, 0] * c)
        nd = np.where(new, d, m[1, 0] * b + m[0, 0] * d)
        scale = 1.0 / (na + nb + nc + nd)
        a, b, c, d = na * scale, nb * scale, nc * scale, nd * scale
    enter = np.zeros(rows)
    x = 0.0
    for r, (ar, br, cr, dr) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
        enter[r] = x
        x = (ar * x + br) / (cr * x + dr)
    out = np.empty((length, rows))
    x = enter
    for t in range(length):
        x = np.where(f2[t], e2[t], e2[t] * (m[0, 1] + m[1, 1] * x) / (m[0, 0] + m[1, 0] * x))
        out[t] = x
    return out.T.ravel()[:n]


def marginals(e: np.ndarray, first: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of label 1 at each word; forward ratio; backward ratio with the word's own e."""
    last = np.append(first[1:], True)
    forward = _ratios(e, first, m)
    backward = _ratios(e[::-1], last[::-1], m.T)[::-1]
    odds = forward * backward / e
    return odds / (1.0 + odds), forward, backward


def _emissions(model: Model, c: Chain) -> np.ndarray:
    score = np.full(c.features.shape[1], model.bias)
    for line in c.features:
        score += model.weights[line]
    return np.exp(np.clip(score, -30, 30))


def tag(model: Model, c: Chain) -> np.ndarray:
    return marginals(_emissions(model, c), c.first, np.exp(model.step))[0]


def _totals(values: np.ndarray, counts: np.ndarray, reduce) -> np.ndarray:
    out = np.zeros(len(counts))
    some = counts > 0
    if some.any():
        out[some] = reduce.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def document_features(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text: 1, the highest marginal, log of the expected and of the likely number of tags."""
    tags = (p >= 0.5).astype(np.float64)
    return np.stack([
        np.ones(len(counts)), _totals(p, counts, np.maximum),
        np.log1p(_totals(p, counts, np.add)), np.log1p(_totals(tags, counts, np.add)),
    ], axis=1)


def document_scores(model: Model, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(document_features(p, counts) @ model.document, -30, 30)))


def word_labels(chains: list[Chain], toxic: np.ndarray, ratio: float = 40.0, least: int = 4) -> list[np.ndarray]:
    """Labels of words from labels of texts: 1 in a toxic text for a word of which a feature is at least
    ``ratio`` times as frequent in toxic texts as in others.

    A feature counts once for each pair of words that it stands between, so copies of a text, near
    ones too, do not make its words toxic.
    """
    texts = np.concatenate([np.repeat(np.arange(len(c.counts)), c.counts) + at for c, at in zip(chains, _starts(chains), strict=True)])
    label = toxic[texts].astype(bool)
    around = np.concatenate([c.around for c in chains])
    seen = np.zeros((2, 1 << BITS))
    for j in range(len(chains[0].features)):
        line = np.concatenate([c.features[j] for c in chains]).astype(np.int64)
        for y in (0, 1):
            own = line[label == y]
            _, first = np.unique(around[label == y] ^ mix(own.astype(_U)), return_index=True)
            seen[y] += np.bincount(own[first], minlength=1 << BITS)
    many = np.maximum(np.bincount(toxic.astype(int), minlength=2), 1)
    strong = (seen[1] >= least) & ((seen[1] + 0.5) / many[1] >= ratio * (seen[0] + 0.5) / many[0])
    out, at = [], 0
    for c in chains:
        n = c.features.shape[1]
        out.append((label[at : at + n] & strong[c.features].any(axis=0)).astype(np.float64))
        at += n
    return out


def _starts(chains: list[Chain]) -> list[int]:
    """Number of texts before each chain."""
    return np.cumsum([0, *[len(c.counts) for c in chains[:-1]]]).tolist()


def fit(chains: list[Chain], toxic: np.ndarray, rounds: int = 40, rate: float = 0.5) -> Model:
    """Maximise the likelihood of the word labels by adaptive gradient steps, then fit the score."""
    model = Model()
    labels = word_labels(chains, toxic)
    squares = np.full(1 << BITS, 1e-6, np.float32)
    other = np.full(5, 1e-6)
    n = max(1, sum(len(y) for y in labels))
    for _ in range(rounds):
        gradient = np.zeros(1 << BITS)
        small = np.zeros(5)
        m = np.exp(model.step)
        for c, y in zip(chains, labels, strict=True):
            if not len(y):
                continue
            p, forward, backward = marginals(_emissions(model, c), c.first, m)
            miss = y - p
            for line in c.features:
                gradient += np.bincount(line, weights=miss, minlength=1 << BITS)
            small[0] += miss.sum()
            inner = np.flatnonzero(~c.first)
            left, right = forward[inner - 1], backward[inner]
            joint = np.stack([np.full(len(inner), m[0, 0]), m[0, 1] * right, left * m[1, 0], left * m[1, 1] * right])
            joint /= joint.sum(axis=0)
            pair = (2 * y[inner - 1] + y[inner]).astype(int)
            small[1:] += np.bincount(pair, minlength=4) - joint.sum(axis=1)
        gradient -= PENALTY * model.weights
        squares += (gradient.astype(np.float32)) ** 2
        model.weights += (rate * gradient / np.sqrt(squares)).astype(np.float32)
        small /= n
        other += small**2
        delta = 0.2 * small / np.sqrt(other)
        model.bias += delta[0]
        model.step += delta[1:].reshape(2, 2)
    x = np.concatenate([document_features(tag(model, c), c.counts) for c in chains])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        s = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (s * (1 - s))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        beta += np.linalg.solve(hessian, x.T @ (toxic - s) - 0.05 * beta)
    model.document = beta
    return model
