"""A linear-chain conditional random field with two labels, in numpy.

Sequences are given one after another: ``score`` holds the log-odds of label 1 that the features of each
position give, ``lengths`` the sequences' lengths, ``trans`` the 2 x 2 log-potentials of neighbouring labels.
All sequences move one position at a time together, longest first, so that the ones still running are a prefix.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, log

import numpy as np

FEW = 6  # sequences still running, from which on plain floats are faster than arrays


def _log_add(a: float, b: float) -> float:
    top = a if a > b else b
    return top + log(exp(a - top) + exp(b - top))


def _ratios(score: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log(alpha(1) / alpha(0)) and log(beta(1) / beta(0)) of each position."""
    t00, t01, t10, t11 = (float(x) for x in trans.ravel())
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    ahead, back = np.empty_like(score), np.zeros_like(score)
    steps = int(lengths[0]) if len(lengths) else 0
    running = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than t
    switch = int(np.searchsorted(-running, -FEW, side="left"))  # positions from here on are done with plain floats
    for t in range(min(switch, steps)):
        at = starts[: running[t]] + t
        if t:
            before = ahead[at - 1]
            ahead[at] = score[at] + np.logaddexp(t01, t11 + before) - np.logaddexp(t00, t10 + before)
        else:
            ahead[at] = score[at]
    if switch < steps:
        for s, n in zip(starts[: running[switch]].tolist(), lengths[: running[switch]].tolist(), strict=True):
            own = score[s + switch : s + n].tolist()
            now = ahead[s + switch - 1] if switch else None
            for i, x in enumerate(own):
                now = x if now is None else x + _log_add(t01, t11 + now) - _log_add(t00, t10 + now)
                own[i] = now
            ahead[s + switch : s + n] = own
            own, now = score[s + switch : s + n].tolist(), 0.0
            out = [0.0] * len(own)
            for i in range(len(own) - 2, -1, -1):
                now = own[i + 1] + now
                now = _log_add(t10, t11 + now) - _log_add(t00, t01 + now)
                out[i] = now
            back[s + switch : s + n] = out
    for t in range(min(switch, steps) - 1, -1, -1):
        if t + 1 < steps:
            at = starts[: running[t + 1]] + t
            after = score[at + 1] + back[at + 1]
            back[at] = np.logaddexp(t10, t11 + after) - np.logaddexp(t00, t01 + after)
    return ahead, back


def marginals(score: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Forward-backward: the probability of label 1 at each position."""
    lengths = np.asarray(lengths, dtype=np.int64)
    lengths = lengths[lengths > 0]
    ahead, back = _ratios(np.asarray(score, dtype=np.float64), lengths, trans)
    return 1.0 / (1.0 + np.exp(-np.clip(ahead + back, -60, 60)))


def pair_sums(score: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The marginals, and the expected number of each pair of neighbouring labels (2 x 2)."""
    lengths = lengths[lengths > 0]
    ahead, back = _ratios(score, lengths, trans)
    p = 1.0 / (1.0 + np.exp(-np.clip(ahead + back, -60, 60)))
    last = np.zeros(len(score), dtype=bool)
    last[np.cumsum(lengths) - 1] = True
    left = np.flatnonzero(~last)
    a, b = ahead[left], score[left + 1] + back[left + 1]
    logs = np.stack([np.full(len(left), trans[0, 0]), trans[0, 1] + b, trans[1, 0] + a, trans[1, 1] + a + b])
    logs -= logs.max(axis=0)
    weights = np.exp(logs)
    weights /= weights.sum(axis=0)
    return p, weights.sum(axis=1).reshape(2, 2)


def fit(
    scores: Callable[[np.ndarray], np.ndarray], gradient: Callable[[np.ndarray], np.ndarray], size: int, labels: np.ndarray,
    lengths: np.ndarray, *, steps: int = 100, rate: float = 0.1, l2: float = 1e-4, start: tuple[np.ndarray, np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Maximise the conditional log-likelihood by Adam over all sequences: weights and transitions.

    ``scores(w)`` gives the log-odds of all positions, ``gradient(g)`` carries a gradient of the scores back
    to the weights.
    """
    w, trans = start or (np.zeros(size), np.zeros((2, 2)))
    lengths = np.asarray(lengths, dtype=np.int64)
    last = np.zeros(len(labels), dtype=bool)
    last[np.cumsum(lengths[lengths > 0]) - 1] = True
    left = np.flatnonzero(~last)
    seen = np.bincount(labels[left] * 2 + labels[left + 1], minlength=4).reshape(2, 2)
    m, v = np.zeros(size + 4), np.zeros(size + 4)
    for step in range(1, steps + 1):
        p, pairs = pair_sums(scores(w), lengths, trans)
        g = np.concatenate([gradient(labels - p), (seen - pairs).ravel()]) / len(labels)
        g -= l2 * np.concatenate([w, trans.ravel()])
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, trans = w + move[:size], trans + move[size:].reshape(2, 2)
    return w, trans


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton's method; x has a column of ones."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w = w + np.clip(step, -5, 5)
    return w
