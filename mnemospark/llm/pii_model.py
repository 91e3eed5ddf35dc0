"""Reliabilities of labelers by expectation-maximisation, and the span classifier that is trained on them."""

from __future__ import annotations

import numpy as np

from mnemospark.llm.pii_spans import CELLS


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, trust: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern, and for each labeler the probabilities of its votes on false and true candidates.

    Each vote weighs by the log odds that it is right, as expectation-maximisation finds them; no vote is no evidence, since
    most items bear no cue at all. A prior, that weighs ``trust`` times the votes, says that labelers are right more often than wrong, and a vote never
    counts for its opposite: votes that come together by habit of one author can't turn the classes round.
    """
    for_, against = patterns == 1, patterns == -1
    logit = lambda p: np.log(p) - np.log1p(-p)
    up, down, share = np.full(patterns.shape[1], 1.2), np.full(patterns.shape[1], -1.6), 0.5
    post = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        z = logit(share) + for_ @ up + against @ down
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        done = np.abs(new - post).max() < 1e-6
        post = new
        share = float(np.clip((counts * post).sum() / counts.sum(), 0.1, 0.9))

        def odds(side: np.ndarray, belief: float) -> np.ndarray:
            mass, true = counts @ side, (counts * post) @ side
            weight = trust * mass + 10
            return logit((true + belief * weight) / (mass + weight)) - logit(share)

        up, down = np.clip(odds(for_, 0.9), 0.1, 4.0), np.clip(odds(against, 0.1), -4.0, -0.1)
        if done:
            break
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, labeler, vote
    table = np.stack([np.einsum("p,plv->lv", counts * w, onehot) + 0.01 for w in (1 - post, post)])
    return post, table / table.sum(axis=2, keepdims=True)


def rows_of(cells: list[list[int]], grid: np.ndarray) -> np.ndarray:
    """Cells of each candidate as a matrix: its features, then a cell for each vote and a constant; the last cell of all is empty."""
    n, labelers = grid.shape
    width = max((len(c) for c in cells), default=0)
    out = np.full((n, width + labelers + 1), CELLS + 3 * labelers + 1, dtype=np.int64)
    for i, c in enumerate(cells):
        out[i, : len(c)] = c
    out[:, width:-1] = CELLS + 3 * np.arange(labelers) + grid + 1
    out[:, -1] = CELLS + 3 * labelers
    return out


def train(x: np.ndarray, target: np.ndarray, size: int, ridge: float = 2e-4, rounds: int = 120) -> np.ndarray:
    """Weights of a logistic regression on soft labels over the cells of each row, by Adam on the whole sample."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    flat = x.ravel()
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(axis=1), -30, 30)))
        g = np.bincount(flat, weights=np.repeat((p - target) / len(x), x.shape[1]), minlength=size) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w[-1] = 0.0
    return w


def score(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[x].sum(axis=1), -30, 30)))
