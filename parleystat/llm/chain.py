"""Two-label linear chains over any number of tokens: exact marginals by a scan over blocks.

A step of the forward recursion is a 2-by-2 matrix, and matrices can be multiplied in any grouping. The tokens are cut
into blocks that advance together, one token at a time; the blocks' products then give what enters each block. So the
number of numpy calls grows with the square root of the tokens and not with the longest text.
"""

from __future__ import annotations

import numpy as np

#: Largest log-odds a token's own evidence or a tie may have, so that no product leaves the range of a double.
STEEPEST = 40.0


def _filtered(odds: np.ndarray, begins: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """The chance of label 1 at each token given the tokens up to it. `begins` marks tokens without a predecessor."""
    n = len(odds)
    length = max(1, int(np.sqrt(n) / 3))  # a step costs more than a block
    blocks = -(-n // length)
    padded = np.ones(blocks * length)
    padded[:n] = odds
    fresh = np.zeros(blocks * length, bool)
    fresh[:n] = begins
    odds, fresh = padded.reshape(blocks, length).T, fresh.reshape(blocks, length).T
    steps = [[np.where(fresh, 1.0, ties[a, b]) for b in (0, 1)] for a in (0, 1)]
    rows = [[np.full(blocks, float(a == b)) for b in (0, 1)] for a in (0, 1)]
    for t in range(length):
        for row in rows:
            zero, one = row[0] * steps[0][0][t] + row[1] * steps[1][0][t], (row[0] * steps[0][1][t] + row[1] * steps[1][1][t]) * odds[t]
            row[0], row[1] = zero, one
        whole = rows[0][0] + rows[0][1] + rows[1][0] + rows[1][1]
        for row in rows:
            row[0], row[1] = row[0] / whole, row[1] / whole
    enter, x, y = [], 0.5, 0.5  # the first token begins a text, so what is put in here does not matter
    for a, b, c, d in zip(*(rows[i][j].tolist() for i in (0, 1) for j in (0, 1))):
        enter.append((x, y))
        x, y = x * a + y * c, x * b + y * d
        x, y = x / (x + y), y / (x + y)
    out = np.empty((length, blocks))
    zero, one = np.array(enter).T
    for t in range(length):
        zero, one = zero * steps[0][0][t] + one * steps[1][0][t], (zero * steps[0][1][t] + one * steps[1][1][t]) * odds[t]
        whole = zero + one
        zero, one = zero / whole, one / whole
        out[t] = one
    return out.T.reshape(-1)[:n]


def marginals(evidence: np.ndarray, begins: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per token the chance of label 1, and the expected counts of neighbouring label pairs.

    `evidence` is a token's log-odds of label 1 by itself, `begins` says where a text starts, `ties[a, b]` is the log
    weight of label b after label a. No tokens give no chances.
    """
    if not len(evidence):
        return np.empty(0), np.zeros((2, 2))
    odds = np.exp(np.clip(evidence, -STEEPEST, STEEPEST))
    weights = np.exp(np.clip(ties, -STEEPEST, STEEPEST))
    ends = np.append(begins[1:], True)
    ahead = _filtered(odds, begins, weights)
    behind = _filtered(odds[::-1], ends[::-1], weights.T)[::-1]
    one, zero = ahead * behind, (1 - ahead) * (1 - behind) * odds  # the token's own odds count in both
    chance = one / (one + zero)
    at = np.flatnonzero(~ends)
    before, after = (1 - ahead[at], ahead[at]), (1 - behind[at + 1], behind[at + 1])
    joint = np.array([[before[a] * weights[a, b] * after[b] for b in (0, 1)] for a in (0, 1)])
    return chance, (joint / joint.sum(axis=(0, 1))).sum(axis=2)
