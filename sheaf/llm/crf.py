"""Inference in linear-chain conditional random fields, over many sequences of different lengths at once.

Sequence i is rows ``at[i]:at[i + 1]`` of the emission scores; step t handles the t-th row of every sequence that long.
"""

from __future__ import annotations

import numpy as np


def _over_labels(x, f):
    """``f`` (add or maximum) over each row's few labels, column by column: numpy's loop along a short axis is slow."""
    if not 0 < x.shape[1] < 8:  # from eight on numpy adds in another order
        return f.reduce(x, axis=1, keepdims=True)
    out = x[:, :1].copy()
    for c in range(1, x.shape[1]):
        f(out, x[:, c:c + 1], out=out)
    return out


def posteriors(emission, at, start, step, pairs=None):
    """Forward-backward over many sequences at once; sequence i is emission[at[i]:at[i + 1]]. Returns the marginals.

    ``pairs``, if given, gets the expected number of each transition added. Rows are put in the order of their steps first:
    a step's rows are then one slice.
    """
    length = np.diff(at)
    order = np.argsort(-length, kind="stable")
    first, length = at[:-1][order], length[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # sequences longer than t
    begin = np.concatenate([[0], np.cumsum(active)]).astype(np.int64)
    nth = np.repeat(np.arange(steps), active)
    rows = first[np.arange(begin[-1]) - begin[nth]] + nth
    p = emission[rows]
    if len(p):
        p = np.exp(p - _over_labels(p, np.maximum))
    out = np.empty_like(p)
    prior = np.broadcast_to(start, (len(first), len(start)))
    for t in range(steps):
        a = out[begin[t]:begin[t + 1]]
        np.multiply(prior[:len(a)], p[begin[t]:begin[t + 1]], out=a)
        a /= _over_labels(a, np.add)
        prior = a @ step
    backward = np.ones((len(first), len(start)), dtype=p.dtype)
    back = step.T
    for t in range(steps - 1, -1, -1):
        m = out[begin[t]:begin[t + 1]]
        n = len(m)
        b = backward[:n]
        m *= b
        m /= _over_labels(m, np.add)
        b = p[begin[t]:begin[t + 1]] * b
        if pairs is not None and t:
            both = out[begin[t - 1]:begin[t - 1] + n][:, :, None] * step * b[:, None, :]
            pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = b @ back
        np.divide(b, _over_labels(b, np.add), out=backward[:n])
    marginals = np.empty_like(out)
    marginals[rows] = out
    return marginals


def viterbi(emission, at, start, step):
    """Best label of every row: ``start`` and ``step`` are log scores of first labels and of transitions."""
    length = np.diff(at)
    order = np.argsort(-length, kind="stable")
    first, length = at[:-1][order], length[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # sequences longer than t
    back = np.zeros(emission.shape, dtype=np.int32)
    best = np.empty_like(emission)
    for t in range(steps):
        w = first[:active[t]] + t
        if t:
            ways = best[w - 1][:, :, None] + step
            back[w] = ways.argmax(axis=1)
            best[w] = ways.max(axis=1) + emission[w]
        else:
            best[w] = start + emission[w]
    out = np.zeros(len(emission), dtype=np.int64)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        w = first[:n] + t
        out[w] = best[w].argmax(axis=1)
        on = int(active[t + 1]) if t + 1 < steps else 0  # sequences that go on take the label their next row came from
        if on:
            out[w[:on]] = back[w[:on] + 1, out[w[:on] + 1]]
    return out
