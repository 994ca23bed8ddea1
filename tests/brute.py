"""Direct single-machine formulas for small fixtures."""

import math
from itertools import combinations

import numpy as np


def midranks(x):
    x = np.asarray(x, float)
    return np.array([np.sum(x < v) + (np.sum(x == v) + 1) / 2 for v in x])


def tie_sum(x):
    _, c = np.unique(x, return_counts=True)
    return float(np.sum(c.astype(float) ** 3 - c))


def kruskal(groups):
    x = np.concatenate(list(groups.values()))
    r, n, at, total = midranks(x), len(x), 0, 0.0
    for g in groups.values():
        total += np.sum(r[at:at + len(g)]) ** 2 / len(g)
        at += len(g)
    h = 12 / (n * (n + 1)) * total - 3 * (n + 1)
    return h / (1 - tie_sum(x) / (n**3 - n))


def dunn(groups):
    x = np.concatenate(list(groups.values()))
    r, n, at, mean = midranks(x), len(x), 0, {}
    for k, g in groups.items():
        mean[k] = np.mean(r[at:at + len(g)])
        at += len(g)
    out = {}
    for a, b in combinations(sorted(groups), 2):
        v = (n * (n + 1) / 12 - tie_sum(x) / (12 * (n - 1))) * (1 / len(groups[a]) + 1 / len(groups[b]))
        out[a, b] = (mean[a] - mean[b]) / math.sqrt(v)
    return out


def rank_sum(a, b):
    """W and z of the first sample."""
    x = np.concatenate([a, b])
    n1, n2 = len(a), len(b)
    n = n1 + n2
    w = np.sum(midranks(x)[:n1]) - n1 * (n1 + 1) / 2
    d = w - n1 * n2 / 2
    s = math.sqrt(n1 * n2 / 12 * (n + 1 - tie_sum(x) / (n * (n - 1))))
    return w, (d - np.sign(d) * 0.5) / s


def normal2(z):
    return math.erfc(abs(z) / math.sqrt(2))


def bh(ps):
    ps = np.asarray(ps, float)
    order = np.argsort(ps)
    m = len(ps)
    out = np.empty(m)
    low = 1.0
    for i in range(m - 1, -1, -1):
        low = min(low, ps[order[i]] * m / (i + 1))
        out[order[i]] = low
    return out


def sequential_ss(frame, factors, value):
    """Sequential sums of squares by least squares on the rows, all interactions by order."""
    y = frame[value].to_numpy(float)
    x = np.ones((len(y), 1))
    rank, rss = 1, float(np.sum((y - y.mean()) ** 2))
    out = []
    for size in range(1, len(factors) + 1):
        for term in combinations(factors, size):
            label = frame[list(term)].astype(str).agg("|".join, axis=1)
            x = np.hstack([x, np.array([label == v for v in label.unique()], float).T])
            fit = x @ np.linalg.lstsq(x, y, rcond=None)[0]
            new_rank, new_rss = np.linalg.matrix_rank(x), float(np.sum((y - fit) ** 2))
            out.append((":".join(term), int(new_rank - rank), rss - new_rss))
            rank, rss = new_rank, new_rss
    return [*out, ("Residuals", len(y) - int(rank), rss)]
