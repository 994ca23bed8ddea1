"""Product codes against plain rounds over every entry."""

import hashlib
import math
import random

import numpy as np
import pytest

from trialframe.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, n long, vector int"


def plain(rows, parts, entries, rounds):
    """(vec_id, code, error, label_error) of each usable row and the digest, one part and entry at a time."""
    usable = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    usable.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(256 * v) for v in r[1]] for r in usable]
    width = len(ints[0]) // parts
    cut = [[v[p * width : p * width + width] for p in range(parts)] for v in ints]
    books = [[cut[e][p] for e in range(min(entries, len(cut)))] for p in range(parts)]

    def assign():
        out = []
        for v in cut:
            best = [min((sum((a - b) ** 2 for a, b in zip(v[p], c)), e) for e, c in enumerate(books[p])) for p in range(parts)]
            out.append(best)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, b in zip(cut, found) if b[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    found = assign()
    errors = [sum(d for d, _ in b) for b in found]
    by_label = {}
    for r, e in zip(usable, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for part in books for entry in part for x in entry).encode()).hexdigest()
    codes = ["".join(f"{e:02x}" for _, e in b) for b in found]
    return sorted(((str(r[0]), c, e, by_label[r[2]]) for r, c, e in zip(usable, codes, errors))), digest


def rows_of(seed, n, width=8):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(5)]
    out = []
    for k in range(n):
        v = [float(np.float32(c + rng.gauss(0, 0.2))) for c in rng.choice(centres)]
        out.append((k * 7 % (n + 3), v, rng.choice([1, 2, 2, 2, None])))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)


def compare(spark, rows, **sizes):
    want, digest = plain(rows, **sizes)
    got = vc.compress(frame(spark, rows), **sizes).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_against_plain_rounds(spark):
    compare(spark, rows_of(1, 150), parts=4, entries=8, rounds=2)


def test_more_rounds_and_shuffle_joins(spark, staged_path):
    compare(spark, rows_of(2, 90), parts=2, entries=5, rounds=5)


def test_left_out_rows_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = rows_of(3, 20)
    rows += [rows[0], rows[0], (None, rows[1][1], 2), (1, None, 1), (2, [1.0] * 7 + [None], 1), (3, [nan] * 8, 1), (4, [0.0] * 7 + [-inf], 1)]
    rows += [(100 + k, [0.5] * 8, None) for k in range(6)]
    compare(spark, rows, parts=4, entries=8, rounds=2)


def test_fewer_rows_than_entries_and_no_rows(spark):
    compare(spark, rows_of(4, 3), parts=4, entries=64, rounds=2)
    assert vc.compress(frame(spark, rows_of(4, 3)).limit(0)).collect() == []
    assert vc.compress(frame(spark, [(1, None, 1)])).collect() == []


def test_vectors_that_do_not_fit_are_errors(spark):
    with pytest.raises(ValueError, match="equal parts"):
        vc.compress(frame(spark, [(1, [1.0] * 7, 1)]), parts=4)
    with pytest.raises(Exception, match="components among"):
        vc.compress(frame(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)]), parts=4).collect()
    with pytest.raises(Exception, match="a component of"):
        vc.compress(frame(spark, [(1, [3e38] * 8, 1)]), parts=4).collect()


def test_bounds_are_below_every_other_distance_and_save_scans():
    rng = np.random.default_rng(3)
    centres = rng.integers(-3000, 3000, (3, 2, 6, 4))
    x = np.concatenate([centres[0][:, e][None] + rng.integers(-60, 60, (200, 2, 4)) for e in range(6)])
    history = [centres[0]]
    codes = vc.Codes.unknown(x)
    codes.assign(history)
    assert codes.scans == x.shape[0] * 2
    for _ in range(4):  # entries wander out and come back: the net displacement stays small
        history.append(centres[0] + rng.integers(-40, 40, centres[0].shape))
        before = codes.scans
        errors = codes.assign(history)
        assert codes.scans - before < 0.2 * x.shape[0] * 2
        for p in range(2):
            every = vc.squared_distances(x[:, p], history[-1][p])
            assert (codes.code[:, p] == every.argmin(axis=1)).all()
            assert (errors[:, p] == every.min(axis=1)).all()
    moves = vc.net_moves(history, 4, 0)
    steps = sum(vc.net_moves(history, k + 1, k) for k in range(4))
    assert (moves <= steps * (1 + 1e-9)).all() and moves.sum() < 0.8 * steps.sum()


def test_distances_are_exact_beyond_doubles():
    big = np.array([[vc.MOST - 1, -(vc.MOST - 1), 12345, 1]])
    entries = np.array([[-(vc.MOST - 1), vc.MOST - 1, -777, 0], [0, 0, 0, 0]])
    want = [sum((int(a) - int(b)) ** 2 for a, b in zip(big[0], e)) for e in entries]
    assert vc.squared_distances(big, entries).tolist() == [want]


def test_hot_and_cold_labels_are_joined_alike(spark):
    rows = [(k, [float(k % 5)] * 8, 1 if k % 3 else 1000 + k) for k in range(4000)]
    got = vc.compress(frame(spark, rows), parts=4, entries=4).collect()
    errors = {}
    for r in got:
        label = rows[r.vec_id][2]
        errors.setdefault(label, []).append((r.error, r.label_error))
    assert len(got) == 4000
    for found in errors.values():
        assert {w for _, w in found} == {sum(e for e, _ in found)}
