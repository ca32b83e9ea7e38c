"""Vector codes: exact against full scans, bounds, odd rows."""

import math

import numpy as np
import pytest

from quirefold.llm import vectors
from quirefold.llm.common import load

SCHEMA = "vec_id long, embedding array<float>, label int, q string, code int"


def expected(rows, entries=64, rounds=2):
    """By full scans of every codebook in every round, on Python integers."""
    good = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    if not good:
        return [], ""
    key = lambda r: (r[0] is None, r[0] or 0, [float(np.float32(x)) for x in r[1]])
    good = sorted(good, key=key)
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    most = vectors.limit(len(good[0][1]))
    wide = -(-len(good[0][1]) // 16)
    q = [[max(-most, min(most, math.floor(float(np.float32(x)) * 256))) for x in r[1]] + [0] * (16 * wide - len(r[1])) for r in good]
    parts = [[tuple(v[p * wide : p * wide + wide]) for p in range(16)] for v in q]
    books = [[v[p] for v in parts[:entries]] for p in range(16)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (distance(v[p], books[p][e]), e)) for p in range(16)] for v in parts]
    for _ in range(rounds):
        codes = assign()
        for p in range(16):
            for e in range(len(books[p])):
                if own := [v[p] for v, c in zip(parts, codes) if c[p] == e]:
                    books[p][e] = tuple(sum(x) // len(own) for x in zip(*own))
    codes = assign()
    errors = [sum(distance(v[p], books[p][c[p]]) for p in range(16)) for v, c in zip(parts, codes)]
    totals = {}
    for r, e in zip(good, errors):
        totals[r[2]] = totals.get(r[2], 0) + e
    digest = vectors.codebooks_digest(np.array(books))
    return sorted(((r[0], "".join(f"{c:02x}" for c in code), e, totals[r[2]], digest) for r, code, e in zip(good, codes, errors)), key=repr), digest


def report(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in vectors.vector_report(table).collect()), key=repr)


def made(n, length, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(9, length)) * spread
    return [(int(i * 3), (middles[i % 9] + rng.normal(size=length) * 0.3).astype(np.float32).tolist(), [None, 1, 2][i % 3]) for i in range(n)]


@pytest.mark.parametrize(("n", "length", "spread"), [(300, 64, 0.2), (130, 20, 3.0), (40, 16, 1.0), (90, 32, 3e5)])
def test_codes_match_full_scans(spark, n, length, spread):
    rows = made(n, length, spread=spread)
    assert report(spark, rows) == expected(rows)[0]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = made(80, 16)
    rows += [(5, None, 1), (6, [], 1), (7, [1.0] * 15 + [None], 1), (8, [nan] + [1.0] * 15, 2), (9, [1.0] * 15 + [-inf], 2), (10, [1.0] * 32, 2), (None, [0.5] * 16, None), (None, [0.5] * 16, 7)]
    rows += [(0, [0.25] * 16, 1)] * 3 + rows[:5] + [(11, [3e38, -3e38] + [0.0] * 14, 3), (12, [-0.001] * 16, 3)]
    got = report(spark, rows)
    assert got == expected(rows)[0] and len(got) == 92
    assert report(spark, []) == []
    assert report(spark, [(1, None, 1)]) == []
    assert [r[1:4] for r in report(spark, [(4, [1.5] * 16, None)] * 3)] == [("00" * 16, 0, 0)] * 3


def test_query_table_and_saved_scans(spark):
    table = load(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    assert sorted((tuple(r) for r in vectors.vector_report(table).collect()), key=repr) == expected(rows)[0]


def test_bounds_hold_and_net_moves_are_tighter():
    """Over many rounds: bounds never exceed true distances, codes stay exact, and net moves scan less than added drifts."""
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(20, 64)) * 100
    x = (middles[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 64)) * 60).astype(np.int64).reshape(3000, 16, 4)
    scans = {}
    for kind in ("net", "sum"):
        history = [x[:64].transpose(1, 0, 2).copy()]
        code, lower, stamp = np.zeros((3000, 16), np.uint8), np.zeros((3000, 16)), np.zeros((3000, 16), np.uint8)
        total = 0
        net = vectors.net_moves
        try:
            if kind == "sum":
                vectors.net_moves = lambda h: np.stack([sum((np.sqrt(((b - a).astype(float) ** 2).sum(axis=2)) for a, b in zip(h[s:], h[s + 1 :])), np.zeros(h[0].shape[:2])).max(axis=1, keepdims=True).repeat(64, axis=1) for s in range(len(h))])
            for t in range(8):
                done = vectors.reassigned(x, history, code, lower, stamp, known=t > 0)
                total += int(done.sum()) if t else 0
                books = history[-1].copy()
                for p in range(16):
                    full = vectors.squares(x[:, p], history[-1][p])
                    assert (code[:, p] == full.argmin(axis=1)).all()
                    for e in range(64):
                        if (code[:, p] == e).any():
                            books[p, e] = x[code[:, p] == e, p].sum(axis=0) // (code[:, p] == e).sum()
                history.append(books)
                moves = net(history)
                for p in range(16):
                    others = vectors.squares(x[:, p], books[p]).astype(float)
                    others[np.arange(3000), code[:, p]] = np.inf
                    assert kind == "sum" or (lower[:, p] - moves[stamp[:, p], p, code[:, p]] <= np.sqrt(others.min(axis=1))).all()
        finally:
            vectors.net_moves = net
        scans[kind] = total
    assert scans["net"] < scans["sum"] < 7 * 3000 * 16


def test_far_components_stay_exact():
    x = np.array([[2**28, -(2**28), 3, 1], [5, 5, 5, 5]])
    entries = np.array([[-(2**28), 2**28, 0, 0], [2**28 - 1, -(2**28), 3, 1]])
    wanted = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, e)) for e in entries] for v in x]
    assert vectors.squares(x, entries).tolist() == wanted
