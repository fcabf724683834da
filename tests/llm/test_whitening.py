"""Whitening against numpy on all vectors at once."""

import random
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))

import plain  # noqa: E402
from markbook.llm import whitening  # noqa: E402
from markbook.llm.common import table  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, key string, x string, copies int, d int, z int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, "k", "x", 1, 2, 3) for i, v in rows], SCHEMA)


def check(got, want, components):
    n, found, explained = want
    assert len(got) == len(found) * components and {r.n for r in got} == {n}
    signs = {}
    for r in got:
        deviation, z = found[r.vec_id]
        assert int(r.deviation) == deviation and r.identity_error < 1e-4
        assert abs(abs(r.whitened) - abs(z[r.component - 1])) < 1e-6
        assert abs(r.explained - explained[r.component - 1]) <= 1e-9
        if abs(r.whitened) > 1e-6:
            signs.setdefault(r.component, set()).add(r.whitened * z[r.component - 1] > 0)
    assert all(len(s) == 1 for s in signs.values())  # either sign, the same in all rows


def test_given_table(spark, small):
    vectors = table(spark, small, "embeddings")
    want = plain.whitened([(r.vec_id, r.embedding) for r in vectors.collect()])
    check(whitening.whitened(vectors).collect(), want, 16)


def test_copies_and_unusable_vectors(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) * (k + 1) for k in range(5)]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(400)]  # more than half of all rows are one vector
    rows += [(2000, [v + 0.001 * 0 for v in rows[4][1]]), (-5, rows[5][1])]
    bad = [(1, None), (2, [1.0, None, 0.0, 0.0, 0.0]), (3, [float("nan")] * 5), (4, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (5, [])]
    df = frame(spark, rows + [(9000 + i, v) for i, v in bad])
    check(whitening.whitened(df, components=4).collect(), plain.whitened(rows, 4), 4)
    by_copies = whitening.whitened(df, components=4, weights="copies").collect()
    check(by_copies, plain.whitened(rows, 4, weigh=lambda copies: copies), 4)


def test_components_without_variance(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (None, [1.0, 2.5, 3.0]), (4, [4.0]), (4, [4.0])]
    got = whitening.whitened(frame(spark, rows)).collect()
    assert len(got) == 3 * 3 + 2
    three = [r for r in got if r.n == 2]
    assert {(r.component, r.whitened is None, r.explained > 0.5) for r in three} == {(1, False, True), (2, True, False), (3, True, False)}
    assert all(abs(abs(r.whitened) - 1) < 1e-9 and r.identity_error < 1e-9 for r in three if r.component == 1)
    assert {int(r.deviation) for r in three} == {32**2}  # x differs by 32 in one dimension, n = 2
    one = [r for r in got if r.n == 1]
    assert [(r.vec_id, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(4, 0, None, None, None)] * 2


def test_large_entries_are_exact(spark):
    rows = [(1, [1e12, 0.0]), (2, [-1e12, 0.25]), (3, [1e30, 0.0])]
    got = {r.vec_id: r for r in whitening.whitened(frame(spark, rows), components=1).collect()}
    x = [int(64 * v) for v in (float(np.float32(1e12)), float(np.float32(-1e12)))]
    assert sorted(got) == [1, 2] and int(got[1].deviation) == (x[0] - x[1]) ** 2 + 16**2


def test_no_vectors(spark):
    empty = whitening.whitened(frame(spark, [(1, None)]))
    assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and empty.count() == 0
