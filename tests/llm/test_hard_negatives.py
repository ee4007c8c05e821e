from collections import Counter

import numpy as np
import pytest

from textquarry.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<double>, label int, class_id int, v string, need string, rank int"


def brute(rows):
    ok = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ok.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, tuple(int(np.floor(256 * x)) for x in v)))
    out = Counter()
    for i, label, a in {r for r in ok if r[0] is not None and r[0] % 50 == 0}:
        scored = [(-sum(x * y for x, y in zip(a, b)), j is None, j or 0, j, m) for j, m, b in ok if len(b) == len(a)]
        scored.sort(key=lambda s: s[:3])
        for p in [s for s in scored if s[4] == label and s[3] != i][:5]:
            fit = [s for s in scored if s[4] != label and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:3]
            out.update((i, p[3], k, s[3], -p[0], -s[0]) for k, s in enumerate(fit, 1))
    return out


def made(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "v", "need", 2) for i, v, label in rows], SCHEMA)


def clustered(n, dim, seed, labels=4, scale=1.0, noise=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    return [(k, [float(x) for x in scale * (centres[k % labels] + noise * rng.normal(size=dim))], int(rng.integers(labels))) for k in range(n)]


def found(df):
    return Counter(tuple(r) for r in H.hard_negatives(df).collect())


@pytest.mark.parametrize(("n", "dim", "scale"), [(700, 16, 1.0), (500, 7, 0.02), (400, 8, 1e5)])
def test_against_brute_force(spark, monkeypatch, n, dim, scale):
    monkeypatch.setattr(H, "BLOCK", 90)
    monkeypatch.setattr(H, "QUESTIONS", 5)
    monkeypatch.setattr(H, "CENTROIDS", 16)
    rows = clustered(n, dim, n, scale=scale)
    want = brute(rows)
    assert want
    assert found(made(spark, rows)) == want


def test_odd_rows(spark):
    rows = clustered(300, 6, 1)
    same = rows[100][1]
    rows += [(1000, None, 1), (1001, [1.0, None] * 3, 1), (1050, [float("nan")] * 6, 2), (1051, [float("inf")] * 6, 2), (1052, [1.0] * 6, None), (None, rows[50][1], 0), (None, rows[50][1], 1)]
    rows += [(2000 + k, same, k % 3) for k in range(120)]  # one vector in many rows
    rows += [rows[50]] * 3 + [rows[100]] + [rows[3]] * 8 + [(50, [x + 0.01 for x in same], rows[50][2]), (50, same, 3)]  # repeated rows, and other rows of an anchor's id
    rows += [(3000, [1.0, 2.0], 1), (3001, [1.0, 2.0], 1), (3002, [0.5, 1.5], 2), (3050, [], 1), (3051, [], 1), (3052, [], 2)]
    assert found(made(spark, rows)) == brute(rows)


def test_many_rows_of_an_anchors_id(spark):
    rows = clustered(200, 4, 3)
    rows += [(50, [3.0 + k / 10, 1.0, 0.0, 0.0], 1) for k in range(9)] + [(60, [3.0, 1.0, 0.1, 0.0], 1), (61, [2.0, 1.0, 0.1, 0.0], 1), (62, [2.0, 1.0, 0.2, 0.0], 2)]
    assert found(made(spark, rows)) == brute(rows)


def test_too_long_vectors_raise(spark):
    with pytest.raises(Exception, match="64 bits"):
        found(made(spark, [(0, [1e30, 1.0], 1), (1, [1.0, 2.0], 1)]))


def test_bounds_hold_for_any_centroids():
    rng = np.random.default_rng(0)
    x, a = rng.integers(-300, 300, (500, 9)).astype(float), rng.integers(-300, 300, (40, 9)).astype(float)
    sizes = [len(range(9)[p]) for p in H._parts(9)]
    book = [(np.round(rng.normal(size=(16, n)) * 100), np.round(rng.normal(size=(16, n)) * 40)) for n in sizes]
    near, widths = 0, []
    for level, (codes, margins) in enumerate(H.encoded(x, book)):
        near = near + sum((a[:, p] @ c[level].T)[:, codes[:, k]] for k, (p, c) in enumerate(zip(H._parts(9), book)))
        widths.append(np.sqrt((a * a).sum(1))[:, None] * margins[None, :])
        assert (np.abs(near - a @ x.T) <= widths[-1]).all()
    assert widths[1].mean() < widths[0].mean()


def test_candidates_are_few(spark, sf_dir):
    """The bounds leave a small part of the rows to be scored exactly."""
    rows = H.valid(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    classes = H.classes_of(rows, 6)
    books = H.fitted(classes)
    asks = classes.where("class_id % 10 = 0").selectExpr("class_id AS q_id", "label", "v", "CAST(6 AS BIGINT) AS need", "CAST(array() AS ARRAY<BIGINT>) AS scores")
    left = H.scan(H.code_blocks(classes, books), H.question_blocks(asks), books, negatives=False).count()
    assert asks.count() <= left < 0.02 * asks.count() * classes.count()


def test_nothing(spark):
    assert found(made(spark, [])) == Counter()
    assert found(made(spark, [(0, [1.0], 1)])) == Counter()
