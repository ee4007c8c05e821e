import re

import numpy as np
import pytest

from textquarry.llm import mixing as X
from textquarry.llm import vector_file as V


def brute(rows, k=20):
    ok = [(i, np.floor(64 * np.array(v, float)).astype(np.int64)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q is None or q % 20:
            continue
        scores = sorted(((-int(a @ b), i is None, i or 0, i) for i, b in ok if i != q and len(b) == len(a)))[:k]
        out |= {(q, n + 1, s[3], -s[0]) for n, s in enumerate(scores)}
    return out


@pytest.mark.parametrize(("n", "scale"), [(300, 0.3), (300, 400.0), (45, 0.02)])
def test_top_k_against_brute_force(spark, monkeypatch, n, scale):
    monkeypatch.setattr(V, "CHUNK", 64)
    rng = np.random.default_rng(n)
    rows = [(k, [float(x) for x in rng.normal(size=8) * scale]) for k in range(n)]
    rows += [(1000, None), (1001, [1.0, None] * 4), (1020, [float("nan")] * 8), (None, [0.5] * 8), (1040, [0.25] * 3), (1041, [1.0, 2.0, 3.0]), (40, rows[40][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = V.top_k_query(df.select("*", df.vec_id.alias("dim"), df.vec_id.alias("rank"))).collect()
    # the repeated row is in the lists of others twice, and is answered once
    want = brute(rows)
    assert len(got) == len({(r["query_id"], r["rank"]) for r in got})
    assert {tuple(r) for r in got} == want


@pytest.mark.parametrize("large", [1e12, 1e17, 1e30])
def test_scores_beyond_64_bits_raise(spark, large):
    df = spark.createDataFrame([(0, [large, 1.0]), (1, [3e15, -1.0]), (2, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        V.top_k_query(df).collect()


def test_scores_beyond_53_bits_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(size=6) * 3e6]) for k in range(60)]
    got = V.top_k_query(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {tuple(r) for r in got} == brute(rows)


def test_top_k_of_nothing(spark):
    assert V.top_k_query(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id bigint, embedding array<float>")
    assert V.top_k_query(one).count() == 0


def target_of(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / share for s in names}
        above = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not above:
            return target
        full |= above


def check_mix(df, tolerance):
    rows = X.mix(df).collect()
    docs = df.select("doc_id", "source", "text").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for d in docs:
        sizes[d["source"]] = sizes.get(d["source"], 0) + size(d["text"])
    target = target_of(sizes)
    assert sorted(str((r["doc_id"], r["size"])) for r in rows) == sorted(str((d["doc_id"], size(d["text"]))) for d in docs)
    source_of, taken = {d["doc_id"]: d["source"] for d in docs}, {}
    for r in rows:
        s = source_of[r["doc_id"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) <= 1e-9 * max(1, target[s])
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, n in taken.items():
        assert abs(n - target[s]) <= tolerance * max(1, sizes[s])
    assert sorted(map(tuple, X.mix(df).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_mixes(odd, none, spark):
    check_mix(odd, 1.0)
    assert X.mixing_query(none).count() == 0
    rows = [(k, f"{'abc'[k % 7 % 3] if k % 7 else None}" if k % 11 else None, "word " * (k % 13 + 1)) for k in range(3000)]
    check_mix(spark.createDataFrame(rows, "doc_id bigint, source string, text string"), 0.004)
    one = [(k, "big" if k else "small", "word " * 10) for k in range(200)]
    check_mix(spark.createDataFrame(one, "doc_id bigint, source string, text string"), 0.1)


def test_thresholds_are_nested(spark):
    rows = [(k, "a", "word " * 10) for k in range(500)] + [(1000 + k, "b", "word " * 10) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    sizes = X.measured(df)
    few = {r["source"]: r["full"] * 2.0**63 + r["below"] for r in X.thresholds(sizes, (1, 9)).collect()}
    many = {r["source"]: r["full"] * 2.0**63 + r["below"] for r in X.thresholds(sizes, (1, 3)).collect()}
    assert few["a"] < many["a"] and few["b"] > many["b"]


def test_mixed_documents(odd):
    out = X.mixed_documents(odd)
    assert out.columns == odd.columns
    assert {r["doc_id"] for r in out.collect()} >= {4, 5, 6}  # without words: once each
