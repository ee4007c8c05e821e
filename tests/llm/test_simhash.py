import random
from collections import Counter

import numpy as np
import xxhash

from textquarry.llm import simhash as S


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, near):
    """Smallest id that links reach, by comparing all."""
    n = len(rows)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if near(rows[a][1], rows[b][1]):
                parent[find(a)] = find(b)
    least = {}
    for k in range(n):
        ids = [rows[j][0] for j in range(n) if find(j) == find(k) and rows[j][0] is not None]
        least[k] = min(ids) if ids else None
    return [least[k] for k in range(n)]


def check(df):
    got = sorted((tuple(r) for r in S.near_duplicates_query(df).collect()), key=str)
    rows = [(r["doc_id"], fingerprint(r["text"])) for r in df.collect()]
    labels = components(rows, lambda a, b: (a ^ b).bit_count() <= 4)
    assert got == sorted(((i, format(f, "016x"), c) for (i, f), c in zip(rows, labels, strict=True)), key=str)


def test_odd_rows(odd, none, spark):
    check(odd)
    assert S.near_duplicates_query(none).count() == 0
    check(spark.createDataFrame([(None, "a b"), (None, "")], "doc_id bigint, text string"))


def test_against_brute_force(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def test_index_finds_all_links_and_groups():
    random.seed(5)
    for n in (3, 40, 300, 2500):
        base = [random.getrandbits(64) for _ in range(max(2, n // 9))]
        fps = list({random.choice(base) ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 6))) for _ in range(n)})
        a, b = S.spanning_edges(np.array(fps, np.uint64).reshape(-1, 1), 4)
        assert all(x != y for x, y in zip(a, b, strict=True)) and len(a) < len(fps)
        label = list(range(len(fps)))
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            assert (fps[x] ^ fps[y]).bit_count() <= 4
            label = [label[x] if k == label[y] else k for k in label]
        if n <= 300:
            want = components([(k, f) for k, f in enumerate(fps)], lambda p, q: (p ^ q).bit_count() <= 4)
            assert len(set(want)) == len({label[k] for k in range(len(fps))})
            assert all((want[p] == want[q]) == (label[p] == label[q]) for p in range(len(fps)) for q in range(p))


def test_chains_contract(spark):
    edges = [(k + 1, k) for k in range(60)] + [(100 + k, 99) for k in range(1, 50)]
    got = {r["u"]: r["v"] for r in S.contracted(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {100 + k: 99 for k in range(1, 50)}
    assert S.contracted(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_a_large_group_of_copies(spark):
    text = "some words that are the same in all of these documents here"
    rows = [(k, text) for k in range(3000)] + [(5000, "other words altogether, which link to nothing else at all")]
    out = S.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert Counter(r["component_id"] for r in out.collect()) == {0: 3000, 5000: 1}


def test_more_blocks_for_more_fingerprints(spark, monkeypatch):
    assert [S.blocks_for(n, 4) for n in (0, 512, 513, 10**6, 10**8, 10**10, 10**12)] == [(5, 0), (5, 0), (5, 1), (5, 11), (6, 18), (7, 25), (8, 31)]
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(40)]
    fps = sorted({rng.choice(base) ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 5))) for _ in range(400)})
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    want = components([(k, f) for k, f in enumerate(fps)], lambda a, b: (a ^ b).bit_count() <= 4)
    for parts in ((5, 0), (5, 3), (5, 12), (6, 5), (6, 20), (8, 31)):
        monkeypatch.setattr(S, "blocks_for", lambda count, radius, parts=parts: parts)
        found = {r["u"]: r["v"] for r in S.contracted(S.link_edges(df, 4)).collect()}
        label = [found.get(f, f) for f in fps]
        assert all((want[a] == want[b]) == (label[a] == label[b]) for a in range(len(fps)) for b in range(a))


def test_groups_of_the_query_hold_some_hundreds_and_all_are_indexed(spark, monkeypatch):
    fps = S.fingerprints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("fp").distinct()
    sizes = sorted(r["count"] for r in S.dealt_groups(fps).groupBy("block", "value").count().collect())
    assert sizes[len(sizes) // 2] >= S.GROUP // 2 and sizes[0] > S.LEAF
    made = []
    monkeypatch.setattr(S, "GrayIndex", lambda *a, index=S.GrayIndex: made.append(index(*a)) or made[-1])
    rng = random.Random(1)
    for n in (2, 20, sizes[0]):
        S.spanning_edges(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64).reshape(-1, 1), 4)
    assert len(made) == 3 and len(made[-1].levels) > 1
