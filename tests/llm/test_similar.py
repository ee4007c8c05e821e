import random

import numpy as np
import pytest

from textquarry.llm import similar as S

from test_simhash import components


def test_one_of_each_group_stays(odd, none):
    kept = S.deduped_documents(odd)
    assert kept.columns == odd.columns
    # 3 is a line of its own; the two rows with id 9 repeat 1; the texts without words are one group
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "10", "2", "3", "4", "7", "8", "None"])
    assert S.deduped_documents(none).count() == 0


def test_similar_documents_reach_recall_and_leave_others(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(4000)]
    rows, groups = [], {}
    for g in range(60):
        base = [rng.choice(words) for _ in range(300)]
        for c in range(3):
            edit = list(base)
            for _ in range(3 if c else 0):  # each edit changes five of 296 shingles
                edit[rng.randrange(300)] = f"x{rng.random()}"
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(edit)))
    out = S.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    label = {r["doc_id"]: r["component_id"] for r in out}
    pairs = [(a, b) for a in groups for b in groups if a < b and groups[a] == groups[b]]
    assert sum(label[a] == label[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert all(groups[i] == groups[c] for i, c in label.items())


def shingled(text):
    words = text.split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def check_similar(spark, texts):
    """All links of brute force and no others; the number of pairs at 0.8 or more."""
    rows = list(enumerate(texts))
    sets = [(k, shingled(t)) for k, t in rows]
    got = {r["doc_id"]: r["component_id"] for r in S.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[k] for k, _ in rows] == components(sets, similar)
    return sum(similar(a, b) for k, (_, a) in enumerate(sets) for _, b in sets[:k])


def test_twins_in_families_of_templated_texts(spark):
    # a family's texts are at 0.70 to 0.79 of one another: false links that must not stand for the twins' true ones
    rng, texts = random.Random(12), []
    for f in range(3):
        frame = [f"f{f}w{k}" for k in range(300)]
        for m in range(100):
            own = frame[:250] + [f"f{f}m{m}o{k}" for k in range(38)] + frame[250:]
            texts.append(" ".join(own))
            if m % 4 == 0:
                twin = list(own)
                for at in rng.sample(range(6, len(own) - 6, 6), 7):
                    twin[at] = f"f{f}m{m}t{at}"
                texts.append(" ".join(twin))
    sets = [shingled(t) for k, t in enumerate(texts[:100]) if k % 5 != 1]
    assert all(0.7 <= len(a & b) / len(a | b) < 0.8 for a in sets for b in sets if a is not b)
    assert check_similar(spark, texts) == 75


def test_repeated_shingles_count_once(spark):
    # one shingle in most places: different words; the same set with other repeats: the same text
    def dashes(g):
        return "- " * 300 + " ".join(f"g{g}w{k}" for k in range(200))

    words = " ".join(f"w{k}" for k in range(200))
    texts = [dashes(g) for g in range(6)] + [words + " -" * 5, words + " -" * 400, "0 " * 40, "0 " * 900]
    assert check_similar(spark, texts) == 2
    kept = S.deduped_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 8]


def test_no_link_near_the_similarity_is_lost(spark):
    rng, texts = random.Random(8), []
    for g in range(200):
        words = [f"g{g}w{k}" for k in range(300)]
        twin = list(words)
        for at in rng.sample(range(6, 290, 6), rng.choice((6, 6, 7))):  # 0.82, or 0.79
            twin[at] = f"g{g}t{at}"
        texts += [" ".join(words), " ".join(twin)]
    assert 100 < check_similar(spark, texts) < 200


@pytest.mark.parametrize("dense", [4, 2048])
def test_pairs_of_large_groups_come_from_the_index(spark, dense):
    # sets of one shingle in common: what the index finds is what comparing all finds
    rng, sets = random.Random(4), []
    for g in range(25):
        base = [rng.getrandbits(63) for _ in range(rng.randint(3, 80))]
        for _ in range(6):
            sets.append(np.unique(np.array([1, *rng.sample(base, rng.randint(len(base) - 2, len(base)))], np.uint64)))
    rows = [(7, k, len(x), len(x), k, bytearray(S.parity(x))) for k, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "token bigint, node bigint, size int, left int, label bigint, bits binary")
    got = {(r["u"], r["v"]) for r in S.candidate_pairs(df, 0.8, dense=dense).collect()}
    true = {(a, b) for a in range(len(sets)) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    assert true and true <= got and len(got) < 2 * len(true)
    nearest = {(r["u"], r["v"]) for r in S.candidate_pairs(df, 0.8, nearest=True, dense=dense).collect()}
    assert nearest <= got and {x for pair in nearest for x in pair} == {x for pair in got for x in pair} and len(nearest) < len(sets)


def test_simhash_links_are_candidates(spark):
    # a chain of SimHashes at four bits, nodes of equal SimHashes, and ones that are far from all
    rng = random.Random(2)
    fps, chain = [rng.getrandbits(64) for _ in range(50)], rng.getrandbits(64)
    for k in range(15):
        chain ^= 0b1111 << 4 * k
        fps += [chain, chain]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = S.simhash_candidates(spark.createDataFrame(list(enumerate(signed)), "node bigint, fp bigint")).collect()
    assert got and all(r["v"] < r["u"] for r in got)
    label = list(range(len(fps)))
    for r in sorted((r["v"], r["u"]) for r in got) * len(got):
        label[r[0]] = label[r[1]] = min(label[r[0]], label[r[1]])
    assert label == components(list(enumerate(fps)), lambda a, b: (a ^ b).bit_count() <= 4)


def test_near_copies_come_by_simhash(spark, monkeypatch):
    # the pipeline's stage tests what SimHash links, and its links hold to the similarity
    words, asked = [f"w{k}" for k in range(400)], []
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), "other words that stay for themselves"]
    monkeypatch.setattr(S, "simhash_candidates", lambda nodes, find=S.simhash_candidates: asked.append(find(nodes).count()) or find(nodes))
    assert check_similar(spark, texts) == 1 and asked == [1]


def test_small_groups_share_an_index():
    rng = np.random.default_rng(3)
    group = np.sort(rng.integers(0, 300, 1000))
    fps = rng.integers(0, 1 << 62, (20, 8), np.uint64)[rng.integers(0, 20, 1000)] ^ np.left_shift(np.uint64(1), rng.integers(0, 60, (1000, 8), np.uint64))
    index = S.GrayIndex(fps, np.full(1000, 8.0), None, group)
    got = {tuple(sorted((int(index.order[a]), int(index.order[b])))) for x, y, _ in index.pairs(lambda: np.arange(1000)) for a, b in zip(x, y, strict=True)}
    near = lambda a, b: group[a] == group[b] and np.bitwise_count(fps[a] ^ fps[b]).sum() <= 16
    assert got == {(a, b) for b in range(1000) for a in range(b) if near(a, b)} and got
