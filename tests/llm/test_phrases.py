import random
import re
from collections import Counter

import pytest

from textquarry.llm import phrases as P

SCHEMA = "text string, lang string, phrase int, m string, f binary, words array<int>, share int"


def brute(rows, least, top=2000, longest=5):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(longest, len(words) - i) + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        n, found = totals[lang], []
        for p, a in f.items():
            if a < least or len(p) == 1:
                continue
            # every longer candidate, not only those of one word more
            if any(g >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, g in f.items() if g >= least):
                continue
            score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((" ".join(p), a, left, right, n, score))
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, k, *x) for k, x in enumerate(found[:top], 1)]
    return sorted(out)


def made(spark, rows):
    return spark.createDataFrame([(t, x, 1, "m", b"f", [1], 2) for t, x in rows], SCHEMA)


def odd_rows(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "Éa", "éa", "x", "y-z", "日本", "a b", "of\tthe", "q\x00", "\xa0", "it's"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\r\n", "\x0b"]) for _ in range(rng.randrange(0, 60)))
        rows.append((text, rng.choice(["en", "en", "fr", None, "und"])))
    return rows + [(None, "en"), ("", None), (" .,\n", "fr"), (rows[0][0], "en"), (rows[0][0], "en"), ("so on and " * 3000, "de")]


@pytest.mark.parametrize(("seed", "least", "top"), [(1, 5, 2000), (2, 12, 7), (3, 40, 2000)])
def test_collocations_against_brute_force(spark, seed, least, top):
    rows = odd_rows(seed)
    got = sorted(tuple(r) for r in P.collocations(made(spark, rows), least, top).collect())
    assert got == brute(rows, least, top)
    assert got


@pytest.mark.parametrize("longest", [2, 3])
def test_shorter_phrases(spark, longest):
    rows = odd_rows(4)
    assert sorted(tuple(r) for r in P.collocations(made(spark, rows), 6, longest=longest).collect()) == brute(rows, 6, longest=longest)


def test_small_holdings_and_a_full_table_lose_nothing(spark, monkeypatch):
    """Sums passed on early, and a table of pairs in which most bits are shared."""
    monkeypatch.setattr(P, "HELD_BYTES", 500)
    monkeypatch.setattr(P, "HELD_PHRASES", 40)
    monkeypatch.setattr(P, "FILTER_BITS", P.ROW_BITS)
    rows = odd_rows(5)
    assert sorted(tuple(r) for r in P.collocations(made(spark, rows), 5).collect()) == brute(rows, 5)


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", b"a", 1, 3_000_000_000), ("en", b"b", 1, 3_000_000_000), ("en", b"a b", 2, 2_999_999_999)], "lang string, phrase binary, words int, f bigint")
    totals = spark.createDataFrame([("en", 9_000_000_000_000)], "lang string, n bigint")
    (row,) = P.scored(counts, totals).collect()
    assert row["score"] == 1000 * 2_999_999_999 * 9_000_000_000_000 // 3_000_000_000**2


def test_pair_table_has_all_pairs(spark):
    pairs = spark.createDataFrame([(x, f"w{k} é{k}".encode()) for k in range(3000) for x in ("en", "日")], "lang string, phrase binary")
    table, bits = P.pair_filter(pairs)
    from xxhash import xxh64_intdigest

    for x in ("en", "日"):
        for k in range(3000):
            h = xxh64_intdigest(f"w{k} é{k}".encode(), xxh64_intdigest(x.encode(), 42)) & (bits - 1)
            assert table[h >> 3] >> (h & 7) & 1


def test_nothing(spark, odd, none):
    assert P.collocations(none).count() == 0
    assert P.collocations(made(spark, [("one two", "en")])).count() == 0
    assert P.collocations(odd, 2).count() > 0
