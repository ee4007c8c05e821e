import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from textquarry.llm import packing as K
from textquarry.llm.tokens import ByteEncoder, WordEncoder


def ids(text, name):
    return np.array([*Tokenizer.from_file(P.path(name)).encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def best(items, capacity):
    items, fewest = sorted(items, reverse=True), [len(items)]

    def go(k, bins):
        if len(bins) >= fewest[0]:
            return
        if k == len(items):
            fewest[0] = len(bins)
            return
        for b in {x: j for j, x in enumerate(bins) if x + items[k] <= capacity}.values():
            bins[b] += items[k]
            go(k + 1, bins)
            bins[b] -= items[k]
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return fewest[0]


def test_bins_against_the_fewest():
    rng, more = random.Random(1), 0
    for _ in range(800):
        capacity = rng.choice([10, 20, 30])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        bins = K.pack(Counter(items), capacity)
        held = Counter()
        for lengths, n in bins:
            assert sum(lengths) <= capacity
            held.update({s: c * n for s, c in Counter(lengths).items()})
        assert held == Counter(items)
        n, fewest = sum(n for _, n in bins), best(items, capacity)
        assert fewest >= K.lower_bound(Counter(items), capacity)
        more += n - fewest
    assert more <= 8


def test_dominating_bins_are_part_of_a_best_packing():
    rng, fixed = random.Random(2), 0
    for _ in range(600):
        capacity = rng.choice([12, 20])
        items = [rng.randint(1, capacity - 1) for _ in range(rng.randint(1, 8))]
        open_ = K.Open(Counter(items))
        for size in open_.sizes:  # of any open length
            if bin_ := K.dominating(open_, size, capacity):
                assert size in bin_
                fixed += 1
                rest = list(items)
                for s in bin_:
                    rest.remove(s)
                assert best(items, capacity) == 1 + (best(rest, capacity) if rest else 0), (items, bin_)
        bins = K.reduced(open_, capacity)
        rest = [s for s, n in open_.count.items() for _ in range(n)]
        assert best(items, capacity) == sum(n for _, n in bins) + (best(rest, capacity) if rest else 0)
    assert fixed > 1000


def test_large_histograms_are_near_the_bound():
    rng = random.Random(3)
    counts = Counter(int(rng.lognormvariate(5.5, 1)) % 1023 + 1 for _ in range(50_000))
    assert sum(n for _, n in K.pack(counts)) <= 1.002 * K.lower_bound(counts)
    # dominance, not best fit, makes most of the bins
    assert sum(n for _, n in K.reduced(K.Open(counts), 1024)) > 0.5 * K.lower_bound(counts)


def check(df):
    rows = K.pack_documents(df).collect()
    texts = Counter((r["doc_id"], r["text"]) for r in df.collect())
    want = Counter()
    for (doc, text), n in texts.items():
        whole = ids(text, "byte_bpe_50k.json")
        first = len(whole) % 1024 or 1024
        cuts = [0, *range(first, len(whole) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc, k, a, b - a, zlib.crc32(whole[a:b].tobytes())] += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    return len(places), Counter(r["length"] for r in rows)


def test_odd_rows(odd, none):
    check(odd)
    assert K.pack_documents(none).count() == 0
    kept = K.pack_documents(odd.where("doc_id = 2"), keep_ids=True).first()
    assert kept["ids"] == ids(odd.where("doc_id = 2").first()["text"], "byte_bpe_50k.json").tolist()


def test_documents(spark, sf_dir):
    n, counts = check(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    assert n <= 1.01 * K.lower_bound(counts) + 1


def test_encoders_give_the_library_s_ids():
    texts = ["a b\tc\n\nd", "don't WE'LL 123 x,y. é ÀÉ Σ ΑΣ İ ß ﬁ", "x\x1cy\x85z\xa0w", "日本 🙂👍🏽", "<|endoftext|> a", "", "  ", "a" * 5000, "ÿ.,;:!? ...", "‍́a"]
    byte, word = ByteEncoder(), WordEncoder()
    for _ in range(2):
        for t in texts:
            assert byte.ids(t).tolist() == ids(t, "byte_bpe_50k.json").tolist(), t
            assert word.ids(t).tolist() == ids(t, "word_bpe_49k.json").tolist(), t


def test_encoder_with_little_memory(monkeypatch):
    from textquarry.llm import tokens

    monkeypatch.setattr(tokens, "KEPT_WORDS", 20)
    word, rng = WordEncoder(), random.Random(4)
    for _ in range(60):
        t = " ".join(f"w{rng.randint(0, 40)}," for _ in range(rng.randint(0, 30)))
        assert word.ids(t).tolist() == ids(t, "word_bpe_49k.json").tolist()
