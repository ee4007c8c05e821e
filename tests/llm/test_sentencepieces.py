import hashlib
import random

import numpy as np
import pytest

from textquarry.llm import sentencepieces as S
from textquarry.llm.tokens import vocabulary

MODEL = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=MODEL)


@pytest.fixture
def encoder():
    return S.PieceEncoder(MODEL)


def odd_texts(encoder, n=1500, seed=0):
    rng = random.Random(seed)
    pool = [p.replace(S.MARK, " ") for p in encoder.symbols]
    char = lambda: chr(rng.choice([32, 32, 9, 10, 46, 44, 40, 0x2581, 0xB2, 48, 0x1F600, 0x301, 0xA0, 0x3000, 0, rng.randrange(1, 0xD7FF), rng.randrange(0x10000, 0x10FFFF)]))
    texts = ["".join(rng.choice(pool) if rng.random() < 0.7 else char() for _ in range(rng.randrange(0, 30))) for _ in range(n)]
    return [*texts, "", " ", "  a", "a  b ", "<s> </s><unk><0x41>", "▁▁", "\r\n", "x\n" * 50, "thethe" * 40, "a" * 300, "=" * 70, "  " * 40, "banana ² m².²."]


def test_ids_and_texts_are_the_librarys(library, encoder):
    texts = odd_texts(encoder)
    got, want = encoder.encode(texts), library.encode(texts)
    assert [g.tolist() for g in got] == want
    assert [encoder.decode(g) for g in got] == [library.decode(w) for w in want]
    assert [encoder.written(g).decode() for g in got] == [",".join(map(str, w)) for w in want]


@pytest.mark.parametrize("long", [8, 10**9])
def test_long_words_by_heap_and_by_rounds(library, encoder, monkeypatch, long):
    monkeypatch.setattr(S, "LONG", long)
    rng = random.Random(long)
    texts = ["a" * 1500, "ab" * 700, " " * 1500, "thethe" * 200, "".join(rng.choice("abcdefgh") for _ in range(1500)), *odd_texts(encoder, 300, 1)]
    assert [g.tolist() for g in encoder.encode(texts)] == library.encode(texts)


def test_full_caches_and_small_groups(library, encoder, monkeypatch):
    monkeypatch.setattr(S, "KEPT_WORDS", 50)
    monkeypatch.setattr(S, "TOGETHER", 30)
    texts = odd_texts(encoder, 200, 2)
    for k in range(0, len(texts), 20):
        assert [g.tolist() for g in encoder.encode(texts[k : k + 20])] == library.encode(texts[k : k + 20])


def test_decoding_any_ids(library, encoder):
    rng = random.Random(3)
    for _ in range(2000):
        ids = [rng.randrange(0, 300) if rng.random() < 0.5 else rng.randrange(32000) for _ in range(rng.randrange(0, 12))]
        assert encoder.decode(np.array(ids, np.uint32)) == library.decode(ids)


def test_query(spark, library, odd, none):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted(map(tuple, S.pieces_query(odd.withColumn("text", odd.text)).collect()), key=repr)
    want = []
    for r in odd.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(want, key=repr)
    assert S.pieces_query(none).count() == 0


def test_documents(spark, sf_dir, library):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    for r in S.pieces_query(documents).collect():
        ids = library.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
