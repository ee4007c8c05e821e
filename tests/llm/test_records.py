import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from textquarry.llm import records as R


def crc(data):
    c = 0xFFFFFFFF
    for x in data:
        c ^= x
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksums():
    assert crc(b"123456789") == 0xE3069283
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in (4, 5, 8, 255, 256, 257, 600)]
    assert R.crc32c(parts).tolist() == [crc(p) for p in parts] and len(R.crc32c([])) == 0


def want(rows):
    tokenizer, at, out = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, []
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_odd_rows(odd, none):
    got = sorted((tuple(r) for r in R.records_query(odd).collect()), key=lambda r: r[1])
    rows = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == want(rows)
    assert R.records_query(none).count() == 0


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((tuple(r) for r in R.records_query(docs).collect()), key=lambda r: r[1])
    assert got == want([(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()])


def test_shards_read_in_any_order_and_damage_is_found(tmp_path):
    folder = f"file://{tmp_path}"
    rows = [(k if k else None, np.arange(k * 7, dtype=np.uint32) * (5000 if k == 3 else 1)) for k in range(6)]
    writer = R.ShardWriter(folder, "s")
    writer.add(rows[:4])
    writer.add(rows[4:])
    writer.close()
    index = R.read_index(folder, "s")
    assert index["ids"].tolist() == [len(i) for _, i in rows]
    for k in (5, 0, 3):
        doc, ids = R.read_record(folder, "s", int(index["offset"][k]))
        assert doc == rows[k][0] and np.array_equal(ids, rows[k][1])
    back = [x for part in R.read_shard(folder, "s", 64) for x in part]
    assert [d for d, _ in back] == [d for d, _ in rows]
    data = bytearray((tmp_path / "s.rec").read_bytes())
    data[int(index["offset"][5]) + 30] ^= 1
    (tmp_path / "s.rec").write_bytes(data)
    with pytest.raises(ValueError, match="checksum"):
        list(R.read_shard(folder, "s"))
