import re
from collections import Counter, defaultdict

import corpus_pipeline as C
from textquarry.llm import line_dedup, queries


def stages(spark, docs):
    out = [docs]
    for _, stage in C.STAGES[:-1]:
        out.append(C.stored(stage(spark, out[-1], ""), "test_stage"))
    return out


def test_stages_against_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read, accepted, lines, alone, mixed = stages(spark, docs)
    for df in (accepted, lines, alone, mixed):
        assert df.columns == docs.columns
    # language: all documents with letters are in a language here
    assert {r["doc_id"] for r in accepted.collect()} == {r["doc_id"] for r in read.collect() if r["text"] and any(c.isalpha() for c in r["text"])}
    # lines: the query's rows are tested elsewhere, here that the stage keeps what it says
    kept = {r["doc_id"]: r["text"] for r in lines.collect()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    held = defaultdict(set)
    for r in accepted.collect():
        for x in r["text"].split("\n"):
            held[key(x)].add(r["doc_id"])
    for r in accepted.collect():
        want = [x for x in r["text"].split("\n") if not (len(key(x)) >= line_dedup.MIN_CHARS and len(held[key(x)]) >= 3 and max(held[key(x)]) != r["doc_id"])]
        assert kept[r["doc_id"]] == "\n".join(want)
    # near copies: no two that stay are similar, and what goes has a similar one
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))
        return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets = {i: shingles(t) for i, t in kept.items()}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    stay = {r["doc_id"] for r in alone.collect()}
    close = [(a, b) for a in stay for b in stay if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    every = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    assert every and not close
    for i in sets.keys() - stay:
        assert max(jaccard(sets[i], sets[j]) for j in sets if j != i) >= 0.8
    # mixing: whole documents, three times at most
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert set(times) <= stay and max(times.values()) <= 3


def test_odd_rows_run_through(spark, odd, none, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    rows = C.run(spark, str(tmp_path)).collect()
    assert rows and max(r["length"] for r in rows) <= 1024
    none.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert C.run(spark, f"{tmp_path}/none").count() == 0


def test_registered_queries():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{n}" for n in range(1, 11)] + ["pipeline"]
    assert [n for n, _ in C.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
