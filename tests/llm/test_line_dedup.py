import hashlib
from collections import defaultdict

import pytest

from textquarry.llm import line_dedup as L

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    held = defaultdict(set)
    key = lambda line: line.strip(SPACES).translate(LOWER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(i)
    least = lambda x: (x is not None, x or 0)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held[key(x)]) >= 3 and max(held[key(x)], key=least) != i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(df):
    return sorted((tuple(r) for r in L.line_dedup_query(df).collect()), key=str)


def test_odd_rows(odd, none):
    assert run(odd) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert run(none) == []


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert run(docs) == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_a_hot_line_and_ties(spark):
    hot = "this very line is in all of the documents"
    rows = [(k % 700, f"{hot}\nown line of document {k % 700} only\n{hot}") for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert run(docs) == brute(rows)


@pytest.mark.parametrize("fanout", [2, 3])
def test_runs_are_compacted_and_adding_again_changes_nothing(spark, sf_dir, fanout):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hashes = L.line_hashes(docs).cache()
    runs = L.LineRuns(spark, fanout, buckets=2)
    for k in range(5):
        runs.add(hashes.where(f"pmod(doc_id, 5) = {k}"))
    assert all(len(level) < fanout for level in runs.levels) and len(runs.levels) > 1
    columns = ["h1", "h2", "n", "lo", "hi"]
    once = sorted(map(tuple, runs.entries().select(*columns).where("n >= 3").collect()))
    want = sorted(map(tuple, L.batch_entries(hashes).select(*columns).where("n >= 3").collect()))
    assert [x[:3] + x[4:] for x in once] == [x[:3] + x[4:] for x in want]
    runs.add(hashes.where("doc_id < 50"))
    assert sorted(map(tuple, runs.entries().select(*columns).where("n >= 3").collect())) == once
    runs.drop()
    hashes.unpersist()


def test_the_query_compacts_runs_whatever_the_number_of_files(spark, sf_dir, monkeypatch):
    """A table of one file gives more batches than the fanout, so that three runs at least are merged before the end."""
    merged = []
    compact = L.LineRuns._compact

    def counted(self):
        before = len(self.paths)
        compact(self)
        merged.append(before - len(self.paths))

    monkeypatch.setattr(L.LineRuns, "_compact", counted)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    assert run(docs) == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert len(merged) == L.FANOUT + 1 and sum(x > 0 for x in merged) == 1


def test_documents_keep_their_columns(odd):
    out = L.deduped_documents(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert {r["doc_id"]: r["text"] for r in out.collect()}[3] == ""
