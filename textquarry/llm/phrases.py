"""Phrase collocations: phrases whose words meet more often than their parts' counts let expect.

Texts, A-Z lower-cased, are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``. Identical
pieces of a language become one row with their multiplicity, and n-grams are counted with that weight:

1. words and pairs: tasks sum what they hold and deal it by hash of language and phrase, in compressed blocks; each task's
   hash buckets are counted in duckdb, which goes to disk beyond ``MEMORY``;
2. phrases of three words and more in the same way, where all their pairs are frequent: a phrase can't be more frequent than
   its pairs. The test is a bit for each frequent pair's hash, in a table of at most ``FILTER_BITS`` bits; a bit that several
   pairs share lets more phrases through to be counted, and none is lost.

Each frequent phrase then asks for the counts of the parts of each of its cuts. The requests are shuffled to where the parts'
counts are, so counts are never held whole anywhere. The score of a cut is floor(1000 * a * n / (l * r)) in decimals of 38
digits; the lowest cut counts.

Defined cases: a null text is empty, a null lang is ``und``. Repeated rows count as often as they come. Texts of any length
are read whole. Ties of cuts go to the shortest first part, ties of phrases to the larger count and then to the lesser phrase
in byte order. Empty tables, and tables without a frequent phrase, give no rows. Only ``text`` and ``lang`` are read; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from zstandard import ZstdCompressor, ZstdDecompressor

from .common import LOWER, UPPER, lean, partitions, small_batches, stored

LEAST, TOP, LONGEST, UND = 100, 2000, 5, "und"
#: What a task holds before it passes sums on: bytes of text, and different phrases.
HELD_BYTES, HELD_PHRASES = 32 << 20, 300_000
#: The table of frequent pairs: bits for each pair, and at most in all (64 MB).
PAIR_BITS, FILTER_BITS = 32, 1 << 29
#: Bits of the table in one row.
ROW_BITS = 1 << 16
#: duckdb's memory for a bucket; beyond, it goes to the task's own folder among Spark's local ones.
MEMORY = "256MB"

#: Bytes of UTF-8 beyond ASCII stay as they are.
_PLAIN = bytes.maketrans(UPPER.encode() + b".,;:!?\n\x0b\x0c\r\t", LOWER.encode() + b"\n" * 10 + b" ")
_SPACES = re.compile(b"  +")
PIECES = "lang string, piece binary, words int, m bigint"
GRAMS = "lang string, bucket int, phrases binary, sums binary"
COUNTS = "lang string, phrase binary, words int, f bigint"
#: Hash buckets for each task that counts.
SHARE = 4

Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("m", pa.int64())])


def _batches(counts: dict[str, Counter[bytes]]) -> Iterator[pa.RecordBatch]:
    """Pieces with their numbers of words and of occurrences."""
    for lang, found in counts.items():
        keys = list(found)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            sizes = [k.count(b" ") + 1 for k in part]
            arrays = [pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()), pa.array(sizes, pa.int32()), pa.array([found[k] for k in part], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "piece", "words", "m"])


def _packed(counts: dict[str, Counter[bytes]], buckets: int) -> Iterator[pa.RecordBatch]:
    """GRAMS: the phrases of each language and hash bucket as one row, compressed."""
    small = ZstdCompressor().compress
    for lang, found in counts.items():
        seed, parts = crc32(lang.encode()), [[] for _ in range(buckets)]
        for phrase in found:
            parts[crc32(phrase, seed) % buckets].append(phrase)
        full = [k for k, part in enumerate(parts) if part]
        if full:
            phrases = [small(b"\n".join(parts[k])) for k in full]
            sums = [small(np.array([found[x] for x in parts[k]], np.int64).tobytes()) for k in full]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full)), pa.array(full, pa.int32()), pa.array(phrases), pa.array(sums)], [x.split()[0] for x in GRAMS.split(", ")])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    large = ZstdDecompressor().decompress
    for batch in batches:
        for lang, _, phrases, sums in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            rows = pa.array(large(phrases).split(b"\n"), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(rows)), rows, pa.array(np.frombuffer(large(sums), np.int64))], _SCHEMA.names)


@lean
def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with single spaces between their words, and how often each comes."""
    held: dict[str, Counter[bytes]] = defaultdict(Counter)
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            plain = text.translate(_PLAIN)
            if b"  " in plain:
                plain = _SPACES.sub(b" ", plain)
            held[lang].update([p.strip(b" ") for p in plain.split(b"\n")])
            size += len(text)
            if size >= HELD_BYTES:
                for found in held.values():
                    found.pop(b"", None)
                yield from _batches(held)
                held.clear()
                size = 0
    for found in held.values():
        found.pop(b"", None)
    yield from _batches(held)


def pieces(documents: DataFrame) -> DataFrame:
    """(lang, piece, words, m): each different piece of a language, its number of words and of occurrences."""
    small_batches(documents.sparkSession)
    lang, text = F.coalesce(F.col("lang").cast("string"), F.lit(UND)), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    split = documents.select(lang.alias("lang"), text.alias("text")).mapInArrow(_split, PIECES)
    return stored(split.groupBy("lang", "piece", "words").agg(F.sum("m").alias("m")), "pieces", compression="zstd")


def _counting(emit: Callable[[str, list[bytes]], list[bytes]], least_words: int, buckets: int) -> Task:
    """The phrases that emit(lang, words) names for each piece, with the pieces' multiplicities, summed as far as a task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter[bytes]] = defaultdict(Counter)
        for batch in batches:
            for lang, piece, words, m in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if words < least_words:
                    continue
                found, grams = held[lang], emit(lang, piece.split(b" "))
                if m == 1:
                    found.update(grams)
                else:
                    for gram in grams:
                        found[gram] += m
            if sum(map(len, held.values())) >= HELD_PHRASES:
                yield from _packed(held, buckets)
                held.clear()
        yield from _packed(held, buckets)

    return lean(run)


def _counted(rows: DataFrame, emit: Callable[[str, list[bytes]], list[bytes]], least_words: int, least: int) -> DataFrame:
    """(lang, phrase, words, f) of the phrases of pieces with f >= least: hash buckets are dealt to tasks, which count out of core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        folder = tempfile.mkdtemp(prefix="phrases-", dir=os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0])
        try:
            with duckdb.connect(config={"memory_limit": MEMORY, "temp_directory": folder, "threads": 1, "preserve_insertion_order": False}) as db:
                db.register("rows", pa.RecordBatchReader.from_batches(_SCHEMA, _unpacked(batches)))
                found = db.execute(f"SELECT lang, phrase, CAST(sum(m) AS BIGINT) AS m FROM rows GROUP BY lang, phrase HAVING sum(m) >= {int(least)}")
                while chunk := found.fetchmany(10_000):
                    lang, phrase, f = zip(*chunk, strict=True)
                    words = pa.array([x.count(b" ") + 1 for x in phrase], pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(phrase, pa.binary()), words, pa.array(f, pa.int64())], ["lang", "phrase", "words", "f"])
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    tasks = partitions(rows.sparkSession)
    dealt = rows.mapInArrow(_counting(emit, least_words, SHARE * tasks), GRAMS).repartition(tasks, "bucket")
    return stored(dealt.mapInArrow(lean(run), COUNTS), "phrases")


def _words_and_pairs(lang: str, words: list[bytes]) -> list[bytes]:
    return [*words, *map(b" ".join, zip(words, words[1:], strict=False))]


def pair_filter(pairs: DataFrame) -> tuple[bytes, int]:
    """A bit for the hash of each of pairs (lang, phrase): the table's bytes and its number of bits."""
    bits = ROW_BITS
    while bits < FILTER_BITS and bits < PAIR_BITS * pairs.count():
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for slots in batch.column(1).to_pylist():
                row = np.zeros(ROW_BITS, np.uint8)
                row[slots] = 1
                rows.append(np.packbits(row, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["row", "bits"])

    slot = F.xxhash64("lang", "phrase").bitwiseAND(F.lit(bits - 1))
    slots = pairs.select(F.shiftright(slot, 16).alias("row"), slot.bitwiseAND(F.lit(ROW_BITS - 1)).cast("int").alias("slot"))
    rows = slots.groupBy("row").agg(F.collect_set("slot").alias("slots")).mapInArrow(run, "row bigint, bits binary")
    table = bytearray(bits // 8)
    for row, part in rows.toLocalIterator():  # at most FILTER_BITS / ROW_BITS rows
        table[row * ROW_BITS // 8 : (row + 1) * ROW_BITS // 8] = part
    return bytes(table), bits


def _longer(table, bits: int, longest: int) -> Callable[[str, list[bytes]], list[bytes]]:  # noqa: ANN001
    """Phrases of 3 to longest words, all of whose pairs have their bit set."""
    seeds: dict[str, int] = {}

    def emit(lang: str, words: list[bytes]) -> list[bytes]:
        from xxhash import xxh64_intdigest

        if lang not in seeds:
            seeds[lang] = xxh64_intdigest(lang.encode(), 42)
        seed, held, mask = seeds[lang], table.value, bits - 1
        out: list[bytes] = []
        run = 1  # words up to here in a row whose pairs are frequent
        for end, pair in enumerate(map(b" ".join, zip(words, words[1:], strict=False)), 2):
            h = xxh64_intdigest(pair, seed) & mask
            if held[h >> 3] >> (h & 7) & 1:
                run += 1
                if run > 2:
                    out += [b" ".join(words[end - size : end]) for size in range(3, min(run, longest) + 1)]
            else:
                run = 1
        return out

    return emit


def phrase_counts(rows: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, words, f): all phrases of up to longest words that come least times or more in pieces()."""
    spark = rows.sparkSession
    small_batches(spark, 10_000)
    short = _counted(rows, _words_and_pairs, 1, least)
    pairs = short.where("words = 2").select("lang", "phrase")
    if longest < 3 or pairs.isEmpty():
        return short.where(F.col("words") <= longest)
    table, bits = pair_filter(pairs)
    return short.unionByName(_counted(rows, _longer(spark.sparkContext.broadcast(table), bits, longest), 3, least))


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) for each phrase of two words or more in counts, by its lowest cut."""
    words = F.split(F.col("phrase").cast("string"), " ")
    k = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    cuts = counts.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), words.alias("w"), "words", k.alias("k"))
    left, right = F.slice("w", F.lit(1), F.col("k")), F.slice("w", F.col("k") + 1, F.col("words") - F.col("k"))
    asked = cuts.select(
        "lang", "phrase", "a", "k",
        F.explode(F.array(F.struct(F.lit(True).alias("first"), F.array_join(left, " ").cast("binary").alias("part")), F.struct(F.lit(False).alias("first"), F.array_join(right, " ").cast("binary").alias("part")))).alias("ask"),
    ).select("lang", "phrase", "a", "k", "ask.first", "ask.part")
    told = asked.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    both = told.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    score = F.expr("(1000 * CAST(a AS DECIMAL(19)) * CAST(n AS DECIMAL(19))) div (CAST(l AS DECIMAL(19)) * CAST(r AS DECIMAL(19)))")
    lowest = both.join(totals, "lang").groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def whole(counts: DataFrame) -> DataFrame:
    """counts without phrases that come as often inside a longer one. One word longer is enough to look at: what lies between
    a phrase and a longer one of the same count has that count too."""
    text = counts.where("words > 2").select("lang", "f", "words", F.col("phrase").cast("string").alias("w"))
    without = F.expr("array(CAST(substring_index(w, ' ', words - 1) AS BINARY), CAST(substring_index(w, ' ', 1 - words) AS BINARY))")
    inside = text.select("lang", "f", F.explode(without).alias("phrase"))
    return counts.join(inside, ["lang", "phrase", "f"], "left_anti")


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first top phrases of each language."""
    spark = documents.sparkSession
    rows = pieces(documents)
    counts = phrase_counts(rows, least, longest)
    totals = rows.groupBy("lang").agg(F.sum(F.col("words") * F.col("m")).alias("n"))
    kept = scored(counts, totals).join(whole(counts).where("words > 1").select("lang", "phrase"), ["lang", "phrase"], "left_semi")
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    # A language may hold most phrases: the first ones of its shares come together only.
    share = F.pmod(F.xxhash64("phrase"), F.lit(max(8, partitions(spark))))
    firsts = kept.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (
  SELECT lang, trim(regexp_replace(piece, '[ \t]+', ' ', 'g')) AS piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
  )
), w AS (SELECT lang, string_split(piece, ' ') AS ws, count(*) AS m FROM p WHERE piece <> '' GROUP BY ALL
), t AS (SELECT lang, CAST(sum(len(ws) * m) AS BIGINT) AS n FROM w GROUP BY lang
), s AS (SELECT lang, ws, m, unnest(range(1, len(ws) + 1)) AS i FROM w
), g AS (SELECT lang, ws[i:i + k - 1] AS ph, m FROM (SELECT lang, ws, m, i, unnest(range(1, least(5, len(ws) - i + 1) + 1)) AS k FROM s)
), f AS (SELECT lang, ph, CAST(sum(m) AS BIGINT) AS f FROM g GROUP BY ALL HAVING sum(m) >= 100
), c AS (SELECT lang, ph, f AS a, unnest(range(1, len(ph))) AS k FROM f WHERE len(ph) > 1
), b AS (
  SELECT c.lang, c.ph, c.a, c.k, x.f AS l, y.f AS r, t.n, (CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.ph = c.ph[1:c.k] JOIN f y ON y.lang = c.lang AND y.ph = c.ph[c.k + 1:len(c.ph)] JOIN t ON t.lang = c.lang
), d AS (SELECT lang, unnest([ph[1:len(ph) - 1], ph[2:len(ph)]]) AS ph, f FROM f WHERE len(ph) > 2
), o AS (
  SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) AS cut FROM b) z
  WHERE cut = 1 AND NOT EXISTS (SELECT 1 FROM d WHERE d.lang = z.lang AND d.ph = z.ph AND d.f >= z.a)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o
) WHERE rank <= 2000
"""
