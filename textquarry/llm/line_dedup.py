"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, with A-Z lower-cased. Keys of at least
``min_chars`` code points that occur in three or more documents lose all their lines, except in the document with the
largest doc_id among those that hold the key.

Keys are recorded as 128-bit hashes in *runs*: tables bucketed and sorted by hash with one entry for each key. An entry
says how many different documents hold the key (1, 2, or 3 for any more), the smallest and the largest of their ids, and
how many lines were seen. With one or two documents those two ids are all the ids there are, so merging entries is exact
and adding a document again changes nothing. Each new batch is reduced to such entries, merge-anti-joined with the
runs (what the runs have settled already is not recorded again) and added as a run of level 0; ``fanout`` runs of one
level are compacted into one of the next. There are as many batches as the number of lines asks for, and always more than
the fanout, so that runs are compacted in any table: groups of the written files of hashes or, where those are fewer, the
rows by ranges of the hash of their doc_id.

Defined cases: a null or empty text is one empty line. Rows with equal doc_id count as one document, and so do all rows
whose doc_id is null, which comes before every other id. Repeated rows are all returned. Empty tables give empty results.
Only ``doc_id`` and ``text`` are read; other columns pass through whatever their names.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACES, UPPER, bucketed, dropped, partitions, stored, unused

MIN_CHARS, MIN_DOCS, FANOUT = 20, 3, 3
#: Lines in a batch, where that makes more batches than FANOUT.
BATCH_LINES = 1 << 32
#: A key counted in one 2000th of all lines is joined by broadcast: there are 2000 such keys at most.
HOT_SHARE = 2000


def line_key(line: Column) -> Column:
    line = F.btrim(line, F.lit(SPACES))
    ascii_only = F.octet_length(line) == F.char_length(line)
    return F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, th, pos, h1, h2) for each line whose key is long enough; th tells texts of one doc_id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select("doc_id", text.alias("text")).select(
        "doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    )
    keys = lines.select("doc_id", "th", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def batch_entries(hashes: DataFrame) -> DataFrame:
    """One entry for each key. Both steps combine before they shuffle, so that a hot key costs a row per task."""
    once = hashes.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("m"))
    return once.groupBy("h1", "h2").agg(
        F.least(F.count("*"), F.lit(MIN_DOCS)).cast("int").alias("n"),
        F.max(F.col("doc_id").isNull()).alias("nul"),
        F.min("doc_id").alias("lo"),
        F.max("doc_id").alias("hi"),
        F.sum("m").alias("m"),
    )


def merged_entries(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two runs as one: a sort-merge join, for which runs in equal buckets need no shuffle."""
    a, b = one.alias("a"), other.alias("b")
    both = a.join(b.hint("merge"), ["h1", "h2"], "full")
    ids = F.size(F.array_distinct(F.array_compact(F.array("a.lo", "a.hi", "b.lo", "b.hi"))))
    nul = F.coalesce("a.nul", F.lit(False)) | F.coalesce("b.nul", F.lit(False))
    few = F.when((F.col("a.n") >= MIN_DOCS) | (F.col("b.n") >= MIN_DOCS), MIN_DOCS).otherwise(ids + nul.cast("int"))
    return both.select(
        "h1",
        "h2",
        F.least(few, F.lit(MIN_DOCS)).cast("int").alias("n"),
        nul.alias("nul"),
        F.least("a.lo", "b.lo").alias("lo"),
        F.greatest("a.hi", "b.hi").alias("hi"),
        (F.coalesce("a.m", F.lit(0)) + F.coalesce("b.m", F.lit(0))).alias("m"),
    )


class LineRuns:
    """The levelled runs. Tables lie under the shared folder; ``levels[k]`` names the runs of level k."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None, often: float = math.inf):
        """often: a batch's keys with so many lines are always recorded, so that they are counted in full."""
        self.spark, self.fanout, self.often = spark, fanout, often
        self.buckets = buckets or partitions(spark)
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def _write(self, entries: DataFrame) -> str:
        name, path = bucketed(entries, "line_run", self.buckets, "h1", "h2")
        self.paths[name] = path
        return name

    def add(self, hashes: DataFrame) -> None:
        """Record a batch of line_hashes()."""
        fresh = batch_entries(hashes)
        for run in self.runs():
            settled = self.spark.table(run).where(F.col("n") >= MIN_DOCS).select("h1", "h2", F.col("hi").alias("settled_hi"))
            known = (fresh.h1 == settled.h1) & (fresh.h2 == settled.h2) & (fresh.hi.isNull() | (settled.settled_hi >= fresh.hi)) & (fresh.m < self.often)
            fresh = fresh.join(settled.hint("merge"), known, "left_anti")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(fresh))
        self._compact()

    def _compact(self) -> None:
        k = 0
        while k < len(self.levels):
            if len(self.levels[k]) >= self.fanout:
                old, self.levels[k] = self.levels[k], []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(self._union(old)))
                self.drop(old)
            k += 1

    def _union(self, names: list[str]) -> DataFrame:
        tables = [self.spark.table(x) for x in names]
        return functools.reduce(merged_entries, tables)

    def entries(self) -> DataFrame:
        return self._union(self.runs())

    def drop(self, names: list[str] | None = None) -> None:
        for name in names or self.runs():
            dropped(self.spark, name, self.paths.pop(name))


def batched(hashes: DataFrame, files: list[str], fanout: int, batch_lines: int) -> tuple[int, list[DataFrame]]:
    """How many lines there are, and the batches. Rows of a document may be in several; entries merge all the same."""
    total = hashes.count()
    n = max(fanout + 1, -(-total // batch_lines)) if total else 0
    if len(files) < n:
        return total, [hashes.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) == k) for k in range(n)]
    return total, [hashes.sparkSession.read.schema(hashes.schema).parquet(*files[k::n]) for k in range(n)]


def dropped_positions(docs: DataFrame, min_chars: int, fanout: int, batch_lines: int) -> DataFrame:
    """(doc_id, th, drop: positions of the lines to drop) for the texts that lose lines."""
    spark = docs.sparkSession
    hashes = stored(line_hashes(docs, min_chars), "line_hashes")
    total, batches = batched(hashes, sorted(hashes.inputFiles()), fanout, batch_lines)

    # A key with two 2000ths of the lines is counted in half of them at least, as its rare batches hold less than one.
    runs = LineRuns(spark, fanout, often=total / HOT_SHARE / max(1, len(batches)))
    for batch in batches:
        runs.add(batch)
    repeated = stored(runs.entries().where(F.col("n") >= MIN_DOCS).select("h1", "h2", "hi", "m"), "repeated_lines") if batches else None
    runs.drop()
    if repeated is None:
        return hashes.where("false").groupBy("doc_id", "th").agg(F.collect_list("pos").alias("drop"))

    is_hot = F.col("m") * HOT_SHARE >= F.lit(total)
    hot, rest = repeated.where(is_hot).drop("m"), repeated.where(~is_hot).drop("m")
    not_last = ~F.col("doc_id").eqNullSafe(F.col("hi"))
    of_hot = hashes.join(F.broadcast(hot), ["h1", "h2"]).where(not_last)
    of_rest = hashes.join(rest, ["h1", "h2"]).where(not_last)
    return of_hot.unionByName(of_rest).groupBy("doc_id", "th").agg(F.collect_list("pos").alias("drop"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, fanout: int = FANOUT, batch_lines: int = BATCH_LINES) -> tuple[DataFrame, dict[str, str]]:
    """docs with three more columns, and their names by what they hold: kept (the text that stays), n_lines, n_dropped."""
    name = {x: unused(docs, f"line_dedup_{x}") for x in ("kept", "n_lines", "n_dropped", "th", "text", "drop", "drop_id", "drop_th")}
    drops = dropped_positions(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")), min_chars, fanout, batch_lines)
    drops = drops.select(F.col("doc_id").alias(name["drop_id"]), F.col("th").alias(name["drop_th"]), F.col("drop").alias(name["drop"]))
    hashed = docs.withColumn(name["th"], F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(name["drop_id"])) & (F.col(name["th"]) == F.col(name["drop_th"]))
    joined = hashed.join(drops, same, "left")

    text, drop = F.coalesce(F.col("text"), F.lit("")), F.col(name["drop"])
    count = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1

    def staying(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
        return F.array_join(F.transform(stay, lambda p: F.get(lines, p)), "\n")

    # The text alone is shuffled; its lines are the one element of an array here, so that they are split once.
    left = F.get(F.transform(F.array(F.split(text, "\n", -1)), staying), 0)
    out = joined.select(
        *docs.columns,
        F.when(drop.isNull(), text).otherwise(left).alias(name["kept"]),
        count.cast("bigint").alias(name["n_lines"]),
        F.when(drop.isNull(), 0).otherwise(F.size(F.array_distinct(drop))).cast("bigint").alias(name["n_dropped"]),
    )
    return out, {x: name[x] for x in ("kept", "n_lines", "n_dropped")}


def deduped_documents(docs: DataFrame, **options: int) -> DataFrame:
    """docs without the lines that repeat, in the columns of docs; n_chars, if there, counts what stays."""
    out, name = dedup_lines(docs, **options)
    new = {"text": F.col(name["kept"]).alias("text"), "n_chars": F.char_length(name["kept"]).cast("bigint").alias("n_chars")}
    return out.select(*[new.get(c, F.col(c)) for c in docs.columns])


def line_dedup_query(docs: DataFrame) -> DataFrame:
    out, name = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col(name["n_lines"]).alias("n_lines"), F.col(name["n_dropped"]).alias("n_dropped"), F.sha2(name["kept"], 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), repeated AS (
  SELECT key, max(doc_id) AS last_id FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.pos, l.line, (r.key IS NOT NULL AND l.doc_id <> r.last_id) AS gone
  FROM lines l LEFT JOIN repeated r ON l.key = r.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
