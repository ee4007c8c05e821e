"""Best-fit packing with Martello-Toth dominance reduction.

Documents are token ids with an end id, packed into sequences of ``capacity`` ids. Longer ones are cut into pieces of
``capacity``, of which the first may be shorter; whole pieces are sequences of their own. The others are a bin-packing
instance with fewer than ``capacity`` different lengths, so the driver sees one count for each length, however many
documents there are.

Over those counts, bins that provably dominate all other bins with an open length are fixed for good, for every length from
the longest on, until a whole pass fixes none: the length alone if nothing fits beside it; the length with its exact
complement; the length with the longest that fits, if no two others fit beside it, or two but none longer together; and two
others beside it, if no three fit and each of any other pair is no longer than one of them. All bins of a kind are fixed at
once. What is left goes best fit, the longest first: into the open bin with the least room that holds it. Bins of one kind
have the same lengths in them and are kept as kind and count.

Each piece then finds its place by its rank among the pieces of its length: ranks are counted within write tasks and
shifted by the counts of the tasks before, so that a length which a third of all documents share meets in no task.

Defined cases: a null or empty text has the end id only. Repeated rows, and rows with null ids, are packed like others.
Empty tables give empty results. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, scratch, small_batches, text_of
from .tokens import byte_encoder

CAPACITY = 1024
Bins = list[tuple[tuple[int, ...], int]]


class Open:
    """Lengths not yet packed, with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.count = {n: c for n, c in counts.items() if c > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, times: int) -> None:
        self.count[size] -= times
        if not self.count[size]:
            del self.count[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def longest(self, room: int, but: Counter[int] | None = None) -> int:
        """The longest length that fits, of which more are open than ``but`` says; 0 if none."""
        k = bisect_right(self.sizes, room) - 1
        while k >= 0 and but and self.count[self.sizes[k]] <= but[self.sizes[k]]:
            k -= 1
        return self.sizes[k] if k >= 0 else 0

    def two_least(self, but: int) -> int:
        """The sum of the two shortest lengths besides one of ``but``; very large if there are fewer than two."""
        got: list[int] = []
        for s in self.sizes:
            got += [s] * min(2, self.count[s] - (s == but))
            if len(got) >= 2:
                return got[0] + got[1]
        return 1 << 60

    def longest_pair(self, room: int) -> int:
        """No two lengths that fit together are longer."""
        best, k = 0, bisect_right(self.sizes, room) - 1
        for i, s in enumerate(self.sizes):
            while k >= i and s + self.sizes[k] > room:
                k -= 1
            if k < i:
                break
            best = max(best, s + self.sizes[k])
        return best


def times_of(bin_: tuple[int, ...], open_: Open) -> int:
    return min(open_.count[s] // k for s, k in Counter(bin_).items())


def dominating(open_: Open, size: int, capacity: int) -> tuple[int, ...] | None:
    """A bin with an open length that is part of some best packing, as what other bins hold beside the length can change
    places with what this one does; or None."""
    room = capacity - size
    mate = open_.longest(room, Counter([size]))
    if not mate:
        return (size,)
    least = open_.two_least(size)
    if mate == room or least > room:
        return (size, mate)
    if least + open_.sizes[0] > room:  # no three fit: others hold one length, of mate at most, or two of them, p >= q
        second = open_.longest(room - mate, Counter([size, mate]))
        if second:
            if open_.longest(room // 2) <= second:  # q is half the room at most
                return (size, mate, second)
        elif open_.longest_pair(room) <= mate:
            return (size, mate)
    return None


def reduced(open_: Open, capacity: int) -> Bins:
    """The bins that dominance fixes; their lengths are open no more."""
    bins: Bins = []
    while True:
        before = len(bins)
        for size in open_.sizes[::-1]:
            while size in open_.count and (bin_ := dominating(open_, size, capacity)):
                n = max(1, times_of(bin_, open_))
                for s in bin_:
                    open_.take(s, n)
                bins.append((bin_, n))
        if len(bins) == before:
            return bins


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> Bins:
    """Bins as (lengths, how many), for counts of lengths from 1 to capacity."""
    open_ = Open(counts)
    return reduced(open_, capacity) + best_fit(open_, capacity)


def best_fit(open_: Open, capacity: int) -> Bins:
    fitted = Counter[tuple[int, ...]]()
    rooms: dict[int, list[tuple[int, ...]]] = {}  # open kinds by their room
    room_sizes: list[int] = []
    while open_.sizes:
        size = open_.sizes[-1]
        left = open_.count[size]
        open_.take(size, left)
        while left:
            k = bisect_left(room_sizes, size)
            if k == len(room_sizes):  # new bins, each as full of this length as it gets
                per = capacity // size
                for kind, n in (((size,) * per, left // per), ((size,) * (left % per), 1 if left % per else 0)):
                    if n:
                        _add(kind, n, capacity, fitted, rooms, room_sizes)
                break
            room = room_sizes[k]
            kind = rooms[room][-1]
            per = min(room // size, left)
            n = min(fitted[kind], left // per)
            _remove(kind, n, room, fitted, rooms, room_sizes)
            _add(kind + (size,) * per, n, capacity, fitted, rooms, room_sizes)
            left -= n * per
    return [(kind, n) for kind, n in fitted.items() if n]


def _add(kind: tuple[int, ...], n: int, capacity: int, fitted: Counter[tuple[int, ...]], rooms: dict[int, list[tuple[int, ...]]], room_sizes: list[int]) -> None:
    room = capacity - sum(kind)
    if not fitted[kind] and room:
        if room not in rooms:
            rooms[room] = []
            insort(room_sizes, room)
        rooms[room].append(kind)
    fitted[kind] += n


def _remove(kind: tuple[int, ...], n: int, room: int, fitted: Counter[tuple[int, ...]], rooms: dict[int, list[tuple[int, ...]]], room_sizes: list[int]) -> None:
    fitted[kind] -= n
    if not fitted[kind]:
        rooms[room].remove(kind)
        if not rooms[room]:
            del rooms[room]
            room_sizes.pop(bisect_left(room_sizes, room))


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Martello and Toth's L2: no packing has fewer bins."""
    best = -(-sum(s * c for s, c in counts.items()) // capacity)
    for k in sorted({s for s in counts if s <= capacity // 2} | {0}):
        big = sum(c for s, c in counts.items() if s > capacity - k)
        mid = [(s, c) for s, c in counts.items() if capacity / 2 < s <= capacity - k]
        low = sum(s * c for s, c in counts.items() if k <= s <= capacity / 2)
        n = sum(c for _, c in mid)
        best = max(best, big + n + max(0, -(-(low - (n * capacity - sum(s * c for s, c in mid))) // capacity)))
    return best


def places(bins: Bins) -> dict[int, dict[str, np.ndarray]]:
    """By length: rank of the first piece of each run, and the run's first sequence, pieces in a bin and first offset."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter[int] = Counter()
    sequence = 0
    for lengths, n in bins:
        offset = 0
        for size, per in sorted(Counter(lengths).items(), reverse=True):
            runs.setdefault(size, []).append((used[size], sequence, per, offset))
            used[size] += per * n
            offset += per * size
        sequence += n
    return {size: dict(zip(("rank", "sequence", "per", "offset"), np.array(r, np.int64).T, strict=True)) for size, r in runs.items()}


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, nth bigint"


def cut(docs: DataFrame, capacity: int, encoder: Callable[[], Callable[[str], np.ndarray]], keep_ids: bool = False) -> DataFrame:
    """The pieces of docs (doc_id, text), each with its task and how many of its length the task had before it."""
    small_batches(docs.sparkSession)
    schema = PIECES + (", ids array<bigint>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode, had = TaskContext.get().partitionId(), encoder(), Counter[int]()
        for batch in batches:
            rows: list[tuple] = []
            kept = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text)
                ends = range(len(ids) % capacity or capacity, len(ids) + 1, capacity)
                for k, end in enumerate(ends):
                    start = max(0, end - capacity) if k else 0
                    part = ids[start:end]
                    rows.append((doc, k, start, end - start, zlib.crc32(part.astype("<u4", copy=False).tobytes()), task, had[end - start]))
                    had[end - start] += 1
                    if keep_ids:
                        kept.append(part)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, (pa.int64(), pa.int32(), *[pa.int64()] * 5), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
            if keep_ids:
                columns.append(pa.array([x.astype(np.int64) for x in kept], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(lean(run), schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizers: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for) for each piece."""
    spark = docs.sparkSession
    columns = text_of(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id")
    made = cut(columns, capacity, lambda: byte_encoder(tokenizers).ids, keep_ids)
    path = scratch(spark, "pieces")
    made.write.parquet(path)
    pieces = spark.read.schema(made.schema).parquet(path)

    of_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = of_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in of_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    full = counts.pop(capacity, 0)
    by_size = places(pack(counts, capacity))
    if full:
        by_size[capacity] = {"rank": np.array([0]), "sequence": np.array([sum(n for _, n in pack(counts, capacity))]), "per": np.array([1]), "offset": np.array([0])}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                on, p = np.flatnonzero(length == size), by_size[int(size)]
                k = np.searchsorted(p["rank"], rank[on], "right") - 1
                nth = rank[on] - p["rank"][k]
                sequence[on] = p["sequence"][k] + nth // p["per"][k]
                offset[on] = p["offset"][k] + nth % p["per"][k] * size
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    ranked = pieces.join(shifts, ["length", "task"])
    ids = ["ids"] if keep_ids else []
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *ids, (F.col("before") + F.col("nth")).alias("rank"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint," + (" ids array<bigint>," if keep_ids else "") + " sequence_id bigint, offset bigint"
    return ranked.mapInArrow(lean(place), schema)
