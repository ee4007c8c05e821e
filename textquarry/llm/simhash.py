"""SimHash near-dedup with a Gray-order hierarchical index.

A text's words are the runs without ``[\\x20\\x09-\\x0D]`` of the text with A-Z lower-cased; each run of ``width`` words,
space-joined, is a shingle (fewer words: all of them, none: fingerprint zero). A fingerprint bit is set if more than half
of the shingles' XXH64 (seed 42) have it. Fingerprints link at ``radius`` or fewer differing bits, and documents are
labelled with the smallest doc_id that links reach.

Equal fingerprints collapse first. Fingerprints that link differ in ``radius`` of n blocks of bits at most, so they agree
on n - radius blocks at least: each fingerprint goes to the groups named by its values of so many blocks, or of the first
bits of them, and links are found in a group. Blocks and bits follow the number of fingerprints, so that groups hold some
hundreds at any size, and a small table is one group. Each group is one index: fingerprints sorted by Gray rank, with nodes
over runs of neighbours that hold the bits all of them share (mask and pattern). Pairs of nodes descend together, adding up
the differences of their shared bits, and are pruned as a whole beyond the radius. A group returns the edges of a spanning
forest, not its pairs, so a dense group costs one edge for each fingerprint; in groups of over ``DENSE``, those around some
pivots are joined before the descent, which then leaves out leaves of one component. The edges of all groups are contracted
by alternating large-star and small-star steps.

``similar`` takes these links as candidates, and the index again to link texts by the Jaccard similarity of their sets of
shingles itself.

Defined cases: null and empty texts have fingerprint zero and link like any other. Repeated rows are all returned. A
component whose ids are all null has a null label; else null ids don't count. Empty tables give empty results. Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, partitions, removed, scratch, small_batches, stored, text_of

WIDTH, RADIUS, SEED = 4, 4, 42
LEAF, FANOUT, FRONT, DENSE, PIVOTS = 16, 8, 1 << 17, 2048, 32
#: Fingerprints that a group has on average, at most, and from half of it on.
GROUP = 512
#: Edges in a task, when they are few.
EDGES = 200_000


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # for bytes: ASCII white space, A-Z
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - width + 1)
    spans = zip(starts[:last].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, last)


def fingerprint(text: str, width: int = WIDTH) -> int:
    return majority(shingle_hashes(text, width))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits((counts * 2 > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp: the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return text_of(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id").mapInArrow(lean(run), "doc_id bigint, fp bigint")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each fingerprint in the order of Gray codes."""
    for shift in (1, 2, 4, 8, 16, 32):
        fps = fps ^ (fps >> np.uint64(shift))
    return fps


def differing(bits: np.ndarray) -> np.ndarray:
    """Set bits in each row of words."""
    return np.bitwise_count(bits).sum(1, dtype=np.int32)


class GrayIndex:
    """Nodes over fingerprints (rows of 64-bit words) in Gray order; levels[0] are the leaves. Two fingerprints link if they
    differ in no more bits than their reaches, half a radius each, add up to. ``first`` are ranks that go before Gray ranks.
    With ``group``, fingerprints of one group only link, and nodes without a common group don't meet."""

    def __init__(self, fps: np.ndarray, reach: np.ndarray, first: np.ndarray | None = None, group: np.ndarray | None = None):
        keys = [gray_rank(w) for w in fps.T[::-1]]
        self.order = np.lexsort([*keys, *(x for x in (first, group) if x is not None)])
        self.fps, self.reach = fps[self.order], reach[self.order]
        self.group = group[self.order] if group is not None else None
        self.groups: list[tuple[np.ndarray, np.ndarray]] = []  # the first and the last group of each node
        low = high = self.group
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        every, some, far, step = self.fps, self.fps, self.reach, LEAF
        while True:
            cuts = np.arange(0, len(every), step)
            every, some, far = np.bitwise_and.reduceat(every, cuts, 0), np.bitwise_or.reduceat(some, cuts, 0), np.maximum.reduceat(far, cuts)
            self.levels.append((~(every ^ some), every, far))  # the bits that all below share, their pattern, the largest reach
            if low is not None and high is not None:
                low, high = low[cuts], high[np.append(cuts[1:], len(high)) - 1]
                self.groups.append((low, high))
            if len(every) == 1:
                break
            step = FANOUT

    def _children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs below pairs of nodes, each once."""
        step, size = (FANOUT, len(self.levels[level - 1][0])) if level else (LEAF, len(self.fps))
        offset = np.arange(step)
        x = np.broadcast_to((a * step)[:, None, None] + offset[None, :, None], (len(a), step, step)).ravel()
        y = np.broadcast_to((b * step)[:, None, None] + offset[None, None, :], (len(a), step, step)).ravel()
        keep = (x < size) & (y < size) & ((x <= y) if level else (x < y))
        return x[keep], y[keep]

    def pairs(self, label: Callable[[], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Linked places (in Gray order) and their distances, in pieces of bounded size; leaves of one label are left out."""
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if level < 0:
                apart = differing(self.fps[a] ^ self.fps[b])
                near = apart <= self.reach[a] + self.reach[b]
                if near.any():
                    yield a[near], b[near], apart[near]
                continue
            if level == 0:
                now = label()
                lo = np.minimum.reduceat(now, np.arange(0, len(self.fps), LEAF))
                hi = np.maximum.reduceat(now, np.arange(0, len(self.fps), LEAF))
                open_ = ~((lo[a] == hi[a]) & (lo[b] == hi[b]) & (lo[a] == lo[b]))
                a, b = a[open_], b[open_]
            most = max(1, FRONT // (LEAF * LEAF if level == 0 else FANOUT * FANOUT))
            for k in range(0, len(a), most):
                x, y = self._children(level, a[k : k + most], b[k : k + most])
                if self.group is not None:
                    low, high = self.groups[level - 1] if level else (self.group, self.group)
                    common = low[y] <= high[x]  # x is not behind y
                    x, y = x[common], y[common]
                if level:
                    mask, pattern, far = self.levels[level - 1]
                    near = differing((pattern[x] ^ pattern[y]) & mask[x] & mask[y]) <= far[x] + far[y]
                    x, y = x[near], y[near]
                if len(x):
                    stack.append((level - 1, x, y))


class Forest:
    """Labels of the connected places: the smallest place that links reach. ``edges`` are the links that joined them."""

    def __init__(self, size: int):
        self.label = np.arange(size)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def link(self, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> None:
        """Join what links a, b join; each component takes its shortest link to one with a smaller label."""
        while True:
            la, lb = self.label[a], self.label[b]
            new = la != lb
            if not new.any():
                return
            a, b, apart, la, lb = a[new], b[new], apart[new], la[new], lb[new]
            high, low = np.maximum(la, lb), np.minimum(la, lb)
            order = np.lexsort((apart, high))
            pick = order[np.append(True, np.diff(high[order]) != 0)]
            self.label[high[pick]] = low[pick]
            self.edges.append((a[pick], b[pick]))
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up


def spanning_edges(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (pairs of places of fps) that connect all that links of the group connect: one fewer than the places at most."""
    n = len(fps)
    forest, index = Forest(n), GrayIndex(fps, np.full(n, radius / 2))
    order = index.order
    if n > DENSE:  # what lies around a few pivots hangs together and needs no pairs
        for pivot in range(0, n, n // PIVOTS):
            apart = differing(index.fps ^ index.fps[pivot])
            near = np.flatnonzero((apart <= radius) & (np.arange(n) != pivot))
            if len(near):
                forest.link(np.full(len(near), pivot), near, apart[near])
    for a, b, apart in index.pairs(lambda: forest.label):
        forest.link(a, b, apart)
    if not forest.edges:
        return order[:0], order[:0]
    a, b = (np.concatenate(x) for x in zip(*forest.edges, strict=True))
    return order[a], order[b]


def blocks_for(count: int, radius: int) -> tuple[int, int]:
    """Into how many blocks to part fingerprints, and how many bits of n - radius blocks name a group, so that ``count`` of
    them make groups of GROUP on average at most. No bits: one group."""
    bits = max(0, (max(count, 1) - 1) // GROUP).bit_length()
    n = radius + 1
    while n < 4 * radius and 64 * (n - radius) // n < bits:
        n += 1
    return n, bits


def dealt_groups(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, block, value): the groups that each fingerprint, in the column fp, goes to."""
    n, bits = blocks_for(fps.count(), radius)
    bounds = [64 * k // n for k in range(n + 1)]

    def value(of: tuple[int, ...]) -> Column:
        """The first bits of some blocks, as many of each, the rest of the fingerprint blank."""
        share = -(-bits // len(of))
        kept = sum((1 << min(bounds[k + 1], bounds[k] + share)) - (1 << bounds[k]) for k in of)
        return F.col("fp").bitwiseAND(F.lit(kept - (1 << 64) if kept >> 63 else kept))

    every = list(combinations(range(n), n - radius)) if bits else [()]
    keys = F.array(*[F.struct(F.lit(k).alias("block"), (value(of) if of else F.lit(0).cast("bigint")).alias("value")) for k, of in enumerate(every)])
    return fps.select(F.col("fp").alias("node"), F.explode(keys).alias("b")).select("node", "b.block", "b.value")


def link_edges(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) with v < u: edges that connect all distinct fingerprints that links connect. ``fps`` holds the column fp."""
    return grouped_edges(dealt_groups(fps, radius), radius)


def grouped_edges(dealt: DataFrame, radius: int) -> DataFrame:
    """(u, v) with v < u from (node: a fingerprint, block, value): spanning_edges() of all groups of equal block and value. A
    task holds one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key = None

        def edges(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            nodes = np.concatenate(parts)
            a, b = spanning_edges(nodes.view(np.uint64).reshape(-1, 1), radius)
            return nodes[a], nodes[b]

        def out(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            u, v = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

        for batch in batches:
            node, block, value = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(node):
                continue
            cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(value) != 0)) + 1).tolist(), len(node)]
            found = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if key != (now := (int(block[a]), int(value[a]))):
                    if sum(map(len, held)) > 1:
                        found.append(edges(held))
                    held, key = [], now
                held.append(node[a:b])
            if found := [x for x in found if len(x[0])]:
                yield out(found)
        if sum(map(len, held)) > 1 and len((last := edges(held))[0]):
            yield out([last])

    spark = dealt.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "32768")
    grouped = dealt.repartition(partitions(spark), "block", "value").sortWithinPartitions("block", "value")
    return grouped.mapInArrow(lean(run), "u bigint, v bigint").distinct()


def contracted(edges: DataFrame) -> DataFrame:
    """(u, v): each node with the smallest node that edges reach, other than itself. A round's edges are never more than before."""
    spark = edges.sparkSession
    path = scratch(spark, "edges")
    edges.where("u <> v").write.parquet(path)
    mark, tasks = None, partitions(spark)
    while True:
        now = spark.read.schema("u bigint, v bigint").parquet(path)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == mark or not state[0]:
            return now
        mark, tasks = tuple(state), min(tasks, 1 + state[0] // EDGES)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        large = stored(large.coalesce(tasks), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        old, path = path, scratch(spark, "edges")
        small.coalesce(tasks).write.parquet(path)
        removed(spark, old)


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, root, component_id) for each row: its fingerprint, its component's fingerprint and smallest doc_id."""
    fps = stored(fingerprints(docs, width), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct_fingerprints")
    nodes = distinct.select(F.col("fp").alias("node"), "least_id")
    found = labelled(fps.select("doc_id", F.col("fp").alias("node")), nodes, link_edges(distinct.select("fp"), radius))
    return found.withColumnRenamed("node", "fp")


def labelled(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (doc_id, node, ...) with root and component_id, for nodes (node, least_id) and edges (u, v)."""
    links = contracted(edges).withColumnsRenamed({"u": "node", "v": "root"})
    rooted = stored(nodes.join(links, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root")), "rooted")
    labels = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_node = rooted.select("node", "root").join(labels, "root")
    return rows.join(of_node, "node").select(*rows.columns, "root", "component_id")


def near_duplicates_query(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
