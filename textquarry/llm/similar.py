"""SimHash near-dedup with a Gray-order hierarchical index, held to the similarity of texts' sets of shingles.

Texts link where the Jaccard similarity of their sets of word shingles is ``similarity`` or more (five words and 0.8 in the
pipeline). Texts of equal sets are one node, whose SimHash has the bits that most of the set's shingles have. SimHashes that
differ in ``radius`` bits or fewer are found by ``simhash``'s index, and their nodes are tested on the shingles themselves.

No link is lost, but for collisions of 64-bit hashes, and SimHash alone would lose some: bits of majority bound nothing. So
what it leaves is completed exactly. A second fingerprint of a set has BITS parity bits, each of the number of shingles
whose hash falls on it. Two of them differ in no more bits than the sets differ in shingles, and sets of the similarity
differ in (1 - similarity) / (1 + similarity) of their sizes' sum at most, so a pair beyond that is no link.

A node goes to the shingles of its set's prefix: the first of them in an order that all texts share, rare ones first by
counts over all texts, so many that sets of the similarity have one in common. What shares none of them with another is
done. Rounds follow, in which links are tested on the shingles before they join anything. Beside SimHash's links, each node
first meets the least node that it shares a shingle with and the neighbour it shares most with, which joins groups of copies
at a link or two for each text. Then, among the nodes of a shingle that are not joined yet, the pairs within the bounds of
size, place and parity bits are found by the same index: one for each large group, and one for the small groups of a batch
together. Twice each node is tested against the nearest of them only, which joins most of what remains to be joined, and at
last all of them are tested.

Defined cases: texts without words have the empty set and are one node. Repeated rows are all returned. A component whose
ids are all null has a null label; else null ids don't count. Empty tables give empty results. Only ``doc_id`` and ``text``
are read; other columns of documents pass through whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, collected, dropped, lean, partitions, removed, scratch, small_batches, stored, text_of, unused
from .simhash import DENSE, RADIUS, SEED, GrayIndex, contracted, labelled, link_edges, majority, shingle_hashes

SIMILARITY, WIDTH, BITS = 0.8, 5, 512
#: Shingles are counted in BUCKETS by their hash, and these summed in CHUNKS.
BUCKETS, CHUNKS = 1 << 20, 64
#: How often nodes meet only the nearest one that they are not joined with, before all pairs that are left are tested.
NEAREST_ROUNDS = 2


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of a text's shingles, each once."""
    return np.unique(shingle_hashes(text, width))


def bucket_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def parity(shingles: np.ndarray) -> bytes:
    """BITS bits: whether an odd number of the shingles falls on each."""
    return np.packbits(np.bincount((shingles % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).tobytes()


def commonness(texts: DataFrame, width: int) -> np.ndarray:
    """For each bucket of shingles a level, a quarter of the logarithm to base 2 of how often all texts have shingles in it."""
    size = BUCKETS // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch.column(0)]
            if sets:
                np.add(total, np.bincount(bucket_of(np.concatenate(sets)), minlength=BUCKETS), out=total, casting="unsafe")
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([x.tobytes() for x in total.reshape(CHUNKS, size)], pa.binary())], ["chunk", "counts"])

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts.as_buffer(), np.uint32).astype(np.uint64)
        levels = [np.minimum(255, 4 * np.log2(x + np.uint64(1))).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["chunk", "levels"])

    small_batches(texts.sparkSession)
    counted = texts.select("text").mapInArrow(lean(count), "chunk int, counts binary")
    rows = counted.repartition(CHUNKS, "chunk").mapInArrow(lean(level), "chunk int, levels binary").collect()  # BUCKETS bytes
    levels = np.zeros((CHUNKS, size), np.uint8)
    for chunk, got in rows:
        levels[chunk] = np.frombuffer(got, np.uint8)
    return levels.ravel()


def prefix(shingles: np.ndarray, levels: np.ndarray, similarity: float) -> np.ndarray:
    """The first of the shingles in an order that all texts share, the common ones last: so many that sets of the
    similarity share one of them at least."""
    n = len(shingles)
    if not n:
        return shingles
    return shingles[np.argsort(levels[bucket_of(shingles)], kind="stable")[: n - math.ceil(similarity * n - 1e-9) + 1]]


def similar_nodes(docs: DataFrame, similarity: float, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (doc_id, th: hash of the text, node), nodes (node, size, least_id, head, copies) and links (u, v) with v < u."""
    spark = docs.sparkSession
    texts = text_of(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id").withColumn("th", F.xxhash64("text"))
    levels = spark.sparkContext.broadcast(commonness(texts, width))  # BUCKETS bytes

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sets = [shingle_set(t, width) for t in texts]
            first = [prefix(x, levels.value, similarity) for x in sets]
            packed = pa.array([packer.compress(t.encode("utf-8", "surrogatepass")) for t in texts], pa.binary())
            node = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            offsets = np.cumsum([0, *map(len, first)]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*first, np.zeros(0, np.uint64)]).view(np.int64)))
            columns = [batch.column(0), batch.column(2), pa.array(node), pa.array([len(x) for x in sets], pa.int32()), pa.array(np.array([majority(x) for x in sets], np.uint64).view(np.int64)), pa.array([parity(x) for x in sets], pa.binary()), tokens, packed]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "node", "size", "fp", "bits", "prefix", "packed"])

    small_batches(spark)
    schema = "doc_id bigint, th bigint, node bigint, size int, fp bigint, bits binary, prefix array<bigint>, packed binary"
    path = scratch(spark, "shingle_prefixes")
    texts.mapInArrow(lean(read), schema).write.parquet(path)  # bits, prefixes and packed texts don't shrink any more
    made = spark.read.schema(schema).parquet(path)
    rows = stored(made.select("doc_id", "th", "node"), "text_nodes")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th")).alias("head")
    distinct = made.groupBy("node").agg(F.first("size").alias("size"), F.min("doc_id").alias("least_id"), head, F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("fp", "bits", "prefix", "packed")])
    table, folder = bucketed(distinct, "shingle_nodes", partitions(spark), "node", dealt=True)
    full = spark.table(table)
    removed(spark, path)
    del made, distinct
    collected(spark)
    nodes = stored(full.select("node", "size", "least_id", "head", "copies"), "nodes")
    shared = shared_shingles(full)
    collected(spark)

    def apart(x: Column) -> Column:
        """Whether this row and the row x of a shingle can be of the similarity, by their sizes and places."""
        small, large = F.least("size", x["size"]), F.greatest("size", x["size"])
        return (small >= similarity * large - 1e-9) & (F.least("left", x["left"]) >= similarity / (1 + similarity) * (small + large) - 1e-9)

    met = shared.select(F.col("node").alias("u"), F.explode(F.array("first", "before")).alias("x"), "size", "left").where(F.col("x").isNotNull() & (F.col("x.node") != F.col("u"))).where(apart(F.col("x")))
    met = met.groupBy("u", F.col("x.node").alias("v")).agg(F.count("*").alias("times"))
    best = met.groupBy("u").agg(F.array_distinct(F.array(F.min("v"), F.max_by("v", F.struct("times", "v")))).alias("v"))
    alike = simhash_candidates(stored(full.select("node", "fp"), "node_fingerprints"))
    few = stored(alike.unionByName(best.select("u", F.explode("v").alias("v"))).distinct(), "first_candidates")
    texts_of = full.select("node", "packed")
    tested, links = few, stored(verified(few, texts_of, similarity, width), "links")
    open_ = shared.select("token", "node", "size", "left")
    for k in range(NEAREST_ROUNDS + 1):
        joined = contracted(links).withColumnsRenamed({"u": "node", "v": "label"})
        open_ = stored(still_open(open_, joined), "open_shingles")
        marked = open_.join(full.select("node", "bits").hint("merge"), "node")
        found = stored(candidate_pairs(marked, similarity, nearest=k < NEAREST_ROUNDS), "candidates")
        new = stored(found.join(tested.hint("merge"), ["u", "v"], "left_anti"), "candidates")
        tested, links = tested.unionByName(new), links.unionByName(stored(verified(new, texts_of, similarity, width), "links"))
        # nodes without any candidate that they are not joined with get none later
        live = found.select(F.col("u").alias("node")).unionByName(found.select(F.col("v").alias("node"))).distinct()
        open_ = open_.drop("label").join(live.hint("merge"), "node", "left_semi")
    dropped(spark, table, folder)
    collected(spark)
    return rows, nodes, links


def simhash_candidates(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) with v < u: pairs that connect all nodes (node, fp) whose SimHashes, the column fp, are connected by links. Nodes of
    one SimHash meet at the least of them."""
    heads = stored(nodes.groupBy("fp").agg(F.min("node").alias("head")), "distinct_fingerprints")
    same = nodes.join(heads, "fp").where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    one, other = (heads.withColumnsRenamed({"fp": x, "head": f"{x}_head"}) for x in "uv")
    apart = link_edges(heads.select("fp"), radius).join(one, "u").join(other, "v")
    return same.unionByName(apart.select(F.greatest("u_head", "v_head").alias("u"), F.least("u_head", "v_head").alias("v")))


def still_open(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows (token, node, ...) of the tokens whose nodes aren't all joined, with the node's label."""
    now = rows.join(joined.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = now.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    return now.join(mixed.hint("merge"), "token", "left_semi")


def shared_shingles(nodes: DataFrame) -> DataFrame:
    """(token, node, size, left, first, before) for the shingles of the prefixes that two nodes have or more: left is how
    many shingles of the node's set don't come before the shingle, first the least node with it, before the next less one."""
    dealt = nodes.select("node", "size", F.posexplode("prefix").alias("place", "token")).select("token", "node", "size", (F.col("size") - F.col("place")).alias("left"))
    order = Window.partitionBy("token").orderBy("node")
    here = F.struct("node", "size", "left")
    found = dealt.withColumns({"first": F.first(here).over(order), "before": F.lag(here).over(order), "more": F.lead("node").over(order)})
    return stored(found.where(F.col("before").isNotNull() | F.col("more").isNotNull()).drop("more"), "shared_shingles")


def candidate_pairs(rows: DataFrame, similarity: float, nearest: bool = False, dense: int = DENSE) -> DataFrame:
    """(u, v) with v < u: nodes (token, node, size, left, label, bits) of different labels that share a token, whose sizes,
    places of it and fingerprints allow the similarity if it is the first that they share. With ``nearest``,
    only the one for each node that differs in the fewest bits. More nodes of a token than ``dense`` have an index of their own."""
    need, reach = similarity / (1 + similarity), (1 - similarity) / (1 + similarity)

    def within(size: np.ndarray, left: np.ndarray, label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        return (label[a] != label[b]) & (small >= similarity * large - 1e-9) & (np.minimum(left[a], left[b]) >= need * (small + large) - 1e-9)

    def linked(token: np.ndarray, size: np.ndarray, left: np.ndarray, label: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        like = np.floor(np.log(np.maximum(size, 1)) / -np.log(similarity)) if similarity < 1 else size
        index = GrayIndex(bits, size * reach + 1e-9, like, token)
        o = index.order
        now = label[o]
        for a, b, apart in index.pairs(lambda: now):
            keep = within(size, left, label, o[a], o[b])
            yield o[a[keep]], o[b[keep]], apart[keep]

    def out(node: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for a, b, apart in pairs:
            if nearest:  # each end's own row, u
                u, v, apart = np.concatenate((node[a], node[b])), np.concatenate((node[b], node[a])), np.concatenate((apart, apart))
                order = np.lexsort((v, apart, u))
                order = order[np.append(True, np.diff(u[order]) != 0)] if len(u) else order
            else:
                u, v = np.maximum(node[a], node[b]), np.minimum(node[a], node[b])
                order = np.lexsort((v, u))
                order = order[np.append(True, (np.diff(u[order]) != 0) | (np.diff(v[order]) != 0))] if len(u) else order
            if len(order):
                yield pa.RecordBatch.from_arrays([pa.array(u[order]), pa.array(v[order]), pa.array(apart[order].astype(np.int32))], ["u", "v", "apart"])

    def of_groups(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Whole groups, one after the other."""
        token, node, *rest = columns
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        lengths = np.diff(np.append(first, len(token)))
        large = lengths > dense
        for a, n in zip(first[large].tolist(), lengths[large].tolist(), strict=True):
            yield from out(node[a : a + n], linked(token[a : a + n], *(c[a : a + n] for c in rest)))
        on = np.repeat(~large, lengths)
        if on.any():
            yield from out(node[on], linked(token[on], *(c[on] for c in rest)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # of the last shingle, whose rows may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            now.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(-1, BITS // 64))
            cut = int(np.searchsorted(now[0], now[0][-1], "left"))
            if cut or (held and held[-1][0][-1] != now[0][0]):
                parts = [*held, *([[c[:cut] for c in now]] if cut else [])]
                yield from of_groups([np.concatenate(x) for x in zip(*parts, strict=True)])
                held = []
            held.append([c[cut:] for c in now])
        if held:
            yield from of_groups([np.concatenate(x) for x in zip(*held, strict=True)])

    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")
    grouped = rows.select("token", "node", "size", "left", "label", "bits").repartition(partitions(spark), "token").sortWithinPartitions("token", "node")
    found = grouped.mapInArrow(lean(run), "u bigint, v bigint, apart int")
    if nearest:
        best = found.groupBy("u").agg(F.min_by("v", F.struct("apart", "v")).alias("v"))
        found = best.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return found.select("u", "v").distinct()


def verified(edges: DataFrame, texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """The edges (u, v) whose texts' shingles have the similarity; texts (node, packed) are in buckets by node."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        sets: dict[int, np.ndarray] = {}

        def set_of(node: int, packed: bytes) -> np.ndarray:
            if node not in sets:
                sets[node] = shingle_set(unpacker.decompress(packed).decode("utf-8", "surrogatepass"), width)
            return sets[node]

        for batch in batches:
            keep = []
            for u, v, one, other in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                a, b = set_of(u, one), set_of(v, other)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(common >= similarity * (len(a) + len(b) - common) - 1e-9)
            kept = batch.filter(pa.array(keep, pa.bool_()))
            sets.clear()  # a batch has few texts
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["u", "v"])

    small_batches(edges.sparkSession)
    a, b = (texts.withColumnsRenamed({"node": x, "packed": f"{x}_text"}) for x in "uv")
    pairs = edges.join(a.hint("merge"), "u").join(b.hint("merge"), "v").select("u", "v", "u_text", "v_text")
    return pairs.mapInArrow(lean(compare), "u bigint, v bigint")


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """(doc_id, th, node, root, component_id) for each row of docs."""
    rows, nodes, links = similar_nodes(docs, similarity, width)
    return labelled(rows, nodes.select("node", "least_id"), links)


def deduped_documents(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """One row of docs for each component: the one with the smallest doc_id, nulls last, and of rows with that id the one
    whose text has the least hash. Rows are told apart by doc_id and text; those that go are joined against, as they are
    fewer than those that stay."""
    name = unused(docs, "near_dedup_text")
    rows, nodes, links = similar_nodes(docs, similarity, width)
    joined = contracted(links).withColumnsRenamed({"u": "node", "v": "root"})
    of_root = nodes.join(joined, "node", "left").select("node", "head", "copies", F.coalesce("root", "node").alias("root"), F.col("root").isNotNull().alias("joined"))
    of_root = stored(of_root.select("*"), "node_roots")
    heads = of_root.groupBy("root").agg(F.min("head").alias("stays"), F.count("*").alias("nodes"))
    several = stored(of_root.join(heads, "root").where("copies > 1 OR nodes > 1").select(F.col("node").alias("n"), "stays"), "several_rows")
    found = rows.join(several, rows["node"] == several["n"])
    is_head = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("th") == F.col("stays.th"))
    gone = found.where(~is_head).select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).distinct()
    hashed = docs.withColumn(name, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    kept = hashed.join(gone, hashed["doc_id"].cast("bigint").eqNullSafe(gone["gone_id"]) & (hashed[name] == gone["gone_th"]), "left_anti")
    if rows.groupBy("doc_id", "th").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", name])
    return kept.select(*docs.columns)
