"""Exact top-k search by inner product with vector-approximation files.

Vectors are integers: floor(64 * x) of each component x. Blocks of ``BLOCK`` vectors hold, beside the exact vectors, the
approximation: the number of the cell, of 2 ** BITS equal ones between a block's least and largest value, that each
component lies in. A block of queries meets a block of vectors in two steps. First the cells are scanned: a cell's middle
gives a query's score to within half a cell's width in each component, so each vector has an upper and a lower bound. Then
the exact vectors are read in the order of their upper bounds until the kth best score is above all bounds that are left.
What a task knows of the kth best score of a query it takes to its next block.

Defined cases: vectors that are null, or have null or non-finite components, take no part. Vectors meet those of the same
number of components. A null vec_id is no query, and comes last among equal scores. A query meets all rows with other
vec_ids; repeated rows count as often as they come, and equal queries are answered once. Vectors too long for scores in 64 bits (a
sum of squares of their integers from 4e18 on) raise an error. Empty tables give empty results.
Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, small_batches, stored

SCALE, K, EVERY = 64, 20, 20
BLOCK, QUERIES, BITS, CHUNK = 16_384, 2_048, 6, 4_096
#: The sum of squares from which on two vectors' product may pass 64 bits.
LONGEST = 4e18
NO_ID = np.iinfo(np.int64).max
BLOCKS = "dim int, block long, ids binary, exact binary, width int, cells binary, low binary, step binary"


def valid(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v: integer components) of the rows that take part."""
    v = F.col(column).cast("array<double>")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), v.alias("x")).where(F.col("x").isNotNull()).where(finite)
    squares = F.aggregate("x", F.lit(0.0), lambda s, c: s + c * SCALE * c * SCALE)
    beyond = F.raise_error(F.lit("a vector's scores don't fit in 64 bits")).cast("array<bigint>")
    return rows.select("vec_id", F.when(squares < LONGEST, F.transform("x", lambda c: F.floor(c * SCALE))).otherwise(beyond).alias("v"))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """rows (vec_id, v) in blocks of up to ``size`` vectors: one BLOCKS row for each."""
    n = max(1, -(-rows.count() // size))

    def block(dim: int, number: int, ids: list[int | None], vectors: list[np.ndarray]) -> list[object]:
        exact = np.stack(vectors) if dim else np.zeros((len(ids), 0), np.int64)
        largest = int(np.abs(exact).max(initial=0))
        kind = next(t for t in (np.int16, np.int32, np.int64) if t is np.int64 or largest <= np.iinfo(t).max)
        low = exact.min(0).astype(np.float64) if dim else np.zeros(0)
        step = np.maximum((exact.max(0) - low + 1) / (1 << BITS), 1e-9) if dim else np.zeros(0)
        cells = np.minimum((exact - low) / step, (1 << BITS) - 1).astype(np.uint8)
        keys = np.array([NO_ID if i is None else i for i in ids], np.int64)
        return [dim, number, keys.tobytes(), exact.astype(kind).tobytes(), np.dtype(kind).itemsize, cells.tobytes(), low.tobytes(), step.tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, tuple[list[int | None], list[np.ndarray]]] = {}
        number = TaskContext.get().partitionId() << 32

        def batch_of(rows: list[list[object]]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            v = batch.column(1)
            flat, cuts = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            for i, a, b in zip(batch.column(0).to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                ids, vectors = held.setdefault(b - a, ([], []))
                ids.append(i)
                vectors.append(flat[a:b])
                if len(ids) == size:
                    yield batch_of([block(b - a, number, ids, vectors)])
                    number += 1
                    del held[b - a]
        for dim, (ids, vectors) in held.items():
            yield batch_of([block(dim, number, ids, vectors)])
            number += 1

    small_batches(rows.sparkSession, 4096)
    return stored(rows.repartition(n).mapInArrow(run, BLOCKS), "vector_blocks")


class Best:
    """The best k of each query of a block, so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        self.kth = np.full(len(ids), -np.inf)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.found[q][0], scores)), np.concatenate((self.found[q][1], ids))
        order = np.lexsort((ids, -scores))[: self.k]
        self.found[q] = scores[order], ids[order]
        if len(order) == self.k:
            self.kth[q] = scores[order[-1]]

    def scan(self, ids: np.ndarray, exact: np.ndarray, cells: np.ndarray, low: np.ndarray, step: np.ndarray) -> None:
        q = self.vectors.astype(np.float64)
        q32 = q.astype(np.float32)
        largest = np.maximum(np.abs(low), np.abs(low + step * (1 << BITS)))
        slack = np.abs(q) @ step / 2 + np.abs(q) @ largest * 1e-5 + 1  # half a cell, and rounding
        wide = float((np.abs(q) @ largest).max(initial=0)) >= 2**53
        for at in range(0, len(ids), CHUNK):
            part = slice(at, at + CHUNK)
            middles = (low + (cells[part] + 0.5) * step).astype(np.float32)
            near = (q32 @ middles.T).astype(np.float64)
            near[(ids[part][None, :] == self.ids[:, None])] = -np.inf
            least = self.kth.copy()
            if near.shape[1] >= self.k:
                least = np.maximum(least, np.partition(near, -self.k, axis=1)[:, -self.k] - slack)
            upper = near + slack[:, None]
            for row in np.flatnonzero((upper >= least[:, None]).any(1)).tolist():
                on = np.flatnonzero((upper[row] >= least[row]) & (upper[row] > -np.inf))
                on = on[np.argsort(-upper[row, on], kind="stable")]
                for k in range(0, len(on), 64):
                    read = on[k : k + 64]
                    if upper[row, read[0]] < self.kth[row]:
                        break
                    vectors = exact[at + read]
                    scores = vectors.astype(np.int64) @ self.vectors[row] if wide else (vectors.astype(np.float64) @ q[row]).astype(np.int64)
                    self.add(row, scores, ids[at + read])


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:  # noqa: ANN001
    """(query_id, rank, vec_id, score): the k best of all rows for each row of vectors (vec_id, v) for which is_query holds."""
    spark = vectors.sparkSession
    kept = stored(vectors, "vectors")
    blocks = packed(kept, BLOCK)
    queries = packed(kept.where(is_query).where("vec_id IS NOT NULL").dropDuplicates(["vec_id", "v"]), QUERIES)
    stripes = max(1, min(partitions(spark), blocks.count() // 2))
    dealt = blocks.withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(stripes)))
    asked = queries.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("exact").alias("q_exact"), F.col("width").alias("q_width"))
    asked = asked.withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(stripes - 1).cast("bigint"))))
    # Blocks against blocks: each row is BLOCK vectors and QUERIES queries.
    pairs = dealt.join(asked, ["dim", "stripe"]).drop("stripe", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, Best] = OrderedDict()

        def rows(best: Best) -> Iterator[pa.RecordBatch]:
            sizes = [len(s) for s, _ in best.found]
            if sum(sizes):
                found = np.concatenate([i for _, i in best.found])
                keys = [zlib.crc32(v.tobytes()) for v in best.vectors]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(best.ids, sizes)), pa.array(np.repeat(np.array(keys, np.int64), sizes)), pa.array(found, mask=found == NO_ID), pa.array(np.concatenate([s for s, _ in best.found]))],
                    ["query_id", "q_key", "vec_id", "score"],
                )

        for batch in batches:
            for r in batch.to_pylist():
                dim, number = r["dim"], r["q_block"]
                if number not in known:
                    if len(known) >= 32:
                        yield from rows(known.popitem(last=False)[1])
                    q_ids = np.frombuffer(r["q_ids"], np.int64)
                    known[number] = Best(q_ids, np.frombuffer(r["q_exact"], f"i{r['q_width']}").reshape(len(q_ids), dim).astype(np.int64), k)
                ids = np.frombuffer(r["ids"], np.int64)
                exact, cells = np.frombuffer(r["exact"], f"i{r['width']}").reshape(len(ids), dim), np.frombuffer(r["cells"], np.uint8).reshape(len(ids), dim)
                known[number].scan(ids, exact, cells, np.frombuffer(r["low"]), np.frombuffer(r["step"]))
        for best in known.values():
            yield from rows(best)

    small_batches(spark, 512)  # by bytes, a batch is a few blocks
    found = pairs.mapInArrow(run, "query_id bigint, q_key bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "q_key").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_query(vectors: DataFrame) -> DataFrame:
    return top_k(valid(vectors), F.col("vec_id") % EVERY == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
"""
