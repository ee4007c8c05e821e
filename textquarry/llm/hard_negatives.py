"""Hard negatives by product quantisation with stored residual norms.

Vectors are integers: floor(256 * x) of each component x. Rows of one label and vector are a class, with the first few of its
ids. A class's code holds, for each ``SUB`` components, the nearest of ``CENTROIDS`` centroids, for what those leave over the
nearest of as many finer ones, and the norms of both residuals. A question's look-up tables have its products with all
centroids; a code's score is a sum of ``components / SUB`` entries, and the exact score lies within (norm of the question) *
(norm of the residual) of it, by Cauchy and Schwarz; what these bounds leave gets the finer sum and its bounds. Codes and exact
vectors are two tables: blocks of questions scan blocks of codes, the bounds leave candidates, and the exact integer score is
computed for candidates alone:

1. positives: candidates of the question's label whose upper bound reaches the least of the first lower bounds;
2. negatives: candidates of other labels whose bounds touch the window of a positive's score, but for those that lie, with
   their upper bound, below enough candidates that are certain to be in it. The exact scores then complete the window.

Centroids are fitted by k-means on at most ``SAMPLE`` classes, those of the least hash; bounds hold for any centroids.

Defined cases: rows with a null label, or a vector that is null or has null or non-finite components, take no part. Vectors
meet those of the same number of components. A null vec_id is no anchor, and comes last among equal scores. An anchor meets
rows of other vec_ids; as a negative of its own, a row of its vec_id and another label may come. Repeated rows count as often
as they come; repeated anchors are answered once. Vectors too long for scores in 64 bits (a sum of squares from 4e18 on)
raise an error. Empty tables, and anchors without positives, give no rows. Only ``vec_id``, ``embedding`` and ``label`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, small_batches, stored

SCALE, EVERY, MOVED, LABELS, POSITIVES, NEGATIVES = 256, 50, 7, 10, 5, 3
SUB, CENTROIDS, SAMPLE, ROUNDS = 2, 256, 4_096, 6
BLOCK, QUESTIONS, TOGETHER = 16_384, 1_024, 32
LONGEST = 4e18
CODES = "dim int, block long, classes binary, labels binary, codes binary, margins binary, finer binary, finer_margins binary"
ASKED = "dim int, q_block long, q_ids binary, q_labels binary, vectors binary, needs binary, counts binary, scores binary"
FOUND = "q_id bigint, asked bigint, class_id bigint, lower double, upper double"

#: For each number of components, the centroids of each part, and those of what they leave.
Books = dict[int, list[tuple[np.ndarray, np.ndarray]]]


def valid(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v: integer components) of the rows that take part, labels moved where the task says so."""
    vec_id, label, x = F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.col("embedding").cast("array<double>")
    rows = embeddings.select(vec_id.alias("vec_id"), label.alias("label"), x.alias("x")).where("label IS NOT NULL AND x IS NOT NULL")
    rows = rows.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    squares = F.aggregate("x", F.lit(0.0), lambda s, c: s + c * SCALE * c * SCALE)
    v = F.when(squares < LONGEST, F.transform("x", lambda c: F.floor(c * SCALE))).otherwise(F.raise_error(F.lit("a vector's scores don't fit in 64 bits")).cast("array<bigint>"))
    moved = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return rows.select("vec_id", moved.alias("label"), v.alias("v"))


def classes_of(rows: DataFrame, ids: int) -> DataFrame:
    """(class_id, label, v, ids: the first ids of each class with the number of their rows)."""
    counted = rows.groupBy("label", "v", "vec_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("label", "v").orderBy(F.col("vec_id").asc_nulls_last())
    firsts = counted.withColumn("k", F.row_number().over(order)).where(F.col("k") <= ids)
    grouped = firsts.groupBy("label", "v").agg(F.collect_list(F.struct("vec_id", "n")).alias("ids"))
    return stored(grouped.select(F.monotonically_increasing_id().alias("class_id"), "label", "v", "ids"), "negatives_classes")


def _parts(dim: int) -> list[slice]:
    return [slice(a, min(a + SUB, dim)) for a in range(0, dim, SUB)]


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    out = [np.argmin((book * book).sum(1) - 2 * x[a : a + 4096] @ book.T, axis=1) for a in range(0, len(x), 4096)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _centroids(points: np.ndarray) -> np.ndarray:
    book = np.unique(points, axis=0)
    book = book[np.linspace(0, len(book) - 1, min(CENTROIDS, len(book))).astype(int)]
    for _ in range(ROUNDS if len(book) == CENTROIDS else 0):
        at = _nearest(points, book)
        size = np.bincount(at, minlength=len(book))
        sums = np.stack([np.bincount(at, points[:, k], len(book)) for k in range(points.shape[1])], 1)
        book = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], book)
    return np.round(book)


def fitted(classes: DataFrame) -> Books:
    """The centroids, from a bounded sample."""
    sample = classes.orderBy(F.xxhash64("v"), "class_id").limit(SAMPLE).select("v").toArrow().column(0).to_pylist()
    books: Books = {}
    for dim in sorted({len(v) for v in sample}):
        of_dim = [v for v in sample if len(v) == dim]
        x = np.array(of_dim, np.float64).reshape(len(of_dim), dim)
        books[dim] = []
        for part in _parts(dim):
            book = _centroids(x[:, part])
            books[dim].append((book, _centroids(x[:, part] - book[_nearest(x[:, part], book)])))
    return books


def book_of(books: Books, dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return books.get(dim) or [(np.zeros((1, len(range(dim)[p]))),) * 2 for p in _parts(dim)]


def encoded(x: np.ndarray, book: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Codes, and by what to multiply a question's norm for the bound: the residual's norm, and for rounding a little more; then
    the same for the finer codes."""
    out, rest = [], x.copy()
    for level in (0, 1):
        codes = np.zeros((len(x), len(book)), np.uint8)
        for k, (part, centroids) in enumerate(zip(_parts(x.shape[1]), book, strict=True)):
            codes[:, k] = _nearest(rest[:, part], centroids[level])
            rest[:, part] -= centroids[level][codes[:, k]]
        residual = np.sqrt((rest * rest).sum(1))
        out.append((codes, residual + 1e-9 * (np.sqrt((x * x).sum(1)) + residual + 1)))
    return out


def _batch(columns: str, rows: list[list[object]]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    named = [c.split() for c in columns.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), named, strict=True)], [n for n, _ in named])


def _blocks(rows: DataFrame, size: int, columns: str, pack, name: str) -> DataFrame:  # noqa: ANN001
    """rows, whose first column is a vector, in blocks of up to size rows of one number of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list[tuple]] = {}
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = held.setdefault(len(row[0]), [])
                mine.append(row)
                if len(mine) == size:
                    yield _batch(columns, [pack(len(row[0]), number, held.pop(len(row[0])))])
                    number += 1
        for dim, mine in held.items():
            yield _batch(columns, [pack(dim, number, mine)])
            number += 1

    small_batches(rows.sparkSession, 4096)
    return stored(rows.repartition(max(1, -(-rows.count() // size))).mapInArrow(run, columns), name)


def code_blocks(classes: DataFrame, books: Books) -> DataFrame:
    def pack(dim: int, number: int, rows: list[tuple]) -> list[object]:
        vectors, ids, labels = zip(*rows, strict=True)
        coarse, finer = encoded(np.array(vectors, np.float64).reshape(len(rows), dim), book_of(books, dim))
        return [dim, number, np.array(ids, np.int64).tobytes(), np.array(labels, np.int64).tobytes(), *(a.tobytes() for a in (*coarse, *finer))]

    return _blocks(classes.select("v", "class_id", "label"), BLOCK, CODES, pack, "negatives_codes")


def question_blocks(asks: DataFrame) -> DataFrame:
    """asks (v, q_id, label, need, scores) in blocks."""

    def pack(dim: int, number: int, rows: list[tuple]) -> list[object]:
        vectors, ids, labels, needs, scores = zip(*rows, strict=True)
        flat = [s for row in scores for s in row]
        longs = [np.array(x, np.int64).tobytes() for x in (ids, labels)]
        return [dim, number, *longs, np.array(vectors, np.int64).tobytes(), *(np.array(x, np.int64).tobytes() for x in (needs, [len(s) for s in scores], flat))]

    return _blocks(asks.select("v", "q_id", "label", "need", "scores"), QUESTIONS, ASKED, pack, "negatives_asks")


def window(score: int) -> tuple[int, int]:
    """The least and the largest negative score s with 50 * score <= 100 * s <= 95 * score."""
    return -(-score // 2), 95 * score // 100


def _nth(values: np.ndarray, n: int) -> float:
    """The nth largest value, if there are so many."""
    return float(np.partition(values, len(values) - n)[-n]) if len(values) >= n else -np.inf


class Known:
    """The largest lower bounds that a task has met for a question so far."""

    def __init__(self) -> None:
        self.lowers: dict[tuple[int, int], np.ndarray] = {}

    def so_far(self, key: tuple[int, int], need: int) -> float:
        """What an upper bound has to reach."""
        best = self.lowers.get(key, ())
        return float(best[0]) if len(best) == need else -np.inf

    def least(self, key: tuple[int, int], lowers: np.ndarray, need: int) -> float:
        """The same with the lower bounds of one more block."""
        if len(lowers) > need:
            lowers = np.partition(lowers, len(lowers) - need)[-need:]
        self.lowers[key] = np.sort(np.concatenate((self.lowers.get(key, np.zeros(0)), lowers)))[-need:]
        return self.so_far(key, need)


def scan(codes: DataFrame, asks: DataFrame, books: Books, negatives: bool) -> DataFrame:
    """FOUND: for each question (and positive score ``asked``, for negatives) the classes that the bounds leave, with a lower
    bound that counts towards what others must reach, and an upper one."""
    spark = codes.sparkSession
    stripes = max(1, min(partitions(spark), codes.count()))
    dealt = codes.withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(stripes)))
    each = asks.withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(stripes - 1).cast("bigint"))))
    # Blocks against blocks: each row is BLOCK codes and QUESTIONS questions.
    pairs = dealt.join(each, ["dim", "stripe"]).drop("stripe", "block", "q_block")

    def pick(key: tuple[int, int], known: Known, need: int, low: float, high: float, at: np.ndarray, near: np.ndarray, width: np.ndarray, finer, ids: np.ndarray) -> list[np.ndarray] | None:  # noqa: ANN001
        """What the bounds leave of the codes at some places, with scores near +- width: those that may lie from low to high and
        reach what enough others reach for certain; then the same by the finer codes."""
        # A row must not count twice among lower bounds, so only the finer ones are kept for the next blocks.
        for last in (False, True):
            lower, upper = near - width, near + width
            sure = (lower >= low) & (upper <= high)
            on = (upper >= low) & (lower <= high)
            on &= upper >= (known.least(key, lower[sure], need) if last else max(known.so_far(key, need), _nth(lower[sure], need)))
            at, near, lower, upper, sure = at[on], near[on], lower[on], np.minimum(upper[on], high), sure[on]
            if not len(at):
                return None
            if not last:
                near, width = finer(at, near)
        return [np.full(len(at), key[0]), np.full(len(at), key[1]), ids[at], np.where(sure, lower, -np.inf), upper]

    def meet(r: dict, known: Known) -> Iterator[list[np.ndarray]]:
        longs = {k: np.frombuffer(r[k], np.int64) for k in ("classes", "labels", "q_ids", "q_labels", "needs", "counts", "scores")}
        vectors = np.frombuffer(r["vectors"], np.int64).reshape(len(longs["q_ids"]), r["dim"]).astype(np.float64)
        book, norms = book_of(books, r["dim"]), np.sqrt((vectors * vectors).sum(1)) * (1 + 1e-9)
        shape = (len(longs["classes"]), len(book))
        code, finer_code = (np.frombuffer(r[k], np.uint8).reshape(shape) for k in ("codes", "finer"))
        margins, finer_margins = np.frombuffer(r["margins"]), np.frombuffer(r["finer_margins"])
        columns, parts = [np.ascontiguousarray(code[:, k]) for k in range(len(book))], np.arange(len(book))[:, None]
        ends = np.cumsum(longs["counts"])
        for a in range(0, len(vectors), TOGETHER):
            some = vectors[a : a + TOGETHER]
            near = np.zeros((len(some), len(code)))
            finer_table = np.zeros((len(book), len(some), CENTROIDS))
            for k, (part, (centroids, finer), column) in enumerate(zip(_parts(r["dim"]), book, columns, strict=True)):
                near += (some[:, part] @ centroids.T).take(column, axis=1)
                finer_table[k, :, : len(finer)] = some[:, part] @ finer.T
            for q, row in enumerate(near, a):
                mine = np.flatnonzero((longs["labels"] == longs["q_labels"][q]) != negatives)
                if not len(mine):
                    continue

                def finer_of(at: np.ndarray, before: np.ndarray, q: int = q, table: np.ndarray = finer_table, a: int = a) -> tuple[np.ndarray, np.ndarray]:
                    return before + table[parts, q - a, finer_code[at].T].sum(0), norms[q] * finer_margins[at] + 1e-6

                q_id, score, width = int(longs["q_ids"][q]), row[mine], norms[q] * margins[mine] + 1e-6
                scores = longs["scores"][ends[q] - longs["counts"][q] : ends[q]].tolist()
                windows = [((q_id, s), NEGATIVES, *window(s)) for s in scores] if negatives else [((q_id, 0), int(longs["needs"][q]), -np.inf, np.inf)]
                for key, need, low, high in windows:
                    found = pick(key, known, need, low, high, mine, score, width, finer_of, longs["classes"])
                    if found:
                        yield found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            for r in batch.to_pylist():
                held: list[list[np.ndarray]] = []
                for found in meet(r, known):
                    held.append(found)
                    if sum(len(f[0]) for f in held[-64:]) > 50_000 or len(held) == 4096:
                        yield rows_of(held)
                        held = []
                if held:
                    yield rows_of(held)

    def rows_of(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], [c.split()[0] for c in FOUND.split(", ")])

    small_batches(spark, 64)
    return pairs.mapInArrow(run, FOUND)


def reranked(found: DataFrame, need: Column, classes: DataFrame, asks: DataFrame) -> DataFrame:
    """(q_id, asked, vec_id, n, score): found's candidates that reach what those of all tasks say, with their exact scores."""
    order = Window.partitionBy("q_id", "asked").orderBy(F.col("lower").desc())
    nth = found.join(asks.select("q_id", "need"), "q_id").withColumn("place", F.row_number().over(order))
    whole = Window.partitionBy("q_id", "asked").orderBy(F.col("lower").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    least = F.max(F.when(F.col("place") == need, F.col("lower"))).over(whole)
    left = nth.withColumn("least", least).where("least IS NULL OR upper >= least").select("q_id", "asked", "class_id")
    exact = left.join(classes.select("class_id", "v", "ids"), "class_id").join(asks.select("q_id", F.col("v").alias("a")), "q_id")
    score = F.aggregate(F.zip_with("v", "a", lambda x, y: x * y), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return exact.select("q_id", "asked", score.alias("score"), F.explode("ids").alias("row")).select("q_id", "asked", "row.vec_id", "row.n", "score")


def copies(rows: DataFrame, most: int) -> DataFrame:
    """Each row of rows as often as it comes in the table, up to most times: more can't be among the first most."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(most)).cast("int")))).drop("copy", "n")


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    rows = stored(valid(embeddings), "negatives_rows")
    classes = classes_of(rows, POSITIVES + 1)
    books = fitted(classes)
    codes = code_blocks(classes, books)

    anchors = rows.where(F.col("vec_id") % EVERY == 0).dropDuplicates(["vec_id", "label", "v"])
    # Of a class one row at most has the anchor's id; so that many more places are needed as it has classes.
    own = anchors.groupBy("vec_id").agg(F.count("*").alias("own"))
    asks = anchors.join(own, "vec_id").groupBy("label", "v").agg((POSITIVES + F.max("own")).cast("bigint").alias("need"))
    asks = stored(asks.select(F.monotonically_increasing_id().alias("q_id"), "label", "v", "need"), "negatives_questions")
    asking = anchors.join(asks, ["label", "v"]).select("q_id", F.col("vec_id").alias("anchor_id"))
    no_scores = F.array().cast("array<bigint>").alias("scores")

    near = stored(scan(codes, question_blocks(asks.select("*", no_scores)), books, negatives=False), "negatives_found")
    best = Window.partitionBy("q_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    firsts = reranked(near, F.col("need"), classes, asks).withColumn("place", F.row_number().over(best)).join(asks.select("q_id", "need"), "q_id").where("place <= need")
    of_anchor = firsts.drop("place", "need").join(asking, "q_id").where(~F.col("vec_id").eqNullSafe(F.col("anchor_id")))
    first = Window.partitionBy("q_id", "anchor_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    chosen = copies(of_anchor, POSITIVES).withColumn("place", F.row_number().over(first)).where(F.col("place") <= POSITIVES)
    positives = stored(chosen.select("q_id", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives_positives")

    # A negative positive score has no window.
    scores = positives.where("positive_score >= 0").groupBy("q_id").agg(F.collect_set("positive_score").alias("scores"))
    again = question_blocks(asks.join(scores, "q_id"))
    hard = stored(scan(codes, again, books, negatives=True), "negatives_found")
    exact = reranked(hard, F.lit(NEGATIVES), classes, asks)
    low, high = F.expr("asked div 2 + asked % 2"), F.expr("asked div 100 * 95 + asked % 100 * 95 div 100")
    place = Window.partitionBy("q_id", "asked").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    inside = copies(exact.where(F.col("score").between(low, high)), NEGATIVES).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= NEGATIVES)
    inside = inside.select("q_id", F.col("asked").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(inside, ["q_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
