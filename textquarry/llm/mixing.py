"""Mixing sources to target weights with hash-threshold histograms.

A document's size is its number of words (runs without ``[\\x20\\x09-\\x0D]``). Sources, in the order of their code points
with null last, weigh 1, 2, 3 and again; by weight they share all words. A target stops at ``most`` times its source's
words, and the excess is shared anew by weight until no target is above that. A source then takes all its documents as
often as its target allows in whole, and once more those whose hash lies under a threshold.

The threshold comes from histograms, without sorting documents: words are summed by source and hash bucket, the bucket
where the sum crosses the remaining budget is found, and only that bucket's documents are summed again by finer buckets.
At the last step a bucket is one hash value. Thresholds are nested: a larger budget takes the same documents and more.
Where a source misses its target by more than NEAR of it, what is left in front of the document that crosses the budget is
filled by the same steps, twice at most, with documents behind it that are small enough; a crossing document is in if that
comes nearer to the target than leaving it out.

Defined cases: a null or empty text has no words, and its document takes none. The hash is of doc_id, source and text, so
reruns agree and repeated rows go together. Null sources are one source. Empty tables give empty results. Only
``doc_id``, ``source`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, unused

WEIGHTS, MOST = (1, 2, 3), 3
#: Bits of the hash that each histogram resolves; the last resolves all 63.
STEPS = (12, 24, 63)
END, ROUNDS = 2**63 - 1, 3
#: A source this near to its target, as a share of it, needs no more rounds; with thousands of documents one round does.
NEAR = 1e-3
#: Tables of one row for each source are broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_ROWS = 50_000


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def place(docs_columns: tuple[str, str, str] = ("doc_id", "source", "text")) -> Column:
    """63 bits of hash."""
    return F.shiftrightunsigned(F.xxhash64(*docs_columns), 1)


def if_small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size). The windows see one row for each source."""
    order = F.col("source").asc_nulls_last()
    turn = F.pmod(F.row_number().over(Window.orderBy(order)) - 1, F.lit(len(weights)))
    w = by_source.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn.cast("int") + 1))
    w = w.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    up = Window.orderBy("ratio", order).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy("ratio", order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # If the sources before this one stop at their caps, the others get this much for each unit of weight.
    unit = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("w").over(down)
    w = w.withColumn("unit", unit).withColumn("place", F.row_number().over(Window.orderBy("ratio", order)))
    first = F.min(F.when(F.col("ratio") >= F.col("unit"), F.struct("place", "unit"))).over(every)
    share = w.withColumn("share", F.coalesce(first["unit"], F.lit(0.0)))
    target = F.when(F.col("ratio") < F.col("share"), F.col("cap")).otherwise(F.least(F.col("share") * F.col("w"), F.col("cap")))
    return share.select("source", "source_size", target.alias("target"))


def crossing(sizes: DataFrame, left: DataFrame) -> DataFrame:
    """left (source, budget, low, cap) with at, size and gap: among the source's documents from place low on of cap words at
    most, in the order of their places, the place where the sum of their words crosses the budget, the words at that place,
    and what the budget has left in front of it. Where all of them fit, at is the end and gap what is left behind it."""
    limits = if_small(left.select(F.col("source").alias("s"), "low", "cap"))
    fits = F.col("source").eqNullSafe(F.col("s")) & (F.col("place") >= F.col("low")) & (F.col("size") <= F.col("cap"))
    chosen = sizes.join(limits, fits).select("source", "place", "size")
    here = left.select("source", F.lit(0).cast("bigint").alias("bucket"), F.col("budget").alias("rest"))
    for k, bits in enumerate(STEPS):
        near = if_small(here.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.col("rest").alias("budget")))
        shift = 63 - STEPS[k - 1] if k else 63
        inside = chosen.join(near, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("place", shift) == F.col("b")))
        histogram = inside.groupBy("source", "budget", F.shiftright("place", 63 - bits).alias("bucket")).agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        summed = histogram.withColumn("upto", upto)
        crossed = summed.where((F.col("upto") >= F.col("budget")) & (F.col("upto") - F.col("size") < F.col("budget")))
        if k == 0:
            sums = stored(summed.groupBy("source").agg(F.max("upto").alias("all")), "sums")
        here = stored(crossed.select("source", "bucket", (F.col("budget") - (F.col("upto") - F.col("size"))).alias("rest"), "size"), "boundary")
    found = here.select(F.col("source").alias("s"), F.col("bucket").alias("at"), "size", F.col("rest").alias("gap"))
    whole = sums.select(F.col("source").alias("s2"), "all")
    out = left.join(if_small(found), F.col("source").eqNullSafe(F.col("s")), "left").join(if_small(whole), F.col("source").eqNullSafe(F.col("s2")), "left")
    gap = F.coalesce("gap", F.col("budget") - F.coalesce("all", F.lit(0)))
    return out.select(*left.columns, F.coalesce("at", F.lit(END)).alias("at"), F.coalesce("size", F.lit(0)).alias("size"), gap.alias("gap"))


def thresholds(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, full, below, bands): documents come full times, and once more if their place is under
    below, or in one of the bands and they have no more words than the band's cap."""
    totals = targets(stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source_sizes"), weights, most)
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("bigint")
    budget = F.greatest(F.col("target") - F.col("full") * F.col("source_size"), F.lit(0.0))
    goal = stored(totals.withColumn("full", full).withColumn("budget", budget), "targets")

    band = "array<struct<low:bigint,below:bigint,cap:bigint>>"
    left = goal.where("budget > 0").select("source", "target", "budget", F.lit(0).cast("bigint").alias("low"), F.lit(END).alias("cap"), F.lit(None).cast(band).alias("bands"), F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("double").alias("over"))
    for k in range(ROUNDS):
        found = stored(crossing(sizes, left), "crossing")
        miss = found.agg(F.max(F.least("gap", F.when(F.col("at") < END, F.abs(F.col("size") - F.col("gap")))) / F.col("target"))).first()[0]
        done = k == ROUNDS - 1 or (miss or 0) <= NEAR
        # in the last round the crossing document is in if that comes nearer
        inside = (F.col("size") - F.col("gap") < F.col("gap")) & (F.col("at") < END) if done else F.lit(False)
        here = F.array(F.struct(F.col("low"), (F.col("at") + inside.cast("bigint")).alias("below"), F.col("cap"))).cast(band)
        # the next round fills the gap with what is small enough among the documents behind the crossing one
        left = found.select(
            "source", "target", F.col("gap").alias("budget"), F.when(F.col("at") < END, F.col("at") + 1).otherwise(F.lit(END)).alias("low"), F.floor("gap").cast("bigint").alias("cap"),
            (here if k == 0 else F.concat("bands", here)).alias("bands"),
            (F.col("at") if k == 0 else F.col("first")).alias("first"), (F.col("size") - F.col("gap") if k == 0 else F.col("over")).alias("over"),
            F.when(inside, F.abs(F.col("size") - F.col("gap"))).otherwise(F.col("gap")).alias("error"),
        )
        if done:
            break
        left = left.drop("error")
    # or the first crossing document is in, if no filling came as near
    simple = (F.col("over") >= 0) & (F.col("over") < F.col("error")) & (F.col("first") < END)
    alone = F.array(F.struct(F.lit(0).cast("bigint").alias("low"), (F.col("first") + 1).alias("below"), F.lit(END).alias("cap"))).cast(band)
    chosen = left.select(F.col("source").alias("s"), F.when(simple, alone).otherwise(F.col("bands")).alias("bands"))
    out = goal.join(chosen, F.col("source").eqNullSafe(F.col("s")), "left")
    below = F.coalesce(F.get("bands", 0)["below"], F.lit(0))
    return out.select("source", "source_size", "target", "full", below.alias("below"), F.coalesce(F.slice("bands", 2, ROUNDS), F.array().cast(band)).alias("bands"))


def taken_times(place_: Column, size: Column, full: Column, below: Column, bands: Column) -> Column:
    more = (place_ < below) | F.exists(bands, lambda b: (place_ >= b["low"]) & (place_ < b["below"]) & (size <= b["cap"]))
    return full + more.cast("bigint")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, place), in one pass over the texts."""
    return stored(docs.select("doc_id", "source", words(F.col("text")).alias("size"), place().alias("place")), "sizes")


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for each row of docs."""
    sizes = measured(docs.select("doc_id", "source", "text"))
    limits = stored(thresholds(sizes), "thresholds").withColumnRenamed("source", "s")
    copies = taken_times(F.col("place"), F.col("size"), F.col("full"), F.col("below"), F.col("bands")).alias("copies")
    joined = sizes.join(if_small(limits), F.col("source").eqNullSafe(F.col("s")))
    return joined.select("doc_id", "size", "source_size", "target", copies, (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, in the columns of docs; rows without words stay once."""
    sizes = measured(docs.select("doc_id", "source", "text"))
    name = {x: unused(docs, f"mixing_{x}") for x in ("s", "full", "below", "bands", "nth")}
    limits = stored(thresholds(sizes), "thresholds").select(*[F.col(c).alias(name[n]) for c, n in (("source", "s"), ("full", "full"), ("below", "below"), ("bands", "bands"))])
    copies = taken_times(place(), words(F.col("text")), *[F.col(name[x]) for x in ("full", "below", "bands")])
    copies = F.when(words(F.col("text")) == 0, F.lit(1)).otherwise(copies)
    joined = docs.join(if_small(limits), docs["source"].eqNullSafe(F.col(name["s"])))
    many = joined.withColumn(name["nth"], F.explode(F.array_repeat(F.lit(0), copies.cast("int"))))
    return many.select(*docs.columns)


def mixing_query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
