"""Operators on line ranges and scopes: merging, containment, nearest names.

All work within a path: they shuffle by path once, and joins of hits with scopes are equi-joins on path and line bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a bucket in containment joins.
BUCKET = 64
#: Scopes of more buckets are joined on their path alone, and not copied to buckets.
WIDE = 64


def merged_ranges(ranges: DataFrame, keys: Sequence[str], start: str = "s", end: str = "e", gap: int = 1) -> DataFrame:
    """(keys, s, e): ranges merged where one starts at most ``gap`` behind the end of those before it (lines 1, bytes 0)."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)
    # by range, so that equal ranges are in one island in whatever order they come
    island = ranges.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def gaps(ranges: DataFrame, keys: Sequence[str], low: Column, high: Column) -> DataFrame:
    """(keys, s, e): what half-open ranges, merged before, leave of [low, high)."""
    order = Window.partitionBy(*keys).orderBy("s")
    with_ends = ranges.withColumn("_next", F.lead("s").over(order)).withColumn("_first", F.lag("s").over(order).isNull())
    behind = with_ends.select(*keys, F.col("e").alias("s"), F.coalesce("_next", high).alias("e"))
    front = with_ends.where("_first").select(*keys, low.alias("s"), F.col("s").alias("e"))
    return front.unionByName(behind).where("s < e")


def context_ranges(hits: DataFrame, keys: Sequence[str], context: int) -> DataFrame:
    """(keys, s, e): merged ranges of ``context`` lines around hits (keys, line_no, total)."""
    around = hits.select(*keys, F.greatest(F.lit(1), F.col("line_no") - context).alias("s"), F.least("total", F.col("line_no") + context).alias("e"))
    return merged_ranges(around, keys)


def scopes_of(hits: DataFrame, scopes: DataFrame, later_start_first: bool = False) -> DataFrame:
    """hits (path, line_no, ...) each with s and e of the smallest scope (path, s, e) around it; else its own line.

    Equal sizes go to the earlier start, or the later. Scopes are copied to buckets of lines, so that a long file's hits
    meet the scopes near them only; very long scopes are few and meet all hits of their path.
    """
    narrow = scopes.where((F.floor(F.col("e") / BUCKET) - F.floor(F.col("s") / BUCKET)) < WIDE)
    wide = scopes.where((F.floor(F.col("e") / BUCKET) - F.floor(F.col("s") / BUCKET)) >= WIDE)
    placed = narrow.select("path", "s", "e", F.explode(F.sequence(F.floor(F.col("s") / BUCKET), F.floor(F.col("e") / BUCKET))).alias("_bucket"))
    start = -F.col("s") if later_start_first else F.col("s")
    best = F.min(F.struct((F.col("e") - F.col("s")).alias("size"), start.alias("tie"), "s", "e")).alias("_best")
    points = hits.select("path", "line_no").distinct().withColumn("_bucket", F.floor(F.col("line_no") / BUCKET))
    inside = (F.col("s") <= F.col("line_no")) & (F.col("line_no") <= F.col("e"))
    near = points.join(placed, ["path", "_bucket"]).where(inside).groupBy("path", "line_no").agg(best)
    far = points.join(wide, ["path"]).where(inside).groupBy("path", "line_no").agg(best)
    found = near.unionByName(far).groupBy("path", "line_no").agg(F.min("_best").alias("_best"))
    out = hits.join(found, ["path", "line_no"], "left")
    return out.select(*hits.columns, F.coalesce("_best.s", "line_no").alias("s"), F.coalesce("_best.e", "line_no").alias("e"))


def touching(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """rows (path, s, e, ...) with ``touches``: whether a region (path, s, e) of their path shares a place with them, both ends
    included. No row meets a region: of the regions that begin up to a row's end, the one that reaches farthest decides."""
    marks = regions.select("path", F.col("s").cast("bigint").alias("_at"), F.lit(0).alias("_is_row"), F.col("e").cast("bigint").alias("_reach"), F.lit(None).cast(rows.select(F.struct(*rows.columns).alias("r")).schema["r"].dataType).alias("_row"))
    asked = rows.select("path", F.col("e").cast("bigint").alias("_at"), F.lit(1).alias("_is_row"), F.lit(None).cast("bigint").alias("_reach"), F.struct(*rows.columns).alias("_row"))
    order = Window.partitionBy("path").orderBy("_at", "_is_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = marks.unionByName(asked).withColumn("_reach", F.max("_reach").over(order)).where("_is_row = 1")
    return found.select("_row.*", F.coalesce(F.col("_reach") >= F.col("_row.s"), F.lit(False)).alias("touches"))


def touching_only(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """The rows (path, s, e, ...) that share a place with a region (path, s, e)."""
    return touching(rows, regions).where("touches").drop("touches")


def outside(points: DataFrame, spans: DataFrame) -> DataFrame:
    """The points (path, at, ...) that lie in no half-open span (path, s, e)."""
    closed = spans.select("path", "s", (F.col("e") - 1).alias("e")).where("s <= e")
    marked = touching(points.withColumns({"s": F.col("at"), "e": F.col("at")}), closed)
    return marked.where("NOT touches").select(*points.columns)


def within(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows (path, s, e, ...) with ``within``: whether a span (path, s, e) of their path holds them whole, both ends included. No
    row meets a span: of the spans that begin no later than a row, the one that reaches farthest decides."""
    kind = rows.select(F.struct(*rows.columns).alias("r")).schema["r"].dataType
    marks = spans.select("path", F.col("s").cast("bigint").alias("_at"), F.lit(0).alias("_is_row"), F.col("e").cast("bigint").alias("_reach"), F.lit(None).cast(kind).alias("_row"))
    asked = rows.select("path", F.col("s").cast("bigint").alias("_at"), F.lit(1).alias("_is_row"), F.lit(None).cast("bigint").alias("_reach"), F.struct(*rows.columns).alias("_row"))
    order = Window.partitionBy("path").orderBy("_at", "_is_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = marks.unionByName(asked).withColumn("_reach", F.max("_reach").over(order)).where("_is_row = 1")
    return found.select("_row.*", F.coalesce(F.col("_reach") >= F.col("_row.e"), F.lit(False)).alias("within"))


def outside_whole(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows (path, s, e, ...) that no span (path, s, e) holds whole, such as definitions that no literal hides."""
    return within(rows, spans).where("NOT within").drop("within")


def tree_faults(scopes: Column, last: Column) -> Column:
    """What keeps scopes, an array of (s, e), from being a tree over lines 1 to last: (s, e, fault), in order. A scope lies
    within the file, ends no sooner than it begins, and of two scopes that share a line one holds the other. One sweep in the
    order of starts, widest first, with the ends of the scopes that are open as a stack."""
    kind = "array<struct<s:int,e:int,fault:string>>"
    start = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast(kind).alias("faults"))
    ordered = F.transform(F.array_sort(F.transform(scopes, lambda x: F.struct(x["s"].cast("int").alias("s"), (-x["e"]).cast("int").alias("e")))), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e")))

    def step(state: Column, x: Column) -> Column:
        open_ = F.filter(state["open"], lambda e: e >= x["s"])
        fault = F.when((x["s"] < 1) | (x["e"] > last), "outside").when(x["e"] < x["s"], "reversed").when(F.exists(open_, lambda e: e < x["e"]), "crossing")
        row = F.struct(x["s"].alias("s"), x["e"].alias("e"), fault.alias("fault"))
        return F.struct(F.concat(open_, F.array(x["e"])).alias("open"), F.concat(state["faults"], F.array(row)).alias("faults"))

    return F.filter(F.aggregate(ordered, start, step)["faults"], lambda x: x["fault"].isNotNull())


def nearest_names(lines: DataFrame, name: str = "name", keys: Sequence[str] = ("path",), order_by: str = "line_no") -> DataFrame:
    """lines with nearest: the last name at or before the row, else the first behind it. Rows without one have null names."""
    order = Window.partitionBy(*keys).orderBy(order_by)
    back = F.last(name, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(name, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return lines.withColumn("nearest", F.coalesce(back, ahead))
