"""Operators on patches: hunk headers to ranges, changed lines, revisions compared by content."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import merged_ranges

HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
MOST_LINE, MOST_SPANS = 1_000_000_000, 100_000


def hunk(line: Column) -> tuple[Column, Column]:
    """Start and count of the new side in a hunk header; null in other lines."""
    start = F.try_to_number(F.nullif(F.regexp_extract(line, HUNK, 1), F.lit("")), F.lit("9999999999"))
    count = F.try_to_number(F.nullif(F.regexp_extract(line, HUNK, 2), F.lit("")), F.lit("9999999999"))
    return start.cast("bigint"), F.when(start.isNotNull(), F.coalesce(count.cast("bigint"), F.lit(1)))


def changed_range(line: Column, total: Column) -> Column:
    """struct(s, e) of the changed lines that a hunk header names, within 1 to total; a pure deletion is the line it stands
    behind. Null for other lines and empty files."""
    start, count = hunk(line)
    last = F.greatest(total.cast("bigint"), F.lit(1))
    s = F.least(F.greatest(start, F.lit(1)), last)
    e = F.least(F.greatest(start + F.greatest(count, F.lit(1)) - 1, s), last)
    return F.when(start.isNotNull(), F.struct(s.alias("s"), e.alias("e")))


def strict_span(line: Column) -> Column:
    """struct(s, e) of a header's new side, unclamped; raises where it goes beyond what line numbers may be."""
    start, count = hunk(line)
    s = F.greatest(start, F.lit(1))
    e = s + F.greatest(count, F.lit(1)) - 1
    return F.when(start.isNull(), None).when(e > MOST_LINE, F.raise_error(F.lit("changed line is out of range"))).otherwise(F.struct(s.alias("s"), e.alias("e")))


def strict_spans(headers: DataFrame) -> DataFrame:
    """(path, s, e) of headers (path, header): merged spans. ValueError for more than MOST_SPANS headers of changed lines."""
    spans = headers.select("path", strict_span(F.col("header")).alias("x")).where("x IS NOT NULL")
    if (n := spans.limit(MOST_SPANS + 1).count()) > MOST_SPANS:
        raise ValueError(f"the patch has {n} spans or more; {MOST_SPANS} are allowed")
    return merged_ranges(spans.select("path", F.col("x.s").cast("bigint").alias("s"), F.col("x.e").cast("bigint").alias("e")), ["path"])


def changed_lines(headers: DataFrame) -> DataFrame:
    """(path, line_no), distinct, of headers (path, header, total)."""
    spans = headers.select("path", changed_range(F.col("header"), F.col("total")).alias("x")).where("x IS NOT NULL")
    return spans.select("path", F.explode(F.sequence(F.col("x.s").cast("int"), F.col("x.e").cast("int"))).alias("line_no")).distinct()


def patch_headers(patches: DataFrame) -> DataFrame:
    """(path, header) of the hunks in patches (patch): a patch text of many files."""
    numbered = patches.select(F.monotonically_increasing_id().alias("_id"), "patch")
    lines = numbered.select("_id", F.posexplode(F.split("patch", "\n", -1)).alias("_p", "line"))
    order = Window.partitionBy("_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    path = F.nullif(F.regexp_extract("line", r"^\+\+\+ b/(.*?)\t?$", 1), F.lit(""))
    named = lines.withColumn("path", F.last(path, ignorenulls=True).over(order))
    return named.where(F.col("line").rlike(HUNK)).select("path", F.col("line").alias("header"))


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status): added, deleted or modified, from files (path, content) of two revisions."""
    a = old.select("path", F.xxhash64("content").alias("_old"), F.sha2("content", 256).alias("_old_sha"))
    b = new.select("path", F.xxhash64("content").alias("_new"), F.sha2("content", 256).alias("_new_sha"))
    joined = a.join(b, "path", "full")
    status = F.when(F.col("_old_sha").isNull(), "added").when(F.col("_new_sha").isNull(), "deleted").when(F.col("_old_sha") != F.col("_new_sha"), "modified")
    return joined.select("path", status.alias("status")).where("status IS NOT NULL")


def line_diff(old: list[str], new: list[str]) -> list[int]:
    """Changed lines of new; a deletion marks the line before it, or the first."""
    out: set[int] = set()
    for tag, _, _, a, b in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if tag in ("replace", "insert"):
            out.update(range(a + 1, b + 1))
        elif tag == "delete" and new:
            out.add(min(max(a, 1), len(new)))
    return sorted(out)


def lines_changed_between(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, line_no) changed in new, from files (path, content) of two revisions. Only files that differ are compared."""
    from ..functions.text import source_lines

    touched = compared(old, new).where("status <> 'deleted'").select("path")
    a = old.join(touched, "path", "left_semi").select("path", source_lines(F.col("content")).alias("a"))
    b = new.join(touched, "path", "left_semi").select("path", source_lines(F.col("content")).alias("b"))
    none = F.array().cast("array<string>")
    both = b.join(a, "path", "left").select("path", F.coalesce("a", none).alias("a"), "b")

    @F.pandas_udf("array<int>")
    def diff(x, y):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([line_diff(list(p), list(q)) for p, q in zip(x, y, strict=True)])

    return both.select("path", F.explode(diff("a", "b")).alias("line_no"))
