"""Operators of symbol and path search over tables of files and lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T


def lines_of(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, line_no, line, total) for each line of files (path, content)."""
    lines = files.select("path", T.source_lines(F.col(content)).alias("_lines"))
    # outer: else Spark also filters by the array's size, and makes the array twice for it
    exploded = lines.select("path", F.size("_lines").alias("total"), F.posexplode_outer("_lines").alias("_p", "line")).where("_p IS NOT NULL")
    return exploded.select("path", (F.col("_p") + 1).alias("line_no"), "line", "total")


def occurrences(lines: DataFrame, symbols: Sequence[str], column: str = "line", identifier: str = T.IDENTIFIER) -> DataFrame:
    """lines with q_ix, symbol and n for each of the symbols that a line has, in one pass over the lines."""
    counts = [F.struct(F.lit(k).alias("q_ix"), F.lit(s).alias("symbol"), T.occurrence_count(F.col(column), s, identifier).cast("bigint").alias("n")) for k, s in enumerate(symbols)]
    any_of = F.lit(False)
    for s in symbols:
        any_of = any_of | F.col(column).contains(s)
    each = lines.where(any_of).withColumn("_q", F.explode(F.array(*counts))).where("_q.n > 0")
    return each.select(*lines.columns, "_q.q_ix", "_q.symbol", "_q.n")


def words_of_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, line_no, symbol, n, leads) for each distinct word of each line of files (path, content): how often the line has
    it, and whether it is the text in front of the line's first blank and no line above of this file begins with it. A file's
    rows come from its own row: nothing is shuffled. Runs of equal words are counted in sorted arrays, so long lines and files
    take no square of their length."""
    struct = F.struct
    lines = files.select("path", T.source_lines(F.col(content)).alias("_lines"))
    led = lines.withColumn("_by_lead", F.array_sort(F.transform("_lines", lambda x, k: struct(F.substring_index(x, " ", 1).alias("lead"), k.alias("k")))))
    before = lambda i: F.get("_by_lead", i - 1)["lead"]
    marked = led.withColumn("_first", F.array_sort(F.transform("_by_lead", lambda x, i: struct(x["k"].alias("k"), ((i == 0) | (x["lead"] != before(i))).alias("first")))))
    each = marked.select("path", F.posexplode(F.arrays_zip("_lines", "_first")).alias("_p", "_x"))
    words = each.select("path", (F.col("_p") + 1).alias("line_no"), F.when(F.col("_x._first.first"), F.substring_index("_x._lines", " ", 1)).alias("_lead"), F.array_sort(F.regexp_extract_all("_x._lines", F.lit(f"[{T.IDENTIFIER}]+"), F.lit(0))).alias("_words"))
    starts = F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda i: (i == 0) | (F.get("_words", i) != F.get("_words", i - 1)))
    runs = words.where(F.size("_words") > 0).withColumn("_starts", starts)
    counts = F.transform("_starts", lambda a, j: struct(F.get("_words", a).alias("symbol"), (F.coalesce(F.get("_starts", j + 1), F.size("_words")) - a).cast("bigint").alias("n")))
    found = runs.select("path", "line_no", "_lead", F.explode(counts).alias("_c"))
    return found.select("path", "line_no", "_c.symbol", "_c.n", F.coalesce(F.col("_c.symbol") == F.col("_lead"), F.lit(False)).alias("leads"))


def path_matches(files: DataFrame, queries: Sequence[str]) -> DataFrame:
    """(q_ix, path, match_rank) for the paths that a query matches."""
    ranks = [F.struct(F.lit(k).alias("q_ix"), P.match_rank(F.col("path"), q).alias("match_rank")) for k, q in enumerate(queries)]
    each = files.select("path", F.explode(F.array(*ranks)).alias("_q")).where("_q.match_rank IS NOT NULL")
    return each.select("_q.q_ix", "path", "_q.match_rank")


def symbol_index(lines: DataFrame, column: str = "line") -> DataFrame:
    """(symbol, path, line_no): each identifier of three characters or more, keywords left out, once for a line."""
    found = lines.select("path", "line_no", F.explode(F.array_distinct(T.identifiers(F.col(column)))).alias("symbol"))
    return found.where(~T.is_keyword(F.col("symbol")))


def frequent_symbols(index: DataFrame, least: int, most: int, limit: int) -> DataFrame:
    """(symbol, n): the limit most frequent symbols of least to most places, ties by name."""
    return index.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n").between(least, most)).orderBy(F.col("n").desc(), "symbol").limit(limit)


def with_snippets(ranges: DataFrame, files: DataFrame, most: int = 0, content: str = "content") -> DataFrame:
    """ranges (path, s, e, line_no, ...) with code, code_start, code_end and code_truncated from their files."""
    lines = files.select("path", T.source_lines(F.col(content)).alias("_lines"))
    joined = ranges.join(lines, "path")
    s, e, focus = F.col("s"), F.col("e"), F.col("line_no")
    start, end = T.snippet_start(s, e, focus, most), T.snippet_end(s, e, focus, most)
    truncated = F.lit(most > 0) & (e - s + 1 > most) if most > 0 else F.lit(False)
    return joined.select(
        *ranges.columns,
        T.joined(F.col("_lines"), start, end).alias("code"),
        F.when(truncated, start).otherwise(0).alias("code_start"),
        F.when(truncated, end).otherwise(0).alias("code_end"),
        truncated.alias("code_truncated"),
    )


def import_ranges(imports: DataFrame) -> DataFrame:
    """(path, s, e): from the first to the last import statement of each file."""
    return imports.groupBy("path").agg(F.min("s").alias("s"), F.max("e").alias("e"))


def brace_definition(line: Column) -> Column:
    """The symbol that a line of a brace language defines: ``function`` or ``class NAME``, or a line that ends with NAME(...) and
    maybe an open brace; null if none."""
    text = F.trim(line)
    named = F.nullif(F.regexp_extract(text, r"^(?:function|class)\s+([A-Za-z_][A-Za-z0-9_]*)(?![A-Za-z0-9_])", 1), F.lit(""))
    called = F.nullif(F.regexp_extract(text, r"^.*(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*)\s*\([^;]*\)\s*\{?\s*$", 1), F.lit(""))
    return F.coalesce(named, called)


def reconciled(count: Column, adjustment: Column) -> Column:
    """A count with a signed correction, at least zero."""
    return F.greatest(F.lit(0), count + F.coalesce(adjustment, F.lit(0)))


def reconciled_columns(found: Column, removed: Column, added: Column) -> Column:
    """Columns without removed ones, once each for as often as they are removed, and with added ones; sorted, distinct."""
    left = F.aggregate(removed, found, lambda have, x: F.when(F.array_position(have, x) > 0, F.concat(F.slice(have, F.lit(1), F.array_position(have, x).cast("int") - 1), F.slice(have, F.array_position(have, x).cast("int") + 1, F.size(have)))).otherwise(have))
    return F.array_sort(F.array_distinct(F.concat(left, added)))
