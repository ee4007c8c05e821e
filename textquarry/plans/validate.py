"""Checks of find against an independent reading of the corpus.

The other reading knows nothing of languages: it takes words from lines, picks symbols that are neither rare nor everywhere,
and compares their places, ranges and code with what find returns when nothing is masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import results, search
from ..sources.corpus import Corpus
from . import verbs
from .options import Options

LEAST, MOST = 2, 200
#: Words of Modula-2 that its files' symbols leave out beside the common ones.
MODULA_WORDS = "ARRAY BEGIN BY CASE CONST DEFINITION DIV DO ELSE ELSIF END EXIT EXPORT FOR FROM IF IMPLEMENTATION IMPORT IN LOOP MOD MODULE NOT OF OR POINTER PROCEDURE QUALIFIED RECORD REPEAT RETURN SET THEN TO TYPE UNTIL VAR WHILE WITH".split()


def has_word(line: Column, word: str) -> Column:
    """Whether a line has word with no letter, number, mark, connector or format character beside it."""
    beside = T.IDENTIFIER + r"\p{Cf}"
    return line.rlike(f"(?<![{beside}]){T.quoted(word)}(?![{beside}])")


def symbols(corpus: Corpus, limit: int = 100) -> DataFrame:
    """(symbol, n): the most frequent symbols found on LEAST to MOST lines of source files."""
    index = search.symbol_index(search.lines_of(corpus.sources()))
    modula = P.extension(F.col("path")).isin("mod", "def") & F.col("symbol").isin(*MODULA_WORDS)
    return search.frequent_symbols(index.where(~modula), LEAST, MOST, limit)


def location_faults(corpus: Corpus, names: list[str]) -> DataFrame:
    """(symbol, path, line, side) that only find, or only the other reading, has."""
    found = verbs.find_many(corpus, names, Options(match="symbol", returns="locations"))
    got = found.select("symbol", "path", "line").distinct()
    lines = search.lines_of(corpus.sources())
    each = F.explode(F.array(*[F.when(F.col("line").contains(w) & has_word(F.col("line"), w), F.lit(w)) for w in names]))
    want = lines.select("path", F.col("line_no").alias("at"), each.alias("symbol")).where("symbol IS NOT NULL").select("symbol", "path", F.col("at").alias("line"))
    return results.differences(got, want, ["symbol", "path", "line"])


def range_faults(corpus: Corpus, rows: DataFrame) -> DataFrame:
    """Rows of a find with code whose range is not in the file, does not hold the hit, or whose code is not its lines."""
    lines = corpus.files.select("path", T.source_lines(F.col("content")).alias("_lines"))
    joined = rows.join(lines, "path")
    inside = (F.col("start_line") >= 1) & (F.col("end_line") <= F.size("_lines")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    start, end = F.coalesce("code_start_line", "start_line"), F.coalesce("code_end_line", "end_line")
    same = F.regexp_replace(T.joined(F.col("_lines"), start, end), "\n+$", "") == F.col("code")
    fault = F.when(~inside, "range").when(F.col("code").isNotNull() & ~same, "code")
    return joined.withColumn("fault", fault).where("fault IS NOT NULL").drop("_lines")


def report(corpus: Corpus, limit: int = 100) -> DataFrame:
    """(symbols, places, location_faults, range_faults): one row."""
    names = [r["symbol"] for r in symbols(corpus, limit).collect()]  # limit names
    if not names:
        return corpus.files.sparkSession.createDataFrame([(0, 0, 0, 0)], "symbols long, places long, location_faults long, range_faults long")
    found = verbs.find_many(corpus, names, Options(match="symbol", returns="scope", max_code_lines=1 << 30))
    counted = found.agg(F.count("*").alias("places"))
    bad = location_faults(corpus, names).agg(F.count("*").alias("location_faults"))
    ranges = range_faults(corpus, found).agg(F.count("*").alias("range_faults"))
    one = counted.select(F.lit(len(names)).cast("bigint").alias("symbols"), "places")
    return one.join(bad, F.lit(True)).join(ranges, F.lit(True))


