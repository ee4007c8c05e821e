"""Operators on result rows: first of equal rows, shared limits, fallbacks, orders of presentation, enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULT_KEY = ("kind", "path", "start_line", "end_line", "symbol")


def first_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row, in the given order, of those with equal keys."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def top_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], most: int) -> DataFrame:
    """rows with rank, the first ``most`` of each key; 0 keeps all. Spark limits groups before it shuffles them."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= most) if most > 0 else ranked


def fair_shares(counts: DataFrame, limit: int) -> DataFrame:
    """(q_ix, n, share) of counts (q_ix, n), in the order of q_ix: a query may take the rest divided by the queries left,
    rounded up; what it leaves goes to later ones; when nothing is left no more queries are answered (share null).
    Queries are what one request asks for, so they fit one row."""
    if limit <= 0:
        return counts.withColumn("share", F.col("n"))
    listed = counts.agg(F.array_sort(F.collect_list(F.struct("q_ix", "n"))).alias("all"))
    start = F.struct(F.lit(limit).cast("bigint").alias("rest"), F.array().cast("array<bigint>").alias("shares"))

    def take(state: Column, x: Column) -> Column:
        queries = F.size("all") - F.size(state["shares"])
        share = F.least(F.ceil(state["rest"] / queries).cast("bigint"), x["n"].cast("bigint"))
        given = F.when(state["rest"] > 0, share)
        return F.struct((state["rest"] - F.coalesce(given, F.lit(0))).alias("rest"), F.concat(state["shares"], F.array(given)).alias("shares"))

    shares = listed.select("all", F.aggregate("all", start, take)["shares"].alias("shares"))
    each = shares.select(F.explode(F.arrays_zip("all", "shares")).alias("x"))
    return each.select(F.col("x.all.q_ix").alias("q_ix"), F.col("x.all.n").alias("n"), F.col("x.shares").alias("share"))


#: Queries of one request whose shares are broadcast.
MOST_QUERIES = 10_000


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], by: str, parts: DataFrame) -> DataFrame:
    """rows with rank, in the given order, of all rows of a key, without a task that holds a key's rows. ``by``: a string column
    that the order begins with, or follows a few constants only with; ``parts``: a table in which a sample of its values gives
    the bounds of ranges, which are numbered by themselves, behind the rows of the ranges before."""
    sample = [r[0] for r in parts.select(by).where(F.col(by).isNotNull()).orderBy(F.xxhash64(by), by).limit(SAMPLE).collect()]
    bounds = sorted(set(sample))[:: max(1, len(sample) // RANGES)]
    at = F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x <= F.col(by))) if bounds else F.lit(0)
    leading = [c for c in order[: next(k for k, c in enumerate(order) if c == by)] if isinstance(c, str)]
    return _in_ranges(rows.withColumn("_range", F.coalesce(at, F.lit(0))), keys, leading, order)


def _in_ranges(ranged: DataFrame, keys: Sequence[str], leading: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """rows with rank in the given order, which goes by the columns leading first and then by _range."""
    here = [*keys, *leading, "_range"]
    # a few numbers for each key: how many rows its ranges have
    sizes = ranged.groupBy(*here).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy(*leading, "_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*here).orderBy(*order))
    joined = ranged.withColumn("_within", within).join(starts.withColumnsRenamed({c: f"_{c}_" for c in here}), [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in here])
    return joined.withColumn("rank", (F.col("_before") + F.col("_within")).cast("int")).drop("_within", "_before", "_range", *[f"_{c}_" for c in here])


#: Values that are sampled for the bounds of ranges, and ranges.
SAMPLE, RANGES = 2_000, 64


def shared_limit(rows: DataFrame, queries: DataFrame, limit: int, order: Sequence[str | Column], paths: DataFrame | None = None) -> DataFrame:
    """rows (q_ix, ...) with rank and truncated, as fair_shares() of the queries (q_ix) allows. With a limit, rows are read
    twice: they should be few, and kept. Without one, ranks come from numbered() by path, for which ``paths`` gives bounds."""
    if limit <= 0 and paths is not None:
        return numbered(rows, ["q_ix"], order, "path", paths).withColumn("truncated", F.lit(False))
    ranked = top_of_each(rows, ["q_ix"], order, limit)  # no share is more than the limit
    if limit <= 0:
        return ranked.withColumn("truncated", F.lit(False))
    counts = queries.select("q_ix").join(rows.groupBy("q_ix").agg(F.count("*").alias("n")), "q_ix", "left").fillna(0, ["n"])
    shares = fair_shares(counts, limit)
    shares = F.broadcast(shares) if queries.count() <= MOST_QUERIES else shares
    joined = ranked.join(shares, "q_ix").where(F.col("rank") <= F.col("share"))
    return joined.withColumn("truncated", F.col("n") > F.col("share")).drop("n", "share")


def first_or_second(first: DataFrame, second: DataFrame, key: str = "q_ix") -> DataFrame:
    """first's rows, and second's for keys that first has no row of."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def first_source(rows: DataFrame, key: str = "q_ix", source: str = "source") -> DataFrame:
    """For each key the rows of its least source, in one reading of rows; source goes."""
    least = F.min(source).over(Window.partitionBy(key))
    return rows.withColumn("_least", least).where(F.col(source) == F.col("_least")).drop("_least", source)


#: Values of a number in order that are numbered by one task.
PLACES = 1 << 16


def placed(rows: DataFrame, behind: Column, order: str = "pos") -> DataFrame:
    """rows with place: over each q_ix first those that are not behind, then the others, each in order of a number, as which
    rank has it. Ranges of PLACES values are numbered by themselves, so no task holds the rows of a query; rows are read twice."""
    ranged = rows.withColumns({"_behind": behind, "_range": F.floor(F.col(order) / PLACES)})
    return _in_ranges(ranged, ["q_ix"], ["_behind"], ["_behind", order]).drop("_behind").withColumnRenamed("rank", "place")


def definitions_first(rows: DataFrame, order: str = "pos") -> DataFrame:
    """rows with place: definitions before others, else as they were."""
    return placed(rows, F.col("kind") != "def", order)


def distinct_files_first(rows: DataFrame, order: str = "pos") -> DataFrame:
    """rows with place: the first of each path, then the others, else as they were."""
    nth = F.row_number().over(Window.partitionBy("q_ix", "path").orderBy(order))
    return placed(rows.withColumn("_nth", nth), F.col("_nth") > 1, order).drop("_nth")


def classified(hits: DataFrame, definitions: DataFrame, include: str = "both") -> DataFrame:
    """hits (path, line_no, symbol, n) as rows of kind def or ref: a line that defines the symbol is a def, and a ref too if
    the symbol is there more often than it is defined. definitions: (path, line_no, symbol), a row for each."""
    counted = definitions.groupBy("path", "line_no", "symbol").agg(F.count("*").alias("_defs"))
    joined = hits.join(counted, ["path", "line_no", "symbol"], "left").withColumn("_defs", F.coalesce("_defs", F.lit(0)))
    return classified_counts(joined, include, "_defs")


def classified_counts(hits: DataFrame, include: str = "both", defs: str = "defs") -> DataFrame:
    """classified() of hits that say themselves, in the column ``defs``, how often their line defines the symbol."""
    kinds = F.when(F.col(defs) == 0, F.array(F.lit("ref"))).when(F.col("n") > F.col(defs), F.array(F.lit("def"), F.lit("ref"))).otherwise(F.array(F.lit("def")))
    rows = hits.withColumn("kind", F.explode(kinds)).drop(defs)
    return rows.where(F.col("kind") == {"defs": "def", "refs": "ref"}[include]) if include in ("defs", "refs") else rows


def finding(kind: Column) -> Column:
    return F.when(kind == "file", "file").when(kind.isin("def", "ref"), "symbol").otherwise("other")


def outcome(rows: DataFrame) -> DataFrame:
    """(q_ix, matched_as): symbol if a row finds one, else other; queries without rows have none."""
    symbol = F.max((finding(F.col("kind")) == "symbol").cast("int"))
    files = F.min((F.col("kind") == "file").cast("int"))
    return rows.groupBy("q_ix").agg(F.when(symbol == 1, "symbol").when(files == 1, "file").otherwise("other").alias("matched_as"))


def changed_only(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """rows of changed paths."""
    return rows.join(changed.select("path").distinct(), "path", "left_semi")


def with_changed_rows(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """rows, where those of changed paths give way to the rows of changed."""
    return changed.unionByName(rows.join(changed.select("path").distinct(), "path", "left_anti"), allowMissingColumns=True)


def counterparts(paths: DataFrame) -> DataFrame:
    """(path, test_path) for x.go with x_test.go among the paths."""
    tests = paths.select(F.col("path").alias("test_path"))
    sources = paths.where(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go"))
    return sources.select("path", F.regexp_replace("path", r"\.go$", "_test.go").alias("test_path")).join(tests, "test_path", "left_semi")


def differences(got: DataFrame, want: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that one side has more often than the other, with side."""
    a, b = got.select(*columns), want.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("got")).unionByName(b.exceptAll(a).withColumn("side", F.lit("want")))


def merged_by_identity(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, s, e, owns): one row for each identity in first (keys, s, e, owns) or second (the same and pos).

    What first has of an identity stands: of its rows those that own a scope, else all, with the widest bounds. An identity
    that only second has is its row of the least pos. Both combine before they shuffle, once."""
    none = F.lit(None).cast("bigint")
    both = first.select(*keys, "s", "e", "owns", none.alias("_pos"), F.lit(True).alias("_first"))
    both = both.unionByName(second.select(*keys, "s", "e", "owns", F.col("pos").cast("bigint").alias("_pos"), F.lit(False).alias("_first")))
    owner, other = F.col("_first") & F.col("owns"), F.col("_first") & ~F.col("owns")
    picked = [F.min(F.when(owner, F.col("s"))).alias("_os"), F.max(F.when(owner, F.col("e"))).alias("_oe"), F.min(F.when(other, F.col("s"))).alias("_ns"), F.max(F.when(other, F.col("e"))).alias("_ne")]
    found = both.groupBy(*keys).agg(*picked, F.min(F.when(~F.col("_first"), F.struct("_pos", "s", "e", "owns"))).alias("_second"))
    owned = F.col("_os").isNotNull()
    bound = lambda a, b, c: F.coalesce(a, b, f"_second.{c}").alias(c)
    return found.select(*keys, bound("_os", "_ns", "s"), bound("_oe", "_ne", "e"), F.when(owned, True).when(F.col("_ns").isNotNull(), False).otherwise(F.col("_second.owns")).alias("owns"))
