"""The four verbs over a corpus: find, inspect, outline, changed. Each is a plan that returns a DataFrame of result rows.

Result rows have q_ix (the query or place they answer) and rank, whether their response is truncated, and RESULT's columns.
``respond`` turns them into responses, one for each query.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..languages import occurrences
from ..operators import ranges, results, search
from ..sources.corpus import Corpus, analysed_files, analysed_lines
from .options import Options

RESULT = (
    "scope string, symbol string, path string, code string, signature string, kind string, finding string, language string, changed_lines array<int>,"
    " scopes array<string>, end_line int, start_line int, line int, code_start_line int, code_end_line int, code_truncated boolean"
)
COLUMNS = [x.split()[0] for x in RESULT.split(", ")]
#: Languages whose hits belong to scopes by column; the others' by line.
BY_COLUMN = ("go", "rust", "java", "c", "cpp", "csharp", "kotlin", "swift", "modula-2")
HINTS = {
    "symbol": "No exact source identifier matched. Try a complete identifier or use match=path for repository paths.",
    "path": "No literal repository path matched. Try a shorter path fragment or use match=symbol for source identifiers.",
    "auto": "No exact source identifier or literal repository path matched. Try a shorter literal query, or use changed for branch, commit, or PR work.",
}


def _lines(files: DataFrame, options: Options, symbols: Sequence[str] = (), only: bool = False, wanted: str = "") -> DataFrame:
    return analysed_lines(files, options.masks_comments, options.no_strings, options.drop_comments, options.drop_docstrings, symbols, only, wanted)


#: Fixed list: words that name something in Kotlin only in backticks.
KOTLIN_WORDS = "as break class continue do else false for fun if in interface is null object package return super this throw true try typealias typeof val var when while".split()


def _by_token(symbol: str) -> list[str]:
    """The languages whose analysis counts the symbol."""
    return [x for x in occurrences.COMPOSITE if occurrences.counted(x, symbol)]


def _token_columns(symbol: str) -> Column:
    return F.get(F.filter("tokens", lambda x: x["symbol"] == symbol), 0)["cols"]


def _counted(symbol: str) -> Column:
    """How often a line has the symbol, by its language's rules."""
    line, lang = F.col("search"), F.col("lang")
    plain = T.occurrence_count(line, symbol)
    script = T.occurrence_count(line, symbol, T.IDENTIFIER_CLASSES["javascript"])
    # Rust: a raw identifier's name and a lifetime's are not the plain name; a closing quote makes it a character
    i, name = T.IDENTIFIER, T.quoted(symbol)
    rust_pattern = f"(?<![{i}])(?<!r#)(?:(?<!')|(?={name}'))(?={name}(?![{i}]))" + ("(?!r#)" if symbol == "r" else "")
    rust = F.when(line.contains(symbol), F.regexp_count(line, F.lit(rust_pattern))).otherwise(F.lit(0))
    count = F.when(lang.isin(*_by_token(symbol)), F.coalesce(F.array_size(_token_columns(symbol)), F.lit(0)))
    count = count.when(lang.isin("javascript", "typescript"), script).when(lang == "rust", rust)
    if symbol in KOTLIN_WORDS:
        count = count.when(lang == "kotlin", T.occurrence_count(line, f"`{symbol}`"))
    spliced = F.aggregate(F.filter("adjust", lambda x: x["symbol"] == symbol), F.lit(0), lambda n, x: n + x["by"])
    return search.reconciled(count.otherwise(plain), spliced)


def _maybe(content: Column, path: Column, symbols: Sequence[str]) -> Column:
    """Whether a file can have one of the symbols, that is, all parts of its name; spares most files the analysis. Spliced
    lines can hide a name from a plain search, so files that may have those stay."""
    found = F.lit(False)
    for s in symbols:
        parts = re.findall(r"\w+", s)
        found = found | functools.reduce(lambda a, b: a & b, [content.contains(x) for x in parts or [s]])
    return found | (P.extension(path).isin(*(P.EXTENSIONS["c"] + " " + P.EXTENSIONS["cpp"]).split()) & content.contains("\\\n"))


def _hits(corpus: Corpus, symbols: Sequence[str], options: Options, files: DataFrame) -> DataFrame:
    """A row for each line, symbol and kind, with the hit's column where owners share the line."""
    lines = _lines(files.where(_maybe(F.col("content"), F.col("path"), symbols)), options, symbols, only=True).where("NOT ignored")
    counts = [F.struct(F.lit(k).alias("q_ix"), F.lit(s).alias("symbol"), _counted(s).alias("n")) for k, s in enumerate(symbols)]
    hits = lines.withColumn("_q", F.explode(F.array(*counts))).where("_q.n > 0").select("*", "_q.q_ix", "_q.symbol", "_q.n").drop("_q")
    own = F.filter("defs", lambda d: d["symbol"] == F.col("symbol"))
    kinds = F.when(F.size(own) == 0, F.array(F.lit("ref"))).when(F.col("n") > F.size(own), F.array(F.lit("def"), F.lit("ref"))).otherwise(F.array(F.lit("def")))
    hits = hits.withColumn("own", F.transform(own, lambda d: d["col"])).withColumn("kind", F.explode(kinds))
    if options.include in ("defs", "refs"):
        hits = hits.where(F.col("kind") == options.include[:-1])
    shared = F.size("owners") > 0
    columns = F.lit(None).cast("array<int>")
    for k, s in enumerate(symbols):
        places = F.when(F.col("lang").isin(*_by_token(s)), _token_columns(s)).otherwise(T.occurrence_columns(F.col("search"), s))
        columns = F.when(shared & (F.col("q_ix") == k), places).otherwise(columns)
    first_ref = F.get(F.filter("_columns", lambda c: ~F.array_contains("own", c)), 0)
    col = F.when(F.col("kind") == "def", F.get("own", 0)).otherwise(F.coalesce(first_ref, F.get("_columns", 0)))
    return hits.withColumn("_columns", columns).withColumn("hit_col", F.when(shared, col)).drop("_columns")


def _placed(hits: DataFrame, options: Options) -> DataFrame:
    """hits with start_line, end_line and scope."""
    at = F.element_at(F.filter("owners", lambda o: (o["col"] <= F.col("hit_col")) & (F.col("hit_col") < o["stop"])), -1)
    inner = F.when((F.size("owners") > 0) & F.col("hit_col").isNotNull() & (F.size(F.filter("owners", lambda o: (o["col"] <= F.col("hit_col")) & (F.col("hit_col") < o["stop"]))) > 0), at)
    by_column = F.col("lang").isin(*BY_COLUMN)
    # an owner declared or ended on the line, but not around the hit, does not hold it
    outside = by_column & (F.size("owners") > 0) & F.col("hit_col").isNotNull() & inner.isNull() & (F.col("owner_start") == F.col("line_no"))
    line = F.col("line_no")
    go_only = (F.col("lang") == "go") & F.col("owner").isNull()
    start = F.when(inner.isNotNull(), inner["s"]).when(outside | go_only, line).otherwise(F.col("nav_start"))
    end = F.when(inner.isNotNull(), inner["e"]).when(outside | go_only, line).otherwise(F.col("nav_end"))
    name = F.when(F.col("kind") == "def", F.col("symbol")).when(~by_column, F.col("scope")).when(inner.isNotNull(), inner["symbol"]).when(outside, F.lit("")).otherwise(F.coalesce("owner", F.lit("")))
    name = F.when((F.col("lang") == "java") & (F.col("kind") != "def") & (name == ""), F.col("scope")).otherwise(name)
    return _ranged(hits, options, start, end).withColumn("scope", name)


def _ranged(hits: DataFrame, options: Options, start: Column, end: Column) -> DataFrame:
    line, total = F.col("line_no"), F.col("total")
    if options.returns == "context":
        start, end = T.context_start(line, options.context or 0), T.context_end(line, options.context or 0, total)
    elif options.returns in ("line", "locations"):
        start, end = line, line
    return hits.withColumn("start_line", start.cast("int")).withColumn("end_line", end.cast("int"))


def _with_code(rows: DataFrame, files: DataFrame, options: Options, code_start: str = "start_line", code_end: str = "end_line", focus: str = "line", few: bool = True) -> DataFrame:
    """rows with code and its range: apply limits before. ``files`` are those that rows can be of. With ``few`` rows only their
    own files go into the join, and rows are read twice."""
    if options.returns == "locations":
        return rows.withColumns({"code": F.lit(None).cast("string"), "code_start_line": F.lit(None).cast("int"), "code_end_line": F.lit(None).cast("int"), "code_truncated": F.lit(False)})
    files = files.join(rows.where(F.col(code_start).isNotNull()).select("path").distinct(), "path", "left_semi") if few else files
    if options.drop_comments or options.drop_docstrings:
        clean = _lines(files, options).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "clean"))).alias("_l"))
        texts = clean.select("path", F.transform("_l", lambda x: x["clean"]).alias("_lines"))
    else:
        texts = files.select("path", T.source_lines(F.col("content")).alias("_lines"))
    s, e, f, most = F.col(code_start), F.col(code_end), F.col(focus), options.max_code_lines
    code = T.joined(F.col("_lines"), T.snippet_start(s, e, f, most), T.snippet_end(s, e, f, most))
    if options.drop_comments or options.drop_docstrings:
        code = F.when(F.col("language") == "go", code).otherwise(T.without_blank_lines(code))
    cut = F.lit(most > 0) & (e - s + 1 > most)
    has = F.col(code_start).isNotNull()
    return (
        rows.join(texts, "path", "left")
        .withColumn("code", F.when(has, F.regexp_replace(code, "\n+$", "")))
        .withColumn("code_start_line", F.when(has & cut, T.snippet_start(s, e, f, most)))
        .withColumn("code_end_line", F.when(has & cut, T.snippet_end(s, e, f, most)))
        .withColumn("code_truncated", F.coalesce(has & cut, F.lit(False)))
        .drop("_lines")
    )


def _shaped(rows: DataFrame, *extra: str) -> DataFrame:
    """rows in the columns of results; missing ones are null."""
    out = []
    for column in RESULT.split(", "):
        name, kind = column.split(" ", 1)
        out.append((F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name))
    return rows.select(*extra, *out)


def _kind_rank() -> Column:
    return F.when(F.col("kind") == "def", 0).otherwise(1)


def find_many(corpus: Corpus, queries: Sequence[str], options: Options = Options(), changed: DataFrame | None = None) -> DataFrame:
    """Rows for all queries: symbols' definitions and references, or paths. changed: (path) of the changed files, for
    changed_only. With a limit, queries share it from left to right."""
    if not queries:
        raise ValueError("at least one query is required")
    if any(not q for q in queries):
        raise ValueError("query must not be empty")
    options = options.normalised("scope")
    spark = corpus.files.sparkSession
    found: list[DataFrame] = []
    texts = corpus.files.where("false")
    if options.match != "path":
        files = _changed_only(corpus.sources(options.path_globs, options.exclude_globs), changed, options)
        files = _enough(corpus, queries, options, files)
        texts = files.where(_maybe(F.col("content"), F.col("path"), queries))  # rows of paths have no code
        hits = _placed(_hits(corpus, queries, options, files), options)
        rows = hits.select("q_ix", "kind", "symbol", "path", F.col("line_no").alias("line"), "start_line", "end_line", "scope", F.col("reported").alias("language"), results.finding(F.col("kind")).alias("finding"))
        first = results.first_of_each(rows, ["q_ix", *results.RESULT_KEY], ["path", "line", _kind_rank()])
        order: list[str | Column] = ["path", "line", _kind_rank()]
        symbols = results.top_of_each(first, ["q_ix"], order, options.limit + 1 if options.limit else 0).drop("rank")
        found.append(symbols.withColumn("match_rank", F.lit(0)).withColumn("source", F.lit(0)))
    if options.match != "symbol":
        paths = _changed_only(corpus.paths(options.path_globs, options.exclude_globs), changed, options)
        matches = search.path_matches(paths, queries)
        matches = results.top_of_each(matches, ["q_ix"], ["match_rank", "path"], options.limit + 1 if options.limit else 0).drop("rank")
        rows = matches.select("q_ix", "path", "match_rank", F.lit("file").alias("kind"), F.lit("file").alias("finding"), F.lit(None).cast("int").alias("line"), F.lit(1).alias("source"))
        found.append(rows)
    every = found[0].drop("source") if len(found) == 1 else results.first_source(found[0].unionByName(found[1], allowMissingColumns=True))
    every = held(every)  # hits are few beside the files, and read more than once
    asked = spark.range(len(queries)).select(F.col("id").cast("int").alias("q_ix"))
    limited = results.shared_limit(every, asked, options.limit, ["match_rank", "path", "line", _kind_rank()], corpus.files)
    for name, kind in (("start_line", "int"), ("end_line", "int"), ("symbol", "string"), ("scope", "string"), ("language", "string")):
        if name not in limited.columns:
            limited = limited.withColumn(name, F.lit(None).cast(kind))
    return _shaped(_with_code(limited, texts, options), "q_ix", "rank", "truncated")


#: Rows that verbs hold in Spark's storage until they are released.
_rows: list[DataFrame] = []


def held(rows: DataFrame) -> DataFrame:
    _rows.append(rows.persist())
    return _rows[-1]


def release() -> None:
    """Free what verbs hold; results that are read afterwards are computed again."""
    while _rows:
        _rows.pop().unpersist()


#: Files that may hold a symbol of a query with a limit: so many are looked at first, then so many times as many.
FIRST_FILES, MORE = 512, 16


def _enough(corpus: Corpus, queries: Sequence[str], options: Options, files: DataFrame) -> DataFrame:
    """With a limit, the files in order of path up to one by which each query has the limit's rows and one more, as results go
    by path first; the rest needs no analysis. All files where there are few, or not enough rows."""
    if not options.limit:
        return files
    may, n = files.where(_maybe(F.col("content"), F.col("path"), queries)), FIRST_FILES
    while True:
        ends = may.select("path").orderBy("path").limit(n).agg(F.max("path").alias("end"), F.count("*").alias("n")).first()
        if ends["n"] < n:
            return files
        part = files.where(F.col("path") <= ends["end"])
        rows = _placed(_hits(corpus, queries, options, part), options)
        got = rows.groupBy("q_ix").agg(F.count_distinct(*results.RESULT_KEY).alias("n"))
        if got.where(F.col("n") > options.limit).count() == len(queries):
            return part
        n *= MORE


def find(corpus: Corpus, query: str, options: Options = Options(), changed: DataFrame | None = None) -> DataFrame:
    return find_many(corpus, [query], options, changed)


def _changed_only(files: DataFrame, changed: DataFrame | None, options: Options) -> DataFrame:
    if not options.changed_only:
        return files
    if changed is None:
        raise ValueError("changed_only needs the changed files")
    return results.changed_only(files, changed)


NAME = r"[\p{L}_][\p{L}\p{Nd}_]*"
#: What stands in front of a member's name, by language.
MEMBERS = {"c": r"(?:\.|->)", "cpp": r"(?:\.|->)", "csharp": r"(?:\.|::)", "kotlin": r"(?:\.|::)", "swift": r"(?:\.|::)", "rust": r"\."}
#: In which order languages look for what a line is about: a call, the outermost call, a macro, the first or last member,
#: the last call, a word.
ORDERS = {
    "go": ("call", "member", "word"),
    "python": ("call", "last_member", "word"),
    "c": ("call", "member", "word"),
    "cpp": ("call", "member", "word"),
    "csharp": ("member", "call", "word"),
    "kotlin": ("member", "call", "word"),
    "swift": ("last_member", "last_call", "word"),
    "rust": ("outer_call", "macro", "member", "word"),
    "java": ("outer_call", "member", "word"),
    "javascript": ("outer_call", "member", "word"),
    "typescript": ("outer_call", "member", "word"),
}


def best_symbol() -> Column:
    """The symbol that stands for an analysed line: what it defines, else what its language's order finds first."""
    line, lang = F.col("structural"), F.col("lang")

    def named(text: Column, pattern: str) -> Column:
        return F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda w: (w != "_") & ~T.is_keyword(w))

    # What is in parentheses goes, so that a chain's last call is the one around all others before it.
    outer = line
    for _ in range(4):
        outer = F.regexp_replace(outer, r"\([^()]*\)", "\u0001")

    def found(what: str, language: str) -> Column:
        before = MEMBERS.get(language, r"\.")
        called = rf"({NAME})\s*(?:<[^<>()]*>\s*)?\(" if language in ("csharp", "cpp") else rf"({NAME})\s*(?:\[|\()" if language in ("", "go", "python") else rf"({NAME})\s*\("
        if what == "member":
            return F.get(named(line, rf"{before}\s*({NAME})"), 0)
        if what == "last_member":
            return F.try_element_at(F.regexp_extract_all(line, F.lit(rf"{before}\s*({NAME})"), F.lit(1)), F.lit(-1))
        if what == "call":
            return F.get(named(line, called), 0)
        if what == "last_call":
            return F.try_element_at(named(line, called), F.lit(-1))
        if what == "outer_call":
            return F.try_element_at(named(outer, rf"({NAME})\s*(?:::)?(?:<[^<>()]*>\s*)?[\x01(]"), F.lit(-1))
        if what == "macro":
            return F.get(named(line, rf"({NAME})\s*!\s*[\[({{]"), 0)
        return F.get(named(line, f"({NAME})"), 0)

    by_language = F.coalesce(*(found(x, "") for x in ("member", "call", "word")))
    for language, order in ORDERS.items():
        by_language = F.when(lang == language, F.coalesce(*(found(x, language) for x in order))).otherwise(by_language)
    return F.coalesce(F.get("defs", 0)["symbol"], by_language, F.lit(""))


def inspect(corpus: Corpus, locations: Sequence[str], options: Options = Options(), changed: DataFrame | None = None) -> DataFrame:
    """For each PATH:LINE its scope, then its file's imports and related definitions and references, as include says. A path or
    line that isn't there, or that filters leave out, is a ValueError."""
    options = options.normalised("scope")
    spark = corpus.files.sparkSession
    asked = [P.parse_location(x) for x in locations]
    asked = [(P.safe_relative(path), line) for path, line in asked]
    wanted = spark.createDataFrame([(k, p, n) for k, (p, n) in enumerate(asked)], "q_ix int, path string, at int")
    files = corpus.files.where(F.col("path").isin(*sorted({p for p, _ in asked})))
    kept = files.where(P.path_filter(F.col("path"), options.path_globs, options.exclude_globs))
    lines = _lines(_changed_only(kept, changed, options), options).join(F.broadcast(wanted), "path").where("line_no = at")
    scopes = _ranged(lines, options, F.col("nav_start"), F.col("nav_end")).withColumn("symbol", best_symbol()).withColumn("kind", F.lit("scope"))
    primary = scopes.select("q_ix", "symbol", "path", "kind", F.col("line_no").alias("line"), "start_line", "end_line", "scope", F.col("reported").alias("language"), F.lit("other").alias("finding"))
    primary = held(primary)
    got = {r["q_ix"]: r for r in primary.collect()}  # a row for each place asked for
    for k, location in enumerate(locations):
        if k not in got:
            raise ValueError(f"{location!r} is not in the corpus, out of range, or left out by filters")
    parts = [primary.withColumn("part", F.lit(0)).withColumn("pos", F.lit(0))]
    if options.include in ("imports", "all"):
        ranges_ = analysed_files(kept).where("import_start IS NOT NULL").join(F.broadcast(wanted), "path")
        parts.append(ranges_.select("q_ix", "path", F.lit("imports").alias("kind"), F.col("import_start").alias("start_line"), F.col("import_end").alias("end_line"), F.col("reported").alias("language"), F.lit("other").alias("finding"), F.lit(1).alias("part"), F.lit(0).alias("pos"), F.col("total")))
    symbols = sorted({r["symbol"] for r in got.values() if r["symbol"]})
    if options.include in ("defs", "refs", "both", "all") and symbols:
        from dataclasses import replace

        # a row of the place itself, or of its imports, may take one's place; one more tells whether there are more
        related_options = replace(options, include="both" if options.include == "all" else options.include, match="symbol", limit=0)
        related = find_many(corpus, symbols, related_options, changed).drop("code", "code_start_line", "code_end_line", "code_truncated", "truncated", "signature", "changed_lines", "scopes")
        which = spark.createDataFrame([(k, symbols.index(r["symbol"])) for k, r in got.items() if r["symbol"]], "q_ix int, s_ix int")
        parts.append(related.withColumnsRenamed({"q_ix": "s_ix", "rank": "pos"}).join(F.broadcast(which), "s_ix").drop("s_ix").withColumn("part", F.lit(2)))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    every = results.first_of_each(every, ["q_ix", *results.RESULT_KEY], ["part", "pos"])
    counted = every.withColumn("rank", F.row_number().over(Window.partitionBy("q_ix").orderBy("part", "pos"))).withColumn("n", F.count("*").over(Window.partitionBy("q_ix")))
    if options.limit:
        counted = counted.where(F.col("rank") <= options.limit).withColumn("truncated", F.col("n") > options.limit)
    else:
        counted = counted.withColumn("truncated", F.lit(False))
    # imports show their lines, the first of them, or the lines around them
    is_import, context = F.col("kind") == "imports", options.context or 0
    total = F.col("total") if "total" in counted.columns else F.lit(None).cast("int")
    first = F.when(is_import & F.lit(options.returns == "context"), F.greatest(F.lit(1), F.col("start_line") - context)).otherwise(F.col("start_line"))
    last = F.when(is_import & F.lit(options.returns == "line"), F.col("start_line")).when(is_import & F.lit(options.returns == "context"), F.least(total, F.col("end_line") + context)).otherwise(F.col("end_line"))
    shown = counted.withColumns({"code_from": first, "code_to": last, "focus": F.coalesce("line", "start_line")})
    coded = _with_code(shown, corpus.files, options, "code_from", "code_to", "focus")
    wider = is_import & ~F.col("code_truncated") & ((F.col("code_from") != F.col("start_line")) | (F.col("code_to") != F.col("end_line"))) & F.lit(options.returns != "locations")
    coded = coded.withColumn("code_start_line", F.when(wider, F.col("code_from")).otherwise(F.col("code_start_line"))).withColumn("code_end_line", F.when(wider, F.col("code_to")).otherwise(F.col("code_end_line")))
    return _shaped(coded, "q_ix", "rank", "truncated")


def outline(corpus: Corpus, paths: Sequence[str], options: Options = Options()) -> DataFrame:
    """For each path its definitions in source order, with the line that each is declared on as signature. Filters don't apply."""
    options = options.normalised("line")
    spark = corpus.files.sparkSession
    clean = [P.safe_relative(p) for p in paths]
    wanted = spark.createDataFrame(list(enumerate(clean)), "q_ix int, path string")
    files = corpus.files.where(F.col("path").isin(*sorted(set(clean))))
    found = analysed_files(files).join(F.broadcast(wanted), "path").select("*", F.posexplode("defs").alias("pos", "d"))
    ranked = found.withColumn("rank", F.col("pos") + 1).withColumn("truncated", F.lit(options.limit > 0) & (F.size("defs") > options.limit))
    if options.limit:
        ranked = ranked.where(F.col("rank") <= options.limit)
    lines = files.select("path", T.source_lines(F.col("content")).alias("_all"))
    line = F.col("d.line")
    rows = ranked.join(lines, "path").select(
        "q_ix", "rank", "truncated", "path", "total", F.col("d.symbol").alias("symbol"), F.col("d.symbol").alias("scope"), line.alias("line"), line.alias("line_no"), F.lit("def").alias("kind"), F.lit("symbol").alias("finding"),
        F.col("reported").alias("language"), F.trim(F.get("_all", line - 1)).alias("signature"), F.col("d.scope_start").alias("s"), F.col("d.scope_end").alias("e"), F.col("d.owns_scope").alias("owns"),
    )
    if options.returns == "scope":
        nav = _lines(files, options).select("path", "line_no", "nav_start", "nav_end")
        rows = rows.join(nav, ["path", "line_no"])
    else:
        rows = rows.withColumn("nav_start", line_of := F.col("line_no")).withColumn("nav_end", line_of)
    rows = _ranged(rows, options, F.col("nav_start"), F.col("nav_end"))
    return _shaped(_with_code(rows, files, options, few=False), "q_ix", "rank", "truncated")


def changed(corpus: Corpus, changed_files: DataFrame, changed_lines: DataFrame, options: Options = Options()) -> DataFrame:
    """Rows for changed files (path) and lines (path, line_no) of the corpus, which is the new side: merged ranges with the
    names of the scopes changed in them, or a row for each line; a file that is gone, empty or unchanged in lines is a row
    of kind file."""
    options = options.normalised("context")
    chosen = changed_files.select("path").distinct().where(P.path_filter(F.col("path"), options.path_globs, options.exclude_globs))
    files = corpus.files.join(chosen, "path", "left_semi")
    # files without changed lines need no analysis, and the others' lines are analysed once, for all that reads them
    numbers = changed_lines.groupBy("path").agg(F.collect_set(F.col("line_no").cast("int")).alias("wanted"))
    touched = _lines(files.join(numbers, "path"), options, wanted="wanted")
    touched = held(touched.select("line_no", "path", "total", "scope", "reported", "nav_start", "nav_end"))
    if options.returns in ("locations", "context"):
        around = 0 if options.returns == "locations" else options.context or 0
        spans = ranges.context_ranges(touched.select("path", "line_no", "total"), ["path"], around).withColumnsRenamed({"s": "start_line", "e": "end_line"})
        inside = touched.select(F.col("path").alias("p"), "line_no", "scope", "reported").join(spans, (F.col("p") == F.col("path")) & F.col("line_no").between(F.col("start_line"), F.col("end_line")))
        grouped = inside.groupBy("path", "start_line", "end_line").agg(F.array_sort(F.collect_list(F.struct("line_no", "scope"))).alias("l"), F.first("reported").alias("language"))
        names = F.array_distinct(F.filter(F.transform("l", lambda x: x["scope"]), lambda n: n != ""))
        rows = grouped.select(
            "path", "start_line", "end_line", F.col("start_line").alias("line"), F.transform("l", lambda x: x["line_no"]).alias("changed_lines"), "language", F.get("l", 0)["line_no"].alias("focus"),
            F.when(F.size(names) == 1, names[0]).alias("scope"), F.when(F.size(names) > 1, names).alias("scopes"),
        )
    else:
        placed = _ranged(touched, options, F.col("nav_start"), F.col("nav_end"))
        rows = placed.select("path", "start_line", "end_line", F.col("line_no").alias("line"), F.col("line_no").alias("focus"), "scope", F.col("reported").alias("language"))
    rows = rows.withColumns({"kind": F.lit("changed"), "finding": F.lit("other"), "symbol": F.lit("")})
    whole = chosen.join(rows.select("path").distinct(), "path", "left_anti")
    whole = whole.select("path", F.lit("file").alias("kind"), F.lit("file").alias("finding"), P.language(F.col("path")).alias("language"))
    joined = rows.unionByName(whole, allowMissingColumns=True)
    joined = results.first_of_each(joined, list(results.RESULT_KEY), ["path", "line"])
    joined = held(joined.withColumn("q_ix", F.lit(0)))
    if options.limit:
        limited = results.top_of_each(joined, ["q_ix"], ["path", "line"], options.limit + 1)
        limited = limited.withColumn("truncated", F.max("rank").over(Window.partitionBy("q_ix")) > options.limit).where(F.col("rank") <= options.limit)
    else:
        limited = results.numbered(joined, ["q_ix"], ["path", "line"], "path", chosen).withColumn("truncated", F.lit(False))
    return _shaped(_with_code(limited, files, options, focus="focus"), "q_ix", "rank", "truncated")


def respond(rows: DataFrame, queries: Sequence[str], options: Options, verb: str = "find", root: str = "") -> list[dict[str, object]]:
    """Responses, in the order of queries, from a verb's rows. The rows come to the driver: limit them. What the verb held is
    released."""
    options = options.normalised("scope" if verb in ("find", "inspect") else "line")
    by_query: dict[int, list[dict[str, object]]] = {}
    truncated: set[int] = set()
    for r in rows.orderBy("q_ix", "rank").collect():
        row = {c: r[c] for c in COLUMNS if r[c] not in (None, "", 0, [], False)}
        by_query.setdefault(r["q_ix"], []).append(row)
        if r["truncated"]:
            truncated.add(r["q_ix"])
    release()
    out, left = [], options.limit
    for k, query in enumerate(queries):
        got = by_query.get(k, [])
        response: dict[str, object] = {"root": root, "results": got, "results_truncated": k in truncated}
        if verb == "find":
            kinds = {x["kind"] for x in got}
            matched = "none" if not got else "file" if kinds == {"file"} else "symbol"
            searched = [options.match] if options.match != "auto" else ["symbol"] if matched == "symbol" else ["symbol", "path"]
            response |= {"query": query, "matched_as": matched, "searched_as": searched}
            if matched == "symbol":
                response["symbol"] = query
            if not got:
                response["hint"] = HINTS[options.match]
        else:
            response["location" if verb == "inspect" else "path"] = query
            if verb == "inspect":
                response["symbol"] = next((x.get("symbol", "") for x in got if x["kind"] == "scope"), "")
        out.append(response)
        if verb == "find" and options.limit:
            left -= len(got)
            if left <= 0:
                break  # nothing is left for the queries behind
    return out


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "q_ix int, rank int, truncated boolean, " + RESULT)
