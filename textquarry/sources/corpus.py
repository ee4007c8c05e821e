"""Corpora of files: directories, tables, revisions.

A corpus is a DataFrame of (path, content). Every verb is a plan over it; nothing is read before a plan runs.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P

MOST_FILES, MOST_FILE_BYTES, MOST_BYTES, MOST_DEPTH, MOST_PATH = 100_000, 64 << 20, 1 << 30, 128, 4096
#: Bytes of files that a task reads.
TASK_BYTES = 32 << 20
LINES = (
    "path string, lang string, reported string, total int, line_no int, raw string, search string, structural string, clean string, ignored boolean,"
    " defs array<struct<symbol:string,col:int>>, owner_start int, owner_end int, owner string, nav_start int, nav_end int, scope string, opener boolean,"
    " owners array<struct<col:int,stop:int,symbol:string,s:int,e:int>>, adjust array<struct<symbol:string,by:int>>,"
    " tokens array<struct<symbol:string,cols:array<int>>>"
)
FILES = (
    "path string, lang string, reported string, total int, defs array<struct<symbol:string,line:int,col:int,scope_start:int,scope_end:int,owned_end_col:int,owns_scope:boolean>>,"
    " scopes array<struct<s:int,e:int>>, import_start int, import_end int, regions array<struct<s:int,e:int,kind:string>>"
)


class Corpus:
    def __init__(self, files: DataFrame):
        self.files = files.select("path", F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content"))

    # -- sources

    @classmethod
    def from_table(cls, table: DataFrame, path: str = "path", content: str = "content") -> Corpus:
        return cls(table.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")))

    @classmethod
    def from_directory(cls, spark: SparkSession, root: str, check: bool = True) -> Corpus:
        """The regular files below root, hidden ones too, without links and without those in directories that scans leave out.
        Bytes that are no UTF-8 are replaced. Tasks read the files, so all executors have to see a local root. In stores that
        only Spark reads, names that begin with _ or . are left out, as by all its readers."""
        if "://" in root and not root.startswith("file://"):
            found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            tail = root.rstrip("/").split("://")[-1]
            path = F.substr("path", F.instr("path", F.lit(tail)) + len(tail))
            files = found.select(F.regexp_replace(path, "^/+", "").alias("path"), "length", "content").where(~P.excluded(F.col("path")))
            if check:
                check_budgets(files.where(P.is_source(F.col("path"))).select("path", "length"))
            return cls(files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content")))
        root = os.path.realpath(root.removeprefix("file://"))
        if not os.path.isdir(root):
            raise ValueError(f"{root!r} is not a directory")
        listed = regular_files(root)
        paths = spark.createDataFrame(listed, "path string, length bigint")
        if check:
            check_budgets(paths.where(P.is_source(F.col("path"))))
        tasks = max(1, min(len(listed), -(-sum(n for _, n in listed) // TASK_BYTES), spark.sparkContext.defaultParallelism * 16))
        read = paths.repartition(tasks).mapInArrow(contents(root), "path string, content binary")
        return cls(read.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content")))

    def stored(self, path: str) -> Corpus:
        """This corpus written as a table, and read from it: an immutable snapshot."""
        spark = self.files.sparkSession
        self.files.write.mode("overwrite").parquet(path)
        return Corpus(spark.read.schema(self.files.schema).parquet(path))

    # -- parts

    def sources(self, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
        """Files of registered languages that pass the path filters."""
        from ..languages import registry

        path = F.col("path")
        extra = [x for x in registry._EXTENSIONS if x not in P.LANGUAGES]
        known = P.is_source(path) | P.extension(path).isin(*extra) if extra else P.is_source(path)
        return self.files.where(known & P.path_filter(path, include, exclude))

    def paths(self, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
        return self.files.select("path").where(P.path_filter(F.col("path"), include, exclude))


def regular_files(root: str) -> list[tuple[str, int]]:
    """(path below root, bytes) of the regular files, in order; links, to files or directories, are not followed."""
    found = []
    for folder, directories, names in os.walk(root):
        directories[:] = sorted(d for d in directories if d not in P.EXCLUDED_DIRECTORIES and not os.path.islink(os.path.join(folder, d)))
        for name in sorted(names):
            full = os.path.join(folder, name)
            status = os.lstat(full)
            if stat.S_ISREG(status.st_mode):
                found.append((os.path.relpath(full, root).replace(os.sep, "/"), status.st_size))
    return found


def contents(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: (path, content) of paths below root, a file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                handle = os.open(os.path.join(root, path), os.O_RDONLY | os.O_NOFOLLOW)
                with open(handle, "rb") as file:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([file.read()], pa.binary())], ["path", "content"])

    return run


def check_budgets(files: DataFrame) -> None:
    """files (path, length) beyond a budget fail the query as a whole."""
    depth = F.size(F.split("path", "/"))
    sums = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.coalesce(F.max("length"), F.lit(0)).alias("largest"), F.coalesce(F.max(depth), F.lit(0)).alias("depth"), F.coalesce(F.max(F.octet_length("path")), F.lit(0)).alias("path")).first()
    for value, most, what in ((sums["n"], MOST_FILES, "files"), (sums["bytes"], MOST_BYTES, "bytes"), (sums["largest"], MOST_FILE_BYTES, "bytes in a file"), (sums["depth"], MOST_DEPTH, "levels of directories"), (sums["path"], MOST_PATH, "bytes in a path")):
        if value > most:
            raise ValueError(f"the corpus has {value} {what}; {most} are allowed")


def analysed_files(files: DataFrame) -> DataFrame:
    """FILES: each file's definitions, scopes and imports."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..languages.analysis import analyse

        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = analyse(path, content)
                imports = a.import_range() or (None, None)
                rows.append({"path": path, "lang": a.language.name, "reported": a.reported, "total": len(a.lines), "defs": a.definitions(), "scopes": [{"s": s, "e": e} for s, e in a.scopes], "import_start": imports[0], "import_end": imports[1], "regions": [{"s": s, "e": e, "kind": k} for s, e, k in a.regions]})
            yield from _batches(rows, FILES_ARROW)

    return files.select("path", "content").mapInArrow(run, FILES)


def analysed_lines(files: DataFrame, no_comments: bool = False, no_strings: bool = False, drop_comments: bool = False, drop_docstrings: bool = False, symbols: Sequence[str] = (), only: bool = False, wanted: str = "") -> DataFrame:
    """LINES: each line masked and cleaned as asked, with its definitions and the scopes that hits on it belong to, and the
    places of ``symbols`` where the language counts them by tokens. ``only``: only the lines that can have one of symbols.
    ``wanted``: a column of files with the numbers (array<int>) of the only lines to give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..languages import occurrences
        from ..languages.analysis import analyse

        for batch in batches:
            numbers = batch.column(2).to_pylist() if wanted else [None] * batch.num_rows
            for path, content, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), numbers, strict=True):
                a = analyse(path, content)
                n = len(a.lines)
                if not n:
                    continue
                # what lines show is made for those that are given
                given: Iterable[int] = range(1, n + 1) if asked is None else sorted(x for x in set(asked) if 1 <= x <= n)
                by_token = only and any(occurrences.counted(a.language.name, x) for x in symbols)
                if only and not by_token:
                    given = [k for k in given if k in a.spliced or any(x in a.lines[k - 1] for x in symbols)]
                    if not given:
                        continue
                search, structural = a.masked(no_comments or drop_comments, no_strings), a.masked(True, True)
                ignored, clean, names = a.ignored(no_comments or drop_comments, drop_docstrings), a.clean(drop_comments, drop_docstrings), a.line_names(max(given, default=0))
                rows, tokens = [], a.occurrences(symbols, search)
                for k in given:
                    if by_token and k not in a.spliced and k not in tokens and not any(x in a.lines[k - 1] for x in symbols):
                        continue
                    owner, nav, here = a.owner[k], a.navigation(k), a.owners_on(k)
                    rows.append(
                        {
                            "path": path, "lang": a.language.name, "reported": a.reported, "total": n, "line_no": k, "raw": a.lines[k - 1], "search": search[k - 1], "structural": structural[k - 1],
                            "clean": clean[k - 1], "ignored": ignored[k - 1], "defs": [{"symbol": d.symbol, "col": d.col} for d in a.by_line.get(k, []) if d.line == k],
                            "owner_start": owner.scope_start if owner else None, "owner_end": owner.scope_end if owner else None, "owner": owner.symbol if owner else None,
                            "nav_start": nav[0], "nav_end": nav[1], "scope": names[k - 1], "opener": bool(here),
                            "adjust": [{"symbol": w, "by": by} for w, by in a.spliced.get(k, ())],
                            "tokens": [{"symbol": w, "cols": cols} for w, cols in tokens.get(k, ())],
                            "owners": [{"col": c, "stop": e, "symbol": s, "s": x, "e": y} for c, e, s, x, y in sorted(here, key=lambda o: (o[0], -o[1]))] if a.language.position_scopes else [],
                        }
                    )
                    if len(rows) == 4096:
                        yield from _batches(rows, LINES_ARROW)
                        rows = []
                yield from _batches(rows, LINES_ARROW)

    return files.select("path", "content", *([wanted] if wanted else [])).mapInArrow(run, LINES)


def _batches(rows: list[dict[str, object]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


_I, _S, _B = pa.int32(), pa.string(), pa.bool_()
FILES_ARROW = pa.schema(
    [("path", _S), ("lang", _S), ("reported", _S), ("total", _I), ("defs", pa.list_(pa.struct([("symbol", _S), ("line", _I), ("col", _I), ("scope_start", _I), ("scope_end", _I), ("owned_end_col", _I), ("owns_scope", _B)]))), ("scopes", pa.list_(pa.struct([("s", _I), ("e", _I)]))), ("import_start", _I), ("import_end", _I), ("regions", pa.list_(pa.struct([("s", _I), ("e", _I), ("kind", _S)])))]
)
LINES_ARROW = pa.schema(
    [("path", _S), ("lang", _S), ("reported", _S), ("total", _I), ("line_no", _I), ("raw", _S), ("search", _S), ("structural", _S), ("clean", _S), ("ignored", _B), ("defs", pa.list_(pa.struct([("symbol", _S), ("col", _I)]))), ("owner_start", _I), ("owner_end", _I), ("owner", _S), ("nav_start", _I), ("nav_end", _I), ("scope", _S), ("opener", _B), ("owners", pa.list_(pa.struct([("col", _I), ("stop", _I), ("symbol", _S), ("s", _I), ("e", _I)]))), ("adjust", pa.list_(pa.struct([("symbol", _S), ("by", _I)]))), ("tokens", pa.list_(pa.struct([("symbol", _S), ("cols", pa.list_(_I))])))]
)
