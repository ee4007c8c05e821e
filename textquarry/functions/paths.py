"""Path functions: glob filters, match ranks, languages by extension, safe relative paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import quoted

#: Extensions by language. Those of the second group are languages of their own name.
EXTENSIONS = {
    "go": "go", "python": "py", "rust": "rs", "java": "java", "c": "c h",
    "cpp": "C CC CPP CXX cc cpp cxx c++ ii H HH HPP HXX hpp hh hxx h++ ipp tpp tcc inl ixx cppm mpp ccm cxxm txx",
    "csharp": "cs csx", "kotlin": "kt kts", "swift": "swift", "modula-2": "mod def",
    "javascript": "js", "typescript": "ts", "tsx": "tsx",
}
OWN_NAMES = ("mjs", "cjs", "jsx", "mts", "cts")
LANGUAGES = {ext: lang for lang, all_ in EXTENSIONS.items() for ext in all_.split()} | {x: x for x in OWN_NAMES}
EXCLUDED_DIRECTORIES = (".cache", ".git", ".hg", ".svn", ".venv", "build", "dist", "node_modules", "target", "vendor")


def base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """With no dot; empty if the last component has none."""
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def language(path: Column) -> Column:
    """The language of a path's extension; else the extension itself."""
    ext = extension(path)
    names = F.create_map(*[F.lit(x) for pair in sorted(LANGUAGES.items()) for x in pair])
    return F.coalesce(F.try_element_at(names, ext), ext)


def is_source(path: Column) -> Column:
    return extension(path).isin(*sorted(LANGUAGES))


def excluded(path: Column) -> Column:
    """Whether a directory of the path is one that scans leave out."""
    parents = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.arrays_overlap(parents, F.array(*[F.lit(x) for x in EXCLUDED_DIRECTORIES]))


def glob_regex(pattern: str) -> str | None:
    """An anchored Java regex for a shell pattern whose wild cards stop at slashes; None if the pattern is malformed."""
    out, k, n = [], 0, len(pattern)
    while k < n:
        c = pattern[k]
        k += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if k == n:
                return None
            out.append(quoted(pattern[k]))
            k += 1
        elif c == "[":
            negated = k < n and pattern[k] == "^"
            k += negated
            parts = []
            while True:
                if k >= n:
                    return None
                if pattern[k] == "]" and parts:
                    k += 1
                    break
                ends = []
                for _ in range(2):
                    if k >= n or pattern[k] in "]-" and not ends or pattern[k] == "]":
                        return None
                    if pattern[k] == "\\":
                        k += 1
                        if k >= n:
                            return None
                    ends.append(pattern[k])
                    k += 1
                    if k < n and pattern[k] == "-" and len(ends) == 1:
                        k += 1
                    else:
                        break
                if k >= n:
                    return None
                low, high = ends[0], ends[-1]
                if low <= high:
                    parts.append(f"\\x{{{ord(low):x}}}-\\x{{{ord(high):x}}}")
                else:
                    parts.append("")
            inside = "".join(parts)
            out.append(f"(?!/)[^{inside}]" if negated and inside else "[^/]" if negated else f"(?!/)[{inside}]" if inside else "(?!)")
        else:
            out.append(quoted(c))
    return "^(?s:" + "".join(out) + ")$"


def glob_match(path: Column, pattern: str) -> Column:
    """The directory of ``dir/**``; the pattern against the path, or the last component if it has no slash; or a substring."""
    if not pattern:
        return F.lit(False)
    matches = []
    if pattern.endswith("/**"):
        prefix = pattern[:-3]
        matches += [path == prefix, path.startswith(prefix + "/")]
    pattern = pattern.removeprefix("**/")
    if (regex := glob_regex(pattern)) is not None:
        if "/" not in pattern:
            matches.append(base(path).rlike(regex))
        matches.append(path.rlike(regex))
    matches.append(path.contains(pattern))
    found = matches[0]
    for m in matches[1:]:
        found = found | m
    return found


def path_filter(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Whether no exclude pattern matches and, if there are any, an include pattern does."""
    keep = F.lit(True)
    for pattern in exclude:
        keep = keep & ~glob_match(path, pattern)
    if include:
        wanted = F.lit(False)
        for pattern in include:
            wanted = wanted | glob_match(path, pattern)
        keep = keep & wanted
    return keep


def match_rank(path: Column, query: str) -> Column:
    """0 the path, 1 its last component, 2 another, 3 and 4 start and part of the last, 5 part of the path; else null."""
    while query.startswith("./"):
        query = query[2:]
    last = base(path)
    return (
        F.when(path == query, 0)
        .when(last == query, 1)
        .when(F.array_contains(F.split(path, "/"), query), 2)
        .when(last.startswith(query), 3)
        .when(last.contains(query), 4)
        .when(path.contains(query), 5)
    )


def safe_relative(path: str) -> str:
    """path in normal form; ValueError if it is empty, absolute, leaves the root or holds a NUL."""
    import posixpath

    if not path or "\0" in path or path.startswith("/"):
        raise ValueError(f"repository path {path!r} must be relative")
    clean = posixpath.normpath(path.replace("\\", "/"))
    if clean == ".." or clean.startswith("../"):
        raise ValueError(f"repository path {path!r} is outside the repository")
    return clean


def parse_location(location: str) -> tuple[str, int]:
    """PATH:LINE at the last colon."""
    path, colon, line = location.rpartition(":")
    if not colon or not path:
        raise ValueError(f"location {location!r} must be PATH:LINE")
    try:
        return path, int(line)
    except ValueError:
        raise ValueError(f"location {location!r} has no line number") from None
