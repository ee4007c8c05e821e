"""Text functions as Column expressions: lines, identifiers, comments, snippets, bounded prefixes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of identifiers: letters, numbers of letter and decimal kind, marks, connectors, and Unicode's Other_ID_* ones.
IDENTIFIER = r"\p{L}\p{Nl}\p{Nd}\p{Mn}\p{Mc}\p{Pc}··፩-፱ᢅᢆ᧚℘℮゛゜"
#: JavaScript and TypeScript also take private names and escapes as part of an identifier.
IDENTIFIER_CLASSES = {"javascript": IDENTIFIER + r"#\\", "default": IDENTIFIER}
#: Fixed list: words that never name the symbol of a line.
KEYWORDS = (
    "and auto bool break case class const continue def defer else enum false for func function if impl import int let match nil none null package "
    "private protected pub public return self static struct switch this true type uint use var void while"
).split()


#: What an identifier of a language begins with and goes on with. Others, Swift too, have the default's.
STARTS = r"_\p{L}\p{Nl}ᢅᢆ℘℮゛゜"
IDENTIFIER_FORMS = {
    "default": (STARTS, IDENTIFIER),
    "go": (r"_\p{L}", r"_\p{L}\p{Nd}"),
    "c": (STARTS + "$", IDENTIFIER + "$"),
    "cpp": (STARTS + "$", IDENTIFIER + "$"),
    "javascript": (STARTS + "$", IDENTIFIER + "$\u200c\u200d"),
    "typescript": (STARTS + "$", IDENTIFIER + "$\u200c\u200d"),
    "java": (r"$\p{L}\p{Nl}\p{Sc}\p{Pc}", r"$\p{L}\p{Nl}\p{Sc}\p{Pc}\p{Nd}\p{Mn}\p{Mc}\p{Cf}\x00-\x08\x0e-\x1b\x7f-\x9f"),
    "csharp": (r"_\p{L}\p{Nl}", r"_\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}\p{Cf}"),
    "kotlin": (r"_\p{L}\p{Nl}", r"_\p{L}\p{Nl}\p{Nd}\p{Mn}\p{Mc}\p{Pc}"),
    "modula": ("_A-Za-z", "_A-Za-z0-9"),
}
#: Fixed list: words that name nothing in Rust, and those that r# doesn't make names either.
RUST_RESERVED = (
    "_ abstract as async await become box break const continue crate do dyn else enum extern false final fn for gen if impl in let loop macro match mod move "
    "mut override priv pub ref return self Self static struct super trait true try type typeof unsafe unsized use virtual where while yield"
).split()
RUST_NEVER = ("_", "crate", "self", "super", "Self")
#: Universal character names of C and C++ that name a character: no surrogates, nothing above U+10FFFF.
SHORT_NAME = r"\\u(?![dD][89a-fA-F])[0-9A-Fa-f]{4}"
LONG_NAME = r"\\U00(?!00[dD][89a-fA-F])(?:0[0-9A-Fa-f]|10)[0-9A-Fa-f]{4}"


def universal_names(text: Column) -> Column:
    """text with the universal character names of C and C++ as the characters they name."""

    def character(digits: Column) -> Column:
        return F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")

    def part(p: Column) -> Column:
        short = F.concat(character(F.substr(p, F.lit(3), F.lit(4))), F.substr(p, F.lit(7)))
        long = F.concat(character(F.substr(p, F.lit(3), F.lit(8))), F.substr(p, F.lit(11)))
        return F.when(p.rlike("^" + SHORT_NAME), short).when(p.rlike("^" + LONG_NAME), long).otherwise(p)

    parts = F.split(text, f"(?={SHORT_NAME}|{LONG_NAME})", -1)
    return F.when(text.contains("\\"), F.array_join(F.transform(parts, part), "")).otherwise(text)


def is_identifier(text: Column, language: str = "default") -> Column:
    """Whether the whole text is one identifier of the language, and in Rust no reserved word. Null for null."""
    start, more = IDENTIFIER_FORMS.get(language, IDENTIFIER_FORMS["default"])
    whole = lambda c: c.rlike(rf"\A[{start}][{more}]*\z")
    if language in ("c", "cpp"):
        return whole(universal_names(text))
    if language == "csharp":
        return whole(F.regexp_replace(text, r"\A@", ""))
    if language == "rust":
        name = F.regexp_replace(text, r"\Ar#", "")
        return whole(name) & F.when(text.startswith("r#"), ~name.isin(*RUST_NEVER)).otherwise(~text.isin(*RUST_RESERVED))
    return whole(text)


def quoted(literal: str) -> str:
    """literal as a Java regex."""
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def source_lines(content: Column) -> Column:
    """The lines of a file: without terminators, one carriage return before each dropped, none after a last newline."""
    text = F.coalesce(content, F.lit(""))
    cut = F.when(text.endswith("\r\n"), 2).when(text.endswith("\n") | text.endswith("\r"), 1).otherwise(0)
    body = F.substr(text, F.lit(1), F.length(text) - cut)
    # a single character parts without the regex engine
    parts = F.when(body.contains("\r"), F.split(body, "\r?\n", -1)).otherwise(F.split(body, "\n", -1))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(parts)


def occurrence_pattern(symbol: str, identifier: str = IDENTIFIER) -> str:
    """Matches, with no width, each place where symbol begins with no identifier character beside it; places may overlap."""
    return f"(?<![{identifier}])(?={quoted(symbol)}(?![{identifier}]))"


def occurrence_count(line: Column, symbol: str, identifier: str = IDENTIFIER) -> Column:
    # contains() is a plain byte search that spares most lines the regex
    return F.when(line.contains(symbol), F.regexp_count(line, F.lit(occurrence_pattern(symbol, identifier)))).otherwise(F.lit(0))


def occurrence_columns(line: Column, symbol: str, identifier: str = IDENTIFIER) -> Column:
    """1-based byte columns of the occurrences, in one pass over the line: it is cut in front of each."""
    parts = F.split(line, occurrence_pattern(symbol, identifier), -1)
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(state: Column, part: Column) -> Column:
        after = state["at"] + F.octet_length(part)
        return F.struct(after.alias("at"), F.concat(state["found"], F.array(after)).alias("found"))

    ends = F.aggregate(parts, start, step, lambda state: state["found"])
    inner = F.slice(ends, 1, F.size(ends) - 1)  # the last part's end is the line's
    at_start = F.regexp_count(F.substring(line, 1, len(symbol) + 1), F.lit(f"^{occurrence_pattern(symbol, identifier)}")) > 0
    columns = F.when(at_start, F.array_union(F.array(F.lit(1)), inner)).otherwise(inner)
    return F.when(line.contains(symbol), columns).otherwise(F.array().cast("array<int>"))


def identifiers(text: Column) -> Column:
    """ASCII identifiers of three characters or more, as symbol indexes take them."""
    return F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]{2,}(?![A-Za-z0-9_])"), F.lit(0))


def is_keyword(word: Column) -> Column:
    return word.isin(*KEYWORDS)


def tokens(text: Column, pattern: str) -> Column:
    """text cut into matches of pattern and single other characters; joined again they give text."""
    return F.regexp_extract_all(text, F.lit(f"(?:{pattern})|(?s:.)"), F.lit(0))


#: Possessive quantifiers keep the matcher's stack flat on long literals.
DOUBLE, SINGLE, BACK = r'"(?:\\.|[^"\\\n])*+"?', r"'(?:\\.|[^'\\\n])*+'?", r"`[^`]*+`?"
SLASH_COMMENT, BLOCK_COMMENT = r"//[^\n]*+", r"/\*(?s:.*?)(?:\*/|\z)"


def rtrimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t\r\x0b\x0c]+$", "")


def without_slash_comment(line: Column) -> Column:
    """A line without its // comment; // in quotes stays."""
    kept = F.filter(tokens(line, f"{DOUBLE}|{SINGLE}|{BACK}|{SLASH_COMMENT}"), lambda t: ~t.startswith("//"))
    return rtrimmed(F.when(line.contains("//"), F.array_join(kept, "")).otherwise(line))


def without_hash_comment(line: Column) -> Column:
    """A line without its # comment; # in quotes stays."""
    kept = F.filter(tokens(line, f"{DOUBLE}|{SINGLE}|#[^\\n]*+"), lambda t: ~t.startswith("#"))
    return rtrimmed(F.when(line.contains("#"), F.array_join(kept, "")).otherwise(line))


def without_c_comments(text: Column) -> Column:
    """Source without // and block comments: a block becomes a space and keeps its newlines."""
    kept = F.transform(
        tokens(text, f"{DOUBLE}|{SINGLE}|{BACK}|{SLASH_COMMENT}|{BLOCK_COMMENT}"),
        lambda t: F.when(t.startswith("//"), F.lit("")).when(t.startswith("/*"), F.concat(F.lit(" "), F.regexp_replace(t, "[^\n]", ""))).otherwise(t),
    )
    return F.array_join(kept, "")


def blanked(token: Column) -> Column:
    """As many spaces as token has bytes, with its line ends."""
    return F.array_join(F.transform(F.split(token, ""), lambda c: F.when(c.isin("\n", "\r"), c).otherwise(F.repeat(F.lit(" "), F.octet_length(c)))), "")


def with_blank_strings(text: Column) -> Column:
    """Source with quoted literals blanked, widths and lines kept."""
    return F.array_join(F.transform(tokens(text, f"{DOUBLE}|{SINGLE}|{BACK}"), lambda t: F.when((F.length(t) > 1) & t.rlike("^[\"'`]"), blanked(t)).otherwise(t)), "")


def without_blank_lines(text: Column) -> Column:
    """Lines trimmed at the right, blank ones gone."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def context_start(line: Column, context: Column | int) -> Column:
    return F.greatest(F.lit(1), line - context)


def context_end(line: Column, context: Column | int, total: Column) -> Column:
    return F.least(total, line + context)


def snippet_start(start: Column, end: Column, focus: Column, most: int) -> Column:
    """First line of the window of ``most`` lines around focus, if the range is longer; else the range's."""
    inside = F.when((focus < start) | (focus > end), start).otherwise(focus)
    first = F.greatest(inside - most // 2, start)
    moved = F.when(first + most - 1 > end, end - most + 1).otherwise(first)
    return F.when((F.lit(most) > 0) & (end - start + 1 > most), moved).otherwise(start)


def snippet_end(start: Column, end: Column, focus: Column, most: int) -> Column:
    return F.when((F.lit(most) > 0) & (end - start + 1 > most), snippet_start(start, end, focus, most) + most - 1).otherwise(end)


def joined(lines: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(lines, start, end - start + 1), "\n")


def bounded_prefix(text: Column, max_lines: int, max_bytes: int) -> tuple[Column, Column]:
    """(prefix, truncated): text without newlines at its end, at most so many lines, then so many bytes (whole characters)."""
    whole = F.regexp_replace(text, "\n+$", "")
    lines = F.split(whole, "\n", -1)
    some = F.when(F.lit(max_lines > 0) & (F.size(lines) > max_lines), F.array_join(F.slice(lines, 1, max_lines), "\n")).otherwise(whole)
    if max_bytes <= 0:
        return some, some != whole
    fits = lambda n: F.octet_length(F.substr(some, F.lit(1), n)) <= max_bytes
    short = F.when(F.octet_length(some) <= max_bytes, some).otherwise(F.substr(some, F.lit(1), largest(fits, F.least(F.length(some), F.lit(max_bytes)), max_bytes)))
    return short, short != whole


def largest(fits: Callable[[Column], Column], most: Column, bound: int) -> Column:
    """The largest number from 0 to most, which is bound at most, for which fits holds, found by halves; 0 if for none."""
    start = F.struct(F.lit(0).alias("lo"), most.cast("int").alias("hi"))

    def step(state: Column, _: Column) -> Column:
        middle = ((state["lo"] + state["hi"] + 1) / 2).cast("int")
        ok = fits(middle)
        return F.struct(F.when(ok, middle).otherwise(state["lo"]).alias("lo"), F.when(ok, state["hi"]).otherwise(F.greatest(middle - 1, state["lo"])).alias("hi"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(bound.bit_length())), start, step, lambda state: state["lo"])


def bounded_json(text: Column, max_bytes: int) -> Column:
    """text, or its longest prefix with an ellipsis, such that its JSON string has at most max_bytes bytes."""
    size = lambda c: F.octet_length(F.to_json(F.struct(c.alias("v")))) - 6  # noqa: E731  {"v":...}
    fits = lambda n: size(F.concat(F.substr(text, F.lit(1), n), F.lit("…"))) <= max_bytes
    length = largest(fits, F.least(F.length(text), F.lit(max_bytes)), max_bytes)
    return F.when(size(text) <= max_bytes, text).otherwise(F.concat(F.substr(text, F.lit(1), length), F.lit("…")))


def fence(code: Column) -> Column:
    """Backticks for a Markdown fence around code: three, or one more than its longest run."""
    runs = F.transform(F.regexp_extract_all(code, F.lit("`+"), F.lit(0)), lambda r: F.length(r))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def last_line_number(offset: Column, text: Column) -> Column:
    """The 1-based line of a 0-based character offset."""
    return F.length(F.regexp_replace(F.substr(text, F.lit(1), offset), "[^\n]", "")) + 1
