"""Occurrences of names by tokens, for languages where a line's text alone does not tell them.

A name is a sequence of tokens. Where its tokens stand side by side on a line, in code or in what is searched besides, that is
an occurrence; so are, in code, tokens of the name with white space, comments or line ends between them. Both are found by one
automaton over the tokens (Knuth, Morris and Pratt), so occurrences may overlap, and each counts for the line on which it
begins. Numbers are tokens of their own, by the longest match: what looks like a name inside of one is none. Literals part names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import regex

from ..functions.text import IDENTIFIER_FORMS

#: Languages whose plain names are counted by tokens; those whose names of several tokens are.
BY_TOKEN = ("c", "cpp", "csharp", "java", "swift")
COMPOSITE = (*BY_TOKEN, "kotlin", "modula-2")

#: Preprocessing numbers; the numbers of C#, and those of Java with their suffixes.
_PP = r"\.?\d(?:[eEpP][+-]|'[0-9A-Za-z_]|[.\p{L}\p{Nd}_])*"
_PLAIN = r"0[xXbBoO][\da-fA-F_]+(?:\.[\da-fA-F_]+)?(?:[pP][+-]?[\d_]+)?|(?:\d[\d_]*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?"
NUMBERS = {
    "c": _PP,
    "cpp": _PP,
    "csharp": rf"(?:{_PLAIN})[fFdDmMuUlL]*",
    "java": r"0[xX][\da-fA-F_]*\.?[\da-fA-F_]*(?:[pP][+-]?[\d_]+)?[fFdDlL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[fFdDlL]?",
    "swift": _PLAIN,
    "kotlin": rf"(?:{_PLAIN})[fFuUL]*",
    "modula-2": r"\d[\dA-F]*[BCH]?(?:\.\d+(?:E[+-]?\d+)?)?",
}
_ESCAPED = r"|\\u+[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\N\{[^}\n]*\}"
PUNCTUATION = {
    "cpp": r"<=>|->\*|<<=|>>=|\.\.\.|::|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=",
    "swift": r"[-/=+!*%<>&|^~?]+",
}
#: Fixed list: words that name something in Swift only in backticks or behind a dot.
SWIFT_WORDS = frozenset(
    "associatedtype class deinit enum extension fileprivate func import init inout internal let open operator private protocol public static struct subscript typealias var break case continue default defer do else fallthrough for guard if in repeat return switch where while as catch false is nil super self throw throws true try".split()
)

Token = tuple[int, int, str]


@lru_cache(maxsize=32)
def _pattern(language: str) -> regex.Pattern[str]:
    start, more = IDENTIFIER_FORMS.get(language, IDENTIFIER_FORMS["default"])
    escaped = _ESCAPED if language in ("c", "cpp", "csharp", "java") else ""
    name = rf"(?:[{start}]{escaped})(?:[{more}]{escaped})*"
    ticked = r"`[^`\n]+`|" if language in ("swift", "kotlin") else ""
    other = PUNCTUATION.get(language)
    return regex.compile(rf"{ticked}{NUMBERS[language]}|{name}|{other + '|' if other else ''}[^\s]")


def tokens(language: str, text: str) -> Iterator[Token]:
    for m in _pattern(language).finditer(text):
        yield m.start(), m.end(), m[0]


@lru_cache(maxsize=1024)
def parts_of(language: str, symbol: str) -> tuple[str, ...]:
    """The tokens of a symbol; none if it is no name of the language."""
    parts = tuple(t for _, _, t in tokens(language, symbol))
    if not parts or "".join(parts) != symbol:
        return ()
    if language == "c" and (len(parts) > 1 or not regex.match(rf"[{IDENTIFIER_FORMS['c'][0]}\\]", symbol)):
        return ()
    return parts


@lru_cache(maxsize=1024)
def _failures(parts: tuple[str, ...]) -> tuple[int, ...]:
    """For each length of a beginning, that of the longest shorter beginning which it ends with."""
    out, k = [0], 0
    for x in parts[1:]:
        while k and parts[k] != x:
            k = out[k - 1]
        k += parts[k] == x
        out.append(k)
    return tuple(out)


def matches(stream: Sequence[Token], parts: tuple[str, ...]) -> Iterator[int]:
    """The place in stream of the first token of each occurrence of parts."""
    fail, k = _failures(parts), 0
    for i, (_, _, token) in enumerate(stream):
        while k and parts[k] != token:
            k = fail[k - 1]
        if parts[k] == token:
            k += 1
            if k == len(parts):
                yield i - k + 1
                k = fail[k - 1]


def _beside(stream: Sequence[Token], at: int, size: int) -> bool:
    return all(stream[k][1] == stream[k + 1][0] for k in range(at, at + size - 1))


def _swift_name(stream: Sequence[Token], at: int, word: str) -> bool:
    return word not in SWIFT_WORDS or (at > 0 and stream[at - 1][2] == ".")


def columns(language: str, line: str, symbol: str) -> list[int]:
    """Where, by character from 0, symbol stands on a line with nothing between its tokens."""
    parts = parts_of(language, symbol)
    if not parts or symbol not in line:
        return []
    stream = list(tokens(language, line))
    found = [i for i in matches(stream, parts) if _beside(stream, i, len(parts))]
    if language == "swift" and len(parts) == 1:
        found = [i for i in found if _swift_name(stream, i, symbol)] + [i for i, t in enumerate(stream) if t[2] == f"`{symbol}`"]
    return sorted(stream[i][0] + (stream[i][2][0] == "`" and symbol[0] != "`") for i in found)


def apart(language: str, code: str, symbol: str) -> list[int]:
    """Where symbol of several tokens begins in code with something between them."""
    parts = parts_of(language, symbol)
    if len(parts) < 2 or not all(p in code for p in parts):
        return []
    stream = list(tokens(language, code))
    return [stream[i][0] for i in matches(stream, parts) if not _beside(stream, i, len(parts))]


def counted(language: str, symbol: str) -> bool:
    """Whether this module counts the symbol in the language."""
    if language not in COMPOSITE:
        return False
    return language in BY_TOKEN or len(parts_of(language, symbol)) > 1
