"""One file's analysis: a row for each line with what search needs, and the file's definitions and imports.

``analyse`` never fails on any text. Each line carries the scopes that a hit on it belongs to, so that verbs need no join
of lines with scopes.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import asdict

from . import occurrences
from .indented import PythonStructure
from .modula import ModulaStructure, is_modula
from .registry import CONTROL, Language, language_of
from .scanner import Scan, Scanner, blanked
from .structure import Definition, Lines, Structure

_scanners: dict[tuple[str, bool], Scanner] = {}
BRACE_FUNCTION = re.compile(r"^(?:function|class)\s+([A-Za-z_][A-Za-z0-9_]*)\b", re.A)
BRACE_CALL = re.compile(r"^.*\b([A-Za-z_][A-Za-z0-9_]*)\s*\([^;]*\)\s*\{?\s*$", re.A)


def source_lines(content: str) -> list[str]:
    lines = [x.removesuffix("\r") for x in content.split("\n")]
    return lines[:-1] if lines[-1] == "" else lines


def by_character(text: str, scan: Scan) -> str:
    """text with a space for each character of comments, literals and markup, where a literal begins with 0, a value to the parser."""
    out, at = [], 0
    spans = [(a, -b, " ") for a, b in scan.comments] + [(a, -b, "0") for a, b in scan.strings] + [(a, -b, x) for a, b, x in scan.markup]
    for start, end, first in sorted(spans):
        start, end = max(start, at), -end
        if end > start:
            piece = re.sub(r"[^\r\n]+", lambda m: " " * len(m[0]), text[start:end])
            out += [text[at:start], first + piece[1:] if piece[0] == " " else piece]
            at = end
    return "".join(out) + text[at:]


_heads: dict[str, re.Pattern[str]] = {}


def lexical_heads(language: Language) -> re.Pattern[str]:
    """What a line that declares a name looks like: a declaring word in front of it, or a function's head up to its brace."""
    if language.name in _heads:
        return _heads[language.name]
    words = "|".join(re.escape(w) for w, kind in language.heads.items() if kind in ("func", "type", "ns", "enum", "alias"))
    name = r"`[^`]+`|(?:r#)?[^\W\d][\w$]*"
    led = rf"(?<![\w.$@])(?:{words})[ \t]*(?:\([^()]*\)|\*|!|<[^<>]*>)?[ \t]*(?<![\w])(?P<led>{name})"
    called = ""
    if language.c_functions and language.name not in ("javascript", "typescript"):
        called = rf"|^[ \t]*(?:[\w:<>,\[\]?]+[ \t*&]+)+(?P<called>[^\W\d]\w*)[ \t]*\([^;{{}}]*\)[^;{{}}()=]*\{{"
    _heads[language.name] = re.compile(led + called)
    return _heads[language.name]


def merged_regions(regions: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """regions in order, each line in one at most; what lacks something only is part of an error around it."""
    out: list[tuple[int, int, str]] = []
    for first, last, kind in sorted(regions, key=lambda r: (r[0], -r[1], r[2])):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last), min(out[-1][2], kind))
        else:
            out.append((first, last, kind))
    return out


class Analysis:
    def __init__(self, path: str, content: str):
        self.language, self.reported = language_of(path)
        self.lines = source_lines(content)
        self.text = "\n".join(self.lines)
        name, extension = self.language.name, path.rpartition(".")[2]
        elements = name == "javascript" or name == "typescript" and extension == "tsx"
        if (name, elements) not in _scanners:
            _scanners[name, elements] = Scanner(self.language.lexis, elements)
        self.scan = _scanners[name, elements].scan(self.text)
        self.code = by_character(self.text, self.scan)
        self.structure = self._structure(self.code)
        self.defs: list[Definition] = self.structure.defs if self.structure else self._brace_definitions()
        self.scopes: list[tuple[int, int]] = self.structure.scopes if self.structure else []
        self.imports: list[tuple[int, int]] = self.structure.imports if self.structure else []
        #: Where the text is damaged: (first line, last line, "error" or "missing").
        self.regions = merged_regions([*self.structure.regions, *self._unterminated()]) if self.structure else []
        if self.regions and self.language.style == "brace":
            self.defs = sorted([*self.defs, *self._admitted()], key=lambda d: (d.line, d.col, d.symbol))
        self._winners()

    def _unterminated(self) -> list[tuple[int, int, str]]:
        """Comments and literals that end with their line or the file, and not as they should."""
        if self.language.style != "brace":
            return []
        at, found = Lines(self.text), []
        for start, end in self.scan.comments:
            if self.text.startswith("/*", start) and (end - start < 4 or not self.text.endswith("*/", start, end)):
                found.append((at.line(start), at.line(end), "error"))
        for start, end in self.scan.strings if not self.scan.markup else []:
            if end == len(self.text) or self.text[end] == "\n":
                opening = re.match(r"[A-Za-z@$]*#*(\"+|'|`)", self.text[start : start + 40])
                if opening and (end - start <= len(opening[0]) or self.text[end - 1] not in "\"'`#{("):
                    found.append((at.line(start), at.line(max(start, end - 1)), "error"))
        return found

    def _admitted(self) -> list[Definition]:
        """Names that a line's text declares, where the line lies in a damaged region and the structure does not have them."""
        language, have = self.language, {(d.symbol, d.line) for d in self.defs}
        declares = lexical_heads(language)
        lines, at = self.code.split("\n"), Lines(self.text)
        found = []
        for first, last, _ in self.regions:
            for number in range(first, min(last, len(lines)) + 1):
                for m in declares.finditer(lines[number - 1]):
                    symbol = m[m.lastgroup or 0].strip("`")
                    if symbol not in CONTROL and symbol not in language.heads and symbol not in language.modifiers and (symbol, number) not in have:
                        have.add((symbol, number))
                        found.append(Definition(symbol, number, at.col(at.starts[number - 1] + m.start(m.lastgroup or 0)), number, number, 0, False))
        return found

    def _structure(self, code: str) -> Structure | PythonStructure | ModulaStructure | None:
        if self.language.style == "indent":
            return PythonStructure(self.text, code, self.scan)
        if self.language.style == "modula":
            return ModulaStructure(self.text, code, self.scan) if is_modula(code) else None
        if self.language.name == "java" and "\\u" in code:  # escapes stand for characters anywhere in Java
            code = re.sub(r"\\u+([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)) + " " * (len(m[0]) - 1), code)
        return Structure(self.language, self.text, code, self.scan) if self.language.name else None

    def _brace_definitions(self) -> list[Definition]:
        if self.language.style == "modula":
            return []
        found = []
        for number, line in enumerate(self.lines, 1):
            if (m := BRACE_FUNCTION.match(line.strip()) or BRACE_CALL.match(line.strip())) is not None:
                col = len(line[: line.find(m[1])].encode("utf-8", "surrogatepass")) + 1
                found.append(Definition(m[1], number, col, number, number, 0, True))
        return found

    # -- masked lines

    def masked(self, comments: bool, strings: bool, docstrings: bool = False) -> list[str]:
        """Lines with spans blanked."""
        spans = (self.scan.comments if comments else []) + (self.scan.strings if strings else []) + (self.scan.docstrings if docstrings else [])
        return blanked(self.text, sorted(spans)).split("\n") if self.lines else []

    def clean(self, comments: bool, docstrings: bool) -> list[str]:
        """Lines without comments or docstrings, trimmed at the right where something went."""
        if not (comments or docstrings):
            return self.lines
        return [b.rstrip() if a != b else a for a, b in zip(self.lines, self.masked(comments, False, docstrings), strict=True)]

    def ignored(self, comments: bool, docstrings: bool) -> list[bool]:
        """Lines that hold nothing but what is masked."""
        masked = self.masked(comments, False, docstrings)
        return [bool(a.strip()) and not b.strip() for a, b in zip(self.lines, masked, strict=True)]

    # -- scopes

    def _winners(self) -> None:
        """For each line the smallest definition around it and the smallest scope."""
        n = len(self.lines)
        tie = -1 if self.language.position_scopes or self.language.later_start else 1
        self.owner: list[Definition | None] = [None] * (n + 2)
        owners = [d for d in self.defs if d.owns_scope]
        self._paint(self.owner, [(d.scope_end - d.scope_start, tie * d.scope_start, k, d.scope_start, d.scope_end, d) for k, d in enumerate(owners)])
        self.around: list[tuple[int, int] | None] = [None] * (n + 2)
        tie = -1 if self.language.later_start else 1
        spans = set(self.scopes) | {(d.scope_start, d.scope_end) for d in owners if d.scope_end > d.scope_start}
        self._paint(self.around, [(e - s, tie * s, 0, s, e, (s, e)) for s, e in spans])

    @staticmethod
    def _paint(rows: list, spans: list) -> None:
        """Each line gets the first span in order that covers it; painted lines are skipped in near constant time."""
        last = len(rows) - 2
        free = list(range(len(rows) + 1))

        def next_free(k: int) -> int:
            root = k
            while free[root] != root:
                root = free[root]
            while free[k] != root:
                free[k], k = root, free[k]
            return root

        for *_, start, end, value in sorted(spans, key=lambda x: x[:3]):
            k = next_free(max(1, start))
            while k <= min(end, last):
                rows[k] = value
                free[k] = k + 1
                k = next_free(k)

    def enclosing(self, line: int) -> tuple[int, int]:
        if not self.structure and self.language.style == "brace":
            return self.brace_scope(line)
        return self.around[line] or (line, line)

    def navigation(self, line: int) -> tuple[int, int]:
        """The scope of the smallest definition around a line, else the smallest scope."""
        owner = self.owner[line]
        return (owner.scope_start, owner.scope_end) if owner else self.enclosing(line)

    def brace_scope(self, line: int) -> tuple[int, int]:
        """The smallest brace block around a line, from the lines of its signature on."""
        if not hasattr(self, "_braced"):
            blocks, stack = [], []
            for number, text in enumerate(self.masked(True, True), 1):
                for c in text:
                    if c == "{":
                        stack.append(number)
                    elif c == "}" and stack:
                        start = self._signature(stack.pop())
                        blocks.append((number - start, len(blocks), 0, start, number, (start, number)))
            self._braced: list[tuple[int, int] | None] = [None] * (len(self.lines) + 2)
            self._paint(self._braced, blocks)
        return self._braced[line] or (line, line)

    def _signature(self, line: int) -> int:
        while line > 1 and (above := self.lines[line - 2].strip()) and (above.startswith(("//", "/*", "*", "#")) or not re.search(r"[;{}]\s*$", above)):
            line -= 1
        return line

    def scope_name(self, line: int) -> str:
        """The name of the smallest owner around a line, rather one declared above; else the nearest declared in its scope."""
        if not hasattr(self, "_names"):
            owners = [d for d in self.defs if d.owns_scope]
            self._names: list[list[str | None]] = [[None] * (len(self.lines) + 2) for _ in range(2)]
            size = lambda d: d.scope_end - d.scope_start
            self._paint(self._names[0], [(size(d), -d.line, k, max(d.line, d.scope_start), d.scope_end, d.symbol) for k, d in enumerate(owners)])
            self._paint(self._names[1], [(size(d), d.line, k, d.scope_start, min(d.line - 1, d.scope_end), d.symbol) for k, d in enumerate(owners)])
            self._at: dict[int, str] = {}
            for d in owners:
                self._at.setdefault(d.line, d.symbol)
        best, at = self._names[0][line] or self._names[1][line], self._at
        if best:
            return best
        start, end = self.enclosing(line)
        for k in range(min(line, end), start - 1, -1):
            if k in at:
                return at[k]
        comment = ("//", "/*", "*", "#")
        ahead = len(self.lines) if start == end == line and self.lines[line - 1].strip().startswith(comment) else end
        for k in range(line + 1, min(ahead, len(self.lines)) + 1):
            text = self.lines[k - 1].strip()
            if text and not text.startswith(comment):
                return at.get(k, "")
        return ""

    def line_names(self, upto: int | None = None) -> list[str]:
        """scope_name of all lines, or of the first ones: one look for each run of lines with the same owner."""
        declared = {d.line for d in self.defs if d.owns_scope}
        bounds = {x for d in self.defs if d.owns_scope for x in (d.scope_start, d.scope_end + 1, d.line)}
        names, last = [], None
        for number in range(1, (len(self.lines) if upto is None else upto) + 1):
            if last is None or number in bounds or number in declared or not last:
                last = self.scope_name(number)
            names.append(last)
        return names

    def owners_on(self, line: int) -> list[tuple[int, int, str, int, int]]:
        """(column, end column, symbol, start, end) of the definitions that a line declares or closes, for hits between them.
        A start column of 1 stands for one that is declared above, a large end column for one that goes on below."""
        here = [d for d in self.by_line.get(line, []) if d.owns_scope]
        return [(d.col if d.line == line else 1, d.owned_end_col if d.scope_end == line and d.owned_end_col else 1 << 30, d.symbol, d.scope_start, d.scope_end) for d in here]

    @property
    def spliced(self) -> dict[int, list[tuple[str, int]]]:
        """By line, what identifiers that a backslash at a line's end cuts add to and take from counts: the whole is on the
        line where it begins, its pieces are nowhere."""
        if not hasattr(self, "_spliced"):
            self._spliced: dict[int, list[tuple[str, int]]] = {}
            if self.language.name in ("c", "cpp") and "\\\n" in self.text:
                at = Lines(self.text)
                for m in re.finditer(r"(?<!\w)[^\W\d]\w*(?:\\\n\w+)+", self.code):
                    pieces = m[0].split("\\\n")
                    first = at.line(m.start())
                    self._spliced.setdefault(first, []).append(("".join(pieces), 1))
                    for k, piece in enumerate(pieces):
                        self._spliced.setdefault(first + k, []).append((piece, -1))
        return self._spliced

    def occurrences(self, symbols: Sequence[str], search: list[str]) -> dict[int, list[tuple[str, list[int]]]]:
        """By line, the byte columns of symbols that this language counts by tokens, in the lines searched."""
        found: dict[int, list[tuple[str, list[int]]]] = {}
        symbols = [x for x in symbols if occurrences.counted(self.language.name, x)]
        if not symbols:
            return found
        at = Lines(self.text)
        for symbol in symbols:
            here: dict[int, list[int]] = {}
            for number, line in enumerate(search, 1):
                for k in occurrences.columns(self.language.name, line, symbol):
                    here.setdefault(number, []).append(len(line[:k].encode("utf-8", "surrogatepass")) + 1)
            for k in occurrences.apart(self.language.name, self.code, symbol):
                here.setdefault(at.line(k), []).append(at.col(k))
            for number, places in here.items():
                found.setdefault(number, []).append((symbol, sorted(places)))
        return found

    @property
    def by_line(self) -> dict[int, list[Definition]]:
        if not hasattr(self, "_by_line"):
            self._by_line: dict[int, list[Definition]] = {}
            for d in self.defs:
                for k in {d.line, d.scope_end} if d.owns_scope and d.owned_end_col else {d.line}:
                    self._by_line.setdefault(k, []).append(d)
        return self._by_line

    def definitions(self) -> list[dict[str, object]]:
        return [asdict(d) for d in self.defs]

    def import_range(self) -> tuple[int, int] | None:
        return (min(s for s, _ in self.imports), max(e for _, e in self.imports)) if self.imports else None


def analyse(path: str, content: str) -> Analysis:
    return Analysis(path, content)

