"""Definitions, scopes and imports of Modula-2 sources, from words matched with their END."""

from __future__ import annotations

import re

from .scanner import Scan
from .structure import Definition, Lines

TOKEN = re.compile(r"[A-Za-z_]\w*|\d\w*|:=|\.\.|[^\s\w]")
UNIT = re.compile(r"\s*(?:(?:UNSAFEGUARDED|GENERIC)\s+)?(?:(?:IMPLEMENTATION|DEFINITION|REFINING)\s+)?MODULE\s+[A-Za-z_]")
OPENS = {"MODULE", "PROCEDURE", "RECORD", "CASE", "IF", "WHILE", "FOR", "LOOP", "WITH", "CLASS"}
SECTIONS = {"TYPE", "CONST", "VAR", "BEGIN", "PROCEDURE", "MODULE", "IMPORT", "FROM", "EXPORT", "END", "CLASS", "FINALLY", "EXCEPT"}


def is_modula(code: str) -> bool:
    """Whether a text is a compilation unit; other files with the same extensions, such as go.mod, are not."""
    return bool(UNIT.match(code))


class ModulaStructure:
    def __init__(self, text: str, code: str, scan: Scan):
        self.at = Lines(text)
        self.defs: list[Definition] = []
        self.scopes: list[tuple[int, int]] = []
        self.imports: list[tuple[int, int]] = []
        self.regions: list[tuple[int, int, str]] = []
        if not is_modula(code):
            return
        found = list(TOKEN.finditer(code))
        self.t, self.o = [m[0] for m in found], [m.start() for m in found]
        definition = "DEFINITION" in self.t[:3]
        self._walk(definition)
        self.defs = sorted(dict.fromkeys(self.defs), key=lambda d: (d.line, d.col, d.symbol))
        self.scopes, self.imports = sorted(set(self.scopes)), sorted(set(self.imports))

    def _line(self, k: int) -> int:
        return self.at.line(self.o[k])

    def _add(self, name: int, first: int, last: int, owns: bool) -> None:
        line = self._line(name)
        end = self.at.col(self.o[last] + len(self.t[last]))
        self.defs.append(Definition(self.t[name], line, self.at.col(self.o[name]), self._line(first) if owns else line, self._line(last) if owns else line, end if owns else 0, owns))
        if owns:
            self.scopes.append((self._line(first), self._line(last)))

    def _walk(self, definition: bool) -> None:
        t, n = self.t, len(self.t)
        stack: list[tuple[str, int, int]] = []  # word, its token, name token
        section, k = "", 0
        while k < n:
            x = t[k]
            if x in ("IMPORT", "FROM") and (k == 0 or t[k - 1] == ";"):
                end = k
                while end < n and t[end] != ";":
                    end += 1
                self.imports.append((self._line(k), self._line(min(end, n - 1))))
                k = end + 1
                continue
            if x == "REPEAT":
                stack.append((x, k, -1))
            elif x == "UNTIL":
                if stack and stack[-1][0] == "REPEAT":
                    self.scopes.append((self._line(stack.pop()[1]), self._line(k)))
            elif x in ("MODULE", "PROCEDURE", "CLASS") and k + 1 < n and re.match(r"[A-Za-z_]", t[k + 1]) and (k == 0 or t[k - 1] not in ("=", ":", "OF", "TO", "END")):
                name = k + 1
                end = name
                while end < n and t[end] != ";":
                    end = self._past_parenthesis(end)
                forward = end + 1 < n and t[end + 1] == "FORWARD"
                if x == "PROCEDURE" and (forward or definition):
                    self._add(name, k, min(end, n - 1), False)
                    k = end
                else:
                    stack.append((x, k, name))
                    if x == "PROCEDURE":
                        k = end
                section = ""
            elif x in ("TYPE", "CONST", "VAR") and x not in ("",):
                section = x
            elif x == "BEGIN":
                section = ""
            elif x == "END":
                closed = ""
                if stack:
                    word, first, name = stack.pop()
                    closed = word
                    last = k + 1 if name >= 0 and k + 1 < n and t[k + 1] == t[name] else k
                    if name >= 0:
                        self._add(name, first if word != "RECORD" else name, last, True)
                    else:
                        self.scopes.append((self._line(first), self._line(last)))
                    k = last
                    if word in ("PROCEDURE", "MODULE"):
                        section = ""
            elif x in ("RECORD", "CASE", "IF", "WHILE", "FOR", "LOOP", "WITH"):
                name = -1
                if x == "RECORD" and section == "TYPE" and k >= 2 and t[k - 1] == "=":
                    name = k - 2
                stack.append((x, k, name))
                if x == "RECORD":
                    section = "RECORD" if section != "RECORD" else section
                elif x == "CASE" and section == "RECORD":  # variants: a tag, and fields behind the labels of each
                    if k + 2 < n and t[k + 2] == ":":
                        self._add(k + 1, k + 1, k + 1, False)
                    while k < n and t[k] not in ("OF", "END", ";"):
                        k += 1
                    k = self._past_labels(k)
                    continue
            elif x == "|" and section == "RECORD":
                k = self._past_labels(k)
                continue
            elif section and re.match(r"[A-Za-z_]", x) and x not in SECTIONS and (t[k - 1] in (";", ",", "TYPE", "CONST", "VAR", "RECORD", ":", "ELSE") or t[k - 1] == "END"):
                k = self._section(k, section)
                continue
            if x == "END" and section == "RECORD" and closed == "RECORD":
                section = "TYPE"
            k += 1
        for word, first, name in stack:
            if name >= 0 and word != "RECORD":
                self._add(name, first, n - 1, True)

    def _past_labels(self, k: int) -> int:
        """The token behind the labels of a variant, which begin behind token k."""
        k += 1
        while k < len(self.t) and self.t[k] not in (":", ";", "END", "|", "ELSE"):
            k += 1
        return k + 1 if k < len(self.t) and self.t[k] == ":" else k

    def _past_parenthesis(self, k: int) -> int:
        if self.t[k] != "(":
            return k + 1
        depth = 0
        while k < len(self.t):
            depth += (self.t[k] == "(") - (self.t[k] == ")")
            k += 1
            if not depth:
                break
        return k

    def _section(self, k: int, section: str) -> int:
        """Names declared at k in a section; returns where to go on."""
        t, n = self.t, len(self.t)
        if section in ("TYPE", "CONST"):
            if k + 1 < n and t[k + 1] == "=":
                if not (k + 2 < n and t[k + 2] == "RECORD"):
                    self._add(k, k, k, False)
                if k + 2 < n and t[k + 2] == "(":
                    j = k + 3
                    while j < n and t[j] != ")":
                        if re.match(r"[A-Za-z_]", t[j]):
                            self._add(j, j, j, False)
                        j += 1
                    return j
                return k + 2
            return k + 1
        names, j = [], k
        while j + 1 < n and re.match(r"[A-Za-z_]", t[j]):
            names.append(j)
            if t[j + 1] == ",":
                j += 2
                continue
            if t[j + 1] == ":":
                for name in names:
                    self._add(name, name, name, False)
            break
        return j + 1
