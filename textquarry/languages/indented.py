"""Definitions, scopes and imports of Python sources: from the syntax tree, else from indented logical lines."""

from __future__ import annotations

import ast
import re
import warnings

from .scanner import Scan
from .structure import Definition, Lines

HEAD = re.compile(r"[ \t]*(?:async[ \t]+)?(?P<word>def|class|type)[ \t]+(?P<name>[^\W\d]\w*)")
COMPOUND = re.compile(r"[ \t]*(?:async[ \t]+)?(?:def|class|if|elif|else|for|while|try|except|finally|with|match|case)\b")
IMPORT = re.compile(r"[ \t]*(?:import|from)\b|.*:[ \t]*(?:import|from)[ \t]+\w")
SUITES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.ExceptHandler, ast.Match)
MOST_BYTES = 2 << 20


class PythonStructure:
    def __init__(self, text: str, code: str, scan: Scan):
        self.at = Lines(text)
        self.defs: list[Definition] = []
        self.scopes: list[tuple[int, int]] = []
        self.imports: list[tuple[int, int]] = []
        self.regions: list[tuple[int, int, str]] = []
        tree = None
        if len(text) <= MOST_BYTES:
            try:
                with warnings.catch_warnings(action="ignore"):
                    tree = ast.parse(text)
            except SyntaxError as e:
                line = min(max(1, e.lineno or 1), max(1, text.count("\n") + 1))
                self.regions.append((line, max(line, e.end_lineno or line), "error"))
            except (ValueError, RecursionError, MemoryError):
                tree = None
        self._logical_lines(text, code, tree is None)
        if tree is not None:
            self._from_tree(text, tree)
            scan.docstrings = self._docstrings(tree)
        else:
            scan.docstrings = self._docstrings_by_line(text, scan)
        self.defs = sorted(dict.fromkeys(self.defs), key=lambda d: (d.line, d.col, d.symbol))
        self.scopes, self.imports = sorted(set(self.scopes)), sorted(set(self.imports))

    def _from_tree(self, text: str, tree: ast.Module) -> None:
        lines = text.split("\n")
        for node in ast.walk(tree):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                line = lines[node.lineno - 1].encode("utf-8", "surrogatepass")
                name = node.name.encode("utf-8", "surrogatepass")
                col = line.find(name, node.col_offset + 4)
                self.defs.append(Definition(node.name, node.lineno, (col if col >= 0 else node.col_offset) + 1, start, node.end_lineno or node.lineno, (node.end_col_offset or 0) + 1, True))
                self.scopes.append((start, node.end_lineno or node.lineno))
            elif isinstance(node, ast.TypeAlias):
                self.defs.append(Definition(node.name.id, node.lineno, node.name.col_offset + 1, node.lineno, node.lineno, 0, False))
            elif isinstance(node, (ast.Import, ast.ImportFrom)):
                self.imports.append((node.lineno, node.end_lineno or node.lineno))

    def _logical_lines(self, text: str, code: str, all_: bool) -> None:
        """Suites by indentation; with all_, definitions and imports too."""
        rows = []  # first line, last line, indent, text
        depth, held = 0, ""
        first = 0
        for number, line in enumerate(code.split("\n"), 1):
            if not held and not line.strip():
                continue
            if not held:
                first = number
            held += line + "\n"
            depth = max(0, depth + sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}"))
            if depth and re.match(r"[ \t]*(?:def|class|import|from)\b", line) and number > first:
                depth = 0  # a bracket was left open above
                held = line + "\n"
                first = number
            if depth or line.rstrip().endswith("\\"):
                continue
            rows.append((first, number, len(held) - len(held.lstrip(" \t")), held))
            held = ""
        if held:
            rows.append((first, len(code.split("\n")), len(held) - len(held.lstrip(" \t")), held))
        decorated = 0
        starts: list[int] = []
        for k, (first, _, _, row) in enumerate(rows):
            starts.append(decorated or first)
            decorated = (decorated or first) if row.lstrip().startswith("@") else 0
        ends = [last for _, last, _, _ in rows]
        open_: list[int] = []
        for k, (_, _, indent, _) in enumerate(rows):
            while open_ and rows[open_[-1]][2] >= indent:
                ends[open_.pop()] = rows[k - 1][1]
            open_.append(k)
        for k in open_:
            ends[k] = rows[-1][1]
        for k, (first, last, indent, row) in enumerate(rows):
            suite = k + 1 < len(rows) and rows[k + 1][2] > indent
            if COMPOUND.match(row) and (suite or ":" in row):
                self.scopes.append((starts[k], self._with_comments(text, ends[k], indent)))
            if not all_:
                continue
            if m := HEAD.match(row):
                offset = self.at.starts[first - 1] + m.start("name")
                if m["word"] == "type":
                    self.defs.append(Definition(m["name"], first, self.at.col(offset), first, first, 0, False))
                else:
                    self.defs.append(Definition(m["name"], first, self.at.col(offset), starts[k], ends[k], 0, True))
            if IMPORT.match(row):
                self.imports.append((first, last))

    def _with_comments(self, text: str, end: int, indent: int) -> int:
        """Comments behind a suite that are indented deeper than its head belong to it."""
        lines, k, last = self.at, end, end
        total = len(lines.starts)
        while k < total:
            line = text[lines.starts[k] : lines.starts[k + 1] if k + 1 < total else len(text)]
            if line.strip() and not line.lstrip().startswith("#"):
                break
            if line.strip() and len(line) - len(line.lstrip(" \t")) > indent:
                last = k + 1
            k += 1
        return last

    def _docstrings(self, tree: ast.Module) -> list[tuple[int, int]]:
        spans = []
        for node in ast.walk(tree):
            if isinstance(node, (ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and node.body:
                value = node.body[0].value if isinstance(node.body[0], ast.Expr) else None
                if isinstance(value, ast.Constant) and isinstance(value.value, str):
                    spans.append((self._offset(value.lineno, value.col_offset), self._offset(value.end_lineno or value.lineno, value.end_col_offset or 0)))
        return sorted(spans)

    def _offset(self, line: int, byte: int) -> int:
        start = self.at.starts[line - 1]
        end = self.at.starts[line] if line < len(self.at.starts) else len(self.at.text)
        return start + len(self.at.text[start:end].encode("utf-8", "surrogatepass")[:byte].decode("utf-8", "ignore"))

    def _docstrings_by_line(self, text: str, scan: Scan) -> list[tuple[int, int]]:
        return [(a, b) for a, b in scan.strings if text[a : a + 3] in ('"""', "'''") and not text[self.at.starts[self.at.line(a) - 1] : a].strip()]
