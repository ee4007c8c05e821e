"""Definitions, scopes and imports of languages with braces, from tokens with matched brackets.

Statements are split by the brackets, semicolons and, where a language has it, line ends; the words in front of a body say
what it is. Text that is no statement of the language yields no definitions but never an error.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass

from ..functions.text import RUST_NEVER
from .registry import CONTROL, Language
from .scanner import Scan

TOKEN = re.compile(r"@?[\w$·]+|\d[\w.]*|=>|->|::|\?\.|&&|\|\||==|!=|<=|>=|[^\s\w]")
#: With names in backticks (Kotlin, Swift), and with universal character names (C, C++).
TICKED = re.compile(r"`[^`\n]+`|" + TOKEN.pattern)
NAMED_CHARACTER = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\N\{[A-Z0-9 -]+\}"
SPELLED = re.compile(rf"(?:[^\W\d]|{NAMED_CHARACTER})(?:[\w$]|{NAMED_CHARACTER})*|" + TOKEN.pattern)
#: With raw identifiers (Rust).
RAW = re.compile(r"r#[^\W\d]\w*|" + TOKEN.pattern)
#: Each with the blanks in front of it, which go at one step; texts must not end with blanks.
SPACED = {x: re.compile(rf"\s*+({x.pattern})") for x in (TOKEN, TICKED, SPELLED, RAW)}
WORD = re.compile(r"(?:@|r#)?[^\W\d][\w$]*$|\$[\w$]*$")
#: A line that ends, or begins, with one of these goes on.
GOES_ON_AFTER = set(", ( [ { = => -> + - * / % & | ^ < ? : . :: ?. && || == != <= >= ! ~".split()) | {"else", "extends", "implements", "where", "in", "is", "as", "return", "throws", "with", "by"}
GOES_ON_BEFORE = set(". ?. && || ? : = => -> == != <= >= , ) ] * / % | & ^ { +".split()) | {"else", "catch", "finally", "where", "throws", "extends", "implements", "by", "as", "is", "in"}
PAIRS = {"(": ")", "[": "]", "{": "}"}
MOST_TOKENS = 4_000_000


@dataclass(frozen=True)
class Definition:
    symbol: str
    line: int
    col: int  # 1-based, bytes
    scope_start: int
    scope_end: int
    owned_end_col: int  # exclusive, 0 unknown
    owns_scope: bool


class Lines:
    """Places in a text as lines and byte columns."""

    def __init__(self, text: str):
        self.text, self.starts = text, [0, *(m.end() for m in re.finditer("\n", text))]

    def line(self, offset: int) -> int:
        return bisect_right(self.starts, offset)

    def col(self, offset: int) -> int:
        piece = self.text[self.starts[self.line(offset) - 1] : offset]
        return (len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))) + 1


def spelled_out(name: str) -> str:
    """name with its universal character names as the characters themselves; unknown ones stay."""

    def character(m: re.Match[str]) -> str:
        if m[0][1] == "N":
            try:
                return unicodedata.lookup(m[0][3:-1])
            except KeyError:
                return m[0]
        code = int(m[0][2:], 16)
        return m[0] if code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code)

    return re.sub(NAMED_CHARACTER, character, name) if "\\" in name else name


class Structure:
    """What a file declares. ``code`` is its text with comments and strings blanked by character, not by byte; a 0 stands for a string."""

    def __init__(self, language: Language, text: str, code: str, scan: Scan):
        self.language, self.text, self.at, self.scan_ = language, text, Lines(text), scan
        self.defs: list[Definition] = []
        self.scopes: list[tuple[int, int]] = []
        self.imports: list[tuple[int, int]] = []
        #: What is found before there are tokens.
        self.early_regions: list[tuple[int, int, str]] = []
        if language.lexis.preprocessor:
            code = self._preprocessor(code)
        self.t: list[str] = []
        self.o: list[int] = []
        pattern = {"kotlin": TICKED, "swift": TICKED, "c": SPELLED, "cpp": SPELLED, "rust": RAW}.get(language.name, TOKEN)
        for m in SPACED[pattern].finditer((code.replace("<%", "{ ").replace("%>", "} ") if language.name in ("c", "cpp") else code).rstrip()):
            self.t.append(spelled_out(m[1]) if "\\" in m[1] else m[1])
            self.o.append(m.start(1))
        if len(self.t) > MOST_TOKENS:
            self.t, self.o = [], []
        #: Regions where the text is no sentence of the language: (first line, last line, "error" or "missing").
        self.regions: list[tuple[int, int, str]] = self.early_regions
        self.mate = self._matched()
        if language.name == "typescript":
            self._reference_directives()
        self._block(0, len(self.t), "file")
        if language.name in ("javascript", "typescript"):
            self._named_expressions()
        self.defs = sorted(dict.fromkeys(self.defs), key=lambda d: (d.line, d.col, d.symbol))
        self.scopes = sorted(set(self.scopes))
        self.imports = sorted(set(self.imports))

    # -- tokens

    def _matched(self) -> list[int]:
        """For each bracket its mate; where brackets don't match, the text is mended first."""
        mate, wrong = self._pairs_of_brackets()
        if any(a < b for a, b in wrong) and self._resynchronised():
            mate, wrong = self._pairs_of_brackets()
        self.regions += [(self.line_of(a), self.line_of(b), "error") for a, b in wrong]
        return mate

    def _pairs_of_brackets(self) -> tuple[list[int], list[tuple[int, int]]]:
        """Mates, and what has none: a closing bracket, or an opening one and the token that ends what is around it."""
        mate, stack, wrong = [-1] * len(self.t), [], []
        for k, token in enumerate(self.t):
            if token in PAIRS:
                stack.append(k)
            elif token in ")]}":
                j = len(stack) - 1
                while j >= 0 and PAIRS[self.t[stack[j]]] != token:
                    j -= 1
                if j >= 0 and (token == "}" or not any(self.t[x] == "{" for x in stack[j + 1 :])):
                    mate[k], mate[stack[j]] = stack[j], k
                    wrong += [(x, k) for x in stack[j + 1 :]]
                    del stack[j:]
                else:
                    wrong.append((k, k))
        return mate, wrong + [(x, len(self.t) - 1) for x in stack]

    def _resynchronised(self) -> bool:
        """Closes brackets that stand open where a declaration begins a line no further in than the line that opened them: that
        is where a reader takes them for forgotten. Each is recorded as missing at the end of the token before."""
        tokens, offsets, stack, changed = [], [], [], False
        indent = lambda o: o - self.at.starts[self.at.line(o) - 1]
        before = -1
        for k, (token, offset) in enumerate(zip(self.t, self.o, strict=True)):
            line = self.at.line(offset)
            if stack and line != before and self._declares(k):
                column = indent(offset)
                first = len(tokens)
                while stack and column <= stack[-1][1] and line > stack[-1][2]:
                    opening, _, _ = stack.pop()
                    tokens.append(PAIRS[opening])
                    offsets.append(max(self.o[k - 1] + len(self.t[k - 1]) - 1, self.o[k - 1]))
                if len(tokens) > first:
                    if tokens[-1] != "}":  # what stood open ends a statement
                        tokens.append(";")
                        offsets.append(offsets[-1])
                    at = self.at.line(offsets[first])
                    self.regions.append((at, at, "missing"))
                    changed = True
            before = line
            tokens.append(token)
            offsets.append(offset)
            if token in PAIRS:
                begin = self.at.starts[line - 1]
                text = self.text[begin:offset]
                stack.append((token, len(text) - len(text.lstrip()), line))
            elif token in ")]}":
                j = len(stack) - 1
                while j >= 0 and PAIRS[stack[j][0]] != token:
                    j -= 1
                if j >= 0:
                    del stack[j:]
        if changed:
            self.t, self.o = tokens, offsets
        return changed

    def _declares(self, k: int) -> bool:
        """Whether token k may begin a declaration: one of the language's words for it, behind modifiers."""
        t, heads, modifiers = self.t, self.language.heads, self.language.modifiers
        for j in range(k, min(k + 6, len(t))):
            if t[j] in heads:
                return j + 1 < len(t) and t[j] not in ("const", "let", "var", "val", "static", "using", "event", "init", "case") and (self.is_word(j + 1) or t[j + 1] in ("(", "<", "[", "*"))
            if t[j] not in modifiers:
                # TYPE NAME(...) {
                return self.language.c_functions and self.language.name not in ("javascript", "typescript") and self._function_head(j)
        return False

    def _function_head(self, k: int) -> bool:
        t = self.t
        if not self.is_word(k) or t[k] in CONTROL:
            return False
        words = 0
        while k < len(t) and (self.is_word(k) or t[k] in ("*", "&", "::", "<", ">", ",", "[", "]", "?", ".")) and t[k] not in CONTROL:
            words += self.is_word(k)
            k += 1
        if words < 2 or k >= len(t) or t[k] != "(":
            return False
        depth = 0
        for j in range(k, min(k + 400, len(t))):
            depth += (t[j] == "(") - (t[j] == ")")
            if not depth:
                return j + 1 < len(t) and (t[j + 1] == "{" or t[j + 1] in ("throws", "const", "noexcept", "override", "where"))
            if t[j] in "{};":
                return False
        return False

    def _reference_directives(self) -> None:
        """Directives in comments in front of all code that name other files."""
        first = self.o[0] if self.o else len(self.text)
        for start, end in self.scan_.comments:
            if start >= first:
                break
            if re.match(r"""///\s*<(?:reference\s[^>]*\b(?:path|types|lib)|amd-dependency\s[^>]*\bpath)\s*=\s*(?:"[^"]+"|'[^']+')[^>]*/>""", self.text[start:end]):
                self.imports.append((self.at.line(start), self.at.line(start)))

    def _preprocessor(self, code: str) -> str:
        """Record #define, #include and #using lines, and blank all directives with the lines they go on to."""
        out, at = [], 0
        found: list[tuple[int, str]] = []
        for m in re.finditer(r"^[ \t]*#[ \t]*(\w+)(?:[^\n\\]|\\[^\n]|\\\n)*", code, re.M):
            name, first, last = m[1], self.at.line(m.start(1)), self.at.line(max(m.start(1), m.end() - 1))
            if name == "define" and (d := re.match(r"\s+(\w+)", code[m.end(1) : m.end()])):
                o = m.end(1) + d.start(1)
                self.defs.append(Definition(d[1], self.at.line(o), self.at.col(o), first, last, self.at.col(m.end()), last > first))
            elif name in ("include", "embed", "import"):
                self.imports.append((first, last))
            elif name.startswith(("if", "el", "endif")):
                found.append((m.start(1), name))
            out.append(code[at : m.start()])
            out.append(re.sub(r"[^\n]", " ", m[0]))
            at = m.end()
        code = "".join(out) + code[at:]
        return self._conditional(code, found) if found else code

    def _conditional(self, code: str, directives: list[tuple[int, str]]) -> str:
        """#if groups: each group and each branch behind its first is a scope. A group is compiled with one branch, so brackets
        that a branch leaves open, or closes beyond it, stand for those of its group once: those of the first branch that has
        any stay, and its siblings' are blanked."""
        scopes = self.language.name in ("c", "cpp")
        gone: list[int] = []
        # Open groups: (line, [branches of (line, brackets left)]); the outermost stands for the file.
        stack: list[tuple[int, list[tuple[int, list[int]]]]] = [(0, [(0, [])])]

        def meet(left: list[int], k: int) -> None:
            """Bracket k behind those that are left unmatched."""
            if left and PAIRS.get(code[left[-1]]) == code[k]:
                left.pop()
            else:
                left.append(k)

        at = ended = 0  # where the last group ended
        for offset, name in [*directives, (len(code), "")]:
            left = stack[-1][1][-1][1]
            for m in re.finditer(r"[][(){}]", code[at:offset]):
                meet(left, at + m.start())
            at, line = offset, self.at.line(offset)
            if name.startswith("if"):
                stack.append((line, [(line, [])]))
            elif len(stack) == 1:
                if name:
                    self.early_regions.append((line, line, "error"))
            elif name.startswith("el"):
                stack[-1][1].append((line, []))
            elif name == "endif":
                first, branches = stack.pop()
                kept = next((left for _, left in branches if left), [])
                gone += [k for _, left in branches if left is not kept for k in left]
                for k in kept:
                    meet(stack[-1][1][-1][1], k)
                if scopes:
                    content = code[: self.at.starts[line - 1]].rstrip()
                    last = max(self.at.line(len(content) - 1) if content else 0, branches[-1][0], ended if ended > first else 0)
                    self.scopes.append((first, line))
                    for begin, _ in branches[1:]:
                        # an #elif goes on to the end of what comes behind it
                        self.scopes.append((begin, max(begin, last)))
                ended = line
        for first, branches in stack[1:]:  # without #endif
            self.early_regions.append((first, self.at.line(len(code)), "error"))
        if not gone:
            return code
        cut = set(gone)
        return "".join(" " if k in cut else c for k, c in enumerate(code))

    def line_of(self, k: int) -> int:
        return self.at.line(self.o[k])

    def is_word(self, k: int) -> bool:
        return bool(WORD.match(self.t[k])) or len(self.t[k]) > 2 and self.t[k][0] == "`"

    # -- statements

    def _statement_end(self, k: int, stop: int, context: str) -> int:
        """Index after the statement that begins at k."""
        t, newline, first = self.t, self.language.newline, k
        if self._is_operator(k, stop):  # its marks don't go on with the next line
            while k < stop and self.line_of(k) == self.line_of(first) and t[k] not in ";{":
                k += 1
            return self.mate[k] + 1 if k < stop and t[k] == "{" and self.mate[k] > 0 else k + (k < stop and t[k] == ";")
        assigned = False
        while k < stop:
            x = t[k]
            if x == ";" or (x == "," and context == "enum" and not self._keyword_led(first, k)):
                return k + 1
            if newline and k > first and self.line_of(k) > self._end_line(k - 1) and not self._goes_on(k):
                return k
            if x == "=" or x == "=>" and not newline:
                assigned = True
            if x in PAIRS:
                end = self.mate[k]
                if end < 0 or end >= stop:
                    return stop if x != "{" else k + 1
                if x == "{" and not assigned:
                    after = t[end + 1] if end + 1 < stop else ""
                    same_line = end + 1 < stop and self.line_of(end + 1) == self.line_of(end)
                    if after in ("else", "catch", "finally") or (after == "while" and t[first] == "do") or (after == "while" and t[first] == "repeat"):
                        k = end + 1
                        continue
                    if after in (";", ","):
                        k = end + 1
                        continue
                    if self.language.name in ("c", "cpp") and any(w in t[first:k] for w in ("struct", "union", "enum", "class", "typedef")) and "(" not in t[first:k] and after not in ("}", ""):
                        k = end + 1
                        continue
                    if after in (".", "?.", "(", "=", "[") and (not newline or same_line) and after != "[":
                        k = end + 1
                        continue
                    return end + 1
                k = end + 1
                continue
            if x in ")]}":
                return k + 1
            k += 1
        return stop

    def _is_operator(self, k: int, stop: int) -> bool:
        """Whether a declaration of an operator begins here (Swift)."""
        return self.language.name == "swift" and k + 2 < stop and self.t[k] in ("prefix", "infix", "postfix") and self.t[k + 1] == "operator"

    def _keyword_led(self, first: int, k: int) -> bool:
        return any(w in self.language.heads for w in self.t[first:k][:8])

    def _end_line(self, k: int) -> int:
        return self.line_of(k)

    def _goes_on(self, k: int) -> bool:
        before, now = self.t[k - 1], self.t[k]
        if now == "{":
            return self.language.name != "go"
        if self.language.name == "go":
            return before in set(", ( [ { = + - * / % & | ^ < . && || == != <= >= :".split())
        if before in GOES_ON_AFTER:
            return not (before in ("!", "?") and self.language.name in ("swift", "kotlin"))
        return now in GOES_ON_BEFORE

    def _block(self, k: int, stop: int, context: str) -> None:
        """All statements of [k, stop), with a stack instead of recursion."""
        todo = [(k, stop, context)]
        while todo:
            k, stop, context = todo.pop()
            while k < stop:
                end = max(k + 1, self._statement_end(k, stop, context))
                todo += self._statement(k, end, context)
                k = end

    def _statement(self, first: int, end: int, context: str) -> list[tuple[int, int, str]]:
        """Record a statement's definitions and scopes; returns the bodies in it."""
        t, lang = self.t, self.language
        k = self._past_attributes(first, end)
        last = end - 1
        if k >= end or t[k] in ";,)]}":
            return self._bodies(first, end, first, "func")
        if lang.name == "csharp" and t[k] == "global" and k + 1 < end and t[k + 1] == "using":
            k += 1
        if t[k] in lang.imports and context in ("file", "ns") or (t[k] == "require" and lang.name in ("javascript", "typescript")):
            if not (lang.name == "csharp" and k + 1 < end and t[k + 1] == "(") and not (t[k] == "extern" and not (k + 1 < end and t[k + 1] in ("crate", "alias"))):
                self.imports.append((self._doc_start(first) if lang.name == "rust" else self.line_of(first), self.line_of(last)))
                if lang.name == "csharp":
                    self._csharp_alias(k, end)
                return []
        if lang.name in ("javascript", "typescript") and context == "file" and "require" in t[k:end] and t[k] in ("const", "let", "var"):
            self.imports.append((self.line_of(first), self.line_of(last)))
        if lang.name in ("javascript", "typescript") and t[k] == "export" and "from" in t[k:end]:
            self.imports.append((self.line_of(first), self.line_of(last)))
        if self._is_operator(k, end):
            j = k + 2
            while j < end and t[j] not in (":", "{", ";"):
                j += 1
            self._define(k + 2, first, end - 1, False, "".join(t[k + 2 : j]))
            return []
        body = self._first_body(k, end)
        head = self._head(k, body if body >= 0 else end)
        if head is None:
            return self._without_head(first, k, end, body, context)
        word, at = head
        kind = lang.heads[word]
        return getattr(self, f"_{kind}")(first, at, end, body, context)

    def _csharp_alias(self, k: int, end: int) -> None:
        t = self.t
        if t[k] == "extern" and k + 2 < end and self.is_word(k + 2):
            self._define(k + 2, k, end - 1, False)
        elif t[k] == "using" and "=" in t[k:end] and self.is_word(at := t.index("=", k, end) - 1) and at > k:
            self._define(at, k, end - 1, False)

    def _past_attributes(self, k: int, end: int) -> int:
        t = self.t
        while k < end:
            x = t[k]
            if x == "@" or (x.startswith("@") and len(x) > 1 and x != "@interface"):
                k += 1 if len(x) > 1 else 2
                while k + 1 < end and t[k] == "." and self.is_word(k + 1):
                    k += 2
                if k < end and t[k] == "(" and self.mate[k] > 0:
                    k = self.mate[k] + 1
            elif x == "#" and k + 1 < end and t[k + 1] in ("[", "!"):
                k += 1 if t[k + 1] == "[" else 2
                k = self.mate[k] + 1 if k < end and t[k] == "[" and self.mate[k] > 0 else k + 1
            elif x == "[" and self.language.name in ("csharp", "cpp", "c") and self.mate[k] > 0:
                k = self.mate[k] + 1
            else:
                break
        return k

    def _first_body(self, k: int, end: int) -> int:
        """The first brace outside other brackets, -1 if none."""
        while k < end:
            if self.t[k] == "{":
                return k
            if self.t[k] in "([" and self.mate[k] > k:
                k = self.mate[k]
            k += 1
        return -1

    def _head(self, k: int, stop: int) -> tuple[str, int] | None:
        """The declaring word in front of stop and its place, behind modifiers only."""
        t, lang = self.t, self.language
        seen = 0
        while k < stop and seen < 24:
            x = t[k]
            if x == "const" and lang.name == "rust":  # of a function
                j = k + 1
                while j < stop and t[j] in ("unsafe", "async", "extern", "0"):
                    j += 1
                if j < stop and t[j] == "fn":
                    k = j
                    x = "fn"
            if x in lang.heads and k + 1 < len(t):
                after = t[k + 1]
                if x in ("type", "module", "namespace", "enum", "record", "union", "macro", "value", "object", "actor", "get", "set", "init", "concept", "event", "data") and not (WORD.match(after) or after in "{<[(" or after == "class" or after == "*" or after == "@"):
                    return None
                if x in ("const", "static", "enum", "data", "value") and k + 1 < stop and (after in lang.heads and after != "_") and after not in ("init",):
                    k += 1
                    seen += 1
                    continue
                if x in ("struct", "union", "enum", "class") and lang.name in ("c", "cpp"):
                    opened = self._first_body(k, stop + 1 if stop < len(t) else stop)
                    if opened < 0 or any(t[j] in ("(", "=") for j in range(k, opened)):
                        return None
                return x, k
            if x in lang.modifiers or x in ("<", ">") and lang.name == "cpp":
                if x == "template" and k + 1 < stop and t[k + 1] == "<":
                    k = self._past_angle(k + 1, stop)
                    continue
                k += 1
                if k < stop and t[k] == "(" and x in ("pub", "private", "public", "internal", "fileprivate", "extern", "open", "unowned") and self.mate[k] > 0:
                    k = self.mate[k] + 1
            elif x == "0" or x == "typedef":  # extern "C"
                k += 1
            else:
                return None
            seen += 1
        return None

    def _past_angle(self, k: int, stop: int) -> int:
        depth = 0
        while k < stop:
            if self.t[k] == "<":
                depth += 1
            elif self.t[k] == ">":
                depth -= 1
                if not depth:
                    return k + 1
            elif self.t[k] in PAIRS and self.mate[k] > k:
                k = self.mate[k]
            elif self.t[k] in ";{":
                return k
            k += 1
        return k

    # -- recording

    def _doc_start(self, first: int) -> int:
        """The line of token first, or of the documentation comments right above it."""
        line = self.line_of(first)
        if self.language.name == "go":
            return line
        k = bisect_right(self.scan_.comments, (self.o[first], -1)) - 1
        while k >= 0:
            start, end = self.scan_.comments[k]
            text = self.text[start : start + 4]
            above, below = self.at.line(start), self.at.line(max(start, end - 1))
            doc = text.startswith(("///", "//!", "/**", "/*!")) and not text.startswith(("///<", "//!<", "/**<", "/*!<"))
            own_line = not self.text[self.at.starts[above - 1] : start].strip()
            if not doc or below < line - 1 or not own_line:
                break
            line = above
            k -= 1
        return line

    def _define(self, name: int, first: int, last: int, owns: bool, symbol: str | None = None) -> None:
        """A definition named by token name that reaches from token first to token last."""
        ticked = symbol is None and self.t[name].startswith("`")
        symbol = symbol or self.t[name].lstrip("@").strip("`")
        if symbol in ("_", "") or symbol[:2] == "r#" and symbol[2:] in RUST_NEVER or symbol == "r" and self.language.name == "rust" and self.t[name + 1 : name + 2] == ["#"]:
            return
        line = self.line_of(name)
        column = self.at.col(self.o[name]) + ticked
        end = self.o[last] + len(self.t[last])
        start = min(line, self._doc_start(first))
        if owns:
            self.defs.append(Definition(symbol, line, column, start, self.line_of(last), self.at.col(end), True))
            self.scopes.append((start, self.line_of(last)))
        else:
            self.defs.append(Definition(symbol, line, column, line, line, 0, False))

    def _bodies(self, k: int, end: int, first: int, context: str) -> list[tuple[int, int, str]]:
        """All outermost braces of [k, end) as bodies; each is a scope with what is in front of it."""
        found, start, t = [], first, self.t
        while k < end:
            if t[k] == "{" and self.mate[k] > k:
                self.scopes.append((self.line_of(start), self.line_of(self.mate[k])))
                found.append((k + 1, self.mate[k], context))
                k = self.mate[k]
                start = k + 1 if k + 1 < end else k
            elif t[k] in "([" and self.mate[k] > k:
                inner = k + 1
                while inner < self.mate[k]:
                    if t[inner] == "{" and self.mate[inner] > inner:
                        self.scopes.append((self.line_of(max(start, k)) if t[k] == "[" else self.line_of(start), self.line_of(self.mate[inner])))
                        found.append((inner + 1, self.mate[inner], "func"))
                        inner = self.mate[inner]
                    inner += 1
                k = self.mate[k]
            k += 1
        return found

    def _name_after(self, k: int, stop: int) -> int:
        """The token behind k that names what is declared; -1 if there is none."""
        k += 1
        t = self.t
        while k < stop and (t[k] in ("*", "&", "class", "struct", "interface", "<", "?", "!", "`", "mut", "unsafe") or t[k] in self.language.modifiers and k + 1 < stop and self.is_word(k + 1)):
            k = self._past_angle(k, stop) if t[k] == "<" else k + 1
        return k if k < stop and (self.is_word(k) or t[k].startswith("$")) else -1

    # -- by kind of declaration

    def _type(self, first: int, at: int, end: int, body: int, context: str) -> list[tuple[int, int, str]]:
        t, lang = self.t, self.language
        if lang.name == "go" and at + 1 < end and t[at + 1] == "(":
            return self._go_group(at, self._go_type)
        if lang.name == "go":
            self._go_type(at + 1, end, first)
            return self._bodies(at, end, at + 1, "type")
        if t[at] == "class" and at + 1 < end and t[at + 1] == "enum":
            at += 1
        name = self._name_after(at, body if body >= 0 else end)
        if lang.name in ("c", "cpp") and name >= 0 and body >= 0:  # the name is the last word in front of bases
            k = name
            while k + 1 < body and self.is_word(k + 1) and t[k + 1] not in ("final",):
                k += 1
            name = k
        if name < 0 and t[at] == "object" and at > 0 and t[at - 1] == "companion":
            self._define(at, first, end - 1, True, "Companion")
            return self._bodies(at, end, first, "type")
        if name >= 0 and (body >= 0 or lang.name not in ("c", "cpp")):
            self._define(name, first, self.mate[body] if body >= 0 and self.mate[body] > 0 else end - 1, True)
        elif body >= 0 and lang.name in ("c", "cpp") and end - 1 > self.mate[body]:
            for k in range(self.mate[body] + 1, end):  # an anonymous aggregate belongs to its declarator
                if self.is_word(k):
                    self._define(k, first, end - 1, True)
                    return self._bodies(at, end, first, "type")
        if lang.name in ("c", "cpp") and body >= 0:
            for k in range(self.mate[body] + 1, end):
                if self.is_word(k):
                    self._define(k, first, end - 1, False)
        if lang.name in ("java", "csharp", "kotlin") and name >= 0:
            self._parameters(name, body if body >= 0 else end)
        if lang.name == "kotlin" and "enum" in t[first:at] and body >= 0 and self.mate[body] > 0:
            return self._members(body)
        return self._bodies(at, end, first, "type")

    def _parameters(self, name: int, stop: int) -> None:
        """Record components and constructor properties."""
        t, k = self.t, name + 1
        if k < stop and t[k] == "<":
            k = self._past_angle(k, stop)
        while k < stop and t[k] in self.language.modifiers | {"constructor"}:
            k += 1
        if k >= stop or t[k] != "(" or self.mate[k] < 0:
            return
        part, depth = k + 1, 0
        for j in range(k + 1, self.mate[k] + 1):
            depth += (t[j] in "([{<") - (t[j] in ")]}>")
            if (t[j] == "," and depth == 0) or j == self.mate[k]:
                words = [x for x in range(part, j) if self.is_word(x)]
                if self.language.name == "kotlin":
                    values = [x for x in words if t[x] in ("val", "var")]
                    if values and values[0] + 1 < j:
                        self._define(values[0] + 1, part, j - 1, False)
                elif len(words) > 1:
                    equals = [x for x in range(part, j) if t[x] == "="]
                    names = [x for x in words if not equals or x < equals[0]]
                    if names:
                        self._define(names[-1], part, j - 1, False)
                part = j + 1

    def _parameter_properties(self, paren: int) -> None:
        """Constructor parameters with a modifier are properties."""
        t, part = self.t, paren + 1
        for j in range(paren + 1, self.mate[paren] + 1):
            if t[j] == "," or j == self.mate[paren]:
                k = part
                while k < j and t[k] in ("public", "private", "protected", "readonly", "override"):
                    k += 1
                if k > part and k < j and self.is_word(k):
                    self._define(k, part, j - 1, False)
                part = j + 1

    def _enum(self, first: int, at: int, end: int, body: int, context: str) -> list[tuple[int, int, str]]:
        self._type(first, at, end, body, context)
        if body < 0 or self.mate[body] < 0:
            return []
        if self.language.name == "swift":
            return [(body + 1, self.mate[body], "type")]
        return self._members(body)

    def _members(self, body: int) -> list[tuple[int, int, str]]:
        """The members of an enumeration; returns what follows them, and bodies of members."""
        t, k, stop = self.t, body + 1, self.mate[body]
        rest: list[tuple[int, int, str]] = []
        while k < stop:
            begin = self._past_attributes(k, stop)
            j = begin
            while j < stop and t[j] not in (",", ";"):
                j = self.mate[j] + 1 if t[j] in PAIRS and self.mate[j] > j else j + 1
            if begin < stop and self.is_word(begin) and t[begin] not in self.language.heads | dict.fromkeys(self.language.modifiers):
                inner = self._first_body(begin, j)
                self._define(begin, k, j - 1, inner >= 0 and self.language.name != "rust")
                if inner >= 0 and self.language.name != "rust":
                    rest.append((inner + 1, self.mate[inner], "type"))
            elif begin < j:
                rest.append((k, j, "type"))
            if j < stop and t[j] == ";":
                rest.append((j + 1, stop, "type"))
                break
            k = j + 1
        return rest

    def _ns(self, first: int, at: int, end: int, body: int, context: str) -> list[tuple[int, int, str]]:
        name = self._name_after(at, body if body >= 0 else end)
        if name >= 0:
            symbol, k = self.t[name], name
            while k + 2 < end and self.t[k + 1] in (".", "::") and self.is_word(k + 2):
                symbol += self.t[k + 1] + self.t[k + 2]
                k += 2
            last = end - 1
            if body < 0 and self.language.name == "csharp":
                last = len(self.t) - 1  # up to the end of the file
            self._define(name, first, last, body >= 0 or self.language.name == "csharp", symbol)
        return self._bodies(at, end, first, "file")

    def _func(self, first: int, at: int, end: int, body: int, context: str) -> list[tuple[int, int, str]]:
        t, lang = self.t, self.language
        k = at + 1
        if lang.name == "go" and k < end and t[k] == "(":
            k = self.mate[k] + 1 if self.mate[k] > 0 else end
        elif lang.name == "rust" and t[at] == "macro_rules":
            k += 1
        elif lang.name == "kotlin":
            if k < end and t[k] == "<":
                k = self._past_angle(k, end)
            paren = k
            while paren < end and t[paren] not in ("(", "{", "="):
                paren += 1
            k = paren - 1 if paren > k else k
        elif lang.name == "csharp":
            paren = k
            while paren < end and t[paren] != "(":
                paren += 1
            k = paren - 1
            if k > at and t[k] == ">":
                while k > at and t[k] != "<":
                    k -= 1
                k -= 1
        elif k < end and t[k] == "*":
            k += 1
        if lang.name == "swift" and k < end and not self.is_word(k):
            symbol, j = "", k
            while j < end and t[j] not in "(<" or (j < end and t[j] == "<" and j == k):
                symbol += t[j]
                j += 1
            if symbol and k < end:
                self._define(k, first, end - 1, True, symbol)
        elif k < end and self.is_word(k):
            self._define(k, first, end - 1, body >= 0 or lang.name in ("kotlin", "go") or t[at] == "func")
        return self._bodies(at, end, first, "func")

    def _constructor(self, first: int, at: int, end: int, body: int, context: str) -> list[tuple[int, int, str]]:
        if context in ("type", "enum"):
            self._define(at, first, end - 1, True)
        return self._bodies(at, end, first, "func")

    def _impl(self, first: int, at: int, end: int, body: int, context: str) -> list[tuple[int, int, str]]:
        stop = body if body >= 0 else end
        k = at + 1
        if k < stop and self.t[k] == "<":
            k = self._past_angle(k, stop)
        if self.language.name == "rust":
            for j in range(k, stop):
                if self.t[j] == "for":
                    k = j + 1
            while k < stop and not self.is_word(k) or k < stop and self.t[k] in ("mut", "dyn"):
                k += 1
            while k + 2 < stop and self.t[k + 1] == "::":
                k += 2
        if k < stop and self.is_word(k):
            name = k
            if self.language.name == "swift":
                while k + 2 < stop and self.t[k + 1] == ".":
                    k += 2
                name = k
            self._define(name, first, end - 1, True)
        return self._bodies(at, end, first, "type")

    def _alias(self, first: int, at: int, end: int, body: int, context: str) -> list[tuple[int, int, str]]:
        name = self._name_after(at, end)
        if self.language.name == "cpp" and not (name >= 0 and name + 1 < end and self.t[name + 1] == "="):
            return []
        if name >= 0 and (name + 1 < end or self.language.name in ("swift", "rust")):
            self._define(name, first, end - 1, self.language.name == "typescript")
        return self._bodies(at, end, first, "type")

    def _value(self, first: int, at: int, end: int, body: int, context: str) -> list[tuple[int, int, str]]:
        t, lang = self.t, self.language
        if lang.name == "go" and at + 1 < end and t[at + 1] == "(":
            return self._go_group(at, self._go_value)
        if lang.name == "go":
            if context in ("file", "func"):
                self._go_value(at + 1, end, first)
            return self._bodies(at, end, at, "func")
        if lang.name in ("swift", "kotlin", "rust", "java", "c") and context == "func":
            return self._bodies(at, end, first, "func")
        k = at + 1
        while k < end and (t[k] in ("mut", "&", "*", "ref", "class") or t[k] in lang.modifiers):
            k += 1
        if lang.name == "kotlin" and k < end and t[k] == "<":
            k = self._past_angle(k, end)
        if k < end and t[k] in "{[(" and self.mate[k] > k:  # destructured
            for j in range(k + 1, self.mate[k]):
                if self.is_word(j) and t[j + 1] in (",", "}", "]", ")", "=") and t[j - 1] not in (".", "="):
                    self._define(j, first, end - 1, False)
            return self._bodies(self.mate[k], end, first, "func")
        if lang.name == "csharp":
            k = self._past_type(k, end)
        while k < end and self.is_word(k):
            if lang.name in ("kotlin", "csharp"):
                while k + 2 < end and t[k + 1] == "." and self.is_word(k + 2):
                    k += 2
            stop = k + 1
            while stop < end and t[stop] not in (",", ";"):
                stop = self.mate[stop] + 1 if t[stop] in PAIRS and self.mate[stop] > stop else self._past_angle(stop, end) if t[stop] == "<" and lang.name != "javascript" and t[stop - 1] != "=" else stop + 1
            owns = any(t[j] in ("function", "=>", "class") for j in range(k, stop)) or (body >= 0 and k < body < stop and (lang.name not in ("javascript", "typescript") or t[body - 1] in ("=", ")")))
            if lang.name == "kotlin":  # properties own their accessors and delegates
                owns = any(t[j] in ("by", "get", "set") for j in range(k + 1, min(stop, end)))
            elif lang.name == "swift":  # and computed ones their bodies
                owns = body >= 0 and "=" not in t[k:body]
            self._define(k, first, max(k, min(stop, end) - 1), owns)
            k = stop + 1
        return self._bodies(at, end, first, "object" if lang.name in ("javascript", "typescript") else "func")

    def _switch_entries(self, body: int) -> None:
        """Each entry of a switch is a scope that the next entry of the same switch ends."""
        t, k, stop = self.t, body + 1, self.mate[body]
        entries: list[int] = []
        while k < stop:
            if t[k] in PAIRS and self.mate[k] > k:
                k = self.mate[k] + 1
                continue
            opens = t[k] in ("case", "default") and (t[k - 1] in ("{", ";", "@unknown") or self.line_of(k) > self.line_of(k - 1)) and t[k - 1] not in (".", "if", "guard", "while", "for", ",")
            if opens:
                entries.append(k - (t[k - 1] == "@unknown"))
            k += 1
        for k, following in zip(entries, [*entries[1:], stop - 1], strict=False):
            self.scopes.append((self.line_of(k), self.line_of(following)))

    def _past_type(self, k: int, end: int) -> int:
        """Behind a type's name with its arguments, array ranks and marks."""
        t = self.t
        while k < end and self.is_word(k):
            k += 1
            if k < end and t[k] == "<":
                k = self._past_angle(k, end)
            if k + 1 < end and t[k] in (".", "::") and self.is_word(k + 1):
                k += 1
                continue
            while k < end and (t[k] in ("?", "*") or t[k] == "[" and self.mate[k] > k):
                k = self.mate[k] + 1 if t[k] == "[" else k + 1
            break
        return k

    def _go_group(self, at: int, each) -> list[tuple[int, int, str]]:  # noqa: ANN001
        stop, k, found = self.mate[at + 1], at + 2, []
        while 0 < k < stop:
            end = max(k + 1, self._statement_end(k, stop, "file"))
            each(k, end, k)
            found += self._bodies(k, end, k, "type" if each == self._go_type else "func")
            k = end
        return found

    def _go_type(self, k: int, end: int, first: int) -> None:
        if k < end and self.is_word(k):
            self._define(k, k, end - 1 - (self.t[end - 1] == ";"), True)

    def _go_value(self, k: int, end: int, first: int) -> None:
        names = []
        while k < end and self.is_word(k):
            names.append(k)
            if k + 1 < end and self.t[k + 1] == ",":
                k += 2
            else:
                break
        owns = any(self.t[j] == "{" for j in range(k, end))
        for name in names:
            self._define(name, first, end - 1 - (self.t[end - 1] == ";"), owns)

    def _without_head(self, first: int, k: int, end: int, body: int, context: str) -> list[tuple[int, int, str]]:
        t, lang = self.t, self.language
        stop = body if body >= 0 else end
        if lang.name == "typescript" and t[k : k + 3] == ["export", "as", "namespace"] and k + 3 < end:
            self._define(k + 3, first, end - 1, False)
            return []
        if lang.name == "java" and context == "type" and body > k and self.is_word(body - 1) and t[body - 1] not in lang.modifiers and all(x in lang.modifiers for x in t[k : body - 1]):
            self._define(body - 1, first, self.mate[body] if self.mate[body] > 0 else end - 1, True)  # a compact constructor
            return self._bodies(k, end, first, "func")
        if lang.name == "go" and context == "type" and k + 1 < end and self.is_word(k) and t[k + 1] == "(":
            self._define(k, first, end - 1, True)  # an interface's method
            return self._bodies(k, end, first, "func")
        if lang.name == "swift" and t[k] in ("case", "indirect") and context == "type":
            j = k + 1 + (t[k] == "indirect")
            while j < end and self.is_word(j):
                self._define(j, first, end - 1, False)
                j += 1
                while j < end and t[j] != ",":
                    j = self.mate[j] + 1 if t[j] in PAIRS and self.mate[j] > j else j + 1
                j += 1
            return []
        while lang.name == "java" and k + 1 < end and t[k] == "synchronized" and t[k + 1] != "(":
            k += 1
        if lang.name == "swift" and t[k] == "switch" and body >= 0 and self.mate[body] > body:
            self._switch_entries(body)
        if t[k] in CONTROL and t[k] not in ("default", "operator", "new", "match", "using", "delete", "get", "set") or t[k] in ("package", "goto", "assert"):
            return self._bodies(k, end, first, "func")
        if context == "object" and lang.name in ("javascript", "typescript"):
            self._pairs(k, end)
            return self._bodies(k, end, first, "object")
        if lang.c_functions:
            paren = k
            while paren < stop and t[paren] != "(" and t[paren] != "=":
                paren = self.mate[paren] + 1 if t[paren] == "[" and self.mate[paren] > paren else self._past_angle(paren, stop) if t[paren] == "<" and lang.name in ("java", "csharp", "cpp", "typescript") else paren + 1
            if lang.name == "cpp" and k < paren < stop and t[paren - 1] == "operator" and self.mate[paren] == paren + 1 and paren + 2 < stop and t[paren + 2] == "(":
                paren += 2  # the call operator
            name = paren - 1
            if lang.name in ("c", "cpp") and paren < stop and t[paren] == "(" and self.mate[paren] > 0:
                inner = self._declarator(paren, "typedef" in t[first:paren])
                if inner >= 0:
                    self._define(inner, first, self.mate[body] if body >= 0 and self.mate[body] > 0 else end - 1, body >= 0)
                    return self._bodies(k, end, first, "func")
            if name >= k and t[name] == ">" :
                while name > k and t[name] != "<":
                    name -= 1
                name -= 1
            called = paren < stop and t[paren] == "(" and name >= k and (self.is_word(name) or "operator" in t[k:paren]) and t[name] not in CONTROL and t[name] not in lang.heads and self.mate[paren] > 0
            if called:
                after = self.mate[paren] + 1
                while lang.name in ("c", "cpp") and after < stop and t[after] == "(" and self.mate[after] > 0 and name == k:
                    after = self.mate[after] + 1
                declared = body >= 0 and (context != "func" or lang.name in ("csharp",) and name > k) and t[name - 1 if name > k else name] not in ("new", "return", ".", "=")
                arrow = lang.name == "csharp" and "=>" in t[after:end]
                ends = t[end - 1] == ";" or lang.name == "typescript" and context == "type"
                named = name > k or context == "type" and lang.name in ("cpp", "typescript")
                bodiless = body < 0 and context in ("type", "file") and named and ends and lang.name in ("java", "csharp", "c", "cpp", "typescript")
                plain_script = lang.name in ("javascript", "typescript") and context in ("file", "func")
                if (declared or arrow or bodiless) and not plain_script:
                    if "operator" in t[k:paren]:
                        at = t.index("operator", k, paren)
                        symbol = "operator" + "".join(t[at + 1 : paren])
                        if lang.name == "cpp":  # as it is spelled
                            symbol = " ".join(self.text[self.o[at] : self.o[paren]].split())
                        if lang.name == "csharp":
                            checked, rest = " checked" * (t[at + 1] == "checked"), t[at + 1 + (t[at + 1] == "checked") : paren]
                            converts = next((x for x in t[k:at] if x in ("implicit", "explicit")), None)
                            symbol = f"{converts} operator{checked} {''.join(rest)}" if converts else f"operator{checked}{''.join(rest)}"
                        self._define(at, first, end - 1, body >= 0 or arrow, symbol)
                    elif name > k and t[name - 1] == "~":
                        self._define(name - 1, first, end - 1, body >= 0, "~" + t[name])
                    elif t[name] not in ("if", "for", "while", "switch", "catch", "this", "super"):
                        self._define(name, first, self.mate[body] if body >= 0 and body < end and lang.name != "csharp" and self.mate[body] > 0 and not arrow else end - 1, body >= 0 or arrow or lang.name in ("java", "typescript"))
                    if lang.name == "typescript" and t[name] == "constructor":
                        self._parameter_properties(paren)
                    return self._bodies(k, end, first, "func")
        if lang.name in ("javascript", "typescript"):
            return self._javascript(first, k, end, body, context)
        if lang.c_values and context in ("type", "file", "ns") and t[k] not in CONTROL:
            self._c_values(first, k, end, body, context)
        return self._bodies(k, end, first, "func" if context != "file" or body < 0 or t[k] != "extern" else "file")

    def _declarator(self, paren: int, typedef: bool) -> int:
        """The name in a declarator in parentheses, such as (*NAME)(...), -1 if these are none."""
        t, k, stop, pointer = self.t, paren + 1, self.mate[paren], False
        if stop + 1 >= len(t) or t[stop + 1] not in ("(", "["):
            return -1
        while k < stop and (t[k] in ("*", "&", "&&", "^", "const", "volatile", "restrict", "::") or self.is_word(k) and k + 1 < stop and (t[k + 1] in ("::", "*") or self.is_word(k + 1))):
            pointer |= t[k] in ("*", "&", "&&", "^")
            k += 1
        if k < stop and t[k] == "(" and self.mate[k] > k and pointer:
            return self._declarator(k, True)
        named = k < stop and self.is_word(k) and t[k] not in CONTROL and (k + 1 == stop or t[k + 1] in ("(", "["))
        return k if named and (pointer or typedef and k + 1 == stop) else -1

    def _c_values(self, first: int, k: int, end: int, body: int, context: str) -> None:
        """TYPE NAME [= VALUE] {, NAME [= VALUE]}; and properties."""
        t, lang = self.t, self.language
        if lang.name == "cpp" and "auto" in t[k:end]:
            j = t.index("auto", k, end) + 1
            while j < end and t[j] in ("&", "&&", "const"):
                j += 1
            if j < end and t[j] == "[" and self.mate[j] > j:  # a structured binding
                for n in range(j + 1, self.mate[j]):
                    if self.is_word(n):
                        self._define(n, first, end - 1, False)
                return
        words, j, name = 0, k, -1
        while j < end:
            x = t[j]
            if x in ("=", ";", ",", ":", "{", "=>") or x == "(" and words:
                if x == "(" and j + 2 < end and t[j + 1] == "*" and self.is_word(j + 2):  # a pointer to a function
                    self._define(j + 2, first, end - 1, False)
                    return
                break
            if x == "[" and self.mate[j] > j:
                if lang.name in ("csharp",) and j > k and t[j - 1] == "this":
                    self._define(j - 1, first, end - 1, body >= 0)
                    return
                j = self.mate[j]
            elif x == "<" and lang.name != "c":
                j = self._past_angle(j, end) - 1
            elif self.is_word(j):
                words += 1
                name = j
            j += 1
        if lang.name == "typescript":
            return
        if words < 2 or name < 0 or t[name] in lang.modifiers or j >= end or t[j] in ("(",) or (t[j] == ":" and lang.name != "cpp" and lang.name != "c"):
            return
        if t[j] == "{" and lang.name != "csharp" and lang.name != "cpp":
            return
        if lang.name == "java" and context == "file":
            return
        closure = lang.name == "java" and body > k and t[body - 1] in (")", "->")
        self._define(name, first, end - 1, closure or lang.name == "csharp" and (body >= 0 and t[j] == "{" or t[j] == "=>"))
        while j < end:
            if t[j] in PAIRS and self.mate[j] > j:
                j = self.mate[j]
            elif t[j] == "<" and lang.name != "c":
                j = max(j, self._past_angle(j, end) - 1)
            elif t[j] == ",":
                n = j + 1
                while n < end and t[n] in ("*", "&"):
                    n += 1
                if n < end and self.is_word(n) and (n + 1 >= end or t[n + 1] in ("=", ",", ";", "[", ":")):
                    self._define(n, first, end - 1, False)
            j += 1

    def _javascript(self, first: int, k: int, end: int, body: int, context: str) -> list[tuple[int, int, str]]:
        t = self.t
        if context == "type" and self.is_word(k):  # fields
            j = k
            while j < end and t[j] in self.language.modifiers and j + 1 < end and (self.is_word(j + 1) or t[j + 1] == "#"):
                j += 1
            if j < end and self.is_word(j) and (j + 1 >= end or t[j + 1] in ("=", ":", ";", "?", "!")):
                owns = any(x in ("=>", "function", "class") for x in t[j:end])
                self._define(j, first, end - 1 - (t[end - 1] == ";"), owns)
        elif "=" in t[k:end]:
            equals = t.index("=", k, end)
            path = t[k:equals]
            exported = path[:1] == ["exports"] or path[:3] == ["module", ".", "exports"]
            if exported and len(path) >= 3 and self.is_word(equals - 1) and t[equals - 1] != "exports":
                owns = equals + 1 < end and (t[equals + 1] in ("function", "class", "async") or "=>" in t[equals:end])
                self._define(equals - 1, first, end - 1, owns)
            return self._bodies(k, end, first, "object" if equals + 1 < end and t[equals + 1] == "{" else "func")
        return self._bodies(k, end, first, "object" if t[k] in ("return", "export") else "func")

    def _named_expressions(self) -> None:
        """Functions and classes with a name that stand within expressions."""
        t, have = self.t, {(d.line, d.col) for d in self.defs}
        for k, x in enumerate(t):
            if x not in ("function", "class") or k and t[k - 1] in (".", "?."):
                continue
            name = k + 1 + (t[k + 1 : k + 2] == ["*"])
            if name + 1 >= len(t) or not self.is_word(name) or t[name] in ("extends", "implements"):
                continue
            j = self.mate[name + 1] + 1 if t[name + 1] == "(" and self.mate[name + 1] > 0 else name + 1
            while j < len(t) and t[j] not in ("{", ";", ")", "}", "="):
                j += 1
            if j < len(t) and t[j] == "{" and self.mate[j] > j and (self.line_of(name), self.at.col(self.o[name])) not in have:
                self._define(name, k - (k > 0 and t[k - 1] == "async"), self.mate[j], True)

    def _pairs(self, k: int, end: int) -> None:
        t = self.t
        while k < end:
            j = k
            while j < end and t[j] != ",":
                j = self.mate[j] + 1 if t[j] in PAIRS and self.mate[j] > j else j + 1
            name = k
            while name < j and t[name] in ("async", "get", "set", "static", "*"):
                name += 1
            if name + 1 < j and self.is_word(name):
                value = t[name + 2 : j]
                if t[name + 1] == ":" and value and (value[0] in ("function", "class", "async") or "=>" in value):
                    self._define(name, k, j - 1, True)
                elif t[name + 1] == "(" and t[j - 1] == "}":
                    self._define(name, k, j - 1, True)
            k = j + 1
