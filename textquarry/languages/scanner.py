"""Comments and strings of a source text, as spans, and texts with spans blanked."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

Span = tuple[int, int]


@dataclass(frozen=True)
class Lexis:
    """What a language's comments and literals look like."""

    line_comments: tuple[str, ...] = ("//",)
    blocks: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    nested: bool = False
    #: (opening regex, closing text or None for the same quote, escapes?, may span lines?, opening of code inside or None)
    strings: tuple[tuple[str, str | None, bool, bool, str | None], ...] = (('"', '"', True, False, None), ("'", "'", True, False, None))
    regex_literals: bool = False
    docstrings: bool = False
    preprocessor: bool = False


@dataclass
class Scan:
    comments: list[Span] = field(default_factory=list)
    strings: list[Span] = field(default_factory=list)
    docstrings: list[Span] = field(default_factory=list)
    #: Tags and texts of elements in code (JSX), with the character that stands for each to a parser.
    markup: list[tuple[int, int, str]] = field(default_factory=list)


#: After these a slash begins a regular expression.
BEFORE_REGEX = set("(,=:[!&|?{};+-*%~^<>") | {""}
WORDS_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "yield", "await"}
JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*")


ELEMENT = re.compile(r"<(?=[A-Za-z_$>])(?!\s*[\w$]+\s*(?:,|extends\b))")
IN_TAG = re.compile(r"""[{"'<]|/?>|/\*""")
IN_CHILDREN = re.compile(r"[{<]")
WORDS_BEFORE_ELEMENT = WORDS_BEFORE_REGEX | {"default"}


class Scanner:
    def __init__(self, lexis: Lexis, elements: bool = False):
        self.lexis = lexis
        arms = [f"(?P<line>{'|'.join(map(re.escape, lexis.line_comments))})"] if lexis.line_comments else []
        arms += [f"(?P<block>{'|'.join(re.escape(a) for a, _ in lexis.blocks)})"] if lexis.blocks else []
        arms += [f"(?P<s{k}>{opening})" for k, (opening, *_rest) in enumerate(lexis.strings)]
        if lexis.regex_literals:
            arms.append("(?P<slash>/)")
        if elements:
            arms.append("(?P<element><)")
        arms.append(r"(?P<brace>[{}()])")
        self.token = re.compile("|".join(arms))
        self.closers = dict(lexis.blocks)
        self.block_marks = {a: re.compile(f"{re.escape(a)}|{re.escape(b)}") for a, b in lexis.blocks}

    def scan(self, text: str) -> Scan:
        out = Scan()
        # Literals and elements that code inside them interrupts wait on a stack (kind, closing text, brackets open around
        # them), so depth has no limit. An element's kind is -1 - the elements that are open, its text is the mode.
        waiting: list[tuple[int, str, int]] = []
        at, depth, n = 0, 0, len(text)
        while at < n:
            m = self.token.search(text, at)
            if m is None:
                break
            kind, start, at = m.lastgroup or "", m.start(), m.end()
            if kind == "line":
                end = text.find("\n", at)
                at = n if end < 0 else end
                out.comments.append((start, at))
            elif kind == "block":
                at = self._block_end(text, m[0], at)
                out.comments.append((start, at))
            elif kind == "slash":
                if (r := JS_REGEX.match(text, start)) and self._regex_may_begin(text, start):
                    at = r.end()
                    out.strings.append((start, at))
            elif kind == "element":
                if not self._element_begins(text, start):
                    continue
                at, state = self._markup(text, start + 1, 1, "tag" if text[at : at + 1] != ">" else "open", start, out)
                if state:
                    waiting.append((*state, depth))
                    depth = 0
            elif kind == "brace" and m[0] in "{(":
                depth += 1
            elif kind == "brace" and not (waiting and depth == 0):
                depth -= 1
            else:
                if kind == "brace":
                    number, close, depth = waiting.pop()
                    if number < 0:
                        at, state = self._markup(text, at, -1 - number, close, start, out)
                        if state:
                            waiting.append((*state, depth))
                            depth = 0
                        continue
                else:
                    number = int(kind[1:])
                    close = self._closing(m[0], self.lexis.strings[number][1])
                at, code = self._string_end(text, at, number, close)
                out.strings.append((start, at))
                if code:
                    waiting.append((number, close, depth))
                    depth = 0
        return out

    @staticmethod
    def _element_begins(text: str, at: int) -> bool:
        """Whether the < at a place opens an element: a value is expected there, and a tag follows."""
        if not ELEMENT.match(text, at):
            return False
        before = text[max(0, at - 400) : at].rstrip()
        if not before or before[-1] in BEFORE_REGEX - {"<"}:
            return True
        word = re.search(r"[A-Za-z_$][\w$]*$", before)
        return bool(word and word[0] in WORDS_BEFORE_ELEMENT)

    @staticmethod
    def _markup(text: str, at: int, open_: int, mode: str, start: int, out: Scan) -> tuple[int, tuple[int, str] | None]:
        """Read markup from at on, with so many elements open: in a ``tag``, behind ``<`` of a fragment (``open``) or among
        ``children``. Where code begins in it, what waits for its end: the number of open elements, coded, and the mode."""
        first = "0" if mode != "children" and text[start] == "<" else " "
        n = len(text)
        while at < n:
            if mode == "open":
                at, mode = at + 1, "children"
            elif mode == "tag":
                m = IN_TAG.search(text, at)
                if m is None:
                    break
                at = m.end()
                if m[0] == "{":
                    out.markup.append((start, at - 1, first))
                    out.markup.append((at - 1, at, ","))
                    return at, (-1 - open_, "tag")
                if m[0] in "\"'":
                    end = text.find(m[0], at)
                    at = n if end < 0 else end + 1
                    out.strings.append((m.start(), at))
                elif m[0] == "/*":
                    end = text.find("*/", at)
                    at = n if end < 0 else end + 2
                    out.comments.append((m.start(), at))
                elif m[0] == "/>":
                    open_, mode = open_ - 1, "children"
                elif m[0] == ">":
                    mode = "children"
            else:
                m = IN_CHILDREN.search(text, at)
                end = m.start() if m else n
                if text[at:end].strip():
                    out.strings.append((at, end))
                if m is None:
                    at = n
                    break
                at = m.end()
                if m[0] == "{":
                    out.markup.append((start, at - 1, first))
                    out.markup.append((at - 1, at, ","))
                    return at, (-1 - open_, "children")
                if text.startswith("/", at):
                    end = text.find(">", at)
                    at, open_ = n if end < 0 else end + 1, open_ - 1
                else:
                    open_, mode = open_ + 1, "open" if text.startswith(">", at) else "tag"
            if not open_:
                break
        out.markup.append((start, at, first))
        return at, None

    @staticmethod
    def _closing(opening: str, closing: str | None) -> str:
        if closing is None:  # the quote itself, or Rust's and Swift's hashes the other way round, or C++'s delimiter
            if (m := re.search(r'R"([^()\\\s]*)\($', opening)) is not None:
                return f'){m[1]}"'
            hashes = opening.count("#")
            quote = re.search(r"(\"+|'+|`+)#*$", opening)
            return (quote[1] if quote else '"') + "#" * hashes
        return closing

    def _string_end(self, text: str, at: int, number: int, close: str) -> tuple[int, bool]:
        """Where the literal's text from at on ends, and whether code begins there."""
        opening, _, escapes, many_lines, code = self.lexis.strings[number]
        stops = [re.escape(close)] + ([code] if code else []) + ([r"\\[\s\S]"] if escapes else []) + ([] if many_lines else ["\n"])
        stop = _pattern("|".join(f"(?:{s})" for s in stops))
        while (m := stop.search(text, at)) is not None:
            if m[0] == close:
                if opening.startswith("@") and text.startswith('"', m.end()):  # a doubled quote in a verbatim literal
                    at = m.end() + 1
                    continue
                return m.end(), False
            if m[0] == "\n" and not many_lines:
                return m.start(), False
            if code and m[0] != "{{" and re.fullmatch(code, m[0]):
                return m.end(), True
            at = m.end()
        return len(text), False

    def _block_end(self, text: str, opening: str, at: int) -> int:
        close = self.closers[opening]
        if not self.lexis.nested:
            end = text.find(close, at)
            return len(text) if end < 0 else end + len(close)
        depth = 1
        for m in self.block_marks[opening].finditer(text, at):
            depth += 1 if m[0] == opening else -1
            if not depth:
                return m.end()
        return len(text)

    @staticmethod
    def _regex_may_begin(text: str, at: int) -> bool:
        k = at - 1
        while k >= 0 and text[k] in " \t":
            k -= 1
        if k < 0 or text[k] in BEFORE_REGEX or text[k] == "\n":
            return True
        word = re.search(r"[A-Za-z_$][\w$]*$", text[max(0, k - 20) : k + 1])
        return bool(word and word[0] in WORDS_BEFORE_REGEX)


_patterns: dict[str, re.Pattern[str]] = {}


def _pattern(source: str) -> re.Pattern[str]:
    if source not in _patterns:
        _patterns[source] = re.compile(source)
    return _patterns[source]


#: A space for each byte but those of line ends.
BLANK = bytes(b if b in b"\r\n" else 32 for b in range(256))


def blanked(text: str, spans: list[Span]) -> str:
    """text with a space for each byte of the spans; line ends stay."""
    out, at = [], 0
    for start, end in spans:
        if start < at:
            start = at
        if end <= start:
            continue
        out.append(text[at:start])
        out.append(text[start:end].encode("utf-8", "surrogatepass").translate(BLANK).decode("ascii"))
        at = end
    out.append(text[at:])
    return "".join(out)
