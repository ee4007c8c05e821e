"""Text and JSON forms of results and responses, on the driver for what is shown to a reader."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import EXTENSIONS, extension

#: Names for Markdown fences by extension, where they are not the language's.
FENCE = {ext: lang for lang, all_ in EXTENSIONS.items() for ext in all_.split()} | {"mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "mts": "typescript", "cts": "typescript"}


def location(path: Column, line: Column, start: Column) -> Column:
    """path:line, else path:start, else the path."""
    number = F.coalesce(F.nullif(line, F.lit(0)), F.nullif(start, F.lit(0)))
    return F.concat_ws(":", path, number.cast("string"))


def fence_language(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(FENCE.items()) for x in pair]), extension(path)), F.lit(""))


#: Characters that have an escape of their own in a quoted text.
ESCAPES = {"\a": "\\a", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\v": "\\v", "\f": "\\f", "\r": "\\r", '"': '\\"', "\\": "\\\\"}


def quoted(text: str) -> str:
    """text in double quotes, with escapes for quotes, backslashes and what can't be printed. Lone surrogates stand for bytes
    that are no UTF-8, and are written as those."""

    def said(c: str) -> str:
        code = ord(c)
        if c in ESCAPES:
            return ESCAPES[c]
        if c.isprintable():
            return c
        if 0xDC80 <= code <= 0xDCFF:
            return f"\\x{code - 0xDC00:02x}"
        return f"\\x{code:02x}" if code < 0x80 else f"\\u{code:04x}" if code < 0x10000 else f"\\U{code:08x}"

    return '"' + "".join(map(said, text)) + '"'


def safe(text: str) -> str:
    """text, quoted if a character of it can't be printed."""
    return text if all(c.isprintable() for c in text) else quoted(text)


def safe_path(path: Column) -> Column:
    """As safe(), over a column."""
    pieces = F.transform(F.split(path, ""), _said)
    return F.when(path.rlike(r"[\p{C}\p{Zl}\p{Zp}[\p{Zs}&&[^ ]]]"), F.concat(F.lit('"'), F.array_join(pieces, ""), F.lit('"'))).otherwise(path)


def _said(c: Column) -> Column:
    out = F.when(c == "", c)
    for character, escape in ESCAPES.items():
        out = out.when(c == character, F.lit(escape))
    code, hex_ = F.ascii(c), F.lower(F.hex(F.ascii(c)))
    wide = F.when(code < 0x80, F.concat(F.lit("\\x"), F.lpad(hex_, 2, "0"))).when(code < 0x10000, F.concat(F.lit("\\u"), F.lpad(hex_, 4, "0"))).otherwise(F.concat(F.lit("\\U"), F.lpad(hex_, 8, "0")))
    return out.when(c.rlike(r"[\p{C}\p{Zl}\p{Zp}[\p{Zs}&&[^ ]]]"), wide).otherwise(c)


def fence(code: str) -> str:
    longest = run = 0
    for c in code:
        run = run + 1 if c == "`" else 0
        longest = max(longest, run)
    return "`" * max(3, longest + 1)


def _fenced(code: str, language: str) -> str:
    mark = fence(code)
    return f"{mark}{language}\n{code}\n{mark}\n"


def result_text(result: Mapping[str, object], returns: str) -> str:
    """A location line, or a heading with the code in a fence; files without code have the heading only."""
    path, line, start, end = safe(str(result.get("path", ""))), result.get("line"), result.get("start_line"), result.get("end_line")
    if returns == "locations":
        return f"{path}:{line or start}\n" if line or start and end else f"{path}\n"
    place = f"{path}:{start}-{end}" if start and end else f"{path}:{line}" if line else path
    names = [place, *(str(result[k]) for k in ("kind",) if result.get(k)), *(safe(str(result[k])) for k in ("symbol",) if result.get(k))]
    head = f"# {' '.join(names)}\n"
    code = str(result.get("code") or "")
    if result.get("finding") == "file" and not code:
        return head
    ext = path.rpartition(".")[2] if "." in path.rpartition("/")[2] else ""
    return head + _fenced(code, FENCE.get(ext, ""))


def results_text(results: Sequence[Mapping[str, object]], returns: str) -> str:
    return "".join(result_text(r, returns) for r in results)


def find_text(response: Mapping[str, object], returns: str) -> str:
    head = f"# {safe(str(response['query']))}: {response['matched_as']}\n"
    hint = f"{response['hint']}\n" if response.get("hint") else ""
    return head + hint + results_text(response["results"], returns)  # type: ignore[arg-type]


def changed_text(response: Mapping[str, object], returns: str) -> str:
    out = []
    for side, name, more in (("head", "head_commit", "head_subject"), ("base", "base", "base_commit")):
        if response.get(name):
            out.append(f"# {side} {safe(str(response[name]))}" + (f" {safe(str(response[more]))}" if response.get(more) else "") + "\n")
    if response.get("patch"):
        out.append(_fenced(str(response["patch"]), "diff"))
    if response.get("patch_truncated"):
        out.append("# patch truncated\n")
    return "".join(out) + results_text(response.get("results", []), returns)  # type: ignore[arg-type]


def json_text(responses: Sequence[Mapping[str, object]], verb: str, pretty: bool = False) -> str:
    """One object for one answer of inspect, outline and changed; a list for several, and always for find."""
    value: object = list(responses) if verb == "find" or len(responses) != 1 else responses[0]
    return json.dumps(value, ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":")) + "\n"
