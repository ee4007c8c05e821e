"""Options of the verbs: values, defaults, checks."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

RETURNS = ("locations", "line", "context", "scope")
INCLUDES = ("defs", "refs", "both", "symbol", "scope", "imports", "all")
#: What the commands of a verb take, where it's not all of them.
INCLUDES_OF = {"find": ("defs", "refs", "both")}
MATCHES = ("auto", "symbol", "path")
DEFAULT_CONTEXT, DEFAULT_CODE_LINES, DEFAULT_PATCH_LINES = 5, 80, 400


@dataclass(frozen=True)
class Options:
    """context None is the default of five lines, 0 none; limit 0 is no limit. The library searches comments and strings."""

    include: str = "both"
    match: str = "auto"
    returns: str = ""
    context: int | None = None
    limit: int = 0
    path_globs: tuple[str, ...] = ()
    exclude_globs: tuple[str, ...] = ()
    changed_only: bool = False
    drop_comments: bool = False
    drop_docstrings: bool = False
    no_comments: bool = False
    no_strings: bool = False
    max_code_lines: int = 0
    max_patch_lines: int = 0

    def normalised(self, returns: str) -> Options:
        """With defaults filled in, for a verb that returns ``returns`` if not told otherwise; ValueError if a value is wrong."""
        out = replace(
            self,
            include=self.include or "both",
            match=self.match or "auto",
            returns=self.returns or returns,
            context=DEFAULT_CONTEXT if self.context is None else self.context,
            max_code_lines=self.max_code_lines or DEFAULT_CODE_LINES,
            max_patch_lines=self.max_patch_lines or DEFAULT_PATCH_LINES,
        )
        for name, value, allowed in (("return", out.returns, RETURNS), ("include", out.include, INCLUDES), ("match", out.match, MATCHES)):
            if value not in allowed:
                raise ValueError(f"unsupported {name} {value!r}; choose one of {', '.join(allowed)}")
        for name in ("context", "limit", "max_code_lines", "max_patch_lines"):
            if getattr(out, name) < 0:
                raise ValueError(f"{name} must not be negative")
        return out

    @property
    def masks_comments(self) -> bool:
        return self.no_comments or self.drop_comments


def environment_caps(environment: Mapping[str, str]) -> dict[str, int]:
    """The caps that TEXTQUARRY_MAX_CONTEXT, _LIMIT, _CODE_LINES and _PATCH_LINES set; ValueError for one that is no positive number."""
    out = {}
    for name in ("context", "limit", "max_code_lines", "max_patch_lines"):
        variable = f"TEXTQUARRY_MAX_{name.removeprefix('max_').upper()}"
        if said := environment.get(variable, "").strip():
            if not said.isascii() or not said.isdigit() or int(said) < 1:
                raise ValueError(f"{variable} must be a positive number, not {said!r}")
            out[name] = int(said)
    return out


def capped(values: Mapping[str, int], caps: Mapping[str, int]) -> None:
    """ValueError for a value above its cap; a capped limit, code or patch size of 0, which means none, is above it too."""
    for name, cap in caps.items():
        value = values.get(name, 0)
        if value > cap or value == 0 and name in ("limit", "max_code_lines", "max_patch_lines"):
            raise ValueError(f"{name} must be between {0 if name == 'context' else 1} and {cap}")


def command_options(include_comments: bool = False, include_strings: bool = False, limit: int = 50, **values: object) -> Options:
    """Options as the command line takes them: comments and strings are left out unless asked for, and there is a limit."""
    verb = str(values.pop("verb", "find"))
    allowed = INCLUDES_OF.get(verb, INCLUDES)
    if values.get("include", allowed[0]) not in allowed:
        raise ValueError(f"{verb} includes one of {', '.join(allowed)}")
    return Options(no_comments=not include_comments, no_strings=not include_strings, limit=limit, **values)
