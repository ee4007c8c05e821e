"""Languages by file extension, and what their declarations look like.

To add a language, ``register`` a Language for its extensions before a corpus is analysed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.paths import LANGUAGES
from .scanner import Lexis


@dataclass(frozen=True)
class Language:
    name: str
    lexis: Lexis
    #: brace, indent, modula
    style: str = "brace"
    #: Statements may end at a line's end.
    newline: bool = False
    #: Words that begin a declaration, with what they declare: type, func, ns, enum, impl, alias, value.
    heads: dict[str, str] = field(default_factory=dict)
    #: NAME(...) before a body, or in a type, is a function.
    c_functions: bool = False
    #: TYPE NAME; in a type or file is a definition.
    c_values: bool = False
    modifiers: frozenset[str] = frozenset()
    imports: tuple[str, ...] = ()
    #: Smallest scopes of equal size: the later start wins.
    later_start: bool = False
    identifier_extra: str = ""
    keeps_blank_lines: bool = False
    position_scopes: bool = True


C_STRINGS = (('(?:u8|[uUL])?"', '"', True, False, None), ("(?:u8|[uUL])?(?<![0-9A-Fa-f])'", "'", True, False, None))
CONTROL = frozenset("if else for while switch do try catch finally return throw new delete sizeof alignof typeof case default when using lock fixed foreach synchronized unsafe checked unchecked defer guard repeat match loop await yield static_assert decltype noexcept requires co_await co_return co_yield".split())
MODIFIERS = frozenset("public private protected internal static final abstract sealed virtual override async extern export default declare readonly const constexpr consteval constinit inline volatile mutable register thread_local explicit friend pub unsafe partial open data inner inline suspend operator infix tailrec external lateinit expect actual annotation value companion enum fileprivate mutating nonmutating required convenience indirect dynamic final lazy weak unowned isolated nonisolated native strictfp transient synchronized default new ref get set accessor vararg crossinline noinline reified typedef".split())

_FUNC, _TYPE, _NS, _ENUM, _ALIAS, _VALUE = "func", "type", "ns", "enum", "alias", "value"
_JS_STRINGS = (('"', '"', True, False, None), ("'", "'", True, False, None), ("`", "`", True, True, r"\$\{"))
_JS = Language(
    "javascript", Lexis(strings=_JS_STRINGS, regex_literals=True), newline=True, later_start=True, identifier_extra="#\\\\", position_scopes=False,
    heads={"function": _FUNC, "class": _TYPE, "const": _VALUE, "let": _VALUE, "var": _VALUE}, c_functions=True, modifiers=MODIFIERS, imports=("import", "require"),
)
_TS = Language(
    "typescript", _JS.lexis, newline=True, later_start=True, identifier_extra="#\\\\", position_scopes=False,
    heads=_JS.heads | {"interface": _TYPE, "enum": _ENUM, "type": _ALIAS, "namespace": _NS, "module": _NS}, c_functions=True, c_values=True, modifiers=MODIFIERS, imports=("import", "require"),
)
_C = Language(
    "c", Lexis(strings=C_STRINGS, preprocessor=True), heads={"struct": _TYPE, "union": _TYPE, "enum": _ENUM}, c_functions=True, c_values=True, modifiers=MODIFIERS - {"enum", "new", "get", "set", "value", "data", "open"}, imports=("#include", "#embed"),
)

LANGUAGE: dict[str, Language] = {
    "go": Language("go", Lexis(strings=(('"', '"', True, False, None), ("`", "`", False, True, None), ("'", "'", True, False, None))), newline=True, heads={"func": _FUNC, "type": _TYPE, "const": _VALUE, "var": _VALUE}, imports=("import",), keeps_blank_lines=True),
    "rust": Language(
        "rust", Lexis(nested=True, strings=(('(?:b|c)?r#*"', None, False, True, None), ('(?:b|c)?"', '"', True, True, None), (r"b?'(?=\\|[^'\n]')", "'", True, False, None))),
        heads={"fn": _FUNC, "struct": _TYPE, "union": _TYPE, "enum": _ENUM, "trait": _TYPE, "impl": "impl", "type": _ALIAS, "const": _VALUE, "static": _VALUE, "mod": _NS, "macro_rules": _FUNC}, modifiers=MODIFIERS, imports=("use", "extern"),
    ),
    "javascript": _JS,
    "typescript": _TS,
    "java": Language("java", Lexis(strings=(('"""', '"""', True, True, None), ('"', '"', True, False, None), ("'", "'", True, False, None))), heads={"class": _TYPE, "interface": _TYPE, "@interface": _TYPE, "enum": _ENUM, "record": _TYPE, "module": _NS}, c_functions=True, c_values=True, modifiers=MODIFIERS - {"enum", "data", "value", "open", "get", "set"}, imports=("import", "requires")),
    "c": _C,
    "cpp": Language("cpp", Lexis(strings=(('(?:u8|[uUL])?R"[^()\\\\\\s]{0,16}\\(', None, False, True, None), *C_STRINGS), preprocessor=True), heads=_C.heads | {"class": _TYPE, "namespace": _NS, "concept": _VALUE, "using": _ALIAS}, c_functions=True, c_values=True, modifiers=_C.modifiers | {"template"}, imports=("#include", "import")),
    "csharp": Language(
        "csharp", Lexis(strings=(('"""+', None, False, True, None), ('@\\$?"|\\$@"', '"', False, True, None), ('\\$"', '"', True, False, r"\{\{|\{"), ('"', '"', True, False, None), ("'", "'", True, False, None)), preprocessor=True),
        heads={"class": _TYPE, "struct": _TYPE, "interface": _TYPE, "enum": _ENUM, "record": _TYPE, "namespace": _NS, "delegate": _FUNC, "event": _VALUE}, c_functions=True, c_values=True, modifiers=MODIFIERS - {"enum", "get", "set"}, imports=("using", "extern"),
    ),
    "kotlin": Language(
        "kotlin", Lexis(nested=True, strings=(('"""', '"""', False, True, r"\$\{"), ('"', '"', True, False, r"\$\{"), ("'", "'", True, False, None))), newline=True,
        heads={"class": _TYPE, "interface": _TYPE, "object": _TYPE, "fun": _FUNC, "val": _VALUE, "var": _VALUE, "typealias": _ALIAS, "constructor": "constructor"}, modifiers=MODIFIERS, imports=("import",),
    ),
    "swift": Language(
        "swift", Lexis(nested=True, strings=(('#+"""|#+"', None, False, True, None), ('"""', '"""', True, True, r"\\\("), ('"', '"', True, False, r"\\\("))), newline=True,
        heads={"class": _TYPE, "struct": _TYPE, "actor": _TYPE, "enum": _ENUM, "extension": "impl", "protocol": _TYPE, "func": _FUNC, "var": _VALUE, "let": _VALUE, "typealias": _ALIAS, "associatedtype": _ALIAS, "macro": _FUNC, "precedencegroup": _TYPE, "init": "constructor", "deinit": "constructor", "subscript": "constructor"}, modifiers=MODIFIERS - {"class"}, imports=("import",),
    ),
    "python": Language("python", Lexis(line_comments=("#",), blocks=(), strings=((r"(?i:(?<!\w)[bur]{1,2})?(?:\"\"\"|''')", None, True, True, None), (r"(?i:(?<!\w)(?:f|rf|fr|t|rt|tr))(?:\"\"\"|''')", None, True, True, r"\{\{|\{"), (r"(?i:(?<!\w)(?:f|rf|fr|t|rt|tr))[\"']", None, True, False, r"\{\{|\{"), (r"[\"']", None, True, False, None)), docstrings=True), style="indent", position_scopes=False),
    "modula-2": Language("modula-2", Lexis(line_comments=(), blocks=(("(*", "*)"), ("<*", "*>")), nested=True, strings=(('"', '"', False, False, None), ("'", "'", False, False, None))), style="modula"),
}
BRACE = Language("", Lexis(), c_functions=True)
_EXTENSIONS: dict[str, tuple[str, str]] = {ext: (name if name in LANGUAGE else {"mjs": "javascript", "cjs": "javascript", "jsx": "javascript"}.get(name, "typescript"), name) for ext, name in LANGUAGES.items()}


def register(language: Language, *extensions: str) -> None:
    """Add a language; an extension that another has is an error."""
    for ext in extensions:
        if ext in _EXTENSIONS:
            raise ValueError(f"extension {ext!r} belongs to {_EXTENSIONS[ext][1]}")
        _EXTENSIONS[ext] = (language.name, language.name)
    LANGUAGE[language.name] = language


def language_of(path: str) -> tuple[Language, str]:
    """The language of a path and the name it is reported by: that of its extension if no language has it."""
    name = path.rpartition("/")[2]
    ext = name.rpartition(".")[2] if "." in name else ""
    if ext in _EXTENSIONS:
        kind, reported = _EXTENSIONS[ext]
        return LANGUAGE[kind], reported
    return BRACE, ext


def is_registered(path: str) -> bool:
    name = path.rpartition("/")[2]
    return "." in name and name.rpartition(".")[2] in _EXTENSIONS
