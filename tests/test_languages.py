import random
import re
import time

import pytest

from textquarry.languages import registry
from textquarry.languages.analysis import analyse
from textquarry.languages.scanner import Lexis, blanked

HEADS = [("go", "func (q *Queue) Push(x int) {", "Push"), ("py", "async def poll(self, every=3): pass", "poll"), ("rs", "pub(super) const unsafe fn weigh<T>(x: T) -> u8 { 0 }", "weigh"), ("js", "async function* pages(of) {", "pages"),
         ("ts", "export abstract class Shelf<T> {", "Shelf"), ("c", "static inline unsigned long hash(const char *s) {", "hash"), ("cpp", "template <class T> T clamp(T x) noexcept {", "clamp"), ("java", "final class Bin { synchronized <T> T take() {", "take"),
         ("cs", "partial class Bin { protected internal async Task<int> Take() {", "Take"), ("kt", "inline fun <reified T> List<T>.pick() {", "pick"), ("swift", "public mutating func drain() {", "drain")]


@pytest.mark.parametrize(("ext", "line", "symbol"), HEADS)
def test_heads_of_declarations(ext, line, symbol):
    assert symbol in [d.symbol for d in analyse(f"a.{ext}", line + "\n").defs]


def names(path, source):
    return [d.symbol for d in analyse(path, source).defs]


CASES = {
    "a.go": ('package shelf\n\nimport (\n\t"os"\n\t"strings"\n)\n\nfunc shout(words ...string) {\n\tfor _, w := range words {\n\t\tos.Stdout.WriteString(strings.ToUpper(w))\n\t}\n}\n', ["shout"], 10, (8, 12), (3, 6)),
    "b.go": ("package p\ntype (\n\tU = int\n\tI interface {\n\t\tDo() error\n\t}\n)\nconst a, b = 1, 2\nvar f = func() {\n}\n", ["U", "I", "Do", "a", "b", "f"], 5, (5, 5), None),
    "a.py": ("from csv import reader\nimport sys\n\n\ndef rows(name):\n    with open(name) as source:\n        yield from reader(source)\n", ["rows"], 7, (5, 7), (1, 2)),
    "b.py": ("@d\nclass A:\n    def f(self):\n        return 1\n", ["A", "f"], 4, (3, 4), None),
    "c.py": ("def broken(:\n    x = (1\ndef ok():\n    return 1\n", ["ok"], 4, (3, 4), None),
    "a.rs": ("use std::fs::File;\n\npub fn size_of(name: &str) -> u64 {\n    let file = File::open(name).unwrap();\n    file.metadata().unwrap().len()\n}\nimpl Area for Square { fn area(&self) -> f64 { self.side } }\nenum Unit { Meter, Other(String) }\n", ["size_of", "Square", "area", "Unit", "Meter", "Other"], 5, (3, 6), (1, 1)),
    "a.js": ("import x from 'y';\nclass A {\n  go(a) {\n    return /re{g/;\n  }\n}\nconst f = (q) => {\n  return q;\n};\nexports.n = function () {};\n", ["A", "go", "f", "n"], 4, (3, 5), (1, 1)),
    "a.ts": ("interface I { a: number; m(): void }\nenum E { A, B = 2 }\nnamespace N { export function q(): void {} }\ntype T = string;\n", ["I", "a", "m", "E", "A", "B", "N", "q", "T"], 1, (1, 1), None),
    "a.java": ("import java.util.*;\nclass C {\n  int x, y;\n  C() {\n  }\n  void f(int a) {\n    if (a > 1) { call(); }\n  }\n  enum K { P, Q }\n}\n", ["C", "x", "y", "C", "f", "K", "P", "Q"], 7, (6, 8), (1, 1)),
    "a.c": ("#include <a.h>\n#define MAX(a) \\\n  (a)\ntypedef struct P { int x; } P_t;\nenum E { A, B = 2 };\nint decl(int);\nvoid f(void) {\n  g();\n}\n", ["MAX", "P", "x", "P_t", "E", "A", "B", "decl", "f"], 8, (7, 9), (1, 1)),
    "a.cpp": ("namespace a::b {\nclass C : public B {\n public:\n  C() {}\n  ~C() {}\n  int operator+(int a) const { return a; }\n};\nusing U = int;\n}\n", ["a::b", "C", "C", "~C", "operator+", "U"], 6, (6, 6), None),
    "a.cs": ("using System;\nnamespace N {\n  class C {\n    public int P { get; set; }\n    public void F(int a) { var s = $\"x {a}\"; }\n    enum E { A }\n  }\n}\n", ["N", "C", "P", "F", "E", "A"], 5, (5, 5), (1, 1)),
    "a.kt": ("import b.c\nclass C(val x: Int) {\n  fun f() {\n    g()\n  }\n}\nenum class E { A, B }\ntypealias T = Int\n", ["C", "x", "f", "E", "A", "B", "T"], 4, (3, 5), (1, 1)),
    "a.swift": ("import Foundation\nclass C {\n  let y = \"a \\(z) b\"\n  init() {}\n  func f() {\n    g()\n  }\n}\nenum E { case a, b }\n", ["C", "y", "init", "f", "E", "a", "b"], 6, (5, 7), (1, 1)),
    "a.mod": ("MODULE C;\nFROM A IMPORT B;\nTYPE R = RECORD a: INTEGER; END;\nVAR v: INTEGER;\nPROCEDURE F;\nBEGIN\n  x\nEND F;\nBEGIN\nEND C.\n", ["C", "R", "a", "v", "F"], 7, (5, 8), (2, 2)),
}


@pytest.mark.parametrize("path", CASES)
def test_definitions_scopes_and_imports(path):
    source, symbols, line, scope, imports = CASES[path]
    a = analyse(path, source)
    assert sorted(d.symbol for d in a.defs) == sorted(symbols)
    assert a.navigation(line) == scope
    assert a.import_range() == imports


SAME_LINE = [
    ("Shelf.java", "class Shelf { int a() { return 1; } int b() { return target(2); } int c; }\n", "b"), ("Left.java", "class Left { void x() { if (y) { target(); } } void z() {} }\n", "x"),
    ("Esc.java", "class Esc \\u007b int e() \\u007b return target;\n\\u007d \\u007d\n", "e"), ("di.c", "int one(int x) <% return target + x;\n%>\n", "one"), ("Shelf.cs", "class Shelf { int A() { return 0; } int B() { return target; } }\n", "B"),
    ("File.cs", "namespace Store.Inner; [target(1)] enum Kind {}\n", "Store.Inner"), ("shelf.cpp", "struct Shelf { int a() { return 0; } int b() const { return target; } };\n", "b"), ("shelf.kt", "object Shelf { fun a() = 1; fun b() { target(1) } }\n", "b"),
    ("shelf.swift", "struct Shelf { func a() {} ; func b() { target(1) } }\n", "b"), ("Shelf.mod", "MODULE Shelf; PROCEDURE A; BEGIN x END A; PROCEDURE B; BEGIN y; target(1) END B; BEGIN END Shelf.\n", "B"),
    ("Two.mod", "MODULE Two; PROCEDURE Up; BEGIN target(0);\nEND Up; END Two.\n", "Up"),
]


@pytest.mark.parametrize(("path", "source", "want"), SAME_LINE)
def test_owners_on_one_line(path, source, want):
    a = analyse(path, source)
    col = len(source[: source.index("target")].encode()) + 1
    inside = [o for o in sorted(a.owners_on(1)) if o[0] <= col < o[1]]
    assert inside[-1][2] == want


def test_masks():
    py = analyse("a.py", '"""doc"""\nx = f"{name} b" # c\n')
    assert py.masked(True, True)[1].split() == ["x", "=", "name"] and py.scan.docstrings == [(0, 9)]
    js = analyse("a.js", "a = `t ${f({b: 1})} u`; // c\n")
    assert re.sub(r"\s+", "", js.masked(True, True)[0]) == "a=f({b:1});"
    rust = analyse("a.rs", "let a = r#\"x \" {\"#; let l: &'a str = 'c'; /* /* n */ */ b\n").masked(True, True)[0]
    assert "{" not in rust and "&'a" in rust and rust.rstrip().endswith("b")
    cpp = analyse("a.cpp", 'auto r = R"x(a " ) )x"; f();\n').masked(True, True)[0]
    assert cpp.rstrip().endswith("; f();")
    cs = analyse("a.cs", 'var a = @"x "" y"; g($"{h} {{i}}");\n').masked(True, True)[0]
    assert "h" in cs and "i" not in cs.split("h", 1)[1].replace("if", "") and "y" not in cs
    assert analyse("go.mod", "module example.com/x\n").defs == []


def test_scope_names_prefer_owners_above_and_comments_name_what_follows():
    a = analyse("a.go", "package p\n\nfunc a() {\n}\n\n// about b\nfunc b() {\n}\n")
    assert a.line_names() == ["", "", "a", "a", "", "b", "b", "b"]


def test_cleaning():
    a = analyse("a.py", 'def f():\n    """doc"""\n    return 1  # c\n')
    assert a.clean(True, True) == ["def f():", "", "    return 1"]


@pytest.mark.parametrize("ext", ["go", "py", "rs", "js", "tsx", "java", "c", "cpp", "cs", "kt", "swift", "mod", "zig"])
def test_no_text_fails_and_coordinates_hold(ext):
    random.seed(ext)
    bits = ["{", "}", "(", ")", "[", "]", '"', "'", "`", "/*", "*/", "//", "#", "\n", "\n", " ", "class", "func", "def", "fn", "enum", "struct", "x", "y", "=", ";", ",", ":", "é", "\\", "${", "@", "<", ">", "MODULE M;", "END", "PROCEDURE", "import", "case", "\r\n", "=>", '"""', "R\"(", "r#\"", "#if A\n", "#else\n", "#endif\n", "<b>", "</b>", "<i a={", "/>", "switch q", "operator", "record R(", "template <T>", "new"]
    for _ in range(150):
        source = "".join(random.choice(bits) + random.choice(["", " "]) for _ in range(random.randint(0, 80)))
        a = analyse(f"a.{ext}", source)
        n = len(a.lines)
        for masked in (a.masked(True, True), a.masked(True, False)):
            assert [len(x.encode()) for x in masked] == [len(x.encode()) for x in a.lines]
        assert len(a.clean(True, True)) == n and len(a.line_names()) == n
        for d in a.defs:
            assert 1 <= d.scope_start <= d.line <= n and d.line <= max(d.scope_end, d.line) <= n and 1 <= d.col <= len(a.lines[d.line - 1].encode()) + 1
        for k in range(1, n + 1):
            s, e = a.navigation(k)
            assert 1 <= s <= k <= e <= n
        if (r := a.import_range()) is not None:
            assert 1 <= r[0] <= r[1] <= n
        assert all(1 <= s <= e for s, e, _ in a.regions) and [r[0] for r in a.regions] == sorted({r[0] for r in a.regions})
        a.occurrences(["x", "x.y", "x::y", "operator="], a.masked(True, True))


def test_names_of_lines_take_no_square():
    took = []
    for n in (1_000, 8_000):
        start = time.perf_counter()
        a = analyse("a.zig", "f() {\nx;\n}\n" * n)
        assert a.line_names()[-1] == "f" and a.enclosing(3 * n - 1) == (3 * n - 2, 3 * n)
        took.append(time.perf_counter() - start)
    assert took[1] < 24 * took[0] + 0.5


@pytest.mark.parametrize("ext", ["swift", "mod", "kt", "js", "rs"])
def test_deep_nesting_ends(ext):
    for bit in ("(", "{", "/*", "(*", '"\\(', "`${", "a{", "/"):
        analyse(f"a.{ext}", bit * 4000)


def test_languages_can_be_added():
    registry.register(registry.Language("toy", Lexis(line_comments=("--",), blocks=()), heads={"proc": "func"}), "toy")
    assert names("a.toy", "proc run() {\n} -- proc not() {}\n") == ["run"]
    with pytest.raises(ValueError, match="go"):
        registry.register(registry.Language("other", Lexis()), "go")


def test_what_owns_a_scope():
    owners = lambda path, source: {d.symbol for d in analyse(path, source).defs if d.owns_scope}
    assert owners("a.rs", "trait T { fn r(&self); fn b(&self) {} }\nconst A: i32 = 1;\nconst B: i32 = { 2 };\ntype X = i32;\nmod a;\nmod b { }\n") == {"T", "b", "B"}
    assert owners("a.kt", "class C {\n  val a = 1\n  val b by lazy { 2 }\n  val c: Int get() = 3\n}\n") == {"C", "b", "c"}
    assert owners("a.swift", "struct S {\n  let a = 1\n  var b: Int { 2 }\n  func f()\n}\nenum E { case x }\n") == {"S", "b", "f", "E"}
    assert owners("a.cs", "class C {\n  int f = 1;\n  int P { get; set; }\n  int Q => 2;\n  delegate void D();\n  void M() {}\n}\n") == {"C", "P", "Q", "M"}
    assert owners("a.java", "class C {\n  int a = 1;\n  Runnable r = () -> { run(); };\n  void m();\n}\n") == {"C", "r", "m"}
    assert "y" in [d.symbol for d in analyse("a.ts", "class C { constructor(private y: T, z: U) {} }\n").defs]


def test_names_in_marks():
    assert names("a.kt", "fun `f g`() {}\nval `in` = 1\nclass `Odd one`(val `x y`: Int)\n") == ["f g", "in", "Odd one", "x y"]
    d = next(d for d in analyse("a.kt", "fun `f g`() {}\n").defs)
    assert (d.col, d.owns_scope) == (6, True)
    assert names("a.swift", "prefix operator ~~\npostfix operator ... \ninfix operator <+> : Sum { }\nfunc `is`() {}\nlet x = 1\n") == ["~~", "...", "<+>", "is", "x"]
    assert names("a.c", "int \\u00e9x;\nint a\\U000000e8(void) { return 0; }\n") == ["éx", "aè"]
    assert names("a.cpp", "int \\N{GREEK SMALL LETTER ALPHA}1 = 2;\nint \\N{NO SUCH}x;\n")[0] == "α1"


def test_rarer_declarations():
    assert names("a.java", "@interface N { int v() default 1; String[] w(); }\nrecord P(int a) { P { check(a); } }\n") == ["N", "v", "w", "P", "a", "P"]
    assert names("a.cpp", "auto [p, q] = f();\nconst auto& [r] = g();\nvoid h() { auto [s, t] = f(); }\n") == ["p", "q", "r", "h"]
    assert names("a.cs", "extern alias Z;\nusing T = System.Text;\nclass C { public static explicit operator checked short(C c) => 0; public static C operator checked +(C a, C b) => a; public static C operator -(C a) => a; }\n") == ["Z", "T", "C", "explicit operator checked short", "operator checked+", "operator-"]
    assert names("a.ts", "export as namespace Lib;\nexport { a as namespace };\n") == ["Lib"]
    source = "MODULE M;\nTYPE R = RECORD\n  a: INTEGER;\n  CASE t: BOOLEAN OF\n    TRUE, FALSE: x, y: CHAR; z: REAL |\n    red: w: REAL\n  ELSE v: CHAR\n  END;\n  b: INTEGER\nEND;\nVAR q: R;\nEND M.\n"
    assert sorted(names("a.mod", source)) == sorted(["M", "R", "a", "t", "x", "y", "z", "w", "v", "b", "q"])


def test_damage_is_found_and_mended():
    regions = lambda path, source: analyse(path, source).regions
    assert regions("a.go", "package p\nfunc A() {\n}\n") == [] and regions("a.js", "const a = <b>it's</b>;\n") == []
    a = analyse("a.swift", "struct S {\n  func f() {\n    if x {\n  }\n  func g() {\n  }\n}\n")
    assert a.regions == [(4, 4, "missing")] and [(d.symbol, d.scope_end) for d in a.defs] == [("S", 7), ("f", 4), ("g", 6)]
    assert regions("a.java", 'class A {\n  String s = "open;\n}\n') == [(2, 2, "error")]
    assert regions("a.py", "def f(:\n    pass\n") == [(1, 1, "error")]
    # a name in a damaged region is taken from its line, one outside of it is not
    assert names("a.go", "package p\nfunc A() {\n\tx(\n\t\tfunc inner() {}\n}\n") == ["A", "inner"]
    assert names("a.go", "package p\nfunc A() {\n\tx(\n\t\tfunc() { /* func not() {} */ }\n\t)\n}\n") == ["A"]


def test_conditional_branches_stand_for_one():
    a = analyse("a.c", "#if A\nint f(int x)\n{\n#elif B\nint f(long x)\n{\n#else\nint f(char x)\n{\n#if C\n  g();\n#endif\n#endif\n  return x;\n}\nint h;\n")
    assert [(d.symbol, d.scope_start, d.scope_end) for d in a.defs] == [("f", 2, 15), ("h", 16, 16)] and a.regions == []
    assert {(1, 13), (4, 12), (7, 12), (10, 12)} <= set(a.scopes)
    assert analyse("a.c", "#endif\nint x;\n").regions == [(1, 1, "error")]
    cs = analyse("a.cs", "class A {\n#if X\n  void F() {\n#else\n  int F() {\n#endif\n  }\n  void G() {}\n}\n")
    assert [(d.symbol, d.scope_end) for d in cs.defs] == [("A", 9), ("F", 7), ("G", 8)]


def test_elements_in_code():
    a = analyse("a.tsx", "const id = <T,>(x: T) => x;\nfunction V() {\n  return <><p a='}' b={{c: 1}}>{/* n */}{list.map(x => <i key={x}>it's {x} {\"}\"}</i>)} }</p></>;\n}\nclass After {}\nconst less = a < b;\n")
    assert [(d.symbol, d.scope_end) for d in a.defs] == [("id", 1), ("V", 4), ("After", 5), ("less", 6)] and a.regions == []
    masked = a.masked(True, True)[2]
    assert "it's" not in masked and "list.map" in masked and "/* n" not in masked


def test_names_by_tokens():
    def count(path, symbol, source):
        a = analyse(path, source)
        return {k: [c for s, cols in v for c in cols] for k, v in a.occurrences([symbol], a.masked(True, True)).items()}

    assert count("a.c", "x", "1.x + x + 0x + .5e+x + x1\n") == {1: [7]}
    assert count("a.c", "a.b", "a.b\n") == {}
    assert count("a.java", "f", "1.f + f + 1.5f + f.g\n") == {1: [7, 18]}
    assert count("a.cs", "ToString", "1.ToString(); 1.5.ToString();\n") == {1: [3, 19]}
    assert count("a.cpp", "a::b", "a::b; a ::\n b; a/* a::b */::b; \"a::b\"; a::b::a::b\n") == {1: [1, 7], 2: [5, 29, 35]}
    assert count("a.kt", "a.a.a", "a.a.a.a.a .a\n") == {1: [1, 3, 5, 7]}
    assert count("a.swift", "in", "x.in + `in` + in\n") == {1: [3, 9]}
    assert count("a.cpp", "~T", "~T(); ~ T(); ~Tx();\n") == {1: [1, 7]}


@pytest.mark.parametrize("seed", range(30))
def test_overlapping_sequences_against_all_places(seed):
    from textquarry.languages import occurrences as O

    rng = random.Random(seed)
    stream = [(k, k + 1, rng.choice("ab.")) for k in range(rng.randrange(0, 60))]
    parts = tuple(rng.choice("ab.") for _ in range(rng.randrange(1, 6)))
    assert list(O.matches(stream, parts)) == [k for k in range(len(stream) - len(parts) + 1) if tuple(t for _, _, t in stream[k : k + len(parts)]) == parts]


def test_blanks_take_the_bytes_of_what_was_there():
    text = "a é日🙂\ud800\r\n/* x é */ b"
    spans = [(2, 9), (9, len(text) - 2)]
    plain = lambda c: c if c in "\r\n" else " " * len(c.encode("utf-8", "surrogatepass"))
    assert blanked(text, spans) == "a " + "".join(map(plain, text[2:-2])) + " b"


def test_long_comments_take_linear_time():
    # a file that is mostly one comment, of letters of several bytes, ten of them behind one another
    text = "func F() {\n}\n" + "/* " + "wörter über wörter " * 50_000 + "*/\n" + " " * 300_000
    start = time.process_time()
    a = analyse("a.go", text)
    assert a.masked(True, True) and [d.symbol for d in a.defs] == ["F"]
    assert time.process_time() - start < 0.5


def test_names_of_the_first_lines_are_those_of_all():
    text = "package p\n\nfunc F() {\n\tx()\n}\n\nfunc G() {\n}\n// end\n"
    a = analyse("a.go", text)
    assert [a.line_names(k) for k in range(10)] == [a.line_names()[:k] for k in range(10)]
