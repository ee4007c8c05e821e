import subprocess

import pytest

from textquarry.plans import options as O
from textquarry.plans import verbs as V
from textquarry.plans.options import Options
from textquarry.sources.corpus import Corpus, analysed_lines


@pytest.fixture
def corpus(spark):
    return lambda files: Corpus(spark.createDataFrame(list(files.items()), "path string, content string"))


def got(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("q_ix", "rank").collect()]


GO = "package a\n\nfunc helper() {}\n\nfunc caller() {\n\thelper()\n}\n"


def test_references_come_with_their_scope(corpus):
    c = corpus({"a.go": GO})
    rows = V.find(c, "helper", Options(include="refs"))
    assert got(rows, "kind", "line", "start_line", "end_line", "scope", "code") == [("ref", 6, 5, 7, "caller", "func caller() {\n\thelper()\n}")]
    assert got(V.find(c, "helper", Options(returns="line")), "kind", "line", "code") == [("def", 3, "func helper() {}"), ("ref", 6, "\thelper()")]
    assert got(V.find(c, "helper", Options(returns="context", context=0, include="defs")), "start_line", "end_line") == [(3, 3)]


def test_equal_results_count_once_before_the_limit(corpus):
    c = corpus({"a.go": "package a\n\nfunc first() {\n\tx()\n\tx()\n}\n\nfunc second() {\n\tx()\n}\n"})
    rows = V.find(c, "x", Options(include="refs", limit=1))
    assert got(rows, "scope", "truncated") == [("first", True)]
    assert len(got(V.find(c, "x", Options(include="refs")), "scope")) == 2


def test_limits_are_shared(corpus):
    c = corpus({"a.go": "package a\n\nfunc f() { Alpha(); Bravo() }\n\nfunc g() { Alpha() }\n"})
    queries = ["Alpha", "Bravo", "Missing"]
    options = Options(include="refs", match="symbol", limit=3)
    responses = V.respond(V.find_many(c, queries, options), queries, options)
    assert [(len(r["results"]), r["results_truncated"]) for r in responses] == [(1, True), (1, False), (0, False)]
    options = Options(include="refs", match="symbol", limit=1)
    assert len(V.respond(V.find_many(c, queries, options), queries, options)) == 1


def test_paths_when_no_symbol_matches(corpus):
    c = corpus({"cmd/tool-validate/main.go": "package main\n", "cmd/tool-validate/settings.yaml": "", "cmd/tool-validate/Makefile": "", "x/other.go": "package x\n"})
    options = Options()
    rows = V.find(c, "tool-validate", options)
    assert got(rows, "kind", "path") == [("file", f"cmd/tool-validate/{n}") for n in ("Makefile", "main.go", "settings.yaml")]
    assert V.respond(rows, ["tool-validate"], options)[0]["searched_as"] == ["symbol", "path"]
    nothing = V.respond(V.find(c, "missing", options), ["missing"], options)[0]
    assert (nothing["matched_as"], nothing["results"]) == ("none", []) and nothing["hint"]
    assert got(V.find(c, "tool-validate", Options(exclude_globs=("*.yaml",), path_globs=("cmd/**",), limit=1)), "path", "truncated") == [("cmd/tool-validate/Makefile", True)]


def test_comments_and_strings_are_searched_unless_masked(corpus):
    c = corpus({"a.go": 'package a\n\n// helper\nvar s = "helper"\n\nfunc f() { helper() }\n'})
    assert len(got(V.find(c, "helper", Options(returns="locations")), "line")) == 3
    assert got(V.find(c, "helper", Options(returns="locations", no_comments=True, no_strings=True)), "line") == [(6,)]
    assert got(V.find(c, "f", Options(drop_comments=True)), "kind") == [("def",)]


def test_same_line_owners_and_rust_names(corpus):
    c = corpus({"One.java": "class C { void first() {} void second() { target(); } }\n", "a.rs": "fn f<'target>(x: &'target str) { r#target(); target(); }\n"})
    assert got(V.find(c, "target", Options(include="refs")), "path", "scope") == [("One.java", "second"), ("a.rs", "f")]


def test_inspect(corpus):
    c = corpus({"a.go": 'package a\n\nimport "fmt"\n\nfunc used() { fmt.Println() }\n\nfunc g() { used() }\n\nfunc unused() {}\n'})
    rows = V.inspect(c, ["a.go:5"], Options(include="all"))
    assert got(rows, "kind", "line", "start_line") == [("scope", 5, 5), ("imports", None, 3), ("def", 5, 5), ("ref", 7, 7)]
    assert got(V.inspect(c, ["a.go:5", "a.go:9"], Options(include="refs", limit=1)), "kind", "symbol", "truncated") == [("scope", "used", True), ("scope", "unused", False)]
    for bad in ("a.go:99", "nope.go:1", "../a.go:1"):
        with pytest.raises(ValueError, match="."):
            V.inspect(c, [bad])
    with pytest.raises(ValueError, match="."):
        V.inspect(c, ["a.go:5"], Options(exclude_globs=("a.go",)))


def test_long_scopes_show_the_hit(corpus):
    body = "".join(f"\tx{n} := {n}\n" for n in range(70))
    c = corpus({"a.go": f"package a\n\nfunc long() {{\n{body}\ttarget()\n}}\n"})
    row = V.find(c, "target", Options(include="refs", max_code_lines=10)).first()
    assert row["code_truncated"] and "target()" in row["code"] and row["code"].count("\n") == 9
    assert (row["code_start_line"], row["code_end_line"]) == (66, 75)


def test_outline(corpus):
    c = corpus({"a.go": "package a\n\ntype T struct{}\n\nfunc (t T) M() {}\n"})
    assert got(V.outline(c, ["a.go"]), "symbol", "line", "signature") == [("T", 3, "type T struct{}"), ("M", 5, "func (t T) M() {}")]
    assert got(V.outline(c, ["./a.go"], Options(limit=1, path_globs=("zzz",))), "symbol", "truncated") == [("T", True)]


def test_changed(corpus, spark):
    c = corpus({"a.go": "package a\n\nfunc one() {\n\tx()\n}\n\nfunc two() {\n\ty()\n}\n\nfunc three() {}\n", "empty.go": ""})
    files = spark.createDataFrame([("a.go",), ("gone.go",), ("empty.go",)], "path string")
    lines = spark.createDataFrame([("a.go", 4), ("a.go", 8)], "path string, line_no int")
    rows = V.changed(c, files, lines)
    assert got(rows, "kind", "path", "start_line", "scopes", "changed_lines") == [("changed", "a.go", 1, ["one", "two"], [4, 8]), ("file", "empty.go", None, None, None), ("file", "gone.go", None, None, None)]
    assert got(V.changed(c, files, lines, Options(returns="scope", path_globs=("a.go",))), "start_line", "scope") == [(3, "one"), (7, "two")]
    assert got(V.changed(c, files, lines, Options(returns="locations", limit=1)), "start_line", "truncated") == [(4, True)]


def test_options():
    assert Options().normalised("scope").context == 5 and Options(context=0).normalised("scope").context == 0
    for bad in (Options(include="x"), Options(match="x"), Options(returns="x"), Options(limit=-1), Options(context=-1)):
        with pytest.raises(ValueError, match="."):
            bad.normalised("scope")
    with pytest.raises(ValueError, match="limit"):
        O.capped({"limit": 0}, {"limit": 50})
    assert O.environment_caps({"TEXTQUARRY_MAX_LIMIT": "7", "TEXTQUARRY_MAX_CODE_LINES": ""}) == {"limit": 7}
    for bad in ("0", "-1", "x"):
        with pytest.raises(ValueError, match="MAX_CONTEXT"):
            O.environment_caps({"TEXTQUARRY_MAX_CONTEXT": bad})
    assert O.command_options().no_comments and O.command_options().limit == 50


def test_directories_and_git(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "vendor").mkdir()
    (tmp_path / "pkg/a b.go").write_text("package p\n\nfunc a() {\n\tx()\n}\n")
    (tmp_path / "vendor/v.go").write_text("package v\n")
    assert [r["path"] for r in Corpus.from_directory(spark, str(tmp_path)).files.collect()] == ["pkg/a b.go"]
    assert V.find(Corpus.from_directory(spark, f"file://{tmp_path}"), "x").count() == 1
    try:
        subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    except FileNotFoundError:
        pytest.skip("no git here")
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("add", "pkg")
    run("commit", "-qm", "one")
    (tmp_path / "pkg/a b.go").write_text("package p\n\nfunc a() {\n\ty()\n}\n")
    (tmp_path / "new.go").write_text("package n\n")
    from textquarry.sources.manifests import Changes, is_base_commit

    c = Changes(spark, str(tmp_path))
    corpus = c.corpus()
    assert c.paths() == ["new.go", "pkg/a b.go", "vendor/v.go"]
    assert sorted((r[0], r[1]) for r in c.lines(corpus).collect()) == [("new.go", 1), ("pkg/a b.go", 4)]
    assert "+\ty()" in c.patch() and "+package n" in c.patch() and "+++ b/new.go" in c.patch() and is_base_commit(str(tmp_path), c.head)
    run("add", "-A")
    run("commit", "-qm", "two")
    c = Changes(spark, str(tmp_path), "HEAD~1")
    rows = V.changed(c.corpus(), c.files(), c.lines(c.corpus()), Options(returns="scope", path_globs=("pkg/**",)))
    assert got(rows, "path", "scope") == [("pkg/a b.go", "a")]
    assert sorted(r["path"] for r in c.corpus(whole=True).files.collect()) == ["new.go", "pkg/a b.go", "vendor/v.go"]
    with pytest.raises(ValueError, match="."):
        Changes(spark, str(tmp_path), "--output=x")


def test_hidden_files_are_read_and_links_are_not(spark, tmp_path):
    inside, outside = tmp_path / "root", tmp_path / "outside"
    for folder in (inside / "a/_b", inside / ".d", inside / "node_modules/m", inside / ".git", outside):
        folder.mkdir(parents=True)
    for name in ("a/__init__.py", "a/_priv.py", ".hid.py", "a/b.py", "a/_b/c.py", ".d/e.py", "node_modules/m/f.py", ".git/g.py", "empty.py"):
        (inside / name).write_text("" if name == "empty.py" else f"def target():\n    return '{name}'\n")
    (outside / "h.py").write_text("def target(): pass\n")
    (inside / "link.py").symlink_to(outside / "h.py")
    (inside / "dirlink").symlink_to(outside)
    (inside / "gone.py").symlink_to(outside / "none")
    (inside / "latin.py").write_bytes(b"def target(): # \xe9\n    pass\n")
    corpus = Corpus.from_directory(spark, str(inside))
    want = [".d/e.py", ".hid.py", "a/__init__.py", "a/_b/c.py", "a/_priv.py", "a/b.py", "empty.py", "latin.py"]
    assert sorted(r["path"] for r in corpus.files.collect()) == want
    assert got(V.find(corpus, "target", Options(include="defs")), "path") == [(p,) for p in want if p != "empty.py"]


def test_verbs_read_only_the_files_that_they_answer_about(corpus, spark, tmp_path):
    c = corpus({f"p/f{k}.go": f"package p\n\nfunc F{k}() {{\n\tx{k}()\n}}\n" for k in range(40)}).stored(str(tmp_path / "files"))
    scanned = lambda df: [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation" in line]
    for rows in (V.inspect(c, ["p/f3.go:4"]), V.outline(c, ["p/f3.go"])):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        joins = [x for x in plan.splitlines() if "Join" in x]
        assert scanned(rows) and ("LeftSemi" in plan or "p/f3.go" in plan) and joins
    rows = V.changed(c, spark.createDataFrame([("p/f5.go",)], "path string"), spark.createDataFrame([("p/f5.go", 4)], "path string, line_no int"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= plan.count("Relation [path") - 1 and got(rows, "path", "scope") == [("p/f5.go", "F5")]


def test_language_rules_of_occurrence(corpus):
    c = corpus({"a.c": "int fo\\\no = 1;\nint y = foo + fo;\n", "B.java": "class B { void m() { java . util\n.List x; java /* c */ . util y; } }\n", "k.kt": "fun f() { val `in` = 1; for (x in y) {} }\n"})
    places = lambda q: got(V.find(c, q, Options(returns="locations", match="symbol")), "path", "line")
    assert places("foo") == [("a.c", 1), ("a.c", 3)] and places("fo") == [("a.c", 3)]
    assert places("java.util") == [("B.java", 1), ("B.java", 2)]
    assert places("in") == [("k.kt", 1)]
    assert got(V.find(c, "in", Options(match="symbol")), "kind") == [("def",)] or got(V.find(c, "in", Options(match="symbol")), "kind") == [("ref",)]


def test_the_validator_finds_no_faults(corpus):
    from textquarry.plans import validate

    c = corpus({"a.go": GO, "b.py": "import os\n\n\ndef helper(path):\n    # caller of helper\n    return os.path.join(path, 'helper')\n", "c.js": "function caller() {\n  return helper();\n}\n"})
    assert tuple(validate.report(c).first()) == (validate.symbols(c).count(), validate.report(c).first()["places"], 0, 0)
    assert validate.symbols(c).first()["symbol"] == "helper"


def test_commands(spark, tmp_path, capsys):
    from textquarry.__main__ import main

    (tmp_path / "a.go").write_text(GO)
    assert main(["find", "helper", "--root", str(tmp_path), "--return", "locations"]) == 0
    assert capsys.readouterr().out == "# helper: symbol\na.go:3\na.go:6\n"
    assert main(["outline", "a.go", "nope.go", "--root", str(tmp_path), "--json"]) == 0
    assert '"error"' in capsys.readouterr().out
    assert main(["outline", "nope.go", "--root", str(tmp_path)]) == 1
    assert main(["inspect", "a.go:6", "--root", str(tmp_path), "--include", "all"]) == 0
    assert "# a.go:5-7 scope helper" in capsys.readouterr().out
    assert main(["find", "a", "b", "--limit", "1", "--root", str(tmp_path)]) == 1


def test_a_limit_needs_the_first_files_only(spark, monkeypatch):
    files = spark.createDataFrame([(f"p{k:03}.go", f"package p\n\nfunc f{k}() {{\n\ttarget({k})\n\ttarget(1)\n}}\n" + ("other()\n" if k % 40 == 0 else "")) for k in range(120)], "path string, content string")
    corpus = Corpus.from_table(files)
    for returns in ("scope",):
        options = Options(limit=5, returns=returns)
        want = [tuple(r) for r in V.find_many(corpus, ["target", "other"], options).orderBy("q_ix", "rank").collect()]
        monkeypatch.setattr(V, "FIRST_FILES", 2)
        kept = V._enough(corpus, ["target"], options, corpus.files)
        assert kept.count() < 120
        assert [tuple(r) for r in V.find_many(corpus, ["target", "other"], options).orderBy("q_ix", "rank").collect()] == want
        assert len(want) == 5
        monkeypatch.undo()
    V.release()


def test_names_across_lines_are_found_once(spark):
    files = spark.createDataFrame([("A.java", "class A {\n  int f() {\n    return Store. // Store.Target\n      Target + Store.Target + 1.e5;\n  }\n}\n"), ("b.c", "int f(void) { return 1.e5x + 2.Target; }\n"), ("B.cs", "class B { void F() { Store\n.Target(); } }\n")], "path string, content string")
    found = lambda q: sorted((r["path"], r["line"], r["scope"]) for r in V.find(Corpus.from_table(files), q, Options(include="both", no_comments=True, returns="line")).collect())
    assert found("Store.Target") == [("A.java", 3, "f"), ("A.java", 4, "f"), ("B.cs", 1, "F")]
    assert found("Target") == [("A.java", 4, "f"), ("B.cs", 2, "F")] and found("e5") == [] and found("e5x") == []
    V.release()


def test_what_a_line_is_about(spark):
    lines = [
        ("go", "x := a.B(c.D)", "B"), ("python", "y = a.b.c", "c"), ("python", "f(a.b)", "f"), ("c", "x = p->q + f(y);", "f"), ("c", "x = p->q;", "q"), ("cpp", "v = make<int>(w.x);", "make"),
        ("csharp", "var x = F(a?.B);", "B"), ("csharp", "F<int>(b);", "F"), ("kotlin", "val x = f(g(1))", "f"), ("swift", "let x = a.b(c.d).e", "e"), ("swift", "f(g(1))", "g"),
        ("rust", "outer(inner(1)).last(x);", "last"), ("rust", "assert!(x);", "assert"), ("rust", "self.field;", "field"), ("java", "a.b().c(d(e));", "c"), ("java", "return x;", "x"), ("typescript", "f<T>(g(1))", "f"), ("javascript", "a.b;", "b"), ("zig", "a.b(c)", "b"),
    ]
    df = spark.createDataFrame([(lang, text, []) for lang, text, _ in lines], "lang string, structural string, defs array<struct<symbol:string,col:int>>")
    assert [r[0] for r in df.select(V.best_symbol()).collect()] == [want for *_, want in lines]


def test_changed_analyses_the_lines_that_changed_once(corpus, spark):
    c = corpus({f"p/f{k}.go": f"package p\n\nfunc F{k}() {{\n\tx{k}()\n}}\n" for k in range(9)})
    files = spark.createDataFrame([(f"p/f{k}.go",) for k in range(5)], "path string")
    lines = spark.createDataFrame([("p/f1.go", 4), ("p/f1.go", 4), ("p/f2.go", 4), ("p/f2.go", 99), ("p/f2.go", None), ("p/f8.go", 4)], "path string, line_no int")
    V.release()
    rows = V.changed(c, files, lines)
    # all that follows reads these rows, which are held
    assert sorted((r["path"], r["line_no"]) for r in V._rows[0].collect()) == [("p/f1.go", 4), ("p/f2.go", 4)]
    assert got(rows, "path", "kind", "changed_lines") == [("p/f0.go", "file", None), ("p/f1.go", "changed", [4]), ("p/f2.go", "changed", [4]), ("p/f3.go", "file", None), ("p/f4.go", "file", None)]


def test_lines_that_are_asked_for(spark):
    files = spark.createDataFrame([("a.go", "package a\n\nfunc one() {\n}\n", [3, 3, 1, 0, 9]), ("b.go", "package b\n", [])], "path string, content string, wanted array<int>")
    assert [(r["path"], r["line_no"], r["scope"]) for r in analysed_lines(files, wanted="wanted").collect()] == [("a.go", 1, ""), ("a.go", 3, "one")]
