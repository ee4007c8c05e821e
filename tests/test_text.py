import itertools

import pytest
from pyspark.sql import functions as F

from textquarry.functions import paths as P
from textquarry.functions import text as T


def values(spark, rows, schema, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_lines_have_no_terminators_and_no_phantom(spark):
    rows = [("",), ("x",), ("x\n",), ("x\n\n",), ("a\r\nb\r",), ("a\r\r\nb",)]
    assert values(spark, rows, "c string", T.source_lines(F.col("c"))) == [[], ["x"], ["x"], ["x", ""], ["a", "b"], ["a\r", "b"]]


@pytest.mark.parametrize(("symbol", "line", "n"), [("a.a", "a.a.a", 2), ("foo", "foo foobar _foo foo", 2), ("é", "é éé é", 2), ("x", "", 0), ("f(", "f(f(", 1)])
def test_occurrences_overlap_and_stop_at_identifiers(spark, symbol, line, n):
    columns = [T.occurrence_count(F.col("c"), symbol), F.size(T.occurrence_columns(F.col("c"), symbol))]
    assert values(spark, [(line,)], "c string", *columns) == [(n, n)]


def test_occurrence_columns_are_bytes(spark):
    assert values(spark, [("é foo foo",)], "c string", T.occurrence_columns(F.col("c"), "foo")) == [[4, 8]]


def test_comments_in_quotes_stay(spark):
    rows = [('x := "// no" // yes',), ("'#' # c",), ("plain  ",)]
    assert values(spark, rows, "c string", T.without_slash_comment(F.col("c"))) == ['x := "// no"', "'#' # c", "plain"]
    assert values(spark, rows, "c string", T.without_hash_comment(F.col("c")))[1] == "'#'"


def test_block_comments_keep_newlines_and_masks_keep_widths(spark):
    assert values(spark, [("a/* x\ny */b",)], "c string", T.without_c_comments(F.col("c"))) == ["a \nb"]
    text = 'a "é" `b\nc`'
    masked = values(spark, [(text,)], "c string", T.with_blank_strings(F.col("c")))[0]
    assert len(masked.encode()) == len(text.encode())
    assert masked.split("\n")[0].strip() == "a"


def test_very_long_literals_do_not_exhaust_the_stack(spark):
    text = '"' + "x" * 400_000 + '" // c'
    assert len(values(spark, [(text,)], "c string", T.without_slash_comment(F.col("c")))[0]) == 400_002


@pytest.mark.parametrize(("s", "e", "focus", "most", "want"), [(1, 100, 50, 10, (45, 54)), (3, 75, 74, 10, (66, 75)), (1, 100, 1, 10, (1, 10)), (5, 9, 7, 10, (5, 9)), (1, 9, 99, 4, (1, 4))])
def test_snippet_windows(spark, s, e, focus, most, want):
    c = [F.col(x) for x in "sef"]
    assert values(spark, [(s, e, focus)], "s int, e int, f int", T.snippet_start(*c, most), T.snippet_end(*c, most)) == [want]


def test_bounded_prefixes_against_a_plain_version(spark):
    texts = ["".join(t) for n in range(7) for t in itertools.product("a\n", repeat=n)]
    for lines, size in ((2, 4), (1, 3), (3, 2)):
        prefix, cut = T.bounded_prefix(F.col("c"), lines, size)
        got = values(spark, [(t,) for t in texts], "c string", prefix, cut)
        for t, (p, c) in zip(texts, got, strict=True):
            whole = t.rstrip("\n")
            want = "\n".join(whole.split("\n")[:lines])[:size]
            assert (p, c) == (want, want != whole), (t, lines, size)


def test_long_lines_take_one_pass(spark):
    lines = [("é" + "x " * 300_000 + "foo foo,foofoo foo",), ("foo a.foo",), ("",), ("foofoo",)]
    got = values(spark, lines, "c string", T.occurrence_columns(F.col("c"), "foo"))
    at = 2 + 600_000
    assert got == [[at + 1, at + 5, at + 16], [1, 7], [], []]
    assert values(spark, [("a.a.a",)], "c string", T.occurrence_columns(F.col("c"), "a.a")) == [[1, 3]]


def test_prefixes_are_found_by_halves(spark):
    for n in range(0, 14):
        text = "aé🙂b" * 3
        want = next(text[:k] for k in range(len(text), -1, -1) if len(text[:k].encode()) <= n)
        if n:
            assert values(spark, [(text,)], "c string", T.bounded_prefix(F.col("c"), 0, n)[0]) == [want]
    assert len(values(spark, [("y" * 3_000_000,)], "c string", T.bounded_prefix(F.col("c"), 0, 2_000_000)[0])[0]) == 2_000_000


def test_bounded_json_and_fences(spark):
    got = values(spark, [("é" * 50,), ("ab",)], "c string", T.bounded_json(F.col("c"), 20))
    assert got[1] == "ab" and got[0].endswith("…") and len(f'"{got[0]}"'.encode()) <= 20
    assert values(spark, [("a ```` b",), ("x",)], "c string", T.fence(F.col("c"))) == ["`````", "```"]


@pytest.mark.parametrize(
    ("pattern", "path", "want"),
    [("_test.go", "a/x_test.go", True), ("*_test.go", "a/x_test.go", True), ("cmd/**", "cmd/a/b.go", True), ("cmd/**", "cmdx/a.go", False), ("**/*_test.go", "a/b/x_test.go", True), ("[", "a[b", True),
     ("[a-c].go", "d/b.go", True), ("[^a-c].go", "d/b.go", False), ("a/*/c", "a/b/d/c", False), ("", "a", False), ("?.py", "x/ab.py", False), ("zzz", "a/b.go", False), ("\\*.go", "*.go", True)],
)
def test_globs(spark, pattern, path, want):
    assert values(spark, [(path,)], "p string", P.glob_match(F.col("p"), pattern)) == [want]


def test_path_filters_ranks_and_languages(spark):
    paths = [("cmd/a.go",), ("cmd/a_test.go",), ("x/cmd",), ("doc/cmdline.md",), ("Makefile",)]
    keep = P.path_filter(F.col("p"), ["cmd"], ["_test.go"])
    assert values(spark, paths, "p string", keep) == [True, False, True, True, False]
    assert values(spark, paths, "p string", P.match_rank(F.col("p"), "./cmd")) == [2, 2, 1, 3, None]
    assert values(spark, [("a.hpp",), ("a.mjs",), ("a.zig",), ("a",)], "p string", P.language(F.col("p"))) == ["cpp", "mjs", "zig", ""]
    assert values(spark, [("vendor/x.go",), ("a/node_modules/x.js",), ("a/vendor",)], "p string", P.excluded(F.col("p"))) == [True, True, False]


@pytest.mark.parametrize("bad", ["", "/etc/passwd", "../x", "a/../../x", "a\0b"])
def test_unsafe_paths(bad):
    with pytest.raises(ValueError, match="."):
        P.safe_relative(bad)
    assert P.safe_relative("./a/../b.go") == "b.go"
    assert P.parse_location("a:b.go:12") == ("a:b.go", 12)
    with pytest.raises(ValueError, match="."):
        P.parse_location("a.go")


@pytest.mark.parametrize(
    ("language", "yes", "no"),
    [
        ("c", ["x$1", "\\u00e9x", "a\\U000000E8", "_"], ["", "1a", "a-b", "\\uD800", "a\\u002D", "a\n", "\\u00e"]),
        ("rust", ["r#type", "été", "_a"], ["_", "type", "r#self", "r#", "$a"]),
        ("java", ["$a", "€", "a\x01"], ["1", "a.b"]),
        ("csharp", ["@class", "a1"], ["@", "a@", "$"]),
        ("go", ["ä1"], ["a$", "1"]),
        ("modula", ["A_1"], ["é"]),
        ("typescript", ["$", "a\u200d"], ["\u200da"]),
        ("swift", ["größe"], ["9"]),
    ],
)
def test_identifiers_of_languages(spark, language, yes, no):
    words = [(w,) for w in [*yes, *no]]
    assert values(spark, words, "w string", T.is_identifier(F.col("w"), language)) == [True] * len(yes) + [False] * len(no)


def test_universal_names(spark):
    words = [("\\u00e9\\U0001F600x",), ("plain",), ("\\uZZ \\U00110000",), (None,)]
    assert values(spark, words, "w string", T.universal_names(F.col("w"))) == ["é\U0001F600x", "plain", "\\uZZ \\U00110000", None]
