import random

from pyspark.sql import functions as F

from textquarry.operators import diffs, ranges, results, search


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_context_ranges_merge_neighbours(spark):
    hits = spark.createDataFrame([("a", n, 100) for n in (10, 13, 40)], "path string, line_no int, total int")
    assert rows(ranges.context_ranges(hits, ["path"], 5)) == [("a", 5, 18), ("a", 35, 45)]


def test_merge_and_gaps_against_sets(spark):
    random.seed(3)
    spans = [("p", a, a + random.randint(1, 5)) for a in (random.randint(0, 60) for _ in range(12))]
    merged = ranges.merged_ranges(spark.createDataFrame(spans, "path string, s int, e int"), ["path"], gap=0)
    covered = {x for _, a, b in spans for x in range(a, b)}
    assert {x for _, a, b in rows(merged) for x in range(a, b)} == covered
    left = ranges.gaps(merged, ["path"], F.lit(0), F.lit(80))
    assert {x for _, a, b in rows(left) for x in range(a, b)} == set(range(80)) - covered


def test_smallest_scopes_against_all(spark):
    random.seed(4)
    scopes = [("p", a, a + random.choice([0, 3, 10, 200, 9000])) for a in (random.randint(1, 400) for _ in range(60))]
    hits = [("p", n) for n in range(1, 450, 7)]
    got = rows(ranges.scopes_of(spark.createDataFrame(hits, "path string, line_no int"), spark.createDataFrame(scopes, "path string, s int, e int")))
    want = []
    for p, n in hits:
        inside = [(e - s, s, e) for _, s, e in scopes if s <= n <= e]
        want.append((p, n, *(min(inside)[1:] if inside else (n, n))))
    assert got == sorted(want)


def test_fair_shares(spark):
    def shares(counts, limit):
        df = spark.createDataFrame(list(enumerate(counts)), "q_ix int, n long")
        return [r["share"] for r in results.fair_shares(df, limit).orderBy("q_ix").collect()]

    assert shares([2, 1, 0], 3) == [1, 1, 0]
    assert shares([2, 1, 0], 1) == [1, None, None]
    assert shares([5, 9, 9], 9) == [3, 3, 3]
    assert shares([1, 9, 9], 9) == [1, 4, 4]
    assert shares([2, 3], 0) == [2, 3]


def test_first_rows_and_fallback(spark):
    df = spark.createDataFrame([(0, "b", 2), (0, "a", 1), (0, "a", 3), (1, "c", 1)], "q_ix int, k string, pos int")
    assert rows(results.first_of_each(df, ["q_ix", "k"], ["pos"])) == [(0, "a", 1), (0, "b", 2), (1, "c", 1)]
    other = spark.createDataFrame([(1, "x", 9), (2, "y", 9)], "q_ix int, k string, pos int")
    assert (2, "y", 9) in rows(results.first_or_second(df, other)) and (1, "x", 9) not in rows(results.first_or_second(df, other))


def test_presentation_orders(spark):
    df = spark.createDataFrame([(0, "a", "ref", 1), (0, "a", "def", 2), (0, "b", "ref", 3)], "q_ix int, path string, kind string, pos int")
    assert [r["pos"] for r in results.definitions_first(df).orderBy("place").collect()] == [2, 1, 3]
    assert [r["pos"] for r in results.distinct_files_first(df).orderBy("place").collect()] == [1, 3, 2]


def test_classified_and_counterparts(spark):
    hits = spark.createDataFrame([("a", 1, "x", 2), ("a", 2, "x", 1), ("a", 3, "x", 1)], "path string, line_no int, symbol string, n long")
    defs = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x")], "path string, line_no int, symbol string")
    assert sorted((r["line_no"], r["kind"]) for r in results.classified(hits, defs).collect()) == [(1, "def"), (1, "ref"), (2, "def"), (3, "ref")]
    paths = spark.createDataFrame([("a.go",), ("a_test.go",), ("b.go",)], "path string")
    assert rows(results.counterparts(paths)) == [("a_test.go", "a.go")]


def test_column_reconciliation(spark):
    df = spark.createDataFrame([([3, 3, 5], [3], [9])], "f array<int>, r array<int>, a array<int>")
    assert df.select(search.reconciled_columns(F.col("f"), F.col("r"), F.col("a"))).first()[0] == [3, 5, 9]


def test_hunks(spark):
    df = spark.createDataFrame([("a", "@@ -2,2 +4,3 @@ f", 99), ("a", "@@ -10 +12,0 @@", 99), ("a", "x", 99), ("b", "@@ -1 +50,9 @@", 3), ("c", "@@ -1,4 +0,0 @@", 1)], "path string, header string, total int")
    assert rows(diffs.changed_lines(df)) == [("a", 4), ("a", 5), ("a", 6), ("a", 12), ("b", 3), ("c", 1)]
    patch = spark.createDataFrame([("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n+++ b/y\n@@ -3 +4,2 @@\n",)], "patch string")
    assert rows(diffs.patch_headers(patch)) == [("x", "@@ -1 +1 @@"), ("y", "@@ -3 +4,2 @@")]


def test_revisions(spark):
    old = spark.createDataFrame([("a", "1\n2\n3\n"), ("b", "x"), ("c", "y")], "path string, content string")
    new = spark.createDataFrame([("a", "1\n3\n4\n"), ("c", "y"), ("d", "z\n")], "path string, content string")
    assert rows(diffs.compared(old, new)) == [("a", "modified"), ("b", "deleted"), ("d", "added")]
    assert rows(diffs.lines_changed_between(old, new)) == [("a", 1), ("a", 3), ("d", 1)]


def test_symbol_index(spark):
    lines = spark.createDataFrame([("a", 1, "foo foo return bar1 x"), ("a", 2, "foo")], "path string, line_no int, line string")
    index = search.symbol_index(lines)
    assert rows(index.select("symbol", "line_no")) == [("bar1", 1), ("foo", 1), ("foo", 2)]
    assert rows(search.frequent_symbols(index, 2, 9, 5)) == [("foo", 2)]


def test_touching_and_outside_against_all_pairs(spark):
    random.seed(5)
    span = lambda n: [(random.choice("pq"), a, a + random.choice([0, 1, 4, 30])) for a in (random.randint(0, 200) for _ in range(n))]
    asked, regions = [(*x, k) for k, x in enumerate(span(80))], span(25)
    got = rows(ranges.touching_only(spark.createDataFrame(asked, "path string, s int, e int, k int"), spark.createDataFrame(regions, "path string, s int, e int")))
    assert got == sorted(r for r in asked if any(p == r[0] and s <= r[2] and r[1] <= e for p, s, e in regions))
    points = [(k, p, s) for p, s, _, k in asked]
    left = rows(ranges.outside(spark.createDataFrame(points, "k int, path string, at int"), spark.createDataFrame(regions, "path string, s int, e int")))
    assert left == sorted(x for x in points if not any(p == x[1] and s <= x[2] < e for p, s, e in regions))
    none = spark.createDataFrame([], "path string, s int, e int")
    assert ranges.outside(spark.createDataFrame(points, "k int, path string, at int"), none).count() == len(points)


def test_identities_of_two_sources(spark):
    first = [("a", 5, 6, False), ("a", 3, 9, True), ("a", 4, 12, True), ("b", 7, 8, False), ("b", 2, 3, False)]
    second = [("a", 1, 99, True, 1), ("c", 4, 5, False, 8), ("c", 1, 2, True, 7)]
    got = results.merged_by_identity(spark.createDataFrame(first, "n string, s long, e long, owns boolean"), spark.createDataFrame(second, "n string, s long, e long, owns boolean, pos int"), ["n"])
    assert rows(got) == [("a", 3, 12, True), ("b", 2, 8, False), ("c", 1, 2, True)]


def test_shared_limit_answers_more_queries_than_are_broadcast(spark, monkeypatch):
    for most in (results.MOST_QUERIES, 100):
        monkeypatch.setattr(results, "MOST_QUERIES", most)
        queries = spark.range(10_005).selectExpr("CAST(id AS INT) AS q_ix")
        rows = queries.selectExpr("q_ix", "'p' AS path")
        got = results.shared_limit(rows, queries, 20_000, ["path"])
        assert got.count() == 10_005 and got.where("truncated OR rank <> 1").count() == 0


def test_numbers_without_a_task_for_all(spark):
    rng = random.Random(2)
    rows = [(q, rng.randrange(2), f"d{rng.randrange(60)}/f", rng.randrange(9)) for q in (0, 1, 1, 1) for _ in range(300)] + [(2, 0, "x", 1), (0, 0, None, 3)]
    df = spark.createDataFrame(rows, "q_ix int, match_rank int, path string, line int").repartition(5)
    order = ["match_rank", "path", "line"]
    numbered = results.numbered(df, ["q_ix"], order, "path", df)
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan
    key = lambda r: (r[1], r[2] is not None, r[2] or "", r[3])
    want = [(q, *key(r)) for q in (0, 1, 2) for r in sorted((x for x in rows if x[0] == q), key=key)]
    got = sorted(numbered.collect(), key=lambda r: (r["q_ix"], r["rank"]))
    assert [(r["q_ix"], *key((0, r["match_rank"], r["path"], r["line"]))) for r in got] == want
    assert [r["rank"] for r in got] == [k for q in (0, 1, 2) for k in range(1, sum(x[0] == q for x in rows) + 1)]
    assert results.numbered(df.where("false"), ["q_ix"], order, "path", df.where("false")).count() == 0


def test_spans_within_spans(spark):
    rng = random.Random(4)
    span = lambda: (f"p{rng.randrange(4)}", a := rng.randrange(40), a + rng.randrange(12))
    rows, spans = [span() for _ in range(200)], [span() for _ in range(25)]
    got = ranges.within(spark.createDataFrame(rows, "path string, s int, e int"), spark.createDataFrame(spans, "path string, s int, e int"))
    want = sorted((*r, any(x[0] == r[0] and x[1] <= r[1] and r[2] <= x[2] for x in spans)) for r in rows)
    assert sorted(map(tuple, got.collect())) == want
    assert ranges.outside_whole(spark.createDataFrame(rows, "path string, s int, e int"), spark.createDataFrame([], "path string, s int, e int")).count() == 200


def test_faults_of_trees(spark):
    df = spark.createDataFrame([([(1, 9), (2, 4), (4, 6), (7, 7), (7, 7)], 9), ([(3, 2), (0, 5), (5, 12)], 9), ([], 3)], "scopes array<struct<s:int,e:int>>, last int")
    got = [[tuple(x) for x in r[0]] for r in df.select(ranges.tree_faults(df["scopes"], df["last"])).collect()]
    assert got == [[(4, 6, "crossing")], [(0, 5, "outside"), (3, 2, "reversed"), (5, 12, "outside")], []]


def test_places_without_a_task_for_all(spark, monkeypatch):
    monkeypatch.setattr(results, "PLACES", 4)
    rng = random.Random(7)
    rows = [(q, f"p{rng.randrange(6)}", rng.choice(["def", "ref"]), k) for q in range(2) for k in rng.sample(range(1, 60), 40)]
    df = spark.createDataFrame(rows, "q_ix int, path string, kind string, pos bigint")
    for place, key in ((results.definitions_first, lambda r, earlier: r[2] != "def"), (results.distinct_files_first, lambda r, earlier: r[1] in earlier)):
        want = []
        for q in range(2):
            mine = sorted((r for r in rows if r[0] == q), key=lambda r: r[3])
            behind = [key(r, {x[1] for x in mine[:k]}) for k, r in enumerate(mine)]
            want += [(*r, n) for n, (_, r) in enumerate(sorted(zip(behind, mine, strict=True), key=lambda x: (x[0], x[1][3])), 1)]
        got = place(df)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want) and got.columns == [*df.columns, "place"]
        plan = got._jdf.queryExecution().executedPlan().toString()
        numbers = [line for line in plan.splitlines() if "row_number() windowspecdefinition(" in line]
        assert numbers and all("_range" in line or "path" in line.split("windowspecdefinition(")[1].split(" ASC")[0] for line in numbers)
