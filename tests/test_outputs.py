import json
import time

import pytest

from textquarry.functions import render
from textquarry.plans import envelope as E
from textquarry.sources import manifests
from textquarry.streaming import budget


def results(n):
    return [{"path": f"d/f{k}.go", "line": k + 1, "kind": "def" if k == 3 else "ref", "symbol": "s" * (k * 9), "scope": "S", "code": "x"} for k in range(n)]


@pytest.mark.parametrize("size", [120, 200, 333, 500, 1024])
def test_answers_keep_to_their_budget(size):
    inspect = {"location": "a.go:3", "symbol": "f", "results": [{"path": "a.go", "line": 3, "start_line": 1, "kind": "scope", "code": "line\n" * 60}, *results(9)], "results_truncated": True}
    for verb, response in (("find", {"query": "q", "matched_as": "symbol", "results": results(9)}), ("inspect", inspect), ("outline", {"path": "a.go", "results": results(7)}), ("changed", {"head_commit": "h", "patch": "p", "results": results(2)})):
        answer = E.fit(verb, response, size)
        assert answer and E.size(answer) <= size and len(answer["results"]) <= 5
        if verb == "inspect" and size > 200:
            text = answer["evidence"]["text"]
            assert ("line\n" * 60).startswith(text) and text.endswith(("line", "line\n"))
    assert E.fit("find", {"query": "q" * 200, "results": []}, 50) is None


def test_answers_lead_on():
    answer = E.fit("find", {"query": "q", "matched_as": "symbol", "results": results(4)})
    assert answer["results"][0]["kind"] == "def" and answer["next"] == {"tool": "inspect", "arguments": {"location": "d/f3.go:4"}}
    paths = [{"path": "a.go", "line": 4, "kind": "ref", "scope": "Run"}, {"path": "a_test.go", "kind": "file"}]
    assert E.fit("find", {"query": "a", "matched_as": "file", "results": paths})["next_related"]["arguments"]["path_globs"] == ["a_test.go"]
    assert len(E.hint("find", {"next": {"tool": "inspect", "arguments": {"location": "é" * 300}}}).encode()) <= 160
    E.checked_input("find", {"query": "x", "limit": 5})
    for bad in ({"other": 1}, {"limit": 0}, {"match": "x"}, {"path_globs": ["a"] * 33}):
        with pytest.raises(ValueError, match="."):
            E.checked_input("find", bad)


def test_answers_over_a_table(spark):
    df = spark.createDataFrame([("find", json.dumps({"query": "q", "results": results(3)}))], "verb string, response string")
    assert E.size(json.loads(E.fitted(df, 300).first()["answer"])) <= 300


def test_texts():
    row = {"path": "a.go", "start_line": 1, "end_line": 2, "kind": "def", "symbol": "f", "code": "a ``` b", "line": 1}
    assert render.result_text(row, "scope") == "# a.go:1-2 def f\n````go\na ``` b\n````\n"
    assert render.result_text(row, "locations") == "a.go:1\n"
    assert render.result_text({"path": "a\x1b", "finding": "file", "kind": "file"}, "scope") == '# "a\\x1b" file\n'
    assert render.json_text([{"a": 1}], "outline") == '{"a":1}\n' and render.json_text([{"a": 1}], "find") == '[{"a":1}]\n'
    assert "# patch truncated" in render.changed_text({"patch": "+x", "patch_truncated": True, "results": []}, "scope")
    assert render.find_text({"query": "q", "matched_as": "none", "hint": "h", "results": []}, "scope") == "# q: none\nh\n"


def test_commands():
    assert budget.standalone("nav find x --json", "nav") == "find"
    assert budget.standalone("sh -lc 'nav changed --json'", "nav") == "changed"
    assert budget.standalone("ls -l", "nav") is None and budget.standalone("navy find --json", "nav") is None
    assert budget.standalone('/bin/sh -lc "nav.bin outline \'a b.go\' --json"', "nav") == "outline"
    assert budget.standalone("nav 'find' \"x y\" --json", "nav") == "find" and budget.standalone("nav --json", "nav") is None and budget.standalone("/opt/nav zzz --json", "nav") is None
    assert budget.standalone("sh -lc '/opt/bin/nav find x --json'", "nav") == "find" and budget.standalone('/usr/local/bin/zsh -lc "nav inspect a:1 --json"', "nav") == "inspect"
    for bad in ("nav find x --json; rm y", "nav find x", "nav find a --json | nav find b --json", "echo nav find --json", "nav find $X --json", "nav find --json --json", "sh -c 'nav find --json'", "bash -lc 'nav find --json'", "sh -lc 'nav find --json' x", "sh -lc ' nav find --json'", "nav find 'x --json", "A=1 nav find --json", "sh -lc 'cd a && nav find --json'", "/usr/local/bin/nav find x --json", "x=$(nav find y --json)", "nav find 'a*' --json", "nav find a\\ b --json", "sh -lc 'nav find --json' > y", "sh -lc 'nav'' find --json'", "nav find nav --json", "echo 'nav find x' # --json"):
        with pytest.raises(ValueError, match="."):
            budget.standalone(bad, "nav")


def test_transcripts_and_budgets(spark, tmp_path):
    lines = ["{bad", json.dumps({"type": "item.started", "item": {"type": "command_execution", "command": "nav find a --json"}}), json.dumps({"type": "item.completed", "item": {"type": "command_execution", "command": "nav find a --json"}}), json.dumps({"type": "item.started", "item": {"type": "message", "command": "x"}})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/t.jsonl").write_text("\n".join(lines))
    commands = budget.transcript(spark, str(tmp_path / "in"), streaming=False)
    assert [tuple(r) for r in budget.usage(commands, ["command"], 0).collect()] == [("nav find a --json", 1, 1, True)]
    assert commands.select(budget.standalone_verb(commands["command"], "nav")).first()[0] == "find"
    stream = budget.usage(budget.transcript(spark, str(tmp_path / "in")), ["command"], 5)
    stream.writeStream.outputMode("complete").format("memory").queryName("transcript").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("transcript").first()["started"] == 1


def test_admission_is_stateful(spark, tmp_path):
    folder = tmp_path / "requests"
    for k in range(2):
        spark.range(k * 3, k * 3 + 3).selectExpr("'u' AS user", "id AS request_id").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema("user string, request_id bigint").option("maxFilesPerTrigger", 1).parquet(str(folder))
    budget.admitted(stream, "user", 4).writeStream.outputMode("append").format("memory").queryName("admitted").trigger(availableNow=True).start().awaitTermination()
    rows = spark.table("admitted").collect()
    assert len(rows) == 6 and sum(r["allowed"] for r in rows) == 4 and max(r["used"] for r in rows) == 4


def test_sequences(spark):
    df = spark.createDataFrame([("a", 1, "changed"), ("a", 2, "find"), ("b", 1, "find"), ("c", 1, "changed"), ("c", 2, "changed")], "k string, n int, verb string")
    got = {r["k"]: r["fault"] for r in budget.sequence_faults(df, "k", "n", "find").collect()}
    assert got["a"] is None and "first" in got["b"] and "got 2" in got["c"]


def test_manifests(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("# c\nname https://github.com/a/b\n\nother  /x\n")
    assert sorted(r["name"] for r in manifests.manifest(spark, str(tmp_path / "m.tsv")).collect()) == ["name", "other"]
    (tmp_path / "bad.tsv").write_text("a x\na y\n")
    with pytest.raises(Exception, match="repeated"):
        manifests.manifest(spark, str(tmp_path / "bad.tsv")).collect()
    assert manifests.safe_url("https://github.com/a/b") and not manifests.safe_url("https://u:p@github.com/a/b")
    (tmp_path / "repo/.git").mkdir(parents=True)
    assert manifests.discovered(str(tmp_path)) == [str(tmp_path / "repo")]


def test_quoted_texts(spark):
    texts = ["plain path.go", "é日本", "a\x1b", 'q"\x07\t\\', "\u200b", "\xa0x", "\U000e0001", "\x7f", "a\nb", "\u2028"]
    assert render.safe(texts[2]) == '"a\\x1b"' and render.safe(texts[4]) == '"\\u200b"' and render.safe(texts[6]) == '"\\U000e0001"' and render.safe("\udcff") == '"\\xff"'
    df = spark.createDataFrame([(t,) for t in texts], "path string")
    assert [r[0] for r in df.select(render.safe_path(df["path"])).collect()] == [render.safe(t) for t in texts]


def test_requests_wait_for_their_command(spark, tmp_path):
    folder = tmp_path / "polled"
    rows = [("a", "item.started", None), ("a", "request", 1), ("b", "request", 2), ("a", "item.completed", None), ("a", "request", 3), ("c", "item.started", None), ("c", "item.started", None), ("c", "request", 4)]
    for k, part in enumerate([rows[:3], rows[3:]]):
        spark.createDataFrame(part, "user string, type string, request_id bigint").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema("user string, type string, request_id bigint").option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = budget.answered(stream, "user", 1, "300 milliseconds").writeStream.outputMode("append").format("memory").queryName("answered").option("checkpointLocation", str(tmp_path / "c")).start()
    for _ in range(120):  # with timeouts there is always another batch to wait for
        if spark.table("answered").count() == 4:
            break
        time.sleep(0.5)
    query.stop()
    got = {r["request_id"]: (r["key"], r["used"], r["remaining"], r["fault"]) for r in spark.table("answered").collect()}
    assert got[1] == ("a", 1, 0, None) and "missing" in got[2][3] and "missing" in got[3][3] and got[4][:3] == ("c", 2, 0) and "1 of 1" in got[4][3]
