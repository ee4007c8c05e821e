"""Streams of navigation events: transcripts, request budgets, the order of requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "type string, item struct<type:string,command:string>"
#: Shells, by name, whose ``-lc`` runs one quoted command, and the verbs of a request.
SHELLS, VERBS = ("sh", "zsh"), ("changed", "find", "inspect", "outline")
#: The characters by which a shell's line is more than words, by what they do.
GRAMMAR = {"parts commands": "\n\r;&|", "redirects": "<>", "groups": "(){}", "expands": "$`", "matches files": "*?[]", "escapes": "\\", "names a home": "~", "comments": "#"}
ROLE = {c: role for role, those in GRAMMAR.items() for c in those}
#: Those of them that end a word in front of them.
PARTING = frozenset(GRAMMAR["parts commands"] + GRAMMAR["redirects"] + "()`")


def transcript(spark: SparkSession, folder: str, streaming: bool = True) -> DataFrame:
    """(type, command) of the command events in a folder of JSON lines; lines that are no JSON are passed over."""
    reader = spark.readStream if streaming else spark.read
    return events(reader.text(folder))


def events(lines: DataFrame) -> DataFrame:
    parsed = lines.select(F.from_json("value", EVENT, {"mode": "PERMISSIVE"}).alias("e"))
    return parsed.where("e.item.type = 'command_execution'").select("e.type", F.col("e.item.command").alias("command"))


class Word:
    """A word of a shell's line: its text without quotes, and how many quoted pieces it has besides plain ones."""

    def __init__(self) -> None:
        self.text, self.quoted, self.plain = "", 0, False


class Line:
    """A shell's line as words, with what it does besides: ``outside`` and ``inside`` of quotes."""

    def __init__(self, line: str):
        self.line, self.words = line, []
        self.outside: set[str] = set()
        self.inside: set[str] = set()
        word, quote = None, ""
        for c in line:
            role = ROLE.get(c)
            if role:
                (self.inside if quote else self.outside).add(role)
            if quote and c == quote:
                quote = ""
            elif quote:
                word.text += c
            elif c in "'\"":
                word = word or self._begun()
                word.quoted, quote = word.quoted + 1, c
            elif c.isspace() or c in PARTING:
                word = None
            else:
                word = word or self._begun()
                word.text, word.plain = word.text + c, True
        self.closed = not quote

    def _begun(self) -> Word:
        self.words.append(Word())
        return self.words[-1]

    def calls(self, program: str) -> list[int]:
        """The words that name the program, by itself or behind a path, with a verb next to them."""
        names = [w.text.rpartition("/")[2].removesuffix(".bin") for w in self.words]
        return [k for k, (name, after) in enumerate(zip(names, self.words[1:], strict=False)) if name == program and after.text in VERBS]

    def faults(self, program: str, by_path: bool) -> Iterator[str]:
        """What keeps the line from being one request and nothing else."""
        if not self.closed:
            yield "a quote is left open"
        for role in sorted(self.outside | self.inside):
            yield f"the shell's line {role}"
        if [w.text for w in self.words].count("--json") != 1:
            yield "one JSON answer has to be asked for, once"
        if self.calls(program) != [0] or self.line.count(program) > 1:
            yield f"{program} has to be what is run, once"
        elif "/" in self.words[0].text and not by_path:
            yield f"{program} has to be called by its name"
        if self.line != self.line.strip():
            yield "there is space around the command"


def standalone(command: str, program: str) -> str | None:
    """The verb of a command that runs ``program`` once, by itself, for one JSON answer; None if it asks it for nothing.
    ValueError if it runs it together with anything else."""
    outer = Line(command)
    if not any(line.calls(program) for line in (outer, *(Line(w.text) for w in outer.words if w.quoted))):
        return None
    line, in_shell = outer, False
    if len(outer.words) == 3 and not outer.outside:
        shell, flags, said = outer.words
        in_shell = shell.text.rpartition("/")[2] in SHELLS and flags.text == "-lc" and said.quoted == 1 and not said.plain
        line = Line(said.text) if in_shell else outer
    for fault in line.faults(program, by_path=in_shell):
        raise ValueError(fault)
    return line.words[1].text


def standalone_verb(command: Column, program: str) -> Column:
    """As standalone(), over a column: null if the program isn't run, ``!`` and the reason if it isn't alone."""

    @F.pandas_udf("string")
    def verb(commands: pd.Series) -> pd.Series:
        def one(c: str | None) -> str | None:
            try:
                return standalone(c or "", program)
            except ValueError as e:
                return f"!{e}"

        return commands.map(one)

    return verb(command)


def usage(commands: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """(keys, started, completed, exceeded) of events (keys, type): a running count for each key, in output mode update or
    complete."""
    counts = commands.groupBy(*keys).agg(F.count_if(F.col("type") == "item.started").alias("started"), F.count_if(F.col("type") == "item.completed").alias("completed"))
    return counts.withColumn("exceeded", F.col("started") > limit)


def admitted(requests: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, request_id, used, remaining, allowed) for each of a stream of requests (key, request_id): the first ``limit`` of
    a key are allowed, in the order of their ids within a batch. The count is kept as state, so a restart goes on from it."""

    def count(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("request_id")
        out = []
        for request in rows["request_id"]:
            allowed = used < limit
            used += allowed
            out.append((keys[0], request, used, max(0, limit - used), allowed))
        state.update((used,))
        yield pd.DataFrame(out, columns=["key", "request_id", "used", "remaining", "allowed"])

    named = requests.select(F.col(key).cast("string").alias("key"), F.col("request_id").cast("bigint").alias("request_id"))
    return named.groupBy("key").applyInPandasWithState(
        count, "key string, request_id bigint, used bigint, remaining bigint, allowed boolean", "used bigint", "append", GroupStateTimeout.NoTimeout
    )


def answered(events: DataFrame, key: str, limit: int, wait: str = "500 milliseconds") -> DataFrame:
    """(key, request_id, used, remaining, fault) for each request in a stream of (key, type, request_id): started and completed
    commands of a key are counted, and a request (type request) is answered once a command is started and not completed, as
    the request is that command's own. Requests wait for it in the state; those that have waited for ``wait`` are answered
    with a fault, as are those beyond the limit."""
    last = int(wait.split()[0])

    def count(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, completed, waiting = (*state.get[:2], list(state.get[2])) if state.exists else (0, 0, [])
        rows = []
        if state.hasTimedOut:
            rows = [(keys[0], r, started, max(0, limit - started), "the command is missing from the transcript") for r in waiting]
            waiting = []
        else:
            for batch in batches:
                for kind, request in zip(batch["type"], batch["request_id"], strict=True):
                    started += kind == "item.started"
                    completed += kind == "item.completed"
                    if kind == "request":
                        waiting.append(int(request))
        if waiting and started > completed:
            fault = f"{limit} of {limit} requests are used up" if started > limit else None
            rows += [(keys[0], r, started, max(0, limit - started), fault) for r in sorted(waiting)]
            waiting = []
        state.update((started, completed, waiting))
        if waiting:
            state.setTimeoutDuration(last)
        yield pd.DataFrame(rows, columns=["key", "request_id", "used", "remaining", "fault"]).astype({"request_id": "int64", "used": "int64", "remaining": "int64"})

    named = events.select(F.col(key).cast("string").alias("key"), "type", F.coalesce(F.col("request_id").cast("bigint"), F.lit(0)).alias("request_id"))
    return named.groupBy("key").applyInPandasWithState(
        count, "key string, request_id bigint, used bigint, remaining bigint, fault string", "started bigint, completed bigint, waiting array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def sequence_faults(verbs: DataFrame, key: str, order: str, current: str | None = None) -> DataFrame:
    """(key, fault) of requests (key, order, verb): the first must be changed, and the only one; the last must be current.
    fault is null where all is well."""
    seen = verbs.groupBy(key).agg(F.min_by("verb", order).alias("first"), F.max_by("verb", order).alias("last"), F.count_if(F.col("verb") == "changed").alias("n"))
    fault = (
        F.when(F.col("first") != "changed", "the first request must be changed")
        .when(F.col("n") != 1, F.concat(F.lit("changed must be requested exactly once, got "), F.col("n").cast("string")))
        .when(F.lit(current is not None) & (F.col("last") != F.lit(current or "")), "the current request is not the latest one")
    )
    return seen.select(key, fault.alias("fault"))
