"""Chat formatting of typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor flattens it in order: texts are escaped,
and each attachment becomes a placeholder ``<|image|>``, ``<|audio|>`` or ``<|document|>`` whose reference and expanded
token count are recorded beside the turn. A formatted turn is ``<|im_start|>ROLE\\nCONTENT<|im_end|>\\n``; a
conversation's formatted text is that of its turns, one after the other.

Texts and roles are escaped so that no control string of this or of common other templates is left in them, nor made where
text parts meet: the texts between two attachments are escaped as one. Backslashes are doubled, and a backslash goes in after the first character of a control string (in roles, also before a newline).
Taking the backslashes out again gives the text back exactly.

The output has one row for each turn, with the offsets of the text under the loss mask (that of assistant turns), so a
conversation of any length needs no row or task memory of its size. Defined cases: a null text or role is empty; turns
with equal numbers come in the order of role and text, null numbers first; repeated rows are all formatted; the null
conv_id is one conversation. Only the four columns named in ``turns`` are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, partitions, small_batches, stored

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = re.compile(r"\\|<(?=\||/?s>|<SYS>>|</SYS>>|unk>|pad>)|\[(?=/?INST\]|/?[A-Z_]+\])|\|(?=>)")
PARTS = "array<struct<type:string,text:string,ref:string,units:bigint>>"
FORMATTED = "conv_id bigint, turn bigint, role string, formatted string, loss_start int, loss_end int, attachments array<struct<type:string,ref:string,at:int,tokens:bigint>>"


def escaped(text: str) -> str:
    return CONTROL.sub(lambda m: m[0] + "\\", text) if CONTROL.search(text) else text


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def escaped_role(role: str) -> str:
    return escaped(role).replace("\n", "\\\n")


def tokens_of_image(units: int) -> int:
    """Tiles of 14 x 14 pixels, merged 2 x 2; units are pixels."""
    return max(1, -(-units // (28 * 28)))


def tokens_of_audio(units: int) -> int:
    """One for each 40 ms; units are milliseconds."""
    return max(1, -(-units // 40))


def tokens_of_document(units: int) -> int:
    """One for each 4 bytes; units are bytes."""
    return max(1, -(-units // 4))


class Flattener:
    """Visits the parts of one turn in order; ``visit_<type>`` handles a type."""

    expand: dict[str, Callable[[int], int]] = {"image": tokens_of_image, "audio": tokens_of_audio, "document": tokens_of_document}

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.texts: list[str] = []  # since the last attachment
        self.length = 0
        self.attachments: list[dict[str, object]] = []

    def visit(self, parts: list[dict[str, object]] | None) -> str:
        for part in parts or []:
            if part is not None:
                getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)
        self.end_text()
        return "".join(self.pieces)

    def add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def end_text(self) -> None:
        self.add(escaped("".join(self.texts)))
        self.texts.clear()

    def visit_text(self, part: dict[str, object]) -> None:
        self.texts.append(part.get("text") or "")

    def attach(self, part: dict[str, object]) -> None:
        kind = part["type"]
        tokens = self.expand[kind](part.get("units") or 0)
        self.end_text()
        self.attachments.append({"type": kind, "ref": part.get("ref"), "at": self.length, "tokens": tokens})
        self.add(f"<|{kind}|>")

    visit_image = visit_audio = visit_document = attach

    def visit_unknown(self, part: dict[str, object]) -> None:
        raise ValueError(f"no content part has type {part.get('type')!r}")


def formatted_turn(role: str, parts: list[dict[str, object]] | None) -> tuple[str, int, int, list[dict[str, object]]]:
    """The formatted turn, start and end of its content in it, and the attachments, placed in it."""
    flat = Flattener()
    content, head = flat.visit(parts), f"{START}{escaped_role(role)}\n"
    for a in flat.attachments:
        a["at"] += len(head)
    return f"{head}{content}{END}\n", len(head), len(head) + len(content), flat.attachments


TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*)<\|im_end\|>\n", re.S)


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and content of a formatted turn, unescaped."""
    m = TURN.fullmatch(formatted)
    if not m:
        raise ValueError("not a formatted turn")
    return unescaped(m[1].replace("\\\n", "\n")), unescaped(m[2])


def format_turns(turns: DataFrame) -> DataFrame:
    """FORMATTED rows of (conv_id, turn, role, parts: PARTS), one for each row."""
    small_batches(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            made = [formatted_turn(r["role"] or "", r["parts"]) for r in rows]
            loss = [r["role"] == "assistant" for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([r["role"] for r in rows], pa.string()),
                    pa.array([m[0] for m in made], pa.string()),
                    pa.array([m[1] if x else None for m, x in zip(made, loss, strict=True)], pa.int32()),
                    pa.array([m[2] if x else None for m, x in zip(made, loss, strict=True)], pa.int32()),
                    pa.array([m[3] for m in made], pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int64())]))),
                ],
                ["conv_id", "turn", "role", "formatted", "loss_start", "loss_end", "attachments"],
            )

    ids = [F.col(c).cast("bigint").alias(c) for c in ("conv_id", "turn")]
    return turns.select(*ids, "role", F.col("parts").cast(PARTS).alias("parts")).mapInArrow(lean(run), FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """What each conversation says, read back from its formatted turns in order. A task streams over its turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[str, object] = {}

        def row() -> list[object]:
            return [state["id"], state["n"], state["turns"].hexdigest(), state["loss"], state["masked"].hexdigest(), state["chars"]]

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            done = []
            for conv, text, start, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not state or state["id"] != conv:
                    if state:
                        done.append(row())
                    state = {"id": conv, "n": 0, "turns": hashlib.sha256(), "loss": 0, "masked": hashlib.sha256(), "chars": 0}
                role, content = read_turn(text)
                state["n"] += 1
                state["chars"] += len(text)
                state["turns"].update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                if start is not None:
                    masked = unescaped(text[start:end])
                    state["loss"] += len(masked)
                    state["masked"].update(masked.encode("utf-8", "surrogatepass"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row(), kinds, strict=True)], names)

    small_batches(formatted.sparkSession)
    ordered = formatted.repartition(partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(lean(run), schema)


def with_text_parts(conversations: DataFrame) -> DataFrame:
    """Turns of one text part each, from a text column."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def chat_query(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    own = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    ids = [F.col(c).cast("bigint").alias(c) for c in ("conv_id", "turn")]
    every = conversations.select(*ids, "role", "text").unionByName(own)
    return digests(stored(format_turns(with_text_parts(every)), "formatted_turns"))
