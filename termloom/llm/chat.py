"""Chat formatting: a finite-state machine over roles, a declarative template, loss flags by segment.

Cases: a null text or role counts as empty; an unknown role or a turn out of order marks the rest of its conversation
as not valid but is still rendered; rows with equal conv_id and turn are ordered by role, then text; repeated rows
are turns of their own; rows with a null conv_id form one conversation; further columns are ignored. Memory holds one
turn: a conversation of any length streams through. Its digests are sequential by nature, so a conversation is the
unit of work; its turns arrive by an external sort.
A template whose marks can't be told from texts is refused when it is made.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.shared import sliced


@dataclass(frozen=True)
class Template:
    """What surrounds a turn, which roles carry loss, and which role may follow which.

    Texts are kept apart from the marks by their first two characters: wherever these stand next to each other in a text
    (or with backslashes between), one more backslash is put after the first. So no mark can begin in a text, and none
    can begin at its end, for the two differ. A mark that can't be protected so is refused."""

    head: str = "<|im_start|>"
    tail: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = ""
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )

    def __post_init__(self):
        for mark in (self.head, self.tail):
            if len(mark) < 2 or mark[0] == mark[1] or "\\" in mark[:2]:
                raise ValueError(f"a mark has to begin with two different characters, neither a backslash: {mark!r}")
        pairs = sorted({(re.escape(m[0]), re.escape(m[1])) for m in (self.head, self.tail)})
        object.__setattr__(self, "_escape", re.compile("|".join(rf"(?<={a})(?=\\*{b})" for a, b in pairs)))
        object.__setattr__(self, "_unescape", re.compile("|".join(rf"(?<={a})\\(?=\\*{b})" for a, b in pairs)))

    def escape(self, text: str) -> str:
        return self._escape.sub(r"\\", text)

    def unescape(self, text: str) -> str:
        return self._unescape.sub("", text)

    def escape_role(self, role: str) -> str:
        """In one line, too."""
        return self.escape(role.replace("\\", "\\\\").replace("\n", "\\n"))

    def unescape_role(self, role: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.unescape(role))


CHATML = Template()
SEGMENTS = "conv_id long, seg_no long, turn_no long, role string, segment string, loss boolean, valid boolean"
READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def escape(text: str) -> str:
    return CHATML.escape(text)


def unescape(text: str) -> str:
    return CHATML.unescape(text)


def escape_role(role: str) -> str:
    return CHATML.escape_role(role)


def unescape_role(role: str) -> str:
    return CHATML.unescape_role(role)


def _flush(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)] if rows else [pa.array([], t.type) for t in schema], schema=schema)


SEGMENT_SCHEMA = pa.schema([("conv_id", pa.int64()), ("seg_no", pa.int64()), ("turn_no", pa.int64()), ("role", pa.string()), ("segment", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])
READ_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])


def format_chat(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """Segments (SEGMENTS) of every conversation of turns (conv_id, turn, role, text), in order within a partition."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, valid, turn_no = object(), "", True, 0
        for batch in sliced(batches):
            rows = []
            for c, role, text in zip(*(x.to_pylist() for x in batch.columns)):
                if c != conv:
                    conv, state, valid, turn_no = c, template.start, True, 0
                valid = valid and role in template.follows.get(state, ())
                state = role
                for k, (piece, loss) in enumerate(((f"{template.head}{template.escape_role(role)}\n", False), (template.escape(text), role in template.loss_roles), (template.tail, False))):
                    rows.append((c, 3 * turn_no + k, turn_no, role, piece, loss, valid))
                turn_no += 1
            yield _flush(rows, SEGMENT_SCHEMA)

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").alias("_turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "_turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(render, SEGMENTS)


def read_back(segments: DataFrame, template: Template = CHATML) -> DataFrame:
    """Parse formatted text again, from the text and the loss mask alone. Segments come as format_chat deals them."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, open_, out = object(), None, []

        def close() -> None:
            if open_ is not None:
                if open_["text"]:
                    raise ValueError(f"conversation {conv}: text after the last turn")
                out.append((conv, open_["n"], open_["turns"].hexdigest(), open_["loss_chars"], open_["loss"].hexdigest(), open_["chars"], open_["valid"]))

        for batch in sliced(batches):
            for c, piece, loss, valid in zip(*(x.to_pylist() for x in batch.columns)):
                if c != conv:
                    close()
                    conv, open_ = c, {"text": "", "n": 0, "chars": 0, "loss_chars": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "valid": True}
                open_["chars"] += len(piece)
                open_["valid"] &= valid
                if loss:
                    plain = template.unescape(piece)
                    open_["loss_chars"] += len(plain)
                    open_["loss"].update(plain.encode())
                open_["text"] += piece
                # a turn ends with the first tail behind its role's line
                while piece.endswith(template.tail[-1]):
                    text = open_["text"]
                    if text and not text.startswith(template.head):
                        raise ValueError(f"conversation {conv}: a turn without its mark")
                    line = text.find("\n", len(template.head)) + 1
                    end = text.find(template.tail, line) if line else -1
                    if end < 0:
                        break
                    role, body = text[len(template.head) : line - 1], text[line:end]
                    open_["turns"].update(f"{template.unescape_role(role)}\n{template.unescape(body)}\n".encode())
                    open_["n"] += 1
                    open_["text"] = text[end + len(template.tail) :]
            yield _flush(out, READ_SCHEMA)
            out.clear()
        close()
        yield _flush(out, READ_SCHEMA)

    return segments.select("conv_id", "segment", "loss", "valid").mapInArrow(parse, READ_BACK)
