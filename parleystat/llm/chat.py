"""Chat formatting: records of many layouts become turns, and turns become marked text with a loss mask.

A record's layout is recognised by a fingerprint: the hash of its set of nested field paths. Fingerprints select a
declarative mapping; records that no mapping fits come out marked, never dropped.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleystat.llm.common import batches

# Layouts


@dataclass(frozen=True)
class Turns:
    """A list of turns at `path`, each with a role and a text; an empty path is the record itself."""

    path: str
    role: str
    text: str


@dataclass(frozen=True)
class Field:
    """One field that is a turn of a fixed role. Several fields of one role in a row join into one turn."""

    path: str
    role: str


@dataclass(frozen=True)
class Layout:
    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    parts: tuple[Turns | Field, ...]
    order: str = ""  # the field that places a record among others of its conversation

    def fingerprints(self) -> Iterator[str]:
        for k in range(len(self.optional) + 1):
            for some in itertools.combinations(self.optional, k):
                yield fingerprint_of({*self.required, *some})


LAYOUTS = (
    Layout("turn_row", ("role",), ("turn", "text"), (Turns("", "role", "text"),), order="turn"),
    Layout("messages", ("messages[]", "messages[].role"), ("messages[].content", "system"),
           (Field("system", "system"), Turns("messages", "role", "content"))),
    Layout("conversations", ("conversations[]", "conversations[].from"), ("conversations[].value", "system"),
           (Field("system", "system"), Turns("conversations", "from", "value"))),
    Layout("dialog", ("data.dialog[]", "data.dialog[].speaker"), ("data.dialog[].utterance",),
           (Turns("data.dialog", "speaker", "utterance"),)),
    Layout("instruction", ("instruction", "output"), ("input", "system"),
           (Field("system", "system"), Field("instruction", "user"), Field("input", "user"), Field("output", "assistant"))),
    Layout("prompt_response", ("prompt", "response"), ("system",),
           (Field("system", "system"), Field("prompt", "user"), Field("response", "assistant"))),
    Layout("prompt_completion", ("prompt", "completion"), ("system",),
           (Field("system", "system"), Field("prompt", "user"), Field("completion", "assistant"))),
    Layout("question_answer", ("question", "answer"), ("context",),
           (Field("context", "user"), Field("question", "user"), Field("answer", "assistant"))),
)
#: Names that other sources give to the three roles; any other name stays as it is.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
ASSISTANT = "assistant"


def paths_of(value: Any) -> set[str]:
    """Nested field paths of a JSON value: `a.b` into objects, `a[]` into lists. A null field is absent."""
    found, left = set(), [("", value)]
    while left:
        prefix, value = left.pop()
        if isinstance(value, dict):
            left += [(f"{prefix}.{k}" if prefix else k, v) for k, v in value.items() if v is not None]
        elif isinstance(value, list):
            found.add(f"{prefix}[]")
            left += [(f"{prefix}[]", v) for v in value if isinstance(v, (dict, list))]
        elif prefix:
            found.add(prefix)
    return found


def fingerprint_of(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


class Mapper:
    """Mappings by fingerprint. Fields that no layout names do not count towards a fingerprint."""

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS):
        self.known = {p for x in layouts for p in (*x.required, *x.optional)}
        self.by_print: dict[str, Layout] = {}
        for layout in layouts:
            for mark in layout.fingerprints():
                self.by_print.setdefault(mark, layout)

    def __call__(self, record: str | None) -> tuple[str | None, str, int | None, list[tuple[str, str]]]:
        """Layout name (null where none fits), fingerprint, place among records, and turns as (role, text).

        What is no JSON, or nested too deeply to be read, fits none. A place is a whole number that a long holds, else
        null; a half of a surrogate pair counts as a replacement character.
        """
        try:
            return self._mapped(json.loads(record or ""))
        except (ValueError, RecursionError):
            return None, "", None, []

    def _mapped(self, value: Any) -> tuple[str | None, str, int | None, list[tuple[str, str]]]:
        mark = fingerprint_of(paths_of(value) & self.known)
        layout = self.by_print.get(mark)
        if layout is None or not isinstance(value, dict):
            return None, mark, None, []
        turns: list[tuple[str, str]] = []
        joins = False  # whether the last turn came from a single field
        for part in layout.parts:
            if isinstance(part, Turns):
                found = value
                for key in part.path.split(".") if part.path else ():
                    found = found[key]
                for item in found if part.path else [found]:
                    role, text = (item.get(part.role), item.get(part.text)) if isinstance(item, dict) else ("", item)
                    turns.append((_role(role, keep=not part.path), _text(text)))
                joins = False
            elif (text := value.get(part.path)) is not None:
                if joins and turns[-1][0] == part.role:
                    turns[-1] = (part.role, f"{turns[-1][1]}\n\n{_text(text)}" if _text(text) else turns[-1][1])
                else:
                    turns.append((part.role, _text(text)))
                joins = True
        place = value.get(layout.order) if layout.order else None
        whole = isinstance(place, int) and not isinstance(place, bool) and -(1 << 63) <= place < 1 << 63
        return layout.name, mark, place if whole else None, turns


def _text(value: Any) -> str:
    text = value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return text


def _role(value: Any, keep: bool) -> str:
    role = _text(value)
    return role if keep else ROLES.get(role, role)


_TURNS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("place", pa.int64()),
        ("step", pa.int64()),
        ("role", pa.string()),
        ("text", pa.string()),
        ("layout", pa.string()),
        ("fingerprint", pa.string()),
    ]
)
_TURNS_DDL = "conv_id long, place long, step long, role string, text string, layout string, fingerprint string"


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Turns of JSON `record`s by `conv_id`: one row per turn (`conv_id, place, step, role, text, layout,
    fingerprint`). A record that no layout fits gives one row whose layout, role and text are null."""

    def convert(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper = Mapper(layouts)

        def rows():
            for part in parts:
                for conv_id, record in zip(part.column(0).to_pylist(), part.column(1)):
                    name, mark, place, turns = mapper(record.as_py())
                    if name is None:
                        yield conv_id, None, 0, None, None, None, mark
                    for step, (role, text) in enumerate(turns):
                        yield conv_id, place, step, role, text, name, mark

        yield from batches(rows(), _TURNS)

    return records.select(F.col("conv_id").cast("long"), "record").mapInArrow(convert, _TURNS_DDL)


# Template

OPEN, CLOSE = "### ", "</turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_TURN = re.compile(r"### ((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    """Break up the control strings with backslashes, and double the backslashes that were there."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:] if len(m[0]) > 1 else "\\\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn, and where its escaped text starts and ends in it."""
    head = OPEN + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse_turns(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        yield unescape(m[1]), unescape(m[2])
        at = m.end()


#: Characters after which a long conversation goes on in another row.
SEGMENT = 1 << 20
_MASK = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("formatted", pa.string()), ("loss", _MASK)])
_FORMATTED_DDL = "conv_id long, segment long, formatted string, loss array<struct<start:long,end:long>>"
_ORDER = ("conv_id", "place", "step", "role", "text")


def _together(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of a conversation in one partition and in order. Partitions are read as a stream, so a task needs
    memory for one row, not for one conversation."""
    return rows.repartition("conv_id").sortWithinPartitions(*order)


def format_conversations(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Canonical turns as text: rows `conv_id, segment, formatted, loss` with the spans under the loss mask, which
    are the assistant's escaped texts in code points of `formatted`.

    Turns are ordered by place and step; ties go by role and text, and repeated rows stay. A conversation is one
    row, or several in order if it is longer than `segment` characters. Null roles and texts are empty; turns
    without a conv_id form one conversation.
    """

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            owner, number, held, loss, size = None, 0, [], [], 0
            for part in parts:
                for conv_id, role, text in zip(part.column(0).to_pylist(), part.column(1), part.column(2)):
                    if held and (conv_id != owner or size >= segment):
                        yield owner, number, "".join(held), loss
                        number = number + 1 if conv_id == owner else 0
                        held, loss, size = [], [], 0
                    owner = conv_id
                    marked, start, end = format_turn(role.as_py() or "", text.as_py() or "")
                    if role.as_py() == ASSISTANT:
                        loss.append({"start": size + start, "end": size + end})
                    held.append(marked)
                    size += len(marked)
            if held:
                yield owner, number, "".join(held), loss

        yield from batches(rows(), _FORMATTED, weigh=lambda r: len(r[2]))

    known = turns.where("layout is not null")
    return _together(known, *_ORDER).select("conv_id", "role", "text").mapInArrow(write, _FORMATTED_DDL)


_DIGEST = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)
_DIGEST_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its formatted text and mask alone: turns, their digest, and what is under the mask."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            owner, state = None, None
            for part in parts:
                for conv_id, text, loss in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist()):
                    if state is None or conv_id != owner:
                        if state:
                            yield owner, *state.result()
                        owner, state = conv_id, _Digest()
                    state.add(text.as_py(), [(x["start"], x["end"]) for x in loss])
            if state:
                yield owner, *state.result()

        yield from batches(rows(), _DIGEST)

    rows = _together(formatted, "conv_id", "segment").select("conv_id", "formatted", "loss")
    return rows.mapInArrow(read, _DIGEST_DDL)


class _Digest:
    def __init__(self):
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, spans: list[tuple[int, int]]) -> None:
        self.chars += len(text)
        for role, said in parse_turns(text):
            self.turns += 1
            self.all.update(f"{role}\n{said}\n".encode())
        for start, end in spans:
            said = unescape(text[start:end])
            self.loss_chars += len(said)
            self.loss.update(said.encode())

    def result(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars
