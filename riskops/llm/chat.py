"""Chat formatting by event-sourced reconstruction.

A conversation log is a stream of events. It is partitioned by conversation and sorted by
sequence; a fold over each conversation applies streamed deltas, edits, deletions and
regenerations, and what remains is rendered with a template that marks each turn. Control
strings inside roles and texts are escaped reversibly, and the loss mask covers each
assistant text alone.

Events: ``message`` (starts a message, or replaces the one with its id), ``delta`` (appends to
it), ``edit`` (replaces its text), ``delete`` (removes it), ``regenerate`` (removes it and
what follows, then starts it anew). A message without an id is a new one each time. An event
for an id that is not there starts the message.

Defined cases: null texts and roles are empty; null conversation ids form one conversation,
null sequence numbers come first; equal sequence numbers go by event, message, role and text; repeated
rows are events like any other; an empty log gives an empty result; other columns are
ignored. A task holds one conversation, which is one cell of the result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: Strings that trainers and common templates treat as control (fixed values).
CONTROL = re.compile(r"<\|[A-Za-z0-9_]+\|>|</?s>|\[/?INST\]|<</?SYS>>")
LOSS_ROLE = "assistant"


def escape(text: str, role: bool = False) -> str:
    """No control string is left; in a role no line feed either."""
    out = CONTROL.sub(lambda m: "\\" + ("l" if m[0][0] == "<" else "b") + m[0][1:], text.replace("\\", "\\\\"))
    return out.replace("\n", "\\n") if role else out


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"l": "<", "b": "[", "n": "\n", "\\": "\\"}[m[1]], text)


def fold(events: Iterator[tuple]) -> list[tuple[str, str]]:
    """(role, text) of the messages that (kind, message, role, text) events leave, in order."""
    order: list[object] = []
    held: dict[object, tuple[str, list[str]]] = {}
    for n, (kind, message, role, text) in enumerate(events):
        key: object = ("new", n) if message is None else message
        parts = [text] if text else []
        if kind == "regenerate" and key in held:
            at = order.index(key)
            role = role or held[key][0]
            for k in order[at:]:
                del held[k]
            del order[at:]
        if kind == "delete":
            if key in held:
                del held[key]
                order.remove(key)
        elif key not in held:
            order.append(key)
            held[key] = (role or "", parts)
        elif kind == "delta":
            held[key][1].extend(parts)
        else:
            held[key] = (role or held[key][0], parts)
    return [(held[k][0], "".join(held[k][1])) for k in order]


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (start, end) of its loss mask, in code points."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escape(role, True) + MIDDLE, escape(text)
        out += [head, body, END]
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, body = part.partition(MIDDLE)
        turns.append((unescape(role), unescape(body[: body.rindex(END)])))
    return turns


def format_conversations(events: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans and n_turns from events conv_id, seq, kind, message, role, text."""
    names = ["conv_id", "kind", "message", "role", "text"]
    dealt = events.select("seq", *names).repartition("conv_id").sortWithinPartitions("conv_id", "seq", "kind", "message", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in names))

        def made(convs: list, done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(convs, pa_type), pa.array([f for f, _ in done], pa.string()),
                 pa.array([[{"start": a, "end": b} for a, b in s] for _, s in done], spans_type)],
                ["conv_id", "formatted", "loss_spans"],
            )

        own: list[tuple] = []
        conv, ids, done, size = None, [], [], 0
        for c, *event in rows():
            if own and c != conv:
                ids.append(conv)
                done.append(render(fold(iter(own))))
                size += len(done[-1][0])
                own = []
                if size > 1 << 22:
                    yield made(ids, done)
                    ids, done, size = [], [], 0
            conv = c
            own.append((event[0], event[1], event[2] or "", event[3] or ""))
        if own:
            ids.append(conv)
            done.append(render(fold(iter(own))))
        if ids:
            yield made(ids, done)

    from pyspark.sql.pandas.types import to_arrow_type

    field = events.schema["conv_id"]
    pa_type, spans_type = to_arrow_type(field.dataType), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return dealt.mapInArrow(run, T.StructType([field, T.StructField("formatted", T.StringType()), T.StructField("loss_spans", span)]))


def table_events(conversations: DataFrame) -> DataFrame:
    """A finished table (conv_id, turn, role, text) as events: each row is one message."""
    none = F.lit(None).cast("string")
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), none.alias("message"), "role", "text")


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them."""
    formatted = formatted.select("conv_id", "formatted", "loss_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text, spans in zip(b.column("formatted").to_pylist(), b.column("loss_spans").to_pylist()):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                row = (
                    len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                    len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text),
                )
                for col, x in zip(out, row):
                    col.append(x)
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *map(pa.array, out, types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    names = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, {names}")
