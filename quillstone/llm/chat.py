"""Chat formatting: conversations rendered by a compiled template, with loss masks.

The turns of a conversation are brought together by a shuffle on its id and stream through
the template in order, so a worker holds one turn, not the conversation. The output has one
row per conversation and segment; a conversation of more than `SEGMENT` characters has
several, in order.

A backslash goes before every backslash and every control string inside a text or role, so
texts can't close or open turns, and `read_back` restores them exactly.

Defined results: turns are ordered by turn number (nulls first), then role, then text; a
null text or role is empty; a null conversation id is one conversation; repeated rows are
turns of their own; empty tables give no output; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.arrow import prepare, tidy
from quillstone.llm.template import compile_template

#: Roles with a heading of their own; any other role is spelled out after `role=`.
HEADINGS = {"system": "System", "user": "User", "assistant": "Assistant"}
TURN_END = "</turn>"
TEMPLATE = (
    "{% for m in messages %}"
    "### {% if m.role == 'system' %}System{% elif m.role == 'user' %}User{% elif m.role == 'assistant' %}Assistant"
    "{% else %}role={{ m.role|escape_role }}{% endif %}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}{{ m.text|escape }}{% endif %}"
    "</turn>\n"
    "{% endfor %}"
)
SEGMENT = 1 << 20

_CONTROL = re.compile(r"\\|(?=###)|(?=</turn>)")
_CONTROL_ROLE = re.compile(r"\\|(?=###)|(?=</turn>)|(?=:)")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str | None) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] else "\\", text or "")


def escape_role(role: str | None) -> str:
    return _CONTROL_ROLE.sub(lambda m: "\\\\" if m[0] else "\\", role or "")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable] = {"escape": escape, "escape_role": escape_role}
_RENDERERS: dict[str, Callable] = {}


def renderer(template: str) -> Callable:
    if template not in _RENDERERS:
        _RENDERERS[template] = compile_template(template, FILTERS)
    return _RENDERERS[template]


FORMATTED = "conv_id bigint, segment int, text string, mask array<struct<start:bigint,end:bigint>>"
_MASK = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def segments(parts: Iterator[tuple[str, bool]], size: int) -> Iterator[tuple[str, list[dict]]]:
    """Text and mask (offsets in code points) of pieces of at least `size` characters; the last may be shorter."""
    text: list[str] = []
    mask: list[dict] = []
    at = 0
    for part, learnt in parts:
        if learnt:
            mask.append({"start": at, "end": at + len(part)})
        text.append(part)
        at += len(part)
        if at >= size and part == f"{TURN_END}\n":  # in a text it would follow a backslash
            yield "".join(text), mask
            text, mask, at = [], [], 0
    if text:
        yield "".join(text), mask


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Formatted text and loss mask, by conversation and segment."""
    prepare(conversations.sparkSession)
    rows = conversations.select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = renderer(template)
        turns = ((c.as_py(), {"role": r.as_py(), "text": t.as_py()}) for b in batches for c, r, t in zip(*b.columns, strict=True))
        held: list[tuple] = []
        size = 0
        for conv, own in groupby(turns, key=lambda x: x[0]):
            for i, (text, mask) in enumerate(segments(render({"messages": (m for _, m in own)}), segment)):
                held.append((conv, i, text, mask))
                size += len(text)
                if size >= segment:
                    yield _formatted(held)
                    held, size = [], 0
        if held:
            yield _formatted(held)

    return placed.mapInArrow(tidy(run), FORMATTED)


def _formatted(rows: list[tuple]) -> pa.RecordBatch:
    c, s, t, m = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(s, pa.int32()), pa.array(t, pa.string()), pa.array(m, _MASK)], names=["conv_id", "segment", "text", "mask"])


_TURN = re.compile(r"### (?:(System|User|Assistant)|role=((?:\\.|[^\\:])*)): ((?:\\.|(?!</turn>)[^\\])*)</turn>\n", re.S)


def parse_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn in formatted text."""
    names = {v: k for k, v in HEADINGS.items()}
    at = 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"not a turn: {text[at : at + 40]!r}")
        yield names[m[1]] if m[1] else unescape(m[2]), unescape(m[3])
        at = m.end()


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and learnt text recovered from the output of TEMPLATE, as counts and digests."""
    prepare(formatted.sparkSession)
    placed = formatted.select("conv_id", "segment", "text", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((c.as_py(), t.as_py(), m.as_py()) for b in batches for c, _, t, m in zip(*b.columns, strict=True))
        out: list[tuple] = []
        for conv, own in groupby(rows, key=lambda x: x[0]):
            turns, loss, n, learnt, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, text, mask in own:
                chars += len(text)
                for role, said in parse_turns(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for span in mask:
                    plain = unescape(text[span["start"] : span["end"]])
                    loss.update(plain.encode())
                    learnt += len(plain)
            out.append((conv, n, turns.hexdigest(), learnt, loss.hexdigest(), chars))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = [f.split()[0] for f in DIGESTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return placed.mapInArrow(tidy(run), DIGESTS)
