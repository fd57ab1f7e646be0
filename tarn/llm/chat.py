r"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation::

    conversation := turn*
    turn         := "<<SYS>>" text "<</SYS>>"            system
                  | "[INST]" text "[/INST]"              user
                  | "<s>" text "</s>"                    assistant
                  | "[ROLE]" role "[/ROLE]" text "[/END]"   any other role

The parser is deterministic: a turn begins with one of four openers and ends at
the next closer of its kind. Texts are first rendered as they are and parsed
back. Where turns don't come back as they were, those with conflicting content
are escaped and the whole is parsed again until both are identical. The escape
puts a backslash after the first character of a control string, and one more
where a control string already has backslashes there, so it can be undone.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
NAME, NAME_END, OTHER_END = "[ROLE]", "[/ROLE]", "[/END]"
_REST = r"(s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|ROLE\]|/ROLE\]|/END\])"
_PLAIN = re.compile(r"([<\[])(\\*)" + _REST)
_ESCAPED = re.compile(r"([<\[])\\(\\*)" + _REST)

TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]], escaped: list[bool]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans under the loss mask: assistant texts, without their marks."""
    out: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for (role, text), needs in zip(turns, escaped):
        body = escape(text) if needs else text
        if role in MARKS:
            opener, closer = MARKS[role]
        else:
            opener, closer = NAME + (escape(role) if needs else role) + NAME_END, OTHER_END
        if role == "assistant":
            spans.append((at + len(opener), at + len(opener) + len(body)))
        out += (opener, body, closer)
        at += len(opener) + len(body) + len(closer)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted conversation; ValueError if it doesn't follow the grammar."""
    turns, at = [], 0

    def upto(closer: str) -> str:
        nonlocal at
        end = formatted.find(closer, at)
        if end < 0:
            raise ValueError(f"no {closer} after {at}")
        found, at = formatted[at:end], end + len(closer)
        return unescape(found)

    while at < len(formatted):
        for role, (opener, closer) in MARKS.items():
            if formatted.startswith(opener, at):
                at += len(opener)
                turns.append((role, upto(closer)))
                break
        else:
            if not formatted.startswith(NAME, at):
                raise ValueError(f"no turn begins at {at}")
            at += len(NAME)
            role = upto(NAME_END)
            turns.append((role, upto(OTHER_END)))
    return turns


def round_trip(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]], int]:
    """Formatted text, loss spans and the number of escaped turns."""
    escaped = [False] * len(turns)
    conflicts = [escape(r) != r or escape(t) != t for r, t in turns]
    while True:
        formatted, spans = render(turns, escaped)
        try:
            back = parse(formatted)
        except ValueError:
            back = None
        if back == turns:
            return formatted, spans, sum(escaped)
        if escaped == conflicts:
            raise AssertionError("an escaped conversation did not come back")
        escaped = conflicts


def format_conversations(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans, n_escaped``.

    Turns are ordered by ``turn``; ties, null turns (first) and repeated rows
    keep a row each, ordered by role and text. Null texts and roles are empty;
    an empty or unknown role is written by name; bytes that are not UTF-8 become
    U+FFFD. A null id names no conversation: such rows are conversations of one
    turn each. ``loss_spans`` are code point ranges ``[start, end)``. Other
    columns are neither read nor returned; an empty table gives an empty result.
    """
    valid = lambda c: F.make_valid_utf8(F.coalesce(F.col(c), F.lit("")))
    rows = conversations.select(
        F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), valid(role_col).alias("role"), valid(text_col).alias("text")).alias("t")
    )
    told = lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))
    named = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), told).alias("turns"))
    grouped = named.unionByName(rows.filter("conv_id is null").select("conv_id", F.array(told(F.col("t"))).alias("turns")))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def write(batches):
        for batch in batches:
            done = [round_trip([(t["role"], t["text"]) for t in turns]) for turns in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([d[0] for d in done], pa.string()),
                    pa.array([[{"start": a, "end": b} for a, b in d[1]] for d in done], span),
                    pa.array([d[2] for d in done], pa.int32()),
                ],
                ["conv_id", "formatted", "loss_spans", "n_escaped"],
            )

    schema = T.StructType(
        [
            T.StructField("conv_id", conversations.schema[id_col].dataType),
            T.StructField("formatted", T.StringType()),
            T.StructField("loss_spans", T.ArrayType(SPAN)),
            T.StructField("n_escaped", T.IntegerType()),
        ]
    )
    return grouped.mapInArrow(write, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, loss, formatted_chars`` parsed from formatted rows.

    ``loss`` holds the unescaped text under each span of the loss mask, in order.
    """
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def read(batches):
        for batch in batches:
            texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([[{"role": r, "text": t} for r, t in parse(x)] for x in texts], turn),
                    pa.array([[unescape(x[s["start"] : s["end"]]) for s in m] for x, m in zip(texts, spans)], pa.list_(pa.string())),
                    pa.array([len(x) for x in texts], pa.int64()),
                ],
                ["conv_id", "turns", "loss", "formatted_chars"],
            )

    schema = T.StructType(
        [
            formatted.schema["conv_id"],
            T.StructField("turns", T.ArrayType(TURN)),
            T.StructField("loss", T.ArrayType(T.StringType())),
            T.StructField("formatted_chars", T.LongType()),
        ]
    )
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(read, schema)
