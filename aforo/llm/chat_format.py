r"""Chat formatting by incremental rendering of a black-box template.

A template is any callable from a list of (role, text) turns to a string. Each turn's span is found
from outside: the turns up to it are rendered, once without and once with it, and the two outputs
compared; what the longer one adds is the turn's segment. If the longer output doesn't begin with the
shorter one, the template has rewritten history: the row is marked, with the number of characters
that stayed. Where the text stands inside the segment is found the same way, by rendering the turn
with a probe in place of its text; the loss mask covers the assistant's texts.

Prefixes are complete: a turn is rendered with all turns before it, and the whole of the two outputs is compared, at every
turn and for texts of any length. That is right for any template; its cost grows with the square of a conversation's turns. A
caller whose template is known to look back no further may pass ``context``, the number of earlier turns to render with; from
there on ``rewritten`` is null (not checked) unless the turns rendered show a change.

Conversations are dealt by id, sorted by turn inside the task (Spark's external sort) and streamed; a task holds the turns
of one conversation, with ``context`` only so many.

Nulls: a null text or role is empty, a null id is a conversation of its own, a null turn comes
first. Rows that repeat a turn are kept, ordered by role and text. Very long texts are rendered like others. Empty tables
give empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aforo.llm.common import small_batches

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Strings with a meaning to the template; inside texts they are broken up.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_BREAK = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_TURN = re.compile(r"<s>\[INST\] ([^\n]*)\n((?s:.*?)) \[/INST\]</s>")
_ROLE = {"%": "%25", "\n": "%0A", "<": "%3C", "[": "%5B"}
#: Stands for a text while the template is probed.
PROBE = "\ue000\ue001\ue000"


def escape(text: str) -> str:
    r"""Put a backslash after each backslash and after the first character of each control string."""
    return _BREAK.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    """The inverse of escape: any backslash follows the character it belongs to."""
    if "\\" not in text:
        return text
    out, i = [], 0
    while i < len(text):
        out.append(text[i])
        i += 2 if text[i + 1 : i + 2] == "\\" else 1
    return "".join(out)


def template(turns: list[Turn]) -> str:
    """``<s>[INST] role, new line, text [/INST]</s>`` for each turn, control strings escaped."""
    return "".join(f"<s>[INST] {re.sub('[%\n<[]', lambda m: _ROLE[m[0]], role)}\n{escape(text)} [/INST]</s>" for role, text in turns)


def read_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """Turns of a formatted text: role, text, and where the escaped text begins and ends."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        role = re.sub("%(25|0A|3C|5B)", lambda x: chr(int(x[1], 16)), m[1])
        out.append((role, unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def _kept(old: str, new: str) -> int:
    """How many characters of ``old`` stand unchanged at the beginning of ``new``."""
    if new.startswith(old):
        return len(old)
    return next((i for i, (a, b) in enumerate(zip(old, new)) if a != b), min(len(old), len(new)))


class Rendering:
    """A conversation's turns, one after the other."""

    def __init__(self, render: Template, context: int | None):
        self.render, self.context = render, context
        self.before: list[Turn] = []
        self.old, self.n = "", 0  # what the turns before render to, turns so far

    def add(self, turn: Turn) -> tuple[str, bool | None, int, int, int]:
        """The turn's segment, whether history was rewritten (null: not all of it was compared), characters kept, start and end of the text in the segment."""
        cut = self.context is not None and self.n > self.context
        if cut:
            del self.before[: len(self.before) - self.context]
            self.old = self.render(self.before)
        new, probed = self.render([*self.before, turn]), self.render([*self.before, (turn[0], PROBE)])
        kept, whole = _kept(self.old, new), len(self.old)
        segment, self.old, self.n = new[kept:], new, self.n + 1
        self.before.append(turn)
        place = probed.rfind(PROBE)
        start, end = (max(0, place - kept), len(segment) - (len(probed) - place - len(PROBE))) if place >= 0 else (0, 0)  # else the template doesn't show the text
        return segment, kept < whole or (None if cut else False), kept, start, end


_SEGMENTS = pa.schema(
    [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("segment", pa.string()), ("start", pa.int64()), ("rewritten", pa.bool_()), ("kept", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_())]
)


def _render(render: Template, context: int | None, trained: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, start = none, 0
        for batch in batches:
            out = []
            for conv_id, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if conv_id != conv:
                    conv, start, turns = conv_id, 0, Rendering(render, context)
                segment, rewritten, kept, a, b = turns.add((role, text))
                out.append((conv_id, turn, role, segment, start, rewritten, kept, start + a, start + b, role == trained))
                start += len(segment)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SEGMENTS)] if out else [pa.array([], f.type) for f in _SEGMENTS], schema=_SEGMENTS)

    return run


def format_turns(turns: DataFrame, render: Template = template, context: int | None = None, trained: str = "assistant") -> DataFrame:
    """One row per turn of (conv_id, turn, role, text): its segment of the formatted conversation.

    conv_id, turn, role, segment, start (in the formatted text), rewritten, kept, text_start, text_end
    (of the escaped text, in the formatted text), loss. The segments of a conversation, in order,
    are its formatted text; rows of a conversation stay together and in order. ``rewritten`` is null where ``context`` left prefixes out.
    """
    rows = small_batches(turns).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_render(render, context, trained), "conv_id long, turn long, role string, segment string, start long, rewritten boolean, kept long, text_start long, text_end long, loss boolean")


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewritten", pa.bool_())])


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = object()
    conv, state = none, None

    def row():
        return conv, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["rewritten"]

    for batch in batches:
        out = []
        for conv_id, segment, start, rewritten, a, b, loss in zip(*(c.to_pylist() for c in batch.columns)):
            if conv_id != conv:
                if state:
                    out.append(row())
                conv, state = conv_id, {"n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "rewritten": False}
            for role, text, _, _ in read_turns(segment):
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode())
            if loss:
                masked = unescape(segment[a - start : b - start])
                state["loss_chars"] += len(masked)
                state["loss"].update(masked.encode())
            state["chars"] += len(segment)
            state["rewritten"] = True if rewritten or state["rewritten"] else None if rewritten is None else state["rewritten"]
        yield _batch(out)
    if state:
        yield _batch([row()])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_READ)], schema=_READ)


def read_back(segments: DataFrame) -> DataFrame:
    """One row per conversation of format_turns' result with the module's template, parsed again.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewritten.
    """
    return segments.select("conv_id", "segment", "start", "rewritten", "text_start", "text_end", "loss").mapInArrow(
        _read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean"
    )


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(format_turns(turns.unionByName(extra)))


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text, '\\|<s>|</s>|\[INST\]|\[/INST\]', '\0\\', 'g') AS escaped,
    replace(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C'), '[', '%5B') AS shown FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<s>[INST] ') + length(shown) + 1 + length(escaped) + length(' [/INST]</s>')) AS BIGINT) AS formatted_chars,
  false AS rewritten
FROM e GROUP BY conv_id
"""
