r"""Conversation structure repair by Four-Russians block tables.

A conversation's rows are edited at least cost so that their roles, by first letters, read ``(s?(ua)+)?``. The pattern has four
states; what the rest of a conversation costs from each of them is a vector of four numbers, of which, up to a common
offset, only a few dozen occur. So for every such vector to the right of a block of ``BLOCK`` rows and for every block of symbols (a row's
symbol is its role's letter and its fault), the vector to the left, the offset, and the state in which each state leaves the block
are tables, worked out once. A conversation is read from its end, a block a lookup; then from its start, where each block is expanded
backward from the vector at its right, and in each state the least letter is taken among the edits that keep the cost.

Rows are dealt by ranges of their order, not by conversation: a long conversation spans several tasks. A task sums up its piece of such
a conversation as a table over all vectors and states (two small rows a task at most), the pieces are put together, and each piece is traced
on its own. Only the digest of a conversation's repaired text, which is sequential by nature, is made piece after piece.

Order: by turn (nulls first), then role, then the text's digest, repeated rows last by their place in the input. Nulls: a null role or text is one
space, a null id is a conversation of its own. A role without letters s, u, a at its start, the empty one too, can be kept nowhere. Blank texts and
repeats of role and text are deleted. Very long texts move once. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aforo.llm.common import checkpoint, small_batches
from aforo.llm.merkle import CRC32_SQL

#: Rows of a block; costs of edits and of a truncated row that stays.
BLOCK, KEEP, REROLE, DELETE, INSERT, TRUNCATED = 4, 0, 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a. The state that a user or assistant row leads to, and that row's role.
START, S, U, A = range(4)
AFTER, ROLE = (U, U, A, U), ("user", "user", "assistant", "user")
#: Faults of a row, and the symbol of one that has to go; others are 2 * (place of the letter in "sua", 3 for any other) + (1 if truncated).
BLANK, DUPLICATE, CUT = 1, 2, 3
GONE, SYMBOLS = 8, 9


def _kept(symbol: int, state: int) -> int | None:
    """The state after a row that is kept, if it may be."""
    letter = symbol >> 1
    if letter == 0:
        return S if state == START else None
    return (U, A)[letter - 1] if letter < 3 and AFTER[state] == (U, A)[letter - 1] else None


def _before(symbol: int, right: tuple[int, ...]) -> list[int]:
    """What the rest costs from each state before a row, given what it costs after it."""
    out = [DELETE + c for c in right]
    if symbol != GONE:
        extra = TRUNCATED * (symbol & 1)
        for q in range(4):
            out[q] = min(out[q], REROLE + extra + right[AFTER[q]])
            if (to := _kept(symbol, q)) is not None:
                out[q] = min(out[q], KEEP + extra + right[to])
    return inserted(out)


def inserted(costs: list[int]) -> list[int]:
    """Costs where rows may be inserted first."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[AFTER[q]]) for q, c in enumerate(costs)]
    return costs


def _edits(symbol: int, right: tuple[int, ...], state: int) -> tuple[str, int]:
    """The least letters that consume a row at least cost, and the state after it."""
    left, letters, extra = _before(symbol, right), "", TRUNCATED * (symbol & 1)
    while True:
        if DELETE + right[state] == left[state]:
            return letters + "D", state
        if INSERT + left[AFTER[state]] == left[state]:
            letters, state = letters + "I", AFTER[state]
            continue
        to = _kept(symbol, state)
        if to is not None and KEEP + extra + right[to] == left[state]:
            return letters + "K", to
        return letters + "R", AFTER[state]


class Tables:
    """Transitions of normalised cost vectors by symbol and by block."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        end = inserted([0, 10**6, 10**6, 0])
        self.vectors, at = [tuple(end)], {tuple(end): 0}
        one: list[list[int]] = []
        for v in self.vectors:  # grows while it is read
            row = []
            for x in range(SYMBOLS):
                left = _before(x, v)
                normal = tuple(c - min(left) for c in left)
                if normal not in at:
                    at[normal] = len(self.vectors)
                    self.vectors.append(normal)
                row.append(at[normal])
            one.append(row)
        self.one = one
        self.edits = [[[_edits(x, v, q) for q in range(4)] for x in range(SYMBOLS)] for v in self.vectors]
        steps, leave = np.array(one), np.array([[[e[1] for e in of] for of in row] for row in self.edits])
        # blocks: symbols from the left are the digits from the left
        digits = np.arange(SYMBOLS**block)[:, None] // SYMBOLS ** np.arange(block)[::-1] % SYMBOLS
        v = np.repeat(np.arange(len(self.vectors))[:, None], len(digits), axis=1)
        out = np.broadcast_to(np.arange(4), (*v.shape, 4))
        for d in digits.T[::-1]:
            out = np.take_along_axis(out, leave[v, d[None, :]], axis=2)
            v = steps[v, d[None, :]]
        self.left, self.leave = v.astype(np.int16), out.astype(np.int8)
        self.one_left, self.one_leave = steps.astype(np.int16), leave.astype(np.int8)

    def codes(self, symbols: list[int]) -> list[int]:
        """The blocks of a piece, from its start; what is left over at its end is not in them."""
        whole = np.array(symbols[: len(symbols) // self.block * self.block], np.int64).reshape(-1, self.block)
        return (whole @ SYMBOLS ** np.arange(self.block)[::-1]).tolist()

    def summary(self, symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """A piece as a table: for each vector at its right the vector at its left, and the state in which each state leaves it."""
        codes = self.codes(symbols)
        v, out = np.arange(len(self.vectors)), np.broadcast_to(np.arange(4), (len(self.vectors), 4))
        for x in reversed(symbols[len(codes) * self.block :]):
            out, v = np.take_along_axis(out, self.one_leave[v, x], axis=1), self.one_left[v, x]
        for c in reversed(codes):
            out, v = np.take_along_axis(out, self.leave[v, c], axis=1), self.left[v, c]
        return v, out

    def trace(self, symbols: list[int], right: int, state: int) -> tuple[list[str], int]:
        """The letters of each row of a piece, and the state after it, given the vector at its right and the state before it."""
        codes, rest = self.codes(symbols), symbols[len(symbols) // self.block * self.block :]
        inner = self._expand(rest, right)
        at = [self.one[inner[0]][rest[0]] if rest else right]  # vectors at the right of each block, from the last
        for c in reversed(codes[1:]):
            at.append(int(self.left[at[-1], c]))
        letters = []
        for k in range(len(codes)):
            block = symbols[k * self.block : (k + 1) * self.block]
            for x, v in zip(block, self._expand(block, at[len(codes) - 1 - k])):
                edit, state = self.edits[v][x][state]
                letters.append(edit)
        for x, v in zip(rest, inner):
            edit, state = self.edits[v][x][state]
            letters.append(edit)
        return letters, state

    def _expand(self, symbols: list[int], right: int) -> list[int]:
        """The vector at the right of each row, backward from the one at the right of all."""
        out = [right]
        for x in reversed(symbols[1:]):
            out.append(self.one[out[-1]][x])
        return out[::-1] if symbols else []

    def closing(self, state: int) -> str:
        """Letters after the last row."""
        return "I" * (self.vectors[0][state] // INSERT)


@functools.cache
def tables(block: int = BLOCK) -> Tables:
    return Tables(block)


def _symbols(batch: pa.RecordBatch) -> list[int]:
    fault, letter = (batch.column(c).to_numpy() for c in ("fault", "letter"))
    return np.where((fault == BLANK) | (fault == DUPLICATE), GONE, 2 * letter + (fault == CUT)).tolist()


def _pieces(batches: Iterable[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[object, list[list]]]:
    """(conv_id, values of symbol and the columns) of each conversation in a task's rows."""
    conv, held = None, None
    for batch in batches:
        lists = [batch.column(c).to_pylist() for c in columns]
        symbols = _symbols(batch)
        for i, c in enumerate(batch.column("conv_id").to_pylist()):
            if held is None or c != conv:
                if held is not None:
                    yield conv, held
                conv, held = c, [[] for _ in range(len(columns) + 1)]
            held[0].append(symbols[i])
            for to, values in zip(held[1:], lists):
                to.append(values[i])
    if held is not None:
        yield conv, held


_SUMMARY_DDL = "part int, conv_id long, lefts array<int>, leaves array<int>, last string"


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries of the first and the last conversation of a task, the only ones that may go on elsewhere."""
    first, last = None, None
    for conv, (symbols, parts, initials) in _pieces(batches, ("part", "initial")):
        last = parts[0], conv, symbols, initials[-1]
        first = first or last
    rows = [(p, c, *(x.ravel().tolist() for x in tables().summary(s)), i) for p, c, s, i in ([first, last] if first and last[1] != first[1] else [first] if first else [])]
    types = (pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["part", "conv_id", "lefts", "leaves", "last"])


def stitch(pieces: pd.DataFrame) -> pd.DataFrame:
    """Of a conversation's pieces: the vector at the right of each, the state before it, the letter before it, whether it is the last."""
    pieces = pieces.sort_values("part").reset_index(drop=True)
    n = len(pieces)
    right, state = [0] * n, [START] * n
    for k in range(n - 1, 0, -1):
        right[k - 1] = int(pieces.lefts[k][right[k]])
    for k in range(n - 1):
        state[k + 1] = int(pieces.leaves[k][4 * right[k] + state[k]])
    return pd.DataFrame({"part": pieces.part, "conv_id": pieces.conv_id, "right": right, "state": state, "before": [None, *pieces["last"][:-1]], "closes": [k == n - 1 for k in range(n)], "n": n})


_OUT = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("nth", pa.int32()), ("whole", pa.bool_()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("lines", pa.string())])
_OUT_DDL = "conv_id long, part int, nth int, whole boolean, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, lines string"
_COSTS = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
#: Rows of a cut conversation's piece that travel together.
_TOGETHER = 256


def repaired(letters: list[str], roles: list[str], texts: list[str], state: int) -> list[list[str]]:
    """The lines that each row's letters leave."""
    out = []
    for edits, role, text in zip(letters, roles, texts):
        lines = []
        for e in edits:
            if e == "I":
                lines.append(f"{ROLE[state]}:")
            elif e != "D":
                lines.append(f"{role if e == 'K' else ROLE[state]}:{text}")
            if e == "K" and role[:1] == "s":
                state = S
            elif e != "D":
                state = AFTER[state]
        out.append(lines)
    return out


def _repair(cut):
    """A row for each conversation; of those in ``cut`` pieces whose lines are yet to be joined."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rows, size = tables(), [], 0
        for conv, (symbols, parts, faults, initials, roles, texts) in _pieces(batches, ("part", "fault", "initial", "role", "text")):
            right, state, before, closes = cut.value.get((parts[0], conv), (0, START, None, True))
            letters, end = table.trace(symbols, right, state)
            last = table.closing(end) if closes else ""
            chain = [*([] if before is None else [before]), *initials]
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(chain, chain[1:]))
            cost = sum(_COSTS[e] for x in letters for e in x) + INSERT * len(last) + TRUNCATED * sum(f == CUT and x[-1] != "D" for f, x in zip(faults, letters))
            lines = repaired([*letters, last], [*roles, ""], [*texts, ""], state)
            counts = (*(sum(f == k for f in faults) for k in (BLANK, DUPLICATE, CUT)), illegal, cost, "".join(letters) + last)
            if (parts[0], conv) not in cut.value:
                rows.append((conv, parts[0], 0, True, *counts, hashlib.sha256("\n".join(x for own in lines for x in own).encode()).hexdigest(), None))
            else:
                for nth, at in enumerate(range(0, len(lines), _TOGETHER)):
                    some = [x for own in lines[at : at + _TOGETHER] for x in own]
                    rows.append((conv, parts[0], nth, False, *(counts if nth == 0 else (0,) * 5 + ("",)), None, "\n".join(some) if some else None))
            if len(rows) >= 1000 or rows[-1][-1] is not None:
                yield from _batches(rows)
                rows = []
        yield from _batches(rows)

    return run


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 64 if rows and rows[-1][-1] is not None else 1000):
        some = rows[at : at + (64 if rows[-1][-1] is not None else 1000)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], f.type) for i, f in enumerate(_OUT)], schema=_OUT)


def _join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of cut conversations, sorted, to one row each; nothing is held but the digest and the audit."""
    conv, state = None, None

    def row() -> pa.RecordBatch:
        counts, audit, digest, _ = state
        return next(_batches([(conv, 0, 0, True, *counts, "".join(audit), digest.hexdigest(), None)]))

    for batch in batches:
        for r in batch.to_pylist():
            if state is None or r["conv_id"] != conv:
                if state:
                    yield row()
                conv, state = r["conv_id"], [[0] * 5, [], hashlib.sha256(), False]
            state[0] = [a + r[c] for a, c in zip(state[0], ("blank", "duplicate", "truncated", "illegal", "cost"))]
            state[1].append(r["audit"])
            if r["lines"] is not None:
                state[2].update(("\n" * state[3] + r["lines"]).encode())
                state[3] = True
    if state:
        yield row()


_SPACE = " \t\n\x0b\f\r"


def faults(turns: DataFrame) -> DataFrame:
    """The rows with fault (null, BLANK, DUPLICATE or CUT as a number, 0 for none), initial and letter (its place in "sua", else 3)."""
    core = F.btrim("text", F.lit(_SPACE))
    text = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = turns.select("conv_id", "turn", "role", "text", F.unhex(F.sha2(text.cast("binary"), 256)).alias("same"), (core == "").alias("blank"), (~F.substring(core, -1, 1).isin(".", "!", "?")).alias("open"))
    rows = checkpoint(rows).withColumn("nth", F.monotonically_increasing_id())
    place = F.struct(F.col("turn").isNotNull(), "turn", "nth")  # nulls first
    firsts = rows.groupBy("conv_id", "same").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = checkpoint(firsts.select(F.col("conv_id").alias("of"), F.col("same").alias("first_same"), "first"))  # so that the join is a plain one, which Spark splits where a key is large
    known = rows.join(firsts, rows.conv_id.eqNullSafe(firsts.of) & (rows.same == firsts.first_same), "left")
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNotNull() & (place > F.col("first")), DUPLICATE).when(F.col("open"), CUT).otherwise(0)
    letter = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return known.select("conv_id", "turn", "role", "text", "same", "nth", fault.cast("int").alias("fault"), initial.alias("initial"), letter.cast("int").alias("letter"))


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text), without nulls in role and text.

    conv_id, blank, duplicate, truncated, illegal (neighbours that may not follow each other), cost, audit (the edits' letters), repaired_sha256.
    """
    order = ["conv_id", "turn", "role", "same", "nth"]
    rows = checkpoint(faults(small_batches(turns)).repartitionByRange(*order).sortWithinPartitions(*order))  # ranges stay partitions
    rows = rows.withColumn("part", F.spark_partition_id())
    ends = checkpoint(rows.select("conv_id", "part", "initial", "fault", "letter").mapInArrow(_ends, _SUMMARY_DDL))
    joined = ends.groupBy("conv_id").applyInPandas(stitch, "part int, conv_id long, right int, state int, before string, closes boolean, n int")
    cut = {(r.part, r.conv_id): (r.right, r.state, r.before, r.closes) for r in joined.filter("n > 1").collect()}  # two a task at most
    found = checkpoint(rows.select("conv_id", "part", "fault", "letter", "initial", "role", "text").mapInArrow(_repair(rows.sparkSession.sparkContext.broadcast(cut)), _OUT_DDL))
    long = found.filter("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "nth").mapInArrow(_join, _OUT_DDL)
    return found.filter("whole").unionByName(long).select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), damaged by CRC-32 of ``conv_id:turn``; nulls of all four are one space there."""
    words = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(words[0], F.lit(":"), words[1]).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(words[3], "[.!?]", "")).otherwise(words[3])
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(words[2]).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"))
    return rows.filter("times > 0").withColumn("copy", F.explode(F.expr("sequence(1, times)"))).drop("copy", "times")


def gaps(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps): turns that are missing between a conversation's first and last."""
    distinct = turns.filter(F.col("turn").isNotNull()).groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    return distinct.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    damaged = damage(turns)
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    done, missing = repair(damaged).withColumnRenamed("conv_id", "c1"), gaps(damaged).withColumnRenamed("conv_id", "c2")
    out = every.join(done, every.conv_id.eqNullSafe(done.c1), "left").join(missing, every.conv_id.eqNullSafe(missing.c2), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


_CRC = CRC32_SQL.format("(c || ':' || t)")
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP13_SQL = f"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') AS c, coalesce(CAST(turn AS VARCHAR), ' ') AS t, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations
), marked AS (
  SELECT *, {_CRC} % 20 AS kind FROM given
), damaged AS (
  SELECT conv_id, turn, c, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM marked WHERE kind <> 0
), placed AS (
  SELECT *, trim(text, {_SPACES}) AS core, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), faulty AS (
  SELECT *, CASE WHEN core = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS initial,
    lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS before
  FROM placed
), symbols AS (
  SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM faulty
), ends AS (
  SELECT c, max(i) AS n FROM symbols GROUP BY c
), raw AS (SELECT 1000000 AS no), back(c, i, g) AS (
  SELECT c, n + 1, [0, 10, 5, 0] FROM ends
  UNION ALL
  SELECT c, i, [least(h[1], 5 + h[3], 10 + h[4]), least(h[2], 5 + h[3], 10 + h[4]), least(h[3], 5 + h[4]), least(h[4], 5 + h[3])] FROM (
    SELECT s.c, s.i, [
      least(2 + g[1], CASE WHEN gone THEN no ELSE 1 + extra + g[3] END, CASE WHEN gone THEN no WHEN initial = 's' THEN extra + g[2] WHEN initial = 'u' THEN extra + g[3] ELSE no END),
      least(2 + g[2], CASE WHEN gone THEN no ELSE 1 + extra + g[3] END, CASE WHEN initial = 'u' AND NOT gone THEN extra + g[3] ELSE no END),
      least(2 + g[3], CASE WHEN gone THEN no ELSE 1 + extra + g[4] END, CASE WHEN initial = 'a' AND NOT gone THEN extra + g[4] ELSE no END),
      least(2 + g[4], CASE WHEN gone THEN no ELSE 1 + extra + g[3] END, CASE WHEN initial = 'u' AND NOT gone THEN extra + g[3] ELSE no END)] AS h
    FROM back b JOIN symbols s ON s.c = b.c AND s.i = b.i - 1, raw)
), trace(c, i, q, audit, lines) AS (
  SELECT c, 1, 1, '', CAST([] AS VARCHAR[]) FROM ends
  UNION ALL
  SELECT c, CASE WHEN letter = 'I' THEN i ELSE i + 1 END, CASE letter WHEN 'D' THEN q WHEN 'K' THEN kept ELSE after END, audit || letter,
    CASE letter WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
      ELSE list_append(lines, CASE WHEN q = 3 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN letter = 'R' THEN text ELSE '' END) END
  FROM (
    SELECT *, CASE WHEN role IS NULL THEN 'I' WHEN 2 + g[q] = h[q] THEN 'D' WHEN 5 + h[after] = h[q] THEN 'I' WHEN kept > 0 AND extra + g[kept] = h[q] THEN 'K' ELSE 'R' END AS letter
    FROM (
      SELECT t.*, s.role, s.text, s.extra, l.g AS h, r.g, CASE WHEN t.q = 3 THEN 4 ELSE 3 END AS after,
        CASE WHEN s.gone THEN 0 WHEN s.initial = 's' AND t.q = 1 THEN 2 WHEN s.initial = 'u' AND t.q <> 3 THEN 3 WHEN s.initial = 'a' AND t.q = 3 THEN 4 ELSE 0 END AS kept
      FROM trace t JOIN back l ON l.c = t.c AND l.i = t.i LEFT JOIN back r ON r.c = t.c AND r.i = t.i + 1 LEFT JOIN symbols s ON s.c = t.c AND s.i = t.i
      WHERE s.role IS NOT NULL OR l.g[t.q] > 0))
), done AS (
  SELECT c, arg_max(audit, length(audit)) AS audit, arg_max(lines, length(audit)) AS lines FROM trace GROUP BY c
), counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM symbols GROUP BY c
)
SELECT DISTINCT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(b.g[1], 0) AS BIGINT) AS cost, coalesce(d.audit, '') AS audit, sha256(coalesce(array_to_string(d.lines, chr(10)), '')) AS repaired_sha256
FROM given g LEFT JOIN counts k USING (c) LEFT JOIN done d USING (c) LEFT JOIN back b ON b.c = g.c AND b.i = 1
"""
