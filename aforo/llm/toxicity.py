"""Toxicity by class-conditional Kneser-Ney models of byte 6-grams.

Two models, of toxic and of ordinary labelled texts, share their backoff: the probability of a byte
after five others is discounted per class, and what the discount frees goes to continuation counts
(in how many different 6-grams a shorter one ends) taken over both classes, so that expressions too
rare for either class weigh the same in both. A text's score comes from the logarithm of the ratio of
the two likelihoods, normalised by length: over the whole text and over its most toxic stretches of
fixed lengths. A logistic function fitted on labelled texts left out of the counts turns these into a
probability.

Counts cover all labelled training texts and are made and combined in Spark, and every counted 6-gram
and context scores. What workers have at hand is bounded: tables of ``SLOTS`` log ratios, where of those
that share a slot the most frequent stays, and sorted arrays of the ``HELD`` most frequent of the others.
What is left stays a Spark table; texts ask for what they need of it in a join by 6-gram, and a bit table of
fixed size says what need not be asked. Labels are broadcast only if there are at most
``BROADCAST_LABELS``; beyond, texts and labels meet in a shuffle join.

Texts are measured in pieces of ``PIECE`` bytes, with what the longest stretch needs of the piece before, so
that a worker's memory does not grow with a text. Log ratios are whole numbers (of 2^-20), so that sums are exact
and a score depends on its text alone, not on how rows are dealt or batched.

Nulls: a null text is empty; an empty text has a ratio of one, and so the score the logistic function
gives to that. A null id is never held out nor labelled. Several labels for one id count as the
largest; rows that repeat are scored alike. Without labels of both kinds every score is 0. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aforo.llm.common import checkpoint, distinct_pairs, free_name, mix64, slices, small_batches

ORDER, DISCOUNT = 6, 0.75
#: Slots for 6-grams and for their contexts, prime numbers.
SLOTS, CONTEXT_SLOTS = 2_097_143, 1_048_573
#: Log ratios without a slot that workers hold at most, bits of the filter of those beyond.
HELD, FILTER_BITS = 4_000_000, 1 << 25
#: No key left in a slot; what tells contexts from 6-grams among the ratios without a slot.
_EMPTY, _CONTEXT = 0xFFFFFFFF, 1 << 48
#: Lengths of stretches in bytes, bytes measured at a time, log ratios per unit.
STRETCHES, PIECE, UNIT = (8, 16, 32, 64), 1 << 18, 1 << 20
#: 6-grams that a task holds before it sends their counts on.
COUNTED = 1_000_000
#: Labelled rows that the logistic function is fitted on at most; labels broadcast at most.
FITTED_ROWS, BROADCAST_LABELS = 20_000, 2_000_000
THRESHOLD = 0.3

_SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def _pieces(texts: list[bytes | None], carry: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text, bytes carried over, ORDER bytes of context and the piece), of about PIECE bytes together."""
    out, held = [], 0
    for i, text in enumerate(texts):
        for start in range(0, len(text or b""), PIECE):
            end, first = min(start + PIECE, len(text)), max(0, start - carry)
            out.append((i, start - first, b" " * max(0, ORDER - first) + text[max(0, first - ORDER) : end]))
            held += end - first
            if held >= PIECE:
                yield out
                out, held = [], 0
    if out:
        yield out


def _grams(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """6-grams of all pieces as integers, one for each byte after the context, and the n + 1 offsets of the pieces.

    A to Z are lower-cased, white space is a space.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) - ORDER
    raw = np.frombuffer(b"".join(pieces).lower().translate(_SPACES), np.uint8)
    keep = np.ones(len(raw), bool)
    starts = np.cumsum(sizes + ORDER) - sizes - ORDER
    keep[(starts[:, None] + np.arange(ORDER)).ravel()] = False
    out = np.zeros(len(raw), np.uint64)
    for j in range(ORDER):
        out[j:] |= raw[: len(raw) - j].astype(np.uint64) << np.uint64(8 * j)
    return out[keep], np.concatenate([[0], np.cumsum(sizes)])


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """6-grams of a task's texts with their counts in ordinary (c0) and toxic (c1) ones; several rows for one 6-gram where there are many."""
    held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

    def merge(parts):
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

    def send(c: int) -> Iterator[pa.RecordBatch]:
        keys, n = merge(held[c])
        held[c], zero = [], np.zeros_like(n)
        for at in range(0, len(keys), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[part].astype(np.int64), *((n[part], zero[part]) if c == 0 else (zero[part], n[part])))], names=["g", "c0", "c1"])

    for batch in slices(batches, "text", PIECE):
        toxic = batch.column("toxic").to_pylist()
        for part in _pieces(batch.column("text").to_pylist(), 0):
            for c in (0, 1):
                own = [p for i, _, p in part if toxic[i] == c]
                if own:
                    held[c].append(np.unique(_grams(own)[0], return_counts=True))
                if len(held[c]) > 8:
                    held[c] = [merge(held[c])]
                if held[c] and len(held[c][0][0]) > COUNTED:
                    yield from send(c)
    for c in (0, 1):
        yield from send(c)


def kneser_ney(types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log ratios in units from the counts (g, c0, c1): (g, weight, ratio) by 6-gram and (h, weight, ratio) by context.

    The chain of backoff is 6, 4, 2 and no byte before; each shorter n-gram counts the longer ones that
    end in it, in either class.
    """
    d = DISCOUNT
    s4 = types.groupBy(F.col("g").bitwiseAND(0xFFFFFFFF).alias("k4")).agg(F.count("*").alias("n4"))
    h3 = s4.groupBy(F.shiftright("k4", 8).alias("k3")).agg(F.sum("n4").alias("t3"), F.count("*").alias("u3"))
    s2 = s4.groupBy(F.col("k4").bitwiseAND(0xFFFF).alias("k2")).agg(F.count("*").alias("n2"))
    h1 = s2.groupBy(F.shiftright("k2", 8).alias("k1")).agg(F.sum("n2").alias("t1"), F.count("*").alias("u1"))
    p2 = s2.withColumn("k1", F.shiftright("k2", 8)).join(h1, "k1").select("k2", (F.greatest(F.col("n2") - d, F.lit(0.0)) / F.col("t1") + d * F.col("u1") / F.col("t1") / 256).alias("p2"))
    p4 = s4.withColumns({"k3": F.shiftright("k4", 8), "k2": F.col("k4").bitwiseAND(0xFFFF)}).join(h3, "k3").join(p2, "k2")
    p4 = p4.select("k4", (F.greatest(F.col("n4") - d, F.lit(0.0)) / F.col("t3") + d * F.col("u3") / F.col("t3") * F.col("p2")).alias("p4"))
    keyed = types.withColumns({"h": F.shiftright("g", 8), "k4": F.col("g").bitwiseAND(0xFFFFFFFF)})
    contexts = keyed.groupBy("h").agg(*(f(c) for c in ("0", "1") for f in (lambda c: F.sum(f"c{c}").alias(f"t{c}"), lambda c: F.count_if(F.col(f"c{c}") > 0).alias(f"u{c}"))))

    def freed(c: str) -> Column:
        return F.when(F.col(f"t{c}") > 0, d * F.col(f"u{c}") / F.col(f"t{c}")).otherwise(1.0)

    def p(c: str) -> Column:
        own = F.when(F.col(f"t{c}") > 0, F.greatest(F.col(f"c{c}") - d, F.lit(0.0)) / F.col(f"t{c}")).otherwise(0.0)
        return own + freed(c) * F.col("p4")

    def units(x: Column) -> Column:
        return F.round(F.log(x) * UNIT).cast("int").alias("ratio")

    grams = keyed.join(p4, "k4").join(contexts, "h").select("g", (F.col("c0") + F.col("c1")).alias("weight"), units(p("1") / p("0")))
    return grams, contexts.select("h", (F.col("t0") + F.col("t1")).alias("weight"), units(freed("1") / freed("0")))


def _slots(table: DataFrame, key: str, n: int) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame]:
    """The table as arrays of ``n`` slots, what is left of the key (or all ones) and the ratio; and the rows without a slot."""
    slot = F.pmod(key, F.lit(n)).cast("int").alias("slot")
    best = checkpoint(table.groupBy(slot).agg(F.max(F.struct("weight", key, "ratio")).alias("b")).select("slot", F.col(f"b.{key}").alias("taken"), F.col("b.ratio").alias("ratio")))
    got = best.select("slot", F.expr(f"cast(taken div {n} as long) AS rest"), "ratio").toArrow()
    rest, ratio = np.full(n, _EMPTY, np.uint32), np.zeros(n, np.int32)
    at = got.column("slot").to_numpy()
    rest[at], ratio[at] = got.column("rest").to_numpy().astype(np.uint32), got.column("ratio").to_numpy()
    return (rest, ratio), table.join(best.select(F.col("taken").alias(key)), key, "left_anti")


def _place(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = mix64(keys) & np.uint64(FILTER_BITS - 1)
    return (p >> np.uint64(3)).astype(np.int64), (p & np.uint64(7)).astype(np.uint8)


def _bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    for b in batches:
        at, bit = _place(b.column(0).to_numpy().view(np.uint64))
        np.bitwise_or.at(table, at, np.uint8(1) << bit)
    at = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at].astype(np.int32))], names=["at", "bits"])


_Ratios = tuple[np.ndarray, np.ndarray]
_NONE: _Ratios = np.zeros(0, np.uint64), np.zeros(0, np.int32)


def _sorted(keys: pa.Array, ratios: pa.Array) -> _Ratios:
    keys, first = np.unique(keys.to_numpy().view(np.uint64), return_index=True)
    return keys, ratios.to_numpy()[first]


@dataclass
class Tables:
    """What workers hold of the log ratios."""

    grams: tuple[np.ndarray, np.ndarray]
    contexts: tuple[np.ndarray, np.ndarray]
    held: _Ratios = _NONE
    filter: np.ndarray | None = None

    def _find(self, keys: np.ndarray, context: bool, answers: _Ratios) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of 6-grams or contexts: the ratio, whether there is one, and where only the table may have it."""
        left, ratio = self.contexts if context else self.grams
        rest, slot = np.divmod(keys, np.uint64(len(left)))
        slot = slot.astype(np.int64)
        taken = left[slot]
        known = taken == rest
        x = np.where(known, ratio[slot], 0).astype(np.int64)
        unsure = np.flatnonzero(~known & (taken != _EMPTY))  # who has no slot finds another in it
        for table, ratios in (self.held, answers):
            if len(table) and len(unsure):
                want = keys[unsure] | np.uint64(_CONTEXT * context)
                at = np.minimum(np.searchsorted(table, want), len(table) - 1)
                hit = table[at] == want
                x[unsure[hit]], known[unsure[hit]] = ratios[at[hit]], True
                unsure = unsure[~hit]
        return x, known, unsure

    def asks(self, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(key, text) that the Spark table may have, distinct within each piece."""
        for part in _pieces(texts, 0):
            grams, offsets = _grams([p for _, _, p in part])
            owner = np.repeat([i for i, _, _ in part], np.diff(offsets))
            _, known, unsure = self._find(grams, False, _NONE)
            new = np.flatnonzero(~known)
            h = grams[new] >> np.uint64(8)
            far = self._find(h, True, _NONE)[2]
            keys = np.concatenate([grams[unsure], h[far] | np.uint64(_CONTEXT)])
            at, bit = _place(keys)
            hit = ((self.filter[at] >> bit) & np.uint8(1)).astype(bool)
            yield distinct_pairs(keys[hit], np.concatenate([owner[unsure], owner[new[far]]])[hit])

    def features(self, texts: list[bytes | None], answers: _Ratios = _NONE) -> np.ndarray:
        """Of each text: mean log ratio, the greatest mean over stretches of each length, log length."""
        n = np.array([len(t or b"") for t in texts], np.int64)
        total, best = np.zeros(len(n), np.int64), np.full((len(n), len(STRETCHES)), np.iinfo(np.int64).min)
        for part in _pieces(texts, max(STRETCHES) - 1):
            grams, offsets = _grams([p for _, _, p in part])
            owner = np.array([i for i, _, _ in part])
            x, known, _ = self._find(grams, False, answers)
            x[~known] = self._find(grams[~known] >> np.uint64(8), True, answers)[0]
            sums = np.concatenate([[0], np.cumsum(x)])
            begin, end = offsets[:-1], offsets[1:]
            np.add.at(total, owner, sums[end] - sums[begin + [carried for _, carried, _ in part]])
            for j, w in enumerate(STRETCHES):
                long = np.flatnonzero(end - begin >= w)
                if len(long):
                    run = np.append(sums[w:] - sums[:-w], np.iinfo(np.int64).min)
                    bounds = np.stack([begin[long], end[long] - w + 1], 1).ravel()
                    np.maximum.at(best[:, j], owner[long], np.maximum.reduceat(run, bounds)[::2])
        out = np.zeros((len(n), len(STRETCHES) + 2))
        out[:, 0] = total / np.maximum(n, 1) / UNIT
        for j, w in enumerate(STRETCHES):
            out[:, j + 1] = np.where(n > w, best[:, j], total) / w / UNIT  # of a shorter text: its sum over the length
        out[:, -1] = np.log1p(n)
        return out


def _beyond(others: DataFrame) -> tuple[_Ratios, np.ndarray | None, DataFrame | None]:
    """Ratios without a slot (k, weight, ratio): the most frequent as arrays; of the others the filter and the table."""
    light = F.least("weight", F.lit(10_000))
    sizes = others.groupBy(light.alias("w")).count().orderBy(F.desc("w")).collect()  # at most 10,000 rows
    least, n = None, 0
    for r in sizes:
        n += r["count"]
        if n > HELD:
            break
        least = r.w
    held = others.filter(light >= least) if least is not None else others.limit(0)
    got = held.select("k", "ratio").toArrow().combine_chunks()
    held = _sorted(got.column("k").combine_chunks(), got.column("ratio").combine_chunks()) if got.num_rows else _NONE
    if n <= HELD:
        return held, None, None
    asked = others.filter(light < least if least is not None else F.lit(True)).select("k", "ratio")
    got = asked.select("k").mapInArrow(_bits, "at int, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    bits[got.column("at").to_numpy()] = got.column("bits").to_numpy().astype(np.uint8)
    return held, bits, asked


@dataclass
class Model:
    shared: Broadcast  # of Tables: sent once, for fitting and scoring
    asked: DataFrame | None = None  # (k, ratio) that no worker holds
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None  # the last is the intercept

    def scorer(self):
        """A function from texts and answers to scores, small to send."""
        shared, mean, scale, weights = self.shared, self.mean, self.scale, self.weights

        def score(texts: list[bytes | None], answers: _Ratios = _NONE) -> np.ndarray:
            if weights is None:
                return np.zeros(len(texts))
            x, z = shared.value.features(texts, answers), np.full(len(texts), weights[-1])
            for j in range(x.shape[1]):  # column by column: the same rounding for any number of rows
                z += (x[:, j] - mean[j]) / scale[j] * weights[j]
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

        return score


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and intercept of a logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _answered(rows: DataFrame, model: Model, text_col: str) -> DataFrame:
    """``rows`` with two more columns at the end, keys and ratios from the model's table that their texts ask for."""
    names = [free_name(rows, c) for c in ("keys", "ratios")]
    if model.asked is None:
        return rows.withColumns({names[0]: F.lit(None).cast("array<long>"), names[1]: F.lit(None).cast("array<int>")})
    key = free_name(rows, "key")
    rows = rows.withColumn(key, F.xxhash64(*(F.col(c) for c, t in rows.dtypes if c == text_col or t in ("bigint", "int", "string"))))

    shared = model.shared

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", PIECE):
            for k, owner in shared.value.asks(piece.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays([piece.column("key").take(pa.array(owner)), pa.array(k.view(np.int64))], names=["key", "k"])

    asks = rows.select(F.col(key).alias("key"), F.col(text_col).cast("binary").alias("text")).mapInArrow(ask, "key long, k long").distinct()
    got = asks.join(model.asked, "k").groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("k", "ratio")).alias("a"))
    return rows.join(got, key, "left").withColumns({names[0]: F.col("a.k"), names[1]: F.col("a.ratio")}).drop("a", key)


def _answers(piece: pa.RecordBatch) -> _Ratios:
    keys, ratios = (piece.column(piece.num_columns - i).flatten() for i in (2, 1))
    return _sorted(keys, ratios) if len(keys) else _NONE


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from all labelled rows but those held out; one in eight of them fits the logistic function."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    labels = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    if labels.count() <= BROADCAST_LABELS:
        labels = F.broadcast(labels)
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).filter(crc % 4 != 2).join(labels, "doc_id")
    left_out = crc.bitwiseAND(28) == 0  # the next three bits
    types = rows.filter(~left_out).select("text", "toxic").mapInArrow(_count, "g long, c0 long, c1 long")
    types = checkpoint(types.groupBy("g").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")))
    grams, contexts = map(checkpoint, kneser_ney(types))
    (of_grams, grams), (of_contexts, contexts) = _slots(grams, "g", SLOTS), _slots(contexts, "h", CONTEXT_SLOTS)
    others = grams.select(F.col("g").alias("k"), "weight", "ratio").unionByName(contexts.select(F.col("h").bitwiseOR(F.lit(_CONTEXT)).alias("k"), "weight", "ratio"))
    held, bits, asked = _beyond(checkpoint(others))
    shared, width = docs.sparkSession.sparkContext.broadcast(Tables(of_grams, of_contexts, held, bits)), len(STRETCHES) + 2
    model = Model(shared, asked)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", PIECE):
            x = shared.value.features(piece.column("text").to_pylist(), _answers(piece))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    sample = _answered(rows.filter(left_out).select("doc_id", "toxic", "text"), model, "text").mapInArrow(measure, "doc_id long, toxic int, x array<double>")
    got = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(FITTED_ROWS).toArrow()
    x, y = np.array(got.column("x").to_pylist(), float).reshape(-1, width), got.column("toxic").to_numpy().astype(float)
    if len(set(y)) == 2:
        model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
        model.weights = _logistic((x - model.mean) / model.scale, y)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score."""
    scores = model.scorer()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", PIECE):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(scores(piece.column("text").to_pylist(), _answers(piece)))], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return _answered(rows, model, "text").mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns."""
    scores, at = model.scorer(), docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, text_col, PIECE):
            good = scores(piece.column(at).cast(pa.binary()).to_pylist(), _answers(piece)) < THRESHOLD
            yield piece.select(range(piece.num_columns - 2)).filter(pa.array(good))

    return _answered(docs, model, text_col).mapInArrow(run, docs.schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, fit(docs, labels.select("doc_id", "toxic")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
