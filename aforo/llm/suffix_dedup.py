"""Repeated passages by sparse suffix arrays.

Of a text's suffixes (sequences of words) only those at content-selected positions are retained: the
minimisers, where the hash of the next ``GRAM`` words is least among ``SPREAD`` in a row. Equal passages
of ``LEAST`` words have a minimiser at the same place within their first ``SPREAD`` words, so that at
least ``LEAST - SPREAD + 1`` words to its right are equal; suffixes whose next so many words
occur once in the table (counted with map-side aggregation) are left out. The others are brought together by
these words, sorted by their words, and neighbours compared: how many words they share to the right, and, extended to the left,
before it. A suffix carries as many words to either side as any match needs to be seen in full
from one of its suffixes. What neighbours share is confirmed; a suffix whose neighbours have other words to the left is
compared with all that share its words to the right, by the words to the left of each length. Confirmed stretches of a text are united.

Groups of suffixes are settled in their task; a group of more than ``LARGE`` is dealt to several tasks by the words
around its suffixes, and of its runs of ``LEAST`` words those that are single in their part are counted by their hash in a second shuffle, where
each part sends a run once, so that memory and time of a task are bounded whatever the number of copies of a passage. Before
the first shuffle the suffixes of a slice that have the same words around them become one row.

Which suffixes to leave out workers read from a bit table with ``KEY_BITS`` bits for each repeated key, as counted, which is broadcast. Where
that would take over ``MOST_BITS``, keys meet the minimisers' (key, row, position) in a join instead, and words move for those found
only. A table of group sizes of fixed size is broadcast as well; when it fills up, more groups are dealt out and results stay the same.

Words are compared without regard to the case of A to Z and to white space. Nulls: a null text is
empty; a null id is carried. Rows that repeat are copies of each other. Texts under ``LEAST`` words have
no passages. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aforo.llm.common import checkpoint, hash_words, mix64, slices, small_batches, split_words

#: Words of a passage at least, words hashed at a position, positions a minimiser is the least of.
LEAST, GRAM, SPREAD = 50, 8, 32
#: Words to the right that are equal for sure; suffixes of a group that a task settles alone; slots of group sizes.
SURE, LARGE, SIZES = LEAST - SPREAD + 1, 2_000, 1 << 20
#: Bits of the table for a repeated key, at least, and at most (16 MB).
KEY_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 27

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _run_hashes(prefix: np.ndarray, back: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, by where they start."""
    return mix64((prefix[size:] - prefix[: len(prefix) - size]) * back[: len(prefix) - size])


def minimisers(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Retained positions of all texts, the hash of the SURE words at each, and the text of each."""
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n < LEAST:
        return none, np.zeros(0, np.uint64), none
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_BASE, n), dtype=np.uint64)])
    back = _powers(_INVERSE, n)
    key = _run_hashes(prefix, back, GRAM)
    whole = SPREAD + GRAM - 1
    fits = np.arange(len(key)) + whole <= offsets[owner[: len(key)] + 1]
    low = key
    for s in (1, 2, 4, 8, 16):  # the least of SPREAD = 32 keys from each position
        low = np.minimum(low[:-s], low[s:])
    low = np.where(fits[: len(low)], low, np.uint64(0))
    high = np.zeros(len(key), np.uint64)  # the greatest of those least keys over all runs that hold a position
    high[: len(low)] = low
    for s in (1, 2, 4, 8, 16):
        more = high.copy()
        more[s:] = np.maximum(high[s:], high[:-s])
        high = more
    at = np.flatnonzero((high == key) & (key > 0))
    at = at[at + SURE <= offsets[owner[at] + 1]]
    return at, _run_hashes(prefix, back, SURE)[at], owner[at]


def table_bits(keys: int) -> int:
    """Bits of the table for so many keys: a power of two."""
    return max(LEAST_BITS, 1 << max(0, KEY_BITS * keys - 1).bit_length())


def _place(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    p = h & np.uint64(bits - 1)
    return (p >> np.uint64(3)).astype(np.int64), (p & np.uint64(7)).astype(np.uint8)


def _hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, "text"):
        words, offsets = split_words(piece.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array(minimisers(hash_words(words), offsets)[1].view(np.int64))], names=["h"])


def _positions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, row, at) of each minimiser; at counts words of its text."""
    for piece in slices(batches, "text"):
        words, offsets = split_words(piece.column("text"))
        at, h, owner = minimisers(hash_words(words), offsets)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), piece.column("row").take(pa.array(owner)), pa.array((at - offsets[owner]).astype(np.int32))], names=["h", "row", "at"])


def _bits(bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits // 8, np.uint8)
        for b in batches:
            at, bit = _place(b.column(0).to_numpy().view(np.uint64), bits)
            np.bitwise_or.at(table, at, np.uint8(1) << bit)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at].astype(np.int32))], names=["at", "bits"])

    return run


_SUFFIX = pa.schema([("h", pa.int64()), ("salt", pa.int32()), ("ahead", pa.binary()), ("behind", pa.binary()), ("rows", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])


def _suffixes(shared):
    """Suffixes in the table, or at the positions found; those of a slice with the same words around them are one row with all places.

    The salt is 0, or in large groups a number from 1 by the words around the suffix.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, levels = shared.value
        for piece in slices(batches, "text"):
            words, offsets = split_words(piece.column("text"))
            hashes = hash_words(words)
            at, h, owner = minimisers(hashes, offsets)
            if table is not None:
                where, bit = _place(h, 8 * len(table))
                hit = ((table[where] >> bit) & np.uint8(1)).astype(bool)
            else:
                found = piece.column("found")  # each text's positions
                begins = np.repeat(offsets[:-1], np.diff(found.offsets.to_numpy()))
                hit = np.isin(at, found.flatten().to_numpy() + begins)
            at, h, owner = at[hit], h[hit], owner[hit]
            short = (hashes >> np.uint64(32)).astype(">u4")
            raw, turned, n = short.tobytes(), short[::-1].tobytes(), len(short)
            begin, end = offsets[owner], offsets[owner + 1]
            right, left = np.minimum(end, at + LEAST), np.maximum(begin, at - SPREAD + 1)
            rows, ids = (piece.column(c).to_pylist() for c in ("row", "doc_id"))
            same: dict[tuple[int, bytes, bytes], tuple[list, list, list]] = {}
            for x, a, r, l, o, p in zip(h.view(np.int64).tolist(), at.tolist(), right.tolist(), left.tolist(), owner.tolist(), (at - begin).tolist()):
                places = same.setdefault((x, raw[4 * a : 4 * r], turned[4 * (n - a) : 4 * (n - l)]), ([], [], []))
                places[0].append(rows[o])
                places[1].append(ids[o])
                places[2].append(p)
            level = levels[np.array([k[0] for k in same], np.int64).view(np.uint64) & np.uint64(SIZES - 1)].tolist()
            salts = [1 + (xxhash.xxh3_64_intdigest(k[1] + k[2]) & (1 << n) - 1) if n else 0 for k, n in zip(same, level)]
            cols = [[k[0] for k in same], salts, [k[1] for k in same], [k[2] for k in same]] + [[v[i] for v in same.values()] for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SUFFIX)], schema=_SUFFIX)

    return run


_FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("h", pa.int64()), ("w", pa.int64())])


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row for each suffix: SPREAD - 1 words before the minimiser and LEAST from there on (0 where there are none), how many there are of either."""
    size = SPREAD - 1
    words = np.zeros((batch.num_rows, size + LEAST), np.uint64)
    ahead, behind = (pc.binary_length(batch.column(c)).to_numpy() // 4 for c in ("ahead", "behind"))
    for part, column, lengths in ((words[:, size:], "ahead", ahead), (words[:, :size][:, ::-1], "behind", behind)):
        flat = np.frombuffer(b"".join(batch.column(column).to_pylist()), ">u4")
        part[np.arange(part.shape[1]) < lengths[:, None]] = flat
    return words, ahead, behind


def _run_keys(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A row for each suffix: of its runs that begin SPREAD - 1 words before the minimiser, ..., at it the hashes."""
    prefix = np.zeros((len(words), words.shape[1] + 1), np.uint64)
    np.cumsum(words * _powers(_BASE, words.shape[1]), axis=1, dtype=np.uint64, out=prefix[:, 1:])
    keys = mix64((prefix[:, LEAST:] - prefix[:, :SPREAD]) * _powers(_INVERSE, SPREAD))
    # runs seen from different minimisers are different ones
    return mix64(keys + h.view(np.uint64)[:, None] * np.uint64(_BASE) + np.arange(SPREAD).astype(np.uint64))


def shared_words(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words rows of a and b share from the start, ``most`` at most."""
    differs = np.concatenate([a != b, np.ones((len(a), 1), bool)], axis=1)
    return np.minimum(differs.argmax(axis=1), most)


def repeated_runs(h: np.ndarray, words: np.ndarray, ahead: np.ndarray, behind: np.ndarray, there: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which runs of each suffix (by where they begin, as in ``there``) occur at another place too: sort, compare neighbours, extend."""
    n, size = len(h), SPREAD - 1
    out = there & (places > 1)[:, None]
    if n < 2:
        return out
    text = np.ascontiguousarray(np.concatenate([h.view(np.uint64)[:, None], words[:, size:]], axis=1).astype(">u8")).view(f"S{8 * (LEAST + 1)}").ravel()
    order = np.argsort(text, kind="stable")
    back_words, fits = words[:, :size][:, ::-1][order], there[order]
    one, two = order[:-1], order[1:]
    right = np.where(h[one] == h[two], shared_words(words[one, size:], words[two, size:], np.minimum(ahead[one], ahead[two])), 0)
    left = shared_words(back_words[:-1], back_words[1:], np.minimum(behind[one], behind[two]))
    need_left = size - np.arange(SPREAD)  # of a run by where it begins
    need_right = LEAST - need_left
    along = right[:, None] >= need_right
    both = along & (left[:, None] >= need_left)
    sure = out[order]
    sure[:-1] |= both
    sure[1:] |= both
    sure &= fits
    # suffixes that share their right words with a neighbour, but not their left words: with all of their class
    beside = np.zeros_like(fits)
    beside[:-1] |= along
    beside[1:] |= along
    if (beside & fits & ~sure).any():
        classes = np.zeros((n, SPREAD), np.int64)
        np.cumsum(~along, axis=0, out=classes[1:])
        prefix = np.zeros((n, SPREAD), np.uint64)
        np.cumsum((back_words + np.uint64(1)) * _powers(_BASE, size), axis=1, dtype=np.uint64, out=prefix[:, 1:])
        key = mix64(mix64(prefix[:, ::-1]) + classes.astype(np.uint64) * np.uint64(SPREAD) + np.arange(SPREAD).astype(np.uint64))
        row, at = np.nonzero(beside & fits)
        _, which, count = np.unique(key[row, at], return_inverse=True, return_counts=True)
        sure[row, at] |= count[which] > 1
    out[order] = sure
    return out


def _settle(batch: pa.RecordBatch, opened: int | None) -> pa.RecordBatch:
    """Runs that occur twice in these suffixes, as stretches; of the group ``opened`` and salted ones also each run once, with its hash.

    Of a run that occurs twice here only the hash counts then, and its row is null.
    """
    words, ahead, behind = _words(batch)
    h, size = batch.column("h").to_numpy(), SPREAD - 1
    places = np.diff(batch.column("at").offsets.to_numpy())
    begins = np.arange(SPREAD)
    there = (begins >= size - behind[:, None]) & (begins + LEAST <= size + ahead[:, None])
    again = repeated_runs(h, words, ahead, behind, there, places)
    twice = np.zeros((len(h), SPREAD + 2), np.int8)
    twice[:, 1:-1] = again
    step = np.diff(twice, axis=1)
    row, begin = np.nonzero(step == 1)
    stop = np.nonzero(step == -1)[1] - 1 + LEAST
    parted = batch.column("salt").to_numpy() > 0
    if opened is not None:
        parted = parted | (h == opened)
    which, at = np.nonzero(there & parted[:, None])
    w = _run_keys(h, words)[which, at].view(np.int64) if len(which) else np.zeros(0, np.int64)
    _, send = np.unique(w, return_index=True)
    repeated = again[which[send], at[send]]
    shared, mine = send[repeated], send[~repeated]
    starts = np.concatenate([[0], np.cumsum(places)])
    times = places[row]
    flat = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(starts[row], times)
    flat = np.concatenate([flat, starts[which[mine]]])
    left = np.concatenate([np.repeat(begin, times), at[mine]]) - size
    right = np.concatenate([np.repeat(stop, times), at[mine] + LEAST]) - size
    rows, ids, where = (batch.column(c).flatten().take(pa.array(flat)) for c in ("rows", "ids", "at"))
    where = where.to_numpy()
    none = np.full(int(times.sum()), 0)
    h_col, w_col = np.concatenate([none, h[which[mine]]]), np.concatenate([none, w[mine]])
    confirmed = np.arange(len(flat)) < len(none)
    own = [rows, ids, pa.array((where + left).astype(np.int32)), pa.array((where + right).astype(np.int32)), pa.array(h_col, mask=confirmed), pa.array(w_col, mask=confirmed)]
    theirs = [*(pa.nulls(len(shared), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())), pa.array(h[which[shared]]), pa.array(w[shared])]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([a.cast(b.type), b]) for a, b in zip(own, theirs)], schema=_FOUND)


def _groups(large: int):
    """From suffixes sorted by h and salt: confirmed stretches (h null), and runs of large groups that are to be counted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, opened = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            h = batch.column("h").to_numpy()
            if batch.column("salt")[-1].as_py():  # other parts of the last group may be anywhere
                yield _settle(batch, opened)
                held = None
                continue
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield _settle(batch.slice(0, cut), opened)
            held = batch.slice(cut)
            if held.num_rows > large:
                opened = int(h[-1])
                yield _settle(held, opened)
                held = None
        if held is not None:
            yield _settle(held, opened)

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, start_word, end_word, n_words) of each stretch of LEAST words or more found elsewhere too.

    Every occurrence is listed, also a second one in the same text; positions count words from 0.
    """
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    repeated = checkpoint(rows.select("text").mapInArrow(_hashes, "h long").groupBy("h").count().filter("count > 1"))
    levels = np.zeros(SIZES, np.uint8)
    large = repeated.filter(F.col("count") > LARGE).groupBy(F.col("h").bitwiseAND(SIZES - 1).alias("at"))
    got = large.agg(F.ceil(F.log2(F.max("count") / LARGE)).alias("level")).toArrow()  # at most SIZES rows
    levels[got.column("at").to_numpy()] = got.column("level").to_numpy().astype(np.uint8)
    bits, table = table_bits(repeated.count()), None
    if bits <= most_bits:
        got = repeated.select("h").mapInArrow(_bits(bits), "at int, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
        table = np.zeros(bits // 8, np.uint8)
        table[got.column("at").to_numpy()] = got.column("bits").to_numpy().astype(np.uint8)
        rows = rows.withColumn("row", F.monotonically_increasing_id())
    else:
        rows = checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))  # numbered once, as rows are found again by their number
        hits = rows.select("row", "text").mapInArrow(_positions, "h long, row long, at int").join(repeated, "h", "left_semi")
        rows = rows.join(hits.groupBy("row").agg(F.collect_list("at").alias("found")), "row")
    shared = docs.sparkSession.sparkContext.broadcast((table, levels))
    suffixes = rows.mapInArrow(_suffixes(shared), "h long, salt int, ahead binary, behind binary, rows array<long>, ids array<long>, at array<int>")
    order = suffixes.repartition("h", "salt").sortWithinPartitions("h", "salt")
    found = checkpoint(order.mapInArrow(_groups(LARGE), "row long, doc_id long, start int, end int, h long, w long"))
    runs = found.filter(F.col("h").isNotNull()).groupBy("h", "w").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("row").isNotNull(), F.struct("row", "doc_id", "start", "end"))).alias("places"))
    found = found.filter(F.col("h").isNull()).select("row", "doc_id", "start", "end").unionByName(runs.filter("n > 1").select(F.explode("places").alias("p")).select("p.*"))
    # stretches of a row that touch or overlap are united: a new one begins where none before reaches
    own = Window.partitionBy("row").orderBy("start", "end")
    reached = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    spans = found.withColumn("new", F.when(reached >= F.col("start"), 0).otherwise(1)).withColumn("nth", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    united = spans.groupBy("row", "nth").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start_word"), F.max("end").alias("end_word"))
    return united.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
