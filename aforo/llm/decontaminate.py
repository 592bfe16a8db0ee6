"""Benchmark decontamination by template windows.

Texts are canonicalised word by word: numbers (digits or words) become ``<num>``, units of measure after a number
``<unit>`` and names ``<name>``; other words are lower-cased and lose punctuation. Names are words that begin with a
capital (TOM, DeShawn, O'Brien, Ann-Marie, an initial with its stop), at the beginning of a sentence or line only if they are no common
opening word, and in capitals throughout only between words that are not; names that follow each other in a sentence are one (Mary Ann). A number with its unit in one word (5kg) counts as two. A window is ``WINDOW`` canonical words of an item (a shorter item is one window). A window with
fewer than ``LITERAL`` words that are no slots says too little as a template and stands for itself: it is compared
with the values in its slots. An item of fewer than ``LITERAL`` words is found only in texts of just these words.

Documents and items meet in a hash join of window hashes. An item is found in a document if enough of its distinct
windows are there and the slots agree: what stood in one slot value of the item must be one value in the document, so
that a question asked again with other numbers, names or units is caught, and a chance likeness of templates is not;
or if ``VERBATIM`` words in a row are there, values included.

The documents' windows don't move: each task first asks a filter (a bit table with ``KEY_BITS`` bits for each window of the items,
as counted, up to ``MOST_BITS``, beyond which more windows pass and results stay the same) and only windows that pass, with the values in
their slots and their places, go to the join, where hashes are compared in full. Share and slots are checked
for each place that the item may have in the document: windows as far from the document's beginning as from the
item's, give or take nothing or up to ``SHIFT`` words put in or left out, and also the first occurrences of
all windows, wherever they are. An item is found if any of these passes.

Nulls: null texts are empty, match nothing; a null item or document id is carried as null. Items are told apart by row,
so that ids may repeat or be null. Rows that repeat are reported each. Empty tables give an empty
result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aforo.llm.common import checkpoint, kept, mix64, raw_hash, slices, small_batches, split_words

#: Words in a window, share of an item's windows that must be found, words of a template that must be
#: words, share of slots that may disagree, words that may shift within an item, words in a row that suffice.
WINDOW, FOUND, LITERAL, DISAGREE, SHIFT, VERBATIM = 8, 0.5, 4, 0.1, 8, 13
#: Bits of the filter for each window of the items, at least, and at most (16 MB).
KEY_BITS, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 27

#: Units of measure, singular or plural, and their signs.
UNITS = frozenset(
    "mm cm m km metre metres meter meters kilometre kilometres kilometer kilometers mile miles inch inches foot feet yard yards "
    "mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds lb lbs oz ml cl dl l litre litres liter liters gallon gallons "
    "pint pints quart quarts cup cups teaspoon teaspoons tablespoon tablespoons yd ft acre acres hectare hectares ha celsius fahrenheit h hr hrs min mins "
    "s sec second seconds minute minutes hour hours day days week weeks month months year years hz khz mhz ghz w kw mw watt watts volt volts "
    "j kj joule joules n newton newtons kpa bar degree degrees percent dollar dollars euro euros cent cents usd eur gbp kb mb gb tb km/h mph m/s".split()
)
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
)
#: Words that open a sentence with a capital and are no names.
OPENERS = frozenset(
    "the a an and or but if when while what which who whose where why how there this that these those it its he she they we you i "
    "in on at by for from to of with as is are was were be do does did can could should would will may not no each every all some "
    "after before since then so because given find let "
    "el la los las un una y o si cuando que qué cómo de en por para con se su es son "
    "le les une et ou quand quel quelle comment dans pour par avec il elle ce ces est sont "
    "der die das ein eine und oder wenn was welche wie wer wo im an auf für von mit er sie wir ist sind".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:e[+-]?\d+)?(?:%|st|nd|rd|th)?$")
_GLUED = re.compile(r"([+-]?\d[\d.,]*)([^\W\d_][^\W\d_/]*(?:/[^\W\d_]+)?)$")
_STRIP = "\"'`.,;:!?()[]{}<>*_~|#$%&…“”‘’«»¿¡"
_END = ".!?:\n"
NUM, UNIT, NAME = "<num>", "<unit>", "<name>"
_WORD, _NUM, _UNIT, _CAPITAL, _OPENER, _SHOUT = 0, 1, 2, 4, 8, 16
#: Under which name workers keep raw words; of how many (one slice more at most); bytes of text in a slice: larger ones repeat more words.
OPERATOR, CACHED, SLICE = "decontaminate", 300_000, 2 << 20


def _singular(unit: str) -> str:
    return {"feet": "foot", "inches": "inch"}.get(unit) or (unit[:-1] if unit[-1:] == "s" and unit[:-1] in UNITS else unit)


_KINDS = dict.fromkeys(OPENERS, _OPENER) | dict.fromkeys(UNITS, _UNIT) | {w: _UNIT | _OPENER for w in UNITS & OPENERS} | dict.fromkeys(NUMBER_WORDS, _NUM)


def _tokens(raw: str) -> tuple[list[tuple[str, int]], bool]:
    """Of a raw word: its tokens (in lower case without punctuation, and what each may be), whether a sentence ends."""
    bare = raw.strip(_STRIP)
    low, ends = bare.lower(), raw[-1] in _END
    if not low:
        return [], ends
    if not low.isalpha():
        glued = _GLUED.match(low)
        if glued and glued[2] in UNITS:
            return [(glued[1], _NUM), (glued[2], _UNIT)], ends
        if _NUMBER.match(low) or "-" in low and all(x in NUMBER_WORDS for x in low.split("-")):
            return [(low, _NUM)], ends
    kind = _KINDS.get(low, _WORD)
    if bare[0].isupper() and kind != _NUM and (len(bare) > 1 or not kind & _OPENER) and (low.isalpha() or all(x.isalpha() or x in "'’-." for x in low)):
        kind |= _CAPITAL | (_SHOUT if len(bare) > 1 and bare.isupper() else 0)
        ends = ends and (len(bare) > 1 or raw[-1] != ".")  # an initial
    return [(low, kind)], ends


def canonical(text: str) -> tuple[list[str], list[str], list[str]]:
    """The canonical words of a text, for each the value if it is a slot, else an empty string, and the words in lower case.

    White space is what it is for split_words. A unit is one only after a number; its value is the singular.
    """
    found = []
    for line in text.split("\n"):
        opens = True
        for raw in re.findall(r"[^\x20\x09-\x0d]+", line):
            tokens, ends = _tokens(raw)
            for low, kind in tokens:
                found.append((low, kind, opens))
                opens = False
            opens = ends or opens
    words, values, lows = [], [], []
    shouts = [False, *(bool(kind & _SHOUT) for _, kind, _ in found), False]
    for i, (low, kind, opens) in enumerate(found):
        name = kind & _CAPITAL and not (opens and kind & _OPENER) and not (shouts[i + 1] and (shouts[i] or shouts[i + 2]))
        slot = NUM if kind == _NUM else UNIT if kind & _UNIT and words and words[-1] == NUM else NAME if name else ""
        if slot == NAME and not opens and words and words[-1] == NAME:
            values[-1] = lows[-1] = f"{lows[-1]} {low}"
        else:
            words.append(slot or low)
            values.append(_singular(low) if slot == UNIT else low if slot else "")
            lows.append(low)
    return words, values, lows


class Known:
    """Raw words seen so far: a number for each, and by number the word, how many tokens it has, whether a sentence ends, and of two tokens kind and hash."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.words: list[str] = []
        self.many, self.ends = np.zeros(0, np.int8), np.zeros(0, bool)
        self.kind, self.hash = np.zeros(0, np.int8), np.zeros(0, np.uint64)

    def add(self, words: list[str]) -> None:
        rows = []
        for w in words:
            tokens, ends = ([], True) if w == "\x01" else _tokens(w)
            (low, kind), (low2, kind2) = (*tokens, ("", 0), ("", 0))[:2]
            rows.append((len(tokens), ends, kind, kind2, xxhash.xxh3_64_intdigest(low), xxhash.xxh3_64_intdigest(low2) if low2 else 0))
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.words += words
        many, ends, kind, kind2, first, second = zip(*rows)
        self.many, self.ends = np.append(self.many, np.array(many, np.int8)), np.append(self.ends, np.array(ends, bool))
        self.kind = np.append(self.kind, np.stack([np.array(kind, np.int8), np.array(kind2, np.int8)], 1).ravel())
        self.hash = np.append(self.hash, np.stack([np.array(first, np.uint64), np.array(second, np.uint64)], 1).ravel())

    def text(self, token: int) -> str:
        return _tokens(self.words[token >> 1])[0][token & 1][0]


class Canonical:
    """Canonical words of many texts at once, as arrays; what canonical() says of each."""

    def __init__(self, texts: pa.Array):
        marked = pc.replace_substring(pc.fill_null(texts, ""), "\n", " \x01 ")
        raw, offsets = split_words(marked, lower=False)
        coded = raw.dictionary_encode()
        words = coded.dictionary.to_pylist()
        own = kept(OPERATOR)
        if len(own.setdefault("known", Known()).number) > CACHED:
            own["known"] = Known()
        known = self.known = own["known"]
        number = np.array([known.number.get(w, -1) for w in words], np.int64)
        if (unknown := number < 0).any():
            number[unknown] = len(known.number) + np.arange(unknown.sum())
            known.add([words[i] for i in np.flatnonzero(unknown)])
        code = number.astype(np.int32)[coded.indices.to_numpy()]
        del marked, raw, coded, words, number
        many, ends = known.many[code], known.ends[code]
        before = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
        self.offsets = before[offsets]
        at = np.repeat(np.arange(len(code)), many)  # each token's word; its tokens are 2 * word and 2 * word + 1
        self.code = 2 * code[at] + (np.arange(len(at)) - before[at]).astype(np.int32)
        kind = known.kind[self.code]
        del many, before, code
        ended = np.concatenate([[0], np.cumsum(ends)])
        first = np.zeros(len(at), bool)
        first[self.offsets[:-1][np.diff(self.offsets) > 0]] = True
        previous = np.concatenate([at[:1], at[:-1]])
        opens = first | (ended[at] > ended[previous])
        del ends, ended, previous
        number = kind == _NUM
        unit = ((kind & _UNIT) > 0) & np.concatenate([number[:0], [False] * bool(len(at)), number[:-1]]).astype(bool) & ~first
        shout = (kind & _SHOUT) > 0
        last = np.zeros(len(at), bool)
        last[self.offsets[1:][np.diff(self.offsets) > 0] - 1] = True
        beside = np.zeros(len(at), bool)  # another word in capitals before or after it
        beside[1:] |= shout[:-1] & ~first[1:]
        beside[:-1] |= shout[1:] & ~last[:-1]
        name = ((kind & _CAPITAL) > 0) & ~unit & ~(opens & ((kind & _OPENER) > 0)) & ~(shout & beside)
        follows = name & ~opens & np.concatenate([name[:0], [False] * bool(len(at)), name[:-1]]).astype(bool)
        self.begin = np.flatnonzero(~follows)  # each canonical word's first token, and how many it has
        self.count = np.diff(np.append(self.begin, len(at)))
        self.offsets = np.concatenate([[0], np.cumsum(~follows)])[self.offsets]
        every = known.hash[self.code]
        self.raw = every[self.begin]
        longer, k = np.flatnonzero(self.count > 1), 1
        while len(longer):
            self.raw[longer] = mix64(self.raw[longer] * np.uint64(0x9E3779B97F4A7C15) + every[self.begin[longer] + k])
            k += 1
            longer = longer[self.count[longer] > k]
        number, unit, name = number[self.begin], unit[self.begin], name[self.begin]
        self.unit, self.slot = unit, number | unit | name
        self.hashes = self.raw.copy()
        for which, mark in ((number, NUM), (unit, UNIT), (name, NAME)):
            self.hashes[which] = xxhash.xxh3_64_intdigest(mark)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each window of ``width`` words: first word, hash (of the template, or of the words where they say more), text."""
        n = np.diff(self.offsets)
        owner = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(owner))
        start = at[at + width <= self.offsets[owner + 1]]
        if width < LITERAL:
            start = start[n[owner[start]] == width]
        slots = np.concatenate([[0], np.cumsum(self.slot)])
        exact = width - (slots[start + width] - slots[start]) < LITERAL
        h = np.zeros(len(start), np.uint64)
        for which, words, seed in ((~exact, self.hashes, 0), (exact, self.raw, 1)):
            own = start[which]
            x = np.full(len(own), seed, np.uint64)
            for j in range(width):
                x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + words[own + j] + np.uint64(j + 1))
            h[which] = x
        return start, h, owner[start]

    def low(self, i: int) -> str:
        return " ".join(self.known.text(c) for c in self.code[self.begin[i] : self.begin[i] + self.count[i]])

    def values(self, start: int, width: int) -> list[str]:
        return [_singular(self.low(i)) if self.unit[i] else self.low(i) for i in range(start, start + width) if self.slot[i]]


def _items(window: int):
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("width", pa.int32()), ("h", pa.int64()), ("at", pa.int32()), ("opening", pa.bool_()), ("values", pa.list_(pa.string()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", operator=OPERATOR):
            items, ids, made, rows = piece.column("item").to_pylist(), piece.column("item_id").to_pylist(), Canonical(piece.column("text")), []
            n = np.diff(made.offsets)
            for width in sorted({min(window, int(x)) for x in n if x}):
                start, h, owner = made.windows(width)
                own = np.minimum(n[owner], window) == width
                seen = set()
                for s, x, o in zip(start[own].tolist(), h[own].view(np.int64).tolist(), owner[own].tolist()):
                    rows.append((items[o], ids[o], width, x, s - int(made.offsets[o]), (o, x) not in seen, made.values(s, width)))
                    seen.add((o, x))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def _probe(widths: list[int], bits):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("h", pa.int64()), ("place", pa.int32()), ("first", pa.bool_()), ("found", pa.list_(pa.string()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for piece in slices(batches, "text", SLICE, OPERATOR):
            rows, ids, texts, made, out = *(piece.column(c).to_pylist() for c in ("row", "doc_id", "text_hash")), Canonical(piece.column("text")), []
            for width in widths:
                start, h, owner = made.windows(width)
                place = h & np.uint64(8 * len(table) - 1)
                hit = np.flatnonzero((table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1))
                seen = set()
                for s, x, o in zip(start[hit].tolist(), h[hit].view(np.int64).tolist(), owner[hit].tolist()):
                    out.append((rows[o], ids[o], texts[o], x, s - int(made.offsets[o]), (o, x) not in seen, made.values(s, width)))
                    seen.add((o, x))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def _bit_table(items: DataFrame) -> np.ndarray:
    """The filter of the items' window hashes: each task sends its bits, which are joined by OR."""
    bytes_ = min(MOST_BITS, max(LEAST_BITS, 1 << (KEY_BITS * items.count()).bit_length())) // 8

    def bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bytes_, np.uint8)
        for b in batches:
            place = b.column(0).to_numpy().view(np.uint64) & np.uint64(8 * bytes_ - 1)
            np.bitwise_or.at(table, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at].astype(np.int32))], names=["at", "bits"])

    got = items.select("h").mapInArrow(bits, "at int, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(bytes_, np.uint8)
    table[got.column("at").to_numpy()] = got.column("bits").to_numpy().astype(np.uint8)
    return table


#: The most numbers in a row among ``places``.
_IN_A_ROW = """
aggregate(array_sort(places), named_struct('last', -2, 'run', 0, 'most', 0), (a, x) -> named_struct(
  'last', x, 'run', IF(x = a.last + 1, a.run + 1, 1), 'most', greatest(a.most, IF(x = a.last + 1, a.run + 1, 1))), a -> a.most)
"""


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, found: float = FOUND) -> DataFrame:
    """(row, doc_id, text_hash, item_id, n_windows, n_found, n_slots) for each item found in a row of ``docs``.

    ``row`` tells rows of equal id apart; it numbers the rows as ``docs`` is read.
    """
    spark = small_batches(docs).sparkSession
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text"))
    items = checkpoint(items.mapInArrow(_items(window), "item long, item_id long, width int, h long, at int, opening boolean, values array<string>"))
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # at most ``window`` numbers
    bits = spark.sparkContext.broadcast(_bit_table(items))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), raw_hash(F.col(text_col)).alias("text_hash")).withColumn("row", F.monotonically_increasing_id())
    hits = rows.mapInArrow(_probe(widths, bits), "row long, doc_id long, text_hash long, h long, place int, first boolean, found array<string>")
    sizes = items.groupBy(F.col("item").alias("of_item")).agg(F.countDistinct("h").alias("n_windows"))
    shift = F.col("place") - F.col("at")
    # alternatives: first occurrences, equal shifts, and shifts in either of two rows of overlapping ranges
    near = [F.struct(F.lit(i).alias("kind"), x.cast("long").alias("shift")) for i, x in enumerate((F.lit(0), shift, F.floor(shift / (2 * SHIFT)), F.floor((shift + SHIFT) / (2 * SHIFT))))]
    ways = F.when(F.col("first") & F.col("opening"), F.array(*near)).otherwise(F.array(*near[1:]))
    same = (F.col("way.kind") == 1) & (F.col("values") == F.col("found"))
    pairs = hits.join(items, "h").withColumn("way", F.explode(ways)).groupBy("row", "doc_id", "text_hash", "item", "item_id", "way").agg(
        F.size(F.collect_set("h")).cast("long").alias("n_found"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("values", "found")))).alias("slots"),
        F.collect_set(F.when(same, F.col("at"))).alias("places"),
    )
    slots = F.size("slots")
    values = F.size(F.array_distinct(F.transform("slots", lambda s: s["values"])))
    agree = (slots - values) <= slots * DISAGREE
    verbatim = F.expr(_IN_A_ROW) + window - 1 >= max(VERBATIM, window + 1)
    pairs = pairs.join(sizes, F.col("item") == F.col("of_item"))
    good = pairs.filter((F.col("n_found") >= F.col("n_windows") * found) & agree | verbatim)
    best = good.groupBy("row", "doc_id", "text_hash", "item", "item_id").agg(F.max(F.struct("n_found", "n_windows", values.alias("n_slots"))).alias("b"))
    return best.select("row", "doc_id", "text_hash", "item_id", "b.n_windows", "b.n_found", "b.n_slots")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, items).drop("row", "text_hash")
