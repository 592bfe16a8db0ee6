"""SentencePiece encoding and decoding for models of the merge type.

Encoding is exact and does not run the merge queue over the text. An Aho-Corasick automaton finds the
pieces in a stretch of text; from the left the longest piece that starts at a position is taken and
kept (one of one or two characters, which are looked up, where no longer one does) if it is compatible with the piece before it, which is tried by merging the two again and seeing
whether the border stays. Else the next shorter piece that it starts with is tried; when none is left the position is
marked in a bitfield of failed positions and the walk goes back one piece. A sequence whose
neighbours are all compatible is the one that merging gives, as the first merge over a border would
also happen between the two neighbours alone.

No piece of such a vocabulary has the space mark after another character, so a text falls apart
before each space mark, and each worker keeps the ids of the stretches it has seen (a bounded cache in two halves: when
one is full the other, not asked for as long, goes).
If a vocabulary has such pieces, whole lines (or texts) are encoded instead.

Nulls: a null text counts as empty and gives only begin and end. Repeated rows are encoded like
others. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from struct import Struct, pack

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aforo.llm.common import kept, slices, small_batches

MARK = "▁"
#: Stretches a worker's cache holds at most, and the longest it keeps.
CACHED, CACHED_CHARS = 700_000, 64
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

#: A piece at a place: its length, its id and the same of the longest shorter piece that it starts with.
Match = tuple[int, int, "Match | None"]
_OUTSIDE: Match = (1, -1, None)
#: Little-endian bytes of so many ids.
_PACK = [Struct(f"<{n}I").pack for n in range(17)]


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """Fields of a protocol buffer message: number, wire type, value."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = data[i : i + n], i + n
        yield key >> 3, kind, value


class Codec:
    """Encodes and decodes with a SentencePiece model file given as bytes."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.dummy_prefix, self.strip_spaces, escape, byte_fallback, model_type, rules = True, True, True, False, 1, b""
        for number, _, value in _fields(model):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for f, _, v in _fields(value):
                    if f == 1:
                        piece = v.decode()
                    elif f == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif f == 3:
                        kind = v
                self.pieces.append(piece)
                self.kinds.append(kind)
                scores.append(score)
            elif number == 2:
                for f, _, v in _fields(value):
                    model_type, byte_fallback = (v if f == 3 else model_type), (bool(v) if f == 35 else byte_fallback)
            elif number == 3:
                for f, _, v in _fields(value):
                    rules = v if f == 2 else rules
                    self.dummy_prefix = bool(v) if f == 3 else self.dummy_prefix
                    self.strip_spaces = bool(v) if f == 4 else self.strip_spaces
                    escape = bool(v) if f == 5 else escape
        if model_type != 2 or rules or self.strip_spaces or not escape or USER in self.kinds or UNUSED in self.kinds:
            raise ValueError("only merge-type models without character rules, space stripping, user-defined or unused pieces")
        self.bos = next((i for i, p in enumerate(self.pieces) if p == "<s>"), -1)
        self.eos = next((i for i, p in enumerate(self.pieces) if p == "</s>"), -1)
        self.unk = self.kinds.index(UNKNOWN)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.score = {p: scores[i] for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        if byte_fallback and len(self.bytes) != 256:
            raise ValueError("byte fallback needs 256 byte pieces")
        self.whole = {p for p in self.ids if self._merge(p) == [p]}  # a piece that merging never makes is never used
        self.automaton = ahocorasick.Automaton()
        found: dict[str, Match] = {}
        for p in sorted(self.whole, key=len):
            shorter = next((found[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in found), None)
            found[p] = len(p), self.ids[p], shorter
        self.short = {p: m for p, m in found.items() if len(p) <= 2}
        for p in (found.keys() - self.short) or found:
            self.automaton.add_word(p, found[p])
        self.automaton.make_automaton()
        joined = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.split = re.compile(r"[^\n]+|\n" if joined else f"{MARK}*[^{MARK}\n]+|{MARK}+|\n") if not any("\n" in p and len(p) > 1 for p in self.ids) else None
        self.limit = CACHED
        self.compatible: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.differs: dict[str, str] = {}
        self.odd = {i for i, k in enumerate(self.kinds) if k != NORMAL}

    def _merge(self, text: str) -> list[str]:
        """Merging by score, leftmost first: what defines the encoding. For single pieces and pairs."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: int, right: int) -> bool:
        key = left << 24 | right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > self.limit:
                self.compatible.clear()
            two = [self.pieces[left], self.pieces[right]]
            known = self.compatible[key] = self._merge("".join(two)) == two
        return known

    def _walk(self, text: str) -> list[Match]:
        """The pieces of a normalised stretch; a character outside the vocabulary has id -1."""
        n, path, at, left, known, short = len(text), [], 0, -1, self.compatible, self.short.get
        found: list[Match | None] = [None] * n
        for end, match in self.automaton.iter(text):
            found[end - match[0] + 1] = match  # ends only grow: the last is the longest
        failed, match = bytearray(n + 1), n and (found[0] or short(text[:2]) or short(text[0]) or _OUTSIDE)
        while at < n:
            while match:
                size, right, shorter = match
                if not failed[at + size]:
                    if left < 0 or right < 0:
                        break
                    fits = known.get(left << 24 | right)
                    if self._fits(left, right) if fits is None else fits:
                        break
                match = shorter
            if match:
                path.append(match)
                at, left = at + size, right
                match = at < n and (found[at] or short(text[at : at + 2]) or short(text[at]) or _OUTSIDE)
            else:
                failed[at] = 1
                size, _, match = path.pop()
                at -= size
                left = path[-1][1] if path else -1
        return path

    def _ids_of(self, text: str) -> list[int]:
        path = self._walk(text)
        ids = [i for _, i, _ in path]
        if -1 not in ids:
            return ids
        out, at = [], 0
        for size, i, _ in path:
            if i >= 0:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in text[at : at + size].encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unk)
            at += size
        return out

    def normalise(self, text: str) -> str:
        return (MARK * self.dummy_prefix + text.replace(" ", MARK)) if text else ""

    def _stretch(self, s: str) -> bytes:
        """Little-endian ids of a stretch.

        They are decoded once; the few stretches that their ids don't give back (space marks kept) are not cached, and put in ``differs``
        with what they give instead.
        """
        known = self.cache.get(s) or self.older.get(s)
        if known is None:
            ids = self._ids_of(s)
            text, known = self._text(ids), _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else pack(f"<{len(ids)}I", *ids)
            if text != s:
                self.differs[s] = text
                return known
        if len(s) <= CACHED_CHARS:
            if len(self.cache) >= self.limit // 2:
                self.older, self.cache = self.cache, {}
            self.cache[s] = known
        return known

    def both_ways(self, text: str) -> tuple[bytes, str]:
        """Little-endian ids of a text and the text they decode to."""
        parts, look, one = self.stretches(text), self.cache.get, self._stretch
        ids = b"".join([look(s) or one(s) for s in parts])
        if self.differs:
            parts = [self.differs.get(s, s) for s in parts]
            self.differs.clear()
        return ids, self._finish("".join(parts))

    def stretches(self, text: str) -> list[str]:
        text = self.normalise(text)
        return self.split.findall(text) if self.split else [text] if text else []

    def encode(self, text: str, bos: bool = False, eos: bool = False) -> list[int]:
        body = np.frombuffer(self.both_ways(text)[0], "<u4").tolist()
        return [self.bos] * bos + body + [self.eos] * eos

    def _text(self, ids: list[int]) -> str:
        if self.odd.isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids])
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            if self.kinds[i] == UNKNOWN:
                out.append(" ⁇ ")
            elif self.kinds[i] != CONTROL:
                out.append(self.pieces[i])
        return "".join(out) + (_utf8(bytes(raw)) if raw else "")

    def _finish(self, text: str) -> str:
        return (text[1:] if self.dummy_prefix and text[:1] == MARK else text).replace(MARK, " ")

    def decode(self, ids: Iterable[int]) -> str:
        """The text of any sequence of ids; bytes that are no UTF-8 become U+FFFD."""
        return self._finish(self._text(list(ids)))


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + size].decode())
                    i += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


#: Under which name workers keep their codecs.
OPERATOR = "sentencepiece"


def _codec(model: bytes) -> Codec:
    codecs, key = kept(OPERATOR), hashlib.sha256(model).digest()
    if key not in codecs:
        codecs[key] = Codec(model)
    return codecs[key]


def read_model(path: str | None = None) -> bytes:
    """A model file's bytes; by default the public 32k merge-type vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ("ids", "decoded"), cached: int = CACHED) -> DataFrame:
    """One row per row: id, n_tokens, ids_sha256, decoded_sha256, and of ids and decoded what ``extra`` names.

    The model (its size is fixed by its vocabulary) is broadcast once. Rows go through in slices of
    bounded size and no shuffle.
    """
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    more = {"ids": pa.list_(pa.int32()), "decoded": pa.string()}
    schema = pa.schema(fields + [(x, more[x]) for x in extra])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        codec.limit = cached
        first, last = (np.array([i], "<u4").tobytes() for i in (codec.bos, codec.eos))
        for piece in slices(batches, "text", operator=OPERATOR):
            n, ids_sha, text_sha, all_ids, texts = [], [], [], [], []
            for text in piece.column("text").to_pylist():
                body, back = codec.both_ways(text or "")
                ids = first + body + last
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                if "ids" in extra:
                    all_ids.append(np.frombuffer(ids, "<i4"))
                if "decoded" in extra:
                    texts.append(back)
            cols = [piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            cols += [pa.array({"ids": all_ids, "decoded": texts}[x], more[x]) for x in extra]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    names = {"int64": "long", "string": "string", "list<item: int32>": "array<int>", "list<element: int32>": "array<int>"}
    ddl = ", ".join(f"{f.name} {names[str(f.type)]}" for f in schema)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_model(), extra=())
