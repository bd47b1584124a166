"""Op 2: exact encoding and decoding with a merge-type SentencePiece vocabulary.

Method: encoding by backtracking. An Aho-Corasick automaton over the vocabulary finds the longest piece that begins at
each position. Pieces are laid one after the other; a piece may follow another only if the two are compatible, that is if
merging their joined text anew by the vocabulary's ranks gives just these two. A sequence all of whose neighbours are
compatible is the one that merging the whole text gives, so when a piece doesn't fit, its next shorter prefix in the
vocabulary is tried, and a position from which no way leads on is remembered in a bitfield and not entered again.

Merging never crosses a place between two characters that stand side by side in no piece. Such places are before a space
mark and before those punctuation marks that no piece has after a letter (found from the vocabulary), so texts are cut
there, and the encodings of the cut words are kept in a bounded cache. Characters outside the vocabulary become byte pieces.

Null texts count as empty; an empty text has only the begin and end ids and decodes to an empty text. Repeated rows give
repeated results. A column of the input that has the name of an output column is replaced.
"""

from __future__ import annotations

import re
import string
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.llm.common import appended, sole

MARK = "▁"
LETTER = r"[^\W\d_]"
#: Words whose encoding a worker keeps; when as many are kept anew, the older ones go.
CACHE_WORDS = 60_000
CACHE_PAIRS = 250_000


def _varint(b: bytes, i: int) -> tuple[int, int]:
    r = k = 0
    while True:
        c = b[i]
        i += 1
        r |= (c & 127) << k
        k += 7
        if c < 128:
            return r, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 2:
            n, i = _varint(b, i)
            yield tag >> 3, b[i : i + n]
            i += n
        elif kind == 0:
            v, i = _varint(b, i)
            yield tag >> 3, v
        elif kind == 5:
            yield tag >> 3, struct.unpack("<f", b[i : i + 4])[0]
            i += 4
        else:
            yield tag >> 3, b[i : i + 8]
            i += 8


class _Kept(dict):
    """Results of make() by string. Once CACHE_WORDS are kept, they only serve what is asked for again."""

    def __init__(self, make):
        self.make, self.before = make, {}

    def __missing__(self, w: str) -> bytes:
        got = self.before.get(w)
        if got is None:
            got = self.make(w)
        if len(w) <= 64:
            if len(self) >= CACHE_WORDS:
                self.before = dict(self)
                self.clear()
            self[w] = got
        return got


class PieceCodec:
    """Encoder and decoder for one model file of type BPE with identity normalisation."""

    def __init__(self, model: bytes):
        pieces: list[tuple[str, float, int]] = []
        norm: dict[int, object] = {}
        trainer: dict[int, object] = {}
        for f, v in _fields(model):
            if f == 1:
                own = dict(_fields(v))
                pieces.append((own.get(1, b"").decode(), own.get(2, 0.0), own.get(3, 1)))
            elif f == 2:
                trainer = dict(_fields(v))
            elif f == 3:
                norm = dict(_fields(v))
        if trainer.get(3, 1) != 2 or norm.get(2) or norm.get(4, 1) or not norm.get(5, 1):
            raise ValueError("only BPE models with identity normalisation and kept white space are supported")
        self.prefix = MARK if norm.get(3, 1) else ""
        self.bos, self.eos, self.unk = trainer.get(41, 1), trainer.get(42, 2), trainer.get(40, 0)
        self.bytes_at = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        if any(kind == 4 or kind == 5 for _, _, kind in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.id_of = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 1}
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece holds the space mark after another character")
        self.text_of = [p for p, _, _ in pieces]
        self.score = {p: s for p, s, kind in pieces if kind == 1}
        self.len_of = [len(p) for p in self.text_of]
        self.auto = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.auto.add_word(p, (i, len(p)))
        self.auto.make_automaton()
        self.shorter = [0] * len(pieces)
        for p, i in self.id_of.items():
            self.shorter[i] = next((self.id_of[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.id_of), -1)
        # what a piece decodes to: its text, one byte, or nothing
        self.out_of = [b"" if kind == 3 else bytes([int(p[3:5], 16)]) if kind == 6 else " ⁇ ".encode() if kind == 2 else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        self.is_byte = np.array([kind == 6 for _, _, kind in pieces])
        self.pairs: dict[int, bool] = {}
        self.words = _Kept(self.word)
        self.parts = _Kept(self.part)
        self.cut = re.compile(self._cuts()).split

    def _cuts(self) -> str:
        """A pattern that matches, without characters, at places that no piece spans."""
        beside = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        own = sorted(set(string.punctuation + "\n") - {y for x, y in beside if re.match(LETTER, x)})
        places = [f"(?<=[^{MARK}])(?={MARK})", f"(?<={LETTER})(?=[{''.join(map(re.escape, own))}])"]
        if not any("\n" in p for p in self.id_of):
            places += ["(?<=\n)", "(?=\n)"]
        return "|".join(places)

    # -- encoding

    def merge(self, s: str) -> list[str]:
        """Plain merging of the best-ranked neighbours, leftmost first."""
        sym, score = list(s), self.score
        while len(sym) > 1:
            best, at = None, -1
            for i in range(len(sym) - 1):
                x = score.get(sym[i] + sym[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if at < 0:
                break
            sym[at : at + 2] = [sym[at] + sym[at + 1]]
        return sym

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        got = self.pairs.get(key)
        if got is None:
            left, right = self.text_of[a], self.text_of[b]
            got = self.merge(left + right) == [left, right]
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[key] = got
        return got

    def _run(self, s: str, longest: list[int], begin: int, end: int) -> list[int]:
        """Pieces of s[begin:end], all of whose characters are in the vocabulary, by backtracking."""
        out: list[int] = []
        pairs, shorter, len_of, compatible = self.pairs, self.shorter, self.len_of, self.compatible
        failed = 0  # bit i: nothing leads on from begin + i
        pos, tok = begin, longest[begin]
        while True:
            to = pos + len_of[tok]
            if to <= end and not failed >> (to - begin) & 1:
                ok = True
                if out:
                    ok = pairs.get(out[-1] << 20 | tok)
                    if ok is None:
                        ok = compatible(out[-1], tok)
                if ok:
                    out.append(tok)
                    if to == end:
                        return out
                    pos, tok = to, longest[to]
                    continue
            tok = shorter[tok]
            while tok < 0:
                failed |= 1 << (pos - begin)
                back = out.pop()
                pos -= len_of[back]
                tok = shorter[back]

    def part(self, s: str) -> bytes:
        """Ids of what stands between two spaces, with the mark before it. Cuts are beside punctuation and line ends only."""
        return self.word(MARK + s) if s.isalpha() else b"".join([self.words[w] for w in self.cut(MARK + s)])

    def word(self, s: str) -> bytes:
        """Ids of a piece of text that merging doesn't leave, as little-endian 32-bit integers."""
        whole = self.id_of.get(s)
        if whole is not None:  # the longest piece from its beginning
            return whole.to_bytes(4, "little")
        n = len(s)
        longest = [-1] * n
        for last, (i, size) in self.auto.iter(s):
            longest[last - size + 1] = i
        ids: list[int] = []
        pos = 0
        while pos < n:
            if longest[pos] < 0:
                ids += [self.bytes_at[x] for x in s[pos].encode()] if self.bytes_at else [self.unk]
                pos += 1
                continue
            end = pos
            while end < n and longest[end] >= 0:
                end += 1
            ids += (self._run if end - pos <= 8192 else self._long)(s, longest, pos, end)
            pos = end
        return struct.pack(f"<{len(ids)}I", *ids)

    def _long(self, s: str, longest: list[int], begin: int, end: int) -> list[int]:
        """As _run, for runs so long that one integer for the bitfield would be copied too often."""
        out: list[int] = []
        failed = bytearray(end - begin + 1)
        pos, tok = begin, longest[begin]
        while True:
            to = pos + self.len_of[tok]
            if to <= end and not failed[to - begin] and (not out or self.compatible(out[-1], tok)):
                out.append(tok)
                if to == end:
                    return out
                pos, tok = to, longest[to]
                continue
            tok = self.shorter[tok]
            while tok < 0:
                failed[pos - begin] = 1
                back = out.pop()
                pos -= self.len_of[back]
                tok = self.shorter[back]

    def encode(self, text: str, begin_end: bool = True) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        parts = [struct.pack("<I", self.bos)] if begin_end else []
        if text:
            if self.prefix and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
                kept = self.parts
                parts += [kept[w] for w in text.split(" ")]
            else:
                kept = self.words
                parts += [kept[w] for w in self.cut(self.prefix + text.replace(" ", MARK))]
        if begin_end:
            parts.append(struct.pack("<I", self.eos))
        return b"".join(parts)

    # -- decoding

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces joined, byte pieces read as UTF-8 (each byte that isn't part of a character becomes
        U+FFFD), control ids left out, and the space that encoding puts before the text taken off."""
        a = np.frombuffer(ids, "<u4")
        out_of = self.out_of
        raw = b"".join([out_of[i] for i in a.tolist()])
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = "".join(self._bytes(a))
        return text[1:] if self.prefix and text.startswith(" ") else text

    def _bytes(self, a: np.ndarray) -> Iterator[str]:
        run = b""
        for i in a.tolist():
            if self.is_byte[i]:
                run += self.out_of[i]
                continue
            if run:
                yield self._utf8(run)
                run = b""
            yield self.out_of[i].decode()
        if run:
            yield self._utf8(run)

    @staticmethod
    def _utf8(run: bytes) -> str:
        out, i = [], 0
        while i < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                i += 1
        return "".join(out)


_codecs: dict[int, PieceCodec] = {}


def codec_of(model: bytes) -> PieceCodec:
    """The codec of a model, one for each worker process."""
    key = hash(model)
    if key not in sole(_codecs):
        _codecs[key] = PieceCodec(model)
    return _codecs[key]


def encode_documents(docs: DataFrame, model: bytes, text_col: str = "text", begin_end: bool = True) -> DataFrame:
    """docs with n_tokens long and ids binary (little-endian unsigned 32-bit integers)."""

    def work(col):
        codec = codec_of(model)
        ids = [codec.encode(x or "", begin_end) for x in col.to_pylist()]
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]

    return appended(docs, [("n_tokens", T.LongType()), ("ids", T.BinaryType())], text_col, work)


def decode_documents(encoded: DataFrame, model: bytes, ids_col: str = "ids") -> DataFrame:
    """encoded with decoded string, the text of each row's ids; null ids count as none."""

    def work(col):
        codec = codec_of(model)
        return [pa.array([codec.decode(x or b"") for x in col.to_pylist()], pa.string())]

    return appended(encoded, [("decoded", T.StringType())], ids_col, work)


def round_trip(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """docs with n_tokens and ids (see encode_documents), and round_trip: whether the ids decode to the text. One worker does
    both with one codec; as two steps, each task takes two workers."""

    def work(col):
        codec, own = codec_of(model), [x or "" for x in col.to_pylist()]
        ids = [codec.encode(x) for x in own]
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([codec.decode(i) == x for i, x in zip(ids, own, strict=True)], pa.bool_())]

    return appended(docs, [("n_tokens", T.LongType()), ("ids", T.BinaryType()), ("round_trip", T.BooleanType())], text_col, work)


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
