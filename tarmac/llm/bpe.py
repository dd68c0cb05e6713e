"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank vocabulary.

Every vocabulary entry becomes a piece whose bytes are mapped to printable characters, scored by its negative rank;
normalisation is the identity.  sentencepiece then merges the best-ranked adjacent pair first, as rank files mean it.
Texts are split by the vocabulary's pattern and each match is encoded by itself; decoding maps ids back to bytes.

A space before a character that is no white space always starts a match of the pattern, so texts are cut there, and
the ids of cuts of at most 100 characters are kept in a cache of bounded size in each worker, which changes no result.
Longer cuts (text without spaces) are encoded some thousand matches at a time and not kept.

Null text is encoded as empty: no ids, nothing decoded.  The vocabulary file is read by the driver (its path is a
parameter) and travels to the executors as the serialised model, about one megabyte.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarmac.llm.frames import add_columns

#: White space as the pattern's own engine has it: Unicode's White_Space, without the separators \x1c-\x1f.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(r" (?=\S)")
#: Entries of a worker's cache, characters of the longest cut that it keeps, and matches that go to the model at once.
_CACHE, _LONG, _AT_ONCE = 200_000, 100, 20_000


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where printable in Latin-1, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte sequences of a rank file (base64, blank, rank), by rank; ranks must run from 0 without gaps."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, filter(bytes.strip, lines))}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol buffer field: bytes by length, floats in four bytes, integers as varints."""

    def varint(n: int) -> bytes:
        n &= 2**64 - 1
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def serialise(pieces: list[bytes]) -> bytes:
    """A sentencepiece BPE model: piece i has id i and score -i; an unknown piece, never produced, comes last."""
    to = byte_characters()
    body = [_field(1, _field(1, "".join(to[b] for b in piece).encode()) + _field(2, float(-i)) + _field(3, 1)) for i, piece in enumerate(pieces)]
    body.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(body) + _field(2, trainer) + _field(3, identity)


class Codec:
    """Encodes texts to little-endian unsigned 32-bit ids, and decodes them."""

    def __init__(self, model: bytes, pattern: str) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.characters = {b: c for b, c in enumerate(byte_characters())}
        back = {ord(c): b for b, c in self.characters.items()}
        n = self.processor.get_piece_size() - 1
        self.pieces = [bytes(back[ord(c)] for c in self.processor.id_to_piece(i)) for i in range(n)]
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{_WHITE}").replace(r"\S", f"[^{_WHITE}]").replace(r"\s", f"[{_WHITE}]"))
        self.table = "".join(self.characters[b] for b in range(256))
        self.cache: dict[str, bytes] = {}

    def _mapped(self, match: str) -> str:
        return match.encode().decode("latin-1").translate(self.table)

    def _new(self, cuts: list[str]) -> list[bytes]:
        """The ids of each of some short cuts; all matches go to the model in one call."""
        matches = [self.pattern.findall(cut) for cut in cuts]
        ids = iter(self.processor.encode([self._mapped(m) for own in matches for m in own], num_threads=1))
        return [array("I", [i for _ in own for i in next(ids)]).tobytes() for own in matches]

    def _long(self, cut: str) -> bytes:
        """The ids of a long cut, some matches at a time."""
        ids, held = array("I"), []
        for match in self.pattern.finditer(cut):
            held.append(self._mapped(match[0]))
            if len(held) == _AT_ONCE:
                ids.extend(i for own in self.processor.encode(held, num_threads=1) for i in own)
                held.clear()
        ids.extend(i for own in self.processor.encode(held, num_threads=1) for i in own)
        return ids.tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = []
        for text in texts:
            cuts = _CUT.split(text or "")
            cuts[1:] = [" " + c for c in cuts[1:]]
            split.append(cuts)
        wanted = {c for cuts in split for c in cuts}
        long = {c: self._long(c) for c in wanted if len(c) > _LONG}
        wanted -= long.keys()
        new = list(wanted - self.cache.keys())
        if len(self.cache) + len(new) > _CACHE:
            self.cache.clear()
            new = list(wanted)
        self.cache.update(zip(new, self._new(new), strict=True))
        get = self.cache.__getitem__
        return [b"".join([long[c] if c in long else get(c) for c in cuts] if long else map(get, cuts)) for cuts in split]

    def decode(self, ids: bytes) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(2)
def codec(model: bytes, pattern: str) -> Codec:
    return Codec(model, pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: list[str] | None = None, decode: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and, on demand, ``decoded`` (the bytes of those ids)."""
    model = docs.sparkSession.sparkContext.broadcast(serialise(read_ranks(vocabulary)))

    def run(part: pa.RecordBatch) -> dict[str, pa.Array]:
        own = codec(model.value, pattern)
        ids = own.encode(part.column("_text").to_pylist())
        out = {"n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
        return out | ({"decoded": pa.array(map(own.decode, ids), pa.binary())} if decode else {})

    fields = {"n_tokens": T.LongType(), "ids": T.BinaryType()} | ({"decoded": T.BinaryType()} if decode else {})
    return add_columns(docs, run, fields, text, keep)
