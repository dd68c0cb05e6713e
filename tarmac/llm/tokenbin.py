"""Token ids as raw binary shards with a minimal perfect hash index for keyed access.

Format.  A shard file holds little-endian ids (16 bits where the vocabulary has at most 65,536 ids, else 32) of its
documents, one after another, each followed by the end id; documents ascend by id over and within shards.  The index is
a table of buckets.  A key's hash names its bucket, and a bucket's blob is a minimal perfect hash over its keys:
levels of bit arrays, where a key stands at the first level at which no other key wants its bit; its rank among all
set bits is its slot.  A slot holds a 32-bit fingerprint of the key, the shard, and offset and length in ids, so a
look-up reads a few bits and one slot however many keys there are; a foreign key is told by its fingerprint (one in
four billion passes).

Writing is one range shuffle by id: every task encodes its range and writes one file to the shared folder under a name
of its own attempt, and Spark's commit of the manifest, not of the files, decides which attempts count, so lost
executors and repeated tasks do no harm.  Payloads never pass the driver; the manifest has one row for each shard.

Null text is encoded as empty and leaves its end id.  Ids are whole numbers (text that is no number fails in the cast).
Rows that repeat an id are stored in order of their row keys; the index leads to the first of them, and how many follow.
Rows without an id come first and have no key.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tarmac.llm.bpe import byte_characters
from tarmac.llm.frames import emit_rows, quoted, row_key, shared_dir, stored
from tarmac.llm.words import mix, slices

#: Entries of each generation of a worker's cache, bytes of the longest cut that it keeps or splits into pieces, and pieces in one string for the model.
_CACHE, _LONG, _TOGETHER = 200_000, 100, 64
#: In a long cut a pre-token also ends between a letter or digit that every Unicode version knows and such a sign.
_DEEP = re.compile(r"(?<=[A-Za-z0-9\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])(?=[\n,.;:!?()\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f\u300c\u300d])")
#: Pre-tokens of byte-level BPE in cuts of letters below U+0250; the separators \x1c-\x1f are no white space to it.
_PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\t-\r \x85\xa0\p{L}\p{N}]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+")
#: Bytes that UTF-8 never has; the model's signs for two of them stand between pieces and between pre-tokens of a piece.
_NEVER = (0xC0, 0xC1, *range(0xF5, 0x100))
_APART = 0xFF
#: A pre-token of letters below U+0100 or of digits.
_WORD = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+)")
#: Kinds of bytes, as bits: ASCII white space, ASCII letters and digits, other printed ASCII characters, bytes that begin
#: a character which is no white space, and those of which the next bytes tell.
_WHITE, _ALNUM, _SIGN, _DARK, _UNSURE = 1, 2, 4, 8, 16
_KIND = np.zeros(256, np.uint8)
_KIND[[*b"\t\n\v\f\r "]] = _WHITE
_KIND[0x21:0x7F] = [(_ALNUM if chr(b).isalnum() else _SIGN) | _DARK for b in range(0x21, 0x7F)]
_KIND[0xC3:] = _DARK
_KIND[[0xC2, 0xE1, 0xE2, 0xE3]] = _UNSURE
_WHITE_2 = np.array([0xC285, 0xC2A0])
_WHITE_3 = np.array([int.from_bytes(chr(c).encode(), "big") for c in (0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000)])
#: Bytes of text that are encoded at once: pieces are looked up once in a slice.
_SLICE = 2 << 20
_SHARD_BYTES = 32 << 20
_GAMMA = 1.5


def _pieces(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces of texts start, in their UTF-8 bytes one after another; ``bounds`` are the texts' starts and the end.

    No pre-token crosses such a place, and the text on either side splits by itself as it does in the whole: each text's
    start; a space before a character that is no white space; ASCII white space after a printed ASCII character or a
    letter of U+00C0 to U+00FF; a newline's end between two characters that are no white space; and, in cuts of at most
    100 bytes, a printed ASCII sign after such a letter or an ASCII letter or digit.
    """
    kind = _KIND[data]
    white, dark, space = (kind & _WHITE) > 0, (kind & _DARK) > 0, data == 0x20
    letter, after = (kind & _ALNUM) > 0, (kind & (_ALNUM | _SIGN)) > 0
    latin = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    letter[1:] |= latin
    after[1:] |= latin
    first = np.zeros(len(data), bool)
    first[1:] = white[1:] & after[:-1]
    first[:-1] |= space[:-1] & dark[1:]
    first[2:] |= after[:-2] & (data[1:-1] == 0x0A) & dark[2:]
    at = np.flatnonzero(space[:-1] & ((kind[1:] & _UNSURE) > 0))
    if len(at):
        one, two, three = (np.append(data, np.zeros(3, np.uint8))[at + k].astype(np.int64) for k in (1, 2, 3))
        first[at[~np.isin(one << 8 | two, _WHITE_2) & ~np.isin(one << 16 | two << 8 | three, _WHITE_3)]] = True
    filled = bounds[1:] > bounds[:-1]
    last = bounds[1:][filled] - 1  # what follows a text's last byte is another text
    first[last] = white[last] & (last > 0) & after[last - 1]
    first[bounds[:-1][filled]] = True
    starts = np.flatnonzero(first)
    sign = np.flatnonzero(letter[:-1] & ((kind[1:] & _SIGN) > 0) & ~first[1:]) + 1
    cut = np.searchsorted(starts, sign, "right") - 1
    first[sign[np.diff(starts, append=len(data))[cut] <= _LONG]] = True
    return np.flatnonzero(first)


def _listed(strings: pa.LargeStringArray) -> list[bytes]:
    """A whole array's strings as bytes."""
    ends = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1)
    data = np.frombuffer(strings.buffers()[2], np.uint8, ends[-1])
    return np.insert(data, ends[1:-1], _APART).tobytes().split(bytes([_APART]))


class Encoder:
    """Encodes by a tokenizers file of byte-level BPE.

    Texts are cut into pieces where pre-tokens surely end.  The different pieces of a slice are looked up, and the ids of
    those of at most 100 bytes are kept in two generations of a bounded cache, which changes no result.  New pieces of
    letters below U+0250 (where all Unicode versions agree) are split into pre-tokens here and go straight to the file's
    BPE model, many in one string; between them stand signs that no merge has, so none reaches over them.  All other
    pieces go through the whole tokenizer, and so do whole texts that hold an added token's string, which the tokenizer
    takes out first, and all pieces where the model is not a plain one.
    """

    def __init__(self, definition: str, special_tokens_as_text: bool) -> None:
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = special_tokens_as_text
        parts = json.loads(definition)
        before, model = parts["pre_tokenizer"] or {}, parts["model"]
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or parts["normalizer"]:
            raise ValueError("a byte-level BPE file without prefix space and normaliser is needed")
        self.added = [t["content"] for t in parts["added_tokens"] if not (special_tokens_as_text and t["special"])]
        characters = byte_characters()
        self.table = np.array(list(map(ord, characters)), "<u2")
        self.size = self.tokenizer.get_vocab_size()
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        merged = {c for m in model["merges"] for c in "".join(m)}
        free = [b for b in _NEVER if characters[b] in model["vocab"] and characters[b] not in merged]
        self.signs = free[:2] if plain and len(free) > 1 else None
        if self.signs:
            self.between, self.within = (bytes([b]) for b in self.signs)
            self.sign_ids = [model["vocab"][characters[b]] for b in self.signs]
            self.merger = Tokenizer(self.tokenizer.model)
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _split(self, piece: bytes) -> bytes | None:
        """A piece with signs between its pre-tokens; None if it has to go through the whole tokenizer."""
        if not self.signs:
            return None
        if _WORD.fullmatch(piece):
            return piece
        text = piece.decode()
        return self.within.join(map(str.encode, _PRE_TOKEN.findall(text))) if max(text) < "\u0250" else None

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces; none is empty."""
        split = list(map(self._split, pieces))
        plain = [p for p in split if p is not None]
        joined = [self.between.join([*plain[i : i + _TOGETHER], b""]) for i in range(0, len(plain), _TOGETHER)]
        joined = [self.table[np.frombuffer(x, np.uint8)].tobytes().decode("utf-16-le") for x in joined]
        done = []
        if joined:
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.merger.encode_batch_fast(joined, add_special_tokens=False)])
            sign = np.isin(ids, self.sign_ids)
            ends = (4 * np.cumsum(~sign)[ids == self.sign_ids[0]]).tolist()
            done = list(map(ids[~sign].tobytes().__getitem__, map(slice, [0, *ends[:-1]], ends)))
        if len(done) == len(pieces):
            return done
        left = iter(done)
        return [self._whole(p.decode()) if own is None else next(left) for p, own in zip(pieces, split, strict=True)]

    def _deep(self, cut: str) -> bytes:
        """The ids of a long cut; each different pre-token is encoded once."""
        parts = filter(None, _DEEP.split(cut))
        parts = [m.encode() for x in parts for m in (_PRE_TOKEN.findall(x) if max(x) < "\u0250" and self.signs else [x])]
        different = list(set(parts))
        return b"".join(map(dict(zip(different, self._ids(different), strict=True)).__getitem__, parts))

    def _known(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of different pieces, from the cache where it has them."""
        if len(self.new) > _CACHE:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        missing = list(filterfalse(new.__contains__, pieces))
        again = list(filter(old.__contains__, missing))
        new.update(zip(again, map(old.__getitem__, again), strict=True))
        missing = list(filterfalse(old.__contains__, missing))
        fresh = [p for p in missing if len(p) <= _LONG]
        new.update(zip(fresh, self._ids(fresh), strict=True))
        if len(fresh) == len(missing):
            return list(map(new.__getitem__, pieces))
        long = {p: self._deep(p.decode()) for p in missing if len(p) > _LONG}
        return [long[p] if p in long else new[p] for p in pieces]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        texts.validate(full=True)  # bytes that are no UTF-8 fail here
        whole = np.zeros(len(texts), bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if whole.any():
            apart = {i: np.frombuffer(self._whole(texts[i].as_py()), np.uint32) for i in np.flatnonzero(whole).tolist()}
            ids, lengths = self.encode_column(pc.if_else(pa.array(whole), "", texts))
            parts = [apart.get(i, part) for i, part in enumerate(np.split(ids, np.cumsum(lengths)[:-1]))]
            return np.concatenate(parts), np.array(list(map(len, parts)))
        bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
        if bounds[0] == bounds[-1]:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8, bounds[-1] - bounds[0], bounds[0])
        bounds = bounds - bounds[0]
        starts = _pieces(data, bounds)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)).dictionary_encode()
        known = self._known(_listed(pieces.dictionary))
        sizes = np.array(list(map(len, known))) // 4
        table, base, at = np.frombuffer(b"".join(known), np.uint32), np.cumsum(sizes) - sizes, pieces.indices.to_numpy()
        size = sizes[at]
        upto = np.append(0, np.cumsum(size))
        ids = table[np.repeat(base[at] - upto[:-1], size) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.searchsorted(starts, bounds)])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, lengths = self.encode_column(pa.array(texts, pa.large_string()))
        return np.split(ids, np.cumsum(lengths)[:-1]) if len(lengths) else []


@lru_cache(2)
def encoder(definition: str, special_tokens_as_text: bool) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
    return Encoder(definition, special_tokens_as_text)


class PerfectHash:
    """A minimal perfect hash of different 64-bit keys: bit arrays by level, with the rank before each byte."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        ones = [np.bitwise_count(level) for level in levels]
        before = np.concatenate([[0], np.cumsum([n.sum() for n in ones])]) if ones else np.zeros(1, np.int64)
        self.ranks = [b + np.concatenate([[0], np.cumsum(n[:-1], dtype=np.int64)]) for b, n in zip(before, ones, strict=False)]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return mix(keys + np.uint64((level + 1) * 0xD1B54A32D192ED03 & 2**64 - 1)) % np.uint64(size * 8)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = int(len(keys) * _GAMMA) // 8 + 1
            at = cls._place(keys, len(levels), size)
            wanted = np.bincount(at.astype(np.int64), minlength=size * 8)
            levels.append(np.packbits(wanted == 1, bitorder="little"))
            keys = keys[wanted[at] > 1]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 where no level has the key."""
        out, todo = np.full(len(keys), -1), np.arange(len(keys))
        for number, (level, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self._place(keys[todo], number, len(level))
            byte, bit = (at >> np.uint64(3)).astype(np.int64), (at & np.uint64(7)).astype(np.uint8)
            hit = (level[byte] >> bit & 1) > 0
            byte, bit = byte[hit], bit[hit]
            lower = level[byte] & ((np.uint8(1) << bit) - np.uint8(1)).astype(np.uint8)
            out[todo[hit]] = rank[byte] + np.bitwise_count(lower)
            todo = todo[~hit]
        return out

    def to_bytes(self) -> bytes:
        return np.array([len(self.levels), *map(len, self.levels)], "<i8").tobytes() + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, body: bytes) -> PerfectHash:
        n = int(np.frombuffer(body, "<i8", 1)[0])
        sizes = np.frombuffer(body, "<i8", n, 8)
        ends = 8 + 8 * n + np.cumsum(sizes)
        return cls([np.frombuffer(body, np.uint8, size, end - size) for size, end in zip(sizes.tolist(), ends.tolist(), strict=True)])


def _key_hash(keys: np.ndarray) -> np.ndarray:
    return mix(keys.view(np.uint64) ^ np.uint64(0xA0761D6478BD642F))


_SLOT = np.dtype([("print", "<u4"), ("shard", "<i4"), ("offset", "<i8"), ("length", "<i8"), ("rows", "<i4")])


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", path: str | None = None, special_tokens_as_text: bool = False, buckets: int | None = None) -> str:
    """Writes shards, manifest and index of ``docs`` under ``path`` (in the shared folder by default) and returns it.

    ``tokenizer`` is the path of a tokenizers file on the driver.  A special token's string in a text becomes its id, as
    the library has it, unless ``special_tokens_as_text``.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    with open(tokenizer, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())
    width = 2 if max(encoder(definition.value, special_tokens_as_text).size - 1, end_id) < 1 << 16 else 4
    size = docs.agg(F.sum(F.octet_length(quoted(text))).alias("bytes"), F.count("*").alias("rows")).first()
    shards = max(1, -(-(size.bytes or 0) // _SHARD_BYTES), -(-size.rows // 1_000_000))
    rows = docs.select(quoted(doc_id).cast("long").alias("id"), row_key(doc_id, text).alias("row"), quoted(text).alias("_text"))
    ranged = rows.repartitionByRange(shards, F.col("id").asc_nulls_first(), "row").sortWithinPartitions(F.col("id").asc_nulls_first(), "row")
    system, folder = _open(path)
    system.create_dir(f"{folder}/shards", recursive=True)

    def encode(batches):
        task = TaskContext.get()
        shard, name = task.partitionId(), f"shards/{task.partitionId():06d}-{uuid.uuid4().hex}.ids"
        own = encoder(definition.value, special_tokens_as_text)
        ids, lengths, start = [], [], 0
        system, folder = _open(path)
        with system.open_output_stream(f"{folder}/{name}.part") as out:
            for batch in batches:
                for part in slices(batch, "_text", _SLICE):
                    coded, length = own.encode_column(part.column("_text"))
                    out.write(np.insert(coded, np.cumsum(length), end_id).astype(f"<u{width}").tobytes())
                    ids.append(part.column("id"))
                    lengths += (length + 1).tolist()
        if not lengths:
            system.delete_file(f"{folder}/{name}.part")
            return
        system.move(f"{folder}/{name}.part", f"{folder}/{name}")
        lengths = np.array(lengths)
        yield {
            "shard": pa.array(np.full(len(lengths), shard, np.int32)), "file": pa.array([name] * len(lengths)), "id": pa.concat_arrays(ids),
            "offset": pa.array(np.cumsum(lengths) - lengths), "length": pa.array(lengths),
        }

    fields = {"shard": T.IntegerType(), "file": T.StringType(), "id": T.LongType(), "offset": T.LongType(), "length": T.LongType()}
    emit_rows(ranged, encode, fields).write.parquet(f"{path}/places")
    places = spark.read.parquet(f"{path}/places")
    totals = places.groupBy("shard").agg(F.first("file").alias("file"), F.sum("length").alias("ids"), F.count("*").alias("docs"))
    totals = totals.withColumn("group", F.shiftright("shard", 10))
    before = lambda by, order: F.coalesce(F.sum("ids").over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = totals.groupBy("group").agg(F.sum("ids").alias("ids"))  # a thousandth of the shards, which are a millionth of the bytes
    groups = groups.select("group", before(Window.partitionBy(F.lit(0)), "group").alias("base"))
    totals = totals.join(groups, "group").withColumn("start", F.col("base") + before(Window.partitionBy("group"), "shard")).drop("group", "base")
    totals.withColumn("width", F.lit(width)).coalesce(1).write.parquet(f"{path}/manifest")
    parts = buckets or max(1, -(-size.rows // 200_000))
    firsts = places.where("id is not null").groupBy("id").agg(F.min(F.struct("shard", "offset", "length")).alias("p"), F.count("*").cast("int").alias("rows"))
    keyed = firsts.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("bucket"), "id", "p.*", "rows")

    def index(batches):
        held, current = [], None

        def blob():
            table = pa.Table.from_batches(held)
            ids, *values = (table.column(c).to_numpy() for c in ("id", "shard", "offset", "length", "rows"))
            hashed = _key_hash(ids)
            perfect = PerfectHash.of(hashed)
            slots = np.zeros(len(ids), _SLOT)
            at = perfect.slots(hashed)
            values = dict(zip(_SLOT.names, (hashed >> np.uint64(32), *values), strict=True))
            for name, value in values.items():
                slots[name][at] = value
            return {"bucket": pa.array([current], pa.int32()), "hash": pa.array([perfect.to_bytes()], pa.binary()), "slots": pa.array([slots.tobytes()], pa.binary())}

        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            for piece in np.split(np.arange(len(bucket)), np.flatnonzero(np.diff(bucket)) + 1):
                if len(piece):
                    if current is not None and bucket[piece[0]] != current:
                        yield blob()
                        held.clear()
                    current = int(bucket[piece[0]])
                    held.append(batch.slice(piece[0], len(piece)))
        if held:
            yield blob()

    dealt = keyed.repartition("bucket").sortWithinPartitions("bucket")
    emit_rows(dealt, index, {"bucket": T.IntegerType(), "hash": T.BinaryType(), "slots": T.BinaryType()}).write.parquet(f"{path}/index")
    return path


def find(path: str, keys: DataFrame, key: str = "id") -> DataFrame:
    """``(id, shard, offset, length, rows)`` of the keys that the index has, found through its perfect hash.

    Keys are made different first, so a bucket gets about as many as it holds.
    """
    spark = keys.sparkSession
    index = spark.read.parquet(f"{path}/index")
    parts = (index.agg(F.max("bucket")).first()[0] or 0) + 1
    wanted = keys.select(quoted(key).cast("long").alias("id")).where("id is not null").distinct()
    wanted = wanted.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    wanted = wanted.groupBy("bucket").agg(F.collect_list("id").alias("ids"))  # different ids: as even as their hashes

    def probe(batches):
        for batch in batches:
            for ids, body, slots in zip(batch.column("ids"), batch.column("hash"), batch.column("slots"), strict=True):
                ids = ids.values.to_numpy()
                table = np.frombuffer(slots.as_buffer(), _SLOT)
                hashed = _key_hash(ids)
                at = PerfectHash.from_bytes(body.as_buffer()).slots(hashed)
                known = at >= 0
                known[known] = table["print"][at[known]] == (hashed[known] >> np.uint64(32))
                hit = table[at[known]]
                yield {"id": pa.array(ids[known]), **{c: pa.array(hit[c].copy()) for c in ("shard", "offset", "length", "rows")}}

    fields = {"id": T.LongType(), "shard": T.IntegerType(), "offset": T.LongType(), "length": T.LongType(), "rows": T.IntegerType()}
    return emit_rows(wanted.join(index, "bucket").select("ids", "hash", "slots"), probe, fields)


def read(path: str, places: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``places`` (with ``shard``, ``offset``, ``length``) with ``ids``, little-endian unsigned 32-bit, read from the shards, and ``start``."""
    spark = places.sparkSession
    manifest = spark.read.parquet(f"{path}/manifest").select("shard", "file", "start", "width")
    keep = [c for c in (places.columns if keep is None else keep) if c.lower() not in ("ids", "start", "file", "width")]
    wanted = places.select(*map(quoted, keep), *(c for c in ("shard", "offset", "length") if c not in keep)).join(manifest, "shard")
    own = {f"_k{i}": c for i, c in enumerate(keep)}
    wanted = wanted.select(*[quoted(c).alias(k) for k, c in own.items()], F.col("offset").alias("_offset"), F.col("length").alias("_length"), "file", "width", (F.col("start") + F.col("offset")).alias("start"))
    wanted = wanted.repartition("file").sortWithinPartitions("file", "_offset")

    def load(batches):
        opened, file = None, None
        system, folder = _open(path)
        for batch in batches:
            ids = []
            for name, width, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "width", "_offset", "_length")), strict=True):
                if name != opened:
                    if file:
                        file.close()
                    opened, file = name, system.open_input_file(f"{folder}/{name}")
                file.seek(offset * width)
                ids.append(np.frombuffer(file.read(length * width), f"<u{width}").astype("<u4").tobytes())
            yield {**{c: batch.column(c) for c in (*own, "start")}, "ids": pa.array(ids, pa.binary())}

    out = emit_rows(wanted, load, {**{k: wanted.schema[k].dataType for k in own}, "start": T.LongType(), "ids": T.BinaryType()})
    return out.select(*[F.col(k).alias(c) for k, c in own.items()], "start", "ids")


def records(path: str, docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Every stored document, from the files: ``id``, ``start``, ``ids``; ids are found through the index, rows that repeat one or have none through the places."""
    spark = docs.sparkSession
    found = stored(find(path, docs, doc_id))
    single = found.where("rows = 1").select("id", "shard", "offset", "length")
    places = spark.read.parquet(f"{path}/places").select("id", "shard", "offset", "length")
    repeated = places.join(found.where("rows > 1").select("id"), "id", "left_semi")
    return read(path, single.unionByName(repeated).unionByName(places.where("id is null")))

