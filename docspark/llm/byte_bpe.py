"""Byte-level BPE on a sentencepiece model serialised from a rank vocabulary.

The model file is written straight from the ranks: byte strings become pieces of
printable characters (one for each byte), scored by negative rank, so that the
best-scored merge is the lowest rank; normalisation is the identity. Texts are
cut into pre-tokens by the tokenizer's pattern, each is encoded by itself, and
decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docspark.llm.common import fresh, slices

#: Pre-tokens remembered by a Python worker.
CACHE = 150_000
UNKNOWN = "⁇"


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte string -> rank, of a file of `base64 rank` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown piece comes last."""
    chars = byte_characters()
    out = bytearray()
    for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
        text = "".join(chars[b] for b in piece).encode()
        out += _block(1, _block(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)))
    out += _block(1, _block(1, UNKNOWN.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(ranks) + 1) + _number(40, len(ranks))
    for field in (41, 42, 43):  # no special pieces: -1
        trainer += _varint(field << 3) + _varint((1 << 64) - 1)
    normalizer = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return bytes(out + _block(2, trainer) + _block(3, normalizer))


class Codec:
    """Encodes and decodes whole texts by one rank vocabulary."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("ranks must be 0 .. n - 1")
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        chars = byte_characters()
        self.map = {i: c for i, c in enumerate(chars)}
        back = {c: bytes([b]) for b, c in enumerate(chars)}
        self.bytes = [b"".join(back[c] for c in self.model.id_to_piece(i)) for i in range(len(ranks))]
        self.cache: dict[str, tuple[int, ...]] = {}

    def _learn(self, pieces: list[str]) -> None:
        if len(self.cache) + len(pieces) > CACHE:
            self.cache.clear()
        raw = [p.encode() for p in pieces]
        rest = []
        for p, b in zip(pieces, raw, strict=True):
            if (rank := self.ranks.get(b)) is not None:
                self.cache[p] = (rank,)
            else:
                rest.append((p, b.decode("latin-1").translate(self.map)))
        if rest:
            for (p, _), ids in zip(rest, self.model.encode([m for _, m in rest], num_threads=1), strict=True):
                self.cache[p] = tuple(ids)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; a null text counts as empty."""
        cut = [self.find(t) if t else [] for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.cache)
        if len(new) + len(self.cache) > CACHE:
            new = set(chain.from_iterable(cut))
            self.cache.clear()
        self._learn(list(new))
        get = self.cache.__getitem__
        return [list(chain.from_iterable(map(get, c))) for c in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for a Python worker."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, round_trip: bool = False) -> DataFrame:
    """docs (its columns in `keep`, default all) with ids; with round_trip also decoded, the bytes that the ids stand for.

    path is the vocabulary on each executor. A null or empty text has no ids and
    decodes to no bytes; a text of any length is encoded whole, rows that repeat
    are each encoded, and an empty table gives an empty one. The new columns get
    other names if docs has such columns. No shuffle; batches are cut by bytes of
    text.
    """
    keep = docs.columns if keep is None else keep
    ids, decoded = fresh(docs, "ids", "decoded")
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(ids, T.ArrayType(T.IntegerType(), False))])
    if round_trip:
        schema = schema.add(decoded, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for whole in batches:
            for batch in slices(whole, text):
                found = c.encode(batch.column(text).to_pylist())
                more = [pa.array(found, pa.list_(pa.field("element", pa.int32(), False)))]
                if round_trip:
                    more.append(pa.array(list(map(c.decode, found)), pa.binary()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *more], schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """tokens with decoded, the bytes that its ids stand for; null ids decode to none."""
    (decoded,) = fresh(tokens, "decoded")
    schema = T.StructType([*tokens.schema.fields, T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            back = [c.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], schema.names)

    return tokens.mapInArrow(run, schema)
