"""Byte-level BPE encoding and decoding over Arrow batches.

The merges come from a rank file: any two neighbouring tokens whose joined bytes have a rank
may merge, the lowest rank first. Every split of a token into two ranked parts is therefore
given to the tokenizers library's BPE model as a merge of that token's rank, which makes its
result that of a rank-based encoder. Bytes are written as characters by the usual byte table,
and each match of the splitting pattern is encoded alone.

Texts are cut before single spaces that stand between other characters. No match of the
pattern crosses such a place, so pieces encode alone as they do in the text, and pieces and
matches seen before come from caches of bounded size.

Null texts count as empty and have no tokens. Rows and other columns stay as they are.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerfold.llm.common import documents

RANKS = "byte_bpe_50k.tiktoken"
#: Pieces, and matches within pieces, kept by a Python worker, in about 150 MB.
PIECES, MATCHES = 300_000, 600_000
#: Rows worked on at once within an Arrow batch.
BATCH = 256

_BESIDE = re.compile(r"\s | \s").search


def byte_characters() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, more = dict.fromkeys(plain), 256
    for b in range(256):
        if b in table:
            table[b] = chr(b)
        else:
            table[b] = chr(more)
            more += 1
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id: the byte table reversed for every token."""
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


@lru_cache(maxsize=2)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids' bytes in a row, and each id's first place and number of them."""
    tokens = token_bytes(path)
    sizes = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes


class Memory(dict):
    """Results by key, computed where missing, the recent ones kept: when it is full, what it
    holds becomes the former half, and is taken over from there as it is asked for again."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most, self.former = compute, most // 2, {}

    def __missing__(self, key: str) -> bytes:
        found = self.former.get(key)
        if found is None:
            found = self.compute(key)
        if len(self) >= self.most:
            self.former = dict(self)
            self.clear()
        self[key] = found
        return found


class Codec:
    """Encodes texts to ids, with the characters that each id stands for."""

    def __init__(self, path: str):
        from tokenizers import models

        ranks = read_ranks(path)
        shown = byte_characters()
        name = {t: "".join(shown[b] for b in t) for t in ranks}
        merges = [
            (name[t[:k]], name[t[k:]])
            for t in sorted(ranks, key=ranks.get)
            for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks
        ]
        self.model = models.BPE(
            vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True
        )
        self.shown = dict(enumerate(shown))
        self.bytes_of = token_bytes(path)
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.matched = Memory(self.match, MATCHES)
        self.spaced = Memory(self._after_space, PIECES)  # by the piece without its space

    def match(self, text: str) -> bytes:
        """The ids of one match of the pattern, as little-endian 32-bit integers."""
        characters = text.encode().decode("latin-1").translate(self.shown)
        return array("i", [token.id for token in self.model.tokenize(characters)]).tobytes()

    def piece(self, text: str) -> bytes:
        """The ids of a piece that encodes alone."""
        return b"".join(map(self.matched.__getitem__, self.split(text)))

    def _after_space(self, piece: str) -> bytes:
        return self.piece(" " + piece)

    def text(self, text: str | None) -> bytes:
        """The ids of a text, as little-endian 32-bit integers."""
        if not text:
            return b""
        parts = text.split(" ")
        if text[0] == " " or text[-1] == " " or _BESIDE(text):
            # Some space has white space beside it: only the other spaces are safe cuts.
            pieces = [parts[0]]
            for before, part in zip(parts, parts[1:], strict=False):
                if before and part and not before[-1].isspace() and not part[0].isspace():
                    pieces.append(" " + part)
                else:
                    pieces[-1] += " " + part
            return b"".join(map(self.piece, pieces))
        first, *more = parts
        return b"".join([self.piece(first), *map(self.spaced.__getitem__, more)])

    def spans(self, text: str | None, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) character of each id: its bytes, mapped to characters."""
        data = np.frombuffer((text or "").encode(), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids], dtype=int)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return character[starts].astype(np.int32), (character[ends - 1] + 1).astype(np.int32)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One per Python worker and vocabulary."""
    return Codec(path)


def _added(df: DataFrame, new: list[T.StructField], rows) -> DataFrame:
    """Columns computed from Arrow batches; all columns of `df` stay, those of a new name go."""
    names = {f.name for f in new}
    kept = df.drop(*[name for name in df.columns if name in names])
    fields = [*kept.schema.fields, *new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                columns = rows(part)
                kept_columns = [part.column(f.name) for f in fields[: -len(new)]]
                yield pa.RecordBatch.from_arrays(
                    [*kept_columns, *columns], names=[f.name for f in fields]
                )

    return df.mapInArrow(run, T.StructType(fields))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def encode(
    docs: DataFrame, text: str = "text", path: str | None = None, offsets: bool = False
) -> DataFrame:
    """Add `ids` array<int>, and with `offsets` also `starts`, `ends` array<int> (characters).

    A token that holds part of a character's bytes has that whole character as its span.
    Null and empty texts get empty arrays. Columns already so named are replaced.
    """
    path = path or public_tokenizers.path(RANKS)
    array = T.ArrayType(T.IntegerType())
    names = ["ids", "starts", "ends"] if offsets else ["ids"]

    def rows(part: pa.RecordBatch) -> list[pa.Array]:
        texts = part.column(text).to_pylist()
        own = codec(path)
        ids = [np.frombuffer(own.text(x), np.int32) for x in texts]
        if not offsets:
            return [_lists(ids)]
        spans = [own.spans(x, i) for x, i in zip(texts, ids, strict=True)]
        return [_lists(ids), _lists([a for a, _ in spans]), _lists([b for _, b in spans])]

    return _added(docs, [T.StructField(name, array) for name in names], rows)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """Add `decoded` binary, the bytes of all ids in order, and drop the ids.

    Bytes of one character may come from several ids; they are joined before anything reads
    them as characters. Null ids decode to no bytes. An unknown id fails the job.
    """
    path = path or public_tokenizers.path(RANKS)

    def rows(part: pa.RecordBatch) -> list[pa.Array]:
        data, first, sizes = byte_table(path)
        column = part.column(ids)
        values = column.flatten().to_numpy(zero_copy_only=False)  # of the lists of this slice
        n = sizes[values]
        ends = np.cumsum(n)
        # each byte's place: its id's first place, and how far it is from where the id begins
        at = np.repeat(first[values] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        until = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])]
        offsets = pa.py_buffer(until.astype(np.int32))
        decoded = pa.py_buffer(np.ascontiguousarray(data[at]))
        return [pa.Array.from_buffers(pa.binary(), part.num_rows, [None, offsets, decoded])]

    return _added(df, [T.StructField("decoded", T.BinaryType())], rows)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the bytes they decode to."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    coded = encode(docs).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        "ids",
    )
    return decode(coded).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )
