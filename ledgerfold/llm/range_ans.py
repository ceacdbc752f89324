"""Token ids in files of entropy-coded blocks: a static range asymmetric numeral system.

`write_tokens` tokenizes documents in ascending doc_id order and writes a folder:

- `table`: how often each id occurs among all documents, scaled to a sum of 2**18 and never below
  1. It is shared by all blocks, and every block names its checksum.
- `blocks`: a row for each block of at most 16,384 ids. A block holds whole documents, or one
  part of a longer document, with the places of these among the ids of all documents. Its
  payload decodes with the table alone, so any task may decode any block.

Within a block 32 coders work in turn: id number i belongs to coder i modulo 32. Their states are
64 bits wide and give off or take in 32 bits at a time, all into one list of words, in the order
in which a decoder asks for them. Every 256 turns a checkpoint keeps the states and the place in
that list: decoding can start there, and the parts between checkpoints of many blocks are decoded
side by side. A checksum of a block's ids is compared after decoding.

Null texts count as empty: the end id alone. Very long texts are spread over many blocks. Rows of
one doc_id keep their number of places, ordered by a hash of the text, and equal rows are kept as
often as they come; a null doc_id comes first. An empty table gives an empty folder and no rows.
Only `doc_id` and `text` are read, so that other columns of any name clash with nothing.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm.common import documents, scratch
from ledgerfold.llm.packing import VOCABULARY, words

END_ID = 2
#: Frequencies sum to 2**BITS.
BITS = 18
#: Bits of an id, of a frequency and of a place among the slots of an id, packed into one word.
FIELD = 20
#: Coders of a block, ids of a block, and turns between two checkpoints.
LANES, BLOCK, CHECKPOINT = 32, 16_384, 256
#: Blocks coded side by side in a task.
GROUP = 64

MAGIC = b"rANS"
#: Magic, bits, coders, ids, turns between checkpoints, checkpoints, checksums of table and ids.
HEADER = struct.Struct("<4sBBIIIII")
LOW = np.uint64(1 << 31)

TOKENS = "part int, doc_id long, start long, n_tokens long, ids binary"
#: The `start` of a part's last row, whose `ids` are pairs of an id and how often the part has it.
COUNTS = -1
BLOCKS = (
    "start long, n_tokens int, whole boolean, doc_ids array<bigint>, doc_starts array<bigint>,"
    " doc_tokens array<bigint>, payload binary"
)
PIECES = "doc_id long, start long, n_tokens long, at long, ids binary"


class Table:
    """A shared table of frequencies, and what coding looks up in it."""

    def __init__(self, frequencies: np.ndarray, bits: int = BITS):
        self.frequencies = np.ascontiguousarray(frequencies, "<u4")
        if bits >= FIELD or len(self.frequencies) > 1 << FIELD:
            raise ValueError(f"ids and frequencies are held in {FIELD} bits")
        self.bits = bits
        self.checksum = zlib.crc32(self.frequencies.tobytes())
        self.filler = int(self.frequencies.argmax()) if len(self.frequencies) else 0
        self.wide = self.frequencies.astype(np.uint64)
        self.first = np.cumsum(self.wide, dtype=np.uint64) - self.wide
        self._slots: np.ndarray | None = None

    def slots(self) -> np.ndarray:
        """For each slot of the range: its id, its place among the id's slots, their number."""
        if self._slots is None:
            ids = np.repeat(np.arange(len(self.frequencies), dtype=np.uint64), self.frequencies)
            places = np.arange(len(ids), dtype=np.uint64) - self.first[ids]
            self._slots = ids | places << np.uint64(FIELD) | self.wide[ids] << np.uint64(2 * FIELD)
        return self._slots


@lru_cache(maxsize=2)
def _table(frequencies: bytes, bits: int) -> Table:
    """One per Python worker and table."""
    return Table(np.frombuffer(frequencies, "<u4"), bits)


def scaled(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 where the count is; all 0 without counts."""
    counts = np.asarray(counts, np.int64)
    there, total = counts > 0, int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.uint32)
    if there.sum() > 1 << bits:
        raise ValueError(f"more than 2**{bits} different ids")
    exact = counts / total * (1 << bits)
    out = np.where(there, np.maximum(1, np.floor(exact)), 0).astype(np.int64)
    rest = (1 << bits) - int(out.sum())
    if rest > 0:  # to those that lost most by rounding down
        gain = np.argsort(-(exact - out), kind="stable")[:rest]
        out[gain] += 1
        out[out.argmax()] += (1 << bits) - int(out.sum())
    for k in np.argsort(-out, kind="stable"):  # what the least frequent have too much
        if rest >= 0:
            break
        less = min(-rest, int(out[k]) - 1, max(1, int(out[k]) // 16))
        out[k] -= less
        rest += less
    while rest < 0:
        k = int(out.argmax())
        less = min(-rest, int(out[k]) - 1)
        out[k] -= less
        rest += less
    return out.astype(np.uint32)


def encode_blocks(blocks: list[np.ndarray], table: Table) -> list[bytes]:
    """The payloads of blocks of ids. An id without a frequency is an error."""
    turns = [-(-len(ids) // LANES) for ids in blocks]
    order = sorted(range(len(blocks)), key=lambda b: -turns[b])
    most = turns[order[0]]
    shape = (most, len(blocks), LANES)
    ids = np.full(shape, table.filler, np.int32)
    for row, b in enumerate(order):
        own = np.full(turns[b] * LANES, table.filler, np.int32)
        own[: len(blocks[b])] = blocks[b]
        ids[: turns[b], row] = own.reshape(-1, LANES)
    if ids.max() >= len(table.wide) or not table.wide[ids].all():
        raise ValueError("an id has no frequency in the table")
    free = np.uint64(63 - table.bits)
    words_, given = np.zeros(shape, np.uint32), np.zeros(shape, bool)
    x = np.full(shape[1:], LOW, np.uint64)
    active = [sum(turns[b] > t for b in order) for t in range(most)]
    bits, half = np.uint64(table.bits), np.uint64(32)
    checkpoints: dict[int, np.ndarray] = {}
    for t in range(most - 1, -1, -1):
        k = active[t]
        own, by = x[:k], table.wide[ids[t, :k]]
        large = own >> free >= by
        words_[t, :k] = own.astype(np.uint32)  # the lower half
        given[t, :k] = large
        own = np.where(large, own >> half, own)
        q = own // by
        x[:k] = (q << bits) + (own - q * by) + table.first[ids[t, :k]]
        if t % CHECKPOINT == 0:
            checkpoints[t] = x.copy()
    out: list[bytes] = [b""] * len(blocks)
    for row, b in enumerate(order):
        mask = given[: turns[b], row]
        passed = np.concatenate([[0], np.cumsum(mask.sum(axis=1))])
        starts = range(0, turns[b], CHECKPOINT)
        data = np.ascontiguousarray(blocks[b], "<u4")
        out[b] = b"".join(
            [
                HEADER.pack(
                    MAGIC, table.bits, LANES, len(data), CHECKPOINT, len(starts), table.checksum,
                    zlib.crc32(data.tobytes()),
                ),
                np.array([passed[t] for t in starts], "<u4").tobytes(),
                np.array([checkpoints[t][row] for t in starts], "<u8").tobytes(),
                words_[: turns[b], row][mask].astype("<u4").tobytes(),
            ]
        )
    return out


class _Block:
    """A payload taken apart."""

    def __init__(self, payload: bytes, table: Table):
        magic, bits, lanes, self.size, every, n, used, self.checksum = HEADER.unpack_from(payload)
        if magic != MAGIC or bits != table.bits or lanes != LANES:
            raise ValueError("not a block of this format")
        if used != table.checksum:
            raise ValueError("the block was written with another table")
        at = HEADER.size
        self.passed = np.frombuffer(payload, "<u4", n, at).astype(np.int64)
        states = np.frombuffer(payload, "<u8", n * LANES, at + 4 * n).reshape(n, LANES)
        self.states = states
        self.words = np.frombuffer(payload, "<u4", offset=at + 4 * n + 8 * n * LANES)
        turns = -(-self.size // LANES)
        self.turns = [min(every, turns - t) for t in range(0, turns, every)]
        self.span = every * LANES


def _decode_parts(parts: list[tuple[_Block, int]], table: Table) -> list[np.ndarray]:
    """The ids between one checkpoint and the next, for many checkpoints side by side."""
    slots = table.slots()
    turns = [block.turns[k] for block, k in parts]
    order = sorted(range(len(parts)), key=lambda i: -turns[i])
    lists: dict[int, int] = {}
    buffers, size = [], 0
    for block, _ in parts:
        if id(block) not in lists:
            lists[id(block)] = size
            buffers.append(block.words)
            size += len(block.words)
    stream = np.concatenate([*buffers, np.zeros(1, np.uint32)]).astype(np.uint64)
    x = np.array([parts[i][0].states[parts[i][1]] for i in order], np.uint64)
    at = np.array([lists[id(parts[i][0])] + parts[i][0].passed[parts[i][1]] for i in order])
    most = turns[order[0]]
    active = np.searchsorted(-np.array([turns[i] for i in order]), -np.arange(most), "left")
    out = np.empty((most, len(parts), LANES), np.int32)
    bits, half, mask = np.uint64(table.bits), np.uint64(32), np.uint64((1 << table.bits) - 1)
    field, fields = np.uint64(FIELD), np.uint64(2 * FIELD)
    lowest = np.uint64((1 << FIELD) - 1)
    for t in range(most):
        k = active[t]
        found_ = slots[(x[:k] & mask).view(np.int64)]
        out[t, :k] = found_ & lowest
        own = (found_ >> fields) * (x[:k] >> bits) + ((found_ >> field) & lowest)
        small = own < LOW
        taken = small.cumsum(axis=1)
        ahead = np.minimum(at[:k, None] + taken - small, len(stream) - 1)
        x[:k] = np.where(small, (own << half) | stream[ahead], own)
        at[:k] += taken[:, -1]
    found: list[np.ndarray] = [out[:0, 0]] * len(parts)
    for row, i in enumerate(order):
        found[i] = out[: turns[i], row].reshape(-1)
    return found


def decode_blocks(payloads: list[bytes], table: Table) -> list[np.ndarray]:
    """The ids of whole blocks, each compared with its checksum."""
    blocks = [_Block(p, table) for p in payloads]
    parts = [(block, k) for block in blocks for k in range(len(block.turns))]
    found = iter(_decode_parts(parts, table)) if parts else iter(())
    out = []
    for block in blocks:
        ids = np.concatenate([next(found) for _ in block.turns])[: block.size].astype("<u4")
        if zlib.crc32(ids.tobytes()) != block.checksum:
            raise ValueError("the ids of a block do not match its checksum")
        out.append(ids)
    return out


def decode_range(payload: bytes, table: Table, first: int, last: int) -> np.ndarray:
    """Ids `first` to `last` (exclusive) of a block, from the checkpoints around them alone."""
    block = _Block(payload, table)
    first, last = max(0, first), min(last, block.size)
    if first >= last:
        return np.empty(0, "<u4")
    start, end = first // block.span, -(-last // block.span)
    ids = np.concatenate(_decode_parts([(block, k) for k in range(start, end)], table))
    return ids[first - start * block.span : last - start * block.span].astype("<u4")


def tokenized(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Documents in ascending order over numbered parts, with ids and places within their part.

    `ids` are little-endian 32-bit integers, the end id last. A last row of each part holds its
    counts (see `COUNTS`), so that no further pass has to read the ids for them. Equal keys are told apart by the
    text's hash and by the place of reading, so that no key is too large for a part.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    end = np.array([end_id], "<u4").tobytes()
    names = [name.split()[0] for name in TOKENS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, part, total = 0, None, np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                part = rows.column(0).slice(0, 1)
                ids = [own + end for own in words(path).texts(rows.column(2))]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                places = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                n = np.bincount(np.frombuffer(b"".join(ids), "<u4"), minlength=len(total))
                n[: len(total)] += total
                total = n
                columns = [rows.column(0), rows.column(1), pa.array(places), pa.array(sizes)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(ids, pa.binary())], names=names
                )
        if part is not None:
            there = np.flatnonzero(total)
            pairs = np.stack([there, total[there]], axis=1).astype("<i8").tobytes()
            own = [pa.nulls(1, pa.int64()), pa.array([COUNTS], pa.int64()), pa.array([0], pa.int64())]
            yield pa.RecordBatch.from_arrays([part, *own, pa.array([pairs], pa.binary())], names=names)

    keys = ["doc_id", "_hash", "_at"]
    return (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("text").cast("string").alias("_text"),
            F.xxhash64("text").alias("_hash"),
            F.monotonically_increasing_id().alias("_at"),
        )
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select(F.spark_partition_id().alias("part"), "doc_id", "_text")
        .mapInArrow(run, TOKENS)
    )


def counted(tokens: DataFrame) -> DataFrame:
    """How often each id occurs, from the parts' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                pairs = np.frombuffer(data, "<i8").reshape(-1, 2)
                n = np.zeros(max(len(total), int(pairs[-1, 0]) + 1), np.int64)
                n[: len(total)] = total
                n[pairs[:, 0]] += pairs[:, 1]
                total = n
        there = np.flatnonzero(total)
        columns = [pa.array(there, pa.int32()), pa.array(total[there])]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "n"])

    rows = tokens.where(F.col("start") == COUNTS).select("ids").mapInArrow(run, "id int, n long")
    return rows.groupBy("id").agg(F.sum("n").alias("n"))


def blocked(
    tokens: DataFrame, bases: dict[int, int], frequencies: bytes, bits: int = BITS
) -> DataFrame:
    """The blocks of tokenized documents. `bases` are the ids before each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(frequencies, bits)
        ready: list[tuple] = []  # start, ids, whole, doc_ids, doc_starts, doc_tokens
        open_: list[tuple] = []  # doc_id, start, ids of the documents of the next block

        def close() -> None:
            if open_:
                ids = np.concatenate([x[2] for x in open_])
                starts, sizes = [x[1] for x in open_], [len(x[2]) for x in open_]
                ready.append((starts[0], ids, True, [x[0] for x in open_], starts, sizes))
                open_.clear()

        def coded() -> pa.RecordBatch:
            payloads = encode_blocks([x[1] for x in ready], table)
            rows = [
                (start, len(ids), *more, payload)
                for (start, ids, *more), payload in zip(ready, payloads, strict=True)
            ]
            ready.clear()
            longs = pa.list_(pa.int64())
            kinds = [pa.int64(), pa.int32(), pa.bool_(), longs, longs, longs, pa.binary()]
            names = [name.split()[0] for name in BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=names,
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = (c.to_pylist() for c in batch.slice(at, 512).columns)
                for part, doc_id, start, size, data in zip(*rows, strict=True):
                    start += bases[part]
                    ids = np.frombuffer(data, "<u4")
                    behind = open_ and open_[-1][1] + len(open_[-1][2]) != start
                    if behind or sum(len(x[2]) for x in open_) + size > BLOCK:
                        close()
                    if size <= BLOCK:
                        open_.append((doc_id, start, ids))
                    else:
                        for k in range(0, size, BLOCK):
                            own = ids[k : k + BLOCK]
                            ready.append((start + k, own, False, [doc_id], [start], [size]))
                    while len(ready) >= GROUP:
                        more = ready[GROUP:]
                        del ready[GROUP:]
                        yield coded()
                        ready.extend(more)
        close()
        if ready:
            yield coded()

    return tokens.where(F.col("start") != COUNTS).mapInArrow(run, BLOCKS)


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID
) -> None:
    """Write the documents' ids to a new folder."""
    spark = docs.sparkSession
    store = scratch(spark, "tokens")
    tokenized(docs, vocabulary, end_id).write.option("compression", "zstd").parquet(store)
    tokens = spark.read.schema(TOKENS).parquet(store)
    # A row for each id of the vocabulary, and one for each part: bounded, whatever the rows.
    counts = counted(tokens).toPandas()
    parts = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").toPandas()
    before = np.cumsum(parts["n"].to_numpy(np.int64)) - parts["n"].to_numpy(np.int64)
    totals = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 0, np.int64)
    totals[counts["id"]] = counts["n"]
    frequencies = scaled(totals)
    there = [(int(i), int(frequencies[i])) for i in np.flatnonzero(frequencies)]
    spark.createDataFrame(there, "id int, frequency int").coalesce(1).write.parquet(f"{path}/table")
    bases = dict(zip(parts["part"].tolist(), before.tolist(), strict=True))
    coded = blocked(tokens, bases, frequencies.astype("<u4").tobytes())
    coded.write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_table(spark: SparkSession, path: str) -> bytes:
    """The shared table of a folder, a frequency for each id up to the largest."""
    rows = spark.read.schema("id int, frequency int").parquet(f"{path}/table").collect()
    out = np.zeros(max((r.id for r in rows), default=-1) + 1, "<u4")
    for r in rows:
        out[r.id] = r.frequency
    return out.tobytes()


def _pieces(blocks: DataFrame, frequencies: bytes, bits: int) -> DataFrame:
    """The documents in blocks, or the parts of longer ones."""
    names = [name.split()[0] for name in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(frequencies, bits)
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                rows = batch.slice(at, GROUP).to_pylist()
                found = []
                for row, ids in zip(
                    rows, decode_blocks([r["payload"] for r in rows], table), strict=True
                ):
                    first, last = row["start"], row["start"] + len(ids)
                    places = (row["doc_ids"], row["doc_starts"], row["doc_tokens"])
                    for doc_id, start, size in zip(*places, strict=True):
                        own = ids[max(start, first) - first : min(start + size, last) - first]
                        found.append((doc_id, start, size, max(first - start, 0), own.tobytes()))
                kinds = [pa.int64()] * 4 + [pa.binary()]
                columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
                )

    return blocks.mapInArrow(run, PIECES)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of all documents in a folder.

    Only the parts of documents longer than a block are brought together.
    """
    frequencies = read_table(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    columns = ["doc_id", "start", "n_tokens", "ids"]

    def joined(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("at")
        ids = b"".join(parts.column("ids").to_pylist())
        return parts.slice(0, 1).select(columns[:3]).append_column("ids", pa.array([ids], pa.binary()))

    # Documents are known by their place; a doc_id may repeat.
    longer = _pieces(blocks.where("not whole"), frequencies, BITS).groupBy("start").applyInArrow(
        joined, "doc_id long, start long, n_tokens long, ids binary"
    )
    return _pieces(blocks.where("whole"), frequencies, BITS).select(*columns).unionByName(longer)


def op11_range_ans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and checksums of each document's ids, as read from the files."""
    path = scratch(spark, "range-ans")
    write_tokens(documents(spark, sf_dir), path)
    return read_tokens(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
