"""Best-fit packing of tokenized documents into sequences of bounded length.

Documents are tokenized, closed by an end id and cut into pieces no longer than a sequence.
Packing then needs the histogram of piece lengths only, which has as many bins as a sequence
has places, however many pieces there are:

1. patterns of up to three lengths that fill a sequence exactly are enumerated;
2. non-negative least squares fits how often each pattern should be used;
3. the counts are rounded, and lowered where the histogram has too few pieces left;
4. the residual pieces go, longest first, to the open sequences that they fit best.

The plan is a list of runs: pieces `first..` of one length go to sequences `sequence..` at one
place. Its size depends on the sequence length alone. Every piece gets its number within its
length from bounded buckets, and looks its sequence up in the plan.

Null texts count as empty: one piece that is the end id alone. Repeated rows are packed as
often as they come. An empty table gives no rows.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerfold.llm.byte_bpe import Memory, byte_characters
from ledgerfold.llm.common import documents, stored, with_offsets

VOCABULARY = "word_bpe_49k.json"
LENGTH = 2048
END_ID = 0
#: Words and matches within words kept by a Python worker, in about 100 MB.
WORDS = 600_000
#: Longer words and matches are not kept.
LONGEST = 1_000
#: Bytes of the texts that are split at once, about.
TEXTS = 4 << 20
#: Pieces of one length are numbered in buckets of about so many.
BUCKET = 20_000
#: Exact patterns tried for each longest length.
PATTERNS = 24

#: The vocabulary file's own split, after white space is one space and letters are small.
_MATCHES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
).findall


#: Characters beyond Latin-1, and a sign after a letter: no match of that split goes over the
#: place between the two.
_BEYOND, _SIGNED = r"[^\x{00}-\x{FF}]", r"(\pL)([^\s\pL\pN])"

#: `ids` are little-endian 32-bit integers.
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def _is_latin(text: str) -> bool:
    """Whether all characters are of Latin-1."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Recent(Memory):
    """A memory that does not keep what belongs to long keys."""

    def __missing__(self, key: str) -> bytes:
        return self.compute(key) if len(key) > LONGEST else super().__missing__(key)


class Words:
    """Ids of texts, word by word: the vocabulary drops white space, so words stand alone.

    Words of Latin-1 characters are split and looked up as the vocabulary file says, each
    match by the library's BPE model; all other words go through the whole tokenizer. Texts of
    Latin-1 characters are split many at once, in small letters and before signs, which leaves
    far fewer different words, and each of these is looked up once for all of the texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.shown = dict(enumerate(byte_characters()))
        self.known = Recent(self._word, WORDS)

    def _match(self, own: str) -> bytes:
        plain = own.isascii() and own.isalnum()  # the byte table leaves these as they are
        shown = own if plain else own.encode().decode("latin-1").translate(self.shown)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of a word, or of a match, which is a word too."""
        if len(word) > LONGEST or not _is_latin(word):
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            return array("I", ids).tobytes()
        small = word.lower()
        if small.isalpha():
            return self._match(small)
        found = _MATCHES(small)
        if found == [word]:
            return self._match(word)
        return b"".join(map(self.known.__getitem__, found))

    def text(self, text: str | None) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        if _is_latin(text):  # lower case is part of the vocabulary's own normalization
            text = text.lower()
        # any white space parts words; lines are the most frequent after spaces
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))

    def texts(self, column: pa.Array) -> list[bytes]:
        """The ids of each of many texts, as of one."""
        column = column.cast(pa.large_string()).fill_null("")
        sizes = pc.binary_length(column).to_numpy()
        beyond = pc.match_substring_regex(column, _BEYOND).to_numpy(zero_copy_only=False)
        alone = beyond | (sizes > TEXTS)
        out: list[bytes] = [b""] * len(column)
        for k in np.flatnonzero(alone):
            out[k] = self.text(column[k].as_py())
        rest = np.flatnonzero(~alone)
        groups = np.cumsum(sizes[rest]) // TEXTS
        for own in np.split(rest, np.flatnonzero(np.diff(groups)) + 1):
            if len(own):
                for k, ids in zip(own, self._latin(column.take(pa.array(own))), strict=True):
                    out[k] = ids
        return out

    def _latin(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of texts of Latin-1 characters."""
        split = pc.replace_substring_regex(pc.utf8_lower(column), _SIGNED, r"\1 \2")
        split = pc.ascii_split_whitespace(split)
        found = split.flatten().dictionary_encode()
        names = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        each = list(map(self.known.__getitem__, names))
        ids = np.frombuffer(b"".join(each), "<u4")
        sizes = np.array([len(x) // 4 for x in each], np.int64)
        word = found.indices.to_numpy()
        ends = np.cumsum(sizes[word])
        start = (np.cumsum(sizes) - sizes)[word] - (ends - sizes[word])
        tokens = ids[np.repeat(start, sizes[word]) + np.arange(ends[-1] if len(ends) else 0)]
        words_ = np.cumsum(pc.list_value_length(split).to_numpy())
        places = np.concatenate([[0], ends])[np.concatenate([[0], words_])]
        return (tokens[a:b].tobytes() for a, b in zip(places[:-1], places[1:], strict=True))


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    """One per Python worker and vocabulary."""
    return Words(path)


def pieces(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """The pieces of each document: place, length and ids."""
    path = path or public_tokenizers.path(VOCABULARY)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = []
                texts = words(path).texts(part.column(1))
                for key, ids in zip(part.column(0).to_pylist(), texts, strict=True):
                    ids += end
                    for k in range(0, len(ids), 4 * length):
                        own = ids[k : k + 4 * length]
                        found.append(
                            (key, k // (4 * length), k // 4, len(own) // 4, own)
                        )
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, PIECES
    )


def patterns(counts: np.ndarray, length: int, most: int = PATTERNS) -> np.ndarray:
    """Rows of up to three lengths, 0 for none, that fill a sequence, longest first.

    For each longest length the partners with the most pieces are preferred.
    """
    there = np.flatnonzero(counts)
    found = [(length, 0, 0)] if counts[length] else []
    for a in there[there < length]:
        rest = length - a
        if rest <= a and counts[rest]:
            found.append((a, rest, 0))
        second = there[(there <= min(a, rest - 1)) & (there >= (rest + 1) // 2)]
        second = second[counts[rest - second] > 0]
        best = np.argsort(-np.minimum(counts[second], counts[rest - second]), kind="stable")
        found += [(a, b, rest - b) for b in second[best[:most]]]
    return np.array(found, np.int64).reshape(-1, 3)


def fitted(rows: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared misfit to the histogram.

    Accelerated projected gradient steps on the sparse pattern matrix.
    """
    size = len(counts)
    target = counts.astype(float)
    target[0] = 0.0

    def used(x: np.ndarray) -> np.ndarray:
        out = np.bincount(rows.ravel(), np.repeat(x, rows.shape[1]), size)
        out[0] = 0.0
        return out

    def back(y: np.ndarray) -> np.ndarray:
        return y[rows].sum(axis=1)

    v = np.ones(len(rows))
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = back(used(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(rounds):
        ahead = np.maximum(y - back(used(y) - target) / (1.05 * top), 0.0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = ahead + (t - 1) / t_next * (ahead - x)
        x, t = ahead, t_next
    return x


def plan(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first, count, sequence, offset) that pack all pieces of a histogram."""
    counts = np.zeros(length + 1, np.int64)
    for size, n in histogram.items():
        counts[size] = n
    left, taken = counts.copy(), np.zeros(length + 1, np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(size: int, n: int, sequence: int, offset: int) -> None:
        runs.append((size, int(taken[size]), n, sequence, offset))
        taken[size] += n
        left[size] -= n

    rows = patterns(counts, length)
    if len(rows):
        repeats = np.rint(fitted(rows, counts)).astype(np.int64)
        for k in np.argsort(-repeats, kind="stable"):
            sizes = [int(size) for size in rows[k] if size]
            n = min(int(repeats[k]), *(int(left[s]) // sizes.count(s) for s in sizes))
            if n > 0:
                at = 0
                for size in sizes:
                    put(size, n, sequences, at)
                    at += size
                sequences += n
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free places: (first, count)
    for size in range(length, 0, -1):
        free = size
        while left[size]:
            while free <= length and not open_.get(free):
                free += 1
            if free > length:
                # New sequences take as many pieces of this length as they hold.
                n, fill = int(left[size]), length // size
                full, rest = divmod(n, fill)
                for k in range(fill if full else 0):
                    put(size, full, sequences, k * size)
                if full and length - fill * size:
                    open_[length - fill * size].append((sequences, full))
                sequences += full
                for k in range(rest):
                    put(size, 1, sequences, k * size)
                if rest:
                    open_[length - rest * size].append((sequences, 1))
                    sequences += 1
                break
            first, n = open_[free].pop()
            some = min(n, int(left[size]))
            put(size, some, first, length - free)
            if n > some:
                open_[free].append((first + some, n - some))
            if free > size:
                open_[free - size].append((first, some))
    return runs


def numbered(parts: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Add `number`, gapless from 0 within each length, and never sort a length in one task.

    A length's pieces fall into buckets by a hash of the whole piece; the pieces of earlier
    buckets are counted, those of the same bucket are numbered in order.
    """
    sizes = parts.groupBy("length").agg(F.count("*").alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    salts = max(1, -(-most // bucket))
    salted = parts.withColumn(
        "_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids"), F.lit(salts))
    )
    key = (F.col("length") * salts + F.col("_salt")).alias("_key")
    counts = salted.groupBy(key, "length").agg(F.count("*").alias("_n"))
    before = with_offsets(counts, "_key", "_n").select("_key", "length", "offset")
    first = before.groupBy("length").agg(F.min("offset").alias("_first"))
    base = before.join(first, "length").select(
        F.col("_key").alias("_bucket"), (F.col("offset") - F.col("_first")).alias("_base")
    )
    inside = Window.partitionBy("_key").orderBy("doc_id", "piece", "ids")
    ranked = salted.withColumn("_key", F.col("length") * salts + F.col("_salt")).withColumn(
        "_at", F.row_number().over(inside) - 1
    )
    return ranked.join(base, F.col("_key") == F.col("_bucket")).select(
        *parts.columns, (F.col("_base") + F.col("_at")).alias("number")
    )


def packed(parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Add `sequence_id` and `offset` to pieces that have a `length`."""
    histogram = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}
    runs = sorted(plan(histogram, length))
    starts = [(size, first) for size, first, *_ in runs]
    names = parts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = [], []
            for size, number in zip(
                batch.column("length").to_pylist(), batch.column("number").to_pylist(), strict=True
            ):
                _, first, _, own, place = runs[bisect_right(starts, (size, number)) - 1]
                sequence.append(own + number - first)
                offset.append(place)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in names),
                    pa.array(sequence, pa.int64()),
                    pa.array(offset, pa.int64()),
                ],
                names=[*names, "sequence_id", "offset"],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields)
    return numbered(parts).mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """The pieces of all documents with their ids, the checksum of these, and their sequences.

    The texts are tokenized once.
    """
    return packed(stored(pieces(docs, length, path)), length).withColumn(
        "ids_crc32", F.crc32("ids")
    )


def sequences(rows: DataFrame) -> DataFrame:
    """sequence_id, length and ids of each training sequence: its pieces' ids by offset."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda ids, part: F.concat(ids, part["ids"]))
    whole = rows.groupBy("sequence_id").agg(joined.alias("ids"))
    length = (F.octet_length("ids") / 4).cast("long").alias("length")
    return whole.select("sequence_id", length, "ids")


def write_sequences(rows: DataFrame, path: str) -> None:
    """The packed sequences of `pack_documents` as Parquet."""
    sequences(rows).write.parquet(path)


def digests(rows: DataFrame) -> DataFrame:
    """Packed pieces with the checksum of their ids in place of the ids."""
    return rows.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack_documents(documents(spark, sf_dir)))
