"""Tokens, packing and shards against the libraries and brute force."""

import collections
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from odd import TEXTS, empty, odd, prose
from tokenizers import Tokenizer

from ledgerfold.llm import byte_bpe, packing, sharding


@pytest.fixture(scope="module")
def reference():
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.RANKS))
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_ids_spans_and_bytes(spark, reference):
    docs = odd(spark)
    rows = byte_bpe.encode(docs, offsets=True).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = r.text or ""
        assert r.ids == reference.encode_ordinary(text)
        for i, a, b in list(zip(r.ids, r.starts, r.ends, strict=True))[:2_000]:
            assert reference.decode_single_token_bytes(i) in text[a:b].encode()
    back = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((r.text or "").encode() for r in rows)
    assert byte_bpe.encode(empty(spark)).count() == 0


def test_random_characters_encode_like_the_rank_library(reference):
    codec = byte_bpe.codec(public_tokenizers.path(byte_bpe.RANKS))
    rng = random.Random(3)
    alphabet = "ab'sST19 \n\téß́你\U0001f600.,-_$  "
    for _ in range(3_000):
        text = "".join(rng.choices(alphabet, k=rng.randint(1, 25)))
        ids = np.frombuffer(codec.text(text), np.int32).tolist()
        assert ids == reference.encode_ordinary(text), repr(text)


def test_word_ids_are_those_of_the_library():
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    library.encode_special_tokens = True
    own = packing.words(public_tokenizers.path(packing.VOCABULARY))
    rng = random.Random(4)
    alphabet = "abIT's19 \n\téÉß́你.,-_$ Σİ"
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(1, 25))) for _ in range(2_000)]
    for text in texts:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(own.text(text), "<u4").tolist() == want, repr(text)[:200]


def test_ids_of_many_texts_are_those_of_the_library(monkeypatch):
    monkeypatch.setattr(packing, "TEXTS", 4_000)
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    library.encode_special_tokens = True
    own = packing.Words(public_tokenizers.path(packing.VOCABULARY))
    rng = random.Random(7)
    alphabet = [*map(chr, range(256)), *"abcd efgh's.,!? \n", "你", "İ", "\u0301"]
    texts = [*TEXTS, None, "", " \n", "ab, " * 3_000, "a" * 3_000, "é!" * 2_500]
    texts += ["".join(rng.choices(alphabet[: rng.choice((256, 273, 276))], k=rng.randint(0, 40))) for _ in range(3_000)]
    rng.shuffle(texts)
    found = own.texts(pa.array(texts, pa.string()).slice(1))
    for text, ids in zip(texts[1:], found, strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)[:200]
    assert own.texts(pa.array([], pa.string())) == []


def test_signs_and_capitals_make_no_words_of_their_own():
    own = packing.Words(public_tokenizers.path(packing.VOCABULARY))
    stems = ["".join(c) for c in itertools.product("bdfg", "aeiou", "lmnr")]
    texts = [f"{stem}{sign} {stem.title()}{sign} {stem.upper()}{sign}" for stem in stems for sign in ",.;:!?"]
    own.texts(pa.array(texts))
    assert len(own.known) <= len(stems) + 6


@pytest.mark.parametrize("seed", range(6))
def test_a_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    length = 64
    sizes = [rng.choice((rng.randint(1, 64), 40, rng.randint(1, 9))) for _ in range(rng.choice((1, 30, 4_000)))]
    counts = collections.Counter(sizes)
    filled, placed = collections.defaultdict(list), collections.Counter()
    for size, first, n, sequence, offset in packing.plan(counts, length):
        for k in range(n):
            filled[sequence + k].append((offset, size))
            placed[size, first + k] += 1
    assert placed == {(s, k): 1 for s, n in counts.items() for k in range(n)}
    for parts in filled.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    # no packing does with less than the whole length, or than a sequence for each large piece
    least = max(-(-sum(sizes) // length), sum(s > length // 2 for s in sizes))
    assert len(filled) <= 1.05 * least + 2


def test_packed_documents(spark):
    docs = odd(spark)
    rows = packing.pack_documents(docs, length=128).collect()
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        assert [a for a, _ in sorted(parts)] == np.cumsum([0, *[n for _, n in sorted(parts)[:-1]]]).tolist()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    by_doc = collections.Counter((r.doc_id, r.piece) for r in rows)
    assert by_doc[8, 0] == 3 and by_doc[0, 0] == 1  # repeated rows, null text
    end = zlib.crc32(b"\0\0\0\0")
    assert [(r.length, r.ids_crc32) for r in rows if r.doc_id == 0] == [(1, end)]
    assert packing.pack_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("bucket", (2, 5, 4_096))
def test_shards_hold_every_row_once(spark, bucket):
    docs = odd(spark)
    rows = sharding.shuffled(docs, shards=4, bucket_rows=bucket).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.text or "")
    assert sorted(map(key, rows)) == sorted(map(key, docs.collect()))
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(v) for v in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.shuffled(empty(spark)).count() == 0


def test_shuffle_is_seeded_and_mixes(spark):
    docs = spark.range(500).selectExpr("id as doc_id")
    one, two, other = (
        {r.doc_id: (r.shard, r.slot) for r in sharding.shuffled(docs, seed=s).collect()} for s in (1, 1, 2)
    )
    assert one == two != other
    order = sorted(one, key=lambda k: (one[k][1], one[k][0]))
    assert sum(abs(a - k) for k, a in enumerate(order)) / 500 > 100


def test_written_shards_keep_their_order(spark, tmp_path):
    docs = spark.createDataFrame([(k, prose(k, 5)) for k in range(40)], "doc_id long, text string")
    sharding.write_shards(sharding.shuffled(docs, shards=4), str(tmp_path / "shards"))
    for shard in range(4):
        part = spark.read.parquet(str(tmp_path / "shards" / f"shard={shard}"))
        assert [r.slot for r in part.collect()] == list(range(10))


def test_the_query_writes_whole_documents_to_shards(spark, tmp_path, monkeypatch):
    docs = odd(spark).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    paths = []
    write = sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda df, path: (paths.append(path), write(df, path)))
    rows = sharding.op6_two_pass_shuffle(spark, str(tmp_path)).collect()
    held = spark.read.parquet(paths[0]).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.text or "")
    assert sorted(map(key, held)) == sorted(map(key, docs.collect()))
    by_place = {(r.shard, r.slot): r for r in held}
    assert len(rows) == len(by_place) == docs.count()
    for r in rows:
        own = (by_place[r.shard, r.slot].text or "").encode()
        assert (r.size, r.text_crc32) == (len(own) + 1, zlib.crc32(own))


def test_copies_of_a_record_are_sent_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 3)
    docs = spark.createDataFrame([(1, "a")] * 20 + [(2, "b")], "doc_id long, text string")
    rows = sharding.shuffled(docs, shards=2).collect()
    assert sorted(r.doc_id for r in rows) == [1] * 20 + [2]
    assert len({(r.shard, r.slot) for r in rows}) == 21


def test_written_sequences_hold_the_ids_of_all_documents(spark, tmp_path):
    docs = odd(spark, TEXTS).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack_documents(docs, length=128)
    packing.write_sequences(rows, str(tmp_path / "sequences"))
    held = {r.sequence_id: bytes(r.ids) for r in spark.read.parquet(str(tmp_path / "sequences")).collect()}
    assert max(map(len, held.values())) <= 4 * 128
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    library.encode_special_tokens = True
    texts, own = {r.doc_id: r.text or "" for r in docs.collect()}, collections.defaultdict(bytes)
    for r in sorted(packing.digests(rows).collect(), key=lambda r: (r.doc_id, r.piece)):
        ids = held[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]
        assert zlib.crc32(ids) == r.ids_crc32
        own[r.doc_id] += ids
    assert sum(map(len, own.values())) == sum(map(len, held.values()))
    for k, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own[k], "<u4").tolist() == [*ids, packing.END_ID]


@pytest.mark.parametrize("records", [1, 7, 512])
def test_a_table_is_shuffled_alike_by_any_number_of_tasks(spark, tmp_path, records):
    names = ["_id", "_n", "_record", "_bucket", "_place", "shard", "_at"]
    docs = spark.range(0, 300, 1, 3).selectExpr("if(id % 3 = 0, 1, id) as doc_id", *[f"'x' as {n}" for n in names])
    docs.write.parquet(str(tmp_path / "t"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")}
    found = []
    try:
        for tasks, size in ((4, "128m"), (7, "1k"), (50, "300b")):
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            out = sharding.shuffled_table(spark.read.parquet(str(tmp_path / "t")), shards=4, records=records)
            assert set(out.columns) == {"doc_id", *names, "law", "slot", "grown_shard"}
            found.append(sorted((r.shard, r.slot, r.doc_id, r._id) for r in out.collect()))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert found[0] == found[1] == found[2]
    assert [(s, k) for s, k, *_ in found[0]] == [(s, k) for s in range(4) for k in range(75)]
    assert sorted(d for *_, d, _ in found[0]) == sorted(r.doc_id for r in docs.collect())


def test_orders_are_permutations_and_hang_on_seed_and_bucket(spark):
    from pyspark.sql import functions as F

    sizes = spark.range(2_000).selectExpr("id as b", "cast(id % 6 as bigint) as n")
    orders = sizes.select("n", sharding.fisher_yates(F.col("n"), F.col("b"), 5).alias("o")).collect()
    assert all(sorted(r.o) == list(range(r.n)) for r in orders if r.n)
    threes = collections.Counter(tuple(r.o) for r in orders if r.n == 3)
    assert len(threes) == 6 and min(threes.values()) > 30  # 333 of 6 kinds
    again = sizes.repartition(3).select(F.col("b"), sharding.fisher_yates(F.col("n"), F.col("b"), 5).alias("o"))
    assert [r.o for r in again.orderBy("b").collect()] == [r.o for r in orders]


def test_an_empty_table_has_no_shards(spark, tmp_path):
    empty(spark).select("doc_id", "text").write.parquet(str(tmp_path / "t"))
    assert sharding.shuffled_table(spark.read.parquet(str(tmp_path / "t"))).isEmpty()
