"""Entropy-coded token files, shared ranking and the Merkle manifest against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from compare import differences, oracle
from odd import empty, odd, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerfold.llm import merkle, queries, range_ans, shared_terms
from ledgerfold.llm.common import scratch

SF_DIR = "/root/testdata/sf0.001"


# ---- range asymmetric numeral system -------------------------------------------------


def coded(sizes, seed=0, ids=5_000):
    rng = np.random.default_rng(seed)
    blocks = [rng.zipf(1.3, size=n) % ids for n in sizes]
    table = range_ans.Table(range_ans.scaled(np.bincount(np.concatenate(blocks), minlength=ids)))
    return blocks, table


def test_blocks_of_any_size_come_back():
    blocks, table = coded((1, 31, 32, 33, 8_191, 8_192, 8_193, 16_384, 5_000))
    payloads = range_ans.encode_blocks(blocks, table)
    for ids, back in zip(blocks, range_ans.decode_blocks(payloads, table), strict=True):
        assert ids.tolist() == back.tolist()
    # a block alone is what it is among others
    assert range_ans.encode_blocks([blocks[4]], table) == [payloads[4]]


def test_the_files_are_near_the_entropy():
    blocks, table = coded((16_384,) * 8)
    counts = np.bincount(np.concatenate(blocks))
    share = counts[counts > 0] / counts.sum()
    least = -(share * np.log2(share)).sum() * counts.sum() / 8
    assert sum(map(len, range_ans.encode_blocks(blocks, table))) < 1.05 * least


def test_a_range_is_decoded_from_the_checkpoints_around_it(monkeypatch):
    blocks, table = coded((16_384,))
    payload = range_ans.encode_blocks(blocks, table)[0]
    parts = []
    kept = range_ans._decode_parts
    monkeypatch.setattr(range_ans, "_decode_parts", lambda p, t: parts.extend(p) or kept(p, t))
    span = range_ans.CHECKPOINT * range_ans.LANES
    for first, last in ((0, 1), (span - 1, span + 1), (span + 5, span + 6), (16_380, 20_000), (9, 9)):
        parts.clear()
        found = range_ans.decode_range(payload, table, first, last)
        assert found.tolist() == blocks[0][first:last].tolist()
        assert len(parts) <= 2
    assert not parts


def test_damage_and_foreign_tables_are_noticed():
    blocks, table = coded((5_000,))
    payload = range_ans.encode_blocks(blocks, table)[0]
    broken = bytearray(payload)
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        range_ans.decode_blocks([bytes(broken)], table)
    other = range_ans.Table(range_ans.scaled(np.bincount(blocks[0], minlength=5_001) + 1))
    with pytest.raises(ValueError, match="another table"):
        range_ans.decode_blocks([payload], other)
    with pytest.raises(ValueError, match="no frequency"):
        range_ans.encode_blocks([np.array([int(np.flatnonzero(table.frequencies == 0)[0])])], table)


@pytest.mark.parametrize("counts", [[5], [0, 1], [10**9, 1, 1, 1], [1] * 3_000, [7, 0, 3, 10**12], []])
def test_frequencies_fill_the_range(counts):
    found = range_ans.scaled(np.array(counts, np.int64))
    assert ((found > 0) == (np.array(counts) > 0)).all()
    assert not counts or int(found.sum()) == 1 << range_ans.BITS


def test_frequencies_of_many_rare_ids():
    counts = np.ones(1 << 10, np.int64)
    counts[0] = 10**15
    assert int(range_ans.scaled(counts, 11).sum()) == 1 << 11
    with pytest.raises(ValueError):
        range_ans.scaled(np.ones(1 << 5, np.int64), 4)


def expected_tokens(texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    return [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_documents_come_back_from_their_files(spark):
    docs = odd(spark)
    path = scratch(spark, "tokens")
    range_ans.write_tokens(docs, path)
    found = range_ans.read_tokens(spark, path).orderBy("start").collect()
    source = docs.select("doc_id", "text").collect()
    assert len(found) == len(source)
    # ascending ids, a missing one first; places follow each other
    order = [(r.doc_id is not None, r.doc_id) for r in found]
    assert order == sorted(order, key=lambda x: (x[0], x[1] or 0))
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    want = Counter(
        (r.doc_id, np.array(ids, "<u4").tobytes())
        for r, ids in zip(source, expected_tokens([r.text for r in source]), strict=True)
    )
    assert Counter((r.doc_id, bytes(r.ids)) for r in found) == want
    assert max(r.n_tokens for r in found) > range_ans.BLOCK  # one is spread over blocks
    again = scratch(spark, "tokens")
    range_ans.write_tokens(empty(spark), again)
    assert range_ans.read_tokens(spark, again).isEmpty()


def test_the_query_gives_the_library_s_ids(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()
    at, want = 0, []
    for row, ids in zip(rows, expected_tokens([r.text for r in rows]), strict=True):
        want.append((row.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    found = range_ans.op11_range_ans(spark, SF_DIR)
    assert found.dtypes == [
        ("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")
    ]
    assert sorted(map(tuple, found.collect())) == want


# ---- ranked search ------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(SMALL))


def best_of(docs, items):
    """(item_id, rank, doc_id, score) by definition."""
    counted = [(key, Counter(terms_of(text))) for key, text in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for (key, c), size in zip(counted, sizes, strict=True):
            score = 0
            for term in terms_of(text):
                if c[term]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1)))
                    m = 100 - 75 + (75 * size * n) // length
                    score += w * ((1_000_000_000 * c[term]) // (1000 * c[term] + 8 * m))
            if score > 0:
                scores.append((-score, key is not None, key or 0, key))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:10], 1)]
    return out


def test_ranks_of_odd_documents(spark):
    docs = odd(spark).select("doc_id", "text", "lang")
    texts = [None, "", "...", "words again", "the on ver THE, the café", "X" * 30_000, prose(2, 3_000),
             "no id", "same words again and again", "words again"]
    items = [(k, t) for k, t in enumerate(texts)] + [(3, "eight windows"), (None, "windows")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    found = shared_terms.ranked(docs, table)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    merged: dict = {}
    for k, t in items:  # rows of one id are one item
        merged[k] = " ".join([merged.get(k) or "", t or ""])
    want = best_of([(r.doc_id, r.text) for r in docs.collect()], merged.items())
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    rows = sorted(map(tuple, found.collect()), key=key)
    assert rows == sorted(want, key=key)
    small = shared_terms.ranked(docs, table, block=2)  # several blocks give the same
    assert sorted(map(tuple, small.collect()), key=key) == rows
    assert shared_terms.ranked(empty(spark), table).isEmpty()
    none = spark.createDataFrame([], "item_id long, text string")
    assert shared_terms.ranked(docs, none).isEmpty()


def test_shared_sums_are_those_of_each_item():
    texts = [terms_of(prose(k % 7, 30) + " " + prose(k, 12)) for k in range(60)]
    texts += [[], ["one"], ["one", "one"], texts[0]]
    plan = shared_terms.mined([[t.encode() for t in own] for own in texts])
    sums = [Counter({t: n}) for t, n in plan.leaves]
    for a, b in plan.nodes:
        sums.append(sums[a] + sums[b])
    for own, symbols in zip(texts, plan.items, strict=True):
        total = sum((sums[s] for s in symbols), Counter())
        assert total == Counter(plan.vocabulary[t.encode()] for t in own)
    alone = sum(max(0, len(set(own)) - 1) for own in texts)
    assert plan.nodes and plan.additions() < 0.8 * alone
    parts = [{k} for k in range(len(plan.leaves))]
    for k, (a, b) in enumerate(plan.nodes, len(parts)):
        parts.append({k} | parts[a] | parts[b])
    serves = Counter(s for own in plan.items for s in set().union(*(parts[x] for x in own)))
    assert all(serves[s] > 1 for s in range(len(plan.leaves), len(sums)))


def test_search_query_equals_its_sql(spark):
    name = "op12_shared_terms"
    assert differences(queries.QUERIES[name](spark, SF_DIR), oracle(SF_DIR), queries.SQL[name]) == []


# ---- Merkle manifest ----------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def walk(nodes):
    """The last node, and each first node's siblings up to it."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, place in enumerate(at):
            if (place ^ 1) < len(nodes):
                paths[leaf].append(nodes[place ^ 1])
        nodes = [sha(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        at = [k // 2 for k in at]
    return nodes[0], paths


def expected_manifest(rows):
    groups: dict = {}
    for r in rows:
        leaf = sha(*(field(r[n]) for n in merkle.FIELDS))
        groups.setdefault(r["lang"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0), leaf, r["doc_id"]))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort()
        trees[lang] = walk([leaf for _, leaf, _ in groups[lang]])
    root, above = walk([trees[lang][0] for lang in langs])
    out = []
    for lang, upper in zip(langs, above, strict=True):
        for (_, leaf, key), path in zip(groups[lang], trees[lang][1], strict=True):
            out.append((key, leaf, trees[lang][0], root, sha(*path, *upper)))
    return Counter(out)


def documents_of(spark, n, langs=("de", "en", None, "ü", "z")):
    rows = [
        (k if k % 97 else None, prose(k, k % 5) or None, langs[0 if k % 3 else k % len(langs)], "s", k)
        for k in range(n)
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame([*rows, rows[5], rows[5], rows[7]], schema)


@pytest.mark.parametrize("band", [1, 2, 10])
@pytest.mark.parametrize("n", [8, 201])
def test_manifest_equals_the_definition(spark, n, band):
    docs = documents_of(spark, n)
    found = merkle.manifest(docs, band=band)
    rows = found.withColumns(
        {
            "folded": merkle.folded(F.col("leaf"), F.col("proof")),
            "joined": F.sha2(merkle.siblings(F.col("proof")).cast("binary"), 256),
        }
    ).collect()
    assert Counter((r.key, r.leaf, r.subroot, r.root, r.joined) for r in rows) == expected_manifest(
        docs.collect()
    )
    assert all(r.folded == r.root for r in rows)


def test_manifest_of_odd_tables(spark):
    docs = odd(spark)
    rows = merkle.manifest(docs).collect()
    assert Counter(r.leaf for r in rows) == Counter(
        sha(*(field(r[n]) for n in merkle.FIELDS)) for r in docs.collect()
    )
    assert merkle.manifest(empty(spark)).isEmpty()
    one = docs.where("doc_id = 3")
    (row,) = merkle.manifest(one).collect()
    assert row.leaf == row.subroot == row.root and row.proof == []


def test_a_changed_field_leads_to_another_root(spark):
    rows = merkle.op13_time_forward(spark, SF_DIR).collect()
    for r in rows:
        tampered = zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        assert r.verified == (not tampered) and (r.folded_root == r.root) == r.verified
    assert {r.verified for r in rows} == {True, False}


def test_manifest_query_equals_its_sql(spark):
    name = "op13_time_forward"
    assert differences(queries.QUERIES[name](spark, SF_DIR), oracle(SF_DIR), queries.SQL[name]) == []
