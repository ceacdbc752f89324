"""Fingerprints, language model, similarity join and the pipeline by brute force."""

import collections
import math
import random

import numpy as np
import pytest
from odd import WORD, empty, odd, prose
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerfold.llm import class_lm, jaccard_join, syncmers
from ledgerfold.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_anchors_are_closed_syncmers(spark):
    """The choice of k-mers is made again from Spark's own hashes of their inner words."""
    docs = odd(spark).select("doc_id", "text").where("length(text) < 1000")
    hashed = {}
    words = {w for r in docs.collect() for w in WORD.findall(r.text or "")}
    for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "xxhash64(w) h").collect():
        hashed[r.w] = r.h
    pairs = {(hashed[a], hashed[b]) for r in docs.collect() for w in [WORD.findall(r.text or "")] for a, b in zip(w, w[1:], strict=False)}
    inner = {
        (r.a, r.b): r.h
        for r in spark.createDataFrame(list(pairs), "a long, b long").selectExpr("a", "b", "xxhash64(a, b) h").collect()
    }
    for r in syncmers.with_anchors(docs, "text", "anchors").collect():
        w = [hashed[x] for x in WORD.findall(r.text or "")]
        s = [inner[p] for p in zip(w, w[1:], strict=False)]
        want = [i for i in range(len(w) - 4) if min(s[i : i + 4]) in (s[i], s[i + 3])]
        got = [a.at for a in r.anchors]
        assert got == (want or [0] * bool(w))


@pytest.mark.parametrize("bucket", (3, 512))
def test_edited_texts_take_from_the_next_document(spark, monkeypatch, bucket):
    monkeypatch.setattr(syncmers, "BUCKET", bucket)
    docs = spark.createDataFrame([(7 * k, prose(k, k % 20)) for k in range(60)], "doc_id long, text string")
    text = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(text, reverse=True)
    after = dict(zip(order, [*order[1:], order[0]], strict=True))
    rows = syncmers.with_edited(docs).collect()
    assert len(rows) == len(text)
    for r in rows:
        half = len(r.text) // 2
        assert r.edited == r.text[: len(r.text) - half] + text[after[r.doc_id]][:half]
    assert syncmers.with_edited(odd(spark)).count() == odd(spark).count()
    assert syncmers.with_edited(empty(spark)).count() == 0


def test_likeness_and_positional_matches(spark):
    long = prose(5, 300)
    docs = spark.createDataFrame([(1, long, "start words go here now " + long)], "doc_id long, a string, b string")
    both = syncmers.with_anchors(syncmers.with_anchors(docs, "a", "x"), "b", "y")
    both = both.withColumn("m", syncmers.matches("x", "y"))
    row = both.withColumn("p", syncmers.hashes("x")).withColumn("q", syncmers.hashes("y"))
    row = row.withColumn("near", syncmers.likeness("p", "q")).first()
    assert row.near > 0.9
    shifts = collections.Counter(p.other - p.at for p in row.m)
    assert shifts.most_common(1)[0][0] == 5


def test_language_model_against_brute_force(spark):
    docs = odd(spark).where("doc_id is not null").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(100 + k, prose(k, 60)) for k in range(80)], docs.schema))
    rows = class_lm.class_scores(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == docs.count()
    tokens = {k: [*class_lm.tokens(t), None] for k, t in text.items()}
    c = collections.Counter()
    for r in docs.collect():
        if not {x.doc_id: x.held_out for x in rows}[r.doc_id]:
            c.update(tokens[r.doc_id])
    n, v = sum(c.values()), len(c)
    for r in rows:
        own = tokens[r.doc_id]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(c[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score <= 0
    assert class_lm.class_scores(empty(spark)).count() == 0


def test_class_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(k, prose(k, 60)) for k in range(80)], "doc_id long, text string")
    counts = stored(class_lm.word_counts(docs))
    model = class_lm.fit(docs, counts)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    by_class = collections.Counter()
    for word, k in model.index.items():
        by_class[model.kind[k]] += 10 ** model.emission[k]
    for k, total in by_class.items():
        assert total + 0.1 / model.class_total[k] == pytest.approx(1)


def test_exchange_separates_two_languages():
    rng = np.random.default_rng(0)
    m = np.zeros((21, 21))
    for a in range(1, 21):
        for b in range(1, 21):
            m[a, b] = rng.integers(50, 100) if (a <= 10) == (b <= 10) else rng.integers(0, 2)
    m[0, 1:] = m[1:, 0] = 1
    own, _ = class_lm.exchange_classes(m, classes=3)
    assert len(set(own[1:11])) == len(set(own[11:])) == 1 and own[1] != own[11] and own[0] == 0


def components(texts, size, percent):
    sets = {}
    for k, text in texts.items():
        w = WORD.findall((text or "").encode().lower().decode())
        sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: (len(sets[k]), find(k)) for k in keys}


def near_copies(seed, n, words=120, edits=4):
    rng = random.Random(seed)
    base = prose(seed, words).split()
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(words)] = f"edit{rng.randrange(10_000)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("size,percent", ((4, 85), (5, 80)))
def test_join_is_exact(spark, size, percent):
    texts = near_copies(1, 40) + near_copies(2, 12, 30, 2) + near_copies(3, 3) + [prose(k, 50) for k in range(20)]
    shared = prose(77, 60)
    texts += [shared + " " + prose(200 + k, 10 + k) for k in range(15)]
    docs = odd(spark, [None, "", " ", "one", "One", "a b", "a B", *texts])
    rows = jaccard_join.linked(docs, size, percent).collect()
    assert len(rows) == docs.count()
    known = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    want = components(known, size, percent)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert jaccard_join.linked(empty(spark)).count() == 0


def test_one_of_each_component_stays(spark):
    docs = odd(spark, [None, None, "", *near_copies(4, 10), prose(8, 40)])
    kept = jaccard_join.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    known = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    want = components(known, 5, 80)
    roots = sorted({root for k, (n, root) in want.items() if n})
    got = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    assert got == sorted([0, 1, 2, *roots])
    assert kept.where("doc_id is null").count() == 1


def test_chains_meet_in_one_component(spark):
    pairs = [(f"{a:03d}".encode(), f"{a + 1:03d}".encode()) for a in range(60) if a != 30]
    links = spark.createDataFrame(pairs, "a binary, b binary")
    got = {bytes(r["class"]): bytes(r["label"]) for r in jaccard_join.components(links).collect()}
    assert {got[b"%03d" % k] for k in range(31)} == {b"000"}
    assert {got[b"%03d" % k] for k in range(31, 61)} == {b"031"}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF))
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now <= before, name
        assert docs.count() == len(now)
        before = now
    pieces = stored(corpus_pipeline.STAGES[-1][1](spark, docs, SF))
    assert {r.doc_id for r in pieces.collect()} == before
    assert pieces.count() == corpus_pipeline.run(spark, SF).count()


@pytest.mark.parametrize("make", (odd, empty))
def test_pipeline_on_odd_and_empty_tables(spark, make):
    docs = make(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
    assert docs.count() >= 0


def test_cells_of_crowded_regions_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", 16)
    texts = near_copies(5, 90, 120, 30) + near_copies(6, 20, 60, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(docs, 5, 80).collect()}
    assert got == components(dict(enumerate(texts)), 5, 80)


def test_few_members_of_other_components_need_no_cells(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", 16)
    cut, whole = [], jaccard_join.cells
    monkeypatch.setattr(jaccard_join, "cells", lambda *args: cut.append(1) or whole(*args))
    monkeypatch.setattr(jaccard_join, "frequent_shingles", lambda counts: np.empty(0, np.uint64))
    texts = near_copies(9, 40, 120, 1)
    far = texts[0].split()
    texts.append(" ".join([*far[:60], *prose(10, 60).split()]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(docs, 5, 80).collect()}
    assert got == components(dict(enumerate(texts)), 5, 80)
    assert not cut


def test_pairs_of_whole_regions_meet_once(spark):
    n, common = 40, list(range(6))
    rows = [
        (r, f"{c:02d}".encode(), n, place, 9, "a" if c else "b")
        for c in range(9) for place, r in enumerate(common)
    ]
    df = spark.createDataFrame(rows, "region long, class binary, n int, place int, size int, label string")
    known = jaccard_join.profiles(df.drop("label"))
    assert [r.before for r in known.first().regions][:3] == [[], [0], [0, 1]]
    assert known.first().regions[-1].before == [1, 2, 3, 4]
    label = F.when(F.col("class") == b"00", "b").otherwise("a").alias("label")
    members = known.select(*(c for c in known.columns if c != "regions"), label, F.inline("regions"))
    regions = jaccard_join.mixed(members)
    assert regions.select("work").distinct().collect() == [(9,)]
    assert jaccard_join.rest_pairs(members, regions, [], 85).count() == 8
    once = jaccard_join.rest_pairs(members, regions.where("region > 0"), [], 85)
    assert once.count() == 0  # all met in the first


def test_regions_are_cut_where_that_leaves_fewer_pairs(spark):
    rows = spark.createDataFrame([(r, k) for r in (1, 2) for k in range(4)], "region long, k int")
    # region 1 parts in halves, region 2 has all members in two cells
    cut = [(1, f"1/{k // 2}") for k in range(4)] + [(2, f"2/{c}") for k in range(4) for c in range(2)]
    cut = spark.createDataFrame(cut, "whole long, region string")
    assert [r.region for r in jaccard_join.eased(rows, cut).collect()] == [1]


def test_sets_are_found_by_the_picked_rows(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (3, "v w x y z"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = {k: jaccard_join.digest(jaccard_join.shingle_set(t)) for k, t in rows if k and t}
    pick = docs.where("doc_id = 2").select(jaccard_join.picked("doc_id", F.xxhash64("text"))).first()[0]
    classes = spark.createDataFrame([(names[1], pick)], "class binary, pick long")
    found = jaccard_join.class_sets(docs, classes).collect()
    assert [(bytes(r["class"]), bytes(r.members)) for r in found] == [
        (names[1], jaccard_join.shingle_set(rows[0][1]).tobytes())
    ]


@pytest.mark.parametrize("held", (1, 3, 4096))
def test_regions_of_one_class_go(spark, monkeypatch, held):
    monkeypatch.setattr(jaccard_join, "HELD", held)
    rows = [(r, b"%02d" % c, 9, 0) for r in range(7) for c in range(r) for _ in range(1 + c % 3)]
    df = spark.createDataFrame(rows, "region long, class binary, n int, place int").coalesce(1)
    got = jaccard_join.shared_regions(df).collect()
    want = sorted((r, b"%02d" % c) for r in range(2, 7) for c in range(r))
    assert sorted((r.region, bytes(r["class"])) for r in got) == want
    assert all(min(r.region, held) <= r["size"] <= r.region for r in got)
