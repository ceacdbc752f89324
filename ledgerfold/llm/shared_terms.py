"""Ranked lexical search of many items at once, sharing the sums that they have in common.

A document's score for an item is a sum over the item's terms, and items share terms. What they
share is found before the documents are scored:

1. `mined` orders each item's terms by the number of items that have them, and replaces
   neighbours that two or more items have in common by a node, round after round. The nodes are
   term sets, each the union of two smaller ones: a graph without cycles that items share.
2. One pass over the documents counts, for every document, its terms and those of the items.
   These counts are stored; document frequencies and totals are summed from them.
3. A second pass reads the counts only. For some hundreds of documents at a time it computes each
   term's part of the score, then each node's from its two parts, once, whichever and however many
   items use it, and then each item's from its nodes. Every task keeps an item's best documents;
   the best of all tasks' are the result.

Items are worked on in blocks of about 4,096, so that what tasks get of the items is bounded, and
every block ranks all documents. Documents are never shuffled, so no term, text or source is hot.

Null texts have no terms. Documents of equal score are ordered by doc_id, a null one first; equal
rows rank as often as they come. Rows of one item_id are one item with the terms of all of them; a
null item_id is an item too. Items without terms, and empty tables, give no rows. Very long texts
are counted whole. Only doc_id, item_id and text are read, so that other columns clash with nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerfold.llm.common import documents, stored

#: Results for each item.
BEST = 10
#: Items of a block, about; a hash of the id deals them out.
ITEMS = 4_096
#: Documents scored at once in a task.
BATCH = 512

#: Bytes that are part of no term become spaces, and A to Z small letters.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in UTF-8."""
    return text.encode().translate(_TERM_BYTES).split(b" ") if text else []


@dataclass(frozen=True)
class Plan:
    """How the sums of a block of items are made.

    Symbols are numbered: first the `leaves`, a term's number and how often an item repeats it;
    then the `nodes`, two earlier symbols each. An item is a list of symbols.
    """

    vocabulary: dict[bytes, int]
    leaves: list[tuple[int, int]]
    nodes: list[tuple[int, int]]
    items: list[list[int]]

    def additions(self) -> int:
        return len(self.nodes) + sum(max(0, len(own) - 1) for own in self.items)


def mined(texts: list[list[bytes]]) -> Plan:
    """The plan for items given by their terms."""
    counts = [Counter(own) for own in texts]
    held = Counter(term for own in counts for term in own)
    order = sorted(held, key=lambda term: (-held[term], term))
    vocabulary = {term: n for n, term in enumerate(order)}
    used = Counter((vocabulary[t], n) for own in counts for t, n in own.items())
    leaves = sorted(used, key=lambda leaf: (-used[leaf], leaf))
    number = {leaf: n for n, leaf in enumerate(leaves)}
    items = [sorted(number[vocabulary[t], n] for t, n in own.items()) for own in counts]
    nodes: list[tuple[int, int]] = []
    while True:
        pairs: Counter = Counter()
        for own in items:
            pairs.update(set(zip(own, own[1:], strict=False)))
        shared = {pair: n for pair, n in pairs.items() if n > 1}
        if not shared:
            break
        made: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for item, own in enumerate(items):
            # the most shared neighbours first; a symbol joins one pair at most
            places = sorted(
                (k for k in range(len(own) - 1) if (own[k], own[k + 1]) in shared),
                key=lambda k: (-shared[own[k], own[k + 1]], own[k], own[k + 1]),
            )
            taken: set[int] = set()
            for k in places:
                if k not in taken and k + 1 not in taken:
                    taken |= {k, k + 1}
                    made.setdefault((own[k], own[k + 1]), []).append((item, k))
        again = {pair: at for pair, at in made.items() if len(at) > 1}
        if not again:  # a pair's other items used its symbols elsewhere: one pair alone is left
            pair = min(shared, key=lambda p: (-shared[p], p))
            again = {
                pair: [
                    (item, k)
                    for item, own in enumerate(items)
                    for k in range(len(own) - 1)
                    if (own[k], own[k + 1]) == pair
                ]
            }
        joined: dict[int, dict[int, int]] = {}
        for pair in sorted(again):
            nodes.append(pair)
            for item, k in again[pair]:
                joined.setdefault(item, {})[k] = len(leaves) + len(nodes) - 1
        for item, at in joined.items():
            own, out, k = items[item], [], 0
            while k < len(own):
                out.append(at.get(k, own[k]))
                k += 2 if k in at else 1
            items[item] = out
    return Plan(vocabulary, leaves, nodes, items)


COUNTED = "doc_id long, n long, terms array<int>, times array<int>"


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Each document's number of terms, and which terms of the vocabulary it has how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = vocabulary.get
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                sizes, places, times = [], [], []
                for text in part.column(1).to_pylist():
                    words = terms(text)
                    found = Counter(map(look, words))
                    found.pop(None, None)
                    sizes.append(len(words) - words.count(b""))
                    places.append(list(found))
                    times.append(list(found.values()))
                lists = pa.list_(pa.int32())
                columns = [pa.array(sizes, pa.int64()), pa.array(places, lists)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *columns, pa.array(times, lists)],
                    names=["doc_id", "n", "terms", "times"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, COUNTED
    )


def weights(n_docs: int, frequencies: np.ndarray) -> np.ndarray:
    """A term's weight by the number of documents that have it."""
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * frequencies + 1))).astype(np.int64)


class Scorer:
    """Scores batches of documents for all items of a plan, and keeps each item's best."""

    def __init__(self, plan: Plan, weight: np.ndarray, n_docs: int, n_terms: int, best: int):
        self.plan, self.weight, self.n_docs, self.n_terms = plan, weight, n_docs, n_terms
        self.best = best
        # the leaves of each term, as rows: first row and number of rows
        leaf_terms = np.array([t for t, _ in plan.leaves], np.int64)
        self.rows = np.argsort(leaf_terms, kind="stable")
        self.times = np.array([n for _, n in plan.leaves], np.int64)[self.rows]
        size = len(plan.vocabulary)
        self.count = np.bincount(leaf_terms, minlength=size)
        self.first = np.cumsum(self.count) - self.count
        self.kept: list[list[tuple]] = [[] for _ in plan.items]  # (-score, known, doc_id)
        self.least = np.ones(len(plan.items), np.int64)

    def scores(self, docs: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Items x documents; a document is its number of terms, and terms with their times."""
        width = len(docs)
        m = [25 + 75 * n * self.n_docs // self.n_terms for n, _, _ in docs]
        lengths = np.repeat(np.array(m, np.int64), [len(t) for _, t, _ in docs])
        column = np.repeat(np.arange(width), [len(t) for _, t, _ in docs])
        term = np.concatenate([t for _, t, _ in docs]).astype(np.int64)
        tf = np.concatenate([f for _, _, f in docs]).astype(np.int64)
        part = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * lengths))
        sums = np.zeros((len(self.rows) + len(self.plan.nodes), width), np.int64)
        uses = self.count[term]
        at = np.repeat(self.first[term], uses) + (
            np.arange(uses.sum()) - np.repeat(np.cumsum(uses) - uses, uses)
        )
        sums[self.rows[at], np.repeat(column, uses)] = np.repeat(part, uses) * self.times[at]
        for k, (a, b) in enumerate(self.plan.nodes, len(self.rows)):
            np.add(sums[a], sums[b], out=sums[k])
        out = np.zeros((len(self.plan.items), width), np.int64)
        for k, own in enumerate(self.plan.items):
            for symbol in own:
                out[k] += sums[symbol]
        return out

    def add(self, ids: list[int | None], docs: list[tuple]) -> None:
        found = self.scores(docs)
        known = np.array([i is not None for i in ids])
        keys = np.array([i or 0 for i in ids], np.int64)
        items, columns = np.nonzero(found >= self.least[:, None])
        ends = np.searchsorted(items, np.arange(len(self.kept) + 1))
        for item in np.flatnonzero(np.diff(ends)):
            own = columns[ends[item] : ends[item + 1]]
            score = found[item, own]
            if len(own) > self.best:
                order = np.lexsort((keys[own], known[own], -score))[: self.best]
                own, score = own[order], score[order]
            more = zip((-score).tolist(), known[own].tolist(), keys[own].tolist(), strict=True)
            self.kept[item] = sorted([*self.kept[item], *more])[: self.best]
            if len(self.kept[item]) == self.best:
                self.least[item] = -self.kept[item][-1][0]

    def result(self) -> list[tuple[int, int | None, int]]:
        return [
            (item, key if known else None, -score)
            for item, own in enumerate(self.kept)
            for score, known, key in own
        ]


def _best(counts: DataFrame, plan: Plan, best: int) -> DataFrame:
    """number (of the item), rank, doc_id and score."""
    total = counts.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    n_docs, n_terms = total[0], total[1] or 0
    # a row for each term of the block's items
    rows = counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    frequencies = np.zeros(len(plan.vocabulary), np.int64)
    for term, n in rows:
        frequencies[term] = n
    weight = weights(n_docs, frequencies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(plan, weight, n_docs, n_terms, best)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                places, times = part.column(2), part.column(3)
                docs = [
                    (n, places[k].values.to_numpy(), times[k].values.to_numpy())
                    for k, n in enumerate(part.column(1).to_pylist())
                ]
                scorer.add(part.column(0).to_pylist(), docs)
        found = scorer.result()
        columns = zip(*found, strict=True) if found else ((), (), ())
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["number", "doc_id", "score"],
        )

    there = counts.where(F.size("terms") > 0)
    parts = there.mapInArrow(run, "number int, doc_id long, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return (
        parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    )


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST, block: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id and score of each item's best documents, of those above zero."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType
    own = stored(
        items.select("item_id", F.col("text").cast("string").alias("text")).withColumn(
            "_block", F.xxhash64("item_id")
        )
    )
    blocks = max(1, -(-own.count() // block))
    docs = docs.select("doc_id", "text")
    found = None
    for k in range(blocks):
        rows = own.where(F.pmod("_block", F.lit(blocks)) == k).select("item_id", "text").collect()
        texts: dict = {}
        for item_id, text in rows:
            texts.setdefault(item_id, []).extend(t for t in terms(text) if t)
        plan = mined(list(texts.values()))
        if not plan.vocabulary:
            continue
        best_of = _best(stored(counted(docs, plan.vocabulary)), plan, best)
        names = spark.createDataFrame(
            [(number, item_id) for number, item_id in enumerate(texts)],
            f"number int, item_id {kind.simpleString()}",
        )
        part = best_of.join(names, "number").select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    if found is None:
        schema = f"item_id {kind.simpleString()}, rank int, doc_id long, score long"
        return spark.createDataFrame([], schema)
    return found


def op12_shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return ranked(documents(spark, sf_dir), items)


#: The same in SQL.
SQL = """
with words as (
  select doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
  from documents),
sizes as (select doc_id, count(*) as n from words group by doc_id),
total as (select count(*) as docs, cast(sum(n) as bigint) as terms from sizes),
wanted as (
  select item_id, term, count(*) as times
  from (select item_id, unnest(regexp_extract_all(
                 translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
        from benchmark)
  group by item_id, term),
held as (
  select doc_id, term, count(*) as tf from words
  where term in (select term from wanted) group by doc_id, term),
weighed as (
  select term, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) as bigint) as w
  from held cross join total group by term),
scored as (
  select item_id, doc_id,
         cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) as bigint) as score
  from wanted join weighed using (term) join held using (term) join sizes using (doc_id) cross join total
  group by item_id, doc_id)
select item_id, cast(rank as int) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank
      from scored where score > 0)
where rank <= 10
"""
