"""Merkle manifest of a dataset by time-forward processing, with a proof for every row.

A leaf is the hash of a row's fields. The leaves of a group (here: of a language) are its tree's
lowest nodes in ascending order of a key; every two neighbours are hashed into a parent until one
node, the subroot, remains, and the subroots in order of their groups are the leaves of one more
tree. A node's label is its level and its place, and a parent's label is known from its child's.

Time-forward processing evaluates such a graph by messages: a node's digest is sent ahead to its
parent's label, and a priority queue ordered by label hands every node the messages of its
children when its turn comes. The queue is external in bands of ten levels: Spark's shuffle sorts
the messages of a band by label, spilling as it must, and a task that reads them works through
the subtrees of its labels one at a time, with a queue in memory for the at most 1,024 messages
within a subtree. Forty levels, a million million leaves, take four bands.

The reversed sweep goes from the root down in the same bands: the siblings on a node's way to the
root, its proof, are sent to the subtree below it, where each child puts its own sibling before
its parent's proof. A row's proof never goes through a shuffle.

Rows of one key are ordered by their leaves; equal rows are kept as often as they come, and the
place of reading tells them apart, so that no key is too large for a range. Null keys and null
groups come first, groups in order of their UTF-8 bytes. Null fields are `-`, so they differ from
empty texts; texts are hashed whole, however long. A group of one row has its leaf as subroot, and
a single group its subroot as root. An empty table gives no rows. Only the named columns are read,
so that others clash with nothing.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerfold.llm.common import documents, remainder, stored

#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a band; a subtree has 2**BAND nodes at its lowest level.
BAND = 10
#: Leaves whose crc32 of the decimal key is divisible by this are tampered with by the query.
TAMPERED = 7

NODES = "tree long, nodes long, place long, digest string, key long, other string"
#: A step of a proof: the mark of the sibling's side and its digest, or nothing without sibling.
LEFT, RIGHT, ALONE = "<", ">", ""


def leaf(*values: Column) -> Column:
    """Hash of fields, each as its UTF-8 byte count, a colon and the value, or `-` where null."""
    texts = [value.cast("string") for value in values]
    fields = [
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
        for t in texts
    ]
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def parent(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and a proof lead to."""

    def step(own: Column, sibling: Column) -> Column:
        other = F.substr(sibling, F.lit(2))
        left = F.when(sibling.startswith(LEFT), other).otherwise(F.lit(""))
        right = F.when(sibling.startswith(RIGHT), other).otherwise(F.lit(""))
        return F.sha2(F.concat(left, own, right).cast("binary"), 256)

    return F.aggregate(proof, digest, step)


def siblings(proof: Column) -> Column:
    """The digests of a proof, one after the other."""
    return F.array_join(F.transform(proof, lambda s: F.substr(s, F.lit(2))), "")


def ordered(df: DataFrame, group: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Add `place`, gapless from 0 within each group in the order of the keys, and `total`.

    Rows are sorted in ranges, of which one group may fill many; every range adds what the ranges
    before it hold of a group.
    """
    by = [*group, *keys, "_at"]
    rows = stored(
        df.withColumn("_at", F.monotonically_increasing_id())
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .drop("_at")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    # a struct equals another where both have nulls
    own = F.struct(*group, F.lit(0).alias("_")).alias("_group")
    counts = rows.groupBy("_part", own).agg(
        F.count("*").alias("_n"), F.min("_row").alias("_first")
    )
    whole = Window.partitionBy("_group")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        "_part",
        "_group",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"),
        F.sum("_n").over(whole).alias("total"),
    )
    return (
        rows.withColumn("_group", own)
        .join(bases, ["_part", "_group"])
        .withColumn("place", F.col("_row") + F.col("_base"))
        .drop("_part", "_row", "_base", "_group")
    )


def levels(nodes: int, band: int = BAND) -> int:
    """Levels that a subtree rises within a band, if its tree has so many nodes at the lowest."""
    return band if nodes > 1 << band else (nodes - 1).bit_length()


def swept(digests: Sequence[str], rise: int) -> list[list[str]]:
    """The nodes of a subtree level by level: children's messages leave a queue in label order."""
    found: list[list[str]] = [[] for _ in range(rise + 1)]
    queue = [(0, place, digest) for place, digest in enumerate(digests)]  # in order: a heap
    while queue:
        level, place, digest = heapq.heappop(queue)
        found[level].append(digest)
        if level < rise:
            run = [digest]
            if queue and queue[0][:2] == (level, place + 1):
                run.append(heapq.heappop(queue)[2])
                found[level].append(run[1])
            heapq.heappush(queue, (level + 1, place // 2, parent(*run)))
    return found


def proofs(found: list[list[str]], suffix: list[str]) -> list[list[str]]:
    """The reversed sweep: each lowest node's siblings within the subtree, then the suffix."""
    above = [suffix]
    for nodes in reversed(found[:-1]):
        below = []
        for place in range(len(nodes)):
            if place % 2:
                step = LEFT + nodes[place - 1]
            else:
                step = RIGHT + nodes[place + 1] if place + 1 < len(nodes) else ALONE
            below.append([step, *above[place // 2]])
        above = below
    return above


def _subtrees(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[dict]]:
    """The rows of one subtree after the other, out of rows sorted by label."""
    own: list[dict] = []
    at = None
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            for row in batch.slice(k, size).to_pylist():
                label = (row["tree"], row["subtree"])
                if label != at and own:
                    yield own
                    own = []
                at = label
                own.append(row)
    if own:
        yield own


def _by_label(rows: DataFrame, *more: str) -> DataFrame:
    return rows.repartition("tree", "subtree").sortWithinPartitions(
        "tree", "subtree", *more, "place"
    )


def risen(nodes: DataFrame, band: int = BAND) -> DataFrame:
    """The top nodes of all subtrees of a band: the next band's lowest nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _subtrees(batches, 1 << band):
            nodes = own[0]["nodes"]
            top = swept([row["digest"] for row in own], levels(nodes, band))[-1][0]
            columns = [[own[0]["tree"]], [-(-nodes >> band)], [own[0]["subtree"]], [top]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)),
                    pa.nulls(1, pa.int64()),
                    pa.nulls(1, pa.string()),
                ],
                names=["tree", "nodes", "place", "digest", "key", "other"],
            )

    labelled = nodes.select(
        "tree", "nodes", F.shiftright("place", band).alias("subtree"), "place", "digest"
    )
    return _by_label(labelled).mapInArrow(run, NODES)


def delivered(nodes: DataFrame, suffixes: DataFrame, band: int = BAND) -> DataFrame:
    """The nodes of a band with their proofs and the subroot of their tree.

    `suffixes` has the proof of each subtree's top node: tree, subtree, subroot and proof. It is
    one more message to the subtree's label, which comes before those of its nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, *own in _subtrees(batches, 1 << band):
            found = swept([row["digest"] for row in own], levels(own[0]["nodes"], band))
            names = ["tree", "nodes", "place", "digest", "key", "other"]
            kinds = [*[pa.int64()] * 3, pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(
                        pa.array([row[n] for row in own], kind)
                        for n, kind in zip(names, kinds, strict=True)
                    ),
                    pa.array([head["subroot"]] * len(own), pa.string()),
                    pa.array(proofs(found, head["proof"]), pa.list_(pa.string())),
                ],
                names=[*names, "subroot", "proof"],
            )

    labelled = nodes.withColumn("subtree", F.shiftright("place", band)).withColumn(
        "kind", F.lit(1)
    )
    heads = suffixes.withColumns({"kind": F.lit(0), "place": F.lit(-1).cast("long")})
    both = labelled.unionByName(heads, allowMissingColumns=True)
    return _by_label(both, "kind").mapInArrow(run, f"{NODES}, subroot string, proof array<string>")


def bands(nodes: DataFrame, most: int, band: int = BAND) -> list[DataFrame]:
    """The lowest nodes of every band, from the leaves on; the last has a row for each tree.

    `most` is the number of leaves of the largest tree. One band at least is worked through.
    """
    found = [nodes]
    while most > 1 or len(found) == 1:
        found.append(stored(risen(found[-1], band)))
        most = -(-most >> band)
    return found


def _downward(found: list[DataFrame], suffixes: DataFrame, band: int) -> DataFrame:
    """Proofs of the lowest nodes; `suffixes` has those of each tree's last node."""
    for nodes in reversed(found[:-1]):
        rows = delivered(nodes, suffixes, band)
        suffixes = rows.select("tree", F.col("place").alias("subtree"), "subroot", "proof")
    return rows


def manifest(
    df: DataFrame,
    fields: Sequence[str] = FIELDS,
    group: str = "lang",
    key: str = "doc_id",
    other: Column | None = None,
    band: int = BAND,
) -> DataFrame:
    """key, leaf, subroot, root and proof of every row; `other` is a value taken along.

    A proof has a step for each level from the leaf to the root: `<` or `>` for the side on which
    the sibling stands, then its digest; or nothing where the node has no sibling.
    """
    rows = df.select(
        F.col(group).cast("string").alias("group"),
        F.col(key).cast("long").alias("key"),
        leaf(*(F.col(name) for name in fields)).alias("digest"),
        (F.lit(None) if other is None else other).cast("string").alias("other"),
    )
    placed = ordered(rows, ["group"], ["key", "digest"])
    named = stored(
        ordered(placed.select("group").distinct(), [], ["group"]).select(
            F.struct("group").alias("_group"),
            F.col("place").alias("tree"),
            F.col("total").alias("trees"),
        )
    )
    most = placed.agg(F.max("total")).first()[0] or 1
    columns = [name.split()[0] for name in NODES.split(", ")]
    leaves = (
        placed.withColumn("_group", F.struct("group"))
        .join(named, "_group")
        .withColumn("nodes", F.col("total"))
        .select(*columns)
    )
    rising = bands(leaves, most, band)
    trees = named.agg(F.max("trees")).first()[0] or 1
    subroots = rising[-1].select(
        F.lit(0).cast("long").alias("tree"),
        F.lit(trees).cast("long").alias("nodes"),
        F.col("tree").alias("place"),
        "digest",
        "key",
        "other",
    )
    above = bands(subroots, trees, band)
    top = above[-1].first()
    root = None if top is None else top["digest"]
    start = above[-1].select(
        "tree",
        F.col("place").alias("subtree"),
        F.col("digest").alias("subroot"),
        F.array().cast("array<string>").alias("proof"),
    )
    to_root = _downward(above, start, band).select(
        F.col("place").alias("tree"),
        F.lit(0).cast("long").alias("subtree"),
        F.col("digest").alias("subroot"),
        "proof",
    )
    return _downward(rising, to_root, band).select(
        "key",
        F.col("digest").alias("leaf"),
        "subroot",
        F.lit(root).cast("string").alias("root"),
        "proof",
        "other",
    )


def op13_time_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's digests and proof, and whether it still leads to the root.

    Every seventh document, by the crc32 of its id, is checked with one more character in n_chars.
    """
    docs = documents(spark, sf_dir)
    fields = {name: F.col(name) for name in FIELDS}
    changed = leaf(*(fields | {"n_chars": F.col("n_chars") + 1}).values())
    rows = manifest(docs, other=F.when(remainder("doc_id", TAMPERED) == 0, changed))
    back = rows.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("proof")))
    return back.select(
        F.col("key").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


#: The same in SQL: levels by recursion, the crc32 of the decimal doc_id bit by bit.
SQL = """
with recursive leaves as (
  select doc_id, lang, row_number() over (partition by lang order by doc_id nulls first) - 1 as place,
         count(*) over (partition by lang) as n,
         coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-')
           || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') as head,
         coalesce(strlen(text) || ':' || text, '-') as tail, n_chars,
         list_reduce(
           list_concat([4294967295::bigint], flatten(list_transform(
             string_split(coalesce(doc_id::varchar, ''), ''),
             lambda d: case when d = '' then []::bigint[]
                       else [ascii(d)::bigint, -1, -1, -1, -1, -1, -1, -1, -1] end))),
           lambda c, b: case when b >= 0 then xor(c, b)
                          when c % 2 = 1 then xor(c // 2, 3988292384)
                          else c // 2 end) as state
  from documents),
hashed as (
  select doc_id, lang, place, n,
         sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
         sha256(head || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || tail) as changed,
         xor(state, 4294967295) % 7 = 0 as tampered
  from leaves),
up as (
  select lang, place, n, leaf as digest, 0 as level from hashed
  union all
  (select lang, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' order by place)), level + 1
   from up where n > 1 group by lang, place // 2, level)),
subroots as (
  select lang, digest, row_number() over (order by lang nulls first) - 1 as place, count(*) over () as n
  from up where n = 1),
above as (
  select place, n, digest, 0 as level from subroots
  union all
  (select place // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' order by place)), level + 1
   from above where n > 1 group by place // 2, level)),
walk as (
  select h.lang, h.place as leaf_place, h.place, 0 as level, 0 as stage, '' as proof,
         case when tampered then changed else leaf end as own, h.n
  from hashed h
  union all
  (select w.lang, w.leaf_place,
          case when w.n > 1 then w.place // 2 else s.place end,
          case when w.n > 1 then w.level + 1 else 0 end,
          case when w.n > 1 then w.stage else 1 end,
          case when w.n > 1 then w.proof || coalesce(l.digest, '') || coalesce(r.digest, '') else w.proof end,
          case when w.n > 1 then sha256(coalesce(l.digest, '') || w.own || coalesce(r.digest, '')) else w.own end,
          case when w.n > 1 then (w.n + 1) // 2 else s.n end
   from walk w
   left join subroots s on w.stage = 0 and w.n = 1 and s.lang is not distinct from w.lang
   left join (select 0 as stage, lang, place, level, digest from up
              union all select 1, null, place, level, digest from above) l
     on w.n > 1 and l.stage = w.stage and l.level = w.level and w.place % 2 = 1 and l.place = w.place - 1
        and (w.stage = 1 or l.lang is not distinct from w.lang)
   left join (select 0 as stage, lang, place, level, digest from up
              union all select 1, null, place, level, digest from above) r
     on w.n > 1 and r.stage = w.stage and r.level = w.level and w.place % 2 = 0 and r.place = w.place + 1
        and (w.stage = 1 or r.lang is not distinct from w.lang)
   where w.n > 1 or w.stage = 0)),
top as (select digest as root from above where n = 1)
select h.doc_id, h.leaf, s.digest as subroot, root, sha256(w.proof) as proof_sha256, w.own as folded_root,
       w.own = root as verified
from hashed h
join walk w on w.stage = 1 and w.n = 1 and w.leaf_place = h.place and w.lang is not distinct from h.lang
join subroots s on s.lang is not distinct from h.lang
cross join top
"""
