"""Exact join of near-equal texts in the metric space of Jaccard distance.

A document is its set of distinct word shingles; two documents link if their Jaccard similarity
reaches the threshold, that is, if their distance 1 - J is at most e. J's distance is a metric,
so regions around pivots can be joined one by one without losing a link:

1. Equal sets form classes; only one member of each goes on.
2. The first pivots are single shingles, in one order of all shingles: a set's nearest pivot is
   its first shingle. A set within e of another can lack only so many of its shingles, so each
   set is replicated to the regions of its first n - ceil(t n) + 1 shingles, its boundary
   window; every link then has a region that holds both its ends. The order is by hash, with
   the shingles of many documents last, so that shared passages make no crowded regions.
3. A crowded region gets pivots that are documents: those with the most, and most crowded,
   regions, which lie near the middle of a group of near copies. Members within e of a pivot
   are linked, and what is connected by then needs no test within itself.
4. Regions that still hold many pairs of several components are cut into the Voronoi cells of further pivots:
   all distances to these are computed exactly, a member goes to the cell of its nearest pivot,
   and as a boundary copy to those of pivots further by at most 2e. Cells with several
   components are cut again. At last their members are paired across components, unless the
   triangle inequality shows them apart: |d(x, p) - d(y, p)| > e.
5. Links are verified on the whole sets, and components are found by alternating star steps.

Pairs are dropped where their sizes, their places in the order, or a filter on their regions
rule the threshold out, so that whole sets are compared for near pairs almost alone. All of this
is exact; the list of frequent shingles is bounded and changes the order of pivots only. Pairs
come from joins of Spark. Only where the regions of one class are dropped do a region's rows
pass through one task, as a stream of which at most HELD and a batch are in memory.

Null and empty texts have empty sets and link with nothing. Texts of fewer words than a shingle
have their whole sequence as one shingle. Repeated rows are members of one class. Documents
without an id link nothing and have no component. An empty table gives no rows. Of other columns
none is read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm.common import documents, stored

WORDS = 4
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Bound of the list of frequent shingles, and the least count in a task to be on it.
FREQUENT, LEAST = 200_000, 4
#: Regions up to this size are paired at once; larger ones get so many pivots at each level.
SMALL, PIVOTS = 8, 4
#: Regions that still hold several components are cut into cells until they have no more pairs
#: left than this number's square, at most so many times.
LEAF, DEPTH = 256, 2
#: Regions ahead of a crowded one that tell whether a pair met before.
BEFORE = 4
#: Room for rounding where distances are compared.
SLACK = 1e-9
#: Rows of a region that are held while it is read.
HELD = 4096
#: Bits of the filter on documents that take part in a candidate pair.
FILTER_BITS = 1 << 24
#: Shingles gathered before they are counted; classes a task remembers as seen.
FLUSH, SEEN = 4_000_000, 500_000

_MIX = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
     0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5],
    np.uint64,
)


def shingle_set(text: str | None, size: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, A-Z taken as small."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - size + 1
    out = h[:n] * _MIX[0]
    for k in range(1, size):
        out += h[k : k + n] * _MIX[k]
    out ^= out >> np.uint64(29)
    return np.unique(out * _MIX[-1])


def digest(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def _arrow(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    parts = [p.split() for p in schema.split(", ")]
    arrays = [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, parts, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in parts])


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    width = len(schema.split(", "))
    return _arrow(list(zip(*rows, strict=True)) or [[]] * width, schema)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            columns = batch.slice(at, 512).columns
            yield from zip(*(c.to_pylist() for c in columns), strict=True)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def members(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """Rows of documents (doc_id, text_key, class, n) and of shingles frequent in a task
    (shingle, df). `text_key` is Spark's xxhash64 of the text."""
    schema = "doc_id long, text_key long, class binary, n long, shingle long, df long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, seen, sets, held = [], set(), [], 0

        def frequent() -> pa.RecordBatch:
            values, df = np.unique(np.concatenate(sets), return_counts=True)
            keep = df >= LEAST
            none = [None] * int(keep.sum())
            values = values[keep].view(np.int64)
            return _arrow([none, none, none, none, values, df[keep]], schema)

        for key, text, text_key in _texts(batches):
            own = shingle_set(text, size)
            name = digest(own) if len(own) and key is not None else None
            rows.append((key, text_key, name, len(own), None, None))
            if name is not None and name not in seen:
                seen.add(name)
                sets.append(own)
                held += len(own)
            if len(rows) >= 10_000:
                yield _rows(rows, schema)
                rows = []
            if held > FLUSH:
                yield frequent()
                sets, held = [], 0
            if len(seen) > SEEN:
                seen.clear()
        yield _rows(rows, schema)
        if sets:
            yield frequent()

    source = _source(docs).withColumn("text_key", F.xxhash64("text"))
    return source.mapInArrow(run, schema)


def frequent_shingles(counts: DataFrame, most: int = FREQUENT) -> np.ndarray:
    """At most `most` frequent shingles, by their count; all those above some count."""
    df = counts.groupBy("shingle").agg(F.sum("df").alias("df"))
    level = F.floor(F.log2("df") * 8).cast("int")
    least, n = None, 0
    for row in sorted(df.groupBy(level.alias("level")).count().collect(), reverse=True):
        n += row[1]
        if n > most:
            break
        least = row[0]
    if least is None:
        return np.empty(0, np.uint64)
    got = df.where(level >= least).toArrow()
    values = got["shingle"].to_numpy().view(np.uint64)
    return values[np.lexsort((values, got["df"].to_numpy()))]


def regions(
    docs: DataFrame, frequent: np.ndarray, size: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """(region, class, n, place): each class in the regions of its first shingles."""
    schema = "region long, class binary, n int, place int"
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_count = shared.value
        order = np.argsort(by_count, kind="stable")
        values = by_count[order]
        seen: set[bytes] = set()
        held: list[tuple[np.ndarray, bytes, int]] = []
        size_held = 0

        def out() -> pa.RecordBatch:
            lengths = [len(x) for x, _, _ in held]
            names = pa.array([name for _, name, _ in held], pa.binary())
            at = np.repeat(np.arange(len(held)), lengths)
            places = np.concatenate([np.arange(k) for k in lengths])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([x for x, _, _ in held]).view(np.int64)),
                    names.take(pa.array(at)),
                    pa.array(np.repeat([n for _, _, n in held], lengths), pa.int32()),
                    pa.array(places, pa.int32()),
                ],
                names=["region", "class", "n", "place"],
            )

        for key, text in _texts(batches):
            own = shingle_set(text, size)
            if not len(own) or key is None:
                continue
            name = digest(own)
            if name in seen:
                continue
            if len(seen) > SEEN:
                seen.clear()
            seen.add(name)
            n = len(own)
            window = n - (percent * n + 99) // 100 + 1
            if len(values):
                at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                often = values[at] == own
                if often.any():
                    rare = own[~often]
                    if len(rare) < window:
                        common = by_count[np.sort(order[at[often]])]
                        rare = np.concatenate([rare, common])
                    own = rare
            held.append((own[:window], name, n))
            size_held += window
            if size_held > 100_000:
                yield out()
                held, size_held = [], 0
        if held:
            yield out()

    return _source(docs).mapInArrow(run, schema)


def shared_regions(df: DataFrame) -> DataFrame:
    """The rows of regions with two classes or more, each class once, with the region's size.

    Rows stream past in the order of regions and classes; no more than HELD of a region are held,
    so that the size of a larger one may be stated too small, yet never below HELD.
    """
    schema = "region long, class binary, n int, place int, size int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows of the last region, how many of it went out before, and if its first row did.
        held, before, skip = None, 0, 0

        def out(part: pa.Table, size: np.ndarray, start: int, end: int) -> list[pa.RecordBatch]:
            at = start + np.flatnonzero(size[start:end] > 1)
            rows = part.take(pa.array(at))
            rows = rows.append_column("size", pa.array(size[at], pa.int32()))
            return rows.combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            if held is not None:
                part = pa.concat_tables([held, part]).combine_chunks()
            region = part["region"].to_numpy()
            own = part["class"].to_numpy()
            new = np.append(True, (region[1:] != region[:-1]) | (own[1:] != own[:-1]))
            part = part.filter(pa.array(new)).combine_chunks()
            region = region[new]
            starts = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
            count = np.diff(np.append(starts, len(region)))
            count[0] += before
            size = np.repeat(count, np.diff(np.append(starts, len(region))))
            last = int(starts[-1])
            if len(region) - last > HELD:
                yield from out(part, size, skip, len(region))
                held, before, skip = part.slice(len(region) - 1), int(count[-1]) - 1, 1
            else:
                yield from out(part, size, skip, last)
                held = part.slice(last)
                if last:
                    before, skip = 0, 0
        if held is not None:
            size = np.full(held.num_rows, held.num_rows + before)
            yield from out(held, size, skip, held.num_rows)

    return df.repartition("region").sortWithinPartitions("region", "class").mapInArrow(run, schema)


def profiles(rows: DataFrame) -> DataFrame:
    """(class, n, m, score, s0 .. s3, regions): a class's size, its number of regions, how crowded
    they are, a filter of 256 bits on them, and its crowded regions in their order.

    These are structs (region, place, before); `before` are the BEFORE crowded ones ahead.
    """
    bit = F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.shiftright("region", 2).bitwiseAND(F.lit(63)).cast("int")
    )
    word = F.col("region").bitwiseAND(F.lit(3))
    filters = [F.bit_or(F.when(word == k, bit).otherwise(F.lit(0))).alias(f"s{k}") for k in range(4)]
    score = F.sum(F.floor(F.log2("size") * 8)).alias("score")
    sizes = F.max("n").alias("n"), F.count("*").alias("m")
    crowded = F.collect_list(F.when(F.col("size") > SMALL, F.struct("place", "region")))
    found = rows.groupBy("class").agg(*sizes, score, *filters, F.sort_array(crowded).alias("_all"))
    known = [c for c in found.columns if c != "_all"]
    names = F.col("_all.region")

    def placed(one: Column, k: Column) -> Column:
        start = F.greatest(k - (BEFORE - 1), F.lit(1))
        before = F.slice(names, start, F.least(k, F.lit(BEFORE)))
        return F.struct(one["region"].alias("region"), one["place"].alias("place"), before.alias("before"))

    return found.select(*known, F.transform("_all", placed).alias("regions"))


#: What `_near` reads of a profile.
PROFILE = ("n", "m", "s0", "s1", "s2", "s3")


def _near(a: str, b: str, percent: int) -> Column:
    """Whether two classes may link, by their sizes and the filters on their regions.

    Take the one whose window ends first in the order of shingles. What both have up to there
    is in both windows, and beyond it that set has n less its window's size left. A bit that one
    filter has and the other lacks stands for a region or more that they do not share.
    """
    n = [F.col(f"{x}.n") for x in (a, b)]

    def shared(x: str, y: str) -> Column:
        lacking = [
            F.bit_count(F.col(f"{x}.s{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}.s{k}"))))
            for k in range(4)
        ]
        return F.col(f"{x}.m") - sum(lacking[1:], lacking[0])

    rest = F.ceil(percent * F.greatest(*n) / 100) - 1
    most = F.least(shared(a, b), shared(b, a)) + rest
    sizes = 100 * F.least(*n) >= percent * F.greatest(*n)
    return sizes & ((100 + percent) * most >= percent * (n[0] + n[1]))


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def small_pairs(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of each region that sizes and places leave room for."""
    a, b = rows.alias("x"), rows.alias("y")
    n, m, p, q = (F.col(c) for c in ("x.n", "y.n", "x.place", "y.place"))
    most = F.least(p, q) + F.least(n - p, m - q)
    room = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (
        (100 + percent) * most >= percent * (n + m)
    )
    on = (F.col("x.region") == F.col("y.region")) & (F.col("x.class") < F.col("y.class")) & room
    return a.join(b, on).select(*_ordered(F.col("x.class"), F.col("y.class")))


def pivots_of(rows: DataFrame, by: str) -> DataFrame:
    """(region, pivot) and the pivot's profile: up to PIVOTS members of each region that have the
    most crowded regions.

    A document that many others are like lies in their regions, so it is near the middle of
    them. The members are dealt by a hash of `by`; a region's pivots differ in it.
    """
    best = rows.groupBy("region", F.pmod(F.xxhash64(by), F.lit(PIVOTS)).alias("_deal")).agg(
        F.max(F.struct("score", "class", *PROFILE)).alias("_best")
    )
    return best.select("region", F.col("_best.class").alias("pivot"), *(f"_best.{c}" for c in PROFILE))


def cells(rows: DataFrame, pivots: DataFrame, tested: DataFrame, far: str, percent: int) -> DataFrame:
    """`rows`, each in the Voronoi cell of its nearest pivot (`core`) and, as a boundary copy, in
    those of pivots further by at most 2e; `far` is its distance to the cell's pivot, and `whole`
    the region that was cut.

    If x and y are within e and p is the nearest pivot of x, p is no further from y than y's
    nearest by more than 2e, so both are in the cell of p, and their distances to p differ by
    at most e. All distances are in `tested`.
    """
    window = 2 * (100 - percent) / 100 + SLACK
    distance = (1 - F.col("inter") / F.col("either")).alias("_d")
    known = tested.select("a", "b", distance)
    dealt = rows.join(pivots.select("region", "pivot"), "region")
    dealt = dealt.withColumn("a", F.least("class", "pivot")).withColumn("b", F.greatest("class", "pivot"))
    dealt = dealt.join(known, ["a", "b"], "left").drop("a", "b")
    dealt = dealt.withColumn("_d", F.when(F.col("class") == F.col("pivot"), 0.0).otherwise(F.col("_d")))
    nearest = dealt.groupBy("region", "class").agg(F.min("_d").alias("_least"))
    dealt = dealt.join(nearest, ["region", "class"]).where(F.col("_d") <= F.col("_least") + window)
    kept = [c for c in rows.columns if c not in ("region", "core")]
    return dealt.select(
        F.col("region").alias("whole"),
        F.concat_ws("/", F.col("region").cast("string"), F.hex("pivot")).alias("region"),
        *kept,
        (F.col("_d") == F.col("_least")).alias("core"),
        F.col("_d").alias(far),
    )


def eased(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """(region) of those whose cells hold fewer pairs than they do as a whole.

    Where all members are within 2e of all pivots, each cell would have them all.
    """
    members = cut.groupBy("whole", "region").agg(F.count("*").alias("_n")).groupBy("whole")
    after = members.agg(F.sum(F.col("_n") * F.col("_n")).alias("_after"))
    before = rows.groupBy("region").agg(F.count("*").alias("_n"))
    same = F.col("region") == F.col("whole")
    return before.join(after, same & (F.col("_after") < F.col("_n") * F.col("_n"))).select("region")


def mixed(rows: DataFrame) -> DataFrame:
    """(region, top, work) of regions with two labels or more: the label that most members have,
    and a bound of the pairs that are left: other members times all."""
    labels = rows.groupBy("region", "label").agg(F.count("*").alias("_n"))
    regions = labels.groupBy("region").agg(
        F.max(F.struct("_n", "label")).alias("_top"),
        F.sum("_n").alias("_size"),
        F.count("*").alias("_labels"),
    )
    work = ((F.col("_size") - F.col("_top._n")) * F.col("_size")).alias("work")
    return regions.where("_labels > 1").select("region", F.col("_top.label").alias("top"), work)


def rest_pairs(
    rows: DataFrame, regions: DataFrame, fars: list[str], percent: int = PERCENT
) -> DataFrame:
    """The pairs (a, b) that `regions` still hold across labels, unless they are shown apart.

    The members of a region's most frequent label are compared with the others alone. Regions
    are joined by Spark, which splits a hot one over tasks.

    A region, or the cells of it, has a pair only where it can meet first: what either has ahead
    of that place the other lacks, and no crowded region just ahead is shared. A link is found in
    the first crowded region that both its ends are in, unless they have one label by then.
    """
    window = (100 - percent) / 100 + SLACK
    tops = regions.select(F.col("region").alias("_r"), "top")
    others = (F.col("region") == F.col("_r")) & (F.col("label") != F.col("top"))
    few = rows.join(tops, others).drop("_r").alias("x")
    on = (F.col("x.region") == F.col("y.region")) & (F.col("x.label") != F.col("y.label"))
    on &= (F.col("y.label") == F.col("x.top")) | (F.col("x.class") < F.col("y.class"))
    for far in fars:
        on &= F.abs(F.col(f"x.{far}") - F.col(f"y.{far}")) <= window
    if fars:
        on &= F.col("x.core") | F.col("y.core")
    n, m = F.col("x.n"), F.col("y.n")
    most = F.least(n - F.col("x.place"), m - F.col("y.place"))
    on &= (100 + percent) * most >= percent * (n + m)
    on &= ~F.arrays_overlap("x.before", "y.before")
    found = few.join(rows.alias("y"), on & _near("x", "y", percent))
    return found.select(*_ordered(F.col("x.class"), F.col("y.class"))).distinct()


def picked(key: str, text_key: Column) -> Column:
    """`pick`: a number that tells a document from most others, by its id and text."""
    return F.xxhash64(key, text_key).alias("pick")


def class_sets(docs: DataFrame, classes: DataFrame, size: int = WORDS) -> DataFrame:
    """(class, members) of the given classes: the whole sets as bytes, one row for each class.

    `classes` has each class once, with the `pick` of one of its documents (see `picked`). A
    filter of fixed size on these keeps most other texts from being read; the join is exact.
    """
    place = F.pmod("pick", F.lit(FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 32).cast("int"))
    words = (
        classes.select(place.alias("at"))
        .groupBy(F.floor(F.col("at") / 32).cast("int").alias("word"))
        .agg(F.bit_or(bit).alias("m"))
        .toArrow()
    )
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[words["word"].to_numpy()] = words["m"].to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    schema = "class binary, members binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, rows, held = shared.value, set(), [], 0
        def wanted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(0).to_numpy() % FILTER_BITS
                keep = (table[at // 32] >> (at % 32).astype(np.uint32)) & np.uint32(1)
                if keep.any():
                    yield batch.filter(pa.array(keep.astype(bool)))

        for _, text in _texts(wanted()):
            own = shingle_set(text, size)
            if not len(own):
                continue
            name = digest(own)
            if name in seen:
                continue
            if len(seen) > SEEN:
                seen.clear()
            seen.add(name)
            rows.append((name, own.tobytes()))
            held += len(own)
            if held > 500_000:
                yield _rows(rows, schema)
                rows, held = [], 0
        yield _rows(rows, schema)

    texts = _source(docs).select(picked("doc_id", F.xxhash64("text")), "text")
    sets = texts.mapInArrow(run, schema).join(classes, "class", "left_semi")
    return sets.groupBy("class").agg(F.first("members").alias("members"))


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, inter, either): the exact sizes of intersection and union."""
    a = sets.select(F.col("class").alias("a"), F.col("members").alias("_a"))
    b = sets.select(F.col("class").alias("b"), F.col("members").alias("_b"))
    schema = "a binary, b binary, inter int, either int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inter, either = [], []
            own = (batch.column(k).to_pylist() for k in (2, 3))
            for x, y in zip(*own, strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                inter.append(int((q[at] == p).sum()))
                either.append(len(p) + len(q) - inter[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(inter, pa.int32()),
                 pa.array(either, pa.int32())],
                names=["a", "b", "inter", "either"],
            )

    return pairs.join(a, "a").join(b, "b").select("a", "b", "_a", "_b").mapInArrow(run, schema)


def components(links: DataFrame) -> DataFrame:
    """(class, label) of all ends of links (a, b): the smallest end each is connected with.

    Alternating large-star and small-star steps; each is a minimum and a join.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v")
        .distinct()
    )

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = (
            both.join(least, F.col("u") == F.col("w"))
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = stored(large)
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(least, F.col("u") == F.col("w"))
        edges = stored(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("class"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("class"), F.col("v").alias("label")).union(roots)


def linked(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles and component_id of every row of `docs`."""
    first = stored(members(docs, size))
    own = first.where(F.col("n").isNotNull()).select("doc_id", "text_key", "class", "n")
    frequent = frequent_shingles(first.where(F.col("shingle").isNotNull()).select("shingle", "df"))
    rows = stored(shared_regions(regions(docs, frequent, size, percent)))
    known = stored(profiles(rows))
    profile = [c for c in known.columns if c != "regions"]
    inside = known.where(F.size("regions") > 0)
    crowded = inside.select(*profile, F.inline("regions"))
    # Each class's least document, and one of its texts by which its set is found again.
    classes = own.where(F.col("class").isNotNull()).groupBy("class")
    classes = classes.agg(F.min(F.struct("doc_id", "text_key")).alias("_r")).select(
        "class", F.col("_r.doc_id").alias("rep"), picked("_r.doc_id", F.col("_r.text_key"))
    )
    classes = stored(classes)
    tested = labels = None

    def named(found: DataFrame) -> DataFrame:
        """`found`, a row for each class, with its label."""
        label = labels.select(F.col("class").alias("_k"), F.col("label").alias("_l"))
        joined = found.join(label, F.col("class") == F.col("_k"), "left")
        return joined.withColumn("label", F.coalesce("_l", "class")).drop("_k", "_l")

    def renamed(found: DataFrame) -> DataFrame:
        """`found`, any number of rows for each class, with their labels."""
        rest = [c for c in found.columns if c not in ("class", "label")]
        held = found.groupBy("class").agg(F.collect_list(F.struct(*rest)).alias("_rows"))
        return named(held).select("class", "label", F.inline("_rows"))

    def sets_of(names: DataFrame) -> DataFrame:
        picks = classes.select("class", "pick").join(names.distinct(), "class", "left_semi")
        return class_sets(docs, stored(picks), size)

    def test(pairs: DataFrame, sets: DataFrame | None = None) -> None:
        """Measure new pairs; where some link, so do their labels."""
        nonlocal tested, labels
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        if sets is None:
            pairs = stored(pairs)
            if tested is not None and pairs.isEmpty():
                return
            sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("class")))
        new = stored(measured(pairs, sets))
        links = 100 * F.col("inter") >= percent * F.col("either")
        linked = tested is None or not new.where(links).isEmpty()
        tested = new if tested is None else tested.union(new)
        if linked:
            labels = stored(components(tested.where(links).select("a", "b")))

    def with_pivots(found: DataFrame, pivots: DataFrame, on: Column) -> DataFrame:
        on &= (F.col("x.region") == F.col("y.region")) & (F.col("class") != F.col("pivot"))
        pairs = found.alias("x").join(pivots.alias("y"), on)
        return pairs.select(*_ordered(F.col("class"), F.col("pivot"))).distinct()

    # Small regions whole, and the members of crowded ones with the pivots.
    near = _near("x", "y", percent)
    pairs = small_pairs(rows.where(F.col("size") <= SMALL), percent).distinct()
    x, y = known.alias("x"), known.alias("y")
    pairs = pairs.join(x, F.col("a") == F.col("x.class")).join(y, F.col("b") == F.col("y.class"))
    pairs = pairs.where(near).select("a", "b")
    test(pairs.union(with_pivots(crowded, pivots_of(crowded, "class"), near)).distinct())

    # Crowded regions with several components are cut into the cells of document pivots, and
    # these again, until they are leaves; the members of these are paired.
    fars: list[str] = []
    left = named(inside).select(*profile, "label", F.lit(True).alias("core"), F.inline("regions"))
    left = stored(left)
    open_ = stored(mixed(left))
    small = F.col("work") <= LEAF * LEAF
    pairs = rest_pairs(left, open_.where(small), fars, percent)
    sets = None
    while len(fars) < DEPTH and not (large := open_.where(~small)).isEmpty():
        left = stored(left.join(large.select("region"), "region", "left_semi"))
        sets = sets or stored(sets_of(left.select("class")))
        pivots = stored(pivots_of(left, "label"))
        test(with_pivots(left, pivots, F.lit(True)), sets)
        cut = stored(cells(left, pivots, tested, f"far{len(fars)}", percent))
        parts = stored(eased(left, cut))
        whole = stored(renamed(left.join(parts, "region", "left_anti")))
        pairs = pairs.union(rest_pairs(whole, mixed(whole), fars, percent))
        parts = parts.withColumnRenamed("region", "whole")
        fars.append(f"far{len(fars)}")
        left = stored(renamed(cut.join(parts, "whole", "left_semi").drop("whole")))
        open_ = stored(mixed(left))
        leaves = open_ if len(fars) == DEPTH else open_.where(small)
        pairs = pairs.union(rest_pairs(left, leaves, fars, percent))
    test(pairs.distinct())

    ends = labels.join(classes, "class")
    least = ends.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = labels.join(least, "label").select(F.col("class").alias("_c"), "component_id")
    table = stored(
        classes.select("class", "rep").join(named, F.col("class") == F.col("_c"), "left").select(
            F.col("class").alias("_c"), F.coalesce("component_id", "rep").alias("component_id")
        )
    )
    full = own.where(F.col("class").isNotNull()).join(table, F.col("class") == F.col("_c"))
    alone = own.where(F.col("class").isNull()).withColumn("component_id", F.col("doc_id"))
    columns = ("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return full.select(*columns).union(alone.select(*columns))


def one_of_each(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One row of each component of `docs`: of those with its least doc_id, one by text hash.

    Rows without an id or without words link with nothing and stay.
    """
    found = linked(docs, size, percent).where("component_id is not null and n_shingles > 0")
    least = (
        found.groupBy("component_id")
        .agg(F.min(F.struct("doc_id", "text_key")).alias("_k"))
        .select(F.col("_k.doc_id").alias("_d"), F.col("_k.text_key").alias("_t"))
    )
    row = docs.select(F.struct("*").alias("_row"))
    key, text = F.col("_row.doc_id").cast("long"), F.col("_row.text").cast("string")
    links = F.coalesce(key.isNotNull() & text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # Copies are merged within the tasks before they are shuffled.
    texts = (
        row.where(links)
        .groupBy(key.alias("_d"), F.xxhash64(F.col("_row.text")).alias("_t"))
        .agg(F.first("_row").alias("_row"))
    )
    one = texts.join(stored(least), ["_d", "_t"], "left_semi").select("_row.*")
    return one.union(row.where(~links).select("_row.*"))


def op10_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
