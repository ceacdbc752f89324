"""Document fingerprints from closed syncmers of words.

A k-mer (k words) is an anchor if the least of its s-mers' hashes (s words) is at one of its
edges. Whether it is one depends on its own words only, so an edit disturbs the anchors that
overlap it and no others, and equal passages have equal anchors wherever they stand: anchors
with their places serve positional matching, their hashes a likeness of texts.

A fingerprint lists the distinct anchor hashes in order of their first place. A text with no
anchor, as one of fewer than k words, has the hash of all its words as its only anchor; null
and empty texts have none. Everything is built from Spark's own functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerfold.llm.common import BLANKS, documents, stored

#: Words of a k-mer and of its inner s-mers.
K, S = 5, 2
#: Documents in a bucket of neighbours, and most buckets along one of two levels.
BUCKET, SIDE = 512, 256


def _split(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    none = F.array().cast("array<string>")
    return F.when(trimmed == "", none).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _range(size: Column) -> Column:
    """0 to size - 1, empty if there are none."""
    none = F.array().cast("array<int>")
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(none)


def with_anchors(df: DataFrame, text: str, into: str) -> DataFrame:
    """Add `into`: array<struct<at int, hash int>>, the anchors of a text in order of place."""
    kept = [F.col(f"`{n}`") for n in df.columns if n != into]
    # Each step is a projection of its own, so that no array is computed again for each element.
    out = df.select(*kept, _split(F.coalesce(F.col(text), F.lit(""))).alias("_w"))
    out = out.select(*kept, "_w", F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    inner = lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(S)])
    smers = F.transform(_range(F.size("_h") - (S - 1)), inner).alias("_s")
    out = out.select(*kept, "_w", "_h", smers)
    last = K - S

    def anchor(i: Column) -> Column:
        smer = [F.get("_s", i + k) for k in range(last + 1)]
        chosen = F.least(smer[0], smer[last]) <= F.least(*smer[1:last])
        parts = [F.get("_s", i), F.get("_s", i + 2), F.get("_h", i + 4)]
        return F.when(chosen, F.struct(i.alias("at"), F.hash(*parts).alias("hash")))

    found = F.array_compact(F.transform(_range(F.size("_h") - (K - 1)), anchor)).alias("_a")
    out = out.select(*kept, "_w", found)
    whole = F.array(F.struct(F.lit(0).alias("at"), F.hash("_w").alias("hash")))
    return out.select(
        *kept,
        F.when((F.size("_a") == 0) & (F.size("_w") > 0), whole).otherwise(F.col("_a")).alias(into),
    )


def hashes(anchors: str | Column) -> Column:
    """The distinct hashes of anchors, in order of their first place."""
    column = F.col(anchors) if isinstance(anchors, str) else anchors
    return F.array_distinct(F.transform(column, lambda a: a["hash"]))


def fingerprint(own: str | Column) -> Column:
    """Distinct hashes as text."""
    column = F.col(own) if isinstance(own, str) else own
    return F.array_join(column.cast("array<string>"), " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def matches(a: str, b: str) -> Column:
    """Places (at, other) of the anchors of `a` whose hash has its first place in `b`."""
    first = F.map_from_entries(
        F.transform(
            hashes(b),
            lambda h: F.struct(h, F.filter(F.col(b), lambda x: x["hash"] == h)[0]["at"]),
        )
    )
    pairs = F.transform(
        F.col(a), lambda x: F.struct(x["at"].alias("at"), first[x["hash"]].alias("other"))
    )
    return F.filter(pairs, lambda p: p["other"].isNotNull())


def _bucketed(docs: DataFrame) -> DataFrame:
    """Rows with `_key`, the sort key, in `_bucket`s of ascending keys; and a copy of each
    bucket's largest row (`_head`) in the bucket above it, the overall largest in the lowest.

    Buckets lie between quantiles, at two levels. Their number is bounded by `SIDE` squared,
    and so are the tables of edges and of heads, which are therefore broadcast.
    """
    keyed = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    n = keyed.count()
    side = max(1, min(SIDE, math.isqrt(max(0, n - 1) // BUCKET) + 1))
    shares = [k / side for k in range(1, side)]
    if not shares:
        keyed = keyed.withColumn("_bucket", F.lit(0))
    else:
        row = keyed.agg(F.percentile_approx("_key", shares, 10_000)).first()
        coarse = F.array(*[F.lit(x).cast("long") for x in row[0] or [0]])
        keyed = keyed.withColumn("_coarse", F.size(F.filter(coarse, lambda e: e <= F.col("_key"))))
        fine = keyed.groupBy("_coarse").agg(
            F.percentile_approx("_key", shares, 10_000).alias("_edges")
        )
        keyed = keyed.join(F.broadcast(stored(fine)), "_coarse").withColumn(
            "_bucket",
            F.col("_coarse") * side + F.size(F.filter("_edges", lambda e: e <= F.col("_key"))),
        )
        keyed = keyed.drop("_coarse", "_edges")
    heads = stored(keyed.groupBy("_bucket").agg(F.max("_key").alias("_top")))
    order = Window.orderBy("_bucket")
    lowest = F.min("_bucket").over(Window.orderBy(F.lit(0)))
    above = heads.select(
        F.col("_top").alias("_key"), F.coalesce(F.lead("_bucket").over(order), lowest).alias("_up")
    )
    own = F.struct(F.col("_bucket"), F.lit(False).alias("_head"))
    other = F.struct(F.col("_up").alias("_bucket"), F.lit(True).alias("_head"))
    copies = F.when(F.col("_up").isNull(), F.array(own)).otherwise(F.array(own, other))
    return (
        keyed.join(F.broadcast(stored(above)), "_key", "left")
        .withColumn("_copy", F.explode(copies))
        .select(*docs.columns, "_key", "_copy._bucket", "_copy._head")
    )


def with_edited(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars, its `anchors`, `next` (those of the next document) and `edited`.

    The next document is the one with the next smaller doc_id, after the smallest the largest;
    rows of one doc_id follow each other by a hash of their text, null ids come last. The last
    half of an edited text is the first as many characters of the next document. Texts are
    shuffled once, by bucket.
    """
    plain = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = with_anchors(_bucketed(plain).repartition("_bucket"), "text", "anchors")
    order = Window.partitionBy("_bucket").orderBy("_head", F.desc("_key"), F.xxhash64("text"))
    rows = rows.withColumn("next", F.lead("anchors").over(order)).withColumn(
        "_next", F.lead("text").over(order)
    )
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    return rows.where(~F.col("_head")).select(
        "doc_id",
        "text",
        n.cast("long").alias("n_chars"),
        "anchors",
        "next",
        F.concat(
            F.substring("text", F.lit(1), n - half), F.substring("_next", F.lit(1), half)
        ).alias("edited"),
    )


def op2_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_anchors(with_edited(documents(spark, sf_dir)), "edited", "edited_anchors")
    rows = rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        hashes("anchors").alias("_own"),
        hashes("edited_anchors").alias("_edited"),
        hashes("next").alias("_next"),
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint("_own").alias("fingerprint"),
        fingerprint("_edited").alias("edited_fingerprint"),
        likeness("_own", "_edited").alias("near_edited"),
        likeness("_own", "_next").alias("near_next"),
    )
