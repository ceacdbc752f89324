"""A toxicity classifier whose score must not hinge on the group a sentence mentions.

Logistic regression on the presence of hashed words, their beginnings and their ends. While it
learns, identity terms in labelled texts are swapped for others (or one is put in where none
is), and a change of the score is penalised, so that neutral mentions of a group do not count
against a text. Weights are learned by follow-the-regularised-leader steps, which keep those of
uninformative features at zero, however long a text is.

Learning uses a bounded sample of labelled documents, chosen by a hash of the document id; all
documents are scored, whole. Null texts count as empty. Without labels of both kinds all scores
are the share of toxic labels.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm.common import documents, remainder

#: Bound of the labelled sample that is fitted.
SAMPLE = 8_000
#: Hash places of the features.
PLACES = 1 << 18
ROUNDS = 4
SEED = 5
#: Steps: rate, and penalties on absolute and squared weights.
ALPHA, L1, L2 = 0.1, 1.0, 1.0
#: Weight of the penalty on score changes, and the share of texts that it looks at.
COUNTERFACTUAL, SWAPPED = 1.0, 0.5
THRESHOLD = 0.3
HELD_OUT, REMAINDER = 4, 2
#: Words kept by a Python worker; beyond it the cache starts anew.
CACHE = 200_000

#: Terms for groups of people that may be swapped for each other.
IDENTITY_TERMS = (
    "women men girls boys muslims christians jews hindus buddhists atheists blacks whites asians "
    "latinos africans europeans arabs gays lesbians straights transgender immigrants refugees "
    "disabled elderly frauen männer muslime christen juden ausländer flüchtlinge femmes hommes "
    "musulmans chrétiens juifs étrangers mujeres hombres musulmanes cristianos judíos extranjeros"
).split()

_WORD = re.compile(r"[^\W\d_]+")
_known: dict[str, tuple[int, ...]] = {}


def word_features(word: str) -> tuple[int, ...]:
    """Places of a lower-case word, its first three to six and last three and four letters."""
    own = ["w" + word]
    own += [f"p{word[:k]}" for k in (3, 4, 5, 6) if len(word) >= k]
    own += [f"s{word[-k:]}" for k in (3, 4) if len(word) >= k]
    return tuple(zlib.crc32(x.encode()) % PLACES for x in own)


def features(text: str | None) -> np.ndarray:
    """The distinct places of all words of a text, in order."""
    if len(_known) > CACHE:
        _known.clear()
    places: set[int] = set()
    for word in set(_WORD.findall((text or "").lower())):
        own = _known.get(word)
        if own is None:
            own = _known[word] = word_features(word)
        places.update(own)
    out = np.fromiter(places, np.int32, len(places))
    out.sort()
    return out


def _sampled(labels: DataFrame, most: int, held_out: int, rest: int) -> DataFrame:
    """doc_id and label of at most about `most` documents, by a hash of their ids."""
    own = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(remainder("doc_id", held_out) != rest)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    share = min(1.0, most / max(1, own.count()))
    return own.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) < share * (1 << 30))


def labelled_features(docs: DataFrame, sample: DataFrame) -> list[tuple[int, int, np.ndarray]]:
    """(doc_id, label, places) of the sampled documents, in order of doc_id.

    The sample holds two numbers for each of at most `SAMPLE` documents, so it is broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(text).tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(got, pa.binary())],
                names=["doc_id", "toxic", "places"],
            )

    one = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.max("text").alias("text"))
        .select("doc_id", F.col("toxic").cast("int"), "text")
    )
    rows = one.mapInArrow(run, "doc_id long, toxic int, places binary").collect()
    return sorted((r[0], r[1], np.frombuffer(r[2], np.int32)) for r in rows)


def fit(rows: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Weights of all places; the last is the constant."""
    random = np.random.Generator(np.random.PCG64(SEED))
    z, n, w = (np.zeros(PLACES + 1) for _ in range(3))
    if not rows:
        return w
    share = sum(y for _, y, _ in rows) / len(rows)
    if share in (0, 1):
        w[-1] = math.log((share + 1e-3) / (1 - share + 1e-3))
        return w
    terms = [np.array(sorted(set(word_features(t))), np.int32) for t in IDENTITY_TERMS]

    present = np.zeros(PLACES + 1, bool)

    def step(at: np.ndarray, g: np.ndarray | float) -> None:
        own = np.broadcast_to(np.asarray(g, float), at.shape)
        root = np.sqrt(n[at])
        n[at] += own * own
        z[at] += own - (np.sqrt(n[at]) - root) / ALPHA * w[at]
        w[at] = np.where(
            np.abs(z[at]) <= L1,
            0.0,
            -(z[at] - np.sign(z[at]) * L1) / ((1.0 + np.sqrt(n[at])) / ALPHA + L2),
        )

    def constant(g: float) -> None:  # without penalty
        root = math.sqrt(n[-1])
        n[-1] += g * g
        z[-1] += g - (math.sqrt(n[-1]) - root) / ALPHA * w[-1]
        w[-1] = -z[-1] / ((1.0 + math.sqrt(n[-1])) / ALPHA)

    for _ in range(ROUNDS):
        for k in random.permutation(len(rows)):
            _, y, places = rows[k]
            p = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, w[places].sum() + w[-1]))))
            step(places, p - y)
            constant(p - y)
            if random.random() < SWAPPED:
                present[places] = True
                there = [t for t in terms if present[t].all()]
                present[places] = False
                new = terms[random.integers(len(terms))]
                old = there[random.integers(len(there))] if there else new[:0]
                gone, come = np.setdiff1d(old, new), np.setdiff1d(new, places)
                gone = np.intersect1d(gone, places)
                change = w[come].sum() - w[gone].sum()
                if change:
                    step(come, 2 * COUNTERFACTUAL * change)
                    step(gone, -2 * COUNTERFACTUAL * change)
    return w


def scored(
    docs: DataFrame,
    weights: np.ndarray,
    kept: tuple[str, ...] = ("doc_id",),
    score: str = "score",
) -> DataFrame:
    """Columns `kept` of all documents with a score between 0 and 1."""
    fields = docs.select(*kept).schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    used = np.flatnonzero(weights)
    values = weights[used]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(PLACES + 1)
        w[used] = values
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            sums = np.array([w[features(t)].sum() + w[-1] for t in texts], float)
            scores = 1.0 / (1.0 + np.exp(-np.clip(sums, -30.0, 30.0)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(scores, pa.float64())],
                names=[*kept, score],
            )

    source = docs.select(*kept, F.col("text").cast("string").alias("_text"))
    return source.mapInArrow(run, f"{schema}, `{score}` double")


def trained(
    docs: DataFrame, labels: DataFrame, held_out: int = HELD_OUT, rest: int = REMAINDER
) -> np.ndarray:
    """Weights learned from labels whose crc32 modulo `held_out` is not `rest`."""
    return fit(labelled_features(docs, _sampled(labels, SAMPLE, held_out, rest)))


def op5_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    weights = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, weights).select(
        "doc_id",
        (remainder("doc_id", HELD_OUT) == REMAINDER).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
