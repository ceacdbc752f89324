"""Quality scores by kernel ridge regression on random Fourier features.

Document statistics are standardised and sent through cosines of seeded random directions,
whose products approximate a Gaussian kernel. Every partition of labelled rows adds up its
share of the normal equations; Spark sums the shares, and the driver solves one small system.
Scores are calibrated by isotonic regression on their histogram over the labelled rows.

All labelled rows that are not held out take part. Null texts count as empty and get a score
like any other; null labels take no part. Without labels of both kinds every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm.common import documents, remainder, stored
from ledgerfold.llm.statistics import RATIOS, with_statistics

DIRECTIONS = 128
SEED = 71
RIDGE = 1e-3
#: Width of the Gaussian kernel, in standard deviations of a statistic.
WIDTH = 2.5
#: Steps of the histogram of raw scores between -1 and 2.
STEPS = 3_000
THRESHOLD = 0.3
HELD_OUT = 5


@dataclass
class Model:
    """Means and scales of the statistics, directions, weights and the calibrated levels."""

    names: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows, with a constant last."""
        z = np.clip((x - self.mean) / self.scale, -8.0, 8.0)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2.0 / len(self.phases))
        return np.hstack([waves, np.ones((len(x), 1))])

    def step(self, x: np.ndarray) -> np.ndarray:
        raw = self.features(x) @ self.weights
        return np.clip(((raw + 1.0) / 3.0 * STEPS).astype(int), 0, STEPS - 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.levels[self.step(x)]


def _matrix(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
    return np.column_stack(columns).astype(float)


def _moments(rows: DataFrame, names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    got = rows.agg(
        *[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names]
    ).first()
    mean = np.array([got[f"m_{n}"] or 0.0 for n in names])
    scale = np.array([got[f"s_{n}"] or 0.0 for n in names])
    return mean, np.where(scale > 1e-9, scale, 1.0)


def _normal_equations(rows: DataFrame, label: str, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The sums of z z' and z y over all rows; partitions send one triangle each."""
    size = DIRECTIONS + 2
    i, j = np.triu_indices(size)
    names = model.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            z = model.features(_matrix(batch, names))
            z = np.hstack([z, batch.column(label).to_numpy(zero_copy_only=False)[:, None]])
            total += z.T @ z
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(i))), pa.array(total[i, j])], names=["place", "value"]
            )

    sums = rows.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value"))
    total = np.zeros((size, size))
    for place, value in sums.collect():
        total[i[place], j[place]] = total[j[place], i[place]] = value
    return total[:-1, :-1], total[:-1, -1]


def isotonic(low: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pooled adjacent violators: the nondecreasing levels closest to means `low / weight`.

    Steps without weight take the level of the nearest one below, or else above.
    """
    blocks: list[list[float]] = []  # sum, weight, steps
    for s, w in zip(low, weight, strict=True):
        blocks.append([float(s), float(w), 1])
        while len(blocks) > 1 and (
            blocks[-1][1] == 0
            or blocks[-2][1] == 0
            or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]
        ):
            s2, w2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + w2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), s / w if w else 0.5) for s, w, n in blocks])


def fit(labelled: DataFrame, label: str, names: tuple[str, ...] = RATIOS) -> Model:
    """A model of rows that hold the statistics `names` and a `label` of 0 or 1."""
    rows = stored(
        labelled.where(F.col(label).isNotNull()).select(*names, F.col(label).cast("double"))
    )
    mean, scale = _moments(rows, names)
    random = np.random.Generator(np.random.PCG64(SEED))
    directions = random.normal(size=(len(names), DIRECTIONS)) / WIDTH
    phases = random.uniform(0, 2 * np.pi, DIRECTIONS)
    size = DIRECTIONS + 1
    model = Model(names, mean, scale, directions, phases, np.zeros(size), np.full(STEPS, 0.5))
    a, b = _normal_equations(rows, label, model)
    n = a[-1, -1]
    if not 0 < b[-1] < n:
        return model
    model.weights = np.linalg.solve(a / n + RIDGE * np.eye(size), b / n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = model.step(_matrix(batch, names))
            yield pa.RecordBatch.from_arrays(
                [pa.array(steps, pa.int64()), batch.column(label)], names=["step", "y"]
            )

    sums, weights = np.zeros(STEPS), np.zeros(STEPS)
    histogram = rows.mapInArrow(run, "step long, y double").groupBy("step")
    for step, total, count in histogram.agg(F.sum("y"), F.count("*")).collect():
        sums[step], weights[step] = total, count
    model.levels = isotonic(sums, weights)
    return model


def scored(facts: DataFrame, model: Model, kept: tuple[str, ...]) -> DataFrame:
    """Columns `kept` of `facts` with `score`."""
    source = facts.select(*kept, *model.names)
    fields = [*facts.select(*kept).schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(_matrix(batch, model.names))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(scores, pa.float64())],
                names=[*kept, "score"],
            )

    return source.mapInArrow(run, f"{schema}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, `held_out` and `score` of every document.

    Labels of documents whose crc32 modulo `held_out` is 0 are never read.
    """
    facts = stored(
        with_statistics(docs.select("doc_id", "text"))
        .drop("text")
        .withColumn("held_out", remainder("doc_id", held_out) == 0)
    )
    own = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    model = fit(facts.where(~F.col("held_out")).join(own, "doc_id"), "quality")
    return scored(facts, model, ("doc_id", "held_out"))


def op7_kernel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(documents(spark, sf_dir), labels).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
