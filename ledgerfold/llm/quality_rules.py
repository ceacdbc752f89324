"""Learned decision lists: ordered threshold rules that reject documents of low quality.

Sequential covering on labelled statistics. Each rule is a conjunction of thresholds, grown one
condition at a time by the gain in information on two thirds of the labelled rows, then cut
back to the length that does best on the last third. Rows that a rule covers are taken out
before the next one. Learning stops when a rule finds too little or is not precise enough.

Counts are made by Spark over all labelled rows, in bins between quantiles; the driver sees a
table of features by bins only. The list becomes one conditional expression.

Null texts count as empty. Labels of unknown documents, null labels and documents without a
label take no part in learning. With no rejected label the list is empty and rejects nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm.common import documents, remainder, stored
from ledgerfold.llm.statistics import COUNTS, RATIOS, with_statistics

#: Quantile bins of each statistic.
BINS = 64
MAX_RULES = 12
MAX_CONDITIONS = 4
#: A rule must be right this often on the rows held back for pruning.
PRECISION = 0.9
#: A rule must find this many low documents, of those used to grow it.
LEAST = 8

#: (statistic, ">=" or "<", threshold)
Condition = tuple[str, str, float]


def _holds(condition: Condition) -> Column:
    name, sign, value = condition
    return F.col(name) >= F.lit(value) if sign == ">=" else F.col(name) < F.lit(value)


def _all(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & _holds(condition)
    return out


def verdict(rules: list[list[Condition]]) -> Column:
    """False where a rule of the list rejects, in order; otherwise true."""
    out = None
    for rule in rules:
        out = (
            F.when(_all(rule), F.lit(False))
            if out is None
            else out.when(_all(rule), F.lit(False))
        )
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _bin(name: str, edges: list[float]) -> Column:
    """How many of the edges a statistic reaches."""
    value = F.col(name)
    return F.size(F.filter(F.array(*[F.lit(float(x)) for x in edges]), lambda e: e <= value))


def _gain(before: tuple[int, int], after: tuple[int, int]) -> float:
    """Information gained on the low rows by narrowing (low, other) counts."""
    low, other = after
    if not low:
        return 0.0
    return low * (math.log2(low / (low + other)) - math.log2(before[0] / sum(before)))


def _best(rows: list, cuts: dict[str, list[float]], now: tuple[int, int]) -> tuple | None:
    """The condition with the largest gain, from counts by (statistic, bin)."""
    best = (0.0, None)
    for name, edges in cuts.items():
        counts = {r["bin"]: (r["low"], r["other"]) for r in rows if r["name"] == name}
        low = other = 0
        for k, edge in enumerate(edges):  # bin k holds values below edge k
            a, b = counts.get(k, (0, 0))
            low, other = low + a, other + b
            for sign, side in (("<", (low, other)), (">=", (now[0] - low, now[1] - other))):
                if (gain := _gain(now, side)) > best[0] + 1e-9:
                    best = (gain, (name, sign, edge))
    return best[1]


def learned(
    labelled: DataFrame,
    features: tuple[str, ...] = RATIOS,
    label: str = "quality",
    precision: float = PRECISION,
) -> list[list[Condition]]:
    """The rules that find rows whose `label` is 0. `labelled` has a doc_id, features, label."""
    used = stored(
        labelled.where(F.col(label).isNotNull()).select(
            (remainder("doc_id", 3) == 0).alias("_prune"),
            (F.col(label) == 0).cast("int").alias("_low"),
            *features,
        )
    )
    shares = [k / BINS for k in range(1, BINS)]
    # Quantiles of the low rows and of all rows both bound the bins.
    edges = used.groupBy("_low").agg(
        *[F.percentile_approx(name, shares, 10_000).alias(name) for name in features]
    )
    cuts: dict[str, list[float]] = {name: [] for name in features}
    for row in edges.collect():
        for name in features:
            cuts[name] = sorted({*cuts[name], *(row[name] or [])})
    if not any(cuts.values()):
        return []
    binned = F.array(
        *[
            F.struct(F.lit(name).alias("name"), _bin(name, own).alias("bin"))
            for name, own in cuts.items()
            if own
        ]
    )
    used = stored(used.withColumn("_bins", binned))
    grow, prune = used.where(~F.col("_prune")), used.where("_prune")

    rules: list[list[Condition]] = []
    while len(rules) < MAX_RULES:
        rule: list[Condition] = []
        rest = grow.where(verdict(rules))
        while len(rule) < MAX_CONDITIONS:
            rows = (
                rest.where(_all(rule))
                .select("_low", F.explode("_bins").alias("_b"))
                .groupBy(F.col("_b.name").alias("name"), F.col("_b.bin").alias("bin"))
                .agg(
                    F.sum("_low").alias("low"), F.sum(1 - F.col("_low")).alias("other")
                )
                .collect()
            )
            first = [r for r in rows if r["name"] == rows[0]["name"]]
            now = (sum(r["low"] for r in first), sum(r["other"] for r in first))
            if now[0] < LEAST or not now[1]:
                break
            condition = _best(rows, cuts, now)
            if condition is None:
                break
            rule.append(condition)
        if not rule:
            break
        # How each shorter form of the rule does on the rows held back.
        held = prune.where(verdict(rules)).agg(
            *[
                F.coalesce(F.sum(F.when(_all(rule[:k]), value)), F.lit(0)).alias(f"{name}{k}")
                for k in range(1, len(rule) + 1)
                for name, value in (("low", F.col("_low")), ("other", 1 - F.col("_low")))
            ]
        )
        row = held.first()
        scores = []
        for k in range(1, len(rule) + 1):
            low, other = row[f"low{k}"], row[f"other{k}"]
            scores.append(((low - other) / max(1, low + other), low, -k))
        best = max(range(len(rule)), key=lambda k: (scores[k][0], scores[k][1], scores[k][2]))
        share = (1 + scores[best][0]) / 2
        if not scores[best][1] or share < precision:
            break
        rules.append(rule[: best + 1])
    return rules


def base_failed() -> Column:
    """Fewer than 20 words, or more than 30 in 100 words in repeated windows."""
    few = F.col("n_words") < 20
    return few | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules_for(facts: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """Rules learned from the `quality` labels of rows with statistics.

    Several labels of one document count as its highest.
    """
    own = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return learned(facts.select("doc_id", *RATIOS).join(own, "doc_id"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, statistics, `base_failed` and `kept` of each document."""
    facts = stored(with_statistics(docs.select("doc_id", "text")).drop("text"))
    rules = rules_for(facts, labels)
    return facts.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & verdict(rules)
    )


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that pass, with all their columns.

    The rows are stored beside their statistics, so that no join has to move them.
    """
    row = docs.select("doc_id", "text", F.struct("*").alias("_row"))
    facts = stored(with_statistics(row).drop("text"))
    rules = rules_for(facts, labels)
    rejected = F.coalesce(base_failed() | ~verdict(rules), F.lit(False))
    return facts.where(~rejected).select("_row.*")


def op8_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = judged(documents(spark, sf_dir), labels)
    return rows.select("doc_id", *COUNTS, "base_failed", "kept")
