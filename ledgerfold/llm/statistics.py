"""Statistics of whole texts as Spark expressions, for filters and classifiers.

A word is a run of characters other than space and U+0009 to U+000D. Null texts count as empty;
empty texts have zero everywhere, ratios too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import BLANKS

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Words in a window whose repetition counts.
WINDOW = 8

#: Ratios that do not depend on the length of a text, and its length on a log scale.
RATIOS = (
    "log_words",
    "mean_word",
    "symbol_share",
    "dup_line_share",
    "repeat_share",
    "distinct_share",
    "capital_runs",
    "bang_share",
    "line_words",
    "digit_runs",
    "stop_share",
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def without(text: Column, characters: str) -> Column:
    """The text less some ASCII characters."""
    for c in characters:
        text = F.replace(text, F.lit(c))
    return text


def _occurrences(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(without(text, characters))).cast("long")


def _window_hashes(words: Column, size: int) -> Column:
    at = F.sequence(F.lit(0), F.size(words) - size)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(F.size(words) >= size, hashes).otherwise(F.array().cast("array<bigint>"))


def _pairs(hashes: Column) -> Column:
    """(hash, place) in order, where some hash occurs twice; otherwise empty."""
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(repeated, F.sort_array(pairs)).otherwise(none)


def _repeated(pairs: Column) -> Column:
    """The places whose hash is that of a neighbour in the order of hashes."""
    own = lambda x, k: F.when(
        x["h"].eqNullSafe(F.get(pairs, k - 1)["h"]) | x["h"].eqNullSafe(F.get(pairs, k + 1)["h"]),
        x["i"],
    )
    return F.sort_array(F.array_compact(F.transform(pairs, own)))


def _covered(places: Column, size: int) -> Column:
    """Words inside windows that begin at ascending places."""
    start = F.struct(F.lit(-size).alias("last"), F.lit(0).alias("words"))
    step = lambda a, i: F.struct(
        i.alias("last"), (a["words"] + F.least(F.lit(size), i - a["last"])).alias("words")
    )
    return F.aggregate(places, start, step)["words"]


def with_statistics(df: DataFrame, text: str = "text", ratios: bool = True) -> DataFrame:
    """Add the counts, and with `ratios` the ratios; columns already so named are replaced.

    Each step is a projection of its own, so that nothing is computed twice.
    """
    own = [*COUNTS, *(RATIOS if ratios else ())]
    kept = [F.col(f"`{n}`") for n in df.columns if n not in own]
    names = [n for n in df.columns if n not in own]
    all_ = [F.col(f"`{n}`") for n in names]
    step = df.select(*kept, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_t"))
    step = step.select(*all_, "_t", F.btrim("_t", F.lit(BLANKS)).alias("_b"))
    empty = F.array().cast("array<string>")
    step = step.select(
        *all_,
        "_t",
        F.when(F.col("_b") == "", empty)
        .otherwise(F.split("_b", r"[\x20\x09-\x0D]+"))
        .alias("_words"),
        F.filter(
            F.split("_t", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != F.lit("")
        ).alias("_lines"),
    )
    hashes = _window_hashes(F.col("_words"), WINDOW).alias("_hashes")
    step = step.select(*all_, "_t", "_words", "_lines", hashes)
    step = step.select(*all_, "_t", "_words", "_lines", _pairs(F.col("_hashes")).alias("_pairs"))
    n = F.size("_words").cast("long")
    step = step.select(
        *all_,
        "_t",
        F.size("_lines").alias("_n_lines"),
        *([F.size(F.array_distinct("_words")).alias("_distinct")] if ratios else []),
        n.alias("n_words"),
        F.length(without(F.col("_t"), BLANKS)).cast("long").alias("word_chars"),
        _occurrences(F.col("_t"), SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _covered(_repeated(F.col("_pairs")), WINDOW).cast("long").alias("n_repeat_words"),
    )
    if not ratios:
        return step.drop("_t", "_n_lines")
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    t = F.col("_t")
    return step.select(
        *all_,
        *COUNTS,
        F.log1p(F.col("n_words").cast("double")).alias("log_words"),
        (F.col("word_chars") / words).alias("mean_word"),
        (F.col("n_symbols") / words).alias("symbol_share"),
        (F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("_distinct") / words).alias("distinct_share"),
        (F.regexp_count(t, F.lit("[A-Z]{2,}")) / words).alias("capital_runs"),
        (_occurrences(t, "!") / words).alias("bang_share"),
        F.log1p(F.col("n_words") / F.greatest(F.col("_n_lines"), F.lit(1))).alias("line_words"),
        (F.regexp_count(t, F.lit("[0-9]+")) / words).alias("digit_runs"),
        (_occurrences(t, ".,") / words).alias("stop_share"),
    )
