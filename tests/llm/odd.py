"""Documents with everything that may go wrong, and brute-force helpers."""

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use themselves.
CLASHES = ("n_words", "score", "start", "path", "shard", "length", "label", "class")
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in CLASHES],
    ]
)
LABELS = "doc_id long, quality int, toxic int"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    parts = "the on ver lich cion para tion que ment an er ing und der las con".split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(words))


TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "a b c",
    "  two  spaces and\ttabs \n\nlines here ",
    "It's we'll THEY'D ’s café straße Île 你好 \U0001f600 é İI",
    "　wide space 123 4567 ٣٤ $$$ ### <|endoftext|> a\x0bb\x1cc\x85d",
    prose(1, 40),
    prose(1, 40),  # equal texts
    prose(2, 30_000),  # very long
    "x" * 30_000,
    "same words again and again for eight windows " * 12,
    "line\nline\nline\nother\n\n",
    'key password=7602ad27cf5550de1c and token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" end',
]


def odd(spark, texts=TEXTS):
    rows = [(k, t, "en", None, None if t is None else len(t), *["x"] * 8) for k, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, "no id at all here", None, None, None, *[None] * 8)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), LABELS)
