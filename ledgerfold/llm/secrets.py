"""Secrets in texts, told from look-alikes by a random forest.

A pattern finds candidates: long runs of letters and digits or of mixed case, and values
assigned to names like password, in configurations, code and JSON. A forest then judges each by its length, its characters and their transitions, how
much of it dictionary words cover, the path of its text and the words next to it. It learns
from labelled findings; by default these are written out from templates of true secrets and of
the usual false alarms (hashes of commits, ids, numbers, placeholders, names in code) around
values derived from a seed. Candidates are cut out by Spark's own functions, the forest is
Spark's own, and no candidate or text reaches the driver.

Null and empty texts have no candidates. Repeated rows are searched once each.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm.common import documents, stored

#: Names a secret is given, and words before harmless hashes and ids.
NAMES = (
    "password|passwd|pwd|passphrase|secret|token|api_?key|access_?key|private_?key|auth|credentials?"
)
HARMLESS = "commit|sha1|sha256|md5|checksum|hash|uuid|guid|digest|order|phone|tel|isbn|version|id"
_RUN = "A-Za-z0-9_+/\\-"
_ASSIGNED = r"[ \t]{0,16}(?:=>|:=|[=:])[ \t]{0,16}[\"']?"
#: At least 8 characters assigned to a secret's name, which may be quoted; or a whole run of at
#: least 12 with a digit, or with a small letter and a capital after the first character.
#: The tests before the long look-behind only spare it where no value can start.
CANDIDATE = (
    r"(?<=[=:>\"' \t])(?=[^\s\"'=:]{8})"
    rf"(?<=(?i:{NAMES}|key)[\"']?{_ASSIGNED})[^\s\"'=:]{{8,}}"
    rf"|(?<![{_RUN}])(?=[A-Za-z_+/\-]*+[0-9]|(?=[A-Z_+/\-]*+[a-z])[{_RUN}][a-z_+/\-]*+[A-Z])"
    rf"[{_RUN}]{{12,}}={{0,2}}"
)
#: Words of code and prose that true secrets hardly hold.
DICTIONARY = (
    "password secret token example sample test demo your change here user name value data file "
    "image index main public static config default string number version update client server "
    "service handler request response the and for with that this from have"
).split()
TEST_PATH = "test|example|sample|fixture|mock|docs?"
TREES, DEPTH, SEED = 40, 8, 29
#: Labelled findings written from each template.
EACH = 250
THRESHOLD = 0.5
#: Characters looked at before and after a candidate.
BEFORE, AFTER = 48, 16

FEATURES = (
    "length",
    "digits",
    "capitals",
    "smalls",
    "others",
    "hexadecimal",
    "transitions",
    "case_changes",
    "repeats",
    "distinct",
    "vowels",
    "dictionary",
    "worded",
    "dashes",
    "known_prefix",
    "named",
    "assigned",
    "quoted",
    "harmless",
    "in_url",
    "test_path",
)


def candidates(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """One row for each candidate: `value`, `start` in characters, `before`, `after`, `path`.

    Other columns than the text are carried along. A text is split at its candidates, so that
    the parts between them give all places and neighbours.
    """
    own = (text, "value", "start", "before", "after", "path")
    kept = [F.col(f"`{n}`") for n in docs.columns if n not in own]
    pattern = F.lit(CANDIDATE)
    there = docs.where(F.regexp_like(text, pattern))
    where = F.lit("") if path is None else F.coalesce(F.col(path).cast("string"), F.lit(""))
    parts = there.select(
        *kept,
        where.alias("_path"),
        F.regexp_extract_all(F.col(text), pattern, F.lit(0)).alias("_values"),
        F.split(text, CANDIDATE, -1).alias("_gaps"),
    )
    at = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("starts"))

    def step(a: Column, x: Column) -> Column:
        start = a["end"] + F.length(x["g"])
        return F.struct(
            (start + F.length(x["v"])).alias("end"), F.concat(a["starts"], F.array(start)).alias("starts")
        )

    pairs = F.zip_with(
        F.slice("_gaps", F.lit(1), F.size("_values")),
        "_values",
        lambda g, v: F.struct(g.alias("g"), v.alias("v")),
    )
    parts = parts.withColumn("_starts", F.aggregate(pairs, at, step)["starts"])
    rows = parts.select(
        *kept,
        "_path",
        "_gaps",
        "_values",
        F.posexplode(F.arrays_zip("_values", "_starts")).alias("_k", "_x"),
    )
    # A name or a path before a candidate may be a candidate itself.
    k, none = F.col("_k"), F.lit("")
    near = lambda name, j: F.coalesce(F.get(name, j), none)
    before = F.concat(near("_gaps", k - 1), near("_values", k - 1), near("_gaps", k))
    after = F.concat(near("_gaps", k + 1), near("_values", k + 1))
    return rows.select(
        *kept,
        F.col("_x._values").alias("value"),
        F.col("_x._starts").cast("long").alias("start"),
        F.right(before, F.lit(BEFORE)).alias("before"),
        F.left(after, F.lit(AFTER)).alias("after"),
        F.col("_path").alias("path"),
    )


def with_features(found: DataFrame) -> DataFrame:
    """Add the vector `features` to rows with value, before, after and path."""
    v = F.col("value")
    n = F.greatest(F.length(v), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    before, after, path = F.col("before"), F.col("after"), F.lower("path")
    rest = F.regexp_replace(F.lower(v), "|".join(DICTIONARY), "")
    columns = {
        "length": n,
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "smalls": share("[a-z]"),
        "others": share("[^A-Za-z0-9]"),
        "hexadecimal": flag(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "transitions": (share("[0-9](?=[A-Za-z])") + share("[A-Za-z](?=[0-9])")),
        "case_changes": share("[a-z](?=[A-Z])"),
        "repeats": share(r"(.)(?=\1)"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "vowels": share("[aeiouAEIOU]"),
        "dictionary": 1.0 - F.length(rest) / n,
        "worded": 1.0 - F.length(F.regexp_replace(v, "[A-Z]?[a-z]{3,}", "")) / n,
        "dashes": share("-"),
        "known_prefix": flag(v.rlike("(?:^|/)(?:AKIA|ASIA|ghp_|gho_|xox[bp]-|sk_live_|AIza|eyJ)")),
        "named": flag(before.rlike(rf"(?i)(?:{NAMES})[^\n]{{0,12}}(?:{_ASSIGNED})?$")),
        "assigned": flag(before.rlike(rf"(?:[=:]\s{{0,2}}[\"']?|{_ASSIGNED})$")),
        "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "harmless": flag(before.rlike(rf"(?i)\b(?:{HARMLESS})\W{{0,3}}$")),
        "in_url": flag(before.rlike(r"(?i)(?:://|www\.|@)\S*$")),
        "test_path": flag(path.rlike(TEST_PATH)),
    }
    named = found.withColumns({f"_f_{name}": columns[name].cast("double") for name in FEATURES})
    own = [f"_f_{name}" for name in FEATURES]
    return VectorAssembler(inputCols=own, outputCol="features").transform(named).drop(*own)


#: Templates (label, before, value, after). `{h}` is a hexadecimal string, `{u}`
#: one of capitals and digits, `{m}` of mixed characters, `{x}` of mixed letters, `{d}` of digits,
#: `{w}` a word, `{s}` one of the dictionary, `{W}` and `{S}` the same with a capital.
TEMPLATES = (
    (1, "{w} {w} ", "AKIA{u16}", " {w}"),
    (1, "key: ", "AKIA{u16}", "\n{w}"),
    (1, "{w} {w} password=", "{h18}", " {w}"),
    (1, "{w}.password: ", "{m14}", "\n"),
    (1, '{w} {w} token = "', "{h40}", '" {w}'),
    (1, "token: ", "{h32}", " {w}"),
    (1, 'api_key = "', "{m32}", '"'),
    (1, "secret='", "{m40}", "'"),
    (1, "export AWS_SECRET_ACCESS_KEY=", "{m40}", "\n"),
    (1, "{w} ", "ghp_{m36}", " {w}"),
    (1, "Authorization: Bearer ", "{m48}", "\n"),
    (1, "{w}: ", "sk_live_{m24}", " {w}"),
    (1, '"password": "', "{m5}!{m6}", '"'),
    (1, '"api_key": "', "{m32}", '"'),
    (1, "'secret' => '", "{m20}", "',"),
    (1, "pwd=", "{w}{d1}!{h3}", "\n"),
    (1, "{w}_pwd\t=\t", "{m10}", "\n"),
    (1, "credential: ", "{m3}${m6}", "\n{w}"),
    (1, "passphrase=", "{x14}", "\n"),
    (1, "auth := ", "{m24}", "\n"),
    (1, "private_key = '", "{x40}", "'"),
    (1, "{w} ", "{x40}", " {w}"),
    (1, "{w} ", "/{w}/{w}/{w}/{w}/ghp_{m36}", " {w}"),
    (1, "{w} ", "{w}/{w}/{w}/{w}/{w}/{w}/AKIA{u16}", "\n"),
    (0, "{w} ", "{s}{S}{S}{S}", "({w}"),
    (0, "{w} ", "{s}{S}{S}", ' = "'),
    (0, "{w} ", "{S}{S}{S}", " {w}"),
    (0, "{w} ", "{S}-{S}{S}", " {w}"),
    (0, "{w} ", "{w}{W}{W}", "({w}"),
    (0, "{w}.", "{w}_{w}{W}", " {w}"),
    (0, "{w} ", "{W}{W}", " {w}"),
    (0, "{w} ", "{W}-{W}", ", {w}"),
    (0, "{w} ", "{W}/{W}/{W}", " {w}"),
    (0, "{w} ", "/{w}/{w}/{w}/{w}/{w}/{w}{d2}", " {w}"),
    (0, '"token": "', "your_token_here_{d2}", '"'),
    (0, "auth: ", "{w}{W}", "\n"),
    (0, "commit ", "{h40}", "\n{w}"),
    (0, "{w} sha1 ", "{h40}", " {w}"),
    (0, "md5: ", "{h32}", " {w}"),
    (0, "checksum = ", "{h64}", "\n"),
    (0, "{w} uuid ", "{h8}-{h4}-{h4}-{h4}-{h12}", " {w}"),
    (0, "{w} {w} ", "{h8}-{h4}-{h4}-{h4}-{h12}", " {w}"),
    (0, "{w} {w} ", "{d10}{d3}", " {w}"),
    (0, "phone ", "{d12}", " {w}"),
    (0, "order {w} ", "{d16}", " {w}"),
    (0, "https://{w}.example.com/", "{w}/{w}-{d6}", " {w}"),
    (0, "{w} ", "{w}_{w}_{d3}", " {w}"),
    (0, "import ", "{w}/{w}/{w}{d1}", "\n"),
    (0, "{w} ", "{w}{w}{d2}", ", {w}"),
    (0, "{w} ", "version-{d1}-{d2}-{d3}", " {w}"),
    (0, "password=", "your_password_{d2}", " {w}"),
    (0, 'token = "', "example_token_{d3}", '"'),
    (0, "secret: ", "changeme{d4}", "\n"),
    (0, 'api_key = "', "xxxxxxxxxxxx{d4}", '"'),
    (0, "password: ", "{w}{w}{w}", " {w}"),
    (0, "src=data:image/png;base64,", "{m120}", '"'),
)


def labelled_findings(spark: SparkSession, each: int = EACH, seed: int = SEED) -> DataFrame:
    """value, before, after, path and `label` of findings written from the templates."""
    rows = spark.range(len(TEMPLATES) * each).select(
        (F.col("id") % len(TEMPLATES)).cast("int").alias("t"), "id"
    )
    syllables = "an the er ing on ver sch lich cion para tion que ment data user file".split()

    def parsed(template: str, k: int) -> list[dict]:
        parts, rest = [], template
        while "{" in rest:
            plain, _, rest = rest.partition("{")
            name, _, rest = rest.partition("}")
            k += 1
            parts.append({"plain": plain, "kind": name[0], "size": int(name[1:] or 0), "k": k})
        return [*parts, {"plain": rest, "kind": "", "size": 0, "k": 0}]

    def piece(part: Column) -> Column:
        digest = lambda end: F.sha2(
            F.concat_ws("-", F.lit(seed), "id", F.concat(part["k"].cast("string"), F.lit(end))), 256
        )
        raw = F.concat(digest("a"), digest("b"))
        mixed = F.translate(
            F.base64(F.concat(F.unhex(raw), F.unhex(F.reverse(raw)))), "+/=\r\n", "ZQ"
        )
        table = F.array(*[F.lit(x) for x in syllables])
        at = [
            F.pmod(
                F.xxhash64("id", F.concat(F.lit(str(seed)), part["k"].cast("string"), F.lit(str(j)))),
                F.lit(len(syllables)),
            )
            for j in (0, 1, 2)
        ]
        word = F.concat(*[F.get(table, i.cast("int")) for i in at])
        listed = F.get(
            F.array(*[F.lit(x) for x in DICTIONARY]),
            F.pmod(F.xxhash64("id", part["k"]), F.lit(len(DICTIONARY))).cast("int"),
        )
        kind = part["kind"]
        source = (
            F.when(kind == "h", raw)
            .when(kind == "u", F.translate(F.upper(mixed), "0189", "WXYZ"))
            .when(kind == "m", mixed)
            .when(kind == "x", F.translate(mixed, "0123456789", "qRsTuVwXyZ"))
            .when(kind == "d", F.translate(raw, "abcdef", "283746"))
        )
        own = (
            F.when(kind == "w", word)
            .when(kind == "W", F.initcap(word))
            .when(kind == "s", listed)
            .when(kind == "S", F.initcap(listed))
            .when(kind == "", F.lit(""))
            .otherwise(F.substring(source, F.lit(1), part["size"]))
        )
        return F.concat(part["plain"], own)

    # One literal for all templates, as an expression for each would outgrow compiled code.
    kinds = "array<struct<plain:string,kind:string,size:int,k:int>>"
    texts = [
        {"value": parsed(v, 100), "before": parsed(b, 200), "after": parsed(a, 300), "label": float(y)}
        for y, b, v, a in TEMPLATES
    ]
    schema = f"array<struct<value:{kinds},before:{kinds},after:{kinds},label:double>>"
    own = F.get(F.from_json(F.lit(json.dumps(texts)), schema), F.col("t"))
    written = lambda name: F.array_join(F.transform(own[name], piece), "").alias(name)
    return rows.select(
        written("value"),
        written("before"),
        written("after"),
        F.lit("").alias("path"),
        own["label"].alias("label"),
    )


def fit(findings: DataFrame) -> RandomForestClassificationModel:
    """A forest of labelled findings (value, before, after, path, label)."""
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label"
    )
    return forest.fit(with_features(findings))


def judged(found: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """Add `score`, the forest's share of votes for a secret, and `is_secret`."""
    rows = model.transform(with_features(found))
    score = vector_to_array("probability")[1]
    return rows.select(
        *found.columns, score.alias("score"), (score >= THRESHOLD).alias("is_secret")
    )


def redacted(docs: DataFrame, path: str | None = None, mark: str = "[secret]") -> DataFrame:
    """`docs` with every span that a forest judges a secret replaced by `mark`.

    Rows are told apart by doc_id and text; all columns stay, and `n_chars` is counted anew.
    """
    key = F.xxhash64("text").alias("_key")
    where = [] if path is None else [F.col(path).alias("_where")]
    rows = docs.select("doc_id", "text", key, *where)
    found = candidates(rows, path="_where" if where else None)
    # Stored first, so that the filter is not pushed below the search and the forest.
    secrets = stored(judged(found, fit(labelled_findings(docs.sparkSession)))).where("is_secret")
    spans = secrets.groupBy(F.col("doc_id").alias("_d"), F.col("_key").alias("_k")).agg(
        F.sort_array(
            F.collect_set(F.struct("start", F.length("value").alias("length"))), asc=False
        ).alias("_spans")
    )
    text = F.aggregate(
        "_spans",
        F.col("_text"),
        lambda t, s: F.concat(
            F.substring(t, F.lit(1), s["start"].cast("int")),
            F.lit(mark),
            F.substring(t, (s["start"] + s["length"] + 1).cast("int"), F.length(t)),
        ),
    )
    row = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"), key)
    on = F.col("_row.doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k"))
    new = row.join(spans, on, "left").withColumn(
        "_new", F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(text)
    )
    changed = {"text": F.col("_new"), "n_chars": F.length("_new").cast("long")}
    return new.select(
        *[
            F.when(F.col("_spans").isNull(), F.col(f"_row.`{n}`"))
            .otherwise(changed[n])
            .alias(n)
            if n in changed
            else F.col(f"_row.`{n}`").alias(n)
            for n in docs.columns
        ]
    )


def op4_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of all documents with the forest's verdict; values as digests only."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    found = candidates(docs, path="source")
    return judged(found, fit(labelled_findings(spark))).select(
        "doc_id",
        "start",
        F.length("value").cast("long").alias("length"),
        F.sha2("value", 256).alias("value_sha256"),
        "score",
        "is_secret",
    )
