"""Secret scans: candidates by shape, false positives removed by a random forest.

A candidate is a run of at least ``MIN_CHARS`` key characters inside a word.  It is
described by its length and make-up, by how likely its character transitions are in
the corpus' words, by how much of it the corpus' dictionary of letter trigrams covers,
by its path (the document's source) and by the neighbouring words.  A random forest
learned from labelled findings tells secrets from look-alikes.

Transition and dictionary tables are counted over all words of all documents; their
size is fixed by the alphabet (38 x 38 and 26 x 26 x 26), whatever the corpus.  The
forest is fitted on at most ``max_findings`` labelled findings of each label.

Everything runs as DataFrame expressions and Spark ML.

Rules for unusual rows: a null or empty text has no candidates; a null source is the
empty path; a null id is an ordinary value but never learned from; repeated rows
report their findings each; with labelled findings of one kind or none, nothing is
removed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import ascii_lower, text_of
from tidepanel.sources.sinks import materialize

MIN_CHARS = 16
RUN = rf"[A-Za-z0-9+/_-]{{{MIN_CHARS},}}"
BLANK = r"[\x20\x09-\x0D]+"
MAX_FINDINGS = 10_000
#: Words that often stand before a credential.
KEYWORDS = ("access", "api", "auth", "bearer", "credential", "key", "passwd", "password", "pwd", "secret", "token")
#: Parts of paths where look-alikes are common.
TEST_PATHS = ("example", "fixture", "mock", "sample", "spec", "test")
SYMBOLS = 38
FEATURES = [
    "chars", "digits", "uppers", "lowers", "others", "runs", "distinct", "hex_only", "transition",
    "coverage", "keyword_before", "keyword_inside", "quoted", "glued", "before_transition",
    "after_transition", "path_test", "path_bucket",
]


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """``key, path, word, nth, value, glue, quoted, before, after`` of every candidate."""
    words = F.split(text_of(text), BLANK)
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"),
        words.alias("words"),
    )
    long_enough = lambda w: (F.char_length(w) >= MIN_CHARS) & F.rlike(w, F.lit(RUN))
    marked = F.filter(
        F.transform("words", lambda w, i: F.struct(i.alias("word"), w.alias("w"))),
        lambda x: long_enough(x["w"]),
    )
    at = lambda shift: F.coalesce(F.try_element_at("words", F.col("x.word") + 1 + shift), F.lit(""))
    around = rows.select("key", "path", "words", F.explode(marked).alias("x")).select(
        "key", "path", F.col("x.word").alias("word"), F.col("x.w").alias("w"),
        F.when(F.col("x.word") > 1, F.concat_ws(" ", at(-2), at(-1)))
        .when(F.col("x.word") > 0, at(-1))
        .otherwise("")
        .alias("before"),
        at(1).alias("after"),
    )
    values = F.regexp_extract_all("w", F.lit(f"({RUN})"), 1)
    return around.select("*", F.posexplode(values).alias("nth", "value")).select(
        "key", "path", "word", "nth", "value", "before", "after",
        F.expr("substr(w, 1, instr(w, value) - 1)").alias("glue"),
    )


def codes(value: Column) -> Column:
    """Numbers of the characters: letters 0-25, digits 26-35, key signs 36, all others 37.

    The value is taken apart once, in time linear in its length.
    """

    def code(char):
        c = F.ascii(char)
        return (
            F.when(c.between(97, 122), c - 97)
            .when(c.between(48, 57), c - 22)
            .when(c.isin(43, 45, 47, 61, 95), F.lit(36))
            .otherwise(F.lit(37))
        )

    return F.when(F.length(value) > 0, F.transform(F.split(value, ""), code)).otherwise(
        F.array().cast("array<int>")
    )


def corpus_tables(docs: DataFrame, text: str = "text") -> tuple[list[float], list[int]]:
    """Log-probability of each symbol after each other one, and the bits of common letter trigrams.

    Words are counted first, each distinct word is taken apart once.
    """
    words = docs.select(F.explode(F.split(ascii_lower(text_of(text)), BLANK)).alias("w"))
    counted = words.where(F.col("w") != "").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    coded = materialize(counted.select("n", codes(F.col("w")).alias("c")), "word-codes")
    positions = lambda k: F.sequence(F.lit(1), F.size("c") - (k - 1))
    pair = F.transform(
        positions(2), lambda i: F.element_at("c", i) * SYMBOLS + F.element_at("c", i + 1)
    )
    pairs = (
        coded.where(F.size("c") >= 2)
        .select("n", F.explode(pair).alias("g"))
        .groupBy("g")
        .agg(F.sum("n").alias("n"))
        .collect()  # at most SYMBOLS squared rows
    )
    seen = {r["g"]: r["n"] for r in pairs}
    after = [sum(seen.get(a * SYMBOLS + b, 0) for b in range(SYMBOLS)) for a in range(SYMBOLS)]
    logs = [
        math.log((seen.get(a * SYMBOLS + b, 0) + 0.5) / (after[a] + 0.5 * SYMBOLS))
        for a in range(SYMBOLS)
        for b in range(SYMBOLS)
    ]
    triple = F.transform(
        positions(3),
        lambda i: F.when(
            (F.element_at("c", i) < 26) & (F.element_at("c", i + 1) < 26) & (F.element_at("c", i + 2) < 26),
            (F.element_at("c", i) * 26 + F.element_at("c", i + 1)) * 26 + F.element_at("c", i + 2),
        ),
    )
    triples = (
        coded.where(F.size("c") >= 3)
        .select("n", F.explode(triple).alias("g"))
        .where("g IS NOT NULL")
        .groupBy("g")
        .agg(F.sum("n").alias("n"))
        .collect()  # at most 26 to the third rows
    )
    total = sum(r["n"] for r in triples)
    bits = [0] * (26**3 // 63 + 1)
    for r in triples:
        if r["n"] * 100_000 >= total:
            bits[r["g"] // 63] |= 1 << r["g"] % 63
    return logs, bits


def described(found: DataFrame, logs: list[float], bits: list[int]) -> DataFrame:
    """Adds the columns of ``FEATURES``."""
    table = F.lit(logs)
    known = F.array(*[F.lit(b).cast("long") for b in bits])

    def transition(c: str) -> Column:
        pairs = F.sequence(F.lit(1), F.size(c) - 1)
        total = F.aggregate(
            pairs, F.lit(0.0),
            lambda acc, i: acc
            + F.element_at(table, F.element_at(c, i) * SYMBOLS + F.element_at(c, i + 1) + 1),
        )
        return F.when(F.size(c) > 1, total / (F.size(c) - 1)).otherwise(F.lit(0.0))

    def is_known(c, i):
        a, b, d = (F.element_at(c, i + j) for j in range(3))
        g = (a * 26 + b) * 26 + d
        letters = (a < 26) & (b < 26) & (d < 26)
        bit = F.getbit(F.element_at(known, F.floor(g / 63).cast("int") + 1), g % 63)
        return F.when(letters, bit.cast("int")).otherwise(0)

    low = ascii_lower(F.col("value"))
    share = lambda p: F.regexp_count("value", F.lit(p)) / F.length("value")
    kinds = F.translate(
        F.translate(F.col("value"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A" * 26),
        "abcdefghijklmnopqrstuvwxyz0123456789+/_-", "a" * 26 + "0" * 10 + "----",
    )
    any_of = lambda c, names: F.rlike(ascii_lower(c), F.lit("|".join(names))).cast("int")
    return (
        found.withColumns(
            {
                "c": codes(low),
                "cb": codes(ascii_lower(F.substring_index("before", " ", -1))),
                "ca": codes(ascii_lower(F.col("after"))),
            }
        )
        .withColumns(
            {
                "chars": F.length("value"),
                "digits": share("[0-9]"),
                "uppers": share("[A-Z]"),
                "lowers": share("[a-z]"),
                "others": share("[^A-Za-z0-9]"),
                "runs": F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) / F.length("value"),
                "distinct": F.size(F.array_distinct("c")) / F.length("value"),
                "hex_only": F.rlike(low, F.lit("^[0-9a-f]+$")).cast("int"),
                "transition": transition("c"),
                "coverage": F.aggregate(
                    F.sequence(F.lit(1), F.size("c") - 2), F.lit(0), lambda acc, i: acc + is_known("c", i)
                )
                / (F.size("c") - 2),
                "keyword_before": any_of(F.col("before"), KEYWORDS),
                "keyword_inside": any_of(F.col("glue"), KEYWORDS),
                "quoted": F.rlike("glue", F.lit("[\"'`]$")).cast("int"),
                "glued": F.rlike("glue", F.lit("[=:]")).cast("int"),
                "before_transition": transition("cb"),
                "after_transition": transition("ca"),
                "path_test": any_of(F.col("path"), TEST_PATHS),
                "path_bucket": F.pmod(F.xxhash64(F.lit(71), "path"), F.lit(16)),
            }
        )
        .drop("c", "cb", "ca")
    )


def format_label() -> Column:
    """1 where a candidate has a published or assigned credential format, else 0.

    Stands in for reviewed findings where none are given: access key ids of four fixed
    letters and 16 capitals or digits, and long hexadecimal values that are assigned to
    a credential word.
    """
    issued = F.rlike("value", F.lit("^AKIA[A-Z0-9]{16}$"))
    context = F.concat_ws(" ", ascii_lower(F.col("before")), ascii_lower(F.col("glue")))
    named = F.rlike(context, F.lit("(" + "|".join(KEYWORDS) + r")\s*[=:]\s*[\"']?$"))
    return (issued | (named & F.rlike("value", F.lit("^[0-9a-f]+$")))).cast("int")


def fit(findings: DataFrame, max_findings: int = MAX_FINDINGS, trees: int = 20, depth: int = 6, seed: int = 5):
    """The forest learned from described findings with ``label`` 0 or 1; None where a label is missing."""
    order = F.xxhash64(F.lit(73), "key", "word", "nth")
    part = lambda y: (
        findings.where(F.col("label") == y).orderBy(order, "key", "word", "nth", "value").limit(max_findings)
    )
    sample = materialize(part(0).unionByName(part(1)).select("label", *FEATURES), "findings")
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, maxBins=64,
        cacheNodeIds=False,
    )
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample))


def scored(found: DataFrame, model) -> DataFrame:
    """Adds ``score``, the forest's probability that a candidate is a secret."""
    if model is None:
        return found.withColumn("score", F.lit(1.0))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
    return model.transform(ready).withColumn("score", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def scan(
    docs: DataFrame,
    labels: DataFrame | None = None,
    threshold: float = 0.5,
    key: str = "doc_id",
    text: str = "text",
    path: str = "source",
) -> DataFrame:
    """``key, path, word, nth, value, before, after, glue, score`` of every finding kept.

    ``labels`` are reviewed findings ``key, word, nth, label``; without them the
    formats label four documents in five.
    """
    found = materialize(candidates(docs, key, text, path), "candidates")
    logs, bits = corpus_tables(docs, text)
    ready = materialize(described(found, logs, bits), "described-candidates")
    if labels is None:
        learn = F.col("key").isNotNull() & (F.crc32(F.col("key").cast("string").cast("binary")) % 5 != 0)
        findings = ready.where(learn).withColumn("label", format_label())
    else:
        findings = ready.join(labels.select("key", "word", "nth", "label"), ["key", "word", "nth"])
    return scored(ready, fit(findings)).where(F.col("score") >= threshold)
