"""Removing lines that many documents repeat, with levelled sorted runs of line digests.

The state is a set of runs, tables ``h1, h2, n_docs, last`` sorted by digest: in how
many documents of the run's batches a key occurs and which is the largest of them.
A batch of documents is merge-anti-joined with the runs: keys that already have
enough documents, a later one among them, add nothing and leave.  What remains
becomes a run of level 0.  When a level holds ``fanout`` runs they are merged into
one run of the next level, so a key is rewritten once per level only.

A key is a line stripped of ASCII blanks and with A-Z lower-cased, known by 128 bits
of digest.

Rules for unusual rows: a null or empty text is one empty line; a null id counts as
one document that is smaller than all others; rows that repeat an id are one
document for counting and keep their own lines; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import BLANKS, ascii_lower, digest, text_of
from tidepanel.sources.sinks import materialize

MIN_CHARS = 20
MIN_DOCS = 3


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def split_lines(c: Column) -> Column:
    return F.split(c, "\n")


def keyed_lines(docs: DataFrame, batches: int, min_chars: int, key: str, text: str) -> DataFrame:
    """``batch, key, content, pos, h1, h2`` of every line whose key is long enough."""
    body = text_of(text)
    keys = F.transform(
        split_lines(body), lambda x, i: F.struct(line_key(x).alias("k"), i.alias("pos"))
    )
    exploded = docs.select(
        F.pmod(F.xxhash64(F.lit(19), F.col(key)), F.lit(batches)).cast("int").alias("batch"),
        F.col(key).alias("key"),
        digest(body, 1).alias("content"),
        F.explode(F.filter(keys, lambda x: F.char_length(x["k"]) >= min_chars)).alias("x"),
    )
    return exploded.select(
        "batch", "key", "content", F.col("x.pos").alias("pos"),
        digest(F.col("x.k"), 21).alias("h1"), digest(F.col("x.k"), 22).alias("h2"),
    )


class LineRuns:
    """Levelled sorted runs; each run is a table in the shared folder."""

    def __init__(self, fanout: int = 2, min_docs: int = MIN_DOCS):
        self.fanout, self.min_docs = fanout, min_docs
        self.levels: list[list[DataFrame]] = []

    def _write(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        ordered = run.repartition("h1", "h2").sortWithinPartitions("h1", "h2")
        self.levels[level].append(materialize(ordered, f"line-run-{level}"))

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def merged(self) -> DataFrame | None:
        """All runs as one: documents add up, the largest id stays."""
        if not (runs := self.runs()):
            return None
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return _fold(out)

    def add(self, batch: DataFrame) -> None:
        """Adds the keys of a batch ``h1, h2, key``; no document may come in two batches."""
        once = batch.groupBy("h1", "h2", "key").agg(F.lit(1).alias("one"))
        new = once.groupBy("h1", "h2").agg(
            F.count(F.lit(1)).alias("n_docs"), F.max("key").alias("last")
        )
        known = self.merged()
        if known is not None:
            settled = known.where(F.col("n_docs") >= self.min_docs).select(
                F.col("h1").alias("s1"), F.col("h2").alias("s2"), F.col("last").alias("s_last")
            )
            no_later = F.col("last").isNull() | (F.col("s_last") >= F.col("last"))
            new = new.join(
                settled,
                (new["h1"] == settled["s1"]) & (new["h2"] == settled["s2"]) & no_later,
                "left_anti",
            )
        self._write(new, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            out = self.levels[level][0]
            for run in self.levels[level][1:]:
                out = out.unionByName(run)
            self.levels[level] = []
            self._write(_fold(out), level + 1)
            level += 1


def _fold(runs: DataFrame) -> DataFrame:
    return runs.groupBy("h1", "h2").agg(
        F.sum("n_docs").alias("n_docs"), F.max("last").alias("last")
    )


def dropped_lines(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """Lines of ``repeated`` keys (``h1, h2, n_docs, last``) outside the largest document.

    Keys in over a ten-thousandth of all lines number at most ten thousand, so they are
    broadcast; the others are joined by shuffle and none of them is large.
    """
    common = max(lines.count() // 10_000, 1)
    often = repeated.where(F.col("n_docs") > common).select("h1", "h2", "last")
    rare = repeated.where(F.col("n_docs") <= common).select("h1", "h2", "last")
    earlier = F.col("key").isNull() & F.col("last").isNotNull() | (F.col("key") < F.col("last"))
    found = lines.join(F.broadcast(often), ["h1", "h2"]).unionByName(
        lines.join(rare, ["h1", "h2"])
    )
    return found.where(earlier)


def dedup_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = 4,
    fanout: int = 2,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``key, n_lines, n_dropped, kept`` of every document, ``kept`` being its text without dropped lines."""
    lines = materialize(
        keyed_lines(docs, batches, min_chars, key, text), "lines", partition_by=["batch"]
    )
    runs = LineRuns(fanout, min_docs)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch))
    repeated = materialize(
        runs.merged().where(F.col("n_docs") >= min_docs), "repeated-lines"
    )
    gone = (
        dropped_lines(lines, repeated)
        .groupBy(F.col("key").alias("g_key"), F.col("content").alias("g_content"))
        .agg(F.collect_set("pos").alias("gone"))
    )
    body = text_of(text)
    whole = docs.select(F.col(key).alias("key"), body.alias("body"), digest(body, 1).alias("content"))
    joined = whole.join(
        gone,
        whole["key"].eqNullSafe(gone["g_key"]) & (whole["content"] == gone["g_content"]),
        "left",
    )
    all_lines = split_lines(F.col("body"))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.transform(
        F.array_except(every, F.col("gone")), lambda i: F.element_at(F.col("lines"), i + 1)
    )
    return joined.withColumn("lines", all_lines).select(
        "key",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("body"))
        .otherwise(F.array_join(kept, "\n"))
        .alias("kept"),
    )
