"""Finding license texts: MinHash bands over overlapping windows, then exact containment.

A template of n words is looked for in windows of n words, at steps of n / 8; a text of
fewer words is one window.  A window's ``BANDS`` x ``ROWS`` MinHash values over its
five-word shingles retrieve the templates that share a band.  A window with 0.8 of the
template's shingles has a Jaccard similarity of at least 2/3 at best alignment and 0.55
at the worst step; with 24 bands of 2 it shares a band with probability
1 - (1 - 0.55^2)^24 > 0.9998.  Retrieved pairs are verified by exact containment: at least
``SHARE`` of the template's distinct shingles in the window, widened by half its length
on either side.

A window is sketched only if it can pass that check: the shingles of all templates are in
a bitmap, which never misses one, and the window, widened, must hold enough shingles
from it for the template of its size with the fewest.  It also carries these alone.

A template under five words has no shingle.  It is found as the exact run of its words.

Rules for unusual rows: a null or empty text has no windows and no findings; templates
that are null or without words are not looked for; templates of one name are variants,
and a place is reported once for all of them; a null name is a name; a null id is an
ordinary value; rows that repeat both id and text are reported once; an empty table or
template list gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.llm.bytesets import U64, chunks, mixed
from tidepanel.llm.common import digest, text_of
from tidepanel.llm.decontaminate import STEP, bitmap_of, fitting, grams, words
from tidepanel.llm.license_texts import TEXTS
from tidepanel.sources.sinks import materialize

SHINGLE, SHARE = 5, 0.8
BANDS, ROWS = 24, 2


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEXTS, "license string, text string")


def step_of(n: int) -> int:
    return max(1, n // 8)


def sketches(shingles: np.ndarray) -> np.ndarray:
    """Band keys of sets given as rows of shingle digests."""
    keys = []
    for band in range(BANDS):
        key = np.full(len(shingles), U64(band + 1))
        for row in range(ROWS):
            salt = mixed(np.array([band * ROWS + row + 1], U64) * STEP[0])
            key = mixed(key + mixed(shingles ^ salt).min(axis=1) * STEP[1])
        keys.append(key)
    return np.stack(keys, axis=1)


def lists(matrix_or_rows, kind=pa.int64()) -> pa.Array:
    return pa.array([np.asarray(r).view(np.int64) for r in matrix_or_rows], pa.list_(kind))


FIELDS = "content long, n int, start int, words int, bands array<long>, shingles array<long>"
TEMPLATE = "license string, template long, n int, bands array<long>, shingles array<long>, one long, two long"


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x).view(np.int64))


def template_sketches(found: DataFrame) -> DataFrame:
    """``TEMPLATE`` of every template that has words; short ones have digests ``one, two`` of all their words."""
    body = F.col("text").cast("string")
    rows = found.where(body.isNotNull()).select(F.col("license").cast("string"), digest(body, 1), body).distinct()

    def scan(batches):
        for batch in batches:
            for i, text in enumerate(batch.column(2).to_pylist()):
                first, second, _ = words([text])
                n = len(first)
                if not n:
                    continue
                s = np.unique(grams(first, SHINGLE, STEP[0]))
                bands = sketches(s[None, :])[0] if len(s) else s
                whole = [signed(grams(w, n, m)) if n < SHINGLE else pa.nulls(1, pa.int64())
                         for w, m in zip((first, second), STEP)]
                yield pa.record_batch(
                    [batch.column(0)[i : i + 1], batch.column(1)[i : i + 1], pa.array([n], pa.int32()),
                     lists([bands]), lists([s]), *whole],
                    names=["license", "template", "n", "bands", "shingles", "one", "two"],
                )

    return rows.mapInArrow(scan, TEMPLATE)


def in_bitmap(digests: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bit = digests & U64(64 * len(bitmap) - 1)
    return (bitmap[bit >> U64(6)] >> (bit & U64(63)) & U64(1)).astype(bool)


def window_starts(counts: np.ndarray, held: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and start of the windows of ``n`` words in texts that hold ``least`` known shingles or more.

    Windows start at multiples of the step and at the last word that has n words from it
    on; a shorter text has one.
    """
    step = step_of(n)
    texts = np.flatnonzero(held >= least)
    rest = np.maximum(counts[texts] - n, 0)
    many = rest // step + 2
    who = np.repeat(np.arange(len(texts)), many)
    start = (np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)) * step
    own = start < rest[who] + step
    return texts[who[own]], np.minimum(start, rest[who])[own]


def body_rows(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    body = text_of(text)
    rows = docs.select(F.col(key).alias("key"), digest(body, 1).alias("content"), body.alias("body"))
    return rows, rows.schema["key"].dataType.simpleString()


def window_sketches(docs: DataFrame, sizes: list[tuple[int, int]], bitmap: np.ndarray, key: str, text: str) -> DataFrame:
    """Sketched windows of the documents: ``key`` and ``FIELDS``.

    ``sizes`` are window lengths, each with the least number of known shingles that a
    widened window must hold.
    """
    rows, kind = body_rows(docs, key, text)
    names = ["key", "content", "n", "start", "words", "bands", "shingles"]

    def scan(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for low, high in chunks(texts):
                first, _, counts = words(texts[low:high])
                s = grams(first, SHINGLE, STEP[0])
                known = in_bitmap(s, bitmap) & fitting(counts, SHINGLE, len(s))
                if not known.any():
                    continue
                # known shingles before each position, and those themselves in turn
                upto, kept = np.concatenate([[0], np.cumsum(known)]), s[known]
                end = np.cumsum(counts)
                begin = end - counts
                held = upto[np.minimum(end, len(s))] - upto[np.minimum(begin, len(s))]
                own, content = batch.column(0)[low:high], np.asarray(batch.column(1)[low:high])
                for n, least in sizes:
                    who, start = window_starts(counts, held, n, least)
                    wide_low = begin[who] + np.maximum(start - n // 2, 0)
                    wide_high = begin[who] + np.minimum(counts[who], start + n + n // 2) - SHINGLE + 1
                    enough = upto[wide_high] - upto[wide_low] >= least
                    who, start = who[enough], start[enough]
                    inside = upto[wide_low[enough]], upto[wide_high[enough]]
                    length = np.minimum(counts[who], n)
                    for part in parts(length):
                        w, st = who[part], start[part]
                        width = length[part[0]] - SHINGLE + 1
                        keys = sketches(s[(begin[w] + st)[:, None] + np.arange(width)[None, :]])
                        wide = [np.unique(kept[x:y]) for x, y in zip(inside[0][part], inside[1][part])]
                        yield pa.record_batch(
                            [own.take(pa.array(w)), pa.array(content[w]), pa.array(np.full(len(w), n, np.int32)),
                             pa.array(st.astype(np.int32)), pa.array(length[part].astype(np.int32)),
                             lists(keys), lists(wide)],
                            names=names,
                        )

    return rows.mapInArrow(scan, f"key {kind}, {FIELDS}")


def parts(length: np.ndarray, cells: int = 1 << 20):
    """Index ranges of windows of one length whose shingles fill about ``cells`` together."""
    order = np.argsort(length, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
        if len(same):
            many = max(1, cells // int(length[same[0]]))
            yield from (same[a : a + many] for a in range(0, len(same), many))


def short_places(docs: DataFrame, sizes: list[int], bitmap: np.ndarray, key: str, text: str) -> DataFrame:
    """Runs of ``sizes`` words that may be a short template: ``key, content, n, start, one, two``."""
    rows, kind = body_rows(docs, key, text)

    def scan(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for low, high in chunks(texts):
                both = words(texts[low:high])
                counts = both[2]
                end = np.cumsum(counts)
                own, content = batch.column(0)[low:high], np.asarray(batch.column(1)[low:high])
                for n in sizes:
                    one, two = (grams(w, n, m) for w, m in zip(both, STEP))
                    at = np.flatnonzero(in_bitmap(one, bitmap) & fitting(counts, n, len(one)))
                    if not len(at):
                        continue
                    who = np.searchsorted(end, at, side="right")
                    yield pa.record_batch(
                        [own.take(pa.array(who)), pa.array(content[who]), pa.array(np.full(len(at), n, np.int32)),
                         pa.array((at - (end - counts)[who]).astype(np.int32)), signed(one[at]), signed(two[at])],
                        names=["key", "content", "n", "start", "one", "two"],
                    )

    return rows.mapInArrow(scan, f"key {kind}, content long, n int, start int, one long, two long")


def find_licenses(
    docs: DataFrame, known: DataFrame, share: float = SHARE, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, license, first_word, last_word, containment, best``: one row per license and place.

    A place is where windows of one license overlap, and shows the one with the largest
    share; copies nearer to each other than the template is long are one place.  Licenses
    with much text in common are found together; ``best`` marks those whose share no
    overlapping place exceeds.
    """
    wanted = materialize(template_sketches(known), "license-templates")
    least = wanted.groupBy("n").agg(F.min(F.size("shingles")).alias("fewest"))
    counts = sorted((r["n"], r["fewest"]) for r in least.collect())  # one per length of a template
    long = wanted.where(F.col("n") >= SHINGLE)
    sizes = [(n, max(1, math.ceil(share * k - 1e-9))) for n, k in counts if n >= SHINGLE]
    marks = bitmap_of(long.select(F.explode("shingles").alias("fp")))
    windows = materialize(window_sketches(docs, sizes, marks, key, text), "license-windows")
    band = lambda df: df.select("*", F.posexplode("bands").alias("band", "band_key")).drop("bands")
    right = band(long).select("license", "template", "n", "band", "band_key")
    met = (
        band(windows.drop("shingles"))
        .join(right, ["n", "band", "band_key"])
        .select("key", "content", "n", "start", "license", "template")
        .distinct()
        .withColumnsRenamed({"key": "k", "content": "c", "start": "s", "n": "m"})
    )
    pairs = windows.drop("bands").join(
        met,
        windows["key"].eqNullSafe(met["k"]) & (windows["content"] == met["c"])
        & (windows["n"] == met["m"]) & (windows["start"] == met["s"]),
    )
    theirs = long.select("template", F.col("shingles").alias("theirs")).dropDuplicates(["template"])
    shared = F.size(F.array_intersect("theirs", "shingles")) / F.size("theirs")
    place = ["key", "content", "license", "start", "end", "containment"]
    hits = (
        pairs.join(theirs, "template")
        .withColumns({"containment": shared, "end": F.col("start") + F.col("words")})
        .where(F.col("containment") >= share)
        .select(*place)
    )
    short = [n for n, _ in counts if n < SHINGLE]
    if short:
        brief = wanted.where(F.col("n") < SHINGLE).select("license", "n", "one", "two")
        marks = bitmap_of(brief.select(F.col("one").alias("fp")))
        exact = short_places(docs, short, marks, key, text).join(brief, ["n", "one", "two"])
        hits = hits.unionByName(
            exact.withColumns({"containment": F.lit(1.0), "end": F.col("start") + F.col("n")}).select(*place)
        )
    places = joined_windows(hits.distinct(), ["key", "content", "license"]).groupBy(
        "key", "content", "license", "place"
    )
    first = F.struct(-F.col("containment"), F.col("start"), F.col("end"))
    found = places.agg(
        F.min_by("start", first).alias("start"), F.min_by("end", first).alias("end"),
        F.max("containment").alias("containment"),
    ).drop("place")
    most = F.max("containment").over(Window.partitionBy("key", "content", "place"))
    return joined_windows(found, ["key", "content"]).select(
        "key", "license", F.col("start").alias("first_word"), (F.col("end") - 1).alias("last_word"), "containment",
        (F.col("containment") == most).alias("best"),
    )


def joined_windows(found: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``place``, a number that ``start`` to ``end`` windows share where they overlap."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("reached").isNull() | (F.col("start") >= F.col("reached")), 1).otherwise(0)
    return found.withColumn("reached", reached).withColumn("place", F.sum(opens).over(order)).drop("reached")
