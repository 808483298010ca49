"""Finding benchmark passages in documents by winnowing.

The fingerprint of ``WINDOW`` successive words is the smallest digest of the
``GRAM``-word grams in it, the first one of equal ones.  A text's fingerprints are the
grams so chosen, with their positions.  Any span of ``WINDOW`` shared words chooses the
same gram in both texts, so a join on fingerprints misses no such span.  A fingerprint
travels with the words around it, as far as a window can reach.  A joined hit is
extended word by word to both sides, and counts if it reaches a window's length.  An
item shorter than a window is one gram of its own length.  Grams and words are
compared by 128 bits of digest.

Before the join, documents' fingerprints pass a bitmap made from the benchmark's, of
at least sixteen bits a fingerprint up to ``MOST_BITS``: it never loses one, and a
still larger benchmark only makes it let more through.

Rules for unusual rows: a null text has no words; an item without words is never
found; a null id is an ordinary value (a null item counts as an item named
``null``); repeated document rows each get a result; with an empty benchmark every
document is clean; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.llm.bytesets import U64, Prefix, byte_values, chunks, mixed
from tidepanel.llm.common import digest, text_of
from tidepanel.sources.sinks import materialize

WINDOW, GRAM = 10, 8
#: How far a window that holds a gram can reach beyond it, to either side.
REACH = WINDOW - GRAM
#: Usual and most bits of a bitmap, powers of two; it travels as bits / 64 numbers.
BITS, MOST_BITS = 1 << 23, 1 << 26

#: Bytes of words: digits, lower-case letters (after lower-casing A-Z), all beyond ASCII.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
LETTERS = byte_values(1), byte_values(2)
STEP = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
PREFIX = Prefix()


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two digests of every word of the texts in turn, and the number of words of each text."""
    raw = [x.encode() for x in texts]
    data = FOLD[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    edge = np.flatnonzero(np.diff(IN_WORD[data].astype(np.int8), prepend=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    length = (end - start).astype(U64)
    both = [
        mixed(PREFIX.ranges(PREFIX.sums(data, v), start, end) + length * STEP[0]) for v in LETTERS
    ]
    ends = np.cumsum([len(x) + 1 for x in raw])
    upto = np.searchsorted(start, ends)
    return both[0], both[1], np.diff(upto, prepend=0)


def grams(w: np.ndarray, k: int, step: np.uint64) -> np.ndarray:
    """Digest of every run of ``k`` successive words."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out = out * step + w[j : j + n]
    return mixed(out)


def chosen(x: np.ndarray, k: int) -> np.ndarray:
    """Position of the smallest, first of equal ones, of every ``k`` successive values."""
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, at = x[:n].copy(), np.arange(n)
    for j in range(1, k):
        less = x[j : j + n] < low
        low[less] = x[j : j + n][less]
        at[less] = np.flatnonzero(less) + j
    return at


def fitting(counts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of ``n`` starts over the joined words have ``k`` words within their own text."""
    ok = np.ones(n, bool)
    ends = np.cumsum(counts)
    for back in range(1, k):
        at = ends - back
        ok[at[(at >= ends - counts) & (at < n)]] = False
    return ok


def surroundings(
    digests: tuple[np.ndarray, np.ndarray], at: np.ndarray, low: np.ndarray, high: np.ndarray, outside: int
) -> np.ndarray:
    """Digests of the words before a gram, nearest first, and of those behind it, one row per gram.

    The gram's text is ``low`` to ``high``; beyond it stands ``outside``.
    """
    offsets = np.array([-1 - i for i in range(REACH)] + [GRAM + i for i in range(REACH)])
    pos = at[:, None] + offsets
    inside = (pos >= low[:, None]) & (pos < high[:, None])
    pos[~inside] = 0
    return np.concatenate([np.where(inside, d[pos], U64(outside)) for d in digests], axis=1)


def fingerprints(texts: list[str], lengths: list[int] | None, bitmap: np.ndarray | None):
    """Words of each text, and for each length the chosen grams of its windows.

    Grams: length, text index, start, two digests, surroundings.  Without ``lengths`` the
    texts are items: a text has windows of one length only, its own if it is short.
    """
    first, second, counts = words(texts)
    begin = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(texts)), counts)
    out = []
    for k in lengths or range(1, WINDOW + 1):
        n = max(len(first) - k + 1, 0)
        ok = fitting(counts, k, n)
        if lengths is None:
            ok &= np.minimum(counts, WINDOW)[owner[:n]] == k
        size = GRAM if k == WINDOW else k
        one = grams(first, size, STEP[0])
        at = chosen(one, REACH + 1) if k == WINDOW else np.arange(n)
        at = np.unique(at[ok])
        if bitmap is not None:
            bit = one[at] & U64(64 * len(bitmap) - 1)
            at = at[(bitmap[bit >> U64(6)] >> (bit & U64(63)) & U64(1)).astype(bool)]
        own = owner[at]
        around = np.zeros((len(at), 0), U64)
        if k == WINDOW:
            # what lies outside a document never equals what lies outside an item
            around = surroundings(
                (first, second), at, begin[own], begin[own] + counts[own], 1 if lengths is None else 0
            )
        out.append((k, own, at - begin[own], one[at], grams(second, size, STEP[1])[at], around))
    return counts, out


def _batches(schema: pa.Schema, columns: list) -> Iterator[pa.RecordBatch]:
    for low in range(0, max(len(columns[0]), 1), 50_000):
        yield pa.record_batch([c[low : low + 50_000] for c in columns], schema=schema)


FIELDS = "row_key {0}, content long, n_words long, start int, len int, fp long, fp2 long, around array<long>"


def _scan(rows: DataFrame, lengths: list[int] | None, bitmap: np.ndarray | None) -> DataFrame:
    """One row per text with its number of words, and one row per fingerprint (``n_words`` null).

    ``rows``: ``row_key, content, body``; for ``lengths`` see :func:`fingerprints`.
    """
    kind = rows.schema["row_key"].dataType.simpleString()
    key_type = pa.int64() if kind in ("bigint", "int") else pa.string()
    numbers = pa.list_(pa.int64())
    schema = pa.schema(
        [("row_key", key_type), ("content", pa.int64()), ("n_words", pa.int64()), ("start", pa.int32()),
         ("len", pa.int32()), ("fp", pa.int64()), ("fp2", pa.int64()), ("around", numbers)]
    )

    def texts_of(keys, content, counts):
        n = len(content)
        empty = [pa.nulls(n, f.type) for f in list(schema)[3:]]
        return _batches(schema, [keys, pa.array(content), pa.array(counts, pa.int64()), *empty])

    def grams_of(keys, content, k, own, start, one, two, around):
        n, width = around.shape
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
        signed = [pa.array(x.view(np.int64)) for x in (one, two)]
        near = pa.ListArray.from_arrays(offsets, pa.array(around.reshape(-1).view(np.int64)))
        return _batches(
            schema,
            [keys.take(pa.array(own)), pa.array(content[own]), pa.nulls(n, pa.int64()),
             pa.array(start, pa.int32()), pa.array(np.full(n, k), pa.int32()), *signed, near],
        )

    def scan(batches):
        for batch in batches:
            keys, content = batch.column(0).cast(key_type), np.asarray(batch.column(1))
            texts = batch.column(2).to_pylist()
            for low, high in chunks(texts):
                own, codes = keys[low:high], content[low:high]
                counts, found = fingerprints(texts[low:high], lengths, bitmap)
                yield from texts_of(own, codes, counts)
                for k, who, *rest in found:
                    if len(who):
                        yield from grams_of(own, codes, k, who, *rest)

    return rows.mapInArrow(scan, FIELDS.format("long" if key_type == pa.int64() else "string"))


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    body = text_of(text)
    return df.select(F.col(key).alias("row_key"), digest(body, 1).alias("content"), body.alias("body"))


def item_fingerprints(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """``item, len, fp, fp2, around``, each fingerprint of an item with each of its surroundings once."""
    return (
        _scan(_rows(benchmark, key, text), None, None)
        .where(F.col("n_words").isNull())
        .select(F.coalesce(F.col("row_key").cast("string"), F.lit("null")).alias("item"),
                "len", "fp", "fp2", "around")
        .distinct()
    )


def bitmap_bits(n: int) -> int:
    """Bits for ``n`` fingerprints: sixteen each, within the bounds, as a power of two."""
    return min(max(1 << (16 * n - 1).bit_length(), BITS), MOST_BITS)


def bitmap_of(items: DataFrame, bits: int = BITS) -> np.ndarray:
    """The bitmap of all fingerprints, put together on the executors."""
    bit = F.col("fp").bitwiseAND(F.lit(bits - 1))
    filled = (
        items.select((F.shiftright(bit, 6)).alias("at"), F.expr("shiftleft(1L, int(fp & 63))").alias("one"))
        .groupBy("at")
        .agg(F.bit_or("one").alias("bits"))
        .toArrow()  # at most bits / 64 rows
    )
    out = np.zeros(bits >> 6, np.int64)
    out[filled["at"].to_numpy()] = filled["bits"].to_numpy()
    return out.view(U64)


def extended(hits: DataFrame) -> DataFrame:
    """Hits with ``end``, and ``start`` moved to the left; those short of a window leave.

    ``near`` are the surroundings in the document, ``around`` those in the item.
    """

    def equal(i: int) -> Column:
        both = (F.get("near", F.lit(j)) == F.get("around", F.lit(j)) for j in (i, i + 2 * REACH))
        return next(both) & next(both)

    def run(places: range) -> Column:
        length = F.lit(0)
        for i in reversed(places):
            length = F.when(equal(i), length + 1).otherwise(0)
        return length

    long_ = F.col("len") == WINDOW
    reached = hits.withColumns(
        {
            "left": F.when(long_, run(range(REACH))).otherwise(0),
            "right": F.when(long_, run(range(REACH, 2 * REACH))).otherwise(0),
            "size": F.when(long_, GRAM).otherwise(F.col("len")),
        }
    )
    return reached.where(F.col("left") + F.col("size") + F.col("right") >= F.col("len")).select(
        "row_key", "content", "place",
        (F.col("start") - F.col("left")).alias("start"),
        (F.col("start") + F.col("size") + F.col("right")).alias("end"),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Documents ``row_key, content, n_words, n_hit, items`` and the hit spans.

    ``n_hit`` counts words inside any benchmark window, ``items`` holds the sorted names
    of the items found.  Spans: ``row_key, content, start, end``, in words, maximal.
    """
    items = materialize(item_fingerprints(benchmark, item_key, item_text), "benchmark-fingerprints")
    lengths = sorted(r["len"] for r in items.select("len").distinct().collect())  # at most WINDOW rows
    marks = bitmap_of(items, bitmap_bits(items.select("fp").distinct().count()))
    scanned = materialize(
        _scan(_rows(docs, key, text), lengths or [WINDOW], marks), "document-fingerprints"
    )
    found = scanned.where(F.col("n_words").isNull()).drop("n_words").withColumnRenamed("around", "near")
    # items share passages: a hit is extended once for all items with the same place
    on, place = ["len", "fp", "fp2"], ["len", "fp", "fp2", "around"]
    places = materialize(
        items.select(*place).distinct().withColumn("place", F.monotonically_increasing_id()), "places"
    )
    met = materialize(extended(found.join(places, on)), "hits")
    hits = met.select("row_key", "content", "start", "end").distinct()
    by_text = Window.partitionBy("row_key", "content").orderBy("start", "end")
    reached = F.max("end").over(by_text.rowsBetween(Window.unboundedPreceding, -1))
    spans = (
        hits.withColumn("reached", reached)
        .withColumn("opens", (F.col("reached").isNull() | (F.col("start") > F.col("reached"))).cast("int"))
        .withColumn("run", F.sum("opens").over(by_text))
        .groupBy("row_key", "content", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("run")
    )
    hit_words = spans.groupBy("row_key", "content").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    names = (
        met.select("row_key", "content", "place")
        .distinct()
        .join(places.join(items, place).select("place", "item"), "place")
        .select("row_key", "content", "item")
        .distinct()
        .groupBy("row_key", "content")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    both = hit_words.join(
        names,
        hit_words["row_key"].eqNullSafe(names["row_key"]) & (hit_words["content"] == names["content"]),
    ).select(hit_words["row_key"].alias("k"), hit_words["content"].alias("c"), "n_hit", "items")
    marks = scanned.where(F.col("n_words").isNotNull()).select("row_key", "content", "n_words")
    documents = marks.join(
        both, marks["row_key"].eqNullSafe(both["k"]) & (marks["content"] == both["c"]), "left"
    ).select(
        "row_key", "content", "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    return documents, spans
