"""Removing repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through ``depth`` bytes, most significant digit first;
suffixes that are equal through all digits are the repeated windows, and every window
but the earliest of its group is covered for removal.

Pass 1.  The first digit of a window is its *anchor*: the ``depth / 2``-byte gram with
the smallest digest in it (the leftmost of equal ones).  It depends on the window's
bytes alone, so equal windows share it, and neighbouring windows mostly have the same
one: they travel as one row ``(gram, context)``, the context being the digest of all
bytes that the row's windows cover.  A gram that occurs once ends the sort for its
windows.  Rows with equal gram and context are settled together: all but the earliest
are repeats as a whole.

Pass 2.  Where a gram occurs in several contexts, the earliest row of each context is
ordered by the remaining digit, window by window, on 128-bit digests.  The earliest
window of a group is always in such a row, so nothing else needs a second pass.

Before each shuffle equal rows of one batch are settled on the spot, so a passage that
a third of all documents share is sent once per batch, not once per document.

Rules for unusual rows: a null text is empty; texts under ``depth`` bytes have no
windows; a null id is smaller than all others; rows that repeat an id are ordered by a
64-bit digest of their text, and equal rows count as one and share their result; ids are
integers; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.llm.bytesets import U64, Prefix, byte_values, chunks, mixed
from tidepanel.llm.common import digest, text_of
from tidepanel.sources.sinks import materialize

DEPTH = 100
#: Bytes of text whose rows are settled together before a shuffle.
SETTLE = 8 << 20
GOLDEN = U64(0x9E3779B97F4A7C15)
LETTERS = byte_values(3), byte_values(4)
PREFIX = Prefix()
#: ``at`` packs start and number of windows; this number marks a settled span.
COUNT_BITS = 20
SPAN = (1 << COUNT_BITS) - 1
POSITION = U64((1 << 24) - 1)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every ``n`` successive values, in about log n passes."""
    out, width = x, 1
    while width * 2 <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    if width < n:
        rest = n - width
        out = np.minimum(out[:-rest], out[rest:])
    return out


def anchors(texts: list[bytes], depth: int):
    """Rows of successive windows with one anchor: text index, start, windows, gram, context."""
    size = np.array([len(x) for x in texts])
    ends = np.cumsum(size)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n, gram = len(data), depth // 2
    if n < depth:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, U64)] * 2
    sums = PREFIX.sums(data, LETTERS[0])
    _, down = PREFIX.powers(n)
    grams = mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    valid = np.ones(n, bool)
    for back in range(1, depth):  # windows must end within their own text
        at = ends - back
        valid[at[at >= ends - size]] = False
    starts = np.flatnonzero(valid[: n - depth + 1])
    if n <= int(POSITION):
        place = (grams & ~POSITION) | np.arange(len(grams), dtype=U64)
        anchor = (sliding_min(place, depth - gram + 1)[starts] & POSITION).astype(np.int64)
    else:  # one very long text: the same rule, without packing
        masked = grams & ~POSITION
        smallest = sliding_min(masked, depth - gram + 1)
        anchor = np.zeros(len(starts), np.int64) - 1
        for shift in range(depth - gram, -1, -1):
            anchor[masked[starts + shift] == smallest[starts]] = shift
        anchor += starts
    if not len(starts):
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, U64)] * 2
    opens = np.flatnonzero(np.diff(anchor, prepend=-1) | (np.diff(starts, prepend=-2) != 1))
    first, anchor = starts[opens], anchor[opens]
    count = np.diff(np.append(opens, len(starts)))
    shape = count.astype(U64) * U64(SPAN) + (anchor - first).astype(U64)
    context = mixed(PREFIX.ranges(sums, first, first + count + depth - 1) + shape * GOLDEN)
    owner = np.searchsorted(ends, first, side="right")
    return owner, first - (ends - size)[owner], count, grams[anchor], context


def joined_spans(owner: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Spans of each text, sorted and with those that touch made one."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    big = int(end.max()) + 1
    reach = np.maximum.accumulate(end + owner * big)
    opens = np.ones(len(owner), bool)
    opens[1:] = start[1:] + owner[1:] * big > reach[:-1]
    at = np.flatnonzero(opens)
    last = reach[np.append(at[1:], len(owner)) - 1]
    return owner[at], start[at], last - owner[at] * big


def repeats_of(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which rows equal an earlier one in both digests."""
    both = mixed(one + mixed(two))
    order = np.argsort(both, kind="stable")
    same = np.zeros(len(one), bool)
    same[1:] = (both[order][1:] == both[order][:-1])
    same[1:] &= (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    out = np.zeros(len(one), bool)
    out[order] = same
    return out


def packed(start: np.ndarray, count) -> np.ndarray:
    return start << COUNT_BITS | count


START, COUNT = f"cast(shiftright(at, {COUNT_BITS}) as int)", f"cast(at & {SPAN} as int)"
ROW = pa.schema([(c, pa.int64()) for c in ("one", "two", "doc", "row", "at")])
ROW_DDL = "one long, two long, doc long, row long, at long"


def _emit(doc: pa.Array, row, owner, start, count, one, two, settled):
    """Rows for the shuffle; settled ones become spans under keys of their own."""
    who, low, high = joined_spans(owner[settled], start[settled], (start + count)[settled])
    keep = ~settled
    owner, start, count, one, two = (x[keep] for x in (owner, start, count, one, two))
    own_key = mixed(mixed(row[who].view(U64) + GOLDEN * low.astype(U64)) + who.astype(U64))
    keys = np.concatenate([one.view(np.int64), own_key.view(np.int64)])
    others = np.concatenate([two.view(np.int64), high])
    at = np.concatenate([packed(start, count), packed(low, SPAN)])
    whose = np.concatenate([owner, who])
    docs, rows = doc.take(pa.array(whose)), row[whose]
    for i in range(0, len(keys), 100_000):
        part = slice(i, i + 100_000)
        yield pa.record_batch(
            [pa.array(keys[part]), pa.array(others[part]), docs[part], pa.array(rows[part]), pa.array(at[part])],
            schema=ROW,
        )


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc, row, body``: id, digest of the text, and the text's UTF-8 bytes."""
    body = text_of(text)
    return docs.select(
        F.col(key).cast("long").alias("doc"),
        digest(body, 41).alias("row"),
        body.cast("binary").alias("body"),
    )


def _in_order(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows by id (null first) and digest, so that earlier rows come first."""
    return batch.take(
        pc.sort_indices(
            batch, sort_keys=[("doc", "ascending"), ("row", "ascending")], null_placement="at_start"
        )
    )


def first_pass(rows: DataFrame, depth: int) -> DataFrame:
    """``doc, row, start, windows, end``: spans to remove, and rows for the second pass (``end`` null)."""

    def scan(batches):
        for batch in batches:
            batch = _in_order(batch)
            doc, row, bodies = batch.column(0), np.asarray(batch.column(1), np.int64), batch.column(2).to_pylist()
            for low, high in chunks(bodies, SETTLE):
                found = []
                for a, b in chunks(bodies[low:high]):
                    owner, *rest = anchors(bodies[low + a : low + b], depth)
                    found.append([owner + a, *rest])
                owner, start, count, gram, context = (np.concatenate(x) for x in zip(*found))
                again = repeats_of(gram, context)
                # a settled span reaches from its first window to the end of its last
                reach = np.where(again, count + depth - 1, count)
                yield from _emit(
                    doc[low:high], row[low:high], owner, start, reach, gram, context, again
                )

    sent = rows.mapInArrow(scan, ROW_DDL)
    order = ["two", F.col("doc").asc_nulls_first(), "row", "at"]
    by_gram = Window.partitionBy("one")
    ranked = sent.withColumns(
        {
            "before": F.lag("two").over(by_gram.orderBy(*order)),
            "several": F.min("two").over(by_gram) != F.max("two").over(by_gram),
        }
    ).withColumns({"windows": F.expr(COUNT), "repeat": F.col("before") == F.col("two")})
    span = F.col("windows") == SPAN
    repeat = F.coalesce("repeat", F.lit(False))
    return ranked.where(span | repeat | F.col("several")).select(
        "doc",
        "row",
        F.expr(START).alias("start"),
        "windows",
        F.when(span, F.col("two"))
        .when(repeat, F.expr(START) + F.col("windows") + (depth - 1))
        .cast("int")
        .alias("end"),
    )


def second_pass(rows: DataFrame, open_rows: DataFrame, depth: int) -> DataFrame:
    """``doc, row, start, end``: spans to remove among the windows left open by the first pass."""
    listed = open_rows.groupBy("doc", "row").agg(
        F.collect_list(F.struct("start", "windows")).alias("open")
    )
    wanted = _with(rows, listed, "inner").select(
        "doc", "row", "body", F.col("open.start").alias("starts"), F.col("open.windows").alias("counts")
    )

    def scan(batches):
        for batch in batches:
            batch = _in_order(batch)
            doc, row, bodies = batch.column(0), np.asarray(batch.column(1), np.int64), batch.column(2).to_pylist()
            starts, counts = batch.column(3), batch.column(4)
            for low, high in chunks(bodies):
                texts = bodies[low:high]
                data = np.frombuffer(b"".join(texts), np.uint8)
                base = np.cumsum([0] + [len(x) for x in texts])
                own, begin, n = [], [], []
                for i in range(low, high):
                    s, c = np.asarray(starts[i].values), np.asarray(counts[i].values)
                    own.append(np.full(len(s), i - low))
                    begin.append(s)
                    n.append(c)
                own, begin, n = (np.concatenate(x).astype(np.int64) for x in (own, begin, n))
                which = np.repeat(np.arange(len(n)), n)
                start = begin[which] + np.arange(len(which)) - (np.cumsum(n) - n)[which]
                owner = own[which]
                order = np.lexsort((start, owner))
                owner, start = owner[order], start[order]
                first = base[owner] + start
                one, two = (
                    mixed(PREFIX.ranges(PREFIX.sums(data, v), first, first + depth)) for v in LETTERS
                )
                again = repeats_of(one, two)
                reach = np.where(again, depth, 1)
                yield from _emit(doc[low:high], row[low:high], owner, start, reach, one, two, again)

    sent = wanted.mapInArrow(scan, ROW_DDL)
    by_window = Window.partitionBy("one", "two").orderBy(F.col("doc").asc_nulls_first(), "row", "at")
    ranked = sent.withColumns({"nth": F.row_number().over(by_window), "windows": F.expr(COUNT)})
    span = F.col("windows") == SPAN
    return ranked.where(span | (F.col("nth") > 1)).select(
        "doc",
        "row",
        F.expr(START).alias("start"),
        F.when(span, F.col("two")).otherwise(F.expr(START) + depth).cast("int").alias("end"),
    )


def _with(rows: DataFrame, listed: DataFrame, how: str) -> DataFrame:
    named = listed.withColumnsRenamed({"doc": "l_doc", "row": "l_row"})
    return rows.join(
        named, rows["doc"].eqNullSafe(named["l_doc"]) & (rows["row"] == named["l_row"]), how
    )


def remove_repeats(
    docs: DataFrame, depth: int = DEPTH, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc, n_bytes, spans, kept``: removed spans as ``start, end`` and the remaining bytes."""
    if not 1 < depth < SPAN:
        raise ValueError(f"depth must be between 2 and {SPAN - 1}")
    rows = _documents(docs, key, text)
    first = materialize(first_pass(rows, depth), "repeats-first")
    second = materialize(
        second_pass(rows, first.where(F.col("end").isNull()), depth), "repeats-second"
    )
    spans = (
        first.where(F.col("end").isNotNull())
        .select("doc", "row", "start", "end")
        .unionByName(second)
        .groupBy("doc", "row")
        .agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    )
    wanted = _with(rows, spans, "left").select("doc", "body", "starts", "ends")

    def cut(batches):
        schema = pa.schema(
            [("doc", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int32())),
             ("ends", pa.list_(pa.int32())), ("kept", pa.binary())]
        )
        for batch in batches:
            for low in range(0, len(batch), 500):  # few texts at once
                part = batch.slice(low, 500)
                out = []
                for body, s, e in zip(part.column(1).to_pylist(), part.column(2), part.column(3)):
                    if not s.is_valid:
                        out.append((len(body), [], [], body))
                        continue
                    s, e = np.asarray(s.values, np.int64), np.asarray(e.values, np.int64)
                    _, s, e = joined_spans(np.zeros(len(s), np.int64), s, e)
                    s, e = s.tolist(), e.tolist()
                    kept = b"".join(body[a:b] for a, b in zip([0, *e], [*s, len(body)]))
                    out.append((len(body), s, e, kept))
                columns = [part.column(0)] + [
                    pa.array(x, t) for x, t in zip(zip(*out), schema.types[1:])
                ]
                yield pa.record_batch(columns, schema=schema)

    done = wanted.mapInArrow(
        cut, "doc long, n_bytes long, starts array<int>, ends array<int>, kept binary"
    )
    return done.select(
        "doc", "n_bytes", F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")).alias("spans"), "kept"
    )
