"""Removing repeated word passages by anchors on fixed blocks.

A window of ``n`` words always holds a whole block of ``b = (n + 1) // 2`` words whose
place in its document is a multiple of ``b``.  So the index takes only the
non-overlapping blocks of each document, and every rolling run of ``b`` words probes it.

Pass 1 (anchors).  Blocks and probes meet in buckets by digest, 5 bytes each.  A digest is
active for a document if a document with a smaller id has it as a block, or if it is the
first to have it as a block and a later document probes it.  A chance match of short
digests only adds a candidate.

Pass 2 (extension).  Around every active block the windows that contain it are taken up on
either side: candidates.  They meet in buckets again, with 128-bit digests of all their
words, and those whose words also start in a smaller document are repeats.  Overlapping
repeats make the maximal spans.

Rows that meet inside one batch are settled there: of a passage that a third of all
documents share, a batch sends what its first documents have, not a row per document.
What the buckets answer is sent back by row key, never gathered.

Rules for unusual rows: a null text has no words; texts under ``n`` words have no window;
ids are integers, a null id is smaller than all others; repeated ids never remove each
other's words; equal rows share their result and all stay; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.bytesets import CHUNK, U64, Prefix, byte_values, mixed
from tidepanel.llm.common import text_of
from tidepanel.sources.sinks import materialize

WINDOW = 13
#: Bytes of text settled together, and bytes of text for one bucket.
SETTLE = 3 << 20
BUCKET = 16 << 20
GOLDEN = U64(0x9E3779B97F4A7C15)
LETTERS = byte_values(13), byte_values(14)
PREFIX = Prefix()
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Order of a null id.
FIRST = -(1 << 63)
TAG_BITS = 39


def word_ranges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of the bytes."""
    blank = np.ones(len(data) + 2, np.int8)
    blank[1:-1] = BLANK[data]
    edge = np.diff(blank)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def slices(data: np.ndarray, size: int = CHUNK):
    """Consecutive ranges of about ``size`` bytes that end behind a blank."""
    low = 0
    while low < len(data):
        high, step = min(low + size, len(data)), size
        while high < len(data) and not BLANK[data[high - 1]]:
            after = np.flatnonzero(BLANK[data[high : high + step]])
            high = high + int(after[0]) + 1 if len(after) else min(high + step, len(data))
        yield low, high
        low = high


def word_digests(data: np.ndarray, seeds: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
    """Start of every word, and its digests under so many seeds."""
    begins, found = [], [[] for _ in range(seeds)]
    for low, high in slices(data):
        part = data[low:high]
        start, end = word_ranges(part)
        begins.append(start + low)
        length = (end - start).astype(U64) * GOLDEN
        for out, values in zip(found, LETTERS):
            out.append(mixed(PREFIX.ranges(PREFIX.sums(part, values), start, end) + length))
    none = np.zeros(0, U64)
    return np.concatenate([np.zeros(0, np.int64), *begins]), [np.concatenate([none, *x]) for x in found]


def run_digests(words: np.ndarray, n: int) -> np.ndarray:
    """Digest of every ``n`` successive words."""
    if len(words) < n:
        return np.zeros(0, U64)
    up, down = PREFIX.powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])


class Batch:
    """Texts in the order of their ids, joined by blanks: words, owners, ranks of ids."""

    def __init__(self, bodies: list[bytes], order: np.ndarray, seeds: int) -> None:
        size = np.array([len(x) + 1 for x in bodies])
        ends = np.cumsum(size)
        data = np.frombuffer(b" ".join(bodies) + b" ", np.uint8)
        start, self.words = word_digests(data, seeds)
        self.owner = np.searchsorted(ends, start, side="right")
        self.first = np.searchsorted(self.owner, np.arange(len(bodies) + 1))
        self.rank = np.unique(order, return_inverse=True)[1]

    def starts(self, n: int) -> np.ndarray:
        """Which words begin a run of ``n`` words inside one text."""
        count = len(self.owner) - n + 1
        if count <= 0:
            return np.zeros(0, bool)
        return self.owner[:count] == self.owner[n - 1 :]


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new value begins in any of the sorted columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """A number for each distinct row of the sorted columns."""
    new = np.zeros(len(columns[0]), np.int64)
    new[_runs(*columns)] = 1
    return np.cumsum(new)


def _answers(group: np.ndarray, order: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries sorted by group: which are active, and which lie behind the group's first block.

    ``block`` marks entries that the index holds; others only probe it.
    """
    if not len(group):
        return np.zeros(0, bool), np.zeros(0, bool)
    at = _runs(group)
    number = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(np.append(at, len(group))))
    first = np.minimum.reduceat(np.where(block, order, np.iinfo(np.int64).max), at)
    several = np.maximum.reduceat(order, at) > first
    known = np.logical_or.reduceat(block, at)
    behind = known[number] & (order > first[number])
    return behind | (block & several[number] & (order == first[number])), behind


ROW = pa.schema(
    [("bucket", pa.int32()), ("keys", pa.binary()), ("docs", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())),
     ("counts", pa.list_(pa.int32())), ("done", pa.bool_())]
)
ROW_DDL = "bucket int, keys binary, docs array<long>, rows array<long>, counts array<int>, done boolean"
FOUND = "row long, key long, keys array<long>"
FOUND_SCHEMA = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("keys", pa.list_(pa.int64()))])


def _lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.append(cuts, len(values)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _sent(bucket, raw, owner, docs, rows, done):
    """Arrow rows, one per bucket: raw keys and, in runs, whose they are; entries sorted by bucket and owner."""
    if not len(bucket):
        return
    at = _runs(bucket)
    ends = np.append(at[1:], len(bucket))
    own = _runs(bucket, owner)
    inside = np.searchsorted(own, at)
    counts = np.diff(np.append(own, len(bucket)))
    who = owner[own]
    columns = [
        pa.array(bucket[at], pa.int32()),
        pa.array([raw[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()),
        _lists(docs[who], inside, pa.int64()),
        _lists(rows[who], inside, pa.int64()),
        _lists(counts, inside, pa.int32()),
        pa.array(np.full(len(at), done)),
    ]
    whole = pa.record_batch(columns, schema=ROW)
    for i in range(0, len(whole), 64):
        yield whole.slice(i, 64)


def _settled(active, keys, owner, docs, rows, buckets):
    """Rows of what a batch has answered itself; they travel by the row they belong to."""
    who, key = owner[active], keys[active]
    bucket = (mixed(rows[who].view(U64)) % U64(buckets)).astype(np.int64)
    order = np.lexsort((key, who, bucket))
    who, key, bucket = who[order], key[order], bucket[order]
    raw = key.view(np.uint8).reshape(-1, 8)
    yield from _sent(bucket, raw, who, docs, rows, True)


def _bytes_of(keys: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :width]


def _wide(raw: bytes, width: int) -> np.ndarray:
    cells = np.frombuffer(raw, np.uint8).reshape(-1, width)
    out = np.zeros((len(cells), 8), np.uint8)
    out[:, :width] = cells
    return out.view(U64).ravel()


def short_keys(runs: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 39 bits of a digest in one number."""
    tag = (runs // U64(buckets)) & U64((1 << TAG_BITS) - 1)
    return (runs % U64(buckets)) << U64(TAG_BITS) | tag


def _in_order(batch: pa.RecordBatch):
    """The batch by id, null first, and ranges of rows with about SETTLE bytes of text."""
    batch = batch.take(pc.sort_indices(batch, sort_keys=[("doc", "ascending")], null_placement="at_start"))
    size = np.cumsum(np.asarray(pc.binary_length(batch.column("body")), np.int64))
    cuts = np.unique(np.searchsorted(size, np.arange(SETTLE, size[-1] if len(size) else 0, SETTLE))) + 1
    cuts = [0, *cuts.tolist(), len(batch)]
    for low, high in zip(cuts, cuts[1:]):
        if low < high:
            part = batch.slice(low, high - low)
            order = np.asarray(pc.fill_null(part.column("doc"), FIRST), np.int64)
            yield part, order, np.asarray(part.column("row"), np.int64)


def probe(rows: DataFrame, window: int, buckets: int) -> DataFrame:
    """Pass 1: ``row, keys`` of the active blocks of each row."""
    block = (window + 1) // 2

    def scan(batches):
        for batch in batches:
            for picked, docs, keys_of in _in_order(batch):
                part = Batch(picked.column("body").to_pylist(), docs, 1)
                runs = short_keys(run_digests(part.words[0], block), buckets)
                long_enough = np.diff(part.first) >= window
                at = np.flatnonzero(part.starts(block) & long_enough[part.owner[: len(runs)]])
                owner, key = part.owner[at], runs[at]
                fixed = (at - part.first[owner]) % block == 0
                by = np.argsort(key, kind="stable")  # owners stay in order
                key, owner, fixed = key[by], owner[by], fixed[by]
                own = _runs(key, owner)
                if not len(own):
                    continue
                fixed = np.logical_or.reduceat(fixed, own)
                key, owner = key[own], owner[own]
                active, behind = _answers(key, part.rank[owner], fixed)
                yield from _settled(active, key, owner, docs, keys_of, buckets)
                key, owner, fixed = key[~behind], owner[~behind], fixed[~behind]
                bucket = (key >> U64(TAG_BITS)).astype(np.int64)
                by = np.lexsort((owner, bucket))
                tag = (key & U64((1 << TAG_BITS) - 1)) << U64(1) | fixed.astype(U64)
                yield from _sent(bucket[by], _bytes_of(tag[by], 5), owner[by], docs, keys_of, False)

    def answer(batches):
        yield from _answer(batches, 5)

    sent = rows.mapInArrow(scan, ROW_DDL)
    return sent.repartitionById(buckets, F.col("bucket")).mapInArrow(answer, FOUND)


def _answer(batches, width: int):
    """All rows of a bucket: the active entries, one row each; those settled before pass through."""
    tags, more, whose, docs, rows = [], [], [], [], []
    bucket, seen = None, 0
    for batch in batches:
        for i in range(len(batch)):
            keys, counts = batch.column(1)[i].as_py(), np.asarray(batch.column(4)[i].values)
            doc, row = np.asarray(batch.column(2)[i].values), np.asarray(batch.column(3)[i].values)
            if batch.column(5)[i].as_py():
                yield from _found(row, np.frombuffer(keys, np.int64), counts)
                continue
            bucket = batch.column(0)[i].as_py()
            if width == 5:
                tags.append(_wide(keys, 5))
            else:
                pair = np.frombuffer(keys, U64).reshape(-1, 2)
                tags.append(pair[:, 0].copy())
                more.append(pair[:, 1].copy())
            whose.append(np.repeat(np.arange(seen, seen + len(doc), dtype=np.int32), counts))
            seen += len(doc)
            docs.append(doc)
            rows.append(row)
    if not tags:
        return
    tag, who = np.concatenate(tags), np.concatenate(whose)
    doc, row = np.concatenate(docs), np.concatenate(rows)
    del tags, whose, docs, rows
    if width == 5:
        by = np.argsort(tag >> U64(1), kind="stable")
        tag, who = tag[by], who[by]
        del by
        active, _ = _answers(tag >> U64(1), doc[who], (tag & U64(1)).astype(bool))
        key = tag[active] >> U64(1) | U64(bucket) << U64(TAG_BITS)
    else:
        other = np.concatenate(more)
        del more
        by = np.lexsort((other, tag))
        tag, other, who = tag[by], other[by], who[by]
        del by
        group = _numbered(tag, other)
        del other
        _, active = _answers(group, doc[who], np.ones(len(who), bool))
        key = tag[active]
    yield from _found(row[who[active]], key.view(np.int64))


def _found(row: np.ndarray, key: np.ndarray, counts: np.ndarray | None = None):
    """Arrow rows ``row, key``, or ``row, keys`` where so many keys each belong to a row."""
    if counts is None:
        columns = [pa.array(row), pa.array(key), pa.nulls(len(row), pa.list_(pa.int64()))]
    else:
        columns = [pa.array(row), pa.nulls(len(row), pa.int64()), _lists(key, np.cumsum(counts) - counts, pa.int64())]
    out = pa.record_batch(columns, schema=FOUND_SCHEMA)
    for i in range(0, len(out), 100_000):
        yield out.slice(i, 100_000)


def _listed(found: DataFrame) -> DataFrame:
    """``row, keys``: all keys of each row."""
    alone, several = F.collect_list("key"), F.flatten(F.collect_list("keys"))
    return found.groupBy("row").agg(F.concat(alone, several).alias("keys"))


def extend(rows: DataFrame, active: DataFrame, window: int, buckets: int) -> DataFrame:
    """Pass 2: ``row, keys`` of the windows of each row that repeat a smaller document."""
    block = (window + 1) // 2
    wanted = rows.join(_listed(active), "row").select("doc", "row", "body", "keys")

    def scan(batches):
        for batch in batches:
            for picked, docs, keys_of in _in_order(batch):
                part = Batch(picked.column("body").to_pylist(), docs, 2)
                known = picked.column("keys").flatten().to_numpy(zero_copy_only=False)
                runs = short_keys(run_digests(part.words[0], block), buckets).view(np.int64)
                hits = np.isin(runs, known)
                inside = part.starts(window)
                if not len(inside):
                    continue
                seen = np.concatenate([[0], np.cumsum(hits)])
                span = window - block + 1
                at = np.flatnonzero(inside & (seen[span : span + len(inside)] > seen[: len(inside)]))
                one, two = (run_digests(w, window)[at] for w in part.words)
                owner = part.owner[at]
                by = np.lexsort((owner, two, one))
                one, two, owner = one[by], two[by], owner[by]
                fresh = _runs(one, two, owner)
                one, two, owner = one[fresh], two[fresh], owner[fresh]
                group = _numbered(one, two)
                _, behind = _answers(group, part.rank[owner], np.ones(len(group), bool))
                yield from _settled(behind, one, owner, docs, keys_of, buckets)
                one, two, owner = (x[~behind] for x in (one, two, owner))
                bucket = (mixed(two) % U64(buckets)).astype(np.int64)
                by = np.lexsort((owner, bucket))
                raw = np.stack([one[by], two[by]], axis=1).view(np.uint8)
                yield from _sent(bucket[by], raw, owner[by], docs, keys_of, False)

    def answer(batches):
        yield from _answer(batches, 16)

    sent = wanted.mapInArrow(scan, ROW_DDL)
    return sent.repartitionById(buckets, F.col("bucket")).mapInArrow(answer, FOUND)


def _kept(body: bytes, gone: np.ndarray | None) -> bytes:
    """Words that stay, joined by one space."""
    data, out, seen = np.frombuffer(body, np.uint8), [], 0
    for low, high in slices(data):
        words = body[low:high].split()
        if gone is not None:
            mask = gone[seen : seen + len(words)]
            seen += len(words)
            words = [w for w, g in zip(words, mask) if not g]
        if words:
            out.append(b" ".join(words))
    return b" ".join(out)


def remove_passages(
    docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc, n_words, spans, kept``: removed word ranges ``start, end`` and the words that stay."""
    body = text_of(text)
    rows = docs.select(
        F.col(key).cast("long").alias("doc"),
        F.xxhash64(F.lit(131), F.col(key), body).alias("row"),
        body.cast("binary").alias("body"),
    )
    volume = docs.agg(F.sum(F.octet_length(body))).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, -(-volume // BUCKET))
    active = materialize(probe(rows, window, buckets), "passages-active")
    found = materialize(extend(rows, active, window, buckets), "passages-found")
    wanted = rows.join(_listed(found), "row", "left").select("doc", "row", "body", "keys")

    def cut(batches):
        schema = pa.schema(
            [("doc", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())),
             ("ends", pa.list_(pa.int64())), ("kept", pa.string())]
        )
        for batch in batches:
            for low in range(0, len(batch), 500):  # few texts at once
                part, out = batch.slice(low, 500), []
                for doc, body, keys in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3)):
                    if not keys.is_valid:
                        kept = _kept(body, None)
                        out.append((doc, kept.count(b" ") + 1 if kept else 0, [], [], kept.decode()))
                        continue
                    _, (words,) = word_digests(np.frombuffer(body, np.uint8))
                    hit = np.isin(run_digests(words, window).view(np.int64), np.asarray(keys.values))
                    at = np.flatnonzero(hit)
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + window, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                    spans = np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()
                    out.append((doc, len(words), *spans, _kept(body, gone).decode()))
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)

    done = wanted.mapInArrow(
        cut, "doc long, n_words long, starts array<long>, ends array<long>, kept string"
    )
    spans = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))
    removed = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return done.select("doc", "n_words", removed.alias("n_removed"), spans.alias("spans"), "kept")
