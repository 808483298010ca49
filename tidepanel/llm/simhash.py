"""Near-duplicates by SimHash, found with pivot distance tables.

A fingerprint has 64 bits; a bit is set if it is set in over half of the XXH64
digests of the text's word shingles.  Texts whose fingerprints differ in at most
``max_bits`` bits are linked.

Equal fingerprints are one node.  Nodes meet in buckets: the 64 bits are cut into
``max_bits + 2`` blocks, and two fingerprints within ``max_bits`` agree in at least two
whole blocks, so each pair of blocks gives a bucket key and no link is missed.
Inside a bucket each fingerprint has a row of Hamming distances to reference
fingerprints.  By the triangle inequality no coordinate of linked fingerprints
differs by more than ``max_bits``; pairs that do are discarded, the others are
verified on all 64 bits.  A large bucket is dealt out as pairs of parts.  A task
reports the links of its bucket as a spanning forest, which keeps the components.

Rules for unusual rows: a null, empty or blank text has fingerprint zero and is
linked like any other; a null id never names a component unless it is alone with
null ids; repeated rows each get a result; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import text_of
from tidepanel.llm.components import components
from tidepanel.sources.sinks import materialize

SHINGLE, MAX_BITS = 3, 3
SEED = 42
#: Fingerprints of a bucket that are compared in one task; larger buckets are dealt out.
PART = 1024
#: Reference fingerprints of the distance tables.
PIVOTS = 16
#: Buckets up to this size are compared many at once.
SMALL = 32


def simhash(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one text."""
    words = (text or "").encode().lower().split()  # bytes: ASCII blanks, A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    one = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    digests = np.array([one(joined[s:e], seed) for s, e in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for low in range(0, len(digests), 1 << 16):
        part = np.ascontiguousarray(digests[low : low + (1 << 16)].astype(">u8")).view(np.uint8)
        ones += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = ones * 2 > len(digests)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(
    docs: DataFrame, size: int = SHINGLE, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, fp`` for every row, ``fp`` as a signed 64-bit number."""
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("body"))
    kind = rows.schema["key"].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            out = np.array([simhash(x, size) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.record_batch(
                [batch.column(0), pa.array(out.view(np.int64))], names=["key", "fp"]
            )

    return rows.mapInArrow(scan, f"key {kind}, fp long")


def blocks(max_bits: int) -> list[tuple[int, int]]:
    """Shift and width of ``max_bits + 2`` blocks that cover 64 bits."""
    n = max_bits + 2
    edges = [64 * i // n for i in range(n + 1)]
    return [(low, high - low) for low, high in zip(edges, edges[1:])]


def bucketed(nodes: DataFrame, max_bits: int) -> DataFrame:
    """``bucket, fp``: each fingerprint in the bucket of every pair of blocks."""
    keys = []
    for i, (one, other) in enumerate(combinations(blocks(max_bits), 2)):
        part = [
            F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)) for low, width in (one, other)
        ]
        # two blocks have under 56 bits together: the pair's number fits in front
        keys.append(
            F.lit(i << 56).bitwiseOR(F.shiftleft(part[0], other[1])).bitwiseOR(part[1])
        )
    return nodes.select("fp", F.explode(F.array(*keys)).alias("bucket"))


def dealt(rows: DataFrame) -> DataFrame:
    """``bucket, one, two, fp``: a bucket over ``PART`` is cut into parts that meet pairwise.

    A fingerprint goes to every pair of parts its own part belongs to.  Buckets of one
    fingerprint have nothing to compare and leave.
    """
    sizes = materialize(
        rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "bucket-sizes"
    )
    parts = F.ceil(F.col("n") / PART).cast("int")
    own = F.pmod(F.xxhash64(F.lit(31), "fp"), F.col("parts")).cast("int")
    meets = F.sequence(F.lit(0), F.col("parts") - 1)
    return (
        rows.join(sizes.select("bucket", parts.alias("parts")), "bucket")
        .withColumn("own", own)
        .select("bucket", "fp", "own", F.explode(meets).alias("other"))
        .select(
            "bucket", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "fp"
        )
    )


def bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def references(n: int = PIVOTS) -> np.ndarray:
    """Fixed pseudorandom reference fingerprints."""
    return np.array([xxhash.xxh64_intdigest(f"reference {i}".encode(), SEED) for i in range(n)], np.uint64)


def linked(fps: np.ndarray, max_bits: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked index pairs of one bucket, by its pivot distance table."""
    distance = bit_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)
    order = np.argsort(distance[:, 0], kind="stable")
    fps, distance = fps[order], distance[order]
    first = distance[:, 0]
    upto = np.searchsorted(first, first + max_bits, side="right")
    left, right = [], []
    for i in range(len(fps) - 1):
        table = distance[i + 1 : upto[i]]
        near = np.flatnonzero((np.abs(table - distance[i]) <= max_bits).all(axis=1)) + i + 1
        near = near[bit_count(fps[near] ^ fps[i]) <= max_bits]
        left.append(np.full(len(near), i))
        right.append(near)
    if not left:
        return np.zeros(0, int), np.zeros(0, int)
    return order[np.concatenate(left)], order[np.concatenate(right)]


def small_linked(fps, distance, segment, sizes, max_bits):
    """Linked index pairs of many small buckets that lie one after the other."""
    left, right = [], []
    at = np.flatnonzero(sizes[segment] > 1)
    for shift in range(1, int(sizes.max(initial=1))):
        at = at[at + shift < len(fps)]
        at = at[segment[at + shift] == segment[at]]
        if not len(at):
            break
        near = at[(np.abs(distance[at] - distance[at + shift]) <= max_bits).all(axis=1)]
        near = near[bit_count(fps[near] ^ fps[near + shift]) <= max_bits]
        left.append(near)
        right.append(near + shift)
    if not left:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(left), np.concatenate(right)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links member to smallest member that join the same nodes as the given pairs."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        if (root == before).all():
            break
    member = np.flatnonzero(root != np.arange(n))
    return member, root[member]


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` with the components of all links."""
    rows = dealt(materialize(bucketed(nodes, max_bits), "buckets"))
    order = ["bucket", "one", "two", "fp"]
    # every reference is shipped with the function: a fixed number of numbers
    sorted_rows = rows.repartition("bucket", "one", "two").sortWithinPartitions(*order)
    pivots = references()

    def solve(bucket, one, two, fps):
        new = (np.diff(bucket) != 0) | (np.diff(one) != 0) | (np.diff(two) != 0)
        segment = np.concatenate([[0], np.cumsum(new)])
        sizes = np.bincount(segment)
        ends = np.cumsum(sizes)
        distance = bit_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)
        pairs = [small_linked(fps, distance, segment, np.where(sizes <= SMALL, sizes, 1), max_bits)]
        for s in np.flatnonzero(sizes > SMALL):
            low = ends[s] - sizes[s]
            i, j = linked(fps[low : ends[s]], max_bits, pivots)
            pairs.append((i + low, j + low))
        member, root = forest(len(fps), *(np.concatenate(x) for x in zip(*pairs)))
        out = np.unique(np.stack([fps[root], fps[member]]).view(np.int64), axis=1)
        return pa.record_batch([pa.array(out[0]), pa.array(out[1])], names=["a", "b"])

    def scan(batches):
        held = None  # the last bucket of a batch may go on in the next
        for batch in batches:
            cols = [np.asarray(batch.column(i)) for i in range(4)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not len(cols[0]):
                continue
            same = np.ones(len(cols[0]), bool)
            for c in cols[:3]:
                same &= c == c[-1]
            cut = len(same) - np.argmin(same[::-1]) if not same.all() else 0
            held = [c[cut:] for c in cols]
            if cut:
                yield solve(*(c[:cut] for c in cols[:3]), cols[3][:cut].view(np.uint64))
        if held is not None and len(held[0]):
            yield solve(*held[:3], held[3].view(np.uint64))

    return sorted_rows.mapInArrow(scan, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    size: int = SHINGLE,
    max_bits: int = MAX_BITS,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``key, fp, component``: the smallest key linked to a row, directly or over others."""
    rows = materialize(fingerprints(docs, size, key, text), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("key").alias("least")), "nodes")
    roots = components(links(nodes, max_bits)).withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    # copies of one text share a fingerprint: names go to nodes first, then to rows
    labels = materialize(named.join(smallest, "root").select("fp", "component"), "labels")
    return spread(rows, labels)


def spread(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with the label of their fingerprint; fingerprints of many rows are broadcast.

    At most ten thousand fingerprints can each hold over a ten-thousandth of all rows.
    """
    common = max(rows.count() // 10_000, 1)
    often = rows.groupBy("fp").count().where(F.col("count") > common).select("fp")
    marked = labels.join(often.withColumn("often", F.lit(True)), "fp", "left")
    hot = marked.where("often").drop("often")
    cold = marked.where("often IS NULL").drop("often")
    return rows.join(F.broadcast(hot), "fp").unionByName(rows.join(cold, "fp")).select(
        "key", "fp", "component"
    )
