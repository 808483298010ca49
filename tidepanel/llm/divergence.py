"""How far the sources of a language differ in the words they use.

Counting.  Every Arrow batch goes through one columnar pipeline: ``ascii_lower``,
``split_pattern_regex``, ``dictionary_encode`` and a hash ``group_by`` per (language,
source, term).  What leaves a task are partial counts with the number of its rows that
hold the term.

Shares.  Merged counts are cut into shards by a digest of the term; a shard is a matrix of
its terms by all sources of the language.  With ``count`` occurrences in a group whose kept
terms occur ``N`` times, and ``V`` kept terms, a term's share is
``1 + floor(scale * (count + 5) / (N + 5 * V))``, in integers throughout.

Divergences.  Each shard adds up the absolute differences of every pair of its sources and
offers its best terms of each source; sums and ranks over shards are small.

Rules for unusual rows: null text, language and source are empty strings; every row is a
document of its own, repeated ids too; a group without terms takes part in all pairs; a
language without kept terms has pairs of value 0; an empty table gives an empty result;
ties rank by the UTF-8 bytes of the item; other columns are ignored.  Exact up to 9 * 10**15
term occurrences in a language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.llm.common import digest
from tidepanel.sources.sinks import materialize

#: Everything but ASCII letters and characters beyond ASCII separates terms.
SEPARATOR = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
PRIOR = 5
MIN_DOCS = 30
TOP = 50
#: Bytes of text that go through the pipeline at once, and cells (terms by sources) of one shard.
SLICE = 4 << 20
SHARD_CELLS = 250_000
#: Partial counts are merged within a task whenever so many have come together.
MERGE_ROWS = 500_000

COUNTS = "lang string, source string, term string, n long, docs long"


def _filled(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.string()), "")


def _slices(text: pa.Array):
    """Ranges of rows with about SLICE bytes of text."""
    size = np.cumsum(np.asarray(pc.binary_length(text), np.int64))
    low = 0
    while low < len(text):
        before = size[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(size, before + SLICE, "right")))
        yield low, high
        low = high


def batch_counts(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """``lang, source, term, n, docs`` of the rows of one batch."""
    code, first = _coded(lang, source)
    words = pc.split_pattern_regex(pc.ascii_lower(text), pattern=SEPARATOR)
    row = pc.list_parent_indices(words)
    coded = pc.list_flatten(words).dictionary_encode()
    group = pa.array(code).take(row)
    table = pa.table({"group": group, "row": row, "code": coded.indices})
    per_row = table.group_by(["group", "row", "code"], use_threads=False).aggregate([([], "count_all")])
    summed = per_row.group_by(["group", "code"], use_threads=False).aggregate(
        [("count_all", "sum"), ([], "count_all")]
    )
    at = pa.array(first).take(summed["group"].combine_chunks())
    out = pa.table(
        {
            "lang": lang.take(at),
            "source": source.take(at),
            "term": coded.dictionary.take(summed["code"].combine_chunks()),
            "n": summed["count_all_sum"].cast(pa.int64()),
            "docs": summed["count_all"].cast(pa.int64()),
        }
    )
    return out.filter(pc.not_equal(out["term"], ""))


def _coded(lang: pa.Array, source: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's (lang, source), and the row where each number stands first."""
    lang, source = lang.dictionary_encode(), source.dictionary_encode()
    both = np.asarray(lang.indices, np.int64) * (len(source.dictionary) + 1) + np.asarray(source.indices)
    _, first, code = np.unique(both, return_index=True, return_inverse=True)
    return code.astype(np.int32), first


def _merged(tables: list[pa.Table]) -> pa.Table:
    return (
        pa.concat_tables(tables)
        .group_by(["lang", "source", "term"], use_threads=False)
        .aggregate([("n", "sum"), ("docs", "sum")])
        .rename_columns(["lang", "source", "term", "n", "docs"])
    )


def partial_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """Counts of each task, one row per (lang, source, term) for every few hundred thousand."""

    def scan(batches):
        held, rows = [], 0
        for batch in batches:
            body, where, which = (_filled(c) for c in batch.columns)
            for low, high in _slices(body):
                part = slice(low, high)
                held.append(batch_counts(where[part], which[part], body[part]))
                rows += len(held[-1])
                if rows > MERGE_ROWS:
                    held = [_merged(held)]
                    if len(held[0]) > MERGE_ROWS // 2:
                        yield from held[0].to_batches(max_chunksize=100_000)
                        held = []
                    rows = sum(map(len, held))
        if held:
            yield from _merged(held).to_batches(max_chunksize=100_000)

    picked = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    return picked.mapInArrow(scan, COUNTS)


def term_counts(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and rows that hold the term."""
    return (
        partial_counts(docs, text, lang, source)
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * (count + PRIOR) / total)`` by long division in digits of base 1000."""
    rest, out = (count + PRIOR) % total, (count + PRIOR) // total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _shard(key: tuple, table: pa.Table, top: int) -> pa.Table:
    """Pair sums and best terms of one shard: its terms by all sources of the language."""
    heads = table.filter(pc.is_null(table["term"]))
    cells = table.filter(pc.is_valid(table["term"]))
    names = heads["source"].combine_chunks()
    order = pc.sort_indices(names)
    names, totals = names.take(order), np.asarray(heads["total"].combine_chunks().take(order))
    whole = heads["lang_total"][0].as_py()
    coded = cells["term"].combine_chunks().dictionary_encode()
    counts = np.zeros((len(coded.dictionary), len(names)), np.int64)
    counts[np.asarray(coded.indices), np.asarray(pc.index_in(cells["source"], names))] = np.asarray(cells["n"])
    own = shares(counts, totals[None, :]) if len(counts) else counts
    lang = shares(counts.sum(axis=1), np.int64(whole)) if len(counts) else counts.sum(axis=1)
    columns = {"source": [], "part": [], "item": [], "value": []}

    def emit(source: int, part: str, items: pa.Array, values: np.ndarray) -> None:
        columns["source"].append(pa.array([names[source].as_py()] * len(items), pa.string()))
        columns["part"].append(pa.array([part] * len(items), pa.string()))
        columns["item"].append(items)
        columns["value"].append(pa.array(values, pa.int64()))

    for s in range(len(names)):
        others = np.flatnonzero(np.arange(len(names)) != s)
        far = np.abs(own - own[:, s : s + 1]).sum(axis=0)
        emit(s, "pair", names.take(pa.array(others)), far[others])
        above = np.flatnonzero((counts[:, s] > 0) & (own[:, s] > lang))
        if len(above):
            found = pa.table(
                {"item": coded.dictionary.take(pa.array(above)), "value": own[above, s] - lang[above]}
            )
            best = pc.sort_indices(found, sort_keys=[("value", "descending"), ("item", "ascending")])
            found = found.take(best[:top])
            emit(s, "term", found["item"].combine_chunks(), np.asarray(found["value"]))
    n = sum(map(len, columns["item"]))
    joined = {k: pa.concat_arrays(v) for k, v in columns.items()}
    return pa.table({"lang": pa.array([key[0].as_py()] * n, pa.string()), **joined})


def audit(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    top: int = TOP,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for all pairs of sources and the top terms."""
    counts = materialize(term_counts(docs, text, lang, source), "terms")
    listed = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))
    listed = listed.where(F.col("docs") >= min_docs).select("lang", "term")
    kept = materialize(counts.join(listed, ["lang", "term"]).select("lang", "source", "term", "n"), "kept-terms")

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(empty(lang).alias("lang"), empty(source).alias("source")).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    size = listed.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    whole = kept.groupBy("lang").agg(F.sum("n").alias("all"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    heads = (
        groups.join(sums, ["lang", "source"], "left").join(size, "lang", "left").join(whole, "lang", "left")
        .select(
            "lang", "source",
            (zero("n") + PRIOR * zero("v")).alias("total"),
            (zero("all") + PRIOR * zero("v")).alias("lang_total"),
            zero("v").alias("v"),
        )
    )
    heads = materialize(heads, "term-totals")
    size = heads.groupBy("lang").agg((F.max("v") * F.count(F.lit(1))).alias("cells"))
    shards = max(1, -(-(size.agg(F.max("cells")).first()[0] or 0) // SHARD_CELLS))
    cells = kept.select(
        "lang", F.pmod(digest(F.col("term"), 111), F.lit(shards)).cast("int").alias("shard"), "source", "term", "n",
        F.lit(None).cast("long").alias("total"), F.lit(None).cast("long").alias("lang_total"),
    )
    everywhere = heads.select(
        "lang", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "source",
        F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "total", "lang_total",
    )
    found = (
        cells.unionByName(everywhere)
        .groupBy("lang", "shard")
        .applyInArrow(
            lambda key, t: _shard(key, t, top),
            "lang string, source string, part string, item string, value long",
        )
    )
    merged = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = merged.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
