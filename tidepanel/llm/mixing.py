"""Mixing sources to target weights, in blocks of a fixed number of words.

Each source is one long stream of words: its documents in pseudorandom order, cut
into blocks of ``block`` words.  The mix is a set of slots.  A source gets so many
slots as its target needs.  How many of them each output shard gets is drawn first, as
a multinomial count, and a shard's slots of a source are the next so many numbers.
Slot ``k`` of a source takes the block to which a pseudorandom permutation of the
source's block numbers sends ``k``.  One pass over the permutation uses every block
once, a second pass (another permutation) uses it twice.  Slots and blocks meet by
block number.

The draw of counts is the multinomial one under the condition that totals over all
shards meet the targets, so a small source misses its target by no more than
rounding to blocks.

Rules for unusual rows: a null text or one of blanks has size 0 and is never taken;
a null source is a source of its own, last in order; repeated rows are separate
documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.llm.common import cell_count, text_of
from tidepanel.sources.sinks import materialize

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK = 128
#: Rounds of the permutation; each sends about half of the numbers elsewhere.
ROUNDS = 24
#: So many slots are made from one row, and from so many rows in one task.
SPAN = 4096
SPANS_A_TASK = 16
MOST_TASKS = 20_000


def word_count(c: Column) -> Column:
    """Number of maximal runs of characters other than ASCII blanks."""
    return F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+"))


def sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``key, source, sk, size``; ``sk`` is a source key without nulls."""
    name = F.col(source).cast("string")
    return docs.select(
        F.col(key).alias("key"),
        name.alias("source"),
        F.coalesce(F.concat(F.lit("="), name), F.lit("null")).alias("sk"),
        word_count(text_of(text)).cast("long").alias("size"),
    )


def source_targets(
    per_source: DataFrame, weights: Sequence[float], share: float, most: float
) -> DataFrame:
    """Adds ``weight`` and ``target`` to one row per source with ``source, source_size``.

    ``share`` times all words are dealt by weight; no source gets over ``most`` times
    its size, and what is left over goes to the others by weight until none is above.
    Sources are few: the windows here run over one row each.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per_source.withColumn(
        "weight",
        F.element_at(listed, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1),
    ).withColumns(
        {
            "cap": F.col("source_size") * F.lit(float(most)),
            "words": F.sum("source_size").over(everything) * F.lit(float(share)),
        }
    )
    # in order of cap per weight, those that reach their cap come first
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(0, Window.unboundedFollowing)
    leveled = ranked.withColumns(
        {
            "nth": F.row_number().over(order),
            "level": (F.col("words") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
            / F.sum("weight").over(later),
        }
    )
    free = F.when(F.col("cap") / F.col("weight") > F.col("level"), F.struct("nth", "level"))
    return (
        leveled.withColumn("first_free", F.min(free).over(everything))
        .withColumn(
            "target",
            F.when(
                F.col("first_free").isNull() | (F.col("nth") < F.col("first_free.nth")), F.col("cap")
            ).otherwise(F.col("first_free.level") * F.col("weight")),
        )
        .drop("cap", "words", "nth", "level", "first_free")
    )


def streams(rows: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """Documents placed on their source's stream, and totals per source.

    A source is cut into cells by hash of the key.  Offsets add up within a cell and
    start after the earlier cells, so a source that holds most rows is many tasks' work.
    Documents: ``sk, cell, nth, key, size, start``; totals: ``sk, source, source_size``.
    """
    cells = cell_count(count, 1)
    cut = rows.withColumn("cell", F.pmod(F.xxhash64(F.lit(11), F.col("key")), F.lit(cells)))
    summed = materialize(
        cut.groupBy("sk", "source", "cell").agg(F.sum("size").alias("words")), "mix-cells"
    )
    before = Window.partitionBy("sk").orderBy("cell")
    starts = summed.select(
        "sk", "cell", (F.sum("words").over(before) - F.col("words")).alias("cell_start")
    )
    totals = summed.groupBy("sk", "source").agg(F.sum("words").alias("source_size"))
    inside = Window.partitionBy("sk", "cell").orderBy(
        F.xxhash64(F.lit(13), F.col("key")), F.col("key").asc_nulls_first(), "size"
    )
    placed = (
        cut.withColumns(
            {"nth": F.row_number().over(inside), "end": F.sum("size").over(
                inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            )}
        )
        .join(starts, ["sk", "cell"])
        .select(
            "sk", "cell", "nth", "key", "size",
            (F.col("cell_start") + F.col("end") - F.col("size")).alias("start"),
        )
    )
    return placed, totals


def permuted(k: Column, n: Column, seed: Sequence[Column], rounds: int = ROUNDS) -> Column:
    """Where a pseudorandom permutation of 0..n-1 sends ``k``; any n, no search.

    Swap-or-not shuffle: each round pairs x with (K - x) mod n and swaps the pair or
    leaves it by one pseudorandom bit of the pair, so each round is its own inverse.
    """

    def step(x, r):
        partner = F.pmod(F.xxhash64(*seed, r) - x, n)
        swap = F.xxhash64(*seed, r, F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), k, step)


def in_spans(ranges: DataFrame, first: Column, n: Column) -> DataFrame:
    """Rows with every number ``k`` from ``first`` on, ``n`` in all, dealt to many tasks in spans."""
    total = ranges.agg(F.sum(n)).first()[0] or 0
    # a few small rows grow into much work, which their size does not tell Spark
    tasks = min(max(-(-total // (SPAN * SPANS_A_TASK)), 1), MOST_TASKS)
    last = F.floor((n - 1) / SPAN).cast("long")
    spans = ranges.where(n > 0).withColumn("span", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    upto = first + F.least((F.col("span") + 1) * SPAN, n) - 1
    return (
        spans.repartition(tasks, *spans.columns)
        .withColumn("k", F.explode(F.sequence(first + F.col("span") * SPAN, upto)))
        .drop("span")
    )


def shard_counts(plan: DataFrame, shards: int, seed: int) -> DataFrame:
    """``sk, blocks, out_shard, n, first``: the multinomial draw of each source.

    ``n`` slots of the source fall on the shard, and they are numbered from ``first``.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(17), "sk", "k"), F.lit(shards)).cast("int")
    drawn = materialize(
        in_spans(plan.select("sk", "blocks", "slots"), F.lit(0).cast("long"), F.col("slots"))
        .groupBy("sk", "blocks", draw.alias("out_shard"))
        .agg(F.count(F.lit(1)).alias("n")),
        "mix-counts",
    )
    # a source has one row per shard here
    upto = Window.partitionBy("sk").orderBy("out_shard")
    return drawn.withColumn("first", F.sum("n").over(upto) - F.col("n"))


def mix_slots(counts: DataFrame, seed: int) -> DataFrame:
    """``sk, k, out_shard, pass, block`` for every slot of the mix, from :func:`shard_counts`."""
    slots = in_spans(counts, F.col("first"), F.col("n")).withColumn(
        "pass", F.floor(F.col("k") / F.col("blocks")).cast("long")
    )
    return slots.select(
        "sk", "k", "pass", "out_shard",
        permuted(
            F.pmod(F.col("k"), F.col("blocks")), F.col("blocks"),
            (F.lit(seed), F.col("sk"), F.col("pass")),
        ).alias("block"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    block: int = BLOCK,
    shards: int = 24,
    seed: int = 7,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with what the mix takes of them, the slots, and the pieces.

    Documents: ``key, size, sk, source_size, target, taken``.  Slots: see
    :func:`mix_slots`.  Pieces: ``sk, block, key, first_word, words``, the part of a
    document that lies in a block; joined to the slots on ``sk, block`` they spell out
    the mix, shard by shard.
    """
    rows = materialize(sized(docs, key, text, source), "mix-sizes")
    placed, totals = streams(rows, rows.count())
    placed = materialize(placed, "mix-streams")
    targets = source_targets(totals, weights, share, most)
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    plan = materialize(
        targets.withColumn("blocks", blocks).withColumn(
            "slots",
            F.when(
                F.col("source_size") > 0,
                F.round(F.col("target") * F.col("blocks") / F.col("source_size")),
            )
            .otherwise(0)
            .cast("long"),
        ),
        "mix-plan",
    )
    counts = materialize(shard_counts(plan, shards, seed), "mix-draw")
    slots = mix_slots(counts, seed)
    first = F.floor(F.col("start") / block).cast("long")
    last = F.floor((F.col("start") + F.col("size") - 1) / block).cast("long")
    low = F.greatest("start", F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    pieces = (
        placed.where(F.col("size") > 0)
        .withColumn("block", F.explode(F.sequence(first, last)))
        .select(
            "sk", "block", "cell", "nth", "key",
            (low - F.col("start")).alias("first_word"),
            (high - low).alias("words"),
        )
    )
    # grows with the documents: never broadcast
    drawn = slots.groupBy("sk", "block").agg(F.count(F.lit(1)).alias("copies")).hint("merge")
    taken = (
        pieces.join(drawn, ["sk", "block"])
        .groupBy("sk", "cell", "nth")
        .agg(F.sum(F.col("words") * F.col("copies")).alias("taken"))
    )
    # a cell of a source meets its totals, so that no task holds a whole source
    listed = (
        placed.select("sk", "cell")
        .distinct()
        .join(plan.select("sk", "source_size", "target"), "sk")
    )
    documents = (
        placed.join(taken, ["sk", "cell", "nth"], "left")
        .join(listed, ["sk", "cell"])
        .select(
            "key", "size", "sk", "source_size", "target",
            F.coalesce("taken", F.lit(0).cast("long")).alias("taken"),
        )
    )
    return documents, slots, pieces.drop("cell", "nth")
