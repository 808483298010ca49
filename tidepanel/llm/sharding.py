"""Sharding by fixed virtual slots.

Records are hashed into ``SLOTS`` virtual slots.  Bytes are summed per slot, and a
small versioned map says which shard each slot lives in.  A shard is looked up
through the map, so rebalancing edits a few map rows and leaves the hash alone.

Equal texts share a slot and thus a shard.  Only a text whose copies hold more than a
whole shard's fair share is cut, into the fewest pieces of at most a share, since no
balanced map exists otherwise; ``pieces`` says so.

Rules for unusual rows: a null text counts as empty (size ``overhead``); a null id
is an ordinary value; repeated rows each get a place, and rows that are equal in all
columns are told apart by the order in which they are read; an empty table gives an
empty result and a map whose slots are all empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.llm.common import cell_count, digest, text_of
from tidepanel.sources.sinks import materialize

SLOTS = 4096
OVERHEAD = 8


def records(
    docs: DataFrame, key: str = "doc_id", text: str = "text", carry: bool = False
) -> DataFrame:
    """One row per record: ``key, size, text_crc32, content, nth``; with ``carry`` also ``row``, all its columns.

    ``nth`` tells equal rows apart.
    """
    body = text_of(text)
    whole = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    return docs.select(
        *whole,
        F.col(key).alias("key"),
        (F.octet_length(body) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        digest(body, 1).alias("content"),
        F.monotonically_increasing_id().alias("nth"),
    )


#: A heavy text's copies are cut at so many places.
CUTS = 4096


def _cut_of(rows: DataFrame) -> DataFrame:
    """Adds ``cut``, a hash of the record."""
    return rows.withColumn("cut", F.pmod(F.xxhash64(F.lit(3), "key", "text_crc32", "nth"), F.lit(CUTS)).cast("int"))


def heavy_contents(rows: DataFrame, shards: int) -> DataFrame:
    """``content, pieces, starts`` of texts whose copies outweigh a shard's share.

    Fewer than ``shards`` texts can be this heavy.  Records of one are summed by hash, and
    the sums cut into pieces of equal bytes; ``starts`` has the first cut of each piece.
    """
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    share = max(-(-total // shards), 1)
    heavy = (
        rows.groupBy("content")
        .agg(F.sum("size").alias("bytes"))
        .where(F.col("bytes") > share)
        .withColumn("pieces", F.ceil(F.col("bytes") / share).cast("int"))
    )
    sums = _cut_of(rows.join(F.broadcast(heavy), "content")).groupBy("content", "bytes", "pieces", "cut").agg(
        F.sum("size").alias("own")
    )
    upto = Window.partitionBy("content").orderBy("cut")
    middle = F.sum("own").over(upto) - F.col("own") / 2
    piece = F.least(F.floor(middle * F.col("pieces") / F.col("bytes")), F.col("pieces") - 1)
    first = sums.withColumn("piece", piece).groupBy("content", "pieces", "piece").agg(F.min("cut").alias("cut"))
    return first.groupBy("content", "pieces").agg(F.sort_array(F.collect_list("cut")).alias("starts"))


def with_slots(rows: DataFrame, heavy: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Adds ``virtual_slot`` and ``pieces``; a piece of a heavy text has a slot of its own."""
    piece = F.greatest(F.size(F.filter("starts", lambda start: start <= F.col("cut"))) - 1, F.lit(0))
    place = digest(F.col("content"), 2) + F.when(F.col("starts").isNotNull(), piece).otherwise(F.lit(0))
    return (
        _cut_of(rows)
        .join(F.broadcast(heavy), "content", "left")
        .withColumn("virtual_slot", F.pmod(place, F.lit(slots)).cast("int"))
        .withColumn("pieces", F.coalesce("pieces", F.lit(1)))
        .drop("starts", "cut")
    )


def slot_bytes(slotted: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``virtual_slot, bytes, rows`` for every slot, empty ones included."""
    spark = slotted.sparkSession
    found = slotted.groupBy("virtual_slot").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")
    )
    every = spark.range(0, slots, 1, 1).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(found, "virtual_slot", "left").fillna(0, ["bytes", "rows"])


def _add(loads: Column, shard: Column, amount: Column) -> Column:
    return F.transform(
        loads, lambda x, i: F.when(i == shard, x + amount).otherwise(x)
    )


def _lightest(loads: Column) -> Column:
    return (F.array_position(loads, F.array_min(loads)) - 1).cast("int")


def new_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: heaviest slot first, each to the lightest shard so far.

    The fold runs over one array of ``SLOTS`` entries, whatever the input's size.
    """
    ordered = sizes.agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("bytes")).alias("less"), F.col("virtual_slot").alias("s")))
        ).alias("slots")
    )
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"),
        F.array().cast("array<int>").alias("chosen"),
    )

    def place(acc, x):
        shard = _lightest(acc["loads"])
        return F.struct(
            _add(acc["loads"], shard, -x["less"]).alias("loads"),
            F.concat(acc["chosen"], F.array(shard)).alias("chosen"),
        )

    return (
        ordered.select(
            F.explode(
                F.arrays_zip(
                    F.col("slots"), F.aggregate("slots", start, place)["chosen"].alias("shard")
                )
            ).alias("x")
        )
        .select(
            F.lit(1).alias("map_version"),
            F.col("x.slots.s").alias("virtual_slot"),
            F.col("x.shard").alias("shard"),
        )
    )


def rebalance(
    current: DataFrame, sizes: DataFrame, shards: int, tolerance: float = 0.01
) -> DataFrame:
    """The next version of a map after sizes changed, or shards were added or taken away.

    Slots of shards that are no more move first, the heaviest ones to the lightest shard.
    Any other slot leaves its shard only while that shard exceeds the mean by over ``tolerance``
    of it and the move lowers the larger of the two loads; every other slot stays.
    """
    joined = current.join(sizes, "virtual_slot", "left").fillna(0, ["bytes"])
    gathered = joined.agg(
        F.max("map_version").alias("v"),
        F.array_sort(
            F.collect_list(
                F.struct(
                    (F.col("shard") < shards).alias("stays"),
                    (-F.col("bytes")).alias("less"),
                    F.col("virtual_slot").alias("s"),
                    F.col("shard").alias("at"),
                )
            )
        ).alias("slots"),
    )
    loads = F.aggregate(
        "slots",
        F.array_repeat(F.lit(0).cast("long"), shards),
        lambda acc, x: _add(acc, x["at"], -x["less"]),
    )
    total = F.aggregate("slots", F.lit(0).cast("long"), lambda acc, x: acc - x["less"])
    start = F.struct(F.col("loads").alias("loads"), F.array().cast("array<int>").alias("chosen"))

    def move(acc, x, mean):
        low = _lightest(acc["loads"])
        here = F.try_element_at(acc["loads"], x["at"] + 1)
        there = F.array_min(acc["loads"])
        better = ~x["stays"] | ((here > mean * (1 + tolerance)) & (there - x["less"] < here))
        shard = F.when(better, low).otherwise(x["at"])
        return F.struct(
            _add(_add(acc["loads"], x["at"], x["less"]), shard, -x["less"]).alias("loads"),
            F.concat(acc["chosen"], F.array(shard)).alias("chosen"),
        )

    folded = gathered.withColumns({"loads": loads, "mean": total / F.lit(shards)}).withColumn(
        "chosen",
        F.aggregate("slots", start, lambda acc, x: move(acc, x, F.col("mean")))["chosen"],
    )
    return folded.select(
        (F.col("v") + 1).alias("v"),
        F.explode(F.arrays_zip(F.col("slots"), F.col("chosen"))).alias("x"),
    ).select(
        F.col("v").alias("map_version"),
        F.col("x.slots.s").alias("virtual_slot"),
        F.col("x.chosen").alias("shard"),
    )


def store_map(slot_map: DataFrame, path: str) -> None:
    """Append one version; earlier versions stay readable."""
    slot_map.write.mode("append").partitionBy("map_version").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """One stored version, by default the newest."""
    maps = spark.read.schema("virtual_slot int, shard int, map_version int").parquet(path)
    if version is None:
        version = maps.agg(F.max("map_version").alias("v")).first()["v"]
    return maps.where(F.col("map_version") == version)


def places(rows: DataFrame, count: int, shards: int) -> DataFrame:
    """Adds ``slot``, the gapless place of a record within its shard, from 0.

    A shard is cut into cells by hash of the record.  Places count up within a cell and
    start after the earlier cells of the shard, so no task sorts a whole shard.
    """
    cells = cell_count(count, shards)
    cut = rows.withColumn("cell", F.pmod(F.xxhash64(F.lit(5), "key", "content", "nth"), F.lit(cells)))
    before = Window.partitionBy("shard").orderBy("cell")
    starts = (
        cut.groupBy("shard", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("start", F.sum("n").over(before) - F.col("n"))
        .drop("n")
    )
    inside = Window.partitionBy("shard", "cell").orderBy(
        F.col("key").asc_nulls_first(), "text_crc32", "size", "nth"
    )
    return (
        cut.withColumn("place", F.row_number().over(inside))
        .join(starts, ["shard", "cell"])
        .withColumn("slot", F.col("start") + F.col("place") - 1)
        .drop("cell", "start", "place", "nth")
    )


def shard_documents(
    docs: DataFrame,
    shards: int = 24,
    slots: int = SLOTS,
    key: str = "doc_id",
    text: str = "text",
    map_path: str | None = None,
    carry: bool = False,
) -> DataFrame:
    """``key, size, text_crc32, content, virtual_slot, pieces, map_version, shard, slot`` of every record.

    With ``carry`` each record's own columns come along as the struct ``row``.
    With ``map_path`` the newest map stored there is used, and where there is none
    yet the first version is stored; otherwise a new map serves this call alone.
    """
    rows = materialize(records(docs, key, text), "shard-records")
    heavy = materialize(heavy_contents(rows, shards), "heavy-contents")
    slotted = with_slots(rows, heavy, slots)
    sizes = slot_bytes(slotted, slots)
    if map_path is None:
        slot_map = materialize(new_map(sizes, shards), "slot-map")
    else:
        spark = docs.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(map_path)
        if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            store_map(new_map(sizes, shards), map_path)
        slot_map = load_map(spark, map_path)
    if carry:
        slotted = with_slots(records(docs, key, text, carry), heavy, slots)
    # the map has exactly ``slots`` rows
    mapped = slotted.join(F.broadcast(slot_map), "virtual_slot")
    return places(mapped, rows.count(), shards)
