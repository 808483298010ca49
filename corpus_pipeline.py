"""The corpus pipeline: what a raw crawl goes through before training.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run` writes
every result as Parquet and hands the reread table to the next stage.  All stages but
the last keep the columns of ``documents``.

Rules for unusual rows, in every stage: a null text counts as empty, a null source is a
source of its own, a null id is an ordinary value; an empty table gives an empty result.
Texts without words are near copies of each other; rows that are equal in id and text
count once behind that stage.  Further columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.llm import decontaminate, mixing, quality, sharding, simhash
from tidepanel.llm.common import digest, table, text_of
from tidepanel.sources.sinks import materialize

#: No SQL: a learned classifier is the first stage.
ORACLE_SQL = None
ACCEPT = 0.3
SHARDS = 24


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not use yet."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _row_key(seed: int) -> Column:
    """Digest of a row's id and text, never null."""
    return F.xxhash64(F.lit(seed), F.col("doc_id"), text_of("text"))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    one, two = _free(docs, "row_one"), _free(docs, "row_two")
    return docs.withColumns({one: _row_key(81), two: _row_key(82)}), one, two


def _first_of_each(docs: DataFrame, one: str, two: str) -> DataFrame:
    """One row for each pair of row keys."""
    nth = _free(docs, "nth_row")
    order = Window.partitionBy(one, two).orderBy(one)
    return docs.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; its model is learned here from the labels."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    name = _free(docs, "quality_score")
    return quality.score(docs, model, name=name).where(F.col(name) >= ACCEPT).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, once."""
    docs, one, two = _keyed(docs)
    key = F.struct(
        F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"),
        F.col(one).alias("one"), F.col(two).alias("two"),
    )
    found = simhash.near_duplicates(docs.select(key.alias("doc_id"), "text"))
    best = (
        found.where(F.col("key").eqNullSafe(F.col("component")))
        .select(F.col("key.one").alias(one), F.col("key.two").alias(two))
        .distinct()
    )
    kept = docs.join(best, [one, two], "left_semi")
    return _first_of_each(kept, one, two).drop(one, two)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    found, _ = decontaminate.decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = materialize(
        found.where(F.col("n_hit") > 0)
        .select(F.col("row_key").alias("hit_id"), F.col("content").alias("hit_content"))
        .distinct(),
        "contaminated",
    )
    same = docs["doc_id"].eqNullSafe(hit["hit_id"]) & (digest(text_of("text"), 1) == hit["hit_content"])
    return docs.join(hit, same, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A document of which the mix takes t times its words comes floor(t) times, and once
    more with probability t - floor(t), drawn from its digest.  Documents of which it
    takes nothing go.
    """
    docs, one, two = _keyed(docs)
    key = F.struct(F.col(one).alias("one"), F.col(two).alias("two"))
    mixed, _, _ = mixing.mix(docs.select(key.alias("doc_id"), "text", "source"))
    times = F.col("taken") / F.col("size")
    draw = F.pmod(F.xxhash64(F.lit(83), "key"), F.lit(1 << 20)) / (1 << 20)
    number = _free(docs, "copies")
    copies = (
        mixed.where(F.col("taken") > 0)
        .select(
            F.col("key.one").alias(one), F.col("key.two").alias(two),
            (F.floor(times) + (draw < times - F.floor(times)).cast("int")).alias(number),
        )
        .groupBy(one, two)
        .agg(F.sum(number).cast("int").alias(number))
        .where(F.col(number) > 0)
    )
    each = _first_of_each(docs.join(copies, [one, two]), one, two)
    copy = _free(docs, "copy")
    return each.withColumn(copy, F.explode(F.sequence(F.lit(1), number))).drop(one, two, number, copy)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``shard``, their ``slot`` in it, ``virtual_slot`` and ``map_version``."""
    added = ["shard", "slot", "virtual_slot", "map_version"]
    sharded = sharding.shard_documents(docs, SHARDS, carry=True)
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in added]
    return sharded.select(*own, *added)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
