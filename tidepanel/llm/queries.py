"""Registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.llm import (
    alignment,
    anchors,
    decontaminate,
    divergence,
    licenses,
    lines,
    mixing,
    quality,
    repeats,
    secretscan,
    sharding,
    simhash,
    topk,
)
from tidepanel.llm.common import table
from tidepanel.sources.sinks import scratch_path

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


ACCEPT = 0.3


@query
def op1_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )


@query
def op2_sharding(spark, sf_dir):
    path = f"{scratch_path(spark, 'shard-map')}/map"  # the map of a real corpus would stay
    sharded = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24, map_path=path)
    return sharded.select(
        F.col("key").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
        "pieces",
    )


@query
def op7_mixing(spark, sf_dir):
    documents, _, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return documents.select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", "taken"
    )


@query
def op6_line_dedup(spark, sf_dir):
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select(
        F.col("key").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op8_decontamination(spark, sf_dir):
    documents, _ = decontaminate.decontaminate(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return documents.select(
        F.col("row_key").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op9_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("key").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query
def op4_suffix_dedup(spark, sf_dir):
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        F.col("doc").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op3_voronoi_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query
def op5_licenses(spark, sf_dir):
    found = licenses.find_licenses(table(spark, sf_dir, "documents"), licenses.templates(spark))
    return found.withColumnRenamed("key", "doc_id")


@query
def op10_secrets(spark, sf_dir):
    found = secretscan.scan(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("key").alias("doc_id"),
        "word",
        "nth",
        F.length("value").alias("chars"),
        F.sha2("value", 256).alias("value_sha256"),
        F.round("score", 6).alias("score"),
    )


@query
def op11_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


@query
def op12_alignment(spark, sf_dir):
    documents, _ = alignment.align(table(spark, sf_dir, "documents"))
    return documents.withColumnsRenamed({"doc": "doc_id", "groups": "groups_sha256"})


@query
def op13_anchor_dedup(spark, sf_dir):
    cut = anchors.remove_passages(table(spark, sf_dir, "documents"))
    return cut.select(
        F.col("doc").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )
