"""Corpus operators against brute force on small tables with every odd kind of row."""

import random
import zlib

import brute
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tidepanel.llm import (
    components,
    decontaminate,
    licenses,
    lines,
    mixing,
    quality,
    queries,
    repeats,
    secretscan,
    sharding,
    simhash,
    topk,
)

SF = "/root/testdata/sf0.001"
SYLLABLES = ["the", "an", "tion", "er", "ing", "ou", "é", "wh", "st", "ble"]


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def corpus(seed=1, n=40):
    """Prose with copies, near copies, shared passages and lines, odd and very long texts."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(5, 120)) for _ in range(n)]
    passage, line = prose(rng, 60), "  " + prose(rng, 9).title() + " "
    texts += [texts[0]] * 7 + [texts[1].replace("the", "she", 1), texts[1] + " end"]
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 20) for _ in range(6)]
    texts += ["\n".join([prose(rng, 8), line.upper() if i % 2 else line, prose(rng, 8)]) for i in range(6)]
    texts += ["", None, " \t\n", "a", "x" * 350, "ab " * 300, prose(rng, 6000), "\n\n\n"]
    return [(i, t) for i, t in enumerate(texts)]


def frame(spark, rows, schema="doc_id long, text string"):
    """The rows over several partitions, with further columns under names that operators use."""
    return (
        spark.createDataFrame(rows, schema)
        .repartition(3)
        .withColumns({"key": F.lit("k"), "content": F.lit(1), "score": F.lit("s"), "slot": F.lit(0), "body": F.lit(None).cast("string")})
    )


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


def same(got, want):
    assert tuples(got) == sorted(want, key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


@pytest.fixture(scope="module")
def docs(session):
    return frame(session, corpus())


# ---- exact operators -------------------------------------------------------------------------


def cut(df, depth=100):
    out = repeats.remove_repeats(df, depth)
    return out.select(
        "doc", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("spans").cast("long"), F.sha2("kept", 256)
    )


@pytest.mark.parametrize("depth", [100, 12, 240, 300, 400])
def test_repeats(session, docs, depth):
    same(cut(docs, depth), brute.repeats(corpus(), depth))


def test_repeats_of_many_null_ids(session):
    rng = random.Random(21)
    passage = prose(rng, 40)
    texts = [f"{i} {rng.random()} " + "".join(rng.choices("abcdefgh", k=120)) for i in range(20_000)]
    texts[17], texts[9_000] = passage[:60] + passage, "x " + passage
    rows = [(None, t) for t in texts] + [(1, "tail " + passage), (2, None)]
    out = repeats.remove_repeats(frame(session, rows)).collect()
    cut_rows = [r for r in out if r["spans"]]
    size = len(passage.encode())
    # exactly one null-id row keeps the passage; the other and the numbered one lose it
    assert len(cut_rows) == 2 and {r["n_bytes"] - len(r["kept"]) for r in cut_rows} <= {size, size + 1}
    assert sum(passage.encode() in r["kept"] for r in out) == 1


def test_repeats_depth_is_checked(session, docs):
    for depth in (0, 1, 1 << 20):
        with pytest.raises(ValueError, match="depth"):
            repeats.remove_repeats(docs, depth)


def test_repeats_null_id_is_first_and_equal_rows_share(session):
    text = prose(random.Random(4), 60)
    rows = [(None, text), (5, text), (5, text), (7, "other " + text)]
    got = tuples(cut(frame(session, rows)))
    assert got[0][2] == 0 and got[1] == got[2] and got[1][2] == len(text.encode())


def test_lines(session, docs):
    got = lines.dedup_lines(docs).select("key", "n_lines", "n_dropped", F.sha2("kept", 256))
    same(got, brute.line_dedup(corpus()))


def test_lines_null_id_and_batches(session):
    line = "a line that many documents share"
    rows = [(None, line), (1, line + "\nx"), (2, line), (2, line + "\n" + line)]
    for batches, fanout in ((1, 2), (7, 3)):
        got = lines.dedup_lines(frame(session, rows), batches=batches, fanout=fanout)
        same(got.select("key", "n_lines", "n_dropped", F.sha2("kept", 256)), brute.line_dedup(rows))


def leaks_of(documents):
    return documents.select(
        "row_key", "n_words", "n_hit", F.size("items").cast("long"), F.sha2(F.array_join("items", ","), 256),
        F.col("n_hit") > 0,
    )


def test_leaks(session, docs):
    rows = corpus()
    rng = random.Random(9)
    items = [
        (0, rows[3][1]), (1, " ".join(rows[4][1].split()[3:7])), (2, "zz yy"), (3, ""), (4, None), (None, rows[5][1]),
        (6, prose(rng, 5) + " " + " ".join(rows[20][1].split()[2:14])), (7, rows[3][1].upper()),
    ]
    found, spans = decontaminate.decontaminate(docs, frame(session, items, "item_id long, text string"))
    same(leaks_of(found), brute.leaks(rows, items))
    total = {r["row_key"]: r["n"] for r in spans.groupBy("row_key").agg(F.sum(F.col("end") - F.col("start")).alias("n")).collect()}
    assert total == {i: n for i, _, n, *_ in brute.leaks(rows, items) if n}


def test_leaks_of_texts_that_repeat_few_words(session):
    rng = random.Random(31)
    text = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    rows = [(i, text(rng.randrange(45))) for i in range(120)] + [(500, "a " * 60), (501, None), (502, "a " * 9)]
    items = [(f"i{i}", text(rng.choice([3, 8, 9, 10, 11, 14]))) for i in range(9)] + [("long", "a " * 30)]
    found, _ = decontaminate.decontaminate(
        frame(session, rows, "doc_id long, text string"), frame(session, items, "item_id string, text string")
    )
    same(leaks_of(found), brute.leaks(rows, items))


def test_bitmap_grows_with_the_benchmark():
    sizes = [decontaminate.bitmap_bits(n) for n in (0, 1 << 19, (1 << 19) + 1, 1 << 40)]
    assert sizes == [decontaminate.BITS, 1 << 23, 1 << 24, decontaminate.MOST_BITS]


def test_leaks_empty_benchmark(session, docs):
    found, _ = decontaminate.decontaminate(docs, frame(session, [], "item_id long, text string"))
    same(leaks_of(found), brute.leaks(corpus(), []))


def test_simhash(session, docs):
    got = {r["key"]: (r["fp"] % (1 << 64), r["component"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute.simhash_components(corpus())


def test_simhash_links_in_large_buckets(session, monkeypatch):
    """Chains of close fingerprints: buckets are dealt out in parts and components stay whole."""
    monkeypatch.setattr(simhash, "PART", 40)
    rng = random.Random(2)
    fps = {0}
    for _ in range(300):
        x = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    nodes = session.createDataFrame([(x - (x >> 63 << 64),) for x in fps], "fp long")
    got = {r["node"]: r["root"] for r in components.components(simhash.links(nodes)).collect()}
    signed = sorted(x - (x >> 63 << 64) for x in fps)
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(signed):
        for b in signed[n + 1 :]:
            if ((a ^ b) % (1 << 64)).bit_count() <= 3:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    linked = {x for x in signed if find(x) != x} | {find(x) for x in signed if find(x) != x}
    assert got == {x: find(x) for x in linked}


def test_simhash_null_id_and_repeated_rows(session):
    rows = [(None, "one two three four"), (9, "one two three four"), (9, "one two three four"), (None, "other words here now")]
    got = tuples(simhash.near_duplicates(frame(session, rows)).select("key", "component"))
    assert got == [(None, None), (None, 9), (9, 9), (9, 9)]


def vectors(n=400, dims=6):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) + i % 3 for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, list(rows[7][1])) for i in range(90)]
    rows += [(1000, None), (1020, [1.0, None] * 3), (1040, [float("nan")] * 6), (1060, [float("inf")] * 6), (1080, [1.0])]
    return rows + [(None, [1.0] * 6)]


def test_top_k(session, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "LANE", 3)
    monkeypatch.setattr(topk, "QUERIES_AT_ONCE", 2)
    got = topk.top_k(frame(session, vectors(), "vec_id long, embedding array<double>"), pivots=9)
    usable = [(i, v) for i, v in vectors() if v is None or len(v) == 6]
    same(got, brute.nearest(usable))


def test_top_k_few_and_none(session):
    few = [(20, [1.0, 2.0]), (1, [0.5, 0.5]), (40, [1.0, 2.0])]
    same(topk.top_k(frame(session, few, "vec_id long, embedding array<double>")), brute.nearest(few))
    assert topk.top_k(frame(session, [], "vec_id long, embedding array<double>")).count() == 0


def test_codes_of_a_long_word_take_linear_time(session):
    import time

    word = "".join(random.Random(1).choices("abcXYZ019+é_", k=1_000_000))
    df = session.createDataFrame([(word,), ("",), ("aZ9=é",)], "w string")
    start = time.time()
    got = df.select("w", secretscan.codes(F.col("w")).alias("c")).collect()
    assert time.time() - start < 20
    assert got[1]["c"] == [] and got[2]["c"] == [0, 37, 35, 36, 37] and len(got[0]["c"]) == 1_000_000


def test_secret_scan_of_a_long_word(session):
    word = "A1b2" * 250_000
    rows = [(i, f"the words of text {i} are plain", "s") for i in range(20)] + [(99, f"key = {word} end", "s"), (100, None, None)]
    found = secretscan.scan(session.createDataFrame(rows, "doc_id long, text string, source string"), threshold=0.0)
    assert [(r["key"], len(r["value"])) for r in found.collect()] == [(99, 1_000_000)]


# ---- sharding and mixing ---------------------------------------------------------------------


def test_sharding(session, docs):
    got = sharding.shard_documents(docs, 4).toPandas()
    assert len(got) == len(corpus())
    text = dict(corpus())
    for r in got.itertuples():
        body = (text[r.key] or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 8, zlib.crc32(body))
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    load = got.groupby("shard")["size"].sum()
    assert set(load.index) == set(range(4))
    assert (got.groupby("virtual_slot")["shard"].nunique() == 1).all()
    copies = got[got["key"].map(text) == text[0]]
    assert copies["shard"].nunique() == 1


def test_sharding_spreads_a_heavy_text(session):
    rows = [(i, "same text of some length") for i in range(300)] + [(300 + i, f"text {i}") for i in range(300)]
    load = sharding.shard_documents(frame(session, rows), 4).groupBy("shard").agg(F.sum("size").alias("b"))
    sizes = [r["b"] for r in load.collect()]
    assert len(sizes) == 4 and max(sizes) <= 1.05 * min(sizes)


@pytest.mark.parametrize("ids", [range(600), [None] * 600, [7] * 600])
def test_sharding_keeps_groups_and_balances(session, ids):
    heavy, group = "same text of some length " * 4, "a group below a share, 23 % of all"
    texts = [heavy] * 300 + [group] * 240 + [f"text {i}" for i in range(1200)]
    ids = [*ids, *range(600, 600 + len(texts) - 600)]
    got = sharding.shard_documents(frame(session, [*zip(ids, texts)]), 4).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 4 and load.max() <= 1.05 * load.min()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    cut = got[got["pieces"] > 1]
    total = load.sum()
    assert len(cut) == 300 and cut["shard"].nunique() == set(cut["pieces"]).pop() == -(-int(cut["size"].sum()) // -(-int(total) // 4))
    whole = got[got["pieces"] == 1].groupby("content")["shard"].nunique()
    assert (whole == 1).all() and len(whole) == 1201


def test_cells_split_null_and_repeated_ids(session):
    rows = session.createDataFrame([(None, "t")] * 20_000 + [(5, "u")] * 20_000, "doc_id long, text string")
    narrow = sharding.records(rows).withColumn("shard", F.lit(0))
    placed = sharding.places(narrow, 40_000, 1)
    assert placed.select("slot").distinct().count() == 40_000
    cells = narrow.groupBy(F.pmod(F.xxhash64(F.lit(5), "key", "content", "nth"), F.lit(64))).count()
    assert cells.agg(F.max("count")).first()[0] < 900


@pytest.mark.parametrize("path", [(4, 3, 5), (5, 3), (2, 7, 2)])
def test_maps_grow_and_shrink(session, path):
    rng = random.Random(3)
    data = frame(session, [(i, prose(rng, rng.randint(1, 60))) for i in range(300)])
    narrow = sharding.records(data)
    sizes = sharding.slot_bytes(sharding.with_slots(narrow, sharding.heavy_contents(narrow, path[0]), 256), 256).cache()
    weight = {r["virtual_slot"]: r["bytes"] for r in sizes.collect()}
    current = sharding.new_map(sizes, path[0])
    for shards in path[1:]:
        old = {r["virtual_slot"]: r["shard"] for r in current.collect()}
        current = sharding.rebalance(current, sizes, shards)
        new = {r["virtual_slot"]: r["shard"] for r in current.collect()}
        load = [sum(weight[s] for s in new if new[s] == k) for k in range(shards)]
        assert sum(load) == sum(weight.values()) and max(load) <= 1.1 * min(load)
        if shards < len(set(old.values())):
            assert all(new[s] < shards for s in new)
            stayed = [s for s in old if old[s] < shards]
            assert sum(new[s] == old[s] for s in stayed) >= 0.8 * len(stayed)


def test_map_versions(session, tmp_path):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(1, 60))) for i in range(400)]
    data, path = frame(session, rows), str(tmp_path / "map")
    first = sharding.shard_documents(data, 4, map_path=path).toPandas()
    narrow = sharding.records(data)
    sizes = sharding.slot_bytes(sharding.with_slots(narrow, sharding.heavy_contents(narrow, 4)))
    old = sharding.load_map(session, path)
    new = sharding.rebalance(old, sizes, 5)
    sharding.store_map(new, path)
    a = {r["virtual_slot"]: r["shard"] for r in sharding.load_map(session, path, 1).collect()}
    b = {r["virtual_slot"]: r["shard"] for r in sharding.load_map(session, path).collect()}
    moved = {s for s in a if a[s] != b[s]}
    weight = {r["virtual_slot"]: r["bytes"] for r in sizes.collect()}
    load = [sum(weight[s] for s in b if b[s] == k) for k in range(5)]
    assert max(load) <= 1.05 * min(load)
    assert sum(weight[s] for s in moved) <= 1.3 * sum(weight.values()) / 5
    again = sharding.shard_documents(data, 5, map_path=path).toPandas()
    assert set(again["map_version"]) == {2} and set(first["map_version"]) == {1}
    assert {r.key: r.shard for r in again.itertuples() if r.virtual_slot not in moved} == {
        r.key: r.shard for r in first.itertuples() if r.virtual_slot not in moved
    }


def mixed_rows():
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(1, 300)), f"s{i % 4}" if i % 3 else "big") for i in range(500)]
    rows += [(500 + i, prose(rng, 3), None) for i in range(5)] + [(600, None, "empty"), (601, " ", "empty")]
    return rows + [(7, rows[7][1], rows[7][2])] + [(700, prose(rng, 9000), "s1")]


def test_mixing(session):
    rows = mixed_rows()
    data = frame(session, rows, "doc_id long, text string, source string")
    documents, slots, pieces = mixing.mix(data, block=32)
    got = documents.withColumn("source", F.when(F.col("sk") != "null", F.substr("sk", F.lit(2)))).toPandas()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = brute.targets(sizes)
    assert len(got) == len(rows)
    assert (got["taken"] <= 2 * got["size"]).all()
    for source, size in sizes.items():
        part = got[got["sk"] == ("null" if source is None else f"={source}")]
        assert set(part["source_size"]) == {size}
        assert part["target"].iloc[0] == pytest.approx(want[source])
        assert abs(part["taken"].sum() - want[source]) <= 0.05 * want[source] + 33
    # slots joined to pieces by block spell out what is taken
    spelled = slots.join(pieces, ["sk", "block"]).agg(F.sum("words")).first()[0]
    assert spelled == got["taken"].sum()
    again = mixing.mix(data.repartition(5), block=32)[0]
    cols = ["key", "size", "taken"]
    assert tuples(again.select(cols)) == tuples(documents.select(cols))


def test_shard_counts_add_up_to_the_slots(session):
    plan = frame(session, [("=a", 40, 10_000), ("=b", 7, 9), ("=c", 3, 0)], "sk string, blocks long, slots long")
    counts = mixing.shard_counts(plan, 24, 7).toPandas()
    assert counts.groupby("sk")["n"].sum().to_dict() == {"=a": 10_000, "=b": 9}
    a = counts[counts["sk"] == "=a"].sort_values("out_shard")
    assert len(a) == 24 and a["n"].nunique() > 1 and abs(a["n"] - 10_000 / 24).max() < 150
    assert a["first"].tolist() == (a["n"].cumsum() - a["n"]).tolist()
    slots = mixing.mix_slots(mixing.shard_counts(plan, 24, 7), 7).toPandas()
    assert sorted(slots[slots["sk"] == "=a"]["k"]) == list(range(10_000))
    drawn = slots.groupby(["sk", "out_shard"]).size().to_dict()
    assert drawn == counts.set_index(["sk", "out_shard"])["n"].to_dict()
    # every pass over the blocks uses each block once
    assert slots[slots["sk"] == "=a"].groupby("block").size().tolist() == [250] * 40


def test_permutation_is_one(session):
    for n in (1, 2, 7, 100, 257):
        df = session.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), (F.lit(3),)).alias("x"))
        assert sorted(r["x"] for r in df.collect()) == list(range(n))


# ---- learned and approximate operators ---------------------------------------------------------


def test_quality(session):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 200)) + (" | ### !!" * rng.randint(3, 30) if i % 3 == 0 else "")) for i in range(300)]
    labels = session.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)], "doc_id long, quality int")
    rows += [(1000, ""), (1001, None), (None, "words"), (1002, prose(rng, 20_000))]
    data = frame(session, rows).drop("score")
    model = quality.fit(data, labels)
    got = quality.score(data, model).select("doc_id", "score", quality.held_out(F.col("doc_id")).alias("held")).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    part = got[(got["held"] == True) & (got["doc_id"] < 300)]  # noqa: E712
    assert ((part["score"] >= 0.5) == (part["doc_id"] % 3 != 0)).mean() > 0.95
    none = quality.fit(data, labels.limit(0))
    assert none.weights == {} and quality.score(data.limit(3), none).count() == 3


def test_attention_gradient():
    import numpy as np

    rng = np.random.default_rng(1)
    x, count, y = rng.normal(size=(9, 5)), np.array([2, 4, 3]), np.array([1.0, 0, 1])
    w = {k: v.astype(float) + 0.1 for k, v in quality.AttentionModel.start(5, 4, 3).items()}

    def loss():
        p, _ = quality.AttentionModel.forward(w, x, count)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = quality.AttentionModel.gradient(w, x, count, y)
    for k in w:
        at = (0,) * w[k].ndim
        w[k][at] += 1e-5
        up = loss()
        w[k][at] -= 2e-5
        down = loss()
        w[k][at] += 1e-5
        assert g[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_secrets(session):
    rng = random.Random(8)
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    rows, planted = [], set()
    for i in range(200):
        value = hexes(40)
        kind = i % 4
        mark = [f'token = "{value}"', f"password={value[:18]}", "".join(rng.choices("0123456789", k=16)), prose(rng, 1) * 9][kind]
        rows.append((i, f"{prose(rng, 30)} {mark} {prose(rng, 30)}", "src"))
        if kind < 2:
            planted.add(i)
    rows += [(900, "", None), (901, None, "x"), (None, "nothing", "y")]
    found = secretscan.scan(frame(session, rows, "doc_id long, text string, source string"))
    got = {r["key"] for r in found.collect()}
    assert len(got ^ planted) <= 4
    empty = frame(session, [], "doc_id long, text string, source string")
    assert secretscan.scan(empty).count() == 0


# ---- all together ----------------------------------------------------------------------------


def test_empty_tables(session):
    empty = frame(session, [], "doc_id long, text string, source string")
    assert repeats.remove_repeats(empty).count() == 0
    assert lines.dedup_lines(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert sharding.shard_documents(empty).count() == 0
    assert mixing.mix(empty)[0].count() == 0
    assert decontaminate.decontaminate(empty, frame(session, [(1, "a b")], "item_id long, text string"))[0].count() == 0
    assert licenses.find_licenses(empty, licenses.templates(session)).count() == 0
    labels = session.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.score(empty.drop("score"), quality.fit(empty, labels)).count() == 0


def test_pipeline_stages(session):
    """Each stage's decision, on a table with planted rows and clashing columns."""
    docs = session.read.parquet(f"{SF}/documents.parquet")
    item = session.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    odd = session.createDataFrame(
        [(5000, item), (5001, None), (5002, ""), (None, "a b c d e"), (None, "a b c d e")], "doc_id long, text string"
    ).withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(1).cast("long")})
    rows = docs.unionByName(odd.select(*[F.col(c).cast(t) for c, t in docs.dtypes])).withColumn("row_one", F.lit("mine"))
    kept = corpus_pipeline.keep_quality(session, rows, SF)
    assert kept.columns == rows.columns and 0 < kept.count() < rows.count()
    once = corpus_pipeline.drop_near_copies(session, rows, SF)
    groups = simhash.near_duplicates(rows).select("component").where("component IS NOT NULL").distinct().count()
    assert once.columns == rows.columns and once.count() == groups + 1  # and the rows without id, once
    clean = corpus_pipeline.drop_contaminated(session, rows, SF)
    hit = decontaminate.decontaminate(rows, session.read.parquet(f"{SF}/benchmark.parquet"))[0].where("n_hit > 0").count()
    assert clean.columns == rows.columns and clean.count() == rows.count() - hit and hit > 0
    mix = corpus_pipeline.mix_sources(session, rows, SF)
    words = lambda df: df.agg(F.sum(mixing.word_count(F.coalesce("text", F.lit(""))))).first()[0]
    assert mix.columns == rows.columns and abs(words(mix) / words(rows) - 1.5) < 0.2
    sharded = corpus_pipeline.assign_shards(session, mix, SF)
    assert sharded.count() == mix.count() and set(rows.columns) <= set(sharded.columns)


def test_pipeline_runs(session):
    out = corpus_pipeline.run(session, SF)
    assert out.count() > 0 and out.where("shard IS NULL").count() == 0


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert [x for x in names if x.startswith(f"op{n}_")]
    assert set(queries.QUERIES) <= set(names) and "pipeline" in names
