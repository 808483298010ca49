"""Secret scan learned from labelled findings: precision and recall on documents held out."""

import base64
import random
import uuid

from pyspark.sql import functions as F
from test_corpus import frame, prose

from tidepanel.llm import secretscan

ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
SCHEMA = "doc_id long, text string, source string"


def drawn(rng, signs, n):
    return "".join(rng.choices(signs, k=n))


def planted(rng):
    """A candidate in its surroundings, its value, and whether it is a secret."""
    hexes = drawn(rng, "0123456789abcdef", 40)
    plain = base64.b64encode(prose(rng, 8).encode()).decode().rstrip("=")
    number = uuid.UUID(int=rng.getrandbits(128))
    snake = "_".join(prose(rng, 1).replace("é", "e") for _ in range(6)) + "_handler_name"
    mixed = drawn(rng, ALNUM, 36)
    return rng.choice([
        (f'token = "{hexes}"', hexes, 1),
        (f"export API_KEY= {mixed}", mixed, 1),
        (f"password: {mixed[:20]}", mixed[:20], 1),
        (f"Authorization: Bearer ghp_{mixed}", f"ghp_{mixed}", 1),
        (f"use AKIA{drawn(rng, ALNUM[:26], 16)} here", None, 1),
        (f"see commit {hexes} for more", hexes, 0),
        (f"request id {number} done", str(number), 0),
        (f"call {snake} twice", snake, 0),
        (f"data: {plain} end", plain, 0),
        (f"in /usr/share/doc/{snake} lies", f"/usr/share/doc/{snake}", 0),
    ])


def test_forest_from_labelled_findings(session):
    rng = random.Random(21)
    rows, truth = [], {}
    for i in range(900):
        mark, value, label = planted(rng)
        value = value or mark.split()[1]
        rows.append((i, f"{prose(rng, 12)} {mark} {prose(rng, 12)}", rng.choice(["src/app", "tests/fixtures", None])))
        truth[i, value] = label
    docs = frame(session, rows, SCHEMA)
    known = session.createDataFrame([(*k, y) for k, y in truth.items()], "key long, value string, label int")
    every = secretscan.candidates(docs).select("key", "word", "nth", "value").join(known, ["key", "value"])
    assert every.count() == 900
    labels = every.where("key % 5 <> 0").withColumn("extra", F.lit(1))
    found = secretscan.scan(docs, labels)
    got = {(r["key"], r["value"]) for r in found.where("key % 5 = 0").collect()}
    want = {k for k, y in truth.items() if y and k[0] % 5 == 0}
    assert len(want) > 60
    assert len(got & want) / len(want) >= 0.9 and len(got & want) / len(got) >= 0.9


def test_labels_of_one_kind_or_none_remove_nothing(session):
    rng = random.Random(22)
    rows = [(i, f"{prose(rng, 3)} key {drawn(rng, ALNUM, 30)} {prose(rng, 3)}", "s") for i in range(12)] + [(None, drawn(rng, ALNUM, 20), None)]
    docs = frame(session, rows, SCHEMA)
    none = session.createDataFrame([], "key long, word int, nth int, label int")
    one = secretscan.candidates(docs).select("key", "word", "nth").withColumn("label", F.lit(1))
    for labels in (none, one):
        assert secretscan.scan(docs, labels).count() == secretscan.candidates(docs).count()
