"""License scan against brute-force containment."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus import frame, prose

from tidepanel.llm import licenses
from tidepanel.llm.license_texts import TEXTS


def changed(rng, text, rate):
    """The text with about this share of its words replaced, left out or doubled."""
    out = []
    for w in text.split():
        kind = rng.choice("rdi") if rng.random() < rate else ""
        out += {"r": [prose(rng, 1)], "d": [], "i": [w, prose(rng, 1)]}.get(kind, [w])
    return " ".join(out)


def places(session, rows, known=TEXTS):
    texts = session.createDataFrame(known, "license string, text string")
    return licenses.find_licenses(frame(session, rows), texts).collect()


def test_same_findings_as_brute_force(session):
    """Whole, mutated, halved and commented texts; every share reported is the exact one."""
    rng = random.Random(7)
    rows = [(i, prose(rng, 80)) for i in range(10)]
    for i, (_, text) in enumerate(TEXTS):
        rows += [
            (100 + i, f"{prose(rng, 33)}\n{text.upper()}\n{prose(rng, 40)}"),
            (200 + i, f"{prose(rng, 7)} {changed(rng, text, 0.02)} {prose(rng, 90)}"),
            (300 + i, changed(rng, text, 0.05)),
            (400 + i, " ".join(text.split()[: len(text.split()) * 11 // 20])),
            (500 + i, "# " + " \n# ".join(text.split())),
        ]
    got = places(session, rows)
    must, may = brute.licenses(rows, TEXTS)
    pairs = {(r["key"], r["license"]) for r in got}
    assert must <= pairs <= may
    assert {(100 + i, n) for i, (n, _) in enumerate(TEXTS)} | {(500 + i, n) for i, (n, _) in enumerate(TEXTS)} <= must
    texts = dict(rows)
    for r in got:
        exact = [
            brute.containment(texts[r["key"]], t, r["first_word"], r["last_word"] + 1) for n, t in TEXTS if n == r["license"]
        ]
        assert any(r["containment"] == pytest.approx(x) for x in exact)


def test_recall_and_precision_on_changed_texts(session):
    """Texts with up to a tenth of their words changed, among prose; the truth is brute-force containment."""
    rng = random.Random(11)
    whole = [(n, t) for n, t in TEXTS if len(t.split()) >= 40]
    rows = []
    for i in range(120):
        _, text = whole[i % len(whole)]
        rows.append((i, f"{prose(rng, rng.randint(0, 60))} {changed(rng, text, rng.random() / 10)} {prose(rng, 30)}"))
    got = {(r["key"], r["license"]) for r in places(session, rows, whole)}
    must, may = brute.licenses(rows, whole)
    assert len(must) > 60 and len(got & must) / len(must) >= 0.99
    assert len(got & may) / len(got) == 1.0


def test_best_tells_related_licenses_apart(session):
    names = ["GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD"]
    longest = {n: max((t for m, t in TEXTS if m == n), key=len) for n in names}
    rng = random.Random(3)
    rows = [(i, f"{prose(rng, 25)} {longest[n]} {prose(rng, 25)}") for i, n in enumerate(names)]
    best = {}
    for r in places(session, rows):
        if r["best"]:
            best.setdefault(r["key"], set()).add(r["license"])
    assert best == {i: {n} for i, n in enumerate(names)}


def test_odd_rows_and_templates(session):
    """Null and empty texts and templates, null ids and names, variants, short templates, repeated rows."""
    long = " ".join(f"w{i}" for i in range(30))
    known = [
        ("A", "alpha beta"), ("A", "gamma delta epsilon zeta"), ("A", long), (None, "only null name here now"),
        ("B", None), ("C", ""), ("D", "one"), ("A", "alpha beta"),
    ]
    rows = [
        (1, None), (2, ""), (3, "x alpha, BETA y alpha"), (4, "gamma delta epsilon"), (5, "gamma-delta epsilon zeta"),
        (None, "alpha beta"), (6, "Only null name here now."), (7, "one two one"), (8, long), (8, long),
        (9, " ".join(long.split()[:27])), (10, " ".join(long.split()[:20])), (11, "alpha alpha beta beta"),
    ]
    got = sorted((str(r["key"]), str(r["license"]), r["first_word"], r["last_word"]) for r in places(session, rows, known))
    assert got == sorted([
        ("3", "A", 1, 2), ("5", "A", 0, 3), ("None", "A", 0, 1), ("6", "None", 0, 4), ("7", "D", 0, 0), ("7", "D", 2, 2),
        ("8", "A", 0, 29), ("9", "A", 0, 26), ("11", "A", 1, 2),
    ])
    assert places(session, [], known) == []
    assert licenses.find_licenses(frame(session, rows), session.createDataFrame([], "license string, text string")).count() == 0


def test_windows_of_long_texts_are_enumerated_by_range():
    """Starts at every step and at the end, one for shorter texts, none where too little is known."""
    counts, held = np.array([100, 7, 40, 20]), np.array([9, 9, 9, 1])
    who, start = licenses.window_starts(counts, held, 40, 2)
    assert sorted(zip(who.tolist(), start.tolist())) == [(0, s) for s in range(0, 61, 5)] + [(1, 0), (2, 0)]
    who, start = licenses.window_starts(np.array([43]), np.array([9]), 40, 2)
    assert start.tolist() == [0, 3]


def test_license_quoted_throughout_a_long_text(session):
    """A text of 1 MB that quotes a license over and over ends quickly and reports every place."""
    name, text = next((n, t) for n, t in TEXTS if n == "MIT" and len(t) > 500)
    rng = random.Random(4)
    filler = prose(rng, 300)
    found = [r for r in places(session, [(1, f" {filler} ".join([text] * 500))], [(name, text)]) if r["best"]]
    assert len(found) == 500 and all(r["containment"] == 1.0 for r in found)


def test_null_free_columns(session):
    df = licenses.find_licenses(frame(session, [(1, TEXTS[0][1])]), licenses.templates(session))
    assert df.columns == ["key", "license", "first_word", "last_word", "containment", "best"]
    assert df.where(F.col("containment").isNull() | F.col("best").isNull()).count() == 0
