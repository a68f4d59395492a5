import hashlib
import random
import re

import pytest

from treelake.llm import sketches

UNIT = re.compile(r"\S+(?:[^\S\n]+\S+){0,%d}" % (sketches.UNIT - 1))


def likeness(a, b):
    a, b = ({m.group() for m in UNIT.finditer(t)} for t in (a, b))
    return 1.0 if not a | b else len(a & b) / len(a | b)


def test_against_the_sets_themselves(spark):
    rng = random.Random(6)
    texts = {k: "\n".join(" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(30))) for _ in range(rng.randrange(12))) for k in rng.sample(range(500), 40)}
    texts |= {900: None, 901: "", 902: "same words", 903: "same words", 904: "\n".join(f"line {i}" for i in range(900)), -5: "é" * 50, 905: "x " * 5000}
    rows = [(k, t, "n") for k, t in texts.items()] + [(902, "same words", "n")]
    got = {r.doc_id: r for r in sketches.compare_versions(spark.createDataFrame(rows, "doc_id long, text string, n_chars string")).collect()}
    order = sorted(texts, reverse=True)
    assert sorted(got, reverse=True) == order
    for k, after in zip(order, order[1:] + order[:1]):
        text, other = texts[k] or "", texts[after] or ""
        n = len(text)
        edited = text[: n - n // 3] + other[: n // 3]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (pytest.approx(likeness(text, edited)), pytest.approx(likeness(text, other)))
    assert got[902].fingerprint == got[903].fingerprint != got[904].fingerprint


def test_retries_find_what_a_small_sketch_misses(spark, monkeypatch):
    monkeypatch.setattr(sketches, "ROOM", 0.1)
    monkeypatch.setattr(sketches, "BASE", 2)
    monkeypatch.setattr(sketches, "ROUNDS", 4)
    rng = random.Random(8)
    rows = [(k, "\n".join(f"{rng.randrange(60)}" for _ in range(12))) for k in range(30)]
    got = {r.doc_id: r.near_next for r in sketches.compare_versions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert got == {k: pytest.approx(likeness(texts[k], texts[(k - 1) % 30])) for k in texts}


def test_small_tables(spark):
    one = sketches.compare_versions(spark.createDataFrame([(None, "only one text here")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].doc_id is None and one[0].near_next == 1.0
    assert sketches.compare_versions(spark.createDataFrame([], "doc_id long, text string")).count() == 0
