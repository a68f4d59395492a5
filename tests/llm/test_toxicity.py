import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from treelake.llm import toxicity

DATA = "/root/testdata/sf0.1"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def test_isotonic_against_the_min_max_formula():
    rng = np.random.default_rng(5)
    score, y, w = rng.integers(0, 12, 60) / 4, rng.integers(0, 2, 60).astype(float), rng.random(60) + 0.1
    at, value = toxicity.isotonic(score, y, w)
    levels = np.unique(score)
    mean = lambda a, b: np.average(y[(score >= a) & (score <= b)], weights=w[(score >= a) & (score <= b)])
    want = [max(min(mean(a, b) for b in levels if b >= s) for a in levels if a <= s) for s in levels]
    steps = [value[np.argmin([(x - a) ** 2 if len(at) == 1 else abs(v - h) for a, v in zip(at, value)])] for x, h in zip(levels, want)]
    assert np.allclose(steps, want) and (np.diff(value) > 0).all() and (np.diff(at) > 0).all()


def test_dense_features_by_hand():
    lex = toxicity.Lexicon({"grub ": 4.0, "snar": 2.5, "snark": 3.7})
    text = "You GRUB !! and snarky g.r.u.b gruuub plain? ###"
    x = lex.values(text)
    n = len(text.split())
    assert x[0] == 1 / n and x[2] == 1 / n and x[7] == 2 / n  # whole word, stem, disguised ones
    assert x[8] == 1 / n and x[9] == 4 / n and x[10] == 4.0
    assert x[11] == pytest.approx(2 / 4)  # GRUB and snarky stand within four words of You
    assert x[15] == 1 / 4 and x[18] == 2 / n and x[19] == 1 / n and x[21] == 2 / n
    assert (lex.values("") == 0).all()
    long = " ".join([text] * 20000)
    assert np.allclose(toxicity.Lexicon(lex.entries).values(long)[:10], x[:10])


@needs_data
def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    known = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = toxicity.classify(known, labels).join(labels, "doc_id").toPandas()
    assert len(got) == labels.count() and got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    assert (got["held_out"] == got["doc_id"].map(lambda k: zlib.crc32(str(k).encode()) % 5 == 0)).all()
    own = got[got["held_out"]]
    hit, said = own["toxic"] == 1, own["predicted"] == 1
    assert (hit & said).sum() / said.sum() > 0.96 and (hit & said).sum() / hit.sum() > 0.88


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "some text", "c"), (2, "", "b"), (7, "word " * 60000, "d")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.classify(docs, none).collect()
    assert len(got) == 5 and all(r.score == 0.0 and r.predicted == 0 for r in got)
    odd = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (77, 0), (1, 5), (7, 0)], "doc_id long, toxic int")
    assert toxicity.classify(docs, odd).count() == 5
    assert toxicity.classify(docs.limit(0), odd).count() == 0
    rows = [(i, "you are a grub" if i % 3 == 0 else "a fine day today") for i in range(90)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    labels = plain.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    got = toxicity.classify(plain, labels).collect()
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in got)
    first = {r.doc_id: r.score for r in got}
    again = toxicity.classify(plain.repartition(3, F.rand(1)), labels.repartition(2, F.rand(2))).collect()
    assert {r.doc_id: r.score for r in again} == first
