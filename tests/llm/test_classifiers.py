import math
import os
import zlib

import pytest
from pyspark.sql import functions as F

from treelake.llm import langid, quality

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@needs_data
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["held_out"] == got["doc_id"].map(lambda k: zlib.crc32(str(k).encode()) % 5 == 0)).all()
    own = got[got["held_out"]]
    assert (own["lang_pred"] == own["lang"]).mean() > 0.98


def test_language_of_odd_texts(spark):
    rows = [(i, t, lang, i) for i, (t, lang) in enumerate([("the cat and the dog were here with them", "en"), ("le chat et le chien sont dans la maison", "fr")] * 30)]
    rows += [(1000, None, "en", 0), (1001, "", None, 0), (1002, "123 !?", "fr", 0), (1003, "the dog " * 30000, None, 0), (None, "la maison", "fr", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1003].lang_pred == "en" and not got[None].held_out
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_against_a_plain_vote(spark):
    """The same machines, a text at a time: duels between families, then between the languages of the winning one."""
    texts = ["the cat and the dog were here with them", "le chat et le chien sont dans la maison", "der Hund und die Katze sind nicht im Haus", "el perro y el gato no son de la casa"]
    docs = spark.createDataFrame([(i, f"{texts[i % 4]} {i}", ("en", "fr", "de", "es")[i % 4]) for i in range(120)], "doc_id long, text string, lang string")
    model = langid.fit(docs)

    def plain(text):
        h, _, n = langid.trigrams([text])
        margins = model.weights[h].sum(0) / max(1, n[0]) + model.bias if len(h) else model.bias

        def winner(names, pairs, at):
            votes = {v: (0, 0.0) for v in names}
            for k, (a, b) in enumerate(pairs):
                m = margins[at + k]
                for v, s in ((a, m), (b, -m)):
                    votes[v] = (votes[v][0] + (s >= 0 if v == a else s > 0), votes[v][1] + s)
            return max(names, key=lambda v: votes[v])

        family, at = winner(sorted(model.families), model.between, 0), len(model.between)
        for f in sorted(model.families):
            if f == family:
                return winner(model.families[f], model.within[f], at)
            at += len(model.within[f])

    own = [f"{t} und le" for t in texts] + texts + ["haus und hof", "la maison", "gato"]
    assert model.predict(own)[0] == [plain(t) for t in own]
    empty = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert empty.predict(["some text", ""])[0] == ["und", "und"] and empty.predict(["some text", ""])[1].tolist() == [0.0, 0.0]


@needs_data
def test_quality_against_plain_arithmetic(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit(docs, labels)
    for text in ["", "A plain sentence of some words.", "BUY NOW!!! BUY NOW!!!", "a a a a b " * 50]:
        x = (quality.pooled(quality.token_rows(text), model.vectors) - model.mean) * model.scale
        first, bias, second, last = model.layers
        hidden = [max(0.0, sum(x[i] * first[i, j] for i in range(len(x))) + bias[j]) for j in range(len(bias))]
        logit = sum(h * w for h, w in zip(hidden, second)) + last
        assert model.score([text])[0] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, logit / model.temperature)))), abs=1e-6)


@needs_data
def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    own = got[got["held_out"]]
    assert (own["held_out"] == own["doc_id"].map(lambda k: zlib.crc32(str(k).encode()) % 3 == 1)).all()
    assert (own["predicted"] == own["quality"]).mean() > 0.97


def test_quality_learns_from_long_texts_whatever_the_partitions(spark):
    rows = [(i, "good words in order here " * (12_000 if i % 30 == 0 else 9) if i % 2 == 0 else "BUY NOW!!! " * 20) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert all(r.predicted == 1 - k % 2 for k, r in got.items())
    again = quality.classify(docs.repartition(3, F.rand(1)), labels.repartition(2, F.rand(2))).collect()
    assert {r.doc_id: r.score for r in again} == {k: r.score for k, r in got.items()}


def test_quality_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "some text", "c"), (2, "", "b")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify(docs, none).collect()
    assert len(got) == 4 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    odd = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (77, 0), (1, 5)], "doc_id long, quality int")
    kept = quality.classify(docs, odd, keep=True)
    assert kept.columns == ["doc_id", "text", "score", "__score"] and kept.count() == 4
    assert quality.classify(docs.limit(0), odd).count() == 0
