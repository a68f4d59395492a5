import random

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from treelake.llm import tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")

ODD = ["", " ", "  a  b ", "it's they'll WE'RE", "x\n\ny \n z", "a<|endoftext|>b <|startoftext|>c", "<|ENDOFTEXT|>", "don't...stop",
       "Ünïcödé ŒUVRE ß İstanbul ΣΑΣ", "日本語 のテキスト", "é café ́x", "a b c\x1cd\x85e", "tab\tsep\r\nline", "1234567 3.14",
       "😀😀 emoji 👩‍👩‍👧", "a_. b_, c", "!!! ??? ***", "th, th. th.\nTh, x", "end,", "end.", ",", ". ", "¿Qué? ¡Sí!", "a" * 700, "ab" * 400 + "!" * 300,
       "\x00\x01 z", "²³¼ ½", "﷽ ﬁ", "a. . b, , c", "trailing space ", "\n", "'s 's", "x's. y'd, z"]


def noise(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    alphabet = "aaeinrst .,'\n  ABé!?-_1290ß\t# 中́<|>"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_words_like_the_library():
    lib, own = Tokenizer.from_file(WORDS), tokens.WordEncoder(WORDS)
    texts = ODD + noise(1, 1500)
    for text, raw in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_bytes_like_the_library():
    lib, own = Tokenizer.from_file(BYTES), tokens.ByteEncoder(BYTES)
    for text in ODD + noise(2, 1500):
        ids = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids, repr(text)
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False), repr(text)


def test_long_words_take_the_same_merges():
    own = tokens.ByteEncoder(BYTES)
    rng = random.Random(3)
    for _ in range(40):
        word = bytes(rng.choice(b"abcdeinrst") for _ in range(rng.randrange(1, 120)))
        assert own._long([own.single[b] for b in word]) == own.word(word)


@pytest.mark.parametrize("values", [
    [], [0], [1] * 5000, list(range(5000)), [49407, 1, 0] * 3000, [2**63, 5, 2**60, 2**60 - 1, 0, 2**64 - 1], [2**64 - 1] * 4100,
    [0] * 4095 + [2**61] + [7] * 20])
def test_code_round_trip(values):
    v = np.array(values, np.uint64)
    words, offsets = tokens.simple8b_encode(v)
    assert len(offsets) == -(-len(v) // tokens.BLOCK)
    assert tokens.simple8b_decode(words, offsets, len(v)).tolist() == v.tolist()


def test_code_round_trip_of_random_widths():
    rng = np.random.default_rng(4)
    for n in (1, 59, 60, 61, 4096, 4097, 20000):
        v = rng.integers(0, 2**62, n, dtype=np.uint64) >> rng.integers(0, 62, n).astype(np.uint64)
        words, offsets = tokens.simple8b_encode(v)
        assert (tokens.simple8b_decode(words, offsets, n) == v).all()
    assert len(tokens.simple8b_encode(np.ones(4096, np.uint64))[0]) == 69


def test_files_keep_the_order(spark, tmp_path):
    texts = {5: "Five five.", 2: None, 9: "", 7: "x " * 3000, None: "null id"}
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()] + [(5, "Five five.", "x")], "doc_id long, text string, start string")
    out = str(tmp_path / "files")
    tokens.write_token_files(docs, out, WORDS, end_id=2)
    got = tokens.read_token_files(spark, out, keep_ids=True).toPandas().sort_values("start")
    assert [None if pd.isna(x) else x for x in got["doc_id"]] == [None, 2, 5, 5, 7, 9]
    lib = Tokenizer.from_file(WORDS)
    start = 0
    for r in got.itertuples():
        expected = lib.encode(texts[None if pd.isna(r.doc_id) else r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert list(r.ids) == expected and r.start == start and r.n_tokens == len(expected)
        start += len(expected)


def test_files_of_an_empty_table(spark, tmp_path):
    out = str(tmp_path / "none")
    tokens.write_token_files(spark.createDataFrame([], "doc_id long, text string"), out, WORDS)
    assert tokens.read_token_files(spark, out).count() == 0


def test_round_trip_rows(spark):
    docs = spark.createDataFrame([(1, "Hello  world"), (2, None), (1, "Hello  world")], "doc_id long, text string")
    got = tokens.bpe_round_trip(docs, BYTES, keep_ids=True).toPandas().sort_values("doc_id")
    assert got["decoded"].tolist() == ["Hello  world", "Hello  world", ""]
    assert got["n_tokens"].tolist()[2] == 0


def test_large_ids_beside_nulls(spark, tmp_path):
    from treelake.llm import html_text, langid, packing, quality, simhash

    big = 2**53 + 1
    docs = spark.createDataFrame([(big, "some text", "en"), (None, "other text", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(big, 1)], "doc_id long, quality int")
    out = str(tmp_path / "big")
    tokens.write_token_files(docs, out, WORDS)
    for got in (tokens.bpe_round_trip(docs, BYTES), tokens.read_token_files(spark, out), packing.pack_documents(docs, WORDS, 1),
                simhash.near_duplicates(docs), langid.identify(docs), quality.classify(docs, labels), quality.classify(docs, labels, keep=True),
                html_text.extract(docs, "doc_id", "lang", "text").withColumnRenamed("page_id", "doc_id")):
        assert {r.doc_id for r in got.collect()} == {big, None}
