import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from treelake.llm import packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


def fill(counts, capacity):
    """The sequences that a plan fills: {sequence: [(offset, length)]}."""
    out, used = {}, {}
    for n, first, last, sequence, offset in packing.plan(counts, capacity):
        assert first == used.get(n, 0)
        used[n] = last
        for k in range(last - first):
            out.setdefault(sequence + k, []).append((offset, n))
    assert used == {n: c for n, c in counts.items() if c}
    for parts in out.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= capacity
    return out


@pytest.mark.parametrize("seed", range(12))
def test_plans_are_whole_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([30, 100, 4096])
    counts = {n: rng.randrange(1, 40) for n in rng.sample(range(1, capacity + 1), min(capacity, rng.randrange(1, 60)))}
    bins = fill(counts, capacity)
    total = sum(n * c for n, c in counts.items())
    large = sum(c for n, c in counts.items() if 2 * n > capacity)
    lower = max(-(-total // capacity), large)
    assert len(bins) <= lower * 1.25 + 2


def test_plan_edges():
    assert packing.plan({}, 10) == []
    assert len(fill({10: 5}, 10)) == 5
    assert len(fill({5: 6}, 10)) == 3
    assert len(fill({1: 25}, 10)) == 3
    assert len(fill({6: 3, 4: 3}, 10)) == 3


def test_documents(spark):
    texts = {1: "word " * 9000, 2: None, 3: "", 4: "a few words", 5: "a few words"}
    docs = spark.createDataFrame([(k, t, 0, 0) for k, t in texts.items()] + [(5, "a few words", 0, 0), (None, "no id", 0, 0)],
                                 "doc_id long, text string, length int, offset int")
    got = packing.pack_documents(docs, WORDS, end_id=1, keep_ids=True).toPandas()
    lib = Tokenizer.from_file(WORDS)
    for key, text in texts.items():
        own = got[got["doc_id"] == key].drop_duplicates("piece").sort_values("piece")
        ids = [i for part in own["ids"] for i in part]
        assert ids == lib.encode(text or "", add_special_tokens=False).ids + [1]
        assert own["start"].tolist() == [4096 * k for k in range(len(own))]
    assert len(got[got["doc_id"] == 5]) == 2 and got["doc_id"].isna().sum() == 1
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows["offset"].tolist() == [0, *rows["length"].cumsum().tolist()[:-1]]
        assert rows["length"].sum() <= 4096
    assert got["sequence_id"].nunique() == 3


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, WORDS, end_id=1).count() == 0
