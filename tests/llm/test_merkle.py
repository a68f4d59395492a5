import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from treelake.llm import merkle


def H(s):
    return sha256(s.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def plain(rows, tampers):
    """Rows (doc_id, source, lang, n_chars, text) by lists and recursion over whole trees."""
    def leaf(r):
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: sorted((r for r in rows if r[2] == k), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for k in langs}
    built = {k: levels([leaf(r) for r in own]) for k, own in trees.items()}
    top = levels([built[k][-1][0] for k in langs])
    out = []
    for n, k in enumerate(langs):
        for i, r in enumerate(trees[k]):
            path = []
            for tree, at in ((built[k], i), (top, n)):
                for level in tree[:-1]:
                    path.append((at % 2, level[at ^ 1] if at ^ 1 < len(level) else ""))
                    at //= 2
            now = leaf((*r[:3], r[3] + 1, r[4])) if tampers(r) and r[3] is not None else leaf(r)
            for left, s in path:
                now = H(s + now if left else now + s)
            out.append((r[0], leaf(r), built[k][-1][0], top[-1][0], H("".join(s for _, s in path)), now, now == top[-1][0]))
    return out


def by_crc(r):
    return r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0


def test_layout_is_a_permutation_with_subtrees_together():
    for height in range(1, 9):
        at = merkle.addresses(height)
        assert [len(level) for level in at] == [2**k for k in reversed(range(height))]
        assert sorted(x for level in at for x in level) == list(range(2**height - 1))
        assert at[-1] == [0]
    at = merkle.addresses(4)
    assert [at[3][0], *at[2]] == [0, 1, 2] and [at[1][0], *at[0][:2]] == [3, 4, 5] and [at[1][3], *at[0][6:]] == [12, 13, 14]


@pytest.mark.parametrize("height", [1, 3, 10])
def test_manifest_against_whole_trees(spark, height):
    rows = [(i, f"s{i % 3}", None if i % 11 == 0 else "en" if i % 10 < 7 else ["fr", "ü", "z"][i % 3], None if i % 13 == 0 else i, f"text é {i % 5}") for i in range(90)]
    rows += [(None, None, None, None, None), (5, None, "en", 3, ""), (5, None, "en", 3, ""), (1000, "x", "only", 7, "w " * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("grp", F.lit(1))
    got = [tuple(r) for r in merkle.manifest(docs, merkle.tampered(), height).collect()]
    want = plain(rows, by_crc)
    key = lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_of_little(spark):
    none = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(none).count() == 0
    one = [(3, "s", None, 4, "text")]
    got = merkle.manifest(spark.createDataFrame(one, none.schema)).collect()
    assert [tuple(r) for r in got] == plain(one, lambda r: False)
    assert got[0].leaf == got[0].root and got[0].proof_sha256 == H("") and got[0].verified
