import math
import os
import random
import zlib
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from treelake.llm import trie

DATA = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """All prefixes of all rebuilt conversations in dictionaries."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]  # % as in SQL: towards zero
    members, children = {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) if below else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[q] for q in below)
    out = set()
    for p, m in members.items():
        ids = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], sha256(ids.encode()).hexdigest()))
    return out


def test_names_follow_prefixes():
    rng = random.Random(1)
    seen = {}
    for _ in range(300):
        items = [bytes([rng.randrange(2)]) for _ in range(rng.randrange(20))]
        for j, name in enumerate(trie.prefix_names(items), 1):
            assert seen.setdefault(name, tuple(items[:j])) == tuple(items[:j])
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("bits", [1, 10])
def test_trie_against_dictionaries(spark, bits):
    rng = random.Random(bits)
    rows = []
    for c in [*range(0, 60), *range(100, 140), *range(250, 260), -3, 7 * 10**12]:
        for t in range(rng.choice([1, 1, 2, 4, 7, 9])):
            rows.append((c, t if t else None, rng.choice(["user", None]), rng.choice(["", "a", "b é", None])))
    deep = [(400, t, "user", "deep") for t in range(70)] + [(401, t, "user", "deep") for t in range(40)] + [(2, t, "x", "long " * 30000) for t in (100, 101)]
    rows += deep + [(None, 1, "user", "nobody"), (None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("name", F.lit("clash")).withColumn("depth", F.lit(1)).repartition(5)
    got = [tuple(r) for r in trie.prefix_trie(df, bits).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_trie_of_little(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(none).count() == 0
    # A conversation whose turns all give way to those of a base that has none.
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1)
    rows = [(c, 0, "user", "gone")]
    assert {tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()} == plain(rows)
    ties = [(100, 1, "user", "same")] * 9
    assert {tuple(r) for r in trie.prefix_trie(spark.createDataFrame(ties, SCHEMA)).collect()} == plain(ties)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_sql_against_dictionaries():
    con = duckdb.connect()
    con.sql(f"create view conversations as from '{DATA}/conversations.parquet'")
    rows = con.sql("select conv_id, turn, role, text from conversations").fetchall()
    got = con.sql(trie.ORACLE).fetchall()
    assert len(got) == len(set(got)) and set(got) == plain(rows)
