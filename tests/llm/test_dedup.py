import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from treelake.llm import common, exact_dedup, simhash

SCHEMA = "doc_id long, text string, norm string, salt int, key long, text_sha256 string"


def table(spark, rows):
    return spark.createDataFrame([(k, t, "n", 7, 1, "x") for k, t in rows], SCHEMA)


def brute(rows):
    groups = {}
    for k, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(k)
    return {(k, hashlib.sha256(n.encode()).hexdigest()): (min(i for i in ids if i is not None), len(ids))
            for n, ids in groups.items() for k in ids if any(i is not None for i in ids)}


def check(spark, rows):
    got = exact_dedup.exact_groups(table(spark, rows)).collect()
    assert len(got) == len(rows)
    expected = brute(rows)
    for r in got:
        assert (r.keep_id, r.group_size) == expected[(r.doc_id, r.text_sha256)]
        if r.kept:
            assert r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len({t for _, t in expected})


def test_white_space_nulls_and_repeats(spark):
    check(spark, [(5, "a  b"), (2, "a\t\nb"), (9, "a b"), (7, None), (3, ""), (4, " "), (1, " \x0b"), (9, "a b"), (8, "é  ü"), (None, "a b"),
                  (11, "a b"), (12, "x" * 200_000)])


def test_a_text_that_holds_most_rows(spark):
    rng = random.Random(1)
    rows = [(i, "hot text") for i in range(400)] + [(1000 + i, f"{rng.random()}") for i in range(200)] + [(2000 + i, "hot  text") for i in range(50)]
    rng.shuffle(rows)
    check(spark, rows)


def test_empty_table(spark):
    assert exact_dedup.exact_groups(table(spark, [])).count() == 0
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_drop_keeps_columns_and_one_of_repeated_rows(spark):
    rows = [(5, "a  b"), (2, "a b"), (2, "a b"), (3, "c")]
    out = exact_dedup.drop_exact_copies(table(spark, rows))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(r.doc_id for r in out.collect()) == [2, 3]


def components_by_hand(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(220)] + [(500, 500 + k) for k in range(1, 50)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == components_by_hand(nodes, [e for e in edges])


def test_fingerprint_definition():
    import xxhash

    words = "The QUICK brown fox jumps\tover\nthe lazy dog É".split()
    low = [w.encode().lower() for w in words]
    h = [xxhash.xxh64_intdigest(b" ".join(low[i : i + 4]), 42) for i in range(len(low) - 3)]
    expected = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint("The QUICK  brown fox jumps\tover\nthe lazy dog É ") == expected
    assert simhash.fingerprint("") == simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One two") == xxhash.xxh64_intdigest(b"one two", 42)


def test_every_close_pair_shares_a_bucket_and_passes_its_chain(spark):
    rng = np.random.default_rng(2)
    ring = simhash.Ring(4, 7)
    assert len(ring.kinds) == 35
    rows = []
    for i in range(300):
        x = int(rng.integers(0, 2**63))
        bits = rng.choice(64, int(rng.integers(0, 7)), replace=False)
        y = x ^ sum(1 << int(b) for b in bits)
        rows.append((i, x, y if y < 2**63 else y - 2**64, len(bits)))
    df = spark.createDataFrame(rows, "i long, a long, b long, n int")
    keyed = lambda c: df.select("i", "a", "b", "n", F.explode(ring.keys([F.col(c)])).alias("k")).select("i", "a", "b", "n", "k.*")
    met = keyed("a").join(keyed("b").select("i", "kind", "bits"), ["i", "kind", "bits"]).where(ring.linked(F.col("kind"), [F.col("a")], [F.col("b")]))
    assert {r.i for r in met.select("i").distinct().collect()} == {r[0] for r in rows if r[3] <= 4}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, k = [], 0
    for _ in range(30):
        base = [rng.choice(vocabulary) for _ in range(150)]
        for _ in range(rng.randrange(1, 8)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(150)] = rng.choice(vocabulary)
            rows.append((k, " ".join(copy)))
            k += rng.randrange(1, 9)
    rows += [(10_000, None), (10_001, ""), (10_002, "one two"), (10_003, "One  TWO")]
    rng.shuffle(rows)
    fps = {i: simhash.fingerprint(t) for i, t in rows}
    linked = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    expected = components_by_hand(fps, linked)
    got = simhash.near_duplicates(table(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == expected
    assert all(int(r.fingerprint, 16) == fps[r.doc_id] for r in got)


def test_one_of_each_near_group_stays(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    copies = []
    for k in range(6):
        c = list(base)
        c[40 * k + 3] = "changed"
        copies.append((10 + k, " ".join(c)))
    rows = copies + [(100 + k, " ".join(f"w{rng.randrange(5000)}" for _ in range(300))) for k in range(10)]
    out = simhash.drop_near_copies(table(spark, rows))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(r.doc_id for r in out.collect()) == [10, *range(100, 110)]


def shingles_by_hand(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_similarity_links_what_all_pairs_of_shingle_sets_link(spark):
    rng = random.Random(6)
    rows, k = [], 0

    def put(words):
        nonlocal k
        rows.append((k, " ".join(words)))
        k += 1

    # 49 words with one changed: exactly 0.8. 204 with four: 0.818, with five: 0.778, with seven: 0.702.
    for length, changes in [(49, 1)] * 60 + [(204, 4)] * 60 + [(204, 5)] * 60 + [(204, 7)] * 20:
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        put(base)
        for c in range(changes):
            base[10 + 25 * c] = f"new{c}"
        put(base)
    for _ in range(3):  # versions, each close to the next alone; and members close to a middle one only
        base = [f"w{rng.randrange(5000)}" for _ in range(204)]
        for c in range(15):
            put(base)
            base[5 + 13 * c] = "later"
        base = [f"w{rng.randrange(5000)}" for _ in range(204)]
        for _ in range(15):
            copy = list(base)
            for at in rng.sample(range(5, 200, 6), rng.randrange(5)):
                copy[at] = f"m{k}"
            put(copy)
    rows += [(10_000, None), (10_001, " "), (10_002, "one two"), (10_003, "One  TWO"), (10_004, "a b c d e f " * 50), (10_005, "a b c d e f " * 9)]
    sets = {i: shingles_by_hand(t) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table(spark, rows), words=5, similarity=0.8).collect()}
    assert got == components_by_hand(sets, linked)
    kept = {r.doc_id for r in simhash.drop_near_copies(table(spark, rows)).collect()}
    assert kept == set(got.values())


def test_bands_miss_next_to_no_pair():
    ring = simhash.Bands(0.8)
    rng = np.random.default_rng(8)
    shared = missed = over = equal = 0
    for _ in range(400):
        both = rng.integers(0, 1 << 63, 180, np.uint64)
        x, y = (simhash.minima(np.unique(np.concatenate([both[:160], own]))) for own in rng.integers(0, 1 << 63, (2, 20), np.uint64))
        same = (x == y)[: ring.rows * ring.bands].reshape(ring.bands, ring.rows).all(1)
        shared += same.any()
        missed += not same.any()
        equal += (x == y).mean() / 400
        bits = (x * np.uint32(0x9E3779B1) >> np.uint32(31)) != (y * np.uint32(0x9E3779B1) >> np.uint32(31))
        over += bits.sum() > ring.limit
    assert (shared, missed, over) == (400, 0, 0) and abs(equal - 0.8) < 0.01


def test_whole_rows_survive_the_sort(spark):
    """Columns with the operator's own names, rows that differ beside id and text, a hot text and null ids."""
    rows = [(1, "a  b", "x", 1), (1, "a b", "y", 2), (2, "a\tb", "z", 3), (None, "c", "n", 4), (None, "c", "m", 5), (3, None, "e", 6), (4, "", "f", 7), (5, "long " * 60000, "l", 8)]
    rows += [(100 + i, "hot", "h", i) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __sha string, whole long").repartition(6)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    got = {(r.doc_id, (r.text or "").replace("\t", " ").replace("  ", " ")) for r in kept.collect()}
    assert got == {(1, "a b"), (None, "c"), (3, ""), (5, "long " * 60000), (100, "hot")} and kept.count() == 5
    again = exact_dedup.drop_exact_copies(docs.repartition(3, F.rand(4)))
    assert sorted(map(str, again.collect())) == sorted(map(str, kept.collect()))
    assert exact_dedup.drop_exact_copies(docs.limit(0)).count() == 0


def test_fingerprints_of_very_long_texts(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short text")], "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert int(got[1].fingerprint, 16) == simhash.fingerprint(long) and got[2].component_id == 1 and got[3].component_id == 3


def test_parities_never_refuse_a_pair_of_the_similarity():
    rng = np.random.default_rng(4)
    for n, apart in [(0, 0), (0, 3), (120, 30), (120, 60), (3000, 700), (3000, 9000)]:
        pool = rng.integers(0, 1 << 63, n + apart, np.uint64)
        x, y = np.unique(pool[: n + apart // 2]), np.unique(np.concatenate([pool[:n], pool[n + apart // 2 :]]))
        bits = sum(bin(int(a)).count("1") for a in (simhash.parities(x) ^ simhash.parities(y)).astype(np.uint64))
        assert bits <= apart and (apart > 100 or bits >= apart - 8)


def test_unlike_versions_of_one_text_are_not_compared_in_pairs(spark, monkeypatch):
    # Every version is at 0.7 or so to any other: hundreds of classes in the same buckets.
    rng = random.Random(12)
    base, rows = [f"w{i}" for i in range(150)], []
    for k in range(200):
        copy = list(base)
        for at in rng.sample(range(5, 145, 7), 3):
            copy[at] = f"x{k}"
        rows.append((k, " ".join(copy)))
    sets = {i: shingles_by_hand(t) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    compared, confirmed = [], simhash.confirmed
    monkeypatch.setattr(simhash, "confirmed", lambda pairs, *rest: compared.append(pairs.count()) or confirmed(pairs, *rest))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table(spark, rows), words=5, similarity=0.8).collect()}
    assert got == components_by_hand(sets, linked)
    assert sum(compared) <= 4 * (len(rows) + len(linked))


def test_no_bucket_keys_are_broadcast(spark):
    """A table of 6000 fingerprints has 210,000 keys, some 7 MB, though its file is below the limit of broadcasts."""
    rng = np.random.default_rng(8)
    x = rng.integers(-(2**63), 2**63 - 1, 3000)
    pairs = np.stack([x, x ^ (1 << rng.integers(0, 63, 3000))])
    fps = common.cut(spark.createDataFrame([(int(f), int(f)) for f in pairs.ravel()], "id long, f0 long"))
    limits = {"spark.sql.autoBroadcastJoinThreshold": "512k", "spark.sql.maxBroadcastTableSize": "2m"}
    before = {k: spark.conf.get(k) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        got = {r.id: r.root for r in simhash.fingerprint_components(fps, simhash.Ring(4, 7)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {int(f): int(min(p)) for p in pairs.T for f in p}
