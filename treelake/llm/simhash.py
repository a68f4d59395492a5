"""SimHash near-duplicates: fingerprints, pigeonring candidates, components.

A document's fingerprint has a bit set where over half of its shingles' XXH64 values have it.
Two fingerprints link at ``max_bits`` or fewer differing bits.

Pigeonring: the 64 bits form a ring of ``m`` segments. If two fingerprints differ in at most ``t``
bits, some start on the ring has every chain of ``l`` consecutive segments differ in at most
``l t / m`` bits, for every length ``l`` from 1 to ``m``. With ``m`` and ``t`` without common
divisor, each choice of ``m - t`` segments that agree fits exactly one such start, so the agreeing
segments of the chain serve as the bucket key, and each later chain length prunes the bucket's
pairs before the full Hamming check, which is the chain of length ``m``.

Buckets are never expanded into all their pairs. First every fingerprint meets only the least one
of each of its buckets (a count and a minimum, aggregated before the shuffle). Labels spread over those
links settle almost every large bucket. Only buckets that still hold several labels are joined
with themselves, and only across labels, which finds every link that is still missing.

A similarity instead of a number of bits compares sets of shingles: MinHash bands are the bucket keys, one bit
of each minimum makes a sketch that sorts out clearly unlike pairs, the parities of the shingles in each of 1024 cells
bound the sets' difference from below, and every pair that passes is
confirmed by the Jaccard likeness of the two texts' own shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache, reduce
from itertools import combinations
from math import gcd, sqrt
from operator import add, and_, or_

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake.llm.common import components, cut, exact_id
from treelake.skew import SMALL, lookup

WORDS, MAX_BITS, SEGMENTS, SEED = 4, 4, 7, 42


#: Minima of a sketch, and the share of pairs at the similarity itself that its bands may miss.
MINIMA, MISSED = 256, 1e-5
_MIX = np.random.default_rng(SEED).integers(0, 1 << 32, (2, MINIMA, 1), np.uint32)
_MIX[1] |= 1
#: Words of 64 cells whose parities a shingle set keeps.
PARITY = 16


def _shingles(text: str | None, words: int) -> list[bytes]:
    """Runs of ``words`` words, A-Z lower-cased, with repeats; a shorter text is one; none without a word."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    if len(parts) <= words:
        return [joined]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - words + 1].tolist()
    return [joined[a:b] for a, b in zip(starts, ends[words - 1 :].tolist())]


def _majority(text: str | None, words: int, size: int, hashes: Callable[[bytes], bytes]) -> bytes:
    """``size`` bytes: each bit is set if over half of the shingles' hashes have it; zeros without a word."""
    raw = [hashes(s) for s in _shingles(text, words)]
    if not raw:
        return bytes(size)
    ones = np.zeros(8 * size, np.int64)
    for at in range(0, len(raw), 16384):
        grid = np.frombuffer(b"".join(raw[at : at + 16384]), np.uint8).reshape(-1, size)
        ones += np.unpackbits(grid, axis=1).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(raw)).tobytes()


def _xxh64(shingle: bytes) -> bytes:
    return xxhash.xxh64_digest(shingle, SEED)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    raw = b"".join([xxhash.xxh3_64_digest(s, SEED) for s in _shingles(text, words)])
    return np.unique(np.frombuffer(raw, ">u8").astype(np.uint64))


def minima(shingles: np.ndarray) -> np.ndarray:
    """``MINIMA`` minima of the set under as many hash functions."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(least, ((low[at : at + 1024] ^ _MIX[0]) * _MIX[1]).min(1), out=least)
    return least


def parities(shingles: np.ndarray) -> np.ndarray:
    """``PARITY`` numbers of 64 bits: whether each cell holds an odd number of the set's shingles. Every shingle that only one of two
    sets has changes one bit, so two sets differ in no fewer shingles than their parities in bits."""
    odd = np.bincount((shingles % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint of one text as an unsigned 64-bit number; 0 if it has no word."""
    return int.from_bytes(_majority(text, words, 8, _xxh64), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, f0 long): whole texts, one at a time inside Arrow batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = b"".join([_majority(t, words, 8, _xxh64) for t in b["text"]])
            yield pd.DataFrame({"doc_id": b["doc_id"], "f0": np.frombuffer(raw, ">i8").astype(np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(exact_id(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id string, f0 long").withColumn("doc_id", F.col("doc_id").cast(kind))


def sketches(docs: DataFrame, ring: Bands, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, text, id, f0 to f3, size, g0 ..., bands): ``id`` is a hash of the shingle set, f0 to f3 one bit of each minimum, g0 ... the
    parities."""
    rows = ring.rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, sizes, bits, odd, bands = [], [], [], [], []
            for text in b["text"]:
                shingles = shingle_set(text, words)
                least = minima(shingles)
                ids.append(_signed(xxhash.xxh3_64_intdigest(shingles.tobytes(), SEED)))
                sizes.append(len(shingles))
                bits.append(np.packbits(least * np.uint32(0x9E3779B1) >> np.uint32(31)).tobytes())
                odd.append(parities(shingles))
                raw = least.tobytes()
                bands.append([_signed(xxhash.xxh3_64_intdigest(raw[4 * rows * j : 4 * rows * (j + 1)], j)) for j in range(ring.bands)])
            grid = np.frombuffer(b"".join(bits), ">i8").astype(np.int64).reshape(-1, 4)
            cells = np.array(odd, np.int64).reshape(-1, PARITY)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": b["text"], "id": np.array(ids, np.int64),
                                **{f"f{i}": grid[:, i] for i in range(4)}, "size": np.array(sizes, np.int64),
                                **{f"g{i}": cells[:, i] for i in range(PARITY)}, "bands": bands})

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(exact_id(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    longs = ", ".join(f"{n} long" for n in ("id", *ring.names))
    out = given.mapInPandas(run, f"doc_id string, text string, {longs}, bands array<long>")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def confirmed(pairs: DataFrame, rows: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """The ``pairs`` (u, v: ids of ``rows``, one row each) whose texts' shingle sets have that Jaccard likeness or more."""
    top, bottom = similarity.numerator, similarity.denominator
    pairs = cut(pairs)
    wanted = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    texts = cut(rows.select("id", "text").join(wanted, "id", "left_semi"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = lru_cache(16)(lambda text: shingle_set(text, words))
        for b in batches:
            keep = []
            for s, t in zip(b["s"], b["t"]):
                x, y = of(s), of(t)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common * bottom >= top * (len(x) + len(y) - common))
            yield b.loc[keep, ["u", "v"]]

    both = (pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("s")), "u")
            .join(texts.select(F.col("id").alias("v"), F.col("text").alias("t")), "v"))
    return both.select("u", "v", "s", "t").mapInPandas(run, "u long, v long")


class Ring:
    """The segments, and for each bucket kind the segments that agree and the chain's start."""

    def __init__(self, max_bits: int, segments: int):
        if gcd(max_bits, segments) != 1 or segments <= max_bits:
            raise ValueError("segments must exceed max_bits and share no divisor with it")
        self.t, self.m = max_bits, segments
        cuts = [64 * i // segments for i in range(segments + 1)]
        self.masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
        self.kinds = [(s, self._start(set(s))) for s in combinations(range(segments), segments - max_bits)]

    def _start(self, agree: set[int]) -> int:
        for i in range(self.m):
            wrong = 0
            for n in range(self.m):
                wrong += (i + n) % self.m not in agree
                if wrong * self.m > (n + 1) * self.t:
                    break
            else:
                return i
        raise AssertionError("the ring has no start")

    names = ("f0",)

    def keys(self, fp: list[Column]) -> Column:
        """An array of (kind, agreeing bits), one for each kind of bucket."""
        lits = [(k, _signed(sum(self.masks[i] for i in s))) for k, (s, _) in enumerate(self.kinds)]
        return F.array(*[F.struct(F.lit(k).alias("kind"), fp[0].bitwiseAND(F.lit(mask).cast("long")).alias("bits"))
                         for k, mask in lits])

    def linked(self, kind: Column, a: list[Column], b: list[Column]) -> Column:
        """The chains of 2 to m segments from the kind's start stay within their budgets."""
        x = a[0].bitwiseXOR(b[0])
        out = F.lit(True)
        for length in range(2, self.m + 1):
            chain = [_signed(sum(self.masks[(i + n) % self.m] for n in range(length))) for _, i in self.kinds]
            mask = F.element_at(F.array(*[F.lit(c).cast("long") for c in chain]), kind + 1)
            out = out & (F.bit_count(x.bitwiseAND(mask)) <= length * self.t // self.m)
        return out


class Bands:
    """Buckets for shingle sets of a Jaccard similarity or more.

    Each minimum is equal with the sets' likeness J as its chance. A bucket is a band of ``rows`` equal minima, as
    many as leave at most ``MISSED`` of the pairs at the similarity itself without a common bucket. A pair of a bucket
    is worth a comparison if the sizes allow the similarity and its one-bit sketches differ in
    no more than the expected ``MINIMA (1 - J) / 2`` bits and six deviations, which some chain of segments on their ring shows
    at every length, and if their parities differ in no more bits than sets of that likeness may differ in shingles, which
    refuses no pair at the similarity or above.
    """

    bits = ("f0", "f1", "f2", "f3")
    names = (*bits, "size", *(f"g{i}" for i in range(PARITY)))

    def __init__(self, similarity: float):
        self.least = Fraction(str(similarity))
        fit = [r for r in range(1, 17) if (1 - similarity**r) ** (MINIMA // r) <= MISSED]
        if not fit:
            raise ValueError("the similarity is too low to search for")
        self.rows = max(fit)
        self.bands = MINIMA // self.rows
        odds = (1 - similarity) / 2
        self.limit = int(MINIMA * odds + 6 * sqrt(MINIMA * odds * (1 - odds)))

    def linked(self, a: list[Column], b: list[Column]) -> Column:
        apart = [F.bit_count(p.bitwiseXOR(q)) for p, q in zip(a[:4], b[:4])]
        small, large = F.least(a[4], b[4]), F.greatest(a[4], b[4])

        def chain(start: int) -> Column:
            """Every chain of segments from ``start`` on stays within its share of the limit."""
            sums = [reduce(add, [apart[(start + k) % 4] for k in range(n)]) for n in range(1, 5)]
            return reduce(and_, [s * 4 <= n * self.limit for n, s in enumerate(sums, 1)])

        top, bottom = self.least.numerator, self.least.denominator
        differ = reduce(add, [F.bit_count(p.bitwiseXOR(q)) for p, q in zip(a[5:], b[5:])])
        return (reduce(or_, [chain(i) for i in range(4)]) & (small * bottom >= large * top)
                & (differ * (bottom + top) <= (small + large) * (bottom - top)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_components(fps: DataFrame, ring: Ring) -> DataFrame:
    """(id, root) for every row of ``fps`` (id long, f0, ...; ids and fingerprints distinct) linked to another.

    ``root`` is the same for two rows if and only if a path of links joins them.

    Spark sizes what an explode makes as if it made one row of each, which would have the keys of all buckets broadcast; both joins
    of them ask for a shuffle.
    """
    names = list(ring.names)
    of = lambda prefix: [F.col(prefix + n) for n in names]
    keyed = fps.select("id", *names, F.explode(ring.keys(of(""))).alias("k")).select("id", *names, "k.kind", "k.bits")
    hubs = (keyed.groupBy("kind", "bits").agg(F.min("id").alias("hub"), F.count("*").alias("n"),
                                              *[F.min_by(n, "id").alias(f"hub_{n}") for n in names])
            .where("n > 1").drop("n"))
    links = keyed.hint("merge").join(hubs, ["kind", "bits"]).where("id <> hub").where(ring.linked(F.col("kind"), of(""), of("hub_")))
    links = cut(links.select(F.col("id").alias("u"), F.col("hub").alias("v")).distinct())

    # Two steps towards the least hub: labels that are equal only inside a component, which is all
    # that pruning needs.
    least = links.groupBy("u").agg(F.min("v").alias("v"))
    above = least.select(F.col("u").alias("v"), F.col("v").alias("top"))
    label = least.join(above, "v", "left").select(F.col("u").alias("id"), F.coalesce("top", "v").alias("label"))
    marked = fps.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    placed = marked.select("id", "label", *names, F.explode(ring.keys(of(""))).alias("k")).select("id", "label", *names, "k.kind", "k.bits")
    open_ = (placed.groupBy("kind", "bits").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
             .where("lo < hi").select("kind", "bits"))
    left = placed.join(open_, ["kind", "bits"], "left_semi")
    a, b = left.hint("merge").alias("a"), left.alias("b")
    across = a.join(b, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.bits") == F.col("b.bits"))
                    & (F.col("a.label") < F.col("b.label")) & ring.linked(F.col("a.kind"), of("a."), of("b.")))
    more = across.select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))
    return components(links.union(more)).withColumnRenamed("node", "id")


def set_components(rows: DataFrame, ring: Bands, words: int) -> DataFrame:
    """(id, root) for every set of ``rows`` (:func:`sketches`; sets may repeat) linked to another, as in
    :func:`fingerprint_components`, every link confirmed on the texts.

    Most sets share no bucket with another, so buckets are counted by their keys alone; sketches and texts are only fetched for
    the sets that meet one.
    """
    names = list(ring.names)
    keyed = rows.select("id", F.explode("bands").alias("bits"))
    hubs = cut(keyed.groupBy("bits").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.count("*").alias("n"))
               .where("hub < last").drop("last"))
    met = cut(lookup(keyed, hubs, "bits", "n").distinct())
    own = rows.select("id", "text", *names)
    known = cut(lookup(own, cut(met.groupBy("id").agg(F.count("*").alias("n"))), "id", "n")
                .groupBy("id").agg(*[F.first(n).alias(n) for n in ("text", *names)]))
    named = lambda prefix: known.select(*[F.col(n).alias(prefix + n) for n in ("id", *names)])
    of = lambda prefix: [F.col(prefix + n) for n in names]
    tried = cut(met.where("id <> hub").select(F.col("id").alias("u_id"), F.col("hub").alias("v_id")).distinct())
    likely = tried.join(named("u_"), "u_id").join(named("v_"), "v_id").where(ring.linked(of("u_"), of("v_")))
    links = cut(confirmed(likely.select(F.col("u_id").alias("u"), F.col("v_id").alias("v")), known, words, ring.least))

    # A refused hub leaves more labels; comparing texts costs more than settling them.
    label = components(links).select(F.col("node").alias("id"), F.col("root").alias("label"))
    marked = cut(met.join(label, "id", "left").select("id", "bits", F.coalesce("label", "id").alias("label")))
    open_ = marked.groupBy("bits").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bits")
    left = cut(marked.join(open_, "bits", "left_semi").join(known.select("id", *names), "id"))
    a, b = left.alias("a"), left.alias("b")
    across = a.join(b, (F.col("a.bits") == F.col("b.bits")) & (F.col("a.label") < F.col("b.label")) & ring.linked(of("a."), of("b.")))
    more = across.select(F.greatest("a.id", "b.id").alias("u"), F.least("a.id", "b.id").alias("v")).distinct()
    more = more.join(tried, (F.col("u") == F.col("u_id")) & (F.col("v") == F.col("v_id")), "left_anti")
    return components(links.union(confirmed(more, known, words, ring.least))).withColumnRenamed("node", "id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    max_bits: int = MAX_BITS, segments: int = SEGMENTS, similarity: float | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Words are runs of anything but the six ASCII white-space characters, A-Z lower-cased; shingles
    count with their repeats. A text of fewer words is one shingle; one without words, or null, has
    fingerprint zero and is linked like any other. component_id is the smallest doc_id reachable;
    rows that repeat an id get the same class if their texts do; a null id never names a class
    (null if all of its class are). An empty table gives an empty result. With ``similarity``, texts link whose sets of
    shingles have that Jaccard likeness instead of by ``max_bits``; texts without words are one class, and
    ``fingerprint`` is the sketch of 256 bits (64 hex digits).
    """
    if similarity is None:
        ring = Ring(max_bits, segments)
        fps = cut(fingerprints(docs, id_col, text_col, words))
        classes = cut(fps.groupBy("f0").agg(F.min("doc_id").alias("least")).withColumn("id", F.col("f0")))
        rooted, bits = fingerprint_components(classes.drop("least"), ring), ring.names
    else:
        ring = Bands(similarity)
        fps = cut(sketches(docs, ring, id_col, text_col, words))
        classes = cut(fps.groupBy("id").agg(F.min("doc_id").alias("least")))
        rooted, bits = set_components(fps, ring, words), ring.bits
    placed = classes.join(rooted, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    own = "f0" if similarity is None else "id"
    # A class may hold a large share of the fingerprints, and a fingerprint of the rows.
    rows_of = fps.groupBy(own).agg(F.count("*").alias("n_rows"))
    named = lookup(placed, named, "root", "n").select(own, "component_id").join(rows_of, own)
    hexed = F.concat(*[F.lpad(F.lower(F.hex(n)), 16, "0") for n in bits])
    return lookup(fps, named, own, "n_rows").select("doc_id", hexed.alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                     similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their class, with all their columns."""
    found = near_duplicates(docs, id_col, text_col, words, similarity=similarity)
    # The few ids that name no class are looked for, not the many that do: whole rows need not move.
    stays = F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")
    lost = cut(found.groupBy(F.col("doc_id").alias("__lost_id")).agg(stays).where("not stays").select("__lost_id"))
    if lost.count() <= SMALL:
        lost = F.broadcast(lost)
    return docs.join(lost, docs[id_col].eqNullSafe(lost["__lost_id"]), "left_anti")
