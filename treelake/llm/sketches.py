"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

A document is the set of its paragraphs' 64-bit digests; a paragraph is a line, cut into runs of at
most ``UNIT`` words so that a change in a long line stays local. A sketch has three tables of
cells; each digest goes to one cell of each, which counts it and keeps the XOR of the digests
and of their checks. Two sketches subtract cell by cell, common digests cancel, and peeling
recovers the others: a cell of one digest gives it away, it is taken out of its other cells, and
so on. A table is peeled at once in each round, so no digest is found twice in a round.

The fingerprint is the sketch of ``BASE`` cells a table. The counts of two fingerprints' difference
estimate how many digests differ, as their squares grow with that number alone; the estimate
sizes the sketch that is peeled, which is the fingerprints' own difference where that is large enough. A pair
whose cells don't empty is tried again with four times the cells.

All steps after the first exchange are keyed by document: building, subtracting and peeling are
groupings inside the partitions in which the texts already are, small enough to be held in memory.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelake.llm.common import cut, settled, shuffle_partitions, text_of

#: Words in a paragraph's run; cells in each table of a fingerprint (a power of two); rounds of peeling; retries.
UNIT, BASE, ROUNDS, RETRIES = 12, 8, 12, 8
#: Cells in all tables for each digest that is thought to differ.
ROOM = 2.4
#: Characters of text that one task holds, as long as there are no more than so many tasks.
TASK_CHARS, MOST_TASKS = 4_000_000, 100_000
_NULL_KEY = -(1 << 63)
_PARAGRAPH = r"\S++(?:[^\S\n]++\S++){0,%d}+" % (UNIT - 1)
#: A slot names a cell of a pair's sketch: the pair, the logarithm of the table's size, and the cell or ``_FOUND``.
_CELL = 1 << 48
_FOUND = _CELL - 1


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_PARAGRAPH), F.lit(0)), lambda u: F.xxhash64(u)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(99)).bitwiseAND(0xFFFFFFFF)


def _cell(digest: Column, table: int, size: Column) -> Column:
    return F.xxhash64(digest, F.lit(table)).bitwiseAND(size - 1) + size * table


def _placed(digests: DataFrame, size: Column, *by: str) -> DataFrame:
    """``digests`` (by, d) to one row for each table's cell of a digest: (by, cell, d, c)."""
    rows = digests.select(*by, "d", _check(F.col("d")).alias("c"), F.array(*[_cell(F.col("d"), t, size) for t in range(3)]).alias("cells"))
    return rows.select(*by, "d", "c", F.explode("cells").alias("cell"))


def _base_cells(sets: DataFrame, *names: str) -> DataFrame:
    """The fingerprints' cells, (key, side, cell, d, c) for each digest in one, the side being the index of its array."""
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(n).alias("of")) for i, n in enumerate(names)])
    rows = sets.select("key", F.explode(sides).alias("s")).select("key", "s.side", F.explode("s.of").alias("d"))
    return _placed(rows, F.lit(BASE).cast("long"), "key", "side")


def _squares(sets: DataFrame) -> DataFrame:
    """(key, squares0, squares1): sums of the squared counts of the difference between the fingerprints of the text and
    of the edited one, and of the next document."""
    n = lambda side: F.count_if(F.col("side") == side)
    counts = _base_cells(sets, "own", "edited", "next").groupBy("key", "cell").agg((n(0) - n(1)).alias("a"), (n(0) - n(2)).alias("b"))
    return counts.groupBy("key").agg(F.sum(F.col("a") * F.col("a")).alias("squares0"), F.sum(F.col("b") * F.col("b")).alias("squares1"))


def _size(squares: str, a: str, b: str) -> Column:
    """The logarithm of the size of the tables that are to be peeled, from the fingerprints of ``a`` and ``b``."""
    apart = F.abs(F.size(a) - F.size(b)).cast("double")
    # The squares of a table add up to the digests that differ, but for those that share a cell.
    about = F.greatest((F.coalesce(F.col(squares), F.lit(0)) / 3.0 - apart * apart / F.lit(float(BASE))) / (1 - 1 / BASE), apart)
    cells = F.least(about, (F.size(a) + F.size(b)).cast("double")) * ROOM / 3
    return F.ceil(F.log2(F.greatest(cells, F.lit(float(BASE))))).cast("int")


def _prints(sets: DataFrame) -> DataFrame:
    """(key, fingerprint, edited_fingerprint)."""
    cells = _base_cells(sets, "own", "edited").groupBy("key", "side", "cell").agg(
        F.count("*").alias("n"), F.bit_xor("d").alias("x"), F.bit_xor("c").alias("c"))
    of = lambda side: _printed(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("cell", "n", "x", "c")))))
    return cells.groupBy("key").agg(of(0).alias("fingerprint"), of(1).alias("edited_fingerprint"))


def _summed(cells: DataFrame) -> DataFrame:
    """Entries of a cell added up; cells that hold nothing go."""
    out = cells.groupBy("key", "slot").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("c").alias("c"))
    return out.where("n <> 0 or x <> 0 or c <> 0")


def _differences(sets: DataFrame, boost: int) -> DataFrame:
    """``sets`` (key, own, edited, next, log0, log1) to (key, delta0, left0, delta1, left1) of each document and its
    edited version (0) or the next document (1): digests found in one of the two alone, and cells that did not empty.
    Tables have 2 to the power of ``log`` and ``boost`` cells. A pair without a difference has nulls or zeros."""
    side = lambda k, name, sign: F.struct(
        F.lit(sign).cast("long").alias("n"), ((F.lit(64 * k) + F.col(f"log{k}") + boost).cast("long") * F.lit(_CELL)).alias("base"),
        F.pow(F.lit(2.0), F.col(f"log{k}") + boost).cast("long").alias("size"), F.col(name).alias("of"))
    sides = F.array(side(0, "own", 1), side(0, "edited", -1), side(1, "own", 1), side(1, "next", -1))
    rows = sets.select("key", F.explode(sides).alias("s")).select("key", "s.n", "s.base", "s.size", F.explode("s.of").alias("d"))
    rows = _placed(rows, F.col("size"), "key", "n", "base", "size")
    cells = _summed(rows.select("key", (F.col("base") + F.col("cell")).alias("slot"), "n", F.col("d").alias("x"), "c"))
    cell = F.pmod(F.col("slot"), F.lit(_CELL))
    base = F.col("slot") - cell
    size = F.pow(F.lit(2.0), F.pmod(F.floor(F.col("slot") / F.lit(_CELL)), F.lit(64))).cast("long")
    for k in range(ROUNDS):
        table = k % 3
        pure = ((F.col("cell") >= F.col("size") * table) & (F.col("cell") < F.col("size") * (table + 1)) & (F.abs("n") == 1)
                & (F.col("c") == _check(F.col("x"))))
        none = F.lit(0).cast("long")
        taken = F.struct((F.col("base") + _FOUND).alias("slot"), F.lit(1).cast("long").alias("n"), none.alias("x"), none.alias("c"))
        others = [F.struct((F.col("base") + _cell(F.col("x"), t, F.col("size"))).alias("slot"), (-F.col("n")).alias("n"), F.col("x").alias("x"),
                           F.col("c").alias("c")) for t in range(3) if t != table]
        peeled = F.when(pure, F.array(taken, *others)).otherwise(F.array(F.struct("slot", "n", "x", "c")))
        known = cells.select("key", "slot", "n", "x", "c", cell.alias("cell"), base.alias("base"), size.alias("size"))
        cells = _summed(known.select("key", F.explode(peeled).alias("e")).select("key", "e.*"))
    found = cell == _FOUND
    which = F.floor(F.col("slot") / F.lit(64 * _CELL))
    of = lambda k: [F.sum(F.when(which == k, F.when(found, F.col("n")).otherwise(0))).alias(f"delta{k}"),
                    F.count_if((which == k) & ~found).alias(f"left{k}")]
    return cells.groupBy("key").agg(*of(0), *of(1))


def _printed(cells: Column) -> Column:
    """A sketch as text: each cell that holds something, in order, as hexadecimal digits."""
    hexed = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    return F.concat_ws("", F.transform(cells, lambda e: F.concat(hexed(e["cell"], 2), hexed(e["n"], 6), hexed(e["x"], 16), hexed(e["c"], 8))))


def neighbours(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` (key, tie, n_chars) to (key, user, third): the document that takes this one as its next in
    descending order, and how many characters of it; the greatest key serves the least. And the characters of all."""
    spark = docs.sparkSession
    one = docs.groupBy("key").agg(F.min(F.struct("tie", "n_chars")).alias("s")).select("key", "s.n_chars")
    ranges = cut(one.repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    parts = ranges.groupBy("part").agg(F.min(F.struct("key", "n_chars")).alias("h"), F.sum("n_chars").alias("n")).orderBy("part").collect()
    heads = [(r["part"], r["h"]["key"], r["h"]["n_chars"]) for r in parts]
    after = [(p, *heads[(k + 1) % len(heads)][1:]) for k, (p, _, _) in enumerate(heads)]
    following = spark.createDataFrame(after, "part int, after_key long, after_chars int")
    w = Window.partitionBy("part").orderBy("key")
    led = ranges.select("key", "part", F.lead("key").over(w).alias("user"), F.lead("n_chars").over(w).alias("chars"))
    led = led.join(F.broadcast(following), "part").select(
        "key", F.coalesce("user", "after_key").alias("user"), F.floor(F.coalesce("chars", "after_chars") / 3).cast("int").alias("third"))
    return led, sum(r["n"] for r in parts)


def compare_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third replaced by as many first characters of the next document in
    descending order of id (the last one's next is the first). Likeness is the share of paragraphs
    in both among those in either, worked out from the sketches; two texts without a paragraph are
    alike (1). Null text counts as empty. Ids must be whole numbers or null; a null id ranks after all others. An id that
    repeats counts once, with the text whose hash is least; other columns are ignored; an empty table gives an
    empty result.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_KEY)).alias("key"), text_of(text_col).alias("text"))
    served, chars = neighbours(rows.select("key", F.xxhash64("text").alias("tie"), F.char_length("text").alias("n_chars")))
    tasks = max(shuffle_partitions(docs.sparkSession), min(ceil(chars / TASK_CHARS), MOST_TASKS))
    w = Window.partitionBy("key").orderBy(F.xxhash64("text"))
    single = rows.repartition(tasks, "key").withColumn("at", F.row_number().over(w)).where("at = 1").drop("at")
    heads = single.join(served, "key").select(F.col("user").alias("key"), F.substring(F.col("text"), F.lit(1), F.col("third")).alias("head"),
                                              digests(F.col("text")).alias("next"))
    n = F.char_length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 3).cast("int")), F.col("head"))
    both = single.join(heads.repartition(tasks, "key"), "key").select("key", "text", edited.alias("edited"), "next")
    # The texts end here; what is kept of them stays partitioned by document.
    sets = settled(both.select("key", n.cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("sha"),
                       digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("edited"), "next"))

    sized = sets.select("key", "own", "edited", "next").join(_squares(sets), "key", "left")
    sized = sized.withColumns({"log0": _size("squares0", "own", "edited"), "log1": _size("squares1", "own", "next")})
    found = settled(_differences(sized, 0))
    failed = cut(sized.join(_unsolved(found), "key", "left_semi"))
    solved: list[DataFrame] = []
    for k in range(1, RETRIES + 1):
        if failed.isEmpty():
            break
        better = cut(_differences(failed, 2 * k))
        solved.append(better.where("left0 = 0 and left1 = 0"))
        failed = failed.join(_unsolved(better), "key", "left_semi")
    else:
        raise RuntimeError("a sketch did not decode at any size")

    out = sets.join(_prints(sets), "key", "left").join(found.select("key", "delta0", "delta1"), "key", "left")
    if solved:
        again = reduce(DataFrame.unionByName, solved).select("key", F.col("delta0").alias("again0"), F.col("delta1").alias("again1"))
        out = out.join(again, "key", "left").withColumns({f"delta{k}": F.coalesce(f"again{k}", f"delta{k}") for k in (0, 1)})

    def likeness(k: int, other: str) -> Column:
        total, delta = F.size("own") + F.size(other), F.coalesce(F.col(f"delta{k}"), F.lit(0))
        return F.when(total == 0, 1.0).otherwise((total - delta) / (total + delta))

    return out.select(F.nullif(F.col("key"), F.lit(_NULL_KEY)).alias("doc_id"), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"),
                      F.coalesce("fingerprint", F.lit("")).alias("fingerprint"), F.coalesce("edited_fingerprint", F.lit("")).alias("edited_fingerprint"),
                      likeness(0, "edited").alias("near_edited"), likeness(1, "next").alias("near_next"))


def _unsolved(found: DataFrame) -> DataFrame:
    return found.where("left0 > 0 or left1 > 0").select("key")
