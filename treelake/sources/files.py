"""Files: discovery, checksums, CSV and N-Triples."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treelake.lineage import settle

#: Files whose offsets one task sums.
_BUCKET = 10_000
#: Bytes up to which a file is one cell, and that are read at a time of a larger one.
WHOLE, BLOCK = 256 << 20, 8 << 20
SUFFIXES = (".hdf", ".hdf5", ".h5", ".nc")
#: The line format. A line is subject, predicate, object and a dot.
_TERM = r"(<[^>]*>|_:\S+)"
_LINE = rf'^\s*{_TERM}\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'


def discover(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES, recursive: bool = True, any_case: bool = False) -> DataFrame:
    """(path, length, modified) of the files with a suffix, sorted by lower-cased path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    path = F.lower("path") if any_case else F.col("path")
    tests = [path.endswith(s.lower() if any_case else s) for s in suffixes]
    test = tests[0]
    for t in tests[1:]:
        test = test | t
    return files.where(test).select("path", "length", F.col("modificationTime").alias("modified")).distinct().orderBy(F.lower("path"))


def with_checksums(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with the length in bytes and the MD5 of a binary or text column in its place."""
    kept = [c for c in files.columns if c not in (content, "length", "md5")]
    return files.select(*kept, F.octet_length(content).cast("long").alias("length"), F.md5(F.col(content).cast("binary")).alias("md5"))


def checksums(spark: SparkSession, folder: str, glob: str = "*", whole: int = WHOLE) -> DataFrame:
    """(path, length, md5). Files of more than ``whole`` bytes, which a cell cannot or should not hold, are read by a task in blocks
    that the digest is carried over, through Arrow's file systems."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    small = with_checksums(files.where(F.col("length") <= whole).select("path", "content"))
    large = files.where(F.col("length") > whole).select("path", "length").repartition("path").mapInPandas(_streamed, "path string, length long, md5 string")
    return small.unionByName(large)


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = []
        for path in b["path"]:
            scheme, _, rest = path.partition(":")
            local = scheme == "file"
            system, place = (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if local else fs.FileSystem.from_uri(path)
            digest = hashlib.md5(usedforsecurity=False)
            with system.open_input_stream(place) as stream:
                while block := stream.read(BLOCK):
                    digest.update(block)
            found.append(digest.hexdigest())
        yield b.assign(md5=found)


def verify_checksums(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """``manifest`` (filename, checksum like ``md5:...``) against ``found`` (filename, md5): a status for each entry."""
    algorithm = F.when(F.col("checksum").contains(":"), F.lower(F.substring_index("checksum", ":", 1))).otherwise("md5")
    expected = F.substring_index("checksum", ":", -1)
    status = (F.when(F.col("md5").isNull(), "missing").when(F.col("checksum").isNull(), "no checksum")
              .when(algorithm != "md5", "unsupported algorithm").when(F.lower(expected) == F.col("md5"), "exists").otherwise("mismatch"))
    return manifest.join(found, "filename", "left").select("filename", status.alias("status"))


# --- CSV ----------------------------------------------------------------------------------------------

def read_csvs(spark: SparkSession, paths: list[str], schema: str, quoted_breaks: bool = False) -> DataFrame:
    """Rows of equal CSV files, or of folders that hold one each in parts, with ``file`` (ordinal in ``paths``), ``at`` (position inside the
    file, through its parts in the order of their names) and the name of the part.

    The reader splits files, so rows are numbered by splits: a task meets a split's rows one after another, and a split's first
    row comes after all rows of the splits before it. ``quoted_breaks`` allows line breaks inside quotes; files are then not split."""
    rows = spark.read.option("header", "true").option("multiLine", str(quoted_breaks).lower()).schema(schema).csv(paths)
    # Written once: another reading might number the rows otherwise.
    rows = settle(rows.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__split"),
                              F.monotonically_increasing_id().alias("__id")))
    bare = [("/" + re.sub("^[a-z0-9]+:/+", "/", p).strip("/"), k) for k, p in enumerate(paths)]
    order = spark.createDataFrame(bare, "__own string, file int")
    splits = rows.groupBy("__path", "__split").agg(F.min("__id").alias("__first"), F.count("*").alias("n"))
    place = F.regexp_replace(F.url_decode(F.regexp_replace("__path", r"\+", "%2B")), "^[a-z0-9]+:/+", "/")
    # A file is found by its own path or that of its folder.
    splits = splits.withColumn("__own", F.explode(F.array(place, F.regexp_replace(place, "/[^/]*$", "")))).join(order, "__own")
    before = Window.partitionBy("file").orderBy("__path", "__split").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    splits = splits.select("file", "__path", "__split", "__first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    at = F.col("__id") - F.col("__first") + F.col("__before")
    return rows.join(splits, ["__path", "__split"]).withColumn("at", at).withColumn("source", F.substring_index("__path", "/", -1)).drop(
        "__path", "__split", "__id", "__first", "__before")


def concatenate(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(name, i, v, source): the files' rows one after another. Row counts per file (one row each) give the offsets, so no
    window spans all rows."""
    bucket = F.floor(F.col("file") / _BUCKET)
    sizes = rows.groupBy("file").agg(F.count("*").alias("n")).withColumn("bucket", bucket)
    # Sums inside a bucket of files, and over the few buckets before it.
    inside = Window.partitionBy("bucket").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy("bucket").agg(F.sum("n").alias("n")).agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("totals"))
    earlier = F.aggregate(F.filter("totals", lambda t: t["bucket"] < F.col("bucket")), F.lit(0).cast("long"), lambda a, t: a + t["n"])
    offsets = sizes.crossJoin(F.broadcast(totals)).select("file", (F.coalesce(F.sum("n").over(inside), F.lit(0)) + earlier).alias("offset"))
    placed = rows.join(offsets, "file").withColumn("i", F.col("offset") + F.col("at"))
    return placed.unpivot(["i", "source"], columns, "name", "v").select("name", "i", "v", "source")


def stacked(rows: DataFrame, columns: list[str], axis: int = 0, shape: list[int] | None = None) -> DataFrame:
    """(name, indexes, v): the files side by side along a new axis, first (0) or last (-1)."""
    cells = rows.unpivot(["file", "at"], columns, "name", "v")
    inner: list[Column] = []
    rest = 1
    for n in reversed(shape or []):
        inner.insert(0, F.floor(F.col("at") / rest) % n)
        rest *= n
    inner = inner or [F.col("at")]
    index = [F.col("file"), *inner] if axis == 0 else [*inner, F.col("file")]
    return cells.select("name", *[c.alias(f"i{k}") for k, c in enumerate(index)], "v")


# --- N-Triples ----------------------------------------------------------------------------------------

#: Escapes of one letter.
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


#: Stands for a backslash while other escapes are resolved; texts that hold it are taken apart instead.
_HELD = "\ue000"


def _unescaped(text: Column) -> Column:
    """``text`` with its escapes, by letter or by the number of a character, resolved."""
    one = lambda t: F.when(t.rlike(r"^\\[uU]"), F.decode(F.unhex(F.lpad(F.substring(t, 3, 8), 8, "0")), "UTF-32")).when(
        t.startswith("\\"), F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _ESCAPES.items() for x in kv]), F.substring(t, 2, 1)), t)).otherwise(t)
    parts = F.regexp_extract_all(text, F.lit(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]++"), F.lit(0))
    put = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    letters = put(text, "\\\\", _HELD)
    for k, v in _ESCAPES.items():
        if k != "\\":
            letters = put(letters, "\\" + k, v)
    numbered = text.contains("\\u") | text.contains("\\U") | text.contains(_HELD)
    return F.when(~text.contains("\\"), text).when(~numbered, put(letters, _HELD, "\\")).otherwise(F.array_join(F.transform(parts, one), ""))


def rejected(lines: DataFrame) -> DataFrame:
    """One row (n): how many lines are neither triples, comments nor empty."""
    return lines.where(~F.col("value").rlike(_LINE) & ~F.col("value").rlike(r"^\s*(?:#.*)?$")).agg(F.count("*").alias("n"))


def parse_ntriples(lines: DataFrame, graph: Column | None = None, bnode_base: str = "https://example.org/") -> DataFrame:
    """Lines (value) to triples. Blank nodes become IRIs under ``bnode_base``; lines that are no triple are left out
    (:func:`rejected` counts them).

    Lines with IRIs and single spaces, without escapes and comments, are cut at ``>`` and at quotes; only others meet the line's pattern.
    Each step is a projection of its own, so that nothing is computed twice."""
    after = lambda c, n: F.substring(c, n if isinstance(n, Column) else F.lit(n), F.lit(2147483647))
    piece = lambda c, k: F.get(c, F.lit(k))
    value, s, p, o, tail = (F.col(c) for c in ("value", "s", "p", "o", "tail"))
    cut = lines.select("value", (graph if graph is not None else F.lit("default")).alias("graph"), F.split("value", ">", 3).alias("at"))
    cut = cut.select("value", "graph", piece("at", 0).alias("s"), piece("at", 1).alias("p"), piece("at", 2).alias("o"))
    cut = cut.select("*", F.when(o.startswith(" <"), F.split("o", ">", 2)).alias("iri"), F.when(o.startswith(' "'), F.split("o", '"', 3)).alias("quoted"))
    cut = cut.select("value", "graph", "s", "p", "iri", piece("quoted", 1).alias("text"), piece("quoted", 2).alias("tail"))
    typed = tail.startswith("^^<") & (F.substring_index("tail", ">", 1) == F.substring("tail", F.lit(1), F.char_length("tail") - 3)) & tail.endswith("> .")
    literal = (tail == " .") | typed | tail.rlike(r"^@[A-Za-z0-9-]+ \.\z")
    plain = s.startswith("<") & p.startswith(" <") & ~value.contains("\\") & F.when(tail.isNull(), piece("iri", 1) == " .").otherwise(literal)
    cut = cut.select("*", F.coalesce(plain, F.lit(False)).alias("plain"))
    cut = cut.select("*", F.when(~F.col("plain"), F.array(*[F.regexp_extract("value", _LINE, k) for k in (1, 2, 3)])).alias("terms"))
    term = lambda k: piece("terms", k)
    cut = cut.withColumn("escaped", F.when(term(2).startswith('"'), F.regexp_extract(term(2), r'^"([^"\\]*+(?:\\.[^"\\]*+)*+)"', 1)))
    fast = F.struct(after(s, 2).alias("s"), F.lit(False).alias("s_blank"), after(p, 3).alias("p"),
                    F.coalesce("text", after(piece("iri", 0), 3)).alias("o"), F.lit(False).alias("o_blank"), tail.alias("tail"))
    bare, blank = (lambda c: F.regexp_replace(c, "^<|>$", "")), (lambda c: c.startswith("_:"))
    slow = F.struct(bare(term(0)).alias("s"), blank(term(0)).alias("s_blank"), term(1).alias("p"), F.coalesce("escaped", bare(term(2))).alias("o"),
                    blank(term(2)).alias("o_blank"), after(term(2), F.char_length("escaped") + 3).alias("tail"))
    # An explode, as a filter would be moved below the lines and compute them twice.
    rows = cut.select("graph", F.explode(F.when(F.col("plain"), F.array(fast)).when(term(0) != "", F.array(slow))).alias("x")).select("graph", "x.*")
    node = lambda c: F.when(F.col(f"{c}_blank"), F.concat(F.lit(bnode_base), after(F.col(c), 3))).otherwise(_unescaped(F.col(c)))
    # What follows a literal's text; null of other terms.
    return rows.select("graph", node("s").alias("s"), F.lit("iri").alias("s_kind"), _unescaped(p).alias("p"), node("o").alias("o"),
                       F.when(tail.isNotNull(), "lit").otherwise("iri").alias("o_kind"),
                       F.when(tail.startswith("^^<"), F.nullif(after(F.substring_index("tail", ">", 1), 4), F.lit(""))).alias("o_dt"),
                       F.when(tail.startswith("@"), after(F.substring_index("tail", " ", 1), 2)).alias("o_lang"))


def load_ntriples(spark: SparkSession, folder: str) -> DataFrame:
    """All ``.nt`` files of a folder as one graph, a set."""
    lines = spark.read.option("pathGlobFilter", "*.nt").option("recursiveFileLookup", "true").text(folder)
    return parse_ntriples(lines).dropDuplicates(["s", "p", "o", "o_kind", "o_dt", "o_lang"])


def format_ntriples(triples: DataFrame) -> DataFrame:
    """Triples to lines (value)."""
    text = F.col("o")
    for a, b in (("\\", r"\\"), ('"', r"\""), ("\n", r"\n"), ("\r", r"\r"), ("\t", r"\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    tag = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_dt").isNotNull(), F.concat(F.lit("^^<"), "o_dt", F.lit(">"))).otherwise("")
    node = lambda c, k: F.when(F.col(k) == "bnode", F.concat(F.lit("_:"), F.col(c))).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    o = F.when(F.col("o_kind") == "lit", F.concat(F.lit('"'), text, F.lit('"'), tag)).otherwise(node("o", "o_kind"))
    return triples.select(F.concat(node("s", "s_kind"), F.lit(" <"), "p", F.lit("> "), o, F.lit(" .")).alias("value"))


def save_ntriples(triples: DataFrame, folder: str) -> None:
    format_ntriples(triples).write.text(folder)
