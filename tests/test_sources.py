import hashlib
import json
import random
import shutil
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_filters import attributes, objects

from treelake.model import LABEL, SCHEMAS, TYPE, Catalogue
from treelake.operators import arrays
from treelake.operators import triples as T
from treelake.sources import documents, files
from treelake.sources import store as store_module
from treelake.sources.store import TripleStore
from treelake.streaming import ingest


def test_discovery(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("f1.hdf", "f2.hdf", "f3.h5", "sub/f4.hdf", "sub/f5.hdf", "sub/f6.H5"):
        (tmp_path / n).write_bytes(n.encode())
    count = lambda **k: files.discover(spark, str(tmp_path), **k).count()
    assert count(suffixes=(".hdf",), recursive=False) == 2 and count(suffixes=(".h5",), recursive=False) == 1
    assert count(suffixes=(".hdf", ".h5"), recursive=False) == 3 and count() == 5 and count(any_case=True) == 6
    sums = {r.path.rsplit("/", 1)[-1]: r.md5 for r in files.checksums(spark, str(tmp_path), "*.hdf").collect()}
    assert sums["f1.hdf"] == hashlib.md5(b"f1.hdf").hexdigest() and len(sums) == 4


def test_checksums(spark):
    manifest = spark.createDataFrame([("a", "md5:AB"), ("b", "md5:0"), ("c", None), ("d", "sha1:x"), ("e", "md5:1")], "filename string, checksum string")
    found = spark.createDataFrame([(x, "ab") for x in "abcd"], "filename string, md5 string")
    assert {r.filename: r.status for r in files.verify_checksums(manifest, found).collect()} == {
        "a": "exists", "b": "mismatch", "c": "no checksum", "d": "unsupported algorithm", "e": "missing"}


def test_csv(spark, tmp_path):
    x, y = [1.0, 5.0, 10.0, 0.0], [-3.0, 20.0, 0.0, 11.5]
    names = []
    for k, sign in (("one", 1), ("two", -1)):
        p = tmp_path / f"{k}.csv"
        p.write_text("x,y\n" + "".join(f"{sign * a},{sign * b}\n" for a, b in zip(x, y)))
        names.append(str(p))
    rows = files.read_csvs(spark, names, "x double, y double")
    joined = files.concatenate(rows, ["x", "y"])
    assert [r.v for r in joined.where("name = 'x'").orderBy("i").collect()] == x + [-a for a in x]
    assert {r.source for r in joined.collect()} == {"one.csv", "two.csv"}
    cells = {(r.i0, r.i1): r.v for r in files.stacked(rows, ["y"]).collect()}
    assert len(cells) == 8 and cells[(1, 3)] == -11.5
    assert {(r.i0, r.i1): r.v for r in files.stacked(rows, ["y"], -1).collect()}[(3, 1)] == -11.5
    cube = {(r.i0, r.i1, r.i2): r.v for r in files.stacked(rows, ["y"], 0, [2, 2]).collect()}
    assert cube[(0, 1, 1)] == 11.5 and len(cube) == 8


def test_csv_is_numbered_by_splits(spark, tmp_path):
    """Large files are read by many tasks, and a folder's parts count on from one another."""
    big, folder = tmp_path / "big.csv", tmp_path / "many parts"
    big.write_text("x\n" + "".join(f"{i}\n" for i in range(3000)))
    folder.mkdir()
    for k in range(3):
        (folder / f"part-{k}.csv").write_text("x\n" + "".join(f"{10_000 + k * 700 + i}\n" for i in range(700)))
    (tmp_path / "none.csv").write_text("x\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        rows = files.read_csvs(spark, [str(folder), str(tmp_path / "none.csv"), str(big)], "x long").cache()
        got = [(r.file, r.at, r.x) for r in rows.orderBy("file", "at").collect()]
        splits = spark.read.option("header", "true").csv(str(big)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert splits > 5
    assert got == [(0, i, 10_000 + i) for i in range(2100)] + [(2, i, i) for i in range(3000)]
    assert [r.i for r in files.concatenate(rows, ["x"]).orderBy("i").collect()] == list(range(5100))
    quoted = tmp_path / "quoted.csv"
    quoted.write_text('x\n"a\nb"\nc\n')
    assert [(r.at, r.x) for r in files.read_csvs(spark, [str(quoted)], "x string", quoted_breaks=True).orderBy("at").collect()] == [(0, "a\nb"), (1, "c")]


LINES = ['<http://a> <http://p> <http://b> .', '_:n1 <http://p> "x \\"y\\" \\n \\\\"@en .', '<http://a> <http://p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> . # note', "# comment", "",
         '<http://a> <http://p> <http://b> .']


def test_ntriples(spark, tmp_path):
    t = files.parse_ntriples(spark.createDataFrame([(x,) for x in LINES], "value string"))
    rows = {(r.s, r.o, r.o_kind, r.o_dt, r.o_lang) for r in t.collect()}
    assert t.count() == 4 and ("https://example.org/n1", 'x "y" \n \\', "lit", None, "en") in rows
    assert ("http://a", "5", "lit", "http://www.w3.org/2001/XMLSchema#integer", None) in rows
    files.save_ntriples(t, str(tmp_path / "out"))
    back = files.parse_ntriples(spark.read.text(str(tmp_path / "out")))
    assert {(r.s, r.o, r.o_kind, r.o_dt, r.o_lang) for r in back.collect()} == rows
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.nt").write_text("\n".join(LINES))
    (tmp_path / "in/b.nt").write_text("\n".join(LINES))
    assert files.load_ntriples(spark, str(tmp_path / "in")).count() == 3


def test_streaming_ingest_is_a_set(spark, tmp_path):
    source, store = tmp_path / "in", TripleStore(spark, str(tmp_path / "store"), buckets=8)
    source.mkdir()
    for k, lines in enumerate((LINES, LINES + ['<http://a> <http://p> "new" .'])):
        (source / f"{k}.nt").write_text("\n".join(lines))
        ingest.ingest(store, str(source), str(tmp_path / "check")).awaitTermination()
        assert store.triples().count() == 3 + k
    assert {(r.measure, r.label): r.n for r in store.measures().collect()}["triples", ""] == 4


def test_store_meets_only_the_buckets_of_a_batch(spark, tmp_path):
    rng = random.Random(2)
    schema = "graph string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"
    store = TripleStore(spark, str(tmp_path / "store"), buckets=16)
    held, sets = set(), []
    for number in range(4):
        rows = [(f"s{rng.randrange(12)}", rng.choice([LABEL, TYPE, "p"]), f"o{rng.randrange(6)}", rng.choice(["lit", "iri"]), rng.choice([None, "t"])) for _ in range(60)]
        batch = spark.createDataFrame([("g", s, "iri", p, o, k, d if k == "lit" else None, None) for s, p, o, k, d in rows], schema)
        for _ in range(2):  # the second time changes nothing
            store.append(batch, number)
        held |= {(s, p, o, k, d if k == "lit" else None) for s, p, o, k, d in rows}
        sets.append(len(held))
        assert store.triples().count() == len(held)
    got = {(r.measure, r.label): r.n for r in store.measures().collect()}
    assert got["triples", ""] == len(held) and got["subjects", ""] == len({t[0] for t in held})
    assert got["subjects_with_labels", ""] == len({t[0] for t in held if t[1] == LABEL}) and got["predicate", "p"] == sum(t[1] == "p" for t in held)
    assert got["class", "o1"] == sum(t[1] == TYPE and t[2] == "o1" for t in held) and got["untyped_literals", ""] == sum(t[3] == "lit" and t[4] is None for t in held)
    one = spark.createDataFrame([("g", "s1", "iri", "new", "x", "iri", None, None)], schema)
    store.append(one, 9)
    assert [r.n for r in store.measures().where("label = 'new'").collect()] == [1]
    touched = store.triples([0])
    assert {r.bucket for r in touched.collect()} <= {0} and "PartitionFilters: [isnotnull(bucket" in touched._jdf.queryExecution().toString()
    stars = store.stars(spark.createDataFrame([("s1",), ("s2",), ("s1",)], "s string"))
    assert {(r.s, r.p, r.o, r.o_kind, r.o_dt) for r in stars.collect()} == {t for t in held if t[0] in ("s1", "s2")} | {("s1", "new", "x", "iri", None)}
    # A batch that failed after its data were written is written again.
    shutil.rmtree(tmp_path / "store/measures/batch=9")
    store.append(one, 9)
    assert store.triples().where("p = 'new'").count() == 1 and [r.n for r in store.measures().where("label = 'new'").collect()] == [1]


def test_repeats_inside_a_watermark(spark, tmp_path):
    rows = [("g", "a", "iri", "p", "x", "lit", None, None, "2024-01-01 00:00:00"), ("g", "a", "iri", "p", "x", "lit", None, None, "2024-01-01 00:30:00"),
            ("g", "a", "iri", "p", "x", "lit", "t", None, "2024-01-01 00:31:00")]
    schema = "graph string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string, at string"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = ingest.distinct_with_watermark(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.o_dt or "" for r in spark.table("seen").collect()) == ["", "t"]


def test_checksums_of_large_files(spark, tmp_path):
    """A sparse file of 3 GB, which no cell could hold, and small ones beside it."""
    (tmp_path / "small one.h5").write_bytes(b"abc")
    with (tmp_path / "big one.h5").open("wb") as f:
        f.truncate(3 << 30)
        f.seek(1 << 31)
        f.write(b"middle")
    digest = hashlib.md5(usedforsecurity=False)
    with (tmp_path / "big one.h5").open("rb") as f:
        while block := f.read(1 << 24):
            digest.update(block)
    got = {r.path.rsplit("/", 1)[-1]: (r.length, r.md5) for r in files.checksums(spark, str(tmp_path)).collect()}
    assert got == {"small one.h5": (3, hashlib.md5(b"abc", usedforsecurity=False).hexdigest()), "big one.h5": (3 << 30, digest.hexdigest())}


def test_tree_pieces_are_the_tree(spark):
    rng = random.Random(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = {("f", "/"), ("g", "/")}
    for _ in range(120):
        parts = [rng.choice(["a", "a-b", "b", "z z", "é"]) for _ in range(rng.randrange(1, 5))]
        rows |= {("f", "/" + "/".join(parts[:k])) for k in range(1, len(parts) + 1)}
    full = [(f, n, None if n == "/" else n.rpartition("/")[0] or "/", "group", None, None, None) for f, n in sorted(rows)]
    attrs = [("f", n, "note", f'say "{n}"') for f, n in sorted(rows) if f == "f"][::3]
    cat = Catalogue(objects(spark, full), attributes(spark, attrs))
    spark.conf.set("spark.sql.shuffle.partitions", "19")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pieces = documents.tree_texts(cat).orderBy("file_id", "at").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    whole = {r.file_id: r.tree for r in documents.trees(cat).collect()}
    for f in ("f", "g"):
        own = [r for r in pieces if r.file_id == f]
        assert [r.at for r in own] == list(range(len(own))) and json.loads("".join(r.text for r in own)) == json.loads(whole[f])
    assert len(pieces) == len(rows) + 2


@pytest.fixture(scope="module")
def cat(spark):
    rows = [("f", "/", None, "group", None, None, None), ("f", "/u", "/", "dataset", "int64", 1, [3]), ("f", "/grp", "/", "group", None, None, None)]
    attrs = [("f", "/u", "units", "m/s"), ("f", "/u", "standard_name", "x_velocity"), ("f", "/grp", "long_name", "a group"), ("f", "/u", "CLASS", "DIMENSION_SCALE"), ("f", "/u", "n", 3)]
    return Catalogue(objects(spark, rows), attributes(spark, attrs))


def test_documents(spark, cat):
    docs = {r.name: r for r in documents.object_documents(cat, ignore=["n"], project="p").collect()}
    assert docs["/u"].attrs == {"units": "m/s", "standard_name": "x_velocity"} and docs["/u"].project == "p" and len(docs) == 3
    data = spark.createDataFrame([("f", "/u", 3), ("f", "/none", 0)], "file_id string, name string, n0 int")
    scales = spark.createDataFrame([("f", "/u", "time", i, str(i / 2)) for i in range(3)], "file_id string, dataset string, scale_name string, i int, value string")
    slices = documents.slice_documents(data, scales)
    assert sorted(r.scales["time"] for r in slices.collect()) == ["0.0", "0.5", "1.0"]
    cells = spark.createDataFrame([("f", "/u", i, 1.0) for i in range(5)], "file_id string, name string, i0 int, v double")
    assert documents.apply_slices(slices, cells).count() == 3
    d = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    assert documents.upsert(d.where("k = 2"), d).count() == 2 and documents.upsert(d, d, update=False).count() == 6
    with pytest.raises(Exception, match="no filename"):
        documents.find_documents(spark.createDataFrame([(None, 1)], "filename string, k int"), F.col("k") == 1, spark.createDataFrame([("x",)], "path string")).collect()
    tree = json.loads(documents.trees(cat, depth=1).first().tree)
    assert [(c["name"], c["kind"], c["children"]) for c in tree["children"]] == [("grp", "group", []), ("u", "dataset", [])]
    assert tree["children"][1]["/"]["units"] == "m/s"


def test_registry(spark):
    empty = spark.createDataFrame([], "id string, path string, created timestamp, metadata string")
    paths = spark.createDataFrame([("a", "{}"), ("a", "{}"), ("b", "{}")], "path string, metadata string")
    once = documents.register_files(empty, paths)
    assert once.count() == 2 and documents.register_files(once, paths).count() == 2


def test_bindings(spark):
    xsd = "http://www.w3.org/2001/XMLSchema#"
    text = ('{"results":{"bindings":[{"a":{"type":"literal","value":"5","datatype":"%sinteger"},"b":{"type":"uri","value":"http://x"}},'
            '{"a":{"type":"literal","value":"bad","datatype":"%sinteger"},"c":{"type":"literal","value":"2024-01-01T00:00:00Z","datatype":"%sdateTime"}}]}}') % (xsd, xsd, xsd)
    got = {(r.row, r.variable): r for r in documents.cast_bindings(documents.parse_bindings(spark.createDataFrame([(text,)], "json string"))).collect()}
    assert got[(0, "a")].as_long == 5 and got[(1, "a")].as_long is None and got[(1, "a")].value == "bad"
    assert got[(0, "b")].value == "http://x" and got[(1, "c")].as_time is not None


def test_structural_and_mapping(spark, cat):
    rows = {(r.s, r.p.split("#")[-1], r.o) for r in T.structural(cat.objects, cat.attributes).collect()}
    me = "https://example.org/f/u"
    hdf = "http://purl.allotrope.org/ontologies/hdf5/1.8#"
    assert {(me, "rank", "1"), (me + "_dim_0", "size", "3"), (me, "datatype", "H5T_INTEGER"), (me, "datatype", hdf + "H5T_INTEL_I64LE"), (me + "@units", "data", "m/s"),
            ("https://example.org/f/", "member", me), ("https://example.org/f", "rootGroup", "https://example.org/f/")} <= rows
    assert not any("CLASS" in s for s, _, _ in rows)
    mapped = T.map_attributes(cat.attributes, {"units": "http://p/u", "standard_name": "http://p/s"}, {"units": lambda c: F.lit(None).cast("string")})
    assert [(r.p, r.o) for r in mapped.collect()] == [("http://p/s", "x_velocity")]
    with pytest.raises(ValueError):
        T.structural(cat.objects, base="http://x")
    with pytest.raises(ValueError):
        T.select_graph(None, None)


def test_contextual(spark, cat):
    notes = spark.createDataFrame([("f", "/u", "obj", "units", "http://s", ["http://c"], "http://p", None, None), ("f", "/grp", "obj", "long_name", None, None, None, None, None)], SCHEMAS["rdf_annot"])
    rows = {(r.s, r.p, r.o, r.o_kind) for r in T.contextual(cat.objects, cat.attributes, notes).collect()}
    assert ("http://s", "http://p", "m/s", "lit") in rows and ("https://example.org/f/u", T.SCHEMA_ABOUT, "http://s", "iri") in rows
    assert ("https://example.org/f/grp", T.RDF_VALUE, "a group", "lit") in rows and len(rows) == 4


def test_escapes_and_rejected_lines(spark):
    lines = spark.createDataFrame([(r'<http://a/\u00e9> <http://p> "t\tb\b n\n \\ \" \' \u00E9 \U0001F600 \\u0041" .',), ("# a comment",), ("",), ("no triple",), ("<a> <b>",)], "value string")
    got = files.parse_ntriples(lines).collect()
    assert [(r.s, r.o) for r in got] == [("http://a/é", "t\tb\b n\n \\ \" ' é 😀 \\u0041")]
    assert files.rejected(lines).first().n == 2


def test_plain_lines_need_no_pattern(spark, monkeypatch):
    """Lines in the form that is written are cut where they part; the pattern is for the others."""
    lines = ['<http://a> <http://p> <http://b> .', '<http://a> <http://p> "x > y" .', '<http://a> <http://p> "1"^^<http://t> .', '<http://a> <http://p> ""@en .']
    odd = ['_:n <http://p> <http://b> .', '<http://a>  <http://p> <http://b>.', r'<http://a> <http://p> "x\ny" .', '<a> <p> <b> . # <c> .', '<a> <p> "b" . # "c" .', '<a> <p> "b"@e_n .',
           '<a> <p> "b"^^<c> <d> .', '<a> <p> "b .', '<a>b> <p> <c> .', '<a> <p> <b> <c> .']
    of = lambda rows: files.parse_ntriples(spark.createDataFrame([(x,) for x in rows], "value string")).collect()
    every = {(r.s, r.o, r.o_kind, r.o_dt, r.o_lang) for r in of(lines + odd)}
    plain = {("http://a", "http://b", "iri", None, None), ("http://a", "x > y", "lit", None, None), ("http://a", "1", "lit", "http://t", None), ("http://a", "", "lit", None, "en")}
    assert every == plain | {("https://example.org/n", "http://b", "iri", None, None), ("http://a", "x\ny", "lit", None, None), ("a", "b", "iri", None, None), ("a", "b", "lit", None, None)}
    # A datatype starts after the text, whatever the text holds.
    held = [r'<a> <p> "\ue000 \\ \"^^<b"^^<c> .', '<a> <p> "^^<b"^^<c> .', '<a> <p> "\ue000\\\\n"@en .']
    assert [(r.o, r.o_dt, r.o_lang) for r in of(held)] == [('\ue000 \\ "^^<b', "c", None), ("^^<b", "c", None), ("\ue000\\n", None, "en")]
    monkeypatch.setattr(files, "_LINE", "(^no)(l)(ine$)")
    assert {(r.s, r.o, r.o_kind, r.o_dt, r.o_lang) for r in of(lines + odd)} == plain


def test_rows_of_trees_reach_every_depth(spark, cat):
    rows = {(r.file_id, r.name): json.loads(r.node) for r in documents.tree_rows(cat).collect()}
    assert len(rows) == cat.objects.count() and all(n["kind"] in ("group", "dataset") for n in rows.values())


def test_conflicting_coordinates(spark):
    grid = spark.createDataFrame([(1.0, 5.0, 6.0), (2.0, 7.0, 8.0)], "x double, u double, v double")
    own = lambda *values: spark.createDataFrame([("x", i, v) for i, v in enumerate(values)], "name string, index long, v double")
    assert {(r.x, r.name, r.v) for r in arrays.to_datasets(grid, ["x"], ["u", "v"], own(1.0, 2.0)).collect()} == {
        (1.0, "u", 5.0), (1.0, "v", 6.0), (2.0, "u", 7.0), (2.0, "v", 8.0)}
    with pytest.raises(Exception, match="a coordinate exists with other values: x"):
        arrays.to_datasets(grid, ["x"], ["u"], own(1.0, 3.0)).collect()
    twice = lambda df: df.withColumn("v", F.col("v") * 2)
    assert arrays.decode_all(arrays.to_datasets(grid, ["x"], ["u"]), [twice, twice]).agg(F.max("v")).first()[0] == 28.0


def test_first_batch_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    schema = "graph string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"
    rows = spark.createDataFrame([("g", f"s{i % 3}", "iri", "p", f"o{i % 4}", "iri", None, None) for i in range(24)], schema)
    store = TripleStore(spark, str(tmp_path / "store"), buckets=4)
    assert store.append(rows.mapInPandas(count, schema), 0).count() == 12 and seen.value == 24


def _shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p: p.stat().st_size for d in folders for p in Path(d).glob("*/shuffle_*") if p.exists()}


def test_append_frees_its_shuffle_files(spark, tmp_path):
    store = TripleStore(spark, str(tmp_path / "store"), buckets=4)
    rows = spark.range(60000).selectExpr("'g' AS graph", "concat('s', id % 20000) AS s", "'iri' AS s_kind", "concat('p', id % 3) AS p", "sha2(cast(id % 30000 AS string), 256) AS o",
                                         "'lit' AS o_kind", "CAST(NULL AS string) AS o_dt", "IF(id % 2 = 0, 'en', NULL) AS o_lang")
    before = set(_shuffle_files(spark))
    for number, batch in enumerate((rows.where("p <> 'p2'"), rows)):
        store.append(batch, number)
    left = lambda: sum(n for p, n in _shuffle_files(spark).items() if p not in before)
    until = time.time() + 15
    while left() > 100_000 and time.time() < until:  # files go in the background
        time.sleep(0.2)
    assert left() <= 100_000
    assert store.triples().count() == rows.distinct().count() and {r.batch: r.n for r in store.triples().groupBy("batch").agg(F.count("*").alias("n")).collect()} == {0: 40000, 1: 20000}


def test_a_batch_in_shares_is_a_set(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "PASS_BYTES", 1)
    monkeypatch.setattr(store_module, "TASK_BYTES", 500)
    rng, schema = random.Random(4), "graph string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"
    store, held = TripleStore(spark, str(tmp_path / "store"), buckets=16), set()
    for number in (2, 5, 7):
        rows = [("g", f"s{rng.randrange(30)}", "iri", rng.choice([LABEL, TYPE, "p"]), rng.choice(["", "a", "b"]), "lit", rng.choice([None, "", "t"]), rng.choice([None, "", "en"])) for _ in range(200)]
        new = {(s, *rest) for _, s, _, *rest in rows} - held
        assert {(r.s, r.p, r.o, r.o_kind, r.o_dt, r.o_lang) for r in store.append(spark.createDataFrame(rows, schema), number).collect()} == new
        held |= new
    assert store.triples().count() == len(held)
    got = {(r.measure, r.label): r.n for r in store.measures().collect()}
    assert got["triples", ""] == got["literals", ""] == len(held) and got["empty_literals", ""] == sum(t[2] == "" for t in held)
    assert got["subjects", ""] == len({t[0] for t in held}) and got["subjects_with_labels", ""] == len({t[0] for t in held if t[1] == LABEL})
    assert got["class", "a"] == sum(t[1] == TYPE and t[2] == "a" for t in held) and got["datatype", "None"] == sum(t[4] is None for t in held)
    assert got["untyped_literals", ""] == sum(t[4] is None and t[5] is None for t in held) and got["language", "en"] == sum(t[5] == "en" for t in held)
