import random

import pytest
from pyspark.sql import functions as F

from treelake.functions import identifiers, literals, paths
from treelake.model import XSD


def apply(spark, f, texts, kind="string"):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")
    return [r.x for r in rows.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_paths(spark):
    names = ["/", "/a", "/a/b", "/a/b/c"]
    assert apply(spark, paths.basename, names) == ["", "a", "b", "c"]
    assert apply(spark, paths.parent, names) == [None, "/", "/a", "/a/b"]
    assert apply(spark, paths.parent_names, names) == [[], [], ["a"], ["a", "b"]]
    assert apply(spark, paths.quoted, ["/My !&9]231,.0Group/My Dataset ", "/a*b~c+d"]) == ["/My%20%21%269%5D231%2C.0Group/My%20Dataset%20", "/a%2Ab~c%2Bd"]


def test_labels(spark):
    iri = lambda c: paths.term_label(c, F.lit("iri"))
    assert apply(spark, iri, ["https://doi.org/10.5281/zenodo.18349039#2023-11-07/x@q", "https://zenodo.org/records/18349039#a", "https://zenodo.org/record/18349039/files/data.h5",
                              "https://doi.org/10.1234/example", "http://purl.org/dc/terms/title", "http://x.org/a#b/c", "http://x.org/a/"]
                 ) == ["zen:18349039#2023-11-07/x@q", "rzen:18349039#a", "rzen:18349039/files/data.h5", "doi:10.1234/example", "dcterms:title", "c", "http://x.org/a/"]
    assert apply(spark, lambda c: paths.term_label(c, F.lit("lit")), ["x" * 48, "x" * 49]) == ["x" * 48, "x" * 45 + "..."]
    assert apply(spark, paths.namespace, ["http://a/b#c#d", "http://a/b/c", "plain"]) == ["http://a/b#c#", "http://a/b/", "plain"]


def test_names(spark):
    assert apply(spark, lambda c: paths.to_iri(c, F.lit("http://b/")), ["_:x", "https://y", "urn:z", "w"]) == ["http://b/x", "https://y", "urn:z", None]
    with pytest.raises(Exception, match="not an IRI"):
        apply(spark, lambda c: paths.to_iri(c, F.lit("b"), strict=True), ["w"])
    assert apply(spark, paths.clean_name, [" a-b  c! ", "__x"]) == ["a_b_c", "x"]
    assert apply(spark, paths.record_id, ["https://zenodo.org/records/123?x=1", "https://z/abc"]) == ["123", None]
    assert apply(spark, paths.rdf_format, ["a.ttl", "b.NT", "c.jsonld", "d.csv"]) == ["turtle", "nt", "json-ld", None]
    assert apply(spark, lambda c: F.struct(*[x.alias(f"c{i}") for i, x in enumerate(paths.label_and_unit(c))]), ["vel [m/s]", "plain"]) == [("vel", "m/s"), ("plain", "")]


def test_dates_and_values(spark):
    d = [None if x is None else x.removeprefix(XSD) for x in apply(spark, literals.date_literal, ["2025-01-10", "2025-01-10T12:00:00", "1.2.3", "2025", "on 2025-01-10", "0999-01-01", "10.01.2025", None])]
    assert d == ["date", "dateTime", None, None, None, None, None, None]
    assert literals.date_pattern("%Y-%m-%dT%H") == "yyyy-MM-dd'T'HH"
    with pytest.raises(ValueError):
        literals.date_pattern("%Q")
    got = apply(spark, literals.parse_value, ['{"a": 1}', "(1, 'b',)", "[]", "text", "{broken"])
    assert [(x.vtype, x["items"]) for x in got] == [("json", None), ("array", ["1", "b"]), ("array", []), ("str", None), ("str", None)]


def test_identifiers(spark):
    check = lambda kind, texts: apply(spark, lambda c: identifiers.identifier_valid(c, kind), texts)
    assert check("orcid", ["https://orcid.org/0000-0002-1825-0097", "0000-0002-1825-0097", "https://orcid.org/0000-0001-5109-3700", "https://orcid.org/0000-0002-1694-233X",
                           "https://orcid.org/0000-0002-1825-0096", "1825-0097", None]) == [True] * 4 + [False] * 3
    assert check("isbn", ["80-85892-15-4", "978-80-85892-15-4", "80/85892-15-4", "80-85892-15-8", "80-85892-15-X", "978-80-85892-15-8", "978/80-85892-15-4"]) == [True] * 2 + [False] * 5
    assert check("ror", ["https://ror.org/04wxnsj81", "04wxnsj81", "https://ror.org/?4wxnsj82", "https://orcid.org/0000-0002-1825-0097"]) == [True, True, False, False]
    assert check("urn", ["urn:isbn:0143039431", "urn:efg://wxyz", "urn:issn:1476-4687", "xyz:issn:1476-4687"]) == [True] * 3 + [False]
    assert check("semver", ["1.2.3", "1.2", "1.2.3-rc.1+b"]) == [True, False, True]


def test_orcid_against_a_loop(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(60):
        d = "".join(rng.choice("0123456789") for _ in range(15)) + rng.choice("0123456789X")
        texts.append("-".join(d[i : i + 4] for i in range(0, 16, 4)))

    def loop(t):
        d, total = t.replace("-", ""), 0
        for c in d[:-1]:
            total = (total + int(c)) * 2
        return "0123456789X"[(12 - total % 11) % 11] == d[-1]

    assert apply(spark, identifiers.orcid_valid, texts) == [loop(t) for t in texts]


def test_long_terms_are_whole(spark):
    long = "https://doi.org/10.1234/" + "x" * (1 << 20)
    df = spark.createDataFrame([(long,), ("_:" + "b" * (1 << 20),)], "t string")
    rows = df.select(F.length(paths.term_label(F.col("t"), F.lit("iri"))).alias("label"), F.length(paths.to_iri(F.col("t"), F.lit("http://b/"))).alias("iri")).collect()
    assert rows[0].label == len(long) - len("https://doi.org/") + len("doi:") and rows[1].iri == (1 << 20) + len("http://b/")
