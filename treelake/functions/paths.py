"""Paths, names and IRIs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespaces that labels shorten, by prefix.
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "hdf": "http://purl.allotrope.org/ontologies/hdf5/1.8#",
    "dcat": "http://www.w3.org/ns/dcat#",
    "dcterms": "http://purl.org/dc/terms/",
    "doi": "https://doi.org/",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "prof": "http://www.w3.org/ns/dx/prof/",
    "prov": "http://www.w3.org/ns/prov#",
    "qudt": "http://qudt.org/schema/qudt/",
    "quantitykind": "http://qudt.org/vocab/quantitykind/",
    "schema": "https://schema.org/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "unit": "http://qudt.org/vocab/unit/",
}
#: Addresses of records with a short form of their own; they come first.
RECORDS = {
    "https://doi.org/10.5281/zenodo.": "zen",
    "https://zenodo.org/records/": "rzen",
    "https://zenodo.org/record/": "rzen",
}
LONGEST_LITERAL = 48


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The path above; null for the root."""
    up = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(path == "/", None).when(up == "", "/").otherwise(up)


def parent_names(path: Column) -> Column:
    """The names above, outermost first; an empty array directly below the root."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) > 1, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<string>"))


def namespace(iri: Column) -> Column:
    """Up to the last ``#``, else up to the last ``/``; all of it if it has neither."""
    hashed = F.regexp_extract(iri, "^(.*#)", 1)
    slashed = F.regexp_extract(iri, "^(.*/)", 1)
    return F.when(hashed != "", hashed).when(slashed != "", slashed).otherwise(iri)


def last_segment(iri: Column) -> Column:
    """What follows the last ``#`` and then the last ``/``; all of it if that is nothing."""
    last = F.substring_index(F.substring_index(iri, "#", -1), "/", -1)
    return F.when(last != "", last).otherwise(iri)


def term_label(term: Column, kind: Column, prefixes: dict[str, str] | None = None) -> Column:
    """A compact label: short form, prefixed name, or last segment of an IRI; the id of a blank node; a
    literal, cut to 45 characters and dots where it has more than 48."""
    cut = F.concat(F.left(term, F.lit(LONGEST_LITERAL - 3)), F.lit("..."))
    out = F.when(kind == "lit", F.when(F.char_length(term) > LONGEST_LITERAL, cut).otherwise(term)).when(kind == "bnode", term)
    named = [*RECORDS.items(), *((v, k) for k, v in (PREFIXES if prefixes is None else prefixes).items())]
    for start, short in named:
        rest = F.right(term, F.char_length(term) - len(start))
        out = out.when(term.startswith(start) & (F.length(term) > len(start)), F.concat(F.lit(short + ":"), rest))
    return out.otherwise(last_segment(term))


def quoted(path: Column) -> Column:
    """Percent-encoded as UTF-8, except letters, digits, ``_.-~`` and ``/``."""
    steps = (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A"))
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), steps, F.url_encode(path))


def object_iri(base: Column, path: Column) -> Column:
    return F.concat(base, quoted(F.regexp_replace(path, "^/+", "")))


def attribute_iri(base: Column, path: Column, attr: Column) -> Column:
    return F.concat(object_iri(base, path), F.lit("@"), quoted(attr))


def to_iri(value: Column, base: Column, strict: bool = False) -> Column:
    """``_:x`` becomes an IRI under ``base``; http(s) and urn pass; anything else is null, or an error."""
    bad = F.raise_error(F.concat(F.lit("not an IRI: "), value)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(value.startswith("_:"), F.concat(base, F.right(value, F.char_length(value) - 2))).when(
        value.rlike("^(https?://|urn:)"), value).otherwise(bad)


def clean_name(name: Column) -> Column:
    """Runs of anything but letters, digits and ``_`` become one ``_``; none at the ends."""
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")


def file_name(url: Column) -> Column:
    """The last path segment of a URL, without query and fragment."""
    return F.substring_index(F.regexp_replace(url, "[?#].*$", ""), "/", -1)


def record_id(url: Column) -> Column:
    """The trailing number of a record's address, or null."""
    found = F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), r"([0-9]+)/?$", 1)
    return F.when(found != "", found)


#: Serialisation by file suffix.
_FORMATS = {"ttl": "turtle", "nt": "nt", "nq": "nquads", "rdf": "xml", "owl": "xml", "xml": "xml", "jsonld": "json-ld", "json": "json-ld",
            "n3": "n3", "trig": "trig"}


def rdf_format(name: Column) -> Column:
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return reduce(lambda c, kv: c.when(suffix == kv[0], kv[1]), _FORMATS.items(), F.when(F.lit(False), ""))


def label_and_unit(text: Column) -> tuple[Column, Column]:
    """``name [unit]`` split in two; without brackets the unit is empty."""
    pattern = r"^(.*?)\s*\[([^\[\]]*)\]\s*$"
    has = text.rlike(pattern)
    return F.when(has, F.regexp_extract(text, pattern, 1)).otherwise(text), F.when(has, F.regexp_extract(text, pattern, 2)).otherwise("")
