"""The find language: objects by attributes, properties and values, over all files at once.

A filter maps keys to an operand or to ``{operator: operand}``; keys combine by AND. Several
operators under one key combine by OR (``match='any'``), or by AND with ``match='all'``. Keys:

* ``name`` — an attribute; ``name.path`` — inside a JSON attribute, at any depth;
* ``$name``, ``$basename``, ``$shape``, ``$ndim``, ... — a property of the object;
* ``$eq``, ``$gt``, ... at the top — the dataset's value, if the operand has its dimensions.

All attribute keys are answered by one scan of the attributes, pruned to their names, and one
grouping by object. Missing attributes never match a comparison; ``$exists: False`` matches every
object in scope that lacks the attribute.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelake.model import Catalogue

KEY = ["file_id", "name"]
_VALUE_OPS = {"$eq", "$gt", "$gte", "$lt", "$lte", "$mean"}
_KINDS = {"group": "group", "groups": "group", "grp": "group", "h5py.group": "group",
          "dataset": "dataset", "datasets": "dataset", "dset": "dataset", "h5py.dataset": "dataset"}


def kind_of(objfilter: str | None) -> str | None:
    """The object kind of one of its spellings."""
    if objfilter is None:
        return None
    try:
        return _KINDS[objfilter.lower().lstrip("$")]
    except KeyError:
        raise ValueError(f"no object kind is called {objfilter!r}") from None


def _ordered(op: str, c: Column, x: Any) -> Column:
    return {"$eq": c == x, "$gt": c > x, "$gte": c >= x, "$lt": c < x, "$lte": c <= x}[op]


def compare(op: str, operand: Any, text: Column, number: Column) -> Column:
    """One operator on a value that is text or a number; null never matches."""
    if op == "$userdefined" or callable(operand):
        return F.coalesce((operand if callable(operand) else operand["f"])(F.coalesce(text, number.cast("string"))), F.lit(False))
    if op in ("$in",):
        words = [x for x in operand if isinstance(x, str)]
        numbers = [x for x in operand if not isinstance(x, str)]
        tests = ([text.isin(*words)] if words else []) + ([number.isin(*numbers)] if numbers else [])
        out = reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), tests, F.lit(False))
    elif op == "$regex":
        out = F.coalesce(text, number.cast("string")).rlike(operand)
    elif op == "$basename":
        out = text.rlike(f"^.*/{operand}$")
    elif op in ("$eq", "$gt", "$gte", "$lt", "$lte"):
        out = _ordered(op, text if isinstance(operand, str) else number, operand)
    else:
        raise ValueError(f"no operator is called {op}")
    return F.coalesce(out, F.lit(False))


def _operators(condition: Any) -> Mapping[str, Any]:
    if isinstance(condition, Mapping) and condition and all(str(k).startswith("$") for k in condition):
        return condition
    return {"$userdefined" if callable(condition) else "$eq": condition}


def _combine(tests: list[Column], match: str) -> Column:
    return reduce((lambda a, b: a & b) if match == "all" else (lambda a, b: a | b), tests)


def in_scope(objects: DataFrame, base: str = "/", recursive: bool = True, objfilter: str | None = None) -> DataFrame:
    """Objects of a kind below ``base`` (itself included), or only its direct children."""
    out = objects if objfilter is None else objects.where(F.col("obj_type") == kind_of(objfilter))
    if not recursive:
        return out.where(F.col("parent") == base)
    if base == "/":
        return out
    return out.where((F.col("name") == base) | F.col("name").startswith(base.rstrip("/") + "/"))


def _property(key: str, condition: Any, match: str) -> Column:
    name = {"$shape": "shape", "$chunks": "chunks", "$maxshape": "maxshape"}.get(key, key[1:])
    c = F.col(name)
    tests = []
    for op, x in _operators(condition).items():
        if isinstance(x, (list, tuple)) and op != "$in":
            tests.append(F.coalesce(c == F.array(*[F.lit(v).cast("long") for v in x]).cast("array<bigint>"), F.lit(False)))
        else:
            tests.append(compare(op, x, c.cast("string"), c.cast("double") if name in ("ndim", "size", "depth", "compression_opts")
                                 else F.lit(None).cast("double")))
    return _combine(tests, match)


def _attribute_test(key: str, op: str, x: Any) -> Column:
    """On an attribute row; the row's name is tested too. A dotted key is a path or a dotted name."""
    own = (F.col("attr") == key) & compare(op, x, F.col("s"), F.coalesce(F.col("d"), F.col("i").cast("double")))
    if "." not in key:
        return own
    head, _, path = key.partition(".")
    inner = F.get_json_object("json", "$." + path)
    return own | ((F.col("attr") == head) & compare(op, x, inner, inner.try_cast("double")))


def _by_value(values: DataFrame, op: str, x: Any, transform: str | None = None) -> DataFrame:
    """Keys of the datasets whose value compares so. Arrays are equal if all their elements are; their
    sizes are compared before any element is gathered, so only literals' sizes are ever collected."""
    if transform == "mean":
        means = values.where("v is not null").groupBy(*KEY).agg(F.avg("v").alias("m"))
        return means.where(_ordered(op, F.col("m"), x)).select(*KEY)
    if isinstance(x, (list, tuple)):
        right = values.where("i0 is not null and i1 is null")
        wanted = F.element_at(F.array(*[F.lit(float(v)) for v in x]), F.least(F.col("i0"), F.lit(len(x) - 1)) + 1)
        hits = right.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if((F.col("i0") < len(x)) & (F.col("v") == wanted)).alias("k"))
        return hits.where(f"n = {len(x)} and k = {len(x)}").select(*KEY)
    scalars = values.where("i0 is null")
    return scalars.where(compare(op, x, F.col("sv"), F.col("v"))).select(*KEY)


@dataclass
class _Compiled:
    """A filter in parts: a condition on objects, tests of values, flags of attribute rows and the condition on them."""

    own: Column
    values: list[tuple[str, Any, str | None]]
    flags: dict[str, Column]
    names: set[str]
    absent: list[str]
    wanted: Column


def _compile(flt: Mapping[str, Any] | str | list[str], match: str = "any", prefix: str = "f") -> _Compiled:
    if isinstance(flt, str):
        flt = {flt: {"$exists": True}}
    elif isinstance(flt, list):
        flt = {k: {"$exists": True} for k in flt}
    out = _Compiled(F.lit(True), [], {}, set(), [], F.lit(True))
    for k, (key, condition) in enumerate(flt.items()):
        if key in _VALUE_OPS:
            out.values.append((key, condition, None) if key != "$mean" else (*next(iter(_operators(condition).items())), "mean"))
        elif key == "$basename":
            out.own = out.own & F.col("name").rlike(f"^.*/{condition}$")
        elif key.startswith("$"):
            out.own = out.own & _property(key, condition, match)
        else:
            out.names |= {key, key.partition(".")[0]}
            tests = []
            for j, (op, x) in enumerate(_operators(condition).items()):
                flag = f"{prefix}{k}_{j}"
                if op == "$exists":
                    out.flags[flag] = F.col("attr") == key
                    tests.append(F.col(flag) if x else ~F.col(flag))
                    out.absent += [] if x else [flag]
                else:
                    out.flags[flag] = _attribute_test(key, op, x)
                    tests.append(F.col(flag))
            out.wanted = out.wanted & _combine(tests, match)
    return out


def _seen(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*KEY).agg(*[F.bool_or(F.coalesce(t, F.lit(False))).alias(f) for f, t in flags.items()])


def find(cat: Catalogue, flt: Mapping[str, Any] | str | list[str], objfilter: str | None = None, base: str = "/",
         recursive: bool = True, match: str = "any") -> DataFrame:
    """The objects that match. ``{}`` matches all in scope; a string or list of strings asks for attributes."""
    c = _compile(flt, match)
    out = in_scope(cat.objects, base, recursive, objfilter).where(c.own)
    for op, x, how in c.values:
        out = out.join(_by_value(cat.values, op, x, how), KEY, "left_semi")
    if not c.flags:
        return out
    rows = cat.attributes.where(F.col("attr").isin(*sorted(c.names)))
    if len(c.flags) == 1:
        (flag, test), = c.flags.items()
        return out.join(rows.where(test).select(*KEY), KEY, "left_anti" if c.absent else "left_semi")
    seen = _seen(rows, c.flags)
    if not c.absent:
        return out.join(seen.where(c.wanted).select(*KEY), KEY, "left_semi")
    filled = out.join(seen, KEY, "left").fillna(False, list(c.flags))
    return filled.where(c.wanted).select(*out.columns)


def find_all(cat: Catalogue, filters: list[tuple[Any, str | None]], names: list[str], match: str = "any") -> DataFrame:
    """(file_id, name, parent) of all objects with a boolean column, named in ``names``, for each of the filters (filter, object
    kind): all of them by one scan of the objects, one of the attributes pruned to the names in question, and one grouping."""
    compiled = [_compile(flt, match, f"f{k}_") for k, (flt, _) in enumerate(filters)]
    flags = {f: t for c in compiled for f, t in c.flags.items()}
    out = cat.objects
    if flags:
        rows = cat.attributes.where(F.col("attr").isin(*sorted({n for c in compiled for n in c.names})))
        out = out.join(_seen(rows, flags), KEY, "left").fillna(False, list(flags))
    columns = []
    for k, (c, (_, kind), name) in enumerate(zip(compiled, filters, names, strict=True)):
        test = F.coalesce(c.own, F.lit(False)) & c.wanted
        if kind is not None:
            test = test & (F.col("obj_type") == kind_of(kind))
        for j, (op, x, how) in enumerate(c.values):
            held = f"v{k}_{j}"
            out = out.join(_by_value(cat.values, op, x, how).distinct().withColumn(held, F.lit(True)), KEY, "left")
            test = test & F.col(held).isNotNull()
        columns.append(test.alias(name))
    return out.select(*KEY, "parent", *columns)


def find_one(cat: Catalogue, flt: Any, per_file: bool = False, **scope: Any) -> DataFrame:
    """The first match by (file_id, name): of all files, or of each."""
    hits = find(cat, flt, **scope)
    if not per_file:
        return hits.orderBy(*KEY).limit(1)
    first = hits.groupBy("file_id").agg(F.min("name").alias("name"))
    return hits.join(first, KEY, "left_semi")


def list_children(objects: DataFrame, kind: str, pattern: str = ".*", base: str = "/", recursive: bool = False) -> DataFrame:
    return in_scope(objects, base, recursive, kind).where(F.col("basename").rlike(pattern))


def has_children(objects: DataFrame, base: str = "/") -> DataFrame:
    """Per file: whether ``base`` has direct groups and datasets."""
    of = F.col("parent") == base
    return objects.groupBy("file_id").agg(F.bool_or(F.coalesce(of & (F.col("obj_type") == "dataset"), F.lit(False))).alias("has_datasets"),
                                          F.bool_or(F.coalesce(of & (F.col("obj_type") == "group"), F.lit(False))).alias("has_groups"))


def distinct_values(cat: Catalogue, key: str, objfilter: str | None = None) -> DataFrame:
    """Distinct values, as text, of an attribute or a ``$property``."""
    if key.startswith("$"):
        c = F.col(key[1:])
        kind = dict(cat.objects.dtypes)[key[1:]]
        text = F.concat_ws(",", c.cast("array<string>")) if kind.startswith("array") else c.cast("string")
        return in_scope(cat.objects, objfilter=objfilter).where(c.isNotNull()).select(text.alias("value")).distinct()
    rows = cat.attributes.where(F.col("attr") == key)
    if objfilter:
        rows = rows.join(in_scope(cat.objects, objfilter=objfilter).select(*KEY), KEY, "left_semi")
    value = F.coalesce("s", F.col("i").cast("string"), F.col("d").cast("string"), "json", F.concat_ws(",", "a"))
    return rows.select(value.alias("value")).distinct()


def rdf_find(cat: Catalogue, subject: str | None = None, type: str | None = None, predicate: str | None = None,
             object: str | None = None) -> DataFrame:
    """Objects whose annotation has all the given parts. A part may come from different annotations of an
    object; ``object`` also matches a string attribute's value."""
    parts = {"subject": (subject, F.col("subject") == subject), "predicate": (predicate, F.col("predicate") == predicate),
             "type": (type, F.array_contains("types", type) if type else None)}
    tests = {k: t for k, (given, t) in parts.items() if given is not None}
    out = cat.objects
    if tests:
        seen = cat.annotations.groupBy(*KEY).agg(*[F.bool_or(F.coalesce(t, F.lit(False))).alias(k) for k, t in tests.items()])
        out = out.join(seen.where(reduce(lambda a, b: a & b, map(F.col, tests))).select(*KEY), KEY, "left_semi")
    if object is not None:
        either = cat.annotations.where(F.col("object") == object).select(*KEY).union(
            cat.attributes.where(F.col("s") == object).select(*KEY))
        out = out.join(either, KEY, "left_semi")
    return out


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``, by a ranked window."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


Predicate = Callable[[Column], Column]
