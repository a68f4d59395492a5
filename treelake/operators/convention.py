"""Attribute conventions: rules on the attributes of files, groups and datasets.

Rules are a small configuration; all attributes they name are looked up in one grouping by object.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake.functions.identifiers import identifier_valid
from treelake.functions.literals import date_literal
from treelake.functions.units import parse, parse_unit, same_dimension
from treelake.model import Catalogue
from treelake.operators.filters import KEY

#: Checks of an attribute's text by name; ``arg`` is what the rule gives.
VALIDATORS: dict[str, Callable[[Column, Any], Column]] = {
    "regex": lambda c, arg: c.rlike("^(?:" + arg + ")"),
    "in": lambda c, arg: c.isin(*arg),
    "str": lambda c, arg: c.isNotNull(),
    "number": lambda c, arg: c.try_cast("double").isNotNull(),
    "units": lambda c, arg: parse(c)["factor"].isNotNull(),
    "quantity": lambda c, arg: same_dimension(parse(F.regexp_replace(c, r"^\s*[-+0-9.eE]+\s*", "")), parse(F.lit(arg))),
    "orcid": lambda c, arg: identifier_valid(c, "orcid"),
    "identifier": lambda c, arg: identifier_valid(c, arg),
    "version": lambda c, arg: identifier_valid(c, "semver"),
    "date": lambda c, arg: date_literal(c).isNotNull(),
    "fields": lambda c, arg: reduce(lambda a, b: a & b, [
        F.coalesce(VALIDATORS[how](F.get_json_object(c, "$." + k), x), F.lit(False)) for k, (how, x) in arg.items()]),
}


def register(name: str, check: Callable[[Column, Any], Column]) -> None:
    """Adds a validator: a function of the attribute's text and the rule's argument."""
    VALIDATORS[name] = check


#: What the configuration's methods create, and how it marks attributes without a default.
_TARGETS = {"__init__": "file", "create_group": "group", "create_dataset": "dataset", "create_string_dataset": "dataset"}
_EMPTY, _NONE = "$EMPTY", "$NONE"


@dataclass
class Rule:
    """One standard attribute of a kind of object (``file``, ``group``, ``dataset``)."""

    attr: str
    target: str
    validator: str = "str"
    arg: Any = None
    obligatory: bool = True
    alternative: str | None = None
    requires: list[str] = field(default_factory=list)
    numeric_only: bool = False


def from_config(config: dict[str, Any]) -> list[Rule]:
    """Rules from a convention's configuration, as YAML or JSON reads it: names in ``__`` describe the convention, a name with ``$`` and a
    list is a set of allowed values, everything else a standard attribute with ``target_method``, ``validator``, ``default_value``,
    ``requirements`` and ``alternative_standard_attribute``. An attribute without a default is obligatory. The name may end in
    ``-file``, ``-group`` or ``-dataset`` where kinds of objects share it."""
    lists = {k: v for k, v in config.items() if k.startswith("$") and isinstance(v, list)}
    rules = []
    for name, given in config.items():
        if name.startswith(("__", "$")):
            continue
        method = given.get("target_method")
        if method not in _TARGETS:
            raise ValueError(f"{name}: no kind of object is created by {method!r}")
        validator, arg = str(given.get("validator") or "str"), None
        call = re.fullmatch(r"\$(\w+)\((.*)\)", validator, re.S)
        if validator in lists:
            validator, arg = "in", lists[validator]
        elif call:
            validator, arg = call[1], call[2]
        validator = validator.removeprefix("$")
        if validator not in VALIDATORS:
            raise ValueError(f"{name}: no validator is called {validator!r}; see register()")
        needs = given.get("requirements") or []
        default = given.get("default_value", _EMPTY)
        rules.append(Rule(re.sub("-(?:file|group|dataset)$", "", name), _TARGETS[method], validator, arg, obligatory=default == _EMPTY,
                          alternative=given.get("alternative_standard_attribute"), requires=[needs] if isinstance(needs, str) else list(needs),
                          numeric_only=validator in ("units", "quantity")))
    return rules


def from_yaml(path: str) -> list[Rule]:
    """Rules from a YAML or JSON file; see :func:`from_config`."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_config(yaml.safe_load(f))


def validate(cat: Catalogue, rules: list[Rule]) -> DataFrame:
    """(file_id, name, attr, problem): obligatory attributes that are missing, and present ones that are not
    valid. A root counts as file and as group; rules for numeric datasets leave string datasets alone."""
    names = sorted({a for r in rules for a in (r.attr, r.alternative, *r.requires) if a})
    rows = cat.attributes.where(F.col("attr").isin(*names))
    text = F.coalesce("s", F.col("d").cast("string"), F.col("i").cast("string"), "json", F.concat_ws(",", "a"))
    held = rows.groupBy(*KEY).agg(*[F.max(F.when(F.col("attr") == a, text)).alias(f"a_{a}") for a in names])
    objects = cat.objects.select(*KEY, "obj_type", "dtype").join(held, KEY, "left")
    problems = []
    for r in rules:
        kind = {"file": F.col("name") == "/", "group": F.col("obj_type") == "group", "dataset": F.col("obj_type") == "dataset"}[r.target]
        if r.numeric_only:
            kind = kind & ~F.coalesce(F.col("dtype").rlike("^(str|object|S|U|O)"), F.lit(False))
        own = F.col(f"a_{r.attr}")
        there = own.isNotNull() if r.alternative is None else own.isNotNull() | F.col(f"a_{r.alternative}").isNotNull()
        problem = F.when(own.isNotNull() & ~F.coalesce(VALIDATORS[r.validator](own, r.arg), F.lit(False)), "invalid")
        for need in r.requires:
            problem = problem.when(own.isNotNull() & F.col(f"a_{need}").isNull(), f"requires {need}")
        if r.obligatory:
            problem = problem.when(~there, "missing")
        problems.append(F.struct(F.lit(r.attr).alias("attr"), F.when(kind, problem).alias("problem")))
    out = objects.select(*KEY, F.explode(F.array(*problems)).alias("p")).select(*KEY, "p.*")
    return out.where("problem is not null")


__all__ = ["Rule", "VALIDATORS", "from_config", "from_yaml", "parse_unit", "register", "validate"]
