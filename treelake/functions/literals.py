"""Dates, times, attribute values and typed literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treelake.model import XSD

#: Strftime directives and the date patterns that mean the same.
_DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%j": "DDD",
               "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%p": "a", "%I": "hh", "%z": "xx", "%%": "%"}
DATES = ("yyyy-MM-dd", "yyyy/MM/dd")
TIMES = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm")


def date_pattern(strftime: str) -> str:
    """A strftime pattern, or ``iso``, as a date pattern; other letters are quoted."""
    if strftime == "iso":
        return "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    out, i = "", 0
    while i < len(strftime):
        if strftime[i] == "%":
            if strftime[i : i + 2] not in _DIRECTIVES:
                raise ValueError(f"no such directive: {strftime[i:i + 2]}")
            out += _DIRECTIVES[strftime[i : i + 2]]
            i += 2
        else:
            out += f"'{strftime[i]}'" if strftime[i].isalpha() else strftime[i]
            i += 1
    return out


def encode_time(t: Column, strftime: str = "iso") -> Column:
    return F.date_format(t, date_pattern(strftime))


def decode_time(s: Column, strftime: str = "iso") -> Column:
    return F.try_to_timestamp(s, F.lit(date_pattern(strftime)))


def date_literal(s: Column) -> Column:
    """The datatype of a text that is a date: xsd:date, xsd:dateTime, or null. It begins with a digit, is no
    dotted version, and its year is 1000 at least."""
    plain = s.rlike("^[0-9]") & ~s.rlike(r"^[0-9]+(\.[0-9]+)+$|^[0-9]+$")
    parse = lambda formats: F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats])
    date, time = parse(DATES), parse(TIMES)
    return F.when(plain & date.isNotNull() & (F.year(date) >= 1000), XSD + "date").when(
        plain & time.isNotNull() & (F.year(time) >= 1000), XSD + "dateTime")


def literal_type(vtype: Column) -> Column:
    """The datatype of an attribute by its kind: text has none."""
    return F.when(vtype == "int", XSD + "integer").when(vtype == "float", XSD + "float")


def parse_value(s: Column) -> Column:
    """An attribute's text as (vtype, json, items): a JSON object, a tuple or list as text, else a string."""
    t = F.trim(s)
    is_json = t.startswith("{") & t.endswith("}") & F.from_json(t, "map<string,string>").isNotNull()
    is_list = t.rlike(r"^\[.*\]$|^\(.*\)$") & (F.length(t) >= 2)
    inner = F.regexp_replace(F.regexp_replace(t, r"^[\[(]\s*|\s*[\])]$", ""), r",\s*$", "")
    items = F.when(inner == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.split(inner, r"\s*,\s*"), lambda x: F.regexp_replace(x, "^['\"]|['\"]$", "")))
    return F.struct(F.when(is_json, "json").when(is_list, "array").otherwise("str").alias("vtype"),
                    F.when(is_json, t).alias("json"), F.when(is_list & ~is_json, items).alias("items"))
