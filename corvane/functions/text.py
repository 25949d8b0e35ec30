"""Texts as lists, names, paths and identifiers, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def pieces(text: Column, separators: str = ", \t", unique: bool = False, count: int | None = None) -> Column:
    """Parts of a text between any of the separators, without empty ones. unique makes a repeated part an error, count any
    other number of parts."""
    found = F.filter(F.split(text, f"[{re.escape(separators)}]+"), lambda p: p != "")
    if unique:
        found = F.when(F.size(found) == F.size(F.array_distinct(found)), found).otherwise(F.raise_error(F.concat(F.lit("repeated part in: "), text)).cast("array<string>"))
    if count is not None:
        found = F.when(F.size(found) == count, found).otherwise(F.raise_error(F.concat(F.lit(f"not {count} parts: "), text)).cast("array<string>"))
    return found


def parsed(text: Column, kind: str, strict: bool = True) -> Column:
    """A text as a value of a type ('true' and 'false' for boolean); one that is none is an error, or null."""
    value = text.try_cast(kind)
    return F.when(value.isNotNull() | text.isNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"not a {kind}: "), text)).cast(kind)) if strict else value


def joined(values: Column, separator: str = ", ") -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), separator)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*?)/?[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def stem(path: Column) -> Column:
    """Path without its last extension."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def file_number(path: Column, extension: str = "root") -> Column:
    """Number at the end of a file's name, as in name_12.root; null without one."""
    return F.nullif(F.regexp_extract(path, rf"_(\d+)\.{extension}$", 1), F.lit("")).cast("int")


def common_suffix(names: Column) -> Column:
    """Longest text that all names end with."""
    shortest = F.array_min(F.transform(names, F.length))
    first = F.get(names, F.lit(0))
    ends = F.transform(F.sequence(F.lit(0), shortest), lambda k: F.when(F.forall(names, lambda n: F.right(n, k) == F.right(first, k)), k))
    return F.right(first, F.array_max(ends))


def named(value: Column, names: Mapping[int, str]) -> Column:
    """Name of an enumerated value; an unknown one is an error."""
    out = F.raise_error(F.concat(F.lit("unknown value: "), value.cast("string"))).cast("string")
    for k, name in names.items():
        out = F.when(value == k, name).otherwise(out)
    return F.when(value.isNotNull(), out)


def value_of(name: Column, names: Mapping[int, str], strict: bool = True) -> Column:
    """Value of an enumeration's name; an unknown one is an error, or null."""
    out = F.raise_error(F.concat(F.lit("unknown name: "), name)).cast("int") if strict else F.lit(None).cast("int")
    for k, known in names.items():
        out = F.when(name == known, k).otherwise(out)
    return F.when(name.isNotNull(), out)


def filled(template: str, **values: Column) -> Column:
    """A template with {name} places."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p].cast("string") if k % 2 else F.lit(p) for k, p in enumerate(parts)])


def event_id(text: Column) -> Column:
    """Struct (run, lumi, evt) of 'run:lumi:evt'; other texts are an error."""
    p = pieces(text, ":", count=3)
    return F.struct(*[parsed(F.get(p, F.lit(k)), "bigint").alias(n) for k, n in enumerate(("run", "lumi", "evt"))])


def text_id(text: Column) -> Column:
    """60-bit number of a text, the same on every machine."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
