"""Feature lists of a data set from its configuration: which features each type of object has, in which order, and what
stands where one has no finite value. Only what the list names is computed and read."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from corvane.functions import features

#: The type whose features are a candidate's own columns; all others are arrays of objects.
GLOBAL = "global"
#: Rules of the features that are computed, by type of object.
RULES: dict[str, Callable[[Column, features.Get], dict[str, Column]]] = {"pfCand": features.particle_features, "ele": features.electron_features, "muon": features.muon_features}


class FeatureSet(NamedTuple):
    """Names by type in order, the value that stands in for one that is not finite, and names that no column gives."""

    names: dict[str, list[str]]
    defaults: dict[str, dict[str, float]]
    missing: dict[str, list[str]]


def computed(kind: str, obj: Column | None = None, get: features.Get = F.col) -> dict[str, Column]:
    """All features of a type that are not plain columns, and those that are among the candidate's."""
    if kind == GLOBAL:
        return features.candidate_features(get, prongs_from=1)
    return RULES[kind](obj, get) if kind in RULES else {}


def fields(df: DataFrame, kind: str) -> set[str]:
    """Plain columns of a type: those of the candidate, or the fields of its array of objects."""
    if kind == GLOBAL:
        return set(df.columns)
    found = df.schema[kind].dataType if kind in df.columns else None
    inside = isinstance(found, ArrayType) and isinstance(found.elementType, StructType)
    return set(found.elementType.names) if inside else set()


def chosen(df: DataFrame, config: dict) -> FeatureSet:
    """The features that a configuration asks for. feature_names lists them by type, in order; `disabled` takes names, or
    with `true` a whole type, out again; `defaults` gives stand-ins by type and name. A name that is no rule's and no
    column's is left out and reported as missing, as is every name of a type that the table has no array for. A name that
    is listed twice is an error, as is a default or a disabled name that is not listed."""
    wanted, off, defaults = config["feature_names"], config.get("disabled") or {}, config.get("defaults") or {}
    names, missing = {}, {}
    for kind, listed in wanted.items():
        if off.get(kind) is True:
            continue
        if len(set(listed)) < len(listed):
            raise ValueError(f"a feature of {kind} is listed twice")
        left = [n for n in listed if n not in (off.get(kind) or [])]
        there = fields(df, kind)
        known = there | (set(computed(kind, F.col(kind))) - set(features.PLAIN) if there else set())
        names[kind] = [n for n in left if n in known]
        missing[kind] = [n for n in left if n not in known]
    for what, table in (("defaults for", defaults), ("disabled", off)):
        for kind, given in table.items():
            unknown = set() if given is True else set(given) - set(wanted.get(kind, []))
            if unknown:
                raise ValueError(f"{what} features of {kind} that are not listed: {sorted(unknown)}")
    return FeatureSet(names, defaults, missing)


def sound(kind: str, name: str, value: Column, default: float | None, dtype: str) -> Column:
    """value as a number; where it is null, NaN or infinite the default, and without one an error."""
    x = value.cast("double")
    other = F.lit(float(default)) if default is not None else F.raise_error(F.lit(f"{kind} {name} has no finite value")).cast("double")
    return F.when(features.finite(x), x).otherwise(other).cast(dtype)


def vectors(df: DataFrame, keys: list[str], chosen: FeatureSet, dtype: str = "float") -> DataFrame:
    """(keys, a column for each type): the candidate's vector of features, and for other types one vector for each object
    in the order of its array. An array that is null or empty gives no vectors. Columns of df that are called like a
    feature are its plain columns, whatever else df holds."""

    def row(kind: str, obj: Column | None) -> Column:
        made = computed(kind, obj)
        plain = (lambda n: F.col(n)) if obj is None else (lambda n: obj[n])
        values = [sound(kind, n, made.get(n, plain(n) if n not in made else None), chosen.defaults.get(kind, {}).get(n), dtype) for n in chosen.names[kind]]
        return F.array(*values).cast(f"array<{dtype}>")

    def column(kind: str) -> Column:
        if kind == GLOBAL:
            return row(kind, None)
        if not chosen.names[kind]:
            return F.array().cast(f"array<array<{dtype}>>")
        return F.coalesce(F.transform(kind, lambda x: row(kind, x)), F.array().cast(f"array<array<{dtype}>>"))

    return df.select(*keys, *[column(kind).alias(kind) for kind in chosen.names])
