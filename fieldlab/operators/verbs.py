"""Table verbs: column selection, renames, null handling, stacking, ordering."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ordinal


def snake(name: str) -> str:
    """Column name in lower snake case; ``mg/g.d?`` becomes ``mg_g_d``."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip().lstrip("﻿"))
    return re.sub(r"[^0-9a-zA-Z]+", "_", spaced).strip("_").lower()


def snake_case(df: DataFrame) -> DataFrame:
    """Normalise all names, refusing two names that would become one."""
    new = [snake(c) for c in df.columns]
    clash = {c for c in new if new.count(c) > 1}
    if clash:
        raise ValueError(f"names collide after normalising: {sorted(clash)}")
    return df.toDF(*new)


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` in table order."""
    names = df.columns
    return names[names.index(first): names.index(last) + 1]


def relocate(df: DataFrame, names: Sequence[str], before: str | None = None,
             after: str | None = None) -> DataFrame:
    """Move columns next to another one; to the front if none is given."""
    rest = [c for c in df.columns if c not in set(names)]
    at = rest.index(before) if before else rest.index(after) + 1 if after else 0
    return df.select(*rest[:at], *names, *rest[at:])


def rename_matching(df: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """Rename the one column whose name contains each given text."""
    found = {}
    for new, text in patterns.items():
        hits = [c for c in df.columns if text in c]
        if len(hits) != 1:
            raise ValueError(f"{text!r} matches {hits}")
        found[hits[0]] = new
    return df.withColumnsRenamed(found)


def across(df: DataFrame, f, names: Iterable[str] | None = None,
           of_type: type[T.DataType] | None = None) -> DataFrame:
    """Apply one Column function to listed columns or to all of a type."""
    if names is None:
        names = [x.name for x in df.schema.fields if isinstance(x.dataType, of_type)]
    return df.withColumns({c: f(F.col(c)) for c in names})


def drop_null(df: DataFrame, *names: str) -> DataFrame:
    """Drop rows with a NULL in the named columns, or in any column."""
    return df.dropna(subset=list(names)) if names else df.dropna()


def keep_unless(df: DataFrame, reject: Column) -> DataFrame:
    """Anti join of a table with a filter of itself, as one predicate.

    Rows where the predicate is NULL were never in the reject set, so they stay.
    """
    return df.filter(~F.coalesce(reject, F.lit(False)))


def stack(*tables: DataFrame) -> DataFrame:
    """Bind rows by name; the tables must have the same columns."""
    out = tables[0]
    for t in tables[1:]:
        if set(t.columns) != set(out.columns):
            raise ValueError(f"columns differ: {sorted(set(t.columns) ^ set(out.columns))}")
        out = out.unionByName(t)
    return out


def order_by_levels(df: DataFrame, name: str, levels: Sequence, *more: Column | str) -> DataFrame:
    """Sort by the position of a level, unknown levels last."""
    return df.orderBy(ordinal(name, levels).asc_nulls_last(), *more)
