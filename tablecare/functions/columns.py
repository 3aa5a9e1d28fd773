"""Columns of any name.

A header may hold dots, back-ticks or names that differ only in case, none of which Spark resolves by
name. Operators therefore work on columns named by their position and give the names back at the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numeric import as_double, family_of, is_floating


def by_position(df: DataFrame, prefix: str = "c") -> tuple[DataFrame, Callable[[str], Column]]:
    """``df`` with its columns named ``<prefix>0`` …, and a function from an original name (the first one of that
    name) to its column there."""
    names = df.columns
    at = {n: i for i, n in reversed(list(enumerate(names)))}

    def col(name: str) -> Column:
        if name not in at:
            raise ValueError(f"no column {name!r}")
        return F.col(f"{prefix}{at[name]}")
    return df.toDF(*[f"{prefix}{i}" for i in range(len(names))]), col


def only(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names`` of ``df``, under their own names."""
    p, col = by_position(df)
    return p.select(*[col(n) for n in names]).toDF(*names)


def field_type(df: DataFrame, name: str):
    """Type of the first column of that name."""
    return next(f.dataType for f in df.schema.fields if f.name == name)


def with_values(df: DataFrame, new: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``df`` with the columns of ``new`` replaced by a function of themselves."""
    p, _ = by_position(df)
    return p.select(*[new[n](F.col(f"c{i}")) if n in new else F.col(f"c{i}") for i, n in enumerate(df.columns)]).toDF(*df.columns)


def as_text(col: Column, dt: T.DataType) -> Column:
    """Canonical text of a value for frequency tables (NULL/NaN → NULL)."""
    if family_of(dt) == "nested":
        return F.to_json(col)
    if is_floating(dt):
        return as_double(col + F.lit(0.0)).cast("string")   # -0.0 → 0.0
    if isinstance(dt, T.BinaryType):
        return F.hex(col)
    return col.cast("string")


def is_missing(col: Column, dt: T.DataType) -> Column:
    """NULL or NaN."""
    return col.isNull() | F.isnan(col) if is_floating(dt) else col.isNull()
