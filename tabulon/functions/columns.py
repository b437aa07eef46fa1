"""Column names, column types and cell-level conversions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the label that missing cells carry in frequency and cross tables.
NULL_LABEL = "缺失"

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def col(name: str) -> Column:
    """Column by literal name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def resolve_columns(requested: Iterable[str], available: Iterable[str], *, loose: bool = False) -> list[str]:
    """Map requested names to existing ones: exact match first, then containment.

    Case and white space never matter; with ``loose`` neither do hyphens and underscores.
    Unknown names are left out, the order of the request is kept, repeats are dropped.
    """
    noise = re.compile(r"[\s_-]+" if loose else r"\s+")

    def simple(name) -> str:
        return noise.sub("", str(name or "").lower())

    names = list(available)
    exact = {simple(name): name for name in names}
    found: dict[str, None] = {}
    for wish in map(simple, requested or []):
        if not wish:
            continue
        match = exact.get(wish) or next((n for n in names if wish in simple(n)), None)
        if match is not None:
            found.setdefault(match)
    return list(found)


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def existing(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Known names of the list, in order and without repeats."""
    known = set(df.columns)
    return list(dict.fromkeys(n for n in names or [] if n in known))


def finite(value: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def strip(value: Column) -> Column:
    """Remove white space of every kind from both ends; NULL stays NULL."""
    return F.trim(value, F.lit(WHITESPACE))


def to_numeric(df: DataFrame, name: str) -> Column:
    """The column as a double; cells that are no finite number become NULL."""
    data_type, value = df.schema[name].dataType, col(name)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return finite(value.cast("double"))
    if is_numeric(data_type):
        return value.cast("double")
    if isinstance(data_type, T.BooleanType):
        return value.cast("int").cast("double")
    if isinstance(data_type, T.StringType):
        text = strip(value)
        # A Java literal suffix ("1d", "2f") parses as a number in Spark but is text here.
        suffix = F.lower(F.right(text, F.lit(1))).isin("d", "f")
        return finite(F.when(~suffix, text.try_cast("double")))
    return F.lit(None).cast("double")


def numeric_view(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Only the named columns, each as a double under its own name."""
    return df.select(*[to_numeric(df, n).alias(n) for n in names])


def as_label(df: DataFrame, name: str, null_label: str | None = NULL_LABEL) -> Column:
    """The column as text; NULL becomes ``null_label`` unless that is None."""
    text = col(name).cast("string")
    return text if null_label is None else F.coalesce(text, F.lit(null_label))


def distinct_key(df: DataFrame, name: str) -> Column:
    """A short stand-in for exact distinct counting: long text is replaced by its digest.

    Whole texts are read, but at most 64 characters of each travel through the shuffle. A digest is longer than any text that
    stands for itself, so the two never meet.
    """
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.when(F.length(col(name)) > 32, F.sha2(col(name), 256)).otherwise(col(name))
    return col(name)


def normalize_missing(df: DataFrame) -> DataFrame:
    """NaN and infinities of all float columns become NULL (one projection)."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(*[
        finite(col(f.name)).alias(f.name, metadata=f.metadata) if f.name in floats else col(f.name)
        for f in df.schema.fields
    ])
