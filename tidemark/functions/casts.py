"""Conversion of raw cells to declared types, with misses told apart from errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The accepted spellings.
TRUE, FALSE = ("true", "1", "yes"), ("false", "0", "no")
DTYPES = ("string", "int", "float", "bool", "json")
ZONED = r"(Z|[+-]\d\d:?\d\d)$"


def is_missing(col: Column) -> Column:
    return col.isNull() | (F.trim(col.cast("string")) == "")


def parse_bool(col: Column) -> Column:
    token = F.lower(F.trim(col.cast("string")))
    return F.when(token.isin(*TRUE), F.lit(True)).when(token.isin(*FALSE), F.lit(False))


def convert(col: Column, dtype: str) -> Column:
    """The cell as text in its declared type's spelling; null where it is missing or does not convert."""
    text = col.cast("string")
    if dtype == "string":
        out = text
    elif dtype == "int":
        out = F.when(F.trim(text).rlike(r"^[+-]?\d+(_?\d+)*$"), F.replace(F.trim(text), F.lit("_"), F.lit("")).try_cast("decimal(38,0)").cast("string"))
    elif dtype == "float":
        out = F.trim(text).try_cast("double").cast("string")
    elif dtype == "bool":
        out = parse_bool(col).cast("string")
    elif dtype == "json":
        out = F.when(F.try_parse_json(text).isNotNull(), text)
    else:
        raise ValueError(f"unknown dtype {dtype!r}")
    return F.when(~is_missing(col), out)


def convert_error(col: Column, dtype: str) -> Column:
    """True where a cell that is there does not convert."""
    return ~is_missing(col) & convert(col, dtype).isNull()


def parse_zoned(col: Column) -> Column:
    """A timestamp from ISO text that names its zone; null without one."""
    return F.when(F.trim(col).rlike(ZONED), F.try_to_timestamp(F.trim(col)))
