"""Column helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are what stands between these: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: Catalyst can't copy it into every place that uses it."""
    return F.transform(F.array(value), body)[0]


def whole_text(col: str | Column) -> Column:
    """The text, or an empty one for null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def whole_row(df: DataFrame) -> Column:
    """All of a row's columns as one value; select("name.*") gives them back."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, nothing else; texts without capitals are passed through."""
    return F.translate(text, _UPPER, _LOWER)


def keyed(df: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """Only id and the given columns, under names no table uses, with a key per row (ids may repeat or be null)."""
    return df.select(F.col(id_col).alias("__id"), *(F.col(c).alias(f"__{i}") for i, c in enumerate(cols)), F.monotonically_increasing_id().alias("__row"))
