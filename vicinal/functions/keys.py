"""Operations on compound hash keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_concat(first: Column, second: Column) -> Column:
    return F.concat(first, second)


def key_prefix(key: Column, length: int | Column) -> Column:
    return F.slice(key, 1, length)
