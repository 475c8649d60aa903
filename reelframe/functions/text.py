"""Text fields of tags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelframe.functions.dims import GENRES

#: yyyy, yyyy-MM, yyyy-MM-dd and so on down to the second.
ID3_TIME = r"^\d{4}(-\d{2}(-\d{2}(T\d{2}(:\d{2}(:\d{2})?)?)?)?)?$"


def genre(text: Column) -> Column:
    """The name for "(17)" or "17"; other text stays."""
    number = F.regexp_extract(text, r"^\(?(\d{1,3})\)?$", 1)
    names = F.array(*map(F.lit, GENRES))
    n = F.when(number != "", number.cast("int"))
    return F.when(n < len(GENRES), F.element_at(names, F.least(n + 1, F.lit(len(GENRES))))).otherwise(text)


def packed_language(value: Column) -> Column:
    """Three letters of five bits each, from 0x60 on."""
    return F.concat(*(F.chr(F.shiftright(value, s).bitwiseAND(F.lit(31)) + 96) for s in (10, 5, 0)))


def id3v1_field(text: Column, start: int, length: int) -> Column:
    return F.trim(F.substring(text, start, length))
