"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space. bytes.split() cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n. Null ids have fold null."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
