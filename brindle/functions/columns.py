"""Column expressions that the operators share."""

from __future__ import annotations

import unicodedata
from functools import cache
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _fold_wide(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).lower(), na_action="ignore")


def _steady(code: int) -> bool:
    """Whether NFKC never changes the character, whatever stands beside it, and lower case is a matter of it alone."""
    c = chr(code)
    category = unicodedata.category(c)
    if category[0] in "MC" or c in "\u0130\u03a3" or 0x1100 <= code < 0x1200 or not unicodedata.is_normalized("NFKC", c):
        return code < 0x80
    return True


@cache
def _unsteady() -> str:
    """A pattern of the characters of the basic plane that aren't steady, and of all beyond it; by ranges, from a rule."""
    edges = [k for k in range(0x10001) if k == 0x10000 or k == 0 or _steady(k) != _steady(k - 1)]
    ranges = [(a, b - 1) for a, b in pairwise(edges) if not _steady(a)]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in [*ranges, (0x10000, 0x10FFFF)]) + "]"


def folded(c: Column) -> Column:
    """NFKC, then lower case. Spark has no NFKC, which leaves most texts as they are: those of steady characters alone,
    accented letters among them, take Spark's lower case; others go through Arrow, where Python gets a null for the rest."""
    plain = (F.octet_length(c) == F.char_length(c)) | ~c.rlike(_unsteady())
    return F.when(plain, F.lower(c)).otherwise(_fold_wide(F.when(~plain, c)))


def ms_instant(c: Column) -> Column:
    """An instant cut to milliseconds, as the wire has it."""
    return F.date_trunc("MILLISECOND", c)


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
