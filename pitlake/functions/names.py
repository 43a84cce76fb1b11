"""Name normalisation."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .stats import col_of


def _marks(first: int, last: int) -> re.Pattern:
    return re.compile("[" + "".join(re.escape(chr(i)) for i in range(first, last) if unicodedata.combining(chr(i))) + "]+")


# Every character that Unicode gives a combining class. Those of the basic plane alone make a set that is looked up in
# one step; the rest, which hardly any text has, would turn it into a list that is walked for each character.
_MARKS, _HIGH_MARKS = _marks(0x300, 0x10000), _marks(0x10000, sys.maxunicode)
_HIGH = re.compile("[\U00010000-\U0010FFFF]")


def _stripped(text: str) -> str:
    plain = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _HIGH_MARKS.sub("", plain) if _HIGH.search(plain) else plain


@F.pandas_udf(StringType())
def _strip_marks(names: pd.Series) -> pd.Series:
    return names.map(_stripped, na_action="ignore")


# The white space of regular expressions, and what else may end a line.
_SPACES, _LINE_ENDS = " \t\n\x0b\f\r", "\x85\u2028\u2029"


def single_spaced(col: Column | str) -> Column:
    """Each run of white space as one space; a plain search leaves the values alone that have none to change."""
    c = col_of(col)
    odd = reduce(or_, [c.contains(x) for x in ("  ", *_SPACES[1:])])
    return F.when(odd, F.regexp_replace(c, r"\s+", " ")).otherwise(c)


def trimmed(col: Column | str) -> Column:
    """Without white space at either end; values that have none there stay as they are."""
    c = col_of(col)
    return F.when(F.btrim(c, F.lit(_SPACES + _LINE_ENDS)) != c, F.regexp_replace(c, r"^\s+|\s+$", "")).otherwise(c)


def normalise_name(col: Column | str) -> Column:
    """Compatibility-decompose, drop combining marks, lower-case, collapse white space.

    Spark has no Unicode decomposition, so that step runs on Arrow batches. Plain ASCII names go
    through it as NULL, which costs next to nothing, and the rest stays in generated code.
    """
    c = col_of(col)
    plain = F.coalesce(_strip_marks(F.when(F.octet_length(c) > F.length(c), c)), c)
    return F.trim(single_spaced(F.lower(plain)))
