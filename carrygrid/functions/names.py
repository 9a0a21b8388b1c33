"""Market symbols and exchange names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD_EDGE = r"(?<=[^\p{L}\p{N}])|(?=[^\p{L}\p{N}])"


def is_perpetual(symbol: Column) -> Column:
    """Symbol ends with -PERP or -PERPS in any letter case."""
    return symbol.rlike(r"(?i)-perps?\z")


def quote_of(symbol: Column) -> Column:
    """Second dash-separated part, or an empty string."""
    return F.split_part(symbol, F.lit("-"), F.lit(2))


def lookup_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def display_name(name: Column) -> Column:
    """Capitalise each run of letters and digits, lower-case the rest.

    Spark's ``initcap`` starts a word after white space only; here every
    character that is neither letter nor digit ends a word.
    """
    words = F.split(F.lower(name), _WORD_EDGE)
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 2**31 - 1))),
        "",
    )
