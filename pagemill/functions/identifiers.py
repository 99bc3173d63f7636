"""Gibberish score for identifiers (ids, class tokens, data-* values).

One native expression: map every character to a class letter with
``translate``, then fold the price of each adjacent pair of classes.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import utf16_len

# Fixed values that must equal the reference's.
GIBBERISH_THRESHOLD = 0.3
GIBBERISH_MIN_LENGTH = 4
# Price of a transition from one character class to the next.
# U = [A-Z], L = [a-z], D = [0-9], S = [-_], O = anything else.
PRICE_TABLE = {
    "UL": 0.2,
    "LU": 0.5,
    "SU": 0.4,
    "SL": 0.3,
    "SD": 0.9,
    "UD": 1.4,
    "LD": 1.3,
    "DU": 1.4,
    "DL": 1.5,
    "DS": 1.2,
    "US": 0.2,
    "LS": 0.2,
    "DD": 1.2,
    "SS": 0.3,
    "UU": 0.1,
    "LL": 0.1,
    "OO": 0.0,
}
DEFAULT_PRICE = 1.0

_FROM = string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_"
_TO = "U" * 26 + "L" * 26 + "D" * 10 + "SS"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def char_classes(col) -> Column:
    """Class letter per code point; everything outside [A-Za-z0-9_-] becomes O."""
    marked = F.translate(_c(col), _FROM, _TO)
    return F.regexp_replace(marked, "[^ULDS]", "O")


def gibberish_score(col) -> Column:
    """Sum of pair prices over code points, divided by max(1, UTF-16 length - 1).

    Strings shorter than 2 UTF-16 units score 0.
    """
    c = _c(col)
    k = char_classes(c)
    price = F.create_map(*[x for kv in PRICE_TABLE.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    n = F.length(k)
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.when(i < n, F.coalesce(F.try_element_at(price, F.substring(k, i, 2)), F.lit(DEFAULT_PRICE))).otherwise(F.lit(0.0)),
    )
    total = F.aggregate(pairs, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    steps = F.greatest(utf16_len(c) - 1, F.lit(1))
    return F.when(utf16_len(c) < 2, F.lit(0.0)).otherwise(total / steps)


def is_gibberish(col) -> Column:
    c = _c(col)
    return F.when(utf16_len(c) < GIBBERISH_MIN_LENGTH, F.lit(False)).otherwise(gibberish_score(c) >= GIBBERISH_THRESHOLD)
