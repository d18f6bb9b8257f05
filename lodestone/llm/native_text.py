"""Words and word n-grams of a text as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands between words.
BETWEEN = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; the array may begin and end with an empty string."""
    return F.split(F.lower(text), BETWEEN)


def bare_words(text: Column) -> Column:
    return F.filter(words(text), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _grams(of: Column, k: int, join: Callable[[list[Column]], Column]) -> Column:
    """join applied to the k words of each place of an array."""

    def over(w: Column) -> Column:
        places = F.slice(w, 1, F.greatest(F.size(w) - F.lit(k - 1), F.lit(0)))
        return F.transform(places, lambda first, i: join([first, *(F.get(w, i + F.lit(j)) for j in range(1, k))]))

    return let(of, over)


def gram_hashes(of: Column, k: int) -> Column:
    """64-bit hashes of each k consecutive words."""
    return _grams(of, k, lambda w: F.xxhash64(*w))


def gram_texts(of: Column, k: int) -> Column:
    return _grams(of, k, lambda w: F.concat_ws(" ", *w))
