"""Text expressions of search and chunking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{4e00}-\x{9fff}]"
WORD = r"[\p{L}\p{N}_]+"


def query_terms(text: Column, cut: int = 32) -> Column:
    """Distinct words in order, without single ideographs, each cut; the whole text where none is left."""
    words = F.regexp_extract_all(F.lower(F.trim(text)), F.lit(f"({WORD})"), F.lit(1))
    words = F.filter(words, lambda w: ~((F.length(w) == 1) & w.rlike(CJK)))
    words = F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, cut)))
    return F.when(F.size(words) > 0, words).otherwise(F.array(F.lower(F.trim(text))))


def cjk_grams(text: Column, sizes: tuple[int, ...] = (3, 2), most: int = 24) -> Column:
    """Distinct runs of so many ideographs, in the order of their place and size."""
    runs = F.regexp_extract_all(text, F.lit(f"({CJK}+)"), F.lit(1))
    of_size = lambda n: F.flatten(F.transform(F.filter(runs, lambda r: F.length(r) >= n), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: F.substring(r, i, F.lit(n)))))
    return F.slice(F.array_distinct(F.concat(*[of_size(n) for n in sizes])), 1, most)


def snippet(text: Column, needle: str, before: int = 80, width: int = 280) -> Column:
    """A window around the first match, with an ellipsis where it is cut."""
    at = F.instr(F.lower(text), needle.lower())
    begin = F.greatest(F.lit(1), at - before)
    begin = F.when(at == 0, F.lit(1)).otherwise(begin)
    cut = F.substring(text, begin, F.lit(width))
    return F.concat(F.when(begin > 1, "…").otherwise(""), cut, F.when(begin + width <= F.length(text), "…").otherwise(""))


def token_estimate(text: Column) -> Column:
    """Ideographs count one each, other characters a quarter, one at least."""
    other = F.length(F.regexp_replace(text, CJK, ""))
    return (F.length(text) - other) + F.greatest(F.lit(1), F.floor(other / 4).cast("int"))


def windows(text: Column, size: int) -> Column:
    """Fixed windows of size characters."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Cut after a Chinese full stop, or an English one before white space."""
    return F.filter(F.split(text, r"(?<=[。！？；])|(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def bounded(text: Column, most: int, mark: str = "\n…\n") -> Column:
    """Head, mark and tail of a text longer than most."""
    room = most - len(mark)
    head = room // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(mark), F.substring(text, -(room - head), room - head)))
