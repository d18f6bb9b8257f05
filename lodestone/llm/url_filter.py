"""URL filters by a Bloom filter cascade: exact membership in a list of keys, without a join per url.

A rule is a host and the beginning of a path; its key is both in one string. A url's candidate keys are the last labels of
its host by the beginnings of its path, of the label counts and lengths that occur among the rules. The cascade is
built over the complete universe of candidate keys of the corpus: level 0 encodes the listed keys, level 1 the other keys
that level 0 passes by mistake, level 2 the listed keys that level 1 passes, and so on until no mistake is left; a key's
membership is the parity of the first level that lacks it. A second cascade, over the listed keys, tells block from allow.
Levels have some bits a listed key. Keys are dealt by hash to parts of ``PART_KEYS`` listed keys or so, each with cascades of its own;
the cascades of one part are broadcast at a time, and the urls pass by the parts one after the other, written in between, so
memory is bounded for a list of any length, and no url is shuffled.

Cases: a null url or one without ``://`` has empty host and path and fits no rule. An empty host fits none either. Repeated
rows are judged each. Of rules of one length that fit, the one with the longer host wins; a key that is listed both ways
is blocked. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import written
from lodestone.llm.words import mix

Rule = tuple[str, str, str]  # host, path, allow or block
#: Listed keys of a part, whose cascades are broadcast together; a level has BITS_A_KEY bits for each.
PART_KEYS, BITS_A_KEY, HASHES = 10_000_000, 10, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


class Level:
    """One Bloom filter over 64-bit hash pairs, in words of 64 bits."""

    def __init__(self, words: np.ndarray, salt: int):
        self.words, self.salt = words, salt

    @staticmethod
    def places(first: np.ndarray, second: np.ndarray, salt: int, size: int) -> np.ndarray:
        a, b = mix(first.view(np.uint64) + np.uint64(salt)), second.view(np.uint64) | np.uint64(1)
        return np.stack([mix(a + np.uint64(i) * b) % np.uint64(size) for i in range(HASHES)], 1)

    def has(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        at = self.places(first, second, self.salt, 64 * len(self.words))
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(1)


def member(levels: list[Level], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether each key is listed."""
    listed, open_ = np.zeros(len(first), bool), np.arange(len(first))
    for k, level in enumerate(levels):
        there = level.has(first[open_], second[open_])
        listed[open_[~there]] = k % 2 == 1
        open_ = open_[there]
    listed[open_] = len(levels) % 2 == 1
    return listed


def _fill(keys: DataFrame, salt: int, count: int) -> Level:
    """A level with the keys (h1, h2) set: words are combined before they come to the driver, in Arrow batches; at most one word
    for 6 keys does."""
    words = count * BITS_A_KEY // 64 + 1

    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(words, np.uint64)
        for batch in batches:
            at = Level.places(batch["h1"].to_numpy(), batch["h2"].to_numpy(), salt, 64 * words).ravel()
            np.bitwise_or.at(bits, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        there = np.flatnonzero(bits)
        yield pd.DataFrame({"at": there, "bits": bits[there].view(np.int64)})

    found = keys.select("h1", "h2").mapInPandas(words_of, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(words, np.uint64)
    bits[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Level(bits, salt)


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[level.has(batch["h1"].to_numpy(), batch["h2"].to_numpy())]

    return keys.mapInPandas(run, "h1 long, h2 long")


def build_cascade(universe: DataFrame) -> list[Level]:
    """universe: h1, h2 and whether the key is listed; each key once."""
    mine, other = (universe.where(c).select("h1", "h2") for c in ("listed", "not listed"))
    levels: list[Level] = []
    while True:
        count = mine.count()
        if not count:
            return levels
        levels.append(_fill(mine, len(levels) + 1, count))
        mine, other = written(_passing(other, levels[-1]), "passing"), mine


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.regexp_extract(url, URL, 2)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key), F.xxhash64(key, F.lit(1))]


def url_verdicts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages: page_id, url. rules: host, path, verdict (allow or block). Returns page_id, host, path, rule, verdict."""
    spark = pages.sparkSession
    listed = written(rules.select(F.concat("host", "path").alias("key"), F.length("host").alias("host_n"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_n"), (F.col("verdict") == "block").alias("block")), "rules")
    shapes = [(r["labels"], r["path_n"]) for r in listed.select("labels", "path_n").distinct().collect()]  # few: what rules look like
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = F.size(F.split("host", r"\."))
    tail = lambda m: F.substring_index("host", ".", -m)
    candidates = [F.when((labels >= m) & (F.length("path") >= n), F.struct(F.concat(tail(m), F.substring("path", 1, n)).alias("key"), F.length(tail(m)).alias("host_n"))) for m, n in shapes]
    if not candidates:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    hashed = lambda x: F.struct(x["key"].alias("key"), x["host_n"].alias("host_n"), F.xxhash64(x["key"]).alias("h1"), F.xxhash64(x["key"], F.lit(1)).alias("h2"))
    rows = rows.withColumn("found", F.array_compact(F.array(*candidates)))
    listed = listed.groupBy("key").agg(F.max("block").alias("block"))
    parts = -(-listed.count() // PART_KEYS)
    h1, h2 = _hashes(F.col("key"))
    universe = rows.select(F.explode("found.key").alias("key")).distinct()
    universe = universe.join(listed, "key", "left").select(h1.alias("h1"), h2.alias("h2"), F.col("block").isNotNull().alias("listed"), F.coalesce("block", F.lit(False)).alias("block"))
    universe = written(universe, "universe")
    judged = rows.select("page_id", "host", "path", F.transform("found", hashed).alias("found"), F.lit(None).cast("string").alias("rule"), F.lit(-1).alias("host_n"), F.lit("allow").alias("verdict"))
    for part in range(parts):
        own = universe.where(F.pmod("h2", F.lit(parts)) == part)
        cascades = build_cascade(own.select("h1", "h2", "listed")), build_cascade(own.where("listed").select("h1", "h2", F.col("block").alias("listed")))
        more = part + 1 < parts
        after = judged if more else judged.drop("found")  # the last part's answers leave their candidates behind
        judged = judged.mapInPandas(_judge(spark.sparkContext.broadcast(cascades), part, parts, after.columns), after.schema)
        if more:
            judged = written(judged, "judged")
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _judge(cascades: Broadcast, part: int, parts: int, columns: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Urls with the best rule so far against the listed keys of one part."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        member_levels, block_levels = cascades.value
        for batch in batches:
            keys, sizes = batch["found"], batch["found"].map(len).to_numpy()
            which = np.repeat(np.arange(len(batch)), sizes)
            first = np.array([k["h1"] for own in keys for k in own], np.int64)
            second = np.array([k["h2"] for own in keys for k in own], np.int64)
            names = [k["key"] for own in keys for k in own]
            host_n = [k["host_n"] for own in keys for k in own]
            hit = (second % parts == part) & member(member_levels, first, second)
            block = member(block_levels, first, second)
            rule, host, verdict = list(batch["rule"]), list(batch["host_n"]), list(batch["verdict"])
            best = [(-1 if r is None else len(r), n) for r, n in zip(rule, host)]
            for k in np.flatnonzero(hit):
                row, rank = which[k], (len(names[k]), host_n[k])
                if rank > best[row]:
                    best[row], rule[row], host[row], verdict[row] = rank, names[k], host_n[k], "block" if block[k] else "allow"
            yield batch.assign(rule=rule, host_n=host, verdict=verdict)[columns]

    return judge
