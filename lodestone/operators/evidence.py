"""Evidence around hits: overlap, budgets, citations, supporting rows; and states of embedding profiles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.vector import cosine


def overlap(before: str, after: str, most: int = 242) -> int:
    """Length of the longest end of one text that begins the other."""
    for n in range(min(most, len(before), len(after)), 0, -1):
        if before.endswith(after[:n]):
            return n
    return 0


def merged_neighbours(chunks: DataFrame, edge: int = 240) -> DataFrame:
    """Each chunk between the end of the one before and the beginning of the one after, what they share said once."""
    w = Window.partitionBy("document_id").orderBy("place")
    rows = chunks.select("chunk_id", "content", F.substring(F.lag("content").over(w), -edge, edge).alias("before"), F.substring(F.lead("content").over(w), 1, edge).alias("after"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for chunk, content, before, after in batch.itertuples(index=False):
                text = content if not before else before + content[overlap(before, content) :] if overlap(before, content) else f"{before}\n\n{content}"
                shared = overlap(text, after) if after else 0
                out.append((chunk, text if not after else text + after[shared:] if shared else f"{text}\n\n{after}"))
            yield pd.DataFrame(out, columns=["chunk_id", "context"])

    return rows.mapInPandas(run, "chunk_id long, context string")


@F.pandas_udf(T.StringType())
def decoded(raw: pd.Series) -> pd.Series:
    """Text of bytes in the first encoding that fits: UTF-8 with or without its mark, GB18030, Latin-1."""

    def one(data: bytes | None) -> str | None:
        for name in ("utf-8-sig", "gb18030"):
            try:
                return None if data is None else data.decode(name)
            except UnicodeDecodeError:
                continue
        return data.decode("latin-1")

    return raw.map(one)


def fair_share(sizes: Column, budget: int) -> Column:
    """What each item gets of a budget, in order: no more than an equal share of what is left."""
    state = F.aggregate(
        sizes, F.struct(F.lit(budget).alias("left"), F.size(sizes).alias("items"), F.array().cast("array<int>").alias("given")),
        lambda s, x: F.struct(
            (s["left"] - F.least(x.cast("int"), F.floor(s["left"] / s["items"]).cast("int"))).alias("left"), (s["items"] - 1).alias("items"),
            F.concat(s["given"], F.array(F.least(x.cast("int"), F.floor(s["left"] / s["items"]).cast("int")))).alias("given"),
        ),
    )
    return state["given"]


def centred(text: Column, at: Column, width: int) -> Column:
    """A cut of a text around a place, with ellipses."""
    begin = F.greatest(F.lit(0), F.least(at - width // 2, F.length(text) - width)).cast("int")
    cut = F.substring(text, begin + 1, F.lit(width))
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.when(begin > 0, "…").otherwise(""), cut, F.when(begin + width < F.length(text), "…").otherwise("")))


def uncited(citations: Column, evidence: Column) -> Column:
    """Citations that no evidence has; an answer is supported if there is none and it cites something."""
    return F.array_except(citations, evidence)


def supporting(hits: DataFrame, anchors: DataFrame) -> DataFrame:
    """One more anchor of the same document and version for each hit, unless the hit's text has it already."""
    own = anchors.select("document_id", "version", F.col("chunk_id").alias("anchor_id"), F.col("content").alias("anchor_text"), "rank").where("kind <> 'table'")
    joined = hits.join(own, ["document_id", "version"]).where((F.col("anchor_id") != F.col("chunk_id")) & ~F.contains("content", F.col("anchor_text")))
    return joined.groupBy("document_id", "chunk_id").agg(F.min_by("anchor_id", F.struct("rank", "anchor_id")).alias("anchor_id"))


#: Which states of an embedding profile may follow which (fixed values).
PROFILE_STEPS = {"draft": {"tested", "failed"}, "tested": {"building", "failed"}, "building": {"ready", "failed"}, "ready": {"active", "building", "retired"}, "active": {"retired"}, "retired": {"active"}, "failed": {"draft"}}


def next_profile_state(state: str, wanted: str, missing: int = 0) -> str:
    """The state after a request: an index that lacks vectors goes back to building instead of becoming active."""
    if wanted == "active" and state in ("ready", "retired") and missing:
        return "building"
    if wanted not in PROFILE_STEPS.get(state, set()):
        raise ValueError(f"{state} cannot become {wanted}")
    return wanted


def compatibility(pairs: DataFrame, profiles: DataFrame, keys: list[str], least: float = 0.999) -> DataFrame:
    """profiles (keys, same_fingerprint, same_shape: dimension and model) with a verdict: same, compatible, rebuild_required or unknown, by the least similarity of the canaries' vectors. pairs:
    keys, e and other, a canary's vector before and now."""
    found = pairs.groupBy(*keys).agg(F.min(cosine(F.col("e"), F.col("other"))).alias("similarity"))
    verdict = (
        F.when(F.col("same_fingerprint"), "same").when(~F.col("same_shape"), "rebuild_required").when(F.col("similarity").isNull(), "unknown")
        .when(F.col("similarity") >= least, "compatible").otherwise("rebuild_required")
    )
    return profiles.join(found, keys, "left").withColumn("verdict", verdict)


def canary_similarity(pairs: DataFrame) -> DataFrame:
    return pairs.select("name", F.round(cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


def valid_boundaries(ends: Column, n: Column) -> Column:
    """Whether ends of groups rise strictly and the last one is the number of blocks."""
    rising = F.forall(F.transform(ends, lambda x, i: (i == 0) | (x > F.get(ends, i - 1))), lambda b: b)
    return rising & (F.size(ends) > 0) & F.coalesce(F.get(ends, F.size(ends) - 1) == n, F.lit(False))
