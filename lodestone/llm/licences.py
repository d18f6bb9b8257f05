"""Licence scans: a trained paragraph classifier, with a calibrated unknown class and template comparison.

A paragraph is a line of text with the lines that it is wrapped onto: a line that ends without a stop, colon or the like goes on in the next
one, if that is not blank. It is classified by multinomial logistic regression over sparse word n-grams of two and three
words. It is trained by Spark ML on the notices below, with variations, against the unknown class: sentences that
speak of licences without giving one, and half of the corpus's own distinct paragraphs (by their hash; together they weigh ``WEIGHT`` at
most, and those with the same n-grams of the vocabulary are one weighted row). The unknown class is calibrated on the other half, all of it: a family must reach
the probability that all but ``ALARM`` of them stay under, and at least ``LEAST``. A prediction is confirmed where the paragraph has a share ``SIMILAR`` of
the n-grams of one of the family's notices.

An n-gram without weight adds nothing, so a paragraph without any n-gram of the model's vocabulary (whose size the notices
bound) has the scores of an empty one, unknown; others are scored by a join with the weights. Only columns, SQL functions
and Spark ML are used.

Cases: null, empty and wordless texts have no licence. A null doc_id is a document of its own; rows that share a doc_id are one
document. Of several notices in a document the most probable is reported, of equal ones the first; n_notices counts
them. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.native_text import bare_words, gram_hashes, gram_texts, let, words
from lodestone.llm.store import written

UNKNOWN = "unknown"
#: The corpus's paragraphs weigh so much together, at most, beside the notices; rows that one task learns from.
WEIGHT, TASK_ROWS = 1500, 200_000
ALARM, LEAST, SIMILAR = 0.001, 0.5, 0.5
#: Words of notices by family, the first of each its full name in the SPDX list (fixed values).
NOTICES = {
    "apache-2.0": ["Apache License 2.0", "Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0", "This project is released under the Apache 2.0 license", "you may not use this file except in compliance with the Apache License", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "mit": ["MIT License", "Released under the MIT License", "Licensed under the MIT license", "The MIT License (MIT)", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "gpl-3.0": ["GNU General Public License v3.0 or later", "This work is licensed under the GNU General Public License, version 3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0-or-later", "under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the GPL v3", "You should have received a copy of the GNU General Public License along with this program", "This program is free software: you can redistribute it and/or modify it"],
    "lgpl-3.0": ["GNU Lesser General Public License v3.0 or later", "Licensed under the GNU Lesser General Public License, version 3", "under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-3.0-only", "GNU LESSER GENERAL PUBLIC LICENSE", "You should have received a copy of the GNU Lesser General Public License along with this library", "This library is free software; you can redistribute it and/or modify it"],
    "bsd-3-clause": ["BSD 3-Clause New or Revised License", "Licensed under the BSD 3-Clause License", "Released under the 3-clause BSD license", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"],
    "mpl-2.0": ["Mozilla Public License 2.0", "Licensed under the Mozilla Public License, Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"],
    "cc-by-nc-4.0": ["Creative Commons Attribution Non Commercial 4.0 International", "Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Content is available under CC-BY-NC 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-4.0": ["Creative Commons Attribution 4.0 International", "Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Content is available under CC-BY 4.0", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc0-1.0": ["Creative Commons Zero v1.0 Universal", "Dedicated to the public domain under CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication", "SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
}
#: Sentences that give no licence (fixed values).
OTHERS = [
    "You need a driving license to rent a car", "The licence fee is due every year", "Read the terms of the contract before you sign it", "All rights reserved", "Copyright notice of the publisher", "He was granted a fishing license version of the permit",
    "under the terms of the agreement", "This work is based on earlier research", "The software is licensed to the buyer only", "A general public meeting was held", "The free software movement grew", "See the license for details", "version 3 of the document was released", "The mit campus opened to visitors",
]
#: An n-gram of these words alone is no feature (fixed values).
STOP = ["a", "an", "and", "any", "are", "as", "by", "for", "from", "in", "is", "it", "may", "not", "of", "on", "or", "that", "the", "this", "to", "under", "was", "were", "with", "you", "your", "be"]
#: What a notice may stand in.
FRAMES = ["{}", "{}.", "Note: {}", "{} by the authors", "see below. {}. thank you", "{} (see the file)"]


def _gram_texts(text: Column) -> Column:
    return let(bare_words(text), lambda w: F.array_distinct(F.concat(gram_texts(w, 2), gram_texts(w, 3))))


#: A line end inside a paragraph: no stop before it (nor more than eight blanks), and no blank line after it. It begins with
#: the line end itself, which is quick to look for.
WRAP = r"\n(?<=[^\s.!?:;。！？：；][ \t]{0,8}\r?\n)(?=[ \t]*\S)"


def _split(text: Column) -> Column:
    return F.split(F.regexp_replace(text, WRAP, " "), "\n")


def _paragraphs(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select("doc_id", F.posexplode(_split(F.col("text"))).alias("paragraph", "line"))


def _examples(spark: SparkSession) -> DataFrame:
    rows = [(family, frame.format(notice), notice) for family, notices in NOTICES.items() for notice in notices for frame in FRAMES]
    return spark.createDataFrame(rows + [(UNKNOWN, frame.format(t), t) for t in OTHERS for frame in FRAMES], "family string, line string, notice string")


class Model:
    """classes, weights (gram texts with one weight by class), intercepts and the calibrated threshold."""

    def __init__(self, classes: list[str], weights: dict[str, list[float]], intercepts: list[float], threshold: float):
        self.classes, self.weights, self.intercepts, self.threshold = classes, weights, intercepts, threshold


def _gram_hash() -> Column:
    """The hash of the column gram, the text of two or three words."""
    w = F.split("gram", " ")
    return F.when(F.size(w) == 2, gram_hashes(w, 2)[0]).otherwise(gram_hashes(w, 3)[0])


def _vocabulary_hashes(spark: SparkSession, model: Model) -> DataFrame:
    """hash, w0.. of each gram of the model."""
    rows = spark.createDataFrame([(g, *map(float, w)) for g, w in model.weights.items()], "gram string, " + ", ".join(f"w{i} double" for i in range(len(model.classes))))
    return rows.withColumn("hash", _gram_hash()).drop("gram")


def _probabilities(rows: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """rows: keys and hashes (distinct, of one paragraph). Adds family and score."""
    vocabulary = F.broadcast(_vocabulary_hashes(rows.sparkSession, model))  # bound by the notices
    sums = rows.select(*keys, F.explode("hashes").alias("hash")).join(vocabulary, "hash").groupBy(*keys).agg(*[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(model.classes))])
    scores = F.array(*[F.col(f"w{i}") + F.lit(float(b)) for i, b in enumerate(model.intercepts)])
    sums = sums.select(*keys, scores.alias("scores"))
    sums = sums.withColumn("scores", F.transform("scores", lambda s: F.exp(s - F.array_max("scores"))))
    known = F.slice("scores", 1, len(model.classes) - 1)  # unknown is the last class
    sums = sums.select(*keys, F.array_max(known).alias("best"), known.alias("known"), F.aggregate("scores", F.lit(0.0), lambda a, x: a + x).alias("total"))
    names = F.array(*[F.lit(c) for c in model.classes])
    return sums.select(*keys, F.get(names, (F.array_position("known", F.col("best")) - 1).cast("int")).alias("family"), (F.col("best") / F.col("total")).alias("score"))


def _hashes(line: Column) -> Column:
    return let(words(line), lambda w: F.concat(gram_hashes(w, 2), gram_hashes(w, 3)))


def _own_sets(docs: DataFrame, vocabulary: list[int]) -> DataFrame:
    """Of every distinct line that speaks of no licence: by (its hash) and hashes, its n-grams of the vocabulary in order."""
    lines = _paragraphs(docs).where(F.length("line") > 0)
    lines = lines.where(~F.lower("line").rlike("licen[cs]e|copyright|spdx|creative commons|public domain"))  # may be a notice itself
    return lines.select(F.xxhash64("line").alias("by"), _known(F.col("line"), vocabulary).alias("hashes")).distinct()


def _known(line: Column, vocabulary: list[int]) -> Column:
    return F.array_sort(F.array_distinct(F.filter(_hashes(line), lambda h: h.isin(vocabulary))))


def _alarm_score(held: DataFrame, model: Model, n: int) -> float | None:
    """Of n lines, the highest score that more than a share of ALARM reach; None if that is less than LEAST. held: hashes, and how many lines have them."""
    scored = _probabilities(held.where(F.size("hashes") > 0), model, ["hashes", "many"]).where(F.col("score") >= LEAST)
    seen = 0
    for row in scored.groupBy("score").agg(F.sum("many").alias("many")).orderBy(F.desc("score")).toLocalIterator():
        seen += row["many"]
        if seen > int(n * ALARM):
            return row["score"]
    return None


def train(docs: DataFrame) -> Model:
    spark = docs.sparkSession
    examples = _examples(spark)
    stop = F.array(*[F.lit(w) for w in STOP])
    features = [g[0] for g in examples.select(F.explode(F.filter(_gram_texts(F.col("notice")), lambda g: F.size(F.array_except(F.split(g, " "), stop)) > 0))).distinct().orderBy("col").collect()]  # bound by the notices
    hash_of = {r["gram"]: r["hash"] for r in spark.createDataFrame([(g,) for g in features], "gram string").select("gram", _gram_hash().alias("hash")).collect()}
    vocabulary = [hash_of[g] for g in features]
    half = F.pmod("by", F.lit(2)).alias("half")
    own = written(_own_sets(docs, vocabulary).groupBy(half, "hashes").agg(F.count(F.lit(1)).alias("many")), "paragraphs")  # lines of equal n-grams are one row
    n = {r["half"]: r["n"] for r in own.groupBy("half").agg(F.sum("many").alias("n")).collect()}
    weight = min(1.0, WEIGHT / max(n.get(0, 0), 1))
    said = examples.select("family", _known(F.col("line"), vocabulary).alias("hashes"), F.lit(1.0).alias("weight"))
    rows = said.union(own.where("half = 0").select(F.lit(UNKNOWN), "hashes", F.col("many") * F.lit(weight)))
    classes = [*sorted(NOTICES), UNKNOWN]
    label = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("family")) - 1
    data = rows.select(label.cast("double").alias("label"), F.col("hashes").cast("array<string>").alias("grams"), "weight")
    data = data.repartition(1 + own.count() // TASK_ROWS, "grams").sortWithinPartitions("label", "grams")
    vectors = CountVectorizerModel.from_vocabulary([str(h) for h in vocabulary], inputCol="grams", outputCol="features", binary=True).transform(data)
    fit = LogisticRegression(maxIter=25, regParam=0.001, family="multinomial", weightCol="weight").fit(vectors.select("label", "features", "weight"))
    matrix = fit.coefficientMatrix.toArray()
    model = Model(classes, {g: [float(x) for x in matrix[:, i]] for i, g in enumerate(features)}, [float(b) for b in fit.interceptVector.toArray()], LEAST)
    over = _alarm_score(own.where("half = 1").select("hashes", "many"), model, n.get(1, 0))
    if over is not None:
        model.threshold = max(LEAST, min(0.99, over + 1e-6))
    return model


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, licence (a family, or null), score, confirmed, paragraph, n_notices."""
    spark = docs.sparkSession
    vocabulary = [r["hash"] for r in _vocabulary_hashes(spark, model).select("hash").collect()]  # bound by the notices
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lines = F.transform(_split(F.col("text")), lambda line, i: F.struct(i.alias("paragraph"), _hashes(line).alias("hashes")))
    lines = F.filter(lines, lambda x: F.exists(x["hashes"], lambda h: h.isin(vocabulary)))
    found = rows.select("doc_id", F.explode_outer(lines).alias("x")).select("doc_id", "x.paragraph", F.array_distinct("x.hashes").alias("hashes"))
    found = written(found, "paragraphs")
    keys = ["doc_id", "paragraph"]
    named = found.where("paragraph is not null")
    judged = _probabilities(named, model, keys).where(F.col("score") >= model.threshold)
    notices = _examples(spark).where(F.col("family") != UNKNOWN).select("family", "notice").distinct().select("family", F.array_distinct(F.concat(gram_hashes(bare_words(F.col("notice")), 2), gram_hashes(bare_words(F.col("notice")), 3))).alias("own"))
    compared = judged.join(named, [judged["doc_id"].eqNullSafe(named["doc_id"]), judged["paragraph"] == named["paragraph"]]).select(judged["doc_id"], judged["paragraph"], "family", "score", "hashes")
    compared = compared.join(F.broadcast(notices), "family").withColumn("similar", F.size(F.array_intersect("own", "hashes")) / F.size("own"))
    best = compared.groupBy("doc_id", "paragraph", "family", "score").agg(F.max("similar").alias("similar"))
    top = best.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("paragraph")).alias("first"), "family", "similar")).alias("b"), F.count_distinct("paragraph").alias("n_notices"))
    top = top.select(F.col("doc_id").alias("id"), F.col("b.family").alias("licence"), "b.score", (F.col("b.similar") >= SIMILAR).alias("confirmed"), (-F.col("b.first")).alias("paragraph"), "n_notices")
    every = found.select("doc_id").distinct()
    return every.join(top, every["doc_id"].eqNullSafe(top["id"]), "left").select("doc_id", "licence", "score", "confirmed", "paragraph", F.coalesce("n_notices", F.lit(0)).alias("n_notices"))


def licences(docs: DataFrame) -> DataFrame:
    return scan(docs, train(docs))
