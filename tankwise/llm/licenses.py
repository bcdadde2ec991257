"""Licence scan (operator 7), DataFrame functions only.

A paragraph (line) is classified by sparse multinomial logistic regression over
its word n-grams (1 to 3 words).  Training rows are the template notices below,
whole and in part, and as the class "unknown" every paragraph of the corpus that
shares no 3-word sequence with a template.  Only n-grams of templates are features,
found once a paragraph by a join with the vocabulary; paragraphs with the same
features are one training row that weighs as many.

A family needs a probability above that of 99.9 % of all unknown paragraphs that
have any feature (and above 1/2).  A prediction is confirmed by comparing the paragraph with
the family's templates: shared word pairs by size of the smaller side.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankwise.llm.shared import documents, dropped, let, of_ids, stored
from tankwise.session import settings

# Customary licence notices, by family.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License.",
                   "This project is released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction.", "SPDX-License-Identifier: MIT"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation, either version 3 of the License, or any later "
            "version.", "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-3.0-only"],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.",
             "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public "
             "License."],
    "BSD": ["Licensed under the BSD 3-Clause License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met.", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "Licensed under the Mozilla Public License 2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International "
              "License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
                 "International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons "
                 "Attribution-NonCommercial 4.0 International License."],
    "CC0": ["This work is dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "Proprietary": ["All rights reserved.", "Copyright (c) the authors. All rights reserved.",
                    "Proprietary and confidential. Unauthorized copying is prohibited."],
}
UNKNOWN = "unknown"
CONFIRM = 0.5
CUT_BINS = 10_000        # probabilities are counted in bins of this width to find the threshold


def tokens(text) -> F.Column:
    """Lower-case words; dots, dashes and plus signs stay inside a word only."""
    inner = F.regexp_replace(F.lower(text), "(?<![\\p{L}\\p{N}])[.+-]+|[.+-]+(?![\\p{L}\\p{N}])", " ")
    return F.filter(F.split(inner, "[^\\p{L}\\p{N}.+-]+"), lambda w: w != "")


def _two(words) -> F.Column:
    return F.filter(F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.concat_ws(" ", a, b)),
                    lambda x: x.contains(" "))


def grams(words) -> F.Column:
    """All 1-, 2- and 3-word sequences as strings."""
    return let(words, lambda ws: F.concat(ws, _two(ws), F.transform(
        F.when(F.size(ws) > 2, F.sequence(F.lit(0), F.size(ws) - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat_ws(" ", F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))))


def template_table(spark) -> DataFrame:
    rows = [(f, f"{f}#{i}", t) for f, ts in TEMPLATES.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "family string, template string, text string")


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return (docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("line", "text"))
            .where(F.length(F.trim("text")) > 0))


def vocabulary_of(known: DataFrame) -> tuple[list[str], int]:
    """All n-grams of the templates, 3-word ones last, and how many are shorter."""
    words = sorted(r[0] for r in known.select(F.explode(grams(tokens(F.col("text"))))).distinct().collect())   # templates only
    short = [g for g in words if g.count(" ") < 2]
    return short + [g for g in words if g.count(" ") == 2], len(short)


def features(lines: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``(id, line, x)``: the places (from 1) in the vocabulary of a paragraph's n-grams,
    ascending; paragraphs without any are left out."""
    spark = lines.sparkSession
    table = spark.createDataFrame([(g, i + 1) for i, g in enumerate(vocabulary)], "gram string, place int")
    table = table.select(F.xxhash64("gram").alias("h"), "place")        # n-grams of the templates: a few thousand rows
    hit = (lines.select("id", "line", F.explode(F.array_distinct(grams(tokens(F.col("text"))))).alias("gram"))
           .select("id", "line", F.xxhash64("gram").alias("h")).join(F.broadcast(table), "h"))
    x = F.sort_array(F.collect_set("place")).alias("x")
    # paragraphs follow each other in a task: many short lists at once, no sort
    with settings(spark, {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "50000"}):
        return stored(hit.groupBy("id", "line").agg(x), "features")


def train(found: DataFrame, bare: int, known: DataFrame, vocabulary: list[str], short: int):
    """``(score, threshold)`` from the features of all paragraphs and the number of
    paragraphs without any; ``score`` adds ``family`` and ``probability`` to rows with ``x``."""
    spark = found.sparkSession
    # parts of a template: every window of at least five words, and the whole
    words = known.select("family", tokens(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    windows = (words.withColumn("a", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - 5))))
               .withColumn("len", F.explode(F.array(F.lit(5), F.lit(8), F.lit(13), F.lit(64))))
               .where("a = 0 or a + len <= n").select("family", F.slice("w", F.col("a") + 1, F.col("len")).alias("w")).distinct())
    place = F.array(*[F.lit(g) for g in vocabulary])
    positive = windows.select(F.col("family").alias("label"), F.transform(grams(F.col("w")), lambda g: F.array_position(place, g).cast("int")).alias("x"),
                              F.lit(1).cast("long").alias("n"))
    # a paragraph that shares a 3-word template sequence may be a licence: not a negative
    held = stored(found.where(F.array_max("x") <= short).groupBy("x").agg(F.count(F.lit(1)).alias("n")), "held")
    empty = spark.createDataFrame([(UNKNOWN, [], bare + 50)], "label string, x array<int>, n long")
    rows = positive.unionAll(held.select(F.lit(UNKNOWN).alias("label"), "x", "n")).unionAll(empty)
    families = [*TEMPLATES, UNKNOWN]
    number = F.create_map(*[x for i, f in enumerate(families) for x in (F.lit(f), F.lit(float(i)))])
    # families and unknown weigh the same in all
    negatives = held.agg(F.sum("n")).first()[0] or 0
    share = positive.count() / (negatives + bare + 50)
    weight = F.col("n") * F.when(F.col("label") == UNKNOWN, share).otherwise(1.0)
    vector = CountVectorizerModel.from_vocabulary([str(i + 1) for i in range(len(vocabulary))], inputCol="words", outputCol="features")
    vector.setBinary(True)
    vectors = lambda df: vector.transform(df.withColumn("words", F.col("x").cast("array<string>")))      # noqa: E731
    model = LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", regParam=1e-4, elasticNetParam=0.1,
                               maxIter=60, family="multinomial", standardization=False
                               ).fit(vectors(rows.withColumns({"y": number[F.col("label")], "weight": weight})).select("features", "y", "weight"))

    def score(df: DataFrame) -> DataFrame:
        """Best family (never "unknown") and its probability."""
        p = F.slice(vector_to_array("probability"), 1, len(families) - 1)
        best = let(p, lambda a: F.struct(F.array_max(a).alias("p"), F.array_position(a, F.array_max(a)).cast("int").alias("i")))
        return (model.transform(vectors(df)).withColumn("best", best)
                .select(*df.columns, F.element_at(F.array(*[F.lit(f) for f in families[:-1]]), F.col("best.i")).alias("family"),
                        F.col("best.p").alias("probability")))

    # calibration: the highest family probabilities among all paragraphs that are no licence
    bins = (score(held).where("probability > 0.5").groupBy(F.floor(F.col("probability") * CUT_BINS).alias("bin"))
            .agg(F.sum("n").alias("n"), F.max("probability").alias("top")).orderBy(F.desc("bin")).collect())     # CUT_BINS / 2 rows at most
    threshold, above = 0.5, 0
    for r in bins:
        above += r["n"]
        if above > 0.001 * negatives:
            threshold = r["top"]
            break
    dropped(held)
    return score, min(0.95, threshold)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, line, family, probability, template, similarity)``: every paragraph
    that is a licence notice.  ``line`` counts a document's lines from 0.

    Null and empty texts and lines give no row; repeated rows of a document give
    one; null ids are not reported; other columns are not read."""
    spark = docs.sparkSession
    lines = paragraphs(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    templates = template_table(spark)
    vocabulary, short = vocabulary_of(templates)
    featured = features(lines, vocabulary)
    # paragraphs are counted as features are: repeated rows of a document once
    bare = lines.select("id", "line").distinct().count() - featured.count()
    score, threshold = train(featured, bare, templates, vocabulary, short)
    found = stored(score(featured).drop("x").where(F.col("probability") > threshold), "found")
    dropped(featured)

    # template comparison on the paragraphs found
    wanted = found.groupBy("id").agg(F.collect_list(F.struct("line", "family", "probability")).alias("hits"))
    ids = stored(found.select("id").distinct(), "ids")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    chosen = (of_ids(texts, ids, "left_semi", "id").join(wanted, "id")
              .select("id", F.split("text", "\n").alias("lines"), F.explode("hits").alias("hit"))
              .select("id", "hit.line", "hit.family", "hit.probability",
                      _pairs(tokens(F.get("lines", F.col("hit.line")))).alias("own")))
    known = templates.select("family", "template", _pairs(tokens(F.col("text"))).alias("theirs"))
    same = F.size(F.array_intersect("own", "theirs"))
    best = F.max(F.struct((same / F.least(F.size("own"), F.size("theirs"))).alias("similarity"),
                          (same / F.size(F.array_union("own", "theirs"))).alias("jaccard"), "template")).alias("best")
    return (chosen.join(F.broadcast(known), "family").where((F.size("own") > 0) & (F.size("theirs") > 0))
            .groupBy("id", "line", "family").agg(F.max("probability").alias("probability"), best)
            .where(F.col("best.similarity") >= CONFIRM)
            .select(F.col("id").alias(id_col), "line", "family", "probability", F.col("best.template").alias("template"),
                    F.col("best.similarity").alias("similarity")))


def _pairs(words) -> F.Column:
    return let(words, lambda ws: F.array_distinct(_two(ws)))


def op7_license_scan(spark, sf_dir):
    """Licence notices in all documents, by family."""
    return scan(documents(spark, sf_dir))
