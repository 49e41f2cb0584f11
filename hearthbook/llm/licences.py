"""Licence notices, found by a trained paragraph classifier in native columns.

A paragraph is a \n-split line; its features are the distinct lower-case words and word pairs that stand in
some notice. A multinomial logistic regression with an L1 penalty is fitted to notices of each family and,
as the unknown class, to every paragraph of the corpus that is held for training: paragraphs of equal features
are one row that weighs as many, so the fit reads all of them and its table stays small. The weights of the
unknown class are scaled to ``unknown`` in all, which keeps the balance of the classes at any size. The few
non-zero weights go into the plan as constants, so scoring is a projection without a shuffle. The unknown
class is calibrated on all held-out corpus paragraphs: a family must reach ``tau``, at least one half and
what all but a share ``alarm`` of the held-out unknown paragraphs that hold a weighted feature stay within.
A prediction counts only if the paragraph also holds ``overlap`` of the words and word pairs of one of the
family's templates.

Null and blank texts have no paragraphs. Every row is judged alone; columns beside key and text are
not read.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, functions as F

from hearthbook.llm.common import WORD, let, running
from hearthbook.session import materialise

# Notices by family.
TEMPLATES = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "cc_by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc_by_nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc_by_sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc0": [
        "Released under CC0 1.0 Universal, public domain dedication.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2 or later.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2024 Example Inc. All rights reserved.",
        "No part of this publication may be reproduced without prior written permission of the publisher.",
    ],
}
# Sentences that speak of licences and give none.
OTHER = [
    "He lost his driving license on the way to the office.", "The public library is open in general until late.",
    "The right to work is reserved to members.", "A version of this text was released in the spring.",
    "All members of the public were reserved.", "The license plate was found under the bridge.",
    "This work is the work of many.", "She was licensed to practise in the state.",
]
FAMILIES = sorted(TEMPLATES)


def tokens(line: Column) -> Column:
    """Lower-case words of letters, digits and dots between digits."""
    return F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(notice: str) -> tuple[list[str], list[str]]:
    """Distinct words, and word pairs, of a notice in plain letters."""
    words = [w for w in re.split(r"[^a-z0-9]+", notice.lower()) if w]
    return list(dict.fromkeys(words)), list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def sql_array(values: list, kind: str) -> Column:
    """A constant array as one literal in the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


class Model(NamedTuple):
    terms: list[str]  # the words and word pairs with weights
    weights: list[float]  # of each term, all classes after each other
    intercepts: list[float]
    tau: float


@functools.cache
def vocabulary() -> tuple[list[str], list[str]]:
    """Words, and word pairs, of all notices and of the sentences that are none."""
    every = [grams(t) for t in [t for texts in TEMPLATES.values() for t in texts] + OTHER]
    return tuple(sorted({g for both in every for g in both[n]}) for n in (0, 1))


def marks(line: Column) -> Column:
    """The distinct words and word pairs of a paragraph that stand in some notice, sorted."""
    words, pairs = vocabulary()
    known = F.transform(tokens(line), lambda w: F.when(w.isin(words), w))

    def find(own: Column) -> Column:
        single = F.filter(own, lambda w: w.isNotNull())
        coupled = F.filter(F.transform(F.sequence(F.lit(0), F.size(own) - 2), lambda i: F.concat(F.get(own, i), F.lit(" "), F.get(own, i + 1))),
                           lambda g: g.isin(pairs))
        return F.when(~F.exists(own, lambda w: w.isNotNull()), F.array().cast("array<string>")).when(F.size(own) < 2, single).otherwise(
            F.array_sort(F.array_distinct(F.concat(single, coupled))))

    return let(known, find)


def notices(spark) -> DataFrame:
    """(line, label): the templates and their beginnings and ends; unknown is the last class."""
    rows = [(t, float(n)) for n, family in enumerate(FAMILIES) for t in TEMPLATES[family]]
    rows += [(t, float(len(FAMILIES))) for t in OTHER]
    values = F.explode(F.array(*[F.struct(F.lit(t).alias("line"), F.lit(n).alias("label")) for t, n in rows])).alias("r")
    known = spark.range(1).select(values).select("r.*")
    words = F.split("line", " ")
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    many = F.ceil(F.size(words) * 0.75).cast("int")
    some = F.when(F.size(words) >= 8, F.array("line", part(F.lit(1), many), part(F.size(words) - many + 1, many))).otherwise(F.array("line"))
    return known.select(F.explode(some).alias("line"), "label")


def covers(own: Column, template: str, overlap: float) -> Column:
    """Whether the words and word pairs of a paragraph hold enough of a template's."""
    words, pairs = grams(template)
    return F.size(F.array_intersect(own, sql_array(words + pairs, "string"))) >= overlap * len(words + pairs)


def confirmed(own: Column, family: Column, overlap: float) -> Column:
    """Whether a paragraph holds enough of one of the family's templates."""
    out = F.lit(False)
    for name in FAMILIES:
        out = F.when(family == name, functools.reduce(Column.__or__, [covers(own, t, overlap) for t in TEMPLATES[name]])).otherwise(out)
    return out


def marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_paragraphs, bare, found): paragraphs, those for training without any mark, and the others with line, half and marks."""
    each = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x, i: F.struct(
        i.alias("line"), x.rlike(WORD).alias("some"), (F.pmod(F.xxhash64(x), F.lit(2)) == 0).alias("held"), marks(x).alias("terms")))
    seen = let(each, lambda e: F.struct(
        F.size(F.filter(e, lambda x: x["some"])).cast("long").alias("n_paragraphs"),
        F.size(F.filter(e, lambda x: x["some"] & ~x["held"] & (F.size(x["terms"]) == 0))).cast("long").alias("bare"),
        F.transform(F.filter(e, lambda x: F.size(x["terms"]) > 0), lambda x: F.struct(x["line"], x["held"], x["terms"])).alias("found")))
    return docs.select(F.col(key), seen.alias("_seen")).select(key, "_seen.*")


def fit(docs: DataFrame, text: str = "text", unknown: float = 2000.0, alarm: float = 0.001) -> Model:
    """The classifier, from every paragraph of the corpus."""
    return fit_marked(materialise(marked(docs.select(F.lit(0).alias("key"), F.col(text).alias("text")), "key", "text"), "marked"), unknown, alarm)


def paragraphs(seen: DataFrame) -> DataFrame:
    """(terms, held, n): how many unknown paragraphs have these marks; notices in the corpus are no unknown paragraphs."""
    marks_of = seen.select(F.explode("found").alias("p")).groupBy("p.terms", "p.held").agg(F.count("*").alias("n"))
    bare = seen.agg(F.sum("bare").alias("n")).filter("n > 0").select(F.array().cast("array<string>").alias("terms"), F.lit(False).alias("held"), "n")
    every = [t for texts in TEMPLATES.values() for t in texts]
    is_notice = functools.reduce(Column.__or__, [covers(F.col("terms"), t, 0.6) for t in every])
    return marks_of.filter(~is_notice).unionAll(bare)


def fit_marked(seen: DataFrame, unknown: float = 2000.0, alarm: float = 0.001) -> Model:
    """The classifier, from the marks of every paragraph (see ``marked``)."""
    plain = materialise(paragraphs(seen), "paragraphs")
    total = plain.filter("not held").agg(F.sum("n")).first()[0] or 0
    share = min(1.0, unknown / total) if total else 1.0
    last = float(len(FAMILIES))
    train = notices(seen.sparkSession).select(marks(F.col("line")).alias("terms"), "label", F.when(F.col("label") < last, 20.0).otherwise(1.0).alias("weight"))
    train = train.unionAll(plain.filter("not held").select("terms", F.lit(last).alias("label"), (F.col("n") * share).alias("weight")))
    words, pairs = vocabulary()
    vectors = CountVectorizerModel.from_vocabulary(words + pairs, inputCol="terms", outputCol="x", minTF=1.0, binary=True)
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", family="multinomial",
                               elasticNetParam=1.0, regParam=0.002, maxIter=60).fit(vectors.transform(train))
    matrix, terms, weights = model.coefficientMatrix.toArray(), [], []
    for place, term in enumerate(words + pairs):
        column = matrix[:, place]
        if abs(column).max() > 1e-6:
            weights += [round(float(v), 6) for v in column]
            terms.append(term)
    found = Model(terms, weights or [0.0] * matrix.shape[0], [round(float(v), 6) for v in model.interceptVector.toArray()], 0.5)
    return found._replace(tau=threshold(plain.filter("held"), found, alarm))


def threshold(held: DataFrame, model: Model, alarm: float) -> float:
    """The least value, one half or more, that at most a share ``alarm`` of the unknown paragraphs ``held`` (terms, n) exceed."""
    best = let(scores(F.col("terms"), model), lambda s: F.array_max(F.slice(s, 1, len(FAMILIES))))
    reached = held.select(best.alias("p"), "n").filter("p is not null").groupBy("p").agg(F.sum("n").alias("n"))
    reached = materialise(reached, "reached")
    total, high = reached.agg(F.sum("n"), F.sum(F.when(F.col("p") > 0.5, F.col("n")))).first()
    if (high or 0) <= alarm * (total or 0):
        return 0.5
    above = running(reached.filter("p > 0.5"), [F.asc("p")], {"n": "upto"}, "at")
    return float(above.filter(high - F.col("upto") <= alarm * total).agg(F.min("p")).first()[0])


def scores(own: Column, model: Model) -> Column:
    """Class probabilities of a paragraph by its marks, unknown last; null where no mark has a weight."""
    classes = len(FAMILIES) + 1
    terms, weights = sql_array(model.terms, "string"), sql_array(model.weights, "double")
    intercepts = sql_array(model.intercepts, "double")
    places = F.filter(F.transform(own, lambda t: F.array_position(terms, t).cast("int")), lambda j: j > 0)

    def softmax(margins: Column) -> Column:
        raised = F.transform(margins, lambda m: F.exp(m - F.array_max(margins)))
        return let(raised, lambda r: F.transform(r, lambda v: v / F.aggregate(r, F.lit(0.0), lambda s, x: s + x)))

    def score(found: Column) -> Column:
        margins = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.aggregate(
            found, F.element_at(intercepts, k + 1), lambda s, j: s + F.element_at(weights, (j - 1) * classes + k + 1)))
        return F.when(F.size(found) > 0, let(margins, softmax))

    return let(places, score)


def scan_licences(docs: DataFrame, key: str = "doc_id", text: str = "text", overlap: float = 0.6, model: Model | None = None) -> DataFrame:
    """(key, n_paragraphs, n_licensed, families, paragraphs) for every row.

    ``paragraphs`` reads line:family, lines from 0, comma-joined; ``families`` lists each family once.
    """
    seen = marked(docs, key, text)
    if model is None:
        seen = materialise(seen, "marked")
        model = fit_marked(seen)
    names = F.array(*[F.lit(f) for f in FAMILIES])

    def family(own: Column) -> Column:
        def choose(p: Column) -> Column:
            best = F.array_max(F.slice(p, 1, len(FAMILIES)))
            return F.when(best >= model.tau, F.element_at(names, F.array_position(p, best).cast("int")))

        guess = let(scores(own, model), choose)
        return let(guess, lambda g: F.when(g.isNotNull(), F.when(confirmed(own, g, overlap), g)))

    judged = F.transform("found", lambda x: F.struct(x["line"], family(x["terms"]).alias("family")))
    out = seen.select(F.col(key), "n_paragraphs", F.filter(judged, lambda x: x["family"].isNotNull()).alias("_found"))
    return out.select(
        key, "n_paragraphs", F.size("_found").cast("long").alias("n_licensed"),
        F.array_join(F.array_sort(F.array_distinct(F.col("_found.family"))), ",").alias("families"),
        F.array_join(F.transform("_found", lambda x: F.concat_ws(":", x["line"].cast("string"), x["family"])), ",").alias("paragraphs"))
