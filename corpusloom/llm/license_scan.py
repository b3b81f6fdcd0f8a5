"""Licence scans: a trained paragraph classifier, confirmed against templates. DataFrame operations only.

Training examples are made from the templates of each licence family: whole, with words
left out, and with foreign words around them. Licence sentences with made-up names form the
class `unknown`, paragraphs of the corpus the class `none`. The features are the word
1- to 3-grams of the licence examples that hold a cue: a word that names a licence, or a
licence word that paragraphs of the corpus hardly ever hold. A multinomial logistic regression is fitted to these sparse
features; its weights become a table that paragraphs are joined with.

Cues are counted over all distinct lines of the corpus that aren't known licence lines. The
words that name a licence are cues however common, and each template keeps so many of its
rarest words that no line without a cue can hold LEAST_OVERLAP of it.

A line without a cue has no feature, so only lines with a cue are scored. A paragraph is a
line, or a window of consecutive lines for notices that are wrapped. A window begins at a
line with a cue and goes on to a blank line, or until it has as many words as the longest template.
A template that it holds enough of ends it at the last line that adds to that; only templates count that neither
the first line nor the others hold as much of, and of these the one with most word pairs. Of the windows of
a document that share lines the one with the largest overlap counts, then the first. Lines inside it
aren't reported again, but for other families' own notices. A predicted family must reach the probability
that all but a few of its own held-back examples reach, and the paragraph must hold
enough of one of the family's templates, and of no other family's more; otherwise it counts
as `unknown`.

Defined results: null and empty texts have no paragraph; lines are taken whole, of any length; repeated rows
give repeated findings; of equal probabilities the first family by name counts; with an
empty table the result is empty; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import shared_table

# FIXED VALUES: short public notices of well-known licence families.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except "
                   "in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD", "Licensed under the BSD 3-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
            "following disclaimer."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
            "following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
            "(at your option) any later version."),
    ("GPL", "You should have received a copy of the GNU General Public License along with this program."),
    ("GPL", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the Software), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("public-domain", "To the extent possible under law, the author has waived all copyright and related rights to "
                      "this work under CC0 1.0."),
    ("reserved", "All rights reserved."),
    ("reserved", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited."),
)
MADE_UP = ("Licensed under the {} License, Version {}.", "Released under the {} License.",
           "This work is licensed under the {} Public License, version {}.",
           "Distributed under the terms of the {} licence {}.", "SPDX-License-Identifier: {}-{}")

# FIXED VALUES: words that licence texts are known by, cues however often the corpus holds them.
LICENCE_WORDS = ("copying", "copyright", "licence", "license", "licensed", "redistribute", "redistribution",
                 "software", "spdx")

VARIANTS = 12           # examples per template; every fourth is held back for calibration
MADE_UP_NAMES = 24      # per made-up sentence
SAMPLE_DOCS = 400       # documents the class none is drawn from, at most
SAMPLE_LINES = 600      # their paragraphs, at most
CUE_SHARE = 0.005       # other cues occur in at most this share of the corpus's distinct lines
LEFT_OUT = 12           # per cent of an example's words
STEPS = 60
PENALTY = 1e-4
KEPT_SHARE = 0.02       # of a family's held-back examples may fall under its least probability
LEAST_OVERLAP = 0.6     # of a template's word pairs


def words_of(text: Column) -> Column:
    """Lower-case ASCII words."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^0-9a-z]+"), "")


def grams(words: Column) -> Column:
    """Distinct word 1-, 2- and 3-grams."""
    def run(n):
        size = F.size(words)
        at = F.when(size >= n, F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))).otherwise(
            F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.array_distinct(F.concat(words, run(2), run(3)))


def word_pairs(words: Column) -> Column:
    """Distinct word pairs; a single word stands for itself."""
    size = F.size(words)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))),
                        lambda i: F.array_join(F.slice(words, i, 2), " "))
    return F.array_distinct(pairs)


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, family, words)."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(f).alias("family"), F.lit(t).alias("text"))
                     for i, (f, t) in enumerate(templates)])
    return spark.range(1).select(F.explode(rows).alias("t")).select(
        "t.template", "t.family", words_of(F.col("t.text")).alias("words"))


def pairs_of(text: str) -> list[str]:
    """The distinct word pairs of a template, sorted."""
    words = re.findall("[0-9a-z]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])} or set(words))


def template_pairs(templates) -> Column:
    """A constant array of (family, word pairs, words, few) of the templates.

    few: the distinct words that half of the pairs have at least.
    """
    rows = []
    for family, text in templates:
        pairs = pairs_of(text)
        words = sorted(set(" ".join(pairs).split()))
        # pairs without a circle have one word more than there are pairs
        circles = max(len(pairs) - len(words) + 1, 0)
        rows.append({"family": family, "pairs": pairs, "words": words,
                     "few": max((len(pairs) + 1) // 2 + 1 - circles, 1)})
    return F.from_json(F.lit(json.dumps(rows)),
                       "array<struct<family:string,pairs:array<string>,words:array<string>,few:int>>")


def licence_vocabulary(templates) -> list[str]:
    """The words of the templates and of the made-up sentences."""
    return sorted(set(re.findall("[0-9a-z]+", " ".join([t for _, t in templates] + list(MADE_UP)).lower())))


def known_line(words: Column, hits: Column, templates) -> Column:
    """Whether a line holds half of a template; ``hits`` are its licence words."""
    return F.exists(template_pairs(templates), lambda t: (F.size(F.array_intersect(t["words"], hits)) >= t["few"]) & (
        F.size(F.array_intersect(t["pairs"], word_pairs(words))) >= 0.5 * F.size(t["pairs"])))


def with_hits(docs: DataFrame, templates) -> DataFrame:
    """(words, hits) of every line that has words: all its words, and those that licence texts have."""
    vocabulary = F.array(*[F.lit(w) for w in licence_vocabulary(templates)])
    lines = docs.select(F.explode(F.transform(F.split("text", "\n"), words_of)).alias("words")).where(F.size("words") > 0)
    # exploded, so that later lambdas read the hits and don't work them out again for every template
    return lines.select("words", F.explode(F.array(F.array_intersect("words", vocabulary))).alias("hits"))


def cue_counts(docs: DataFrame, templates) -> dict[str, int]:
    """Distinct lines of the whole corpus that hold each licence word; under the empty word, all of them.

    Lines are told apart by the hash of their words; known licence lines don't count.
    """
    lines = with_hits(docs, templates).select(F.xxhash64("words").alias("line"), "hits", known_line(
        F.col("words"), F.col("hits"), templates).alias("known"))
    once = lines.where(~F.col("known")).groupBy("line").agg(F.first("hits").alias("hits"))
    counts = once.select(F.explode(F.concat("hits", F.array(F.lit("")))).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in counts.collect()}    # words of the templates: a fixed, small list


def choose_cues(counts: dict[str, int], templates) -> list[str]:
    """The cues: words that name a licence, rare words, and of each template as many of the rarest as it needs."""
    vocabulary = licence_vocabulary(templates)
    most = CUE_SHARE * counts.get("", 0)
    cues = {w for w in vocabulary if w in LICENCE_WORDS or (len(w) > 1 and counts.get(w, 0) <= most)}
    for _, text in templates:
        pairs = [p.split() for p in pairs_of(text)]
        rest = sorted({w for p in pairs for w in p} - cues, key=lambda w: (len(w) == 1, counts.get(w, 0), w))
        # a line without a cue holds none of the pairs that have one
        while rest and sum(cues.isdisjoint(p) for p in pairs) >= LEAST_OVERLAP * len(pairs):
            cues.add(rest.pop(0))
    return sorted(cues)


def cue_lines(docs: DataFrame, cues: list[str], most: int) -> DataFrame:
    """(row, doc_id, paragraph, words, lines, later) of every line with a cue.

    lines: the line itself and those after it, up to a blank one or until they have ``most`` words;
    later: the words of those after it.
    """
    cue = F.array(*[F.lit(c) for c in cues]) if cues else F.array().cast("array<string>")
    split = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.split("text", "\n").alias("all"))
    marked = F.filter(F.transform("all", lambda x, i: F.struct(i.alias("paragraph"), words_of(x).alias("words"))),
                      lambda s: F.arrays_overlap(s["words"], cue))

    def follow(state, line):
        words = words_of(line)
        go_on = state["open"] & (F.trim(line) != "")
        return F.when(go_on, F.struct(
            F.concat(state["later"], F.array(words)).alias("later"), (state["n"] + F.size(words)).alias("n"),
            (state["n"] + F.size(words) < most).alias("open"))).otherwise(
            F.struct(state["later"].alias("later"), state["n"].alias("n"), F.lit(False).alias("open")))

    # a line that goes on has a word or is a row of signs; a window has at most as many lines as the longest template words
    start = F.struct(F.array().cast("array<array<string>>").alias("later"), F.lit(0).alias("n"), F.lit(True).alias("open"))
    with_later = F.transform(marked, lambda s: F.struct(
        s["paragraph"].alias("paragraph"), s["words"].alias("words"),
        F.when(F.size(s["words"]) < most, F.aggregate(
            F.slice(F.col("all"), s["paragraph"] + 2, most), start, follow)["later"]).otherwise(
            F.array().cast("array<array<string>>")).alias("later")))
    with_lines = F.transform(with_later, lambda s: F.struct(
        s["paragraph"].alias("paragraph"), s["words"].alias("words"), s["later"].alias("later"),
        F.slice(F.col("all"), s["paragraph"] + 1, F.size(s["later"]) + 1).alias("lines")))
    return split.select("row", "doc_id", F.explode(with_lines).alias("s")).select("row", "doc_id", "s.*")


@dataclass
class LicenseModel:
    """Classes, cues, and tables: weights (gram, w array by class), least probability per class, templates."""
    classes: list[str]
    cues: list[str]
    weights: DataFrame
    least: DataFrame
    templates: tuple[tuple[str, str], ...]


def training_examples(docs: DataFrame, templates) -> DataFrame:
    """(example, label, held_back, words): made from templates, made-up names and corpus paragraphs."""
    # ids are picked first: at most SAMPLE_DOCS of them
    picked = (docs.where("doc_id is not null and text is not null").select("doc_id")
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS))
    some = docs.where("text is not null").join(F.broadcast(picked), "doc_id", "left_semi")
    # lines that hold much of a template aren't examples of the class none; of equal lines one is drawn
    lines = (with_hits(some, templates).where(~known_line(F.col("words"), F.col("hits"), templates))
             .select(F.slice("words", 1, 60).alias("words")).distinct()
             .orderBy(F.xxhash64("words"), "words").limit(SAMPLE_LINES)
             .select("words", (F.row_number().over(W.orderBy(F.xxhash64("words"), "words")) - 1).alias("line")))
    lines = shared_table(lines, "licence-lines")
    n = max(lines.count(), 1)

    def draw(*keys):
        return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")

    spark = docs.sparkSession
    variants = template_table(spark, templates).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("variant"))
    thinned = F.filter("words", lambda w, i: (F.col("variant") < 2) | (
        F.pmod(F.xxhash64(F.col("template"), F.col("variant"), i), F.lit(100)) >= LEFT_OUT))
    before = F.when(F.col("variant") % 3 == 0, F.array().cast("array<string>")).otherwise(
        F.coalesce(F.slice("around", 1, 4), F.array().cast("array<string>")))
    after = F.when(F.col("variant") % 2 == 0, F.array().cast("array<string>")).otherwise(
        F.coalesce(F.slice("around", 5, 6), F.array().cast("array<string>")))
    positive = (variants.withColumn("line", draw(F.col("template"), F.col("variant")))
                .join(F.broadcast(lines.withColumnRenamed("words", "around")), "line", "left")
                .select(F.concat_ws("-", F.lit("t"), "template", "variant").alias("example"),
                        F.col("family").alias("label"), (F.col("variant") % 4 == 3).alias("held_back"),
                        F.concat(before, thinned, after).alias("words")))
    shapes = F.array(*[F.struct(F.lit(i).alias("shape"), F.lit(s).alias("text")) for i, s in enumerate(MADE_UP)])
    made_up = (spark.range(MADE_UP_NAMES).select(F.col("id").cast("int").alias("name"), F.explode(shapes).alias("s"))
               .withColumn("line", draw(F.col("name"), F.col("s.shape"), F.lit("name")))
               .join(F.broadcast(lines), "line", "left")
               .withColumn("title", F.concat_ws(" ", F.slice(F.coalesce("words", F.array(F.lit("acme"))),
                                                             1 + F.col("name") % 3, 1 + F.col("name") % 2)))
               .select(F.concat_ws("-", F.lit("u"), "name", "s.shape").alias("example"),
                       F.lit("unknown").alias("label"), (F.col("name") % 4 == 3).alias("held_back"),
                       words_of(F.regexp_replace(F.regexp_replace("s.text", r"\{\}(?=.*\{\})|\{\}(?!.*\{\}|.*Version|.*version)",
                                                                  F.col("title")), r"\{\}",
                                                 (1 + F.col("name") % 5).cast("string"))).alias("words")))
    none = lines.select(F.concat_ws("-", F.lit("n"), "line").alias("example"), F.lit("none").alias("label"),
                        (F.col("line") % 4 == 3).alias("held_back"), "words")
    return positive.union(made_up).union(none)


def cue_grams(words: Column, cues: list[str]) -> Column:
    """The n-grams of a word array that hold a cue."""
    cue = F.array(*[F.lit(c) for c in cues]) if cues else F.array().cast("array<string>")
    return F.filter(grams(words), lambda g: F.arrays_overlap(F.split(g, " "), cue))


def train(examples: DataFrame, classes: list[str], cues: list[str]) -> DataFrame:
    """(gram, w): weights by class, the bias under the empty gram.

    Classes of few examples weigh more, by the square root of their number.
    """
    spark = examples.sparkSession
    fit = examples.where(~F.col("held_back"))
    share = fit.groupBy("label").agg((1 / F.sqrt(F.count("*"))).alias("importance"))
    number = F.array(*[F.lit(c) for c in classes])
    x = shared_table(fit.join(F.broadcast(share), "label").select(
        cue_grams(F.col("words"), cues).alias("grams"), "importance",
        (F.array_position(number, F.col("label")) - 1).cast("double").alias("y")), "licence-features")
    counter = CountVectorizer(inputCol="grams", outputCol="x", binary=True, vocabSize=1 << 16).fit(x)
    fitted = LogisticRegression(featuresCol="x", labelCol="y", weightCol="importance", family="multinomial",
                                regParam=PENALTY, maxIter=STEPS, standardization=False).fit(counter.transform(x))
    table = fitted.coefficientMatrix
    column = [[float(table[i, j]) for i in range(table.numRows)] for j in range(table.numCols)]
    bias = [float(v) for v in fitted.interceptVector]
    # classes times grams of the templates: a fixed, small table
    rows = json.dumps([{"gram": g, "w": w} for g, w in zip(counter.vocabulary, column)] + [{"gram": "", "w": bias}])
    return shared_table(spark.range(1).select(F.explode(F.from_json(
        F.lit(rows), "array<struct<gram:string,w:array<double>>>")).alias("r")).select("r.gram", "r.w"),
        "licence-weights")


def class_scores(lines: DataFrame, key: list[str], weights: DataFrame, classes: list[str], cues: list[str]) -> DataFrame:
    """Key columns, class and probability of the likeliest class of each row; ``words`` holds its words."""
    x = lines.select(*key, F.explode(F.concat(cue_grams(F.col("words"), cues), F.array(F.lit("")))).alias("gram"))
    # the weights' grams come from the templates: a fixed, small table
    scores = (x.join(F.broadcast(weights), "gram").groupBy(*key)
              .agg(*[F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(len(classes))]))
    top = F.greatest(*[f"s{i}" for i in range(len(classes))])
    raised = [F.exp(F.col(f"s{i}") - top) for i in range(len(classes))]
    whole = sum(raised[1:], raised[0])
    pick = F.coalesce(*[F.when(F.col(f"s{i}") == top, F.lit(c)) for i, c in enumerate(classes)])
    return scores.select(*key, pick.alias("label"), (1 / whole).alias("probability"))


def fit_licenses(docs: DataFrame, templates=TEMPLATES) -> LicenseModel:
    """Train on the templates and on paragraphs of at most SAMPLE_DOCS documents; cues come from all of them."""
    docs = docs.select("doc_id", "text")
    examples = shared_table(training_examples(docs, templates), "licence-examples")
    classes = sorted({f for f, _ in templates}) + ["none", "unknown"]
    cues = choose_cues(cue_counts(docs, templates), templates)
    weights = train(examples, classes, cues)
    marked = examples.where("held_back").select("example", F.col("label").alias("truth"), "words")
    scored = class_scores(marked, ["example", "truth"], weights, classes, cues)
    least = (scored.where("label = truth").groupBy("label")
             .agg(F.percentile_approx("probability", KEPT_SHARE, 10_000).alias("least")))
    return LicenseModel(classes, cues, weights, shared_table(least, "licence-least"), tuple(templates))


def judged(found: DataFrame, model: LicenseModel) -> DataFrame:
    """Scored rows with overlap, and ``sure``: whether their label's family is confirmed by its templates."""
    templates = template_pairs(model.templates)
    pairs = word_pairs(F.col("words"))

    def best(of_label):
        chosen = F.filter(templates, lambda t: (t["family"] == F.col("label")) == F.lit(of_label))
        return F.coalesce(F.array_max(F.transform(chosen, lambda t: F.size(F.array_intersect(t["pairs"], pairs))
                                                  / F.size(t["pairs"]))), F.lit(0.0))

    # at most one row per family
    return (found.join(F.broadcast(model.least), "label", "left")
            .withColumn("overlap", best(True)).withColumn("other", best(False))
            .withColumn("sure", (F.col("probability") >= F.coalesce("least", F.lit(0.0))) & (F.col("label") != "unknown")
                        & (F.col("overlap") >= LEAST_OVERLAP) & (F.col("overlap") >= F.col("other"))))


def windows_of(lines: DataFrame, templates) -> DataFrame:
    """(row, line, doc_id, paragraph, last, text, words) of the windows that hold enough of a template.

    A template's window ends where it holds most. Only templates count that the window's first line alone, and its
    other lines, hold less of.
    """
    def held(pairs, words):
        return F.size(F.array_intersect(pairs, word_pairs(words)))

    whole = F.concat(F.col("words"), F.flatten("later"))
    counted = F.transform(template_pairs(templates), lambda t, i: F.struct(
        held(t["pairs"], whole).alias("n"), (-i).alias("order"), t["pairs"].alias("pairs")))
    enough = F.filter(counted, lambda c: (c["n"] >= LEAST_OVERLAP * F.size(c["pairs"])) & (
        held(c["pairs"], F.col("words")) < c["n"]))

    def upto(m):
        return F.flatten(F.slice("later", 1, m))

    # the least number of later lines that hold as much
    ended = F.transform(enough, lambda c: F.struct(c["n"].alias("n"), c["order"].alias("order"), F.array_min(F.transform(
        F.sequence(F.lit(1), F.size("later")), lambda m: F.struct(
            (-held(c["pairs"], F.concat(F.col("words"), upto(m)))).alias("n"), m.alias("m"))))["m"].alias("m"),
        c["pairs"].alias("pairs")))
    begun = F.filter(ended, lambda c: held(c["pairs"], upto(c["m"])) < c["n"])
    return (lines.where(F.size("later") > 0)
            .select("*", F.explode(F.slice(F.sort_array(begun, asc=False), 1, 1)).alias("t"))
            .select("*", F.col("t.m").alias("m"))
            .select("row", "line", "doc_id", "paragraph", (F.col("paragraph") + F.col("m")).alias("last"),
                    F.array_join(F.slice("lines", 1, F.col("m") + 1), "\n").alias("text"),
                    F.concat(F.col("words"), upto(F.col("m"))).alias("words")))


def without_shared_lines(windows: DataFrame) -> DataFrame:
    """(row, kept): each document's windows, the largest overlap first, without those that share lines with an earlier one."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("overlap")).alias("order"), "paragraph", "last", "doc_id", "text",
                                                   "label", "probability", "overlap")))

    def add(kept, w):
        return F.when(F.exists(kept, lambda v: (v["paragraph"] <= w["last"]) & (w["paragraph"] <= v["last"])), kept
                      ).otherwise(F.concat(kept, F.array(w)))

    # the confirmed notices of one document: a bounded group
    return windows.groupBy("row").agg(ordered.alias("found")).select(
        "row", F.aggregate("found", F.filter("found", lambda _: F.lit(False)), add).alias("kept"))


def find_licenses(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """(doc_id, paragraph, last, text, family, probability, overlap) of every licence paragraph.

    paragraph, last: numbers of its first and last line. family is `unknown` for a licence line that
    matches no family surely enough.
    """
    longest = max(len(re.findall("[0-9a-z]+", t.lower())) for _, t in model.templates)
    lines = shared_table(cue_lines(docs.select("doc_id", "text"), model.cues, longest)
                         .withColumn("line", F.monotonically_increasing_id()), "licence-candidates")
    alone = lines.select("row", "line", "doc_id", "paragraph", F.col("paragraph").alias("last"),
                         F.col("lines")[0].alias("text"), "words")
    windows = shared_table(windows_of(lines, model.templates), "licence-windows")

    def scored(some):
        marks = class_scores(some, ["line"], model.weights, model.classes, model.cues).where("label <> 'none'")
        return judged(some.join(marks, "line"), model)

    kept = shared_table(without_shared_lines(scored(windows).where("sure")), "licence-kept")
    inside = F.exists(F.coalesce("kept", F.array().cast(kept.schema["kept"].dataType)), lambda w: F.col("paragraph").between(
        w["paragraph"], w["last"]) & (~F.col("sure") | (w["label"] == F.col("label"))))
    out = ("doc_id", "paragraph", "last", "text", "label", "probability", "overlap")
    single = scored(alone).join(kept, "row", "left").where(~inside).withColumn(
        "label", F.when(F.col("sure"), F.col("label")).otherwise("unknown"))
    wrapped = kept.select(F.explode("kept").alias("w")).select("w.*")
    return single.select(*out).union(wrapped.select(*out)).withColumnRenamed("label", "family")
