"""Licence paragraphs: a trained n-gram classifier with an unknown class, confirmed by templates."""

from __future__ import annotations

import math
import re

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglode.llm.common import stored

UNKNOWN = "unknown"
FEATURES = 1 << 13
#: Share of a template's words a paragraph must hold.
MIN_OVERLAP = 0.6
#: Words of the windows over the joined lines of a block.
WINDOWS = (8, 16, 32, 64)
#: A line alone counts so many times as much as a window that holds as much of a template.
LONE = 1.5
LEAST_PROBABILITY = 0.5
#: Share of the held lines that may be taken for a family.
OUTLIERS = 0.005
#: Held lines are counted by steps of their log-odds, each a hundredth.
STEPS = 100

# The words by which licence families are granted.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GPL, version 2 or later.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "Licensed under the Mozilla Public License.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under CC BY-NC-SA 4.0.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Released under a Creative Commons Attribution-ShareAlike License.",
    ],
    "reserved": [
        "All rights reserved.",
        "Copyright 2020 the authors. All rights reserved.",
        "No part of this publication may be reproduced without prior written permission of the publisher.",
    ],
}
COMMON = "a all and any are as at be by except for following from in is it may met no not of on or part provided that the this to under use with without work you".split()
_WORD = re.compile(r"[^\W_]+")
NOT_LICENCES = [
    "He lost his driving licence last year.",
    "The driver must show a valid license to the police.",
    "Artistic license allows a poet to bend the rules.",
    "The software was released in the spring.",
    "The general public was not admitted.",
    "The Apache helicopter flew over the valley.",
    "Students at MIT built a small robot.",
    "The creative director left the commons room.",
    "This work is done under pressure and with no permission to rest.",
]


def terms(text: Column) -> Column:
    """Lower-cased words, runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _rarer() -> list[str]:
    """The templates' words without the common ones."""
    return sorted({w for _, t in _template_words() for w in t} - set(COMMON))


def _grams(words: Column) -> Column:
    """The rarer words of templates, and the pairs of neighbours that hold one, each once and sorted."""
    rarer = F.array(*map(F.lit, _rarer()))
    own = lambda w: F.array_contains(rarer, w)
    pairs = lambda w: F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.when(own(a) | own(b), F.concat(a, F.lit(" "), b)))
    both = F.transform(F.array(words), lambda w: F.concat(F.filter(w, own), F.filter(pairs(w), lambda g: g.isNotNull())))
    return F.array_sort(F.array_distinct(both[0]))


def _share_of(template: list[str]) -> int:
    """The fewest words of the template that are MIN_OVERLAP of it."""
    return -int(-MIN_OVERLAP * len(template) // 1)


def anchors() -> list[str]:
    """Words one of which any text must hold that holds MIN_OVERLAP of a template: all but so many of its words as may be absent, the common ones absent first."""
    out: set[str] = set()
    for template in _template_words():
        rare = sorted(template[1], key=lambda w: (w in COMMON, -len(w), w))
        out.update(rare[: len(rare) - _share_of(rare) + 1])
    return sorted(out)


def _blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, lines): the blocks between blank lines that hold an anchor, each line with its number (from 1) and its words.

    Lines without a letter or digit are blank, so comment marks alone are, too; marks in front of words fall away with
    all other signs. Blank lines are emptied and the others numbered before the text is split.
    """
    held = _one_of(anchors())
    docs = docs.select(F.col("`doc_id`"), F.lower("`text`").alias("text")).where(F.regexp_like("text", F.lit(held)))
    bare = lambda line: F.regexp_replace(line, r"^\s*(?:rem|dnl)(?:\s|$)", "")
    number = lambda line, at: F.when(F.regexp_like(line, F.lit(r"[\p{L}\p{N}]")), F.concat((at + 1).cast("string"), F.lit("\t"), line)).otherwise("")
    numbered = F.array_join(F.transform(F.transform(F.split("text", "\n"), bare), number), "\n")
    blocks = docs.select("doc_id", F.explode(F.split(numbered, "\n\n+")).alias("block")).where(F.regexp_like("block", F.lit(held)))
    line = lambda x: F.struct(F.split(x, "\t", 2)[0].cast("int").alias("no"), terms(F.split(x, "\t", 2)[1]).alias("words"))
    return blocks.select("doc_id", F.transform(F.filter(F.split("block", "\n"), lambda x: x != ""), line).alias("lines"))


def _rated(start: Column, words: Column, lone: bool) -> Column:
    """The unit with the template it holds most words of, and the largest share; null where it holds enough of none.

    In running text the rarer words count by themselves, too, and of a short grant three in four must be there."""
    held = F.transform(_template_array(), lambda t: F.struct(F.size(F.array_intersect(t["words"], words)).alias("n"), t["family"].alias("family"), t["words"].alias("template")))
    share = lambda t: t["n"] * 100 / F.size(t["template"])
    rare = lambda t: F.array_except(t["template"], F.array(*map(F.lit, COMMON)))
    most = lambda t: F.size(F.array_intersect(rare(t), words)) * 100 >= F.size(rare(t)) * F.when(F.size(t["template"]) >= 10, 100 * MIN_OVERLAP).otherwise(75)
    enough = lambda t: (share(t) >= 100 * MIN_OVERLAP) & (F.lit(True) if lone else most(t))
    held = F.transform(F.filter(held, enough), lambda t: F.struct((t["n"] * share(t) * (LONE if lone else 1.0)).alias("rank"), t["family"].alias("family"), t["template"].alias("template")))
    unit = lambda t: F.struct(t["family"].alias("family"), start.alias("start"), (start + F.size(words)).alias("end"), t["rank"].alias("rank"), t["template"].alias("template"), words.alias("words"), F.lit(lone).alias("lone"))
    return F.get(F.transform(F.slice(F.sort_array(held, asc=False), 1, 1), unit), F.lit(0))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, words, near, nearest) for every run of words of docs (doc_id, text, ...) that holds MIN_OVERLAP of a template.

    Looked at are the lines, and over the joined lines of each block word windows of the sizes WINDOWS, a quarter of
    their size apart, so a licence may be wrapped, or stand inside a long line. Of runs that share words and are nearest
    to the same family, the one that holds the most of a template stays; a line alone is preferred to a window around
    it, unless it is only a piece of the wrapped text. words are the run's without what is before and after the
    template, near are all of them, line_no is where it begins; nearest is the family of a window, null for a line.
    """
    once = lambda c: F.explode(F.array(c))  # noqa: E731  a generator's result is not computed again where it is used
    at = _blocks(docs).select("doc_id", once(F.col("lines")).alias("lines"))
    at = at.select("doc_id", "lines", once(F.flatten(F.transform("lines", lambda x: F.transform(x["words"], lambda w: F.struct(w.alias("w"), x["no"].alias("no")))))).alias("ends"))
    wanted = F.array(*map(F.lit, anchors()))
    spots = F.filter(F.transform("ends", lambda x, i: F.when(F.array_contains(wanted, x["w"]), i)), lambda i: i.isNotNull())
    at = at.select("doc_id", "lines", "ends", once(F.struct(F.col("ends")["w"].alias("all"), spots.alias("spots"))).alias("x")).select("doc_id", "lines", "ends", "x.*")
    # In running text a template takes two of its rarer words at least.
    rarer = F.array(*map(F.lit, _rarer()))
    two = lambda s, size: F.size(F.array_intersect(rarer, F.slice("all", s + 1, size))) >= 2
    # starts are counted from 0
    over = lambda size: F.transform(F.filter(_starts(size), lambda s: two(s, size)), lambda s: _rated(s, F.slice("all", s + 1, size), False))
    windows = [over(size) for size in WINDOWS]
    first = lambda no: F.array_position(F.col("ends")["no"], no).cast("int") - 1
    lone = F.transform(F.filter("lines", lambda x: F.arrays_overlap(x["words"], wanted)), lambda x: _rated(first(x["no"]), x["words"], True))
    units = F.array_sort(F.filter(F.concat(lone, *windows), lambda u: u.isNotNull()))
    at = at.select("doc_id", "ends", once(units).alias("units"))
    kept = F.aggregate("units", F.slice("units", 1, 0), _settled)
    at = at.select("doc_id", "ends", F.explode(kept).alias("u"))
    rare = F.array(*map(F.lit, COMMON))
    marks = F.filter(F.transform(F.col("u")["words"], lambda w, i: F.when(F.array_contains(F.col("u")["template"], w) & ~F.array_contains(rare, w), i)), lambda i: i.isNotNull())
    at = at.select("*", F.coalesce(F.array_min(marks), F.lit(0)).alias("from"), F.coalesce(F.array_max(marks), F.size("u.words") - 1).alias("to"))
    tight = F.slice(F.col("u")["words"], F.col("from") + 1, F.col("to") - F.col("from") + 1)
    line_no = F.element_at("ends", F.col("u")["start"] + F.when(F.col("u")["lone"], 0).otherwise(F.col("from")) + 1)["no"]
    return at.select("doc_id", line_no.alias("line_no"), F.when(F.col("u")["lone"], F.col("u")["words"]).otherwise(tight).alias("words"), F.col("u")["words"].alias("near"), F.when(~F.col("u")["lone"], F.col("u")["family"]).alias("nearest"))


def _starts(size: int) -> Column:
    """Where the windows of that size begin that hold an anchor."""
    step = size // 4
    grid = F.flatten(F.transform("spots", lambda p: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: (F.floor(p / step).cast("int") - j) * step)))
    return F.filter(F.array_distinct(grid), lambda s: s >= 0)


def _settled(kept: Column, unit: Column) -> Column:
    """The units kept so far with one more, in the order of families and starts."""
    last = F.get(kept, F.size(kept) - 1)
    apart = F.size(kept).eqNullSafe(0) | (last["family"] != unit["family"]) | (last["end"] <= unit["start"])
    better = F.struct(unit["rank"], -F.size(unit["words"])) > F.struct(last["rank"], -F.size(last["words"]))
    swapped = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(unit))
    return F.when(apart, F.concat(kept, F.array(unit))).when(better, swapped).otherwise(kept)


def _values(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Constant rows (family, text) without a look at Python when they are read."""
    made = [F.struct(F.lit(f).alias("family"), F.lit(t).alias("text")) for f, t in rows]
    return spark.range(1).select(F.inline(F.array(*made)))


def templates(spark: SparkSession) -> DataFrame:
    return _values(spark, [(f, t) for f, texts in TEMPLATES.items() for t in texts]).select("family", terms(F.col("text")).alias("words"))


def _one_of(words: list[str]) -> str:
    """The pattern of a lower-cased text that holds one of the words."""
    return r"(?:^|[^\p{L}\p{N}])(?:" + "|".join(words) + r")(?![\p{L}\p{N}])"


def plain_lines(docs: DataFrame, touching: bool = False) -> DataFrame:
    """(words): all lines of all texts that hold a word, without those that may be licences.

    Left out are lines with a licence word or name, also in other languages, and lines that hold MIN_OVERLAP of a template.
    touching: only lines with a rarer word of a template; the others have no grams.
    """
    named = r"\b(?:MIT|L?GPL|GNU|BSD|MPL|CC[ -]BY|Apache|Mozilla)(?![\p{L}\p{N}])|(?i)\bGPL|\(c\)\s*\d{4}|©|droits r|rechte vorbehalten|derechos reservados|direitos reservados|diritti riservati"
    marked = r"(?i)licen|copyright|reserved|spdx|commons|permission|redistribut"
    texts = docs.select(F.col("`text`").alias("text"))
    if touching:
        texts = texts.where(F.regexp_like(F.lower("text"), F.lit(_one_of(_rarer()))))
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line"))
    if touching:
        lines = lines.where(F.regexp_like(F.lower("line"), F.lit(_one_of(_rarer()))))
    lines = lines.where(~F.regexp_like("line", F.lit(marked)) & ~F.regexp_like("line", F.lit(named)))
    # a generator's result is not computed again where it is used
    words = lines.select(F.explode(F.array(terms(F.col("line")))).alias("words")).where(F.size("words") > 0)
    return words.where(~F.exists(_template_array(), lambda t: _share(t["words"], F.col("words")) >= int(100 * MIN_OVERLAP)))


#: The former name.
sample_lines = plain_lines


def thresholds(found: list[tuple], held: int, families: int) -> list[float]:
    """The probability from which each family (labels from 1) is believed, given what the held lines were taken for.

    found: (label, probability) or (label, probability, number of lines). All but OUTLIERS of the held lines, one at
    least, must stay below the threshold."""
    out = []
    for label in range(1, families + 1):
        spare, least = max(1, int(OUTLIERS * held)), LEAST_PROBABILITY
        for _, p, *n in sorted((x for x in found if x[0] == label), key=lambda x: -x[1]):
            spare -= n[0] if n else 1
            if spare < 0:
                least = max(least, p + 1e-6)
                break
        out.append(least)
    return out


def fit(docs: DataFrame) -> tuple[PipelineModel, list[str], list[float]]:
    """The classifier, its families by label, and the probability from which each known family is believed.

    Templates teach the families. The unknown class is taught by all lines of the corpus that are no licence
    (`plain_lines`), together with sentences that only sound alike. Lines are told apart by their grams (`_grams`), so
    those without a word of a template are one. By the hash of their grams one half of them teaches, and the other
    calibrates the thresholds, for each family by a quantile (`thresholds`).

    What reaches the driver are counts: lines by class, and held lines by family and step of their log-odds.
    """
    spark = docs.sparkSession
    families = [UNKNOWN, *sorted(TEMPLATES)]
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    lines = plain_lines(docs, touching=True).select(_grams(F.col("words")).alias("grams")).distinct().sortWithinPartitions("grams")
    lines = stored(lines.select("grams", (F.pmod(F.xxhash64("grams"), F.lit(2)) == 0).alias("held")))
    other = _values(spark, [(UNKNOWN, t) for t in [*NOT_LICENCES, ""]]).select("family", terms(F.col("text")).alias("words"))
    fixed = templates(spark).union(other).select("family", _grams(F.col("words")).alias("grams"))
    sizes = {bool(r.held): r["count"] for r in lines.groupBy("held").count().collect()}
    of_unknown = len(NOT_LICENCES) + 1 + sizes.get(False, 0)
    share = F.when(F.col("family") == UNKNOWN, F.lit(of_unknown))
    for family, texts in TEMPLATES.items():
        share = share.when(F.col("family") == family, F.lit(len(texts)))
    rows = fixed.union(lines.where("NOT held").select(F.lit(UNKNOWN).alias("family"), "grams"))
    rows = rows.select("grams", label.alias("label"), (1.0 / share).alias("weight"))
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True)
    logistic = LogisticRegression(family="multinomial", maxIter=40, regParam=1e-4, weightCol="weight", standardization=False, predictionCol="", rawPredictionCol="")
    model = PipelineModel([hashing, logistic.fit(hashing.transform(rows))])
    # Probabilities are rounded up to whole steps, so no held line counts for less than it got.
    step = F.ceil(STEPS * F.log(F.col("p") / (1 - F.col("p"))))
    taken = _classified(model, lines.where("held").select("grams"), [LEAST_PROBABILITY] * len(TEMPLATES))
    taken = taken.select("label", F.when(F.col("p") < 1, F.least(step, F.lit(40 * STEPS))).otherwise(40 * STEPS).alias("step"))
    found = [(r.label, 1 / (1 + math.exp(-r.step / STEPS)), r["count"]) for r in taken.groupBy("label", "step").count().collect()]
    return model, families, thresholds(found, sizes.get(True, 0), len(TEMPLATES))


def _classified(model: PipelineModel, rows: DataFrame, least: list[float]) -> DataFrame:
    """Rows (grams, ...) whose most likely family is known and reaches its threshold, with its label and probability p.

    One generator per row reads the probabilities once; as a filter the model would run once per mention of its result.
    """
    out = model.transform(rows)
    best = F.transform(F.array(vector_to_array("probability")), lambda v: F.struct(F.array_max(v).alias("p"), (F.array_position(v, F.array_max(v)) - 1).cast("int").alias("label")))
    best = F.filter(best, lambda b: (b["label"] > 0) & (b["p"] >= F.get(F.array(*map(F.lit, least)), b["label"] - 1)))
    return out.select(*rows.columns, F.inline(best))


def licence_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, family, overlap) for every paragraph of docs (doc_id, text, ...) that grants or reserves rights.

    What holds MIN_OVERLAP of the words of a template, on a line or wrapped over several (`paragraphs`), goes as hashed
    single words and pairs that hold a rarer word of a template through a multinomial logistic regression over the families and an unknown class (`fit`). The
    family it names must be one whose template is held; overlap is the largest such share, in percent, and line_no the
    line where the paragraph begins.

    Built-in functions and the JVM's models only. Every text is judged where it is read; what is shuffled are the grams of
    the lines that teach, which all lines with a rarer word of a template do. Texts without any of the templates' rarer words, one of
    which every licence holds that can be confirmed, are passed over.

    Defined cases: a null or empty text has no paragraphs; a null doc_id is carried; repeated rows give repeated rows;
    an empty table gives no rows; other columns are ignored.
    """
    model, families, least = fit(docs)
    found = _classified(model, paragraphs(docs).withColumn("grams", _grams(F.col("words"))), least)
    named = F.element_at(F.array(*map(F.lit, families)), F.col("label") + 1)
    out = found.select("doc_id", "line_no", named.alias("family"), "near", "nearest").where("family = coalesce(nearest, family)")
    best = F.array_max(F.transform(F.filter(_template_array(), lambda t: t["family"] == F.col("family")), lambda t: _share(t["words"], F.col("near"))))
    return out.select("doc_id", "line_no", "family", best.alias("overlap")).where(F.col("overlap") >= int(100 * MIN_OVERLAP))


def _template_words() -> list[tuple[str, list[str]]]:
    return [(family, list(dict.fromkeys(_WORD.findall(t.lower())))) for family, texts in TEMPLATES.items() for t in texts]


def _template_array() -> Column:
    return F.array(*[F.struct(F.lit(f).alias("family"), F.array(*map(F.lit, words)).alias("words")) for f, words in _template_words()])


def _share(template: Column, words: Column) -> Column:
    return F.floor(F.size(F.array_intersect(template, words)) * 100 / F.size(template)).cast("long")
