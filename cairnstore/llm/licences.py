"""Licence scan: a trained paragraph classifier, scored with DataFrame functions only.

A sparse multinomial logistic regression over the presence of word n-grams (1 to 3 words) tells licence families
and ordinary text apart. It is fitted on the driver from the fixed notices below and from perturbed copies of them
(words dropped, cut short, set in other words), with an L1 penalty, so its vocabulary is a few hundred n-grams.
The least probability at which a family is named is calibrated on wordings that were not fitted (`UNSEEN`, perturbed
too) and on other ordinary sentences: it is the one that parts right from wrong family names best. A paragraph (a line, or a window of at most `WINDOW` lines in a
row that all have words, as notices are wrapped) that is a licence rather than ordinary text, but reaches no family's calibrated probability, or that no notice of the family confirms, is `unknown`.
Confirmation: the share of a notice's 2-word grams that stand in the paragraph, `CONFIRM` at least.

Of windows and lines of a document that overlap, those that are named go before the unknown, then the one that ends
first stays, the shortest of these: so a line that is named by itself always stays. A window's number is that of its
first line.

Scoring explodes the words of every whole text, keeps those that open a gram of the vocabulary (a bounded set),
looks the grams up and gathers each line's distinct grams, those that reach into a next line apart: the vocabulary
bounds a group's size. Windows put the grams of their lines together.

Defined results: null and blank texts have no paragraphs; rows of one doc_id and one text are one, rows of one doc_id
and different texts are read each by itself; ids may be null; of families that are equally likely the one that comes
first in `NOTICES` is taken; a line of any length is one paragraph; other columns do not matter.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONFIRM = 0.6
WINDOW = 6
WORD = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
NONE = "none"
ROUNDS, PENALTY = 150, 2e-3

# Customary notices of licence families.
NOTICES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at apache.org licenses LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GNU GPL version 2 or later.",
        "Licensed under GPLv3.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPL version 3.",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL version 3.",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work. Creative Commons Zero",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
    ],
}
# Ordinary sentences with words that notices use too.
ORDINARY = [
    "The driver showed a license and the officer took a copy of it.",
    "Permission to enter the garden was given to any person with a ticket.",
    "The work was released in spring and the public liked the version of the second author.",
    "Free tickets are subject to the terms of the house.",
    "The source of the river is under the hill in the north.",
    "We use this file for the notes of the meeting and keep a copy at home.",
    "The general of the army may not agree with the public in this matter.",
    "The software of the machine is published by the company of the town.",
    "In the end it is the law of the land and the rights of the author that count.",
    "You can modify the plan or use it without the rest.",
    "The conditions are met with or without the help of the state.",
    "The international work of the foundation is well known in the world.",
    "This is the first version of the story that was told to us.",
    "It was a common way of the time and by no means a new one.",
    "That is for you to see and for us to know, as it was with them.",
    "The house is on the hill and the river runs by the wall of the old town.",
    "Es ist nicht für die das und der ein mit von zu auf.",
    "De la que le et les des pour dans une pas en un du.",
    "El la que de los no se por un para con las una es.",
]
# Other customary wordings, for calibration only; `none` are sentences that no family owns.
UNSEEN = {
    "MIT": ["This software is distributed under the terms of the MIT License, see the file LICENSE.", "The code is made available under the MIT license."],
    "Apache-2.0": ["Distributed under the Apache License, Version 2.0, without warranties of any kind.", "This file is available under the Apache License, Version 2.0."],
    "GPL": ["You can copy and change it under the GNU General Public License, version 2.", "Distributed under the terms of the GNU General Public License as published by the Free Software Foundation."],
    "LGPL": ["Distributed under the GNU Lesser General Public License, version 3."],
    "AGPL": ["You may use it under the GNU Affero General Public License, version 3."],
    "BSD": ["This code is released under the BSD 3-Clause License, see COPYING.", "Redistribution and use in source and binary forms are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This file is subject to the terms of the Mozilla Public License, version 2.0."],
    "CC-BY-NC": ["The photos are licensed under CC BY-NC 4.0.", "The text is available under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["The article is licensed under CC BY-SA 4.0.", "The text is available under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY": ["The figures are licensed under CC BY 4.0."],
    "CC0": ["The data are released under CC0 1.0, no rights reserved."],
    "Unlicense": ["The script is released under the Unlicense."],
    "none": [
        "The general public may read the terms of the house rules at the door.",
        "A source of free water was found by the foundation near the town.",
        "The author of this version has a license to use the public road.",
        "The conditions in the binary star are not well known to the public.",
        "All rights of way in the national park are subject to the law of the state.",
        "The licence of the shop was not renewed under the new law.",
        "Copyright of the songs is held by the band, all rights reserved.",
    ],
}
_COMMON = frozenset("the of and a to in is this that it for or by with at as be are you may on any an was from use not all".split())


def grams_of(text: str) -> list[str]:
    """Distinct grams of 1 to 3 words, without common single words."""
    words = re.findall(WORD, text.lower())
    out = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    return sorted(out - _COMMON)


def _examples(rng: np.random.Generator, copies: int, wordings: dict[str, list[str]]) -> list[tuple[str, str]]:
    filler = [w for s in ORDINARY for w in re.findall(WORD, s.lower())]
    out = []
    for family, texts in wordings.items():
        for text in texts:
            out.append((family, text))
            words = text.split()
            for _ in range(copies):
                kept = [w for w in words if rng.random() > 0.08] or words
                before, after = (list(rng.choice(filler, rng.integers(0, 12))) for _ in range(2))
                out.append((family, " ".join([*before, *kept, *after])))
    for _ in range(20 * copies):
        out.append((NONE, " ".join(rng.choice(filler, rng.integers(3, 60)))))
    return out


@cache
def model():
    """(grams, classes, weights [gram, class], bias, least probability): fitted once a driver."""
    rng = np.random.default_rng(5)
    fit, calibrate = _examples(rng, 5, {**NOTICES, NONE: ORDINARY}), _examples(rng, 6, UNSEEN)
    classes = [*NOTICES, NONE]
    grams = sorted({g for _, t in fit for g in grams_of(t)})
    at = {g: i for i, g in enumerate(grams)}

    def matrix(rows):
        x = np.zeros((len(rows), len(grams)), dtype=np.float32)
        for k, (_, text) in enumerate(rows):
            x[k, [at[g] for g in grams_of(text) if g in at]] = 1
        return x, np.array([classes.index(c) for c, _ in rows])

    x, y = matrix(fit)
    # Each family weighs the same, ordinary text as much as all of them.
    share = (1 / np.bincount(y, minlength=len(classes)))[y] * np.where(y == len(classes) - 1, len(NOTICES), 1)
    share = (share / share.sum()).astype(np.float32)
    w, b = np.zeros((len(grams), len(classes)), dtype=np.float32), np.zeros(len(classes), dtype=np.float32)
    target = np.eye(len(classes), dtype=np.float32)[y]
    for _ in range(ROUNDS):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        back = (p - target) * share[:, None]
        w -= 1.5 * (x.T @ back)
        b -= 0.5 * back.sum(axis=0)
        w = np.sign(w) * np.maximum(np.abs(w) - 1.5 * PENALTY, 0)
    cx, cy = matrix(calibrate)
    z = cx @ w + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    named, best = p.argmax(axis=1), p.max(axis=1)
    right = (named == cy) & (cy != len(classes) - 1)
    wrong = (named != cy) & (named != len(classes) - 1)
    cuts = np.linspace(0.3, 0.9, 61)
    least = float(cuts[np.argmax([(right & (best >= c)).sum() - 5 * (wrong & (best >= c)).sum() for c in cuts])])
    kept = np.abs(w).max(axis=1) > 0
    notice = {g for texts in NOTICES.values() for t in texts for g in grams_of(t) if g.count(" ") == 1}
    used = [g for g, k in zip(grams, kept, strict=True) if k or g in notice]
    return used, classes, w[[at[g] for g in used]].astype(np.float64), b.astype(np.float64), least


def _words(docs: DataFrame) -> DataFrame:
    """(doc_id, row, paragraph, ahead, i, n, alone, a, b, c): each word of a line with the two that follow it.

    ``i`` is its place among the ``n`` words of its line; ``alone``: the next line has one word. ``ahead`` is the
    number of next lines, `WINDOW` - 1 at most, before one without words.
    """
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0)))
    texts = docs.select("doc_id", F.xxhash64("text").alias("row"), lines.alias("lines"))
    texts = texts.withColumn("filled", F.transform("lines", lambda x: F.size(x) > 0))
    none = F.array().cast("array<string>")

    def line(words, i):
        one, two = (F.coalesce(F.get("lines", i + k), none) for k in (1, 2))
        tail = F.when(F.size(one) == 1, F.concat(one, F.slice(two, 1, 1))).otherwise(F.slice(one, 1, 2))
        after = F.slice("filled", i + 2, WINDOW - 1)
        gap = F.array_position(after, F.lit(False)).cast("int")
        ahead = F.when(gap > 0, gap - 1).otherwise(F.size(after))
        return F.struct(F.concat(words, tail).alias("w"), F.size(words).alias("n"), (F.size(one) == 1).alias("alone"), ahead.alias("ahead"))

    each = texts.select("doc_id", "row", F.posexplode(F.transform("lines", line)).alias("paragraph", "line"))
    each = each.select("doc_id", "row", "paragraph", "line.*").where(F.col("n") > 0)
    size = F.size("w")
    zipped = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), size).alias("b"), F.slice("w", F.lit(3), size).alias("c"))
    found = each.select("doc_id", "row", "paragraph", "ahead", "n", "alone", F.posexplode(zipped).alias("i", "z"))
    return found.where(F.col("i") < F.col("n")).select("doc_id", "row", "paragraph", "ahead", "i", "n", "alone", "z.*")


def _units(lines: DataFrame) -> DataFrame:
    """(doc_id, row, paragraph, last, hits) of every line and window; those that add nothing to a shorter one are left out."""
    order = Window.partitionBy("doc_id", "row").orderBy("paragraph").rangeBetween(0, WINDOW - 1)
    near = F.collect_list(F.struct("paragraph", "hits0", "hits1", "hits2")).over(order)

    def unit(k):
        last = F.col("paragraph") + k

        def inside(x):
            later = [F.when(x["paragraph"] + r <= last, x[f"hits{r}"]).otherwise(F.slice(x["hits0"], 1, 0)) for r in (1, 2)]
            return F.concat(x["hits0"], *later)

        hits = F.flatten(F.transform(F.filter("near", lambda x: x["paragraph"] <= last), inside))
        return F.struct(last.alias("last"), F.array_distinct(hits).alias("hits"))

    every = lines.withColumn("near", near)
    every = every.select("doc_id", "row", "paragraph", F.transform(F.sequence(F.lit(0), F.col("ahead")), unit).alias("units"))

    def adds(u, i):
        return (F.size(u["hits"]) > 0) & ((i == 0) | (F.size(u["hits"]) > F.size(F.get("units", i - 1)["hits"])))

    return every.select("doc_id", "row", "paragraph", F.inline(F.filter("units", adds)))


def _apart(scored: DataFrame) -> DataFrame:
    """One of the lines and windows that overlap; ``scored`` has doc_id, row, paragraph, last and what is kept with them."""
    kept = [c for c in scored.columns if c not in ("doc_id", "row", "paragraph", "last")]
    unit = F.struct("last", (-F.col("paragraph")).alias("minus"), "paragraph", *kept)
    groups = scored.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(unit)).alias("units"))

    def chosen(units):
        def add(out, x):
            free = (F.size(out) == 0) | (F.get(out, F.size(out) - 1)["last"] < x["paragraph"])
            return F.when(free, F.concat(out, F.array(x))).otherwise(out)

        return F.aggregate(units, F.filter(units, lambda x: F.lit(False)), add)

    groups = groups.withColumn("named", chosen(F.filter("units", lambda x: x["family"] != "unknown")))

    def free(x):
        return ~F.exists("named", lambda y: (x["paragraph"] <= y["last"]) & (y["paragraph"] <= x["last"]))

    unknown = chosen(F.filter("units", lambda x: (x["family"] == "unknown") & free(x)))
    return groups.select("doc_id", F.explode(F.concat("named", unknown)).alias("unit")).select("doc_id", "unit.*")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity) of every paragraph that is a licence notice."""
    grams, classes, weights, bias, least = model()
    spark = docs.sparkSession
    number = {g: i for i, g in enumerate(grams)}
    vocabulary = F.broadcast(spark.createDataFrame(list(number.items()), "gram string, number int"))
    opens = sorted({g.split(" ")[0] for g in grams})

    def reach(j):
        """How many lines below its first one a gram ends that ends in word j."""
        return F.when(j < F.col("n"), 0).when((j == F.col("n")) | ~F.col("alone"), 1).otherwise(2)

    i = F.col("i")
    runs = [(F.col("a"), F.lit(0)), (F.concat_ws(" ", "a", "b"), reach(i + 1)), (F.concat_ws(" ", "a", "b", "c"), reach(i + 2))]
    runs = [F.when(F.col(c).isNotNull(), F.struct(gram.alias("gram"), at.alias("reach"))) for c, (gram, at) in zip("abc", runs, strict=True)]
    each = _words(docs).where(F.col("a").isin(opens))
    found = each.select("doc_id", "row", "paragraph", "ahead", F.inline(F.array_compact(F.array(*runs)))).join(vocabulary, "gram")
    sets = [F.collect_set(F.when(F.col("reach") == r, F.col("number"))).alias(f"hits{r}") for r in range(3)]
    hits = _units(found.groupBy("doc_id", "row", "paragraph").agg(F.max("ahead").alias("ahead"), *sets))

    def logit(c: int):
        column = F.array(*[F.lit(float(x)) for x in weights[:, c]])
        return F.aggregate("hits", F.lit(float(bias[c])), lambda total, g: total + F.get(column, g))

    def similarity(family: str):
        shares = []
        for text in NOTICES[family]:
            own = F.array(*[F.lit(number[g]) for g in grams_of(text) if g.count(" ") == 1])
            shares.append(F.size(F.array_intersect("hits", own)) / F.size(own))
        return F.greatest(*shares) if len(shares) > 1 else shares[0]

    def judged(z):
        top = F.array_max(z)
        total = F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - top))
        return F.struct((F.array_position(z, top) - 1).cast("int").alias("at"), (1 / total).alias("probability"))

    z = F.array(*[logit(c) for c in range(len(classes))])
    scored = hits.withColumn("judged", F.get(F.transform(F.array(z), judged), F.lit(0)))
    scored = scored.where(F.col("judged.at") < len(classes) - 1).withColumn("probability", F.col("judged.probability"))
    scored = scored.withColumn("likeliest", F.get(F.array(*map(F.lit, classes)), F.col("judged.at")))
    match = F.lit(0.0)
    for family in NOTICES:
        match = F.when(F.col("likeliest") == family, similarity(family)).otherwise(match)
    scored = scored.withColumn("similarity", match)
    sure = (F.col("probability") >= least) & (F.col("similarity") >= CONFIRM)
    family = F.when(sure, F.col("likeliest")).otherwise("unknown").alias("family")
    return _apart(scored.select("doc_id", "row", "paragraph", "last", family, "probability", "similarity")).select(
        "doc_id",
        F.col("paragraph").cast("bigint").alias("paragraph"),
        "family",
        F.round("probability", 6).alias("probability"),
        F.round("similarity", 6).alias("similarity"),
    )
