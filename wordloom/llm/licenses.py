"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory. DataFrame functions only."""

from __future__ import annotations

import math
import pathlib
import re
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.storage import join_small, materialize

#: Least cosine of a notice, and of a whole licence text.
THRESHOLD, FULL_THRESHOLD = 0.7, 0.8
SEPARATOR = r"[^0-9a-z]+"
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"
#: An identifier, or an expression of several, after its tag.
SPDX = r"SPDX-License-Identifier:[ \t]*([0-9A-Za-z.+()-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[0-9A-Za-z.+()-]+)*)"
#: Ranks of evidence: a stated identifier, a whole licence text, a notice, and words that any notice may add.
STATED, WHOLE, NOTICE, GENERIC = 3, 2, 1, 0

# Notices by which licences are declared, by SPDX identifier.
TEMPLATES = {
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Licensed under the Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ],
    "LGPL-2.1": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
        "option) any later version.",
    ],
    "LGPL-3.0": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ],
    "ISC": ["Released under the ISC License."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction',
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved."],
}
# Words that tell the variants of a licence apart. A notice has exactly its template's
# variant words, and at least its template's numbers, so that versions aren't confused.
VARIANTS = ["affero", "lesser", "library", "nc", "nd", "noncommercial", "noderivatives", "noderivs", "sa", "sharealike"]
#: Licences that any other notice beats, however similar.
GENERIC_LICENSES = {"Proprietary"}
#: Whole licence texts, by SPDX identifier.
FULL_TEXTS = pathlib.Path(__file__).with_name("licence_texts")
#: Template words that stand in more than this share of the texts don't count as evidence for a whole licence.
COMMON = 0.05


@cache
def full_texts() -> dict[str, str]:
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted(FULL_TEXTS.glob("*.txt"))}


def words(text: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for w in re.split(SEPARATOR, text.lower()):
        if w:
            found[w] = found.get(w, 0) + 1
    return found


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SEPARATOR), "")


def all_frequencies(files: DataFrame, text: str = "text") -> DataFrame:
    """``token, n``: in how many texts each word of the corpus occurs; the empty token counts the texts."""
    own = files.filter(F.col(text).isNotNull())
    found = own.select(F.explode(F.concat(F.array_distinct(tokens(F.col(text))), F.array(F.lit("")))).alias("token"))
    return materialize(found.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "frequencies")


def _unit(raw: dict[str, float]) -> dict[str, float]:
    norm = math.sqrt(sum(x * x for x in raw.values()))
    return {w: x / norm for w, x in raw.items()}


class Weights:
    """Template vectors in the corpus's TF-IDF weights. ``other`` is the weight of a word that is in no text."""

    def __init__(self, texts: int, frequencies: dict[str, int], templates: dict[str, list[str]], whole: dict[str, str] | None = None) -> None:
        idf = lambda n: math.log((1 + texts) / (1 + n)) + 1
        self.texts, self.other, self.frequencies = texts, idf(0), frequencies
        vectors = [(name, i, words(t)) for name, own in templates.items() for i, t in enumerate(own)]
        full = {name: words(t) for name, t in (whole or {}).items()}
        self.idf = {w: idf(frequencies.get(w, 0)) for w in sorted({w for v in (*(v for *_, v in vectors), *full.values()) for w in v})}
        self.vectors = [(name, i, _unit({w: n * self.idf[w] for w, n in v.items()})) for name, i, v in vectors]
        self.sizes = {(name, i): sum(v.values()) for name, i, v in vectors}
        self.full = {name: _unit({w: (1 + math.log(n)) * self.idf[w] for w, n in v.items()}) for name, v in full.items()}

    def anchors(self, threshold: float) -> list[str]:
        """Words of which a unit that reaches the threshold with any template has at least one."""
        return sorted(set().union(*(self.template_anchors(v, threshold) for *_, v in self.vectors)))

    def template_anchors(self, v: dict[str, float], threshold: float) -> set[str]:
        """Words of which a unit that reaches the threshold with this template has at least one.

        The heaviest words are taken until the rest, even if all of a unit,
        can't reach the threshold: a cosine is at most the norm of the words in common.
        """
        found, rest = set(), 1.0
        for w in sorted(v, key=lambda w: (-v[w], w)):
            if rest < threshold * threshold - 1e-9:
                break
            found.add(w)
            rest -= v[w] * v[w]
        return found

    def evidence(self, threshold: float) -> tuple[list[str], int]:
        """Rare words of the whole licence texts, and of how many a text needs to reach the threshold with any.

        A cosine is at most the norm of the template's words in common, so that of its common
        words and its so many heaviest rare ones bounds it.
        """
        rare, least = set(), None
        for v in self.full.values():
            own = {w for w in v if self.frequencies.get(w, 0) <= COMMON * self.texts}
            mass, n = sum(x * x for w, x in v.items() if w not in own), 0
            for x in sorted((v[w] for w in own), reverse=True):
                if mass >= threshold * threshold - 1e-9:
                    break
                mass, n = mass + x * x, n + 1
            rare, least = rare | own, n if least is None else min(n, least)
        return sorted(rare), least or 0

    def frame(self, spark: SparkSession) -> DataFrame:
        """``token, template, license, weight, sign``, and per template ``signs`` and ``variants``: a row for each of its words.

        ``sign`` is 1 for numbers and variant words, ``signs`` how many of them the template has.
        """
        sign = lambda w: int(w.isdigit() or w in VARIANTS)
        rows = [(w, f"{name}/{i}", name, x, sign(w), sum(map(sign, v)), sorted(set(v) & set(VARIANTS))) for name, i, v in self.vectors for w, x in v.items()]
        return spark.createDataFrame(rows, "token string, template string, license string, weight double, sign int, signs int, variants array<string>")

    def whole(self, spark: SparkSession) -> DataFrame:
        """``token, license, weight`` of the whole licence texts."""
        return spark.createDataFrame([(w, name, x) for name, v in self.full.items() for w, x in v.items()], "token string, license string, weight double")

    def places(self, spark: SparkSession, threshold: float) -> DataFrame:
        """``token, template, n, c, square, anchor``: what one place of a word adds to a template's dot and a squared norm."""
        rows = []
        for name, i, v in self.vectors:
            heavy = self.template_anchors(v, threshold)
            rows += [(w, f"{name}/{i}", self.sizes[name, i], self.idf[w] * x, self.idf[w] ** 2, w in heavy) for w, x in v.items()]
        return spark.createDataFrame(rows, "token string, template string, n int, c double, square double, anchor boolean")


def windows(candidate: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """``file, spans``: starts and sizes, in words, of the windows over several lines that can reach the threshold.

    A window has as many words as a template and begins at one of its words; words of the template
    stand on more than one of its lines. Its cosine is at most the template's dot by the norm of
    single words, as words that repeat only add to the norm and no word weighs under 1.
    """
    places = F.broadcast(weights.places(candidate.sparkSession, threshold))  # a row for each word of a fixed template
    split = F.split("text", r"[\r\n]+")
    numbered = F.flatten(F.transform(split, lambda x, i: F.transform(tokens(x), lambda w: F.struct(i.alias("line"), w.alias("token")))))
    own = materialize(candidate.filter(F.col("text").rlike(r"[\r\n]")).select("file", numbered.alias("seq")), "words")
    # A window that reaches the threshold holds an anchor of its template, so only what lies around anchors is looked at.
    near = (own.select("file", F.posexplode("seq").alias("pos", "word")).select("file", "pos", "word.token")
            .join(places.filter("anchor"), "token").select("file", "template", "n", F.floor(F.col("pos") / F.col("n")).cast("int").alias("stretch")).distinct())
    begin = F.greatest(F.lit(0), (F.col("stretch") - 1) * F.col("n"))
    around = (near.join(own, "file").withColumn("total", F.size("seq")).withColumn("begin", begin)
              .select("file", "total", "template", "stretch", "begin", F.posexplode(F.slice("seq", F.col("begin") + 1, 3 * F.col("n"))).alias("at", "word")))
    met = (around.select("file", "total", "template", "stretch", (F.col("begin") + F.col("at")).alias("pos"), "word.line", "word.token")
           .join(places, ["token", "template"])
           .groupBy("file", "total", "template", "stretch", "n")
           .agg(F.array_sort(F.collect_set(F.struct("pos", "line", "c", "square"))).alias("at")))

    def reach(i: Column) -> Column:
        first = F.get("at", i)
        inside = F.filter(F.slice("at", i + 1, F.col("n")), lambda p: p["pos"] < first["pos"] + F.col("n"))
        zero = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("square"), F.lit(0).alias("k"), F.lit(-1).alias("line"))
        sums = F.aggregate(inside, zero, lambda s, p: F.struct(
            (s["c"] + p["c"]).alias("c"), (s["square"] + p["square"]).alias("square"), (s["k"] + 1).alias("k"), p["line"].alias("line")))
        return F.struct(first["pos"].alias("start"), first["line"].alias("line"), sums.alias("sums"))

    found = met.select("file", "total", "n", F.explode(F.transform(F.sequence(F.lit(0), F.size("at") - 1), reach)).alias("w"))
    rest = F.least(F.col("n"), F.col("total") - F.col("w.start")) - F.col("w.sums.k")
    able = F.col("w.sums.c") >= (threshold - 1e-6) * F.sqrt(F.col("w.sums.square") + rest)
    found = found.filter((F.col("w.sums.line") > F.col("w.line")) & able)
    return found.groupBy("file").agg(F.collect_set(F.struct("w.start", "n")).alias("spans"))


def weigh(counted: DataFrame, weights: Weights, frequencies: DataFrame) -> DataFrame:
    """``counted`` with ``idf`` of each token; the table of all words has as many rows as the corpus has words."""
    idf = F.log(F.lit(1.0 + weights.texts) / (F.lit(1) + F.col("n"))) + 1
    found = join_small(counted, frequencies.select("token", idf.alias("idf")), ["token"], "left")
    return found.withColumn("idf", F.coalesce("idf", F.lit(weights.other)))


def whole_licences(able: DataFrame, weights: Weights, frequencies: DataFrame, threshold: float = FULL_THRESHOLD) -> DataFrame:
    """``file, license, similarity, rank`` of the files whose whole text is a licence's, by dampened counts."""
    counted = (able.select("file", F.explode(tokens(F.col("text"))).alias("token"))
               .groupBy("file", "token").agg(F.count(F.lit(1)).alias("tf")))
    weighed = weigh(counted, weights, frequencies).withColumn("x", (1 + F.log("tf")) * F.col("idf"))
    norms = weighed.groupBy("file").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = (weighed.join(F.broadcast(weights.whole(able.sparkSession)), "token")  # a row for each word of a fixed text
            .groupBy("file", "license").agg(F.sum(F.col("x") * F.col("weight")).alias("dot")))
    return (dots.join(norms, "file").withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6))
            .filter(F.col("similarity") >= threshold).select("file", "license", "similarity", F.lit(WHOLE).alias("rank")))


def candidates(files: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """``file, text, near, whole``: files that may have a notice (``near``), be a licence's text (``whole``) or state an identifier.

    A notice holds an anchor of its template, and a licence's text as many rare words of licences as
    any licence needs: the bounds lose none. Repeated files are one.
    """
    anchors = weights.anchors(threshold)
    rare, least = weights.evidence(FULL_THRESHOLD)

    def judged(words: Column) -> Column:
        seen = F.filter(F.array_distinct(words), lambda w: w.isin(rare))
        return F.struct(F.exists(words, lambda w: w.isin(anchors)).alias("near"), (F.size(seen) >= least).alias("whole"))

    found = files.filter("text is not null").withColumn("judged", F.transform(F.array(tokens(F.col("text"))), judged)[0])  # words are split once
    found = found.select("file", "text", "judged.near", "judged.whole").filter(F.col("near") | F.col("whole") | F.col("text").contains("SPDX-License-Identifier"))
    return materialize(found.dropDuplicates(["file"]), "candidates")


def declared(files: DataFrame, weights: Weights, frequencies: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``file, license, similarity, rank``: the best evidence of each file.

    ``files`` has ``file`` (whatever tells files apart) and ``text``. A stated SPDX identifier
    beats a whole licence text, that beats a notice (a line, a window over lines or a whole
    text like a template's), and that beats words that any notice may add (``All rights reserved.``).
    Within a rank the greatest similarity wins, then the first licence by name. Words weigh by
    ``frequencies`` (:func:`all_frequencies`).
    """
    spark = files.sparkSession
    anchor = r"(?i)(?<![0-9a-z])(" + "|".join(weights.anchors(threshold)) + r")(?![0-9a-z])"
    able = candidates(files, weights, threshold)
    candidate = able.filter("near").select("file", "text")
    lines = candidate.select("file", F.posexplode(F.concat(F.array("text"), F.split("text", r"[\r\n]+"))).alias("unit", "line"))
    lines = lines.filter(F.col("line").rlike(anchor))
    spans = materialize(windows(candidate, weights, threshold), "spans")
    over = (join_small(candidate, spans, ["file"]).select("file", tokens(F.col("text")).alias("seq"), F.explode("spans").alias("span"))
            .select("file", F.col("span.start").alias("unit"), F.col("span.n").alias("size"),
                    F.explode(F.slice("seq", F.col("span.start") + 1, F.col("span.n"))).alias("token")))
    unit = ["file", "unit", "size"]
    counted = (lines.select("file", "unit", F.lit(0).alias("size"), F.explode(tokens(F.col("line"))).alias("token")).unionByName(over)
               .groupBy(*unit, "token").agg(F.count(F.lit(1)).alias("tf")))
    weighed = weigh(counted, weights, frequencies).withColumn("x", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy(*unit).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"),
                                       F.collect_set(F.when(F.col("token").isin(VARIANTS), F.col("token"))).alias("own"))
    dots = (weighed.join(F.broadcast(weights.frame(spark)), "token")  # a row for each word of a fixed template
            .groupBy(*unit, "template", "license")
            .agg(F.sum(F.col("x") * F.col("weight")).alias("dot"), F.sum("sign").alias("met"),
                 F.first("signs").alias("signs"), F.first("variants").alias("variants")))
    scored = (dots.filter("met = signs").join(norms, unit).filter(F.size(F.array_except("own", "variants")) == 0)
              .withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("similarity") >= threshold))
    notices = (scored.groupBy("file", "license").agg(F.max("similarity").alias("similarity"))
               .withColumn("rank", F.when(F.col("license").isin(*GENERIC_LICENSES), GENERIC).otherwise(NOTICE)))
    stated = able.withColumn("license", F.regexp_replace(F.regexp_extract("text", SPDX, 1), r"[ \t]+", " "))
    stated = stated.filter("license != ''").select("file", "license", F.lit(1.0).alias("similarity"), F.lit(STATED).alias("rank"))
    every = notices.unionByName(stated).unionByName(whole_licences(able.filter("whole"), weights, frequencies))
    return every.groupBy("file").agg(_best()).select("file", "best.license", (-F.col("best.down")).alias("similarity"), (-F.col("best.lower")).alias("rank"))


def _best() -> Column:
    return F.min(F.struct((-F.col("rank")).alias("lower"), (-F.col("similarity")).alias("down"), "license")).alias("best")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, *, path: str = "path", text: str = "text", keep: list[str] | None = None,
         threshold: float = THRESHOLD, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """``*keep, path, license, similarity, origin, declared_in`` of each row.

    All words weigh by the number of texts they are in. A file's own licence is that of
    :func:`declared` (``origin`` header); a licence file (LICENSE, COPYING, NOTICE) also declares
    for its directory: the best evidence wins, then the first licence by name. A file without
    own licence takes that of its nearest directory upwards (``origin`` inherited, ``declared_in``
    that directory, its similarity); else ``origin`` is none and the rest null.

    A null text has no notice; a null path is the empty one, in the root directory. Rows that
    repeat path and text are judged once and all returned. Extra columns may have any name; those
    of ``keep`` that are named like a column of the result come as ``kept_`` and their name.
    """
    keep = keep or []
    named = files.select(F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("__none")).alias("kept"),
                         F.coalesce(path, F.lit("")).alias("path"), F.col(text).alias("text"))
    templates, whole = templates or TEMPLATES, full_texts()
    vocabulary = sorted({w for own in (*templates.values(), whole.values()) for t in own for w in words(t)})
    frequencies = all_frequencies(named)
    counts = {r["token"]: r["n"] for r in frequencies.filter(F.col("token").isin("", *vocabulary)).collect()}
    weights = Weights(counts.pop("", 0), counts, templates, whole)
    key = F.struct("path", F.unhex(F.md5(F.col("text").cast("binary"))).alias("hash"))
    found = materialize(declared(named.select(key.alias("file"), "text"), weights, frequencies, threshold), "notices")
    rows = named.withColumn("file", key).drop("text")
    name = F.regexp_extract("file.path", r"[^/]*$", 0)
    homes = (found.filter(name.rlike(LICENSE_FILE))
             .groupBy(folder(F.col("file.path")).alias("home")).agg(_best())
             .select("home", F.col("best.license").alias("home_license"), (-F.col("best.down")).alias("home_similarity")))
    homes = materialize(homes, "homes")
    folders = rows.select(folder(F.col("path")).alias("folder")).distinct()
    parts = F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.split("folder", "/"))
    above = folders.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts)))).withColumn(
        "home", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    nearest = (join_small(above, homes, ["home"]).groupBy("folder")
               .agg(F.max_by(F.struct("home", "home_license", "home_similarity"), "depth").alias("near")))
    nearest = materialize(nearest, "nearest")
    own = join_small(rows, found.drop("rank"), ["file"], "left").withColumn("folder", folder(F.col("path")))
    out = join_small(own, nearest, ["folder"], "left")
    origin = (F.when(F.col("license").isNotNull(), "header").when(F.col("near").isNotNull(), "inherited").otherwise("none"))
    named_so = lambda c: f"kept_{c}" if c in ("path", "license", "similarity", "origin", "declared_in") else c
    return out.select(
        *[F.col(f"kept.`{c}`").alias(named_so(c)) for c in keep], "path", F.coalesce("license", "near.home_license").alias("license"),
        F.coalesce("similarity", "near.home_similarity").alias("similarity"), origin.alias("origin"),
        F.when(F.col("license").isNull(), F.col("near.home")).alias("declared_in"))
