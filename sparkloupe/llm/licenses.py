"""Licence scans by a trained paragraph classifier, in Spark SQL expressions.

A paragraph is the text between blank lines; its lines are one sequence of words. It is read in windows of `WINDOW`
words that overlap by half, so that a notice inside a long paragraph is found, too. Sparse word n-grams (one to three
words) feed a multinomial logistic regression over licence families and an unknown class, whose probability is
calibrated on held-out paragraphs; a prediction counts if enough words of a template of the family are there, and no
family whose template is much the same has a higher score. So a paragraph can state several licences, of which none is
taken for another's variant.

The fit has a fixed size: `VARIANTS` invented variants of each template, and as negatives invented sentences, words of
templates in no order, and windows of at most `SAMPLE` documents, drawn by a hash of doc_id, that are far from every
template.

The main path is one projection; nothing is shuffled and nothing leaves the JVM. As a template confirms only if
`CONFIRM` of its words, as they weigh, are there, a window without one of some of its words can't count: such witness
words, chosen by rule, are a gate that loses nothing, and windows that no template would confirm aren't scored.
"""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spans import let

_GPL = "you can redistribute it and or modify it under the terms of the gnu {} public license as published by the free software foundation either version {} of the license or at your option any later version"
#: Families with short standard notices.
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license", "spdx license identifier apache 2.0"),
    "mit": ("released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "spdx license identifier mit"),
    "isc": ("released under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "spdx license identifier isc"),
    "bsd": ("licensed under the bsd license", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    "bsd-2-clause": ("licensed under the bsd 2 clause license", "released under the simplified bsd license", "spdx license identifier bsd 2 clause"),
    "bsd-3-clause": ("licensed under the bsd 3 clause license", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "spdx license identifier bsd 3 clause"),
    "gpl": ("licensed under the gnu general public license", "released under the gpl license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    "gpl-2.0": ("this work is licensed under the gnu general public license version 2", "this program is free software " + _GPL.format("general", "2"), "spdx license identifier gpl 2.0"),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", "this program is free software " + _GPL.format("general", "3"), "spdx license identifier gpl 3.0"),
    "lgpl": ("licensed under the gnu lesser general public license", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    "lgpl-2.1": ("licensed under the gnu lesser general public license version 2.1", "this library is free software " + _GPL.format("lesser general", "2.1"), "spdx license identifier lgpl 2.1"),
    "lgpl-3.0": ("licensed under the gnu lesser general public license version 3", "this library is free software " + _GPL.format("lesser general", "3"), "spdx license identifier lgpl 3.0"),
    "agpl-3.0": ("licensed under the gnu affero general public license version 3", "this program is free software " + _GPL.format("affero general", "3"), "spdx license identifier agpl 3.0"),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0", "spdx license identifier mpl 2.0"),
    "epl-2.0": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2.0", "licensed under the eclipse public license version 2.0", "spdx license identifier epl 2.0"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software", "spdx license identifier unlicense"),
    "zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "licensed under the zlib license", "spdx license identifier zlib"),
    "bsl-1.0": ("distributed under the boost software license version 1.0", "spdx license identifier bsl 1.0"),
    "cc-by": ("licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "spdx license identifier cc by 4.0"),
    "cc-by-sa": ("licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license", "spdx license identifier cc by sa 4.0"),
    "cc-by-nc": ("licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", "spdx license identifier cc by nc 4.0"),
    "cc0": ("this work is dedicated to the public domain under cc0", "to the extent possible under law the author has waived all copyright under cc0 1.0 universal", "spdx license identifier cc0 1.0"),
    "all-rights-reserved": ("all rights reserved", "copyright the authors all rights reserved"),
}
#: Sentences that have words of licences and state none, and words that join sentences to notices.
OTHERS = ("the driver lost his license last year", "general elections and public opinion", "public transport in the city", "permission was granted to enter the building", "human rights and civil rights", "he studied at mit and lived nearby", "the commons debate went on", "a creative writing course", "seats are reserved for members", "the bbc and other public bodies", "the apache helicopter", "the gnu grazes in herds", "a domain name was registered", "attribution theory in psychology", "please read the general notes", "copyright law is complex", "all of the rights of the people", "the software license fee is due", "the terms of the contract are subject to change", "the mozilla foundation met in the eclipse of the sun", "a free copy of the work is at the library", "the license plate was issued under the old law", "we discussed the apache and mit licenses at length", "the version of the report is 2.0", "under the bridge the public gathered")
FILLER = "the software file project data text by author team 2019 2020 2021 see for details and of a in this code material or any with is are".split()
#: Words too common to be witnesses where a template has others.
COMMON = frozenset("the a an of and or to in is are be for by with at as this that it its you your any all may not no on under use from which was were he she we they".split())
FAMILIES = tuple(TEMPLATES)
VARIANTS, EPOCHS, RATE, DECAY = 16, 160, 4.0, 1e-4
SAMPLE = 1000
WINDOW, STRIDE = 80, 40
PRECISION = 0.98
CONFIRM = 0.6
#: A window is a negative if it has less than this share of each template.
FAR = 0.3
#: Templates of two families with this similarity of their words are rivals.
RIVAL = 0.5
SEED = 5
_SPLIT = r"[^a-z0-9.]+"
_BLANK = r"\n[ \t\r\f]*(?:\n[ \t\r\f]*)+"
_FOUND = "array<struct<paragraph:int,family:string,chance:double,shared:double>>"


def words(text: str) -> list[str]:
    return [w for w in (x.strip(".") for x in re.split(_SPLIT, text.lower())) if w]


def grams(tokens: list[str]) -> set[str]:
    return {" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1) if not COMMON.issuperset(tokens[i : i + n])}


def notices() -> list[tuple[list[str], int]]:
    return [(words(n), label) for label, texts in enumerate(TEMPLATES.values()) for n in texts]


def weighed() -> list[dict[str, float]]:
    """For each template its words, by the number of templates that have them: rare words tell licences apart. Sums are 1."""
    every = [set(n) for n, _ in notices()]
    used = Counter(w for n in every for w in n)
    return [{w: round(1 / used[w] / sum(1 / used[v] for v in n), 6) for w in sorted(n)} for n in every]


def shares(tokens: list[str]) -> list[float]:
    """For each template, how much of its words, as they weigh, the tokens have."""
    have = set(tokens)
    return [sum(x for w, x in n.items() if w in have) for n in weighed()]


def witnesses() -> list[str]:
    """Words such that a template that `CONFIRM` is there of has one of them there: of each template words that weigh
    more than what may be missing, the least common first."""
    out: set[str] = set()
    for n in sorted(weighed(), key=len):
        sum_, spare = 0.0, 1 - CONFIRM + 1e-4
        for w in sorted(n, key=lambda w: (w in COMMON, w not in out, -n[w], w)):
            if sum_ <= spare:
                out.add(w)
                sum_ += n[w]
    return sorted(out)


def invented() -> list[tuple[list[str], int]]:
    """Paragraphs as tokens, with their class: variants of templates with words lost, added and cut, and others."""
    rng = random.Random(SEED)
    vocabulary = sorted({w for n, _ in notices() for w in n})
    around = FILLER + sorted(COMMON)
    pad = lambda most: [rng.choice(around) for _ in range(rng.randint(0, most))]
    out = []
    for notice, label in notices():
        for k in range(VARIANTS):
            tokens = notice
            if k:
                tokens = [w for w in tokens if rng.random() > 0.04] if len(tokens) > 8 else tokens
                tokens = pad(30) + tokens + pad(30)
            out.append((tokens, label))
    unknown = len(FAMILIES)
    for other in OTHERS:
        out += [(pad(30) + words(other) + pad(30) + [rng.choice(vocabulary) for _ in range(rng.randint(0, 3))], unknown) for _ in range(VARIANTS)]
    out += [([rng.choice(vocabulary) for _ in range(rng.randint(3, 30))], unknown) for _ in range(30 * VARIANTS)]
    rng.shuffle(out)
    return out


class Model:
    """keys are the n-grams, weights their rows of class weights; the last class is unknown; `least` is the calibrated
    probability against unknown, `accuracy` and `recall` those of the held-out quarter."""

    def __init__(self, negatives: list[str] = ()) -> None:
        rows = invented() + [(t, len(FAMILIES)) for t in map(words, negatives) if t and max(shares(t)) < FAR]
        random.Random(SEED + 1).shuffle(rows)
        known = sorted({g for n, _ in notices() for g in grams(n)})
        vocabulary = {g: i for i, g in enumerate(known)}
        x = np.zeros((len(rows), len(known)), "f4")
        for i, (t, _) in enumerate(rows):
            at = [vocabulary[g] for g in grams(t) if g in vocabulary]
            x[i, at] = 1.0
        x /= np.maximum(np.sqrt(x.sum(axis=1, keepdims=True)), 1)
        y = np.eye(len(FAMILIES) + 1, dtype="f4")[[label for _, label in rows]]
        held = np.arange(len(rows)) % 4 == 0
        w, bias = np.zeros((len(known), y.shape[1]), "f4"), np.zeros(y.shape[1], "f4")
        train, target = x[~held], y[~held]
        for _ in range(EPOCHS):
            gap = self._chances(train @ w + bias) - target
            w -= RATE * (train.T @ gap / len(train) * 24 + DECAY * w)
            bias -= RATE * gap.mean(axis=0)
        self.bias = np.round(bias, 4).astype(float)
        strong = np.abs(w).max(axis=1) > 0.05
        self.keys = [g for g, s in zip(known, strong, strict=True) if s]
        self.weights = np.round(w[strong], 2).astype(float)
        scores = x[held][:, strong] @ self.weights + self.bias
        best, right = scores[:, :-1].argmax(axis=1), y[held].argmax(axis=1)
        chance = 1 / (1 + np.exp(scores[:, -1] - scores[np.arange(len(best)), best]))
        order = np.argsort(-chance, kind="stable")
        precision = np.cumsum(best[order] == right[order]) / (np.arange(len(order)) + 1)
        good = np.flatnonzero(precision >= PRECISION)
        self.least = float(min(0.95, max(0.5, chance[order[good[-1]]]))) if len(good) else 0.95
        said = np.where(chance >= self.least, best, len(FAMILIES))
        self.accuracy = float((said == right).mean())
        self.recall = float((said == right)[right < len(FAMILIES)].mean())

    @staticmethod
    def _chances(scores: np.ndarray) -> np.ndarray:
        out = np.exp(scores - scores.max(axis=-1, keepdims=True))
        return out / out.sum(axis=-1, keepdims=True)


def fit(docs: DataFrame) -> Model:
    """A model whose negatives come from at most `SAMPLE` of docs(doc_id, text), too."""
    rate = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, docs.count() // (2 * SAMPLE)))) == 0
    at = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - 8 * WINDOW, F.lit(1)))
    cut = F.substring("text", at.cast("int") + 1, F.lit(8 * WINDOW))
    few = docs.where(rate & F.col("text").isNotNull()).select(F.xxhash64("doc_id", "text").alias("place"), cut.alias("cut"))
    return Model([" ".join(words(r["cut"])[1:WINDOW]) for r in few.orderBy("place", "cut").limit(SAMPLE).collect()])


def _strings(values: list[str]) -> Column:
    """A literal array: one string that is cut while the query is planned."""
    return F.split(F.lit("\n".join(values)), "\n")


def _numbers(values: np.ndarray) -> Column:
    return F.split(F.lit("\n".join(f"{v:g}" for v in values)), "\n").cast("array<double>")


def rivals() -> list[list[int]]:
    """For each template, counted from 1, those of other families with much the same words."""
    every = [(set(n), label) for n, label in notices()]
    return [[k for k, (m, other) in enumerate(every, 1) if other != label and len(n & m) >= RIVAL * len(n | m)] for n, label in every]


def _rivals() -> Column:
    return F.array(*[F.split(F.lit(" ".join(map(str, r)) or "0"), " ").cast("array<int>") for r in rivals()])


def classify(tokens: Column, model: Model) -> Column:
    """array<struct(template, family, chance, shared)> of a window's words, for each template that confirms its family."""
    classes = len(FAMILIES) + 1
    keys, flat, bias, names = _strings(model.keys), _numbers(model.weights.reshape(-1)), _numbers(model.bias), _strings(list(FAMILIES))
    every = notices()
    weights = weighed()
    templates = F.array(*[F.struct(F.split(F.lit(" ".join(n)), " ").alias("w"), F.split(F.lit(" ".join(map(str, n.values()))), " ").cast("array<double>").alias("x")) for n in weights])
    vocabulary = _strings(sorted({w for n in weights for w in n}))
    owner = F.split(F.lit(" ".join(str(label + 1) for _, label in every)), " ").cast("array<int>")
    rival = _rivals()

    def score(t: Column) -> Column:
        runs = [F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " ")) for n in (2, 3)]  # noqa: B023
        used = F.array_intersect(F.concat(t, *runs), keys)

        def total(u: Column) -> Column:
            part = 1 / F.greatest(F.sqrt(F.size(u)), F.lit(1.0))
            rows = F.transform(u, lambda g: F.slice(flat, ((F.array_position(keys, g) - 1) * classes + 1).cast("int"), F.lit(classes)))
            sums = F.aggregate(rows, F.transform(bias, lambda b: F.lit(0.0)), lambda a, r: F.zip_with(a, r, lambda x, y: x + y))
            return F.zip_with(sums, bias, lambda s, b: s * part + b)

        return let(used, total)

    def pick(t: Column, near: Column) -> Column:
        def of(s: Column) -> Column:
            mine = lambda k: F.element_at(s, F.element_at(owner, k))
            chance = lambda k: 1 / (1 + F.exp(F.element_at(s, classes) - mine(k)))
            said = F.filter(F.sequence(F.lit(1), F.lit(len(every))), lambda k: F.element_at(near, k) >= CONFIRM)

            def kept(ids: Column) -> Column:
                beaten = lambda k: F.exists(F.array_intersect(F.element_at(rival, k), ids), lambda u: mine(u) > mine(k))
                sure = F.filter(ids, lambda k: (chance(k) >= model.least) & ~beaten(k))
                return F.transform(sure, lambda k: F.struct(k.alias("template"), F.element_at(names, F.element_at(owner, k)).alias("family"), chance(k).alias("chance"), F.element_at(near, k).alias("shared")))

            return let(said, kept)

        return let(score(t), of)

    def confirmable(t: Column) -> Column:
        near = lambda v: F.transform(templates, lambda n: F.aggregate(F.zip_with(n["w"], n["x"], lambda w, x: F.when(F.array_contains(v, w), x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x))
        return let(let(F.array_intersect(t, vocabulary), near), lambda x: F.when(F.array_max(x) >= CONFIRM, pick(t, x)).otherwise(F.array().cast("array<struct<template:int,family:string,chance:double,shared:double>>")))

    return let(tokens, confirmable)


def find(text: Column, model: Model) -> Column:
    """array<struct(paragraph, family, chance, shared)>: the families that the paragraphs, counted from 1, state, each
    once with its best window's figures; by paragraph and family. A notice that a window's end cuts gives way to a
    rival of which a window that overlaps has more."""
    few = witnesses()
    gate = r"(?i)(?<![a-z0-9])(?:" + "|".join(re.escape(w) for w in few) + r")(?![a-z0-9])"
    rare, rival = _strings(few), _rivals()

    def windows(p: Column) -> Column:
        tokens = F.filter(F.transform(F.split(F.lower(p["text"]), _SPLIT), lambda w: F.btrim(w, F.lit("."))), lambda w: w != "")

        def of(t: Column) -> Column:
            starts = F.sequence(F.lit(0), F.greatest(F.size(t) - STRIDE, F.lit(0)), F.lit(STRIDE))
            parts = F.filter(F.transform(starts, lambda s: F.struct(s.alias("at"), F.slice(t, s + 1, F.lit(WINDOW)).alias("w"))), lambda x: F.arrays_overlap(x["w"], rare))
            found = lambda x: F.transform(classify(x["w"], model), lambda c: F.struct(p["paragraph"].alias("paragraph"), x["at"].alias("at"), *[c[f].alias(f) for f in ("template", "family", "chance", "shared")]))
            return F.flatten(F.transform(parts, found))

        return let(tokens, of)

    def best(every: Column) -> Column:
        better = lambda a, b: (a["chance"] > b["chance"]) | ((a["chance"] == b["chance"]) & (a["shared"] > b["shared"]))
        twice = lambda c, o: (o["family"] == c["family"]) & better(o, c)
        cut = lambda c, o: (F.abs(o["at"] - c["at"]) <= STRIDE) & F.array_contains(F.element_at(rival, c["template"]), o["template"]) & (o["shared"] > c["shared"])
        kept = F.filter(every, lambda c: ~F.exists(every, lambda o: (o["paragraph"] == c["paragraph"]) & (twice(c, o) | cut(c, o))))
        return F.array_sort(F.array_distinct(F.transform(kept, lambda c: F.struct(*[c[f].alias(f) for f in ("paragraph", "family", "chance", "shared")]))))

    paragraphs = F.transform(F.split(text, _BLANK, -1), lambda p, i: F.struct((i + 1).alias("paragraph"), p.alias("text")))
    found = F.flatten(F.transform(F.filter(paragraphs, lambda p: p["text"].rlike(gate)), windows))
    return F.when(text.rlike(gate), let(found, best).cast(_FOUND)).otherwise(F.lit(None).cast(_FOUND))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with an array column `licences`. Null and empty texts, and texts without a licence, have an empty array.
    Repeated rows stay."""
    return docs.withColumn("licences", F.coalesce(find(F.col("text"), model or Model()), F.array().cast(_FOUND)))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_licences, families (distinct, sorted, comma-joined), paragraphs (paragraph:family, comma-joined)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = scan(docs, fit(docs)).select("doc_id", "licences")
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda c: c["family"]))), ",")
    places = F.array_join(F.transform("licences", lambda c: F.concat_ws(":", c["paragraph"], c["family"])), ",")
    return rows.select("doc_id", F.size("licences").cast("long").alias("n_licences"), families.alias("families"), places.alias("paragraphs"))
