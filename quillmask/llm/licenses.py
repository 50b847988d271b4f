"""License scans: a trained paragraph classifier, confirmed by templates, scored in DataFrame expressions only.

A sparse logistic regression over the word uni- and bigrams of a paragraph tells licence families and 'unknown'. It is trained here, on
the notices below and on sentences in four languages that aren't any, some of which share words with them; a temperature fitted on
left-out texts calibrates its probabilities. A family is confirmed if the paragraph also holds enough of the word bigrams of one of its
templates. A paragraph is a line, or a run of several lines between lines without words.

Weights and templates are small tables, fixed by this module. No n-gram of function words alone is a feature, so each feature holds an
anchor, one of its other words. A text without any anchor has no feature at all and is 'unknown' by the intercepts: leaving it out
loses no row of a known family, whatever its probability or coverage.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmask.llm.common import settled
from quillmask.llm.quality_rules import FUNCTION_WORDS

#: Probability that a family needs and share of a template's bigrams that confirms it. A run of lines may hold several notices: there a family
#: needs PROBABILITY against unknown alone, and this share among all families.
PROBABILITY, COVERAGE, AMONG = 0.5, 0.6, 0.1
UNKNOWN = "unknown"

#: Notices by family, in common wordings.
TEMPLATES = {
    "mit": ["Released under the MIT License.", "This project is licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT", "Distributed under the MIT license, see the LICENSE file."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "SPDX-License-Identifier: Apache-2.0", "This project is released under the Apache License 2.0."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GNU GPL v3."],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License.", "SPDX-License-Identifier: GPL-2.0-only"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License.", "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "agpl-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0-only"],
    "bsd": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 2-Clause License."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "proprietary": ["All rights reserved. No part of this work may be reproduced without permission.", "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
#: Sentences that share words with notices and aren't any.
OTHERS = [
    "He lost his driver's license on the way to the station.", "A license plate was seen under the bridge.", "The new version of the software was released in public.", "The general told the public that the work was free.",
    "She studied at MIT and wrote about the permission of the author.", "The apache helicopter flew under the clouds.", "You can modify the recipe and use any copy of this file.", "The foundation published the terms of the prize.",
    "A fishing license is granted free of charge to any person under sixteen.", "The creative work of the commons was shared at four.", "All rights of the citizens were reserved for the public domain.", "The license of the pub was not granted.",
    "In the first version, the work was distributed with or without notice.", "The conditions are met and the use of the source is permitted.", "the of and to in is that it for on was be with as this by", "Mozilla and other browsers show the page in any form.",
    "Copyright law is taught in the second year.", "", "Version 2.0 of the plan is 3 pages long.", "The software runs on any computer with enough memory.", "Please read the terms before you sign the contract.",
    "The public library is open to everybody until eight.", "No part of the house was left standing after the storm.", "The file was copied to another disk and then removed.", "Her work is known in many countries and under many names.",
    "Source of the river is a small lake in the hills, free of ice in May.", "The general conditions of the sale are printed on the back.", "An international committee will meet in the commons.", "You may use the kitchen, but do not modify the oven.",
    "We distribute food to any person who asks, with or without papers.", "This program starts at nine and is followed by the news.", "The author reserved a table for four.", "Users can redistribute seats between rows.",
    "Der Vertrag ist mit dem Verlag geschlossen und gilt f\u00fcr drei Jahre.", "Er kam mit seiner Schwester und einem Hund aus der Stadt.", "Die Lizenz zum Fischen gilt nur im Sommer.", "Mit der Zeit wurde die Software besser, aber auch langsamer.",
    "Das Werk steht unter dem Schutz der Stadt und ist frei zug\u00e4nglich.", "Alle Rechte der B\u00fcrger sind im Gesetz genannt.", "Die allgemeine \u00d6ffentlichkeit wurde nicht gefragt.", "Eine Version des Liedes wurde im Radio gespielt.",
    "Le contrat est sign\u00e9 avec la maison pour trois ans.", "La licence de p\u00eache est valable en \u00e9t\u00e9 seulement.", "Le logiciel est plus lent que la version pr\u00e9c\u00e9dente.", "Tous les droits de l'homme sont dans ce texte.", "Une oeuvre publique se trouve au milieu de la place.",
    "Il est libre de partir avec ou sans sa soeur.", "El contrato se firma con la casa por tres a\u00f1os.", "La licencia de pesca vale solo en verano.", "El programa es m\u00e1s lento que la versi\u00f3n anterior.", "Todos los derechos est\u00e1n en la ley general.",
    "Una obra p\u00fablica se abre en el centro de la ciudad.", "Es libre de salir con o sin permiso.", "le la les des et sous une licence du travail", "der die das und ist nicht unter Lizenz von einer Stiftung", "el la los de y en una licencia de la obra", "mit mit und mit", "mit 4 und by 3 sa nc",
]


def words(text: str) -> list[str]:
    """Lower-cased runs of ASCII letters and digits, and of other non-ASCII characters, as WORDS splits them."""
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]


#: Short names by family, and sentences that are notices with them, and none with the things listed last.
NAMES = {
    "mit": ["MIT License", "MIT license", "Expat License"], "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"], "gpl-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0"],
    "gpl-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0"], "lgpl": ["GNU Lesser General Public License", "GNU LGPL", "LGPL-2.1"], "agpl-3.0": ["GNU Affero General Public License", "GNU AGPL v3", "AGPL-3.0"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD license"], "mpl-2.0": ["Mozilla Public License 2.0", "Mozilla Public License", "MPL-2.0"], "isc": ["ISC License", "ISC license"], "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 License"], "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 License"], "cc0": ["CC0 1.0 Universal", "CC0 1.0 public domain dedication"], "unlicense": ["Unlicense", "The Unlicense"],
}
FRAMES = ["Released under the {}.", "Licensed under {}.", "This project is licensed under the {}.", "Distributed under the terms of the {}.", "See the {} for details.", "This work is made available under the {}.", "SPDX-License-Identifier: {}", "Code is covered by the {}."]
THINGS = ["new label", "water", "supervision of the city", "name of the band", "red flag", "usual conditions"]


#: Words that are no anchor: function words and single characters.
PLAIN = frozenset(w for w in FUNCTION_WORDS if w.isascii()) | frozenset("you may any other no part all use it its can we he she they or if do does been will more than with under a v 0 1 2 3 4 5 6 7 8 9".split())


def grams(w: list[str]) -> set[str]:
    """Uni- and bigrams but for those of function words alone."""
    return {g for g in (*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))) if not PLAIN.issuperset(g.split(" "))}


def bigrams(w: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(w, w[1:])}


def _regress(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 250, ridge: float = 1e-4, lasso: float = 2e-5) -> np.ndarray:
    """Multinomial logistic regression by accelerated proximal gradient steps; the last row is the intercept, which isn't penalised."""
    w = ahead = np.zeros((x.shape[1], classes))
    onehot = np.eye(classes)[y]
    for k in range(steps):
        z = x @ ahead
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - (x.T @ (p - onehot) / len(x) + ridge * ahead)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - lasso, 0)
        w, ahead = new, new + k / (k + 3) * (new - w)
    return w


@lru_cache(1)
def trained() -> tuple[list[str], dict[str, list[float]], list[float], float, float]:
    """Classes, weights of each n-gram, intercepts, and of texts left out of the fit in turn: the share told right, and the share of sentences without a notice that are told a family. Deterministic."""
    classes = [*TEMPLATES, UNKNOWN]
    other = len(classes) - 1
    text = [(t, i, 4) for i, c in enumerate(classes[:-1]) for t in TEMPLATES[c]] + [(t, other, 2) for t in OTHERS]
    text += [(f.format(n), i, 1) for i, c in enumerate(classes[:-1]) for n in NAMES.get(c, ()) for f in FRAMES] + [(f.format(n), other, 1) for n in THINGS for f in FRAMES]
    rng, rows = np.random.default_rng(11), []
    vocabulary = sorted({g for t, i, _ in text if i < other for g in grams(words(t))})
    at = {g: j for j, g in enumerate(vocabulary)}
    for n, (t, i, variants) in enumerate(text):
        w = words(t)
        # each example, and variants within other words or with some words left out
        for k in range(variants):
            v = [x for x in w if k < 2 or rng.random() > 0.15]
            v = [f"w{rng.integers(99)}" for _ in range(k)] + v + [f"w{rng.integers(99)}" for _ in range(k)]
            rows.append((n, i, grams(v), k))
    x = np.zeros((len(rows), len(vocabulary) + 1))
    x[:, -1] = 1
    for r, (_, _, g, _) in enumerate(rows):
        for j in (at[s] for s in g if s in at):
            x[r, j] = 1
        x[r, :-1] /= max(1.0, x[r, :-1].sum() ** 0.5)
    y, part, whole = np.array([i for _, i, _, _ in rows]), np.array([n * 7 % 4 for n, *_ in rows]), np.array([k == 0 for *_, k in rows])
    z = np.zeros((len(rows), len(classes)))
    for fold in range(4):
        z[part == fold] = x[part == fold] @ _regress(x[part != fold], y[part != fold], len(classes))

    def share(heat: float) -> np.ndarray:
        s = np.exp(z / heat - (z / heat).max(axis=1, keepdims=True))
        return s / s.sum(axis=1, keepdims=True)

    heat = min(np.arange(0.2, 3.0, 0.05), key=lambda h: -np.log(share(h)[np.arange(len(y)), y] + 1e-300).mean())
    p = share(heat)
    said = np.where(p.max(axis=1) >= PROBABILITY, p.argmax(axis=1), len(classes) - 1)
    w = _regress(x, y, len(classes)) / heat
    weights = {g: [round(float(v), 6) for v in w[j]] for g, j in at.items() if np.abs(w[j]).max() > 1e-3}
    intercepts = [round(float(v), 6) for v in w[-1]]
    assert max(intercepts) == intercepts[-1]
    none = whole & (y == other)
    return classes, weights, intercepts, float((said == y)[whole].mean()), float((said != y)[none].mean())


@lru_cache(1)
def model() -> tuple[list[str], dict[str, list[float]], list[float], list[str]]:
    """Classes, weights of each n-gram, intercepts and anchors."""
    classes, weights, intercepts, _, _ = trained()
    held = {p for ts in TEMPLATES.values() for t in ts for p in bigrams(words(t))}
    return classes, weights, intercepts, sorted({w for g in (*weights, *held) for w in g.split(" ") if w not in PLAIN})


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _texts(values: Iterable[str]) -> Column:
    """An array of texts without quotes, as one literal: thousands of columns made one by one take seconds."""
    return F.expr("array(" + ", ".join(f"'{v}'" for v in values) + ")")


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(_lower(text), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")), " ")


def _units(docs: DataFrame, anchors: Column) -> DataFrame:
    """row, doc_id, paragraph, last, line: every line, and every run of several lines between lines without words, of texts with an anchor."""
    # lower() folds more than A-Z, so that this lets through a little more than need be
    docs = docs.where(F.arrays_overlap(F.split(F.lower("text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), anchors))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.split("text", "\n").alias("lines"))
    rows = rows.withColumn("full", F.transform("lines", lambda x: x.rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")))
    at = lambda i: F.coalesce(F.get("full", i), F.lit(False))
    number = F.sequence(F.lit(0), F.size("lines") - 1)
    ends = lambda step: F.filter(number, lambda i: at(i) & ~at(i + step))
    unit = lambda a, b, t: F.struct(a.alias("paragraph"), b.alias("last"), t.alias("line"))
    rows = rows.select("row", "doc_id", "lines", F.filter(F.zip_with(ends(-1), ends(1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["b"] > x["a"]).alias("runs"))
    runs = F.transform("runs", lambda x: unit(x["a"], x["b"], F.array_join(F.slice("lines", x["a"] + 1, x["b"] - x["a"] + 1), "\n")))
    return rows.select("row", "doc_id", F.explode(F.concat(F.transform("lines", lambda x, i: unit(i, i, x)), runs)).alias("u")).select("row", "doc_id", "u.*")


def scan(docs: DataFrame, unknown: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, paragraph, last, family, probability, coverage, confirmed: a row for each paragraph of a known family.

    paragraph and last are the numbers of its first and last line, from 0 within the text. Of a line, family is the most probable class,
    'unknown' if that is below PROBABILITY; coverage the largest share of a template's word bigrams, of that family, in the paragraph;
    confirmed a known family with COVERAGE. A run of lines has a row for each family with AMONG, PROBABILITY against unknown, and COVERAGE, that
    none of its lines confirms by itself; probability is that among all classes. Equal probabilities go to the family listed first. With
    `unknown`, lines that have an anchor and no known family have rows as well. Paragraphs without anchors are unknown, and they, null
    and empty texts have no row. Rows that repeat, or have a null doc_id, are scanned like others, one by one; other columns are ignored.
    """
    classes, weights, intercept, anchor = model()
    anchors = _texts(anchor)
    lines = _units(docs, anchors)
    lines = lines.select("row", "doc_id", "paragraph", "last", _words(F.col("line")).alias("w")).where(F.arrays_overlap("w", anchors))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    rows = settled(lines.withColumn("pairs", F.array_distinct(pairs)))
    # a paragraph's own n-grams of the vocabulary, then a sum over these for each class
    vocabulary = _texts(weights)
    rows = rows.withColumn("known", F.array_intersect(F.concat(F.array_distinct("w"), "pairs"), vocabulary))
    table = F.expr("map(" + ", ".join(f"'{g}', array({', '.join(f'{a!r}D' for a in v)})" for g, v in weights.items()) + ")")
    rows = rows.withColumn("each", F.transform("known", lambda g: F.element_at(table, g)))
    scale = F.greatest(F.lit(1.0), F.sqrt(F.size("known")))
    total = lambda k: F.aggregate("each", F.lit(0.0), lambda a, e: a + F.get(e, F.lit(k)))
    logits = F.array(*[total(k) / scale + F.lit(b) for k, b in enumerate(intercept)])
    rows = rows.withColumn("logits", logits).withColumn("top", F.array_max("logits"))
    p = 1 / F.aggregate("logits", F.lit(0.0), lambda a, z: a + F.exp(z - F.col("top")))
    rows = rows.withColumn("probability", p).withColumn("best", F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("logits", F.col("top")).cast("int")))
    held = {c: [sorted(bigrams(words(t))) for t in ts] for c, ts in TEMPLATES.items()}
    # templates are compared with the few pairs that any of them has, not with all of a long paragraph
    rows = rows.withColumn("pairs", F.array_intersect("pairs", _texts(sorted({g for ts in held.values() for t in ts for g in t}))))
    share = lambda t: F.size(F.array_intersect("pairs", _texts(t))) / F.lit(float(len(t)))
    cover = F.lit(0.0)
    for c, ts in held.items():
        cover = F.when(F.col("best") == c, F.greatest(*[share(t) for t in ts], F.lit(0.0))).otherwise(cover)
    rows = rows.withColumn("family", F.when(F.col("probability") >= PROBABILITY, F.col("best")).otherwise(UNKNOWN)).withColumn("coverage", cover)
    rows = settled(rows.select("row", "doc_id", "paragraph", "last", "pairs", "logits", "top", "probability", "family", "coverage"))  # else the logits are written out for each family
    hit = lambda f, p, c: F.struct(f.alias("family"), p.alias("probability"), c.alias("coverage"))
    each = [hit(F.lit(c), F.exp(F.get("logits", F.lit(k)) - F.col("top")) * F.col("probability"), F.greatest(*[share(t) for t in held[c]], F.lit(0.0))) for k, c in enumerate(TEMPLATES)]
    none = F.exp(F.get("logits", F.lit(len(TEMPLATES))) - F.col("top")) * F.col("probability")
    wrapped = F.filter(F.array(*each), lambda x: (x["probability"] >= AMONG) & (x["probability"] >= PROBABILITY * (x["probability"] + none)) & (x["coverage"] >= COVERAGE))
    single = F.col("last") == F.col("paragraph")
    hits = F.when(single, F.array(hit(F.col("family"), F.col("probability"), F.col("coverage")))).otherwise(wrapped)
    out = rows.select("row", "doc_id", "paragraph", "last", F.explode(hits).alias("x")).select("row", "doc_id", "paragraph", "last", "x.*")
    out = settled(out.withColumn("confirmed", (F.col("family") != UNKNOWN) & (F.col("coverage") >= COVERAGE)))
    if not unknown:
        out = out.where(F.col("family") != UNKNOWN)
    own = F.collect_list(F.when(single & F.col("confirmed"), F.col("paragraph"))).over(Window.partitionBy("row", "family"))
    out = out.withColumn("own", own).where(single | ~F.exists("own", lambda i: (i >= F.col("paragraph")) & (i <= F.col("last"))))
    return out.select("doc_id", "paragraph", "last", "family", "probability", "coverage", "confirmed")


def oracle() -> str:
    """SQL for DuckDB over documents that gives scan()'s rows, with probabilities and coverages of six decimals. It scores every paragraph; anchors have no part in it."""
    classes, weights, intercept, _ = model()
    s = lambda x: "'" + x.replace("'", "''") + "'"
    split = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    table = ", ".join(f"({s(g)}, {v})" for g, v in weights.items())
    templates = ", ".join(f"({s(c)}, {sorted(bigrams(words(t)))})" for c, ts in TEMPLATES.items() for t in ts)
    numbers = {c: k + 1 for k, c in enumerate(classes)}
    index = "CASE family " + " ".join(f"WHEN {s(c)} THEN {k}" for c, k in numbers.items()) + " END"
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, i - 1 AS paragraph, lines[i] AS line FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM t)),
g AS (SELECT *, paragraph - row_number() OVER (PARTITION BY r ORDER BY paragraph) AS island FROM l WHERE regexp_matches(line, '[0-9A-Za-z]|[^\\x00-\\x7F]')),
u AS (SELECT r, doc_id, paragraph, paragraph AS last, line FROM l UNION ALL SELECT r, doc_id, min(paragraph), max(paragraph), string_agg(line, chr(10) ORDER BY paragraph) FROM g GROUP BY r, doc_id, island HAVING count(*) > 1),
w AS (SELECT *, list_filter(string_split_regex(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{split}'), lambda x: x <> '') AS w FROM u),
a AS (SELECT r, doc_id, paragraph, last, w, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pairs FROM w),
m(g, v) AS (VALUES {table}),
k AS (SELECT r, paragraph, last, count(*) AS n, {", ".join(f"sum(v[{j + 1}]) AS s{j}" for j in range(len(classes)))} FROM (SELECT r, paragraph, last, unnest(list_distinct(w) || pairs) AS g FROM a) JOIN m USING (g) GROUP BY ALL),
z AS (SELECT a.*, [{", ".join(f"coalesce(s{j}, 0) / greatest(1.0, sqrt(coalesce(n, 0))) + {b!r}" for j, b in enumerate(intercept))}] AS z FROM a LEFT JOIN k USING (r, paragraph, last)),
p AS (SELECT * EXCLUDE (z), list_transform(z, lambda x: exp(x - list_max(z)) / list_sum(list_transform(z, lambda y: exp(y - list_max(z))))) AS p, {classes}[list_position(z, list_max(z))] AS best FROM z),
c(family, t) AS (VALUES {templates}),
q AS (SELECT r, doc_id, paragraph, last, best, family, p, p[{index}] AS probability, max(len(list_intersect(pairs, t)) / len(t)) AS coverage FROM p JOIN c ON (CASE WHEN paragraph = last THEN family = best ELSE true END) GROUP BY ALL),
h AS (SELECT *, coverage >= {COVERAGE} AS confirmed FROM q WHERE CASE WHEN paragraph = last THEN probability >= {PROBABILITY} ELSE probability >= {AMONG} AND probability >= {PROBABILITY} * (probability + p[{len(classes)}]) AND coverage >= {COVERAGE} END)
SELECT doc_id, paragraph::INT AS paragraph, last::INT AS last, family, round(probability, 6) AS probability, round(coverage, 6) AS coverage, confirmed FROM h
WHERE paragraph = last OR NOT EXISTS (SELECT 1 FROM h o WHERE o.r = h.r AND o.family = h.family AND o.paragraph = o.last AND o.confirmed AND o.paragraph BETWEEN h.paragraph AND h.last)
"""
