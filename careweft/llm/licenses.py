"""Licence scan: a trained paragraph classifier with template confirmation.

A unit of text becomes the set of its word one- and two-grams, hashed into
`BUCKETS`. A multinomial logistic regression over them has one class per licence family and one
for unknown text. It is trained on notices of each family, whole and with words left out, and on
unknown text: fixed sentences that speak of licences without granting one, and at most
`UNKNOWN_ROWS` lines of the corpus of at most `SAMPLE_CHARS` characters (of each document the line of least hash, of
these the least hashes, if they hold no clue). Names of families are training rows too. The temperature of the probabilities, the
least probability for a family and `left_out_notices` come from `FOLDS` fits that each leave whole notices out;
`held_out_accuracy` is that of every fifth row, where other rows of the same notice were seen.

A prediction stands if the unit names no other family (`NAMES`) and either holds `CONTAINED` or more of the two-grams of one notice
of the family, or, runs excepted, names the family and has `CONTAINED` or more of its own two-grams in notices.

Every line of every text is judged. A bound is taken of each: the sum, over the buckets of its grams, of the largest lead that
any family has there over unknown text. Lines whose bound is below what the least probability needs are predicted for no family whatever
their sums are (`likely`); the others are scored in full.

Passages: lines that hold a clue, alone or across the line's end, and the lines around them, up to the first blank one, with at most `REACH`
words between; a passage may have any number of lines. Clues are two-grams of notices with a word that is not common, and
names of families. Units are the lines of a passage, its sentences that hold a clue, its runs (words between clues that are at most
`REACH` words apart, wherever lines and sentences end) and the whole passage. Of each notice more than 1 - `CONTAINED` of the two-grams
are clues and at most `REACH` words are between two (a test checks it), and a family's name is one, so a unit without a clue
cannot be confirmed, and no line length cuts a notice. Passages are staged once, so rows keep their numbers.

Equal units are scored once. The weights (`BUCKETS` rows at most) and
the grams of the notices are the only things sent to all executors. Scanning uses built-in
functions only; the fit is a small numpy loop on the driver over at most some
thousand rows of hashes.

Rows: null text counts as empty; texts without a notice get zeros and an empty family list; repeated rows
and keys are scanned one by one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careweft.session import cut_lineage

BUCKETS = 4096
UNKNOWN_ROWS = 2000
SAMPLE_CHARS = 1000
CONTAINED = 0.6
FOLDS = 5
REACH = 8
NAME_WEIGHT = 10
UNKNOWN = "unknown"

# Public notices by family.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "Code is available under the Apache License 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files under the MIT license.",
        "This software is distributed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "The code in this repository is available under the MIT license.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GNU GPL v3.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the LGPL, version 2.1 or later.",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "Licensed under the AGPL, version 3 or later.",
    ],
    "BSD": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD license.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "This software is distributed under the terms of the BSD license.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0 (MPL 2.0).",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "Text is available under the Creative Commons Attribution 4.0 License (CC BY 4.0).",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "Text is available under the Creative Commons Attribution-ShareAlike 4.0 License (CC BY-SA 4.0).",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Text is available under the Creative Commons Attribution-NonCommercial 4.0 License (CC BY-NC 4.0).",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related rights under the CC0 public domain dedication.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
    ],
}
# Text with trigger words that grants nothing.
PLAIN = [
    "The driver renewed a license at the office on Monday.",
    "A fishing licence costs more in spring than in autumn.",
    "The restaurant lost its liquor license after the inspection.",
    "Copyright law differs between countries and changes over time.",
    "All rights reserved. Copyright by the publisher.",
    "The company licensed the patent to a competitor for ten years.",
    "Please read the license agreement before you install the program.",
    "The warranty covers parts and labour for two years.",
    "The book entered the public domain last year.",
    "A licensed electrician has to check the wiring.",
    "They will redistribute the food among the villages.",
    "What is the difference between these licenses, and which version should be used?",
    "The MIT campus lies by the river.",
    "An Apache helicopter landed near the general public.",
    "The version of the file is not the one that was released.",
]
# One- and two-grams that name a family.
NAMES = {
    "Apache-2.0": ["apache license", "apache 2", "apache licenses", "apache org"],
    "MIT": ["mit license", "identifier mit"],
    "GPL": ["gnu general", "gpl"],
    "LGPL": ["gnu lesser", "lgpl"],
    "AGPL": ["gnu affero", "agpl"],
    "BSD": ["bsd"],
    "MPL-2.0": ["mozilla public", "mpl"],
    "CC-BY": ["by 4", "by 3", "attribution 4", "attribution 3"],
    "CC-BY-SA": ["by sa", "nc sa", "attribution sharealike", "noncommercial sharealike"],
    "CC-BY-NC": ["by nc", "attribution noncommercial"],
    "CC0": ["cc0", "unencumbered software"],
}
# Words that are common in any text.
COMMON = set("a an and any as at be by can found free in is it may not of or published that the terms this to under use used with work you".split())
BREAK = "\x02"


def _cut(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def clues() -> dict[str, str]:
    """Two-grams of notices with a word that is not common, and those that name a family, each with that word (the longer one of two)."""
    pairs = {p for texts in NOTICES.values() for n in texts for p in zip(_cut(n), _cut(n)[1:], strict=False)}
    pairs |= {tuple(n.split()) for texts in NAMES.values() for n in texts if " " in n}
    rare = {p: [w for w in p if w not in COMMON] for p in pairs}
    return {" ".join(p): max(found, key=len) for p, found in sorted(rare.items()) if found}


CLUES = clues()
NAME_WORDS = sorted(n for texts in NAMES.values() for n in texts if " " not in n)


def words(text: Column) -> Column:
    return F.split(F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pairs(w: Column) -> Column:
    return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))


def grams(text: Column) -> Column:
    """Distinct one- and two-grams; two-grams hold a space."""
    return _bind(words(text), lambda w: F.array_distinct(F.concat(w, _pairs(w))))


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _rows(spark: SparkSession, values: list, schema: str) -> DataFrame:
    """A small literal table."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(values)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def notices(spark: SparkSession) -> DataFrame:
    """(family, notice, gram, size) for the two-grams of all notices."""
    flat = [{"family": f, "notice": n} for f, texts in NOTICES.items() for n in texts]
    pairs = _rows(spark, flat, "family: string, notice: string").withColumn("pairs", F.filter(grams(F.col("notice")), lambda g: F.contains(g, F.lit(" "))))
    return pairs.select("family", "notice", F.size("pairs").alias("size"), F.explode("pairs").alias("gram"))


def _marks(w: Column) -> Column:
    """Per word whether a clue starts there."""
    return F.transform(w, lambda x, i: x.isin(*NAME_WORDS) | F.coalesce(F.concat_ws(" ", x, F.get(w, i + 1)).isin(*CLUES), F.lit(False)))


def _has_clue(text: Column) -> Column:
    return _bind(words(text), lambda w: F.exists(_marks(w), lambda m: m))


def _steps(low: int, high: int) -> Column:
    """Distances from `low` to `high`, small ones first. A slice of an array would copy the whole array."""
    return F.array(*[F.lit(d) for d in sorted(range(low, high + 1), key=abs)])


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) == ""


def _near(lines: Column, cut: Column) -> Column:
    """Per line whether it is in a passage. `cut` holds the words of each line."""
    # A clue stands in one line or goes over to the next.
    after = lambda i: F.slice(F.coalesce(F.get(cut, i + 1), F.array().cast("array<string>")), 1, 1)
    hits = F.transform(cut, lambda w, i: _bind(F.concat(w, after(i)), lambda v: F.exists(_marks(v), lambda m: m)))
    # A line without words counts as one, a blank line ends the passage.
    counts = F.transform(lines, lambda x, i: F.when(_blank(x), REACH + 1).otherwise(F.size(F.get(cut, i))))

    def mark(hits: Column, counts: Column) -> Column:
        def reached(i: Column, d: Column) -> Column:
            passed = F.aggregate(_steps(1, REACH), F.lit(0), lambda a, e: a + F.when(e < F.abs(d), F.get(counts, i + e * F.sign(d).cast("int"))).otherwise(0))
            return F.coalesce(F.get(hits, i + d), F.lit(False)) & (passed <= REACH)

        return F.transform(lines, lambda x, i: ~_blank(x) & F.exists(_steps(-REACH - 1, REACH + 1), lambda d: reached(i, d)))

    return _bind(hits, lambda h: _bind(counts, lambda c: mark(h, c)))


def _runs(text: Column) -> Column:
    """The stretches of words of a passage from clue to clue, where at most `REACH` words are between."""

    def kept(w: Column, marks: Column) -> Column:
        def within(i: Column) -> Column:
            marked = lambda d: F.coalesce(F.get(marks, i + d), F.lit(False))
            return marked(0) | marked(-1) | (F.exists(_steps(-REACH - 1, -1), marked) & F.exists(_steps(0, REACH), marked))

        return F.array_join(F.transform(w, lambda x, i: F.when(within(i), x).otherwise(BREAK)), " ")

    joined = _bind(words(text), lambda w: _bind(_marks(w), lambda m: kept(w, m)))
    return F.filter(F.transform(F.split(joined, BREAK), F.btrim), lambda r: r != "")


def samples(docs: DataFrame) -> DataFrame:
    """Of each document the line that may be taken for unknown text."""
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")
    short = F.filter(lines, lambda x: (F.length(x) <= SAMPLE_CHARS) & ~_blank(x))
    return docs.select(F.array_min(F.transform(short, lambda x: F.struct(F.xxhash64(x, F.lit(1)).alias("h"), x.alias("line")))).alias("sample"))


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Per document its key, a row number, how many paragraphs (lines with a word) it has, its passages, and the lines
    outside them that may be predicted for a family. Staged: the numbers stay as they are."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda x: F.translate(x, BREAK, "\x01"))
    cut = F.transform("lines", words)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), lines.alias("lines")).withColumn("cut", cut)
    # A clue in the whole text is needed for one in its lines; few texts have one, many have a word of one.
    some = sorted({*CLUES.values(), *NAME_WORDS})
    suspected = F.exists("cut", lambda w: F.exists(w, lambda x: x.isin(*some)))
    clue = _bind(F.filter(F.flatten("cut"), lambda x: x != ""), lambda w: F.exists(_marks(w), lambda m: m))
    none = F.array().cast("array<boolean>")
    near = F.when(suspected & clue, _near(F.col("lines"), F.col("cut"))).otherwise(none)
    rows = rows.select("row", "doc_id", "lines", near.alias("near"), F.transform("cut", model.likely).alias("likely"))
    inside = lambda i: F.coalesce(F.get("near", i), F.lit(False))
    marked = F.array_join(F.transform("lines", lambda x, i: F.when(inside(i), x).otherwise(BREAK)), "\n")
    found = F.when(F.size("near") > 0, F.filter(F.transform(F.split(marked, BREAK), lambda p: F.btrim(p, F.lit("\n"))), lambda p: p != ""))
    others = F.filter("lines", lambda x, i: F.get("likely", i) & ~inside(i) & ~_blank(x))
    return cut_lineage(
        rows.select(
            "row", "doc_id", F.size(F.filter("lines", lambda x: ~_blank(x))).cast("long").alias("n_paragraphs"),
            F.coalesce(found, F.array().cast("array<string>")).alias("passages"), others.alias("others"),
        )
    )


def units(rows: DataFrame) -> DataFrame:
    """(row, passage, line, single, run): what is scored of each passage. `single` are its lines, those outside any
    passage in passage -1; `run` its runs."""
    each = rows.select("row", F.posexplode("passages").alias("passage", "_text"))
    whole = F.regexp_replace("_text", r"\s*\n\s*", " ")
    sentences = F.filter(F.split(whole, r"(?<=[.!?;])\s+"), _has_clue)
    several = F.array_distinct(F.concat(sentences, F.array(whole)))
    as_units = lambda c, single, run: F.transform(c, lambda x: F.struct(x.alias("line"), F.lit(single).alias("single"), F.lit(run).alias("run")))
    named = F.concat(as_units(F.split("_text", "\n"), True, False), as_units(several, False, False), as_units(_runs(F.col("_text")), False, True))
    inside = each.select("row", "passage", F.explode(named).alias("u")).select("row", "passage", "u.*")
    return inside.unionByName(rows.select("row", F.lit(-1).alias("passage"), F.explode("others").alias("line"), F.lit(True).alias("single"), F.lit(False).alias("run")))


def _training_rows(rows: DataFrame, spark: SparkSession) -> list[tuple[str, list[int], int]]:
    """(family, buckets, fold): notices with every word left out once, and unknown text. All rows
    of a notice are in one fold; those of a family are dealt in turn."""
    if "sample" not in rows.columns:
        rows = samples(rows)
    flat = [{"family": f, "line": n, "fold": i % FOLDS} for f, texts in [*NOTICES.items(), (UNKNOWN, PLAIN)] for i, n in enumerate(texts)]
    # Names are in no fold: each fit has seen them.
    flat += [{"family": f, "line": n, "fold": FOLDS} for f, texts in NAMES.items() for n in texts]
    given = _rows(spark, flat, "family: string, line: string, fold: int").withColumn("w", words(F.col("line")))
    short = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.concat_ws(" ", F.slice("w", F.lit(1), i - 1), F.slice("w", i + 1, F.size("w"))))
    every = F.when(F.col("fold") < FOLDS, F.concat(F.array("line"), short)).otherwise(F.array("line"))
    varied = given.select("family", F.explode(every).alias("line"), "fold")
    lines = rows.filter("sample is not null").groupBy("sample.h", "sample.line").count().filter(~_has_clue(F.col("line")))
    unknown = lines.orderBy("h", "line").limit(UNKNOWN_ROWS).select(F.lit(UNKNOWN).alias("family"), "line", F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold"))
    rows = varied.unionByName(unknown).select("family", F.transform(grams(F.col("line")), bucket).alias("buckets"), "fold")
    return sorted((r.family, sorted(set(r.buckets)), r.fold) for r in rows.collect())


class Model:
    """Weights, bias, temperature and least probability."""

    def __init__(self, rows: list[tuple[str, list[int], int]], steps: int = 200, rate: float = 4.0, decay: float = 1e-4):
        self.families = [*NOTICES, UNKNOWN]
        used = sorted({b for _, found, _ in rows for b in found})
        place = {b: i for i, b in enumerate(used)}
        x = np.zeros((len(rows), len(used)), "f4")
        for i, (_, found, _) in enumerate(rows):
            x[i, [place[b] for b in found]] = 1 / np.sqrt(max(1, len(found)))
        y = np.array([self.families.index(f) for f, _, _ in rows])
        fold = np.array([k for _, _, k in rows])

        kinds = np.array([[x[y == c, :].any(axis=0)] for c in range(len(self.families) - 1)]).sum(axis=(0, 1))
        # Grams that few families have count for more.
        spread = np.log1p(len(self.families) / np.maximum(kinds, 1)).astype("f4")
        x *= spread
        names = fold == FOLDS

        def fit(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            share = np.where(names[at], NAME_WEIGHT, 1.0)
            weight = share / np.bincount(y[at], weights=share, minlength=len(self.families))[y[at]]
            weight = (weight / weight.sum()).astype("f4")
            target, seen = np.eye(len(self.families), dtype="f4")[y[at]], x[at]
            weights, bias = np.zeros((len(used), len(self.families)), "f4"), np.zeros(len(self.families), "f4")
            for _ in range(steps):
                off = (_softmax(seen @ weights + bias) - target) * weight[:, None]
                weights -= rate * len(self.families) * (seen.T @ off + decay * weights)
                bias -= rate * off.sum(axis=0)
            return weights, bias

        # Every fifth row: others of the same notice were seen.
        held = ~names & (np.cumsum(~names) % 5 == 0)
        weights, bias = fit(np.flatnonzero(~held))
        self.held_out_accuracy = float(((x[held] @ weights + bias).argmax(axis=1) == y[held]).mean())
        # Whole notices: each is judged by a fit that has not seen it.
        logits = np.zeros((len(rows), len(self.families)), "f4")
        for k in range(FOLDS):
            weights, bias = fit(np.flatnonzero(fold != k))
            logits[fold == k] = x[fold == k] @ weights + bias
        logits, truth = logits[~names], y[~names]
        scales = np.linspace(0.5, 8, 31)
        loss = [-np.log(_softmax(logits * s)[np.arange(len(truth)), truth] + 1e-9).mean() for s in scales]
        self.scale = float(scales[int(np.argmin(loss))])
        p = _softmax(logits * self.scale)
        unknown = truth == len(self.families) - 1
        right = p.argmax(axis=1) == truth
        self.left_out_accuracy = float(right.mean())
        self.left_out_notices = float(right[~unknown].mean())
        # At most one in a hundred unknown rows that were left out reaches it.
        self.least = float(min(0.9, max(0.3, np.quantile(p[unknown, :-1].max(axis=1), 0.99) + 0.01)))
        weights, self.bias = fit(np.arange(len(rows)))
        self.weights = np.zeros((BUCKETS, len(self.families)), "f4")
        self.weights[used] = weights * spread[:, None]

    def likely(self, w: Column) -> Column:
        """Whether a line of words `w` may reach the least probability in a family; true for all that do."""
        # Rounded as in `table`. A family at the least probability leads unknown text by `need`.
        scaled = np.where(np.abs(self.weights).max(axis=1, keepdims=True) > 1e-4, np.round(self.weights * self.scale, 4), 0)
        lead = scaled[:, :-1].max(axis=1) - scaled[:, -1]
        need = math.log(self.least / (1 - self.least)) - float((self.bias[:-1] - self.bias[-1]).max()) * self.scale - 1e-3
        leads = F.split(F.lit(",".join(f"{v:.5f}" for v in lead)), ",").cast("array<double>")
        buckets = F.array_distinct(F.transform(F.concat(w, _pairs(w)), bucket))
        return _bind(buckets, lambda b: F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(leads, x)) >= need * F.sqrt(F.size(b)))

    def table(self, spark: SparkSession) -> DataFrame:
        used = np.flatnonzero(np.abs(self.weights).max(axis=1) > 1e-4)
        values = [{"bucket": int(b), "w": [round(float(v) * self.scale, 4) for v in self.weights[b]]} for b in used]
        return _rows(spark, values, "bucket: int, w: array<double>")


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def classify(lines: DataFrame, model: Model) -> DataFrame:
    """`lines` (line), distinct, with `family` as predicted, `probability`, `confirmed`, and `contained` (confirmed by one notice)."""
    spark, n = lines.sparkSession, len(model.families)
    parts = lines.withColumn("grams", grams(F.col("line")))
    ones = parts.select("line", F.size("grams").alias("size"), F.explode("grams").alias("gram")).select("line", "size", bucket(F.col("gram")).alias("bucket")).distinct()
    sums = [F.coalesce(F.sum(F.get("w", F.lit(i))), F.lit(0.0)).alias(f"s{i}") for i in range(n)]
    # A row per line, bucket; a bucket counts once, as in training.
    scored = ones.join(F.broadcast(model.table(spark)), "bucket", "left").groupBy("line").agg(F.count(F.lit(1)).alias("size"), *sums)
    logits = [F.col(f"s{i}") / F.sqrt("size") + F.lit(float(model.bias[i]) * model.scale) for i in range(n)]
    top = F.array_max(F.array(*[F.struct(z.alias("z"), F.lit(f).alias("family")) for z, f in zip(logits, model.families, strict=True)]))
    predicted = scored.select("line", top.alias("top"), F.array(*logits).alias("all"))
    total = F.aggregate("all", F.lit(0.0), lambda a, z: a + F.exp(z - F.col("top.z")))
    predicted = predicted.select("line", F.col("top.family").alias("family"), (1 / total).alias("probability"))
    known = notices(spark)
    pairs = parts.select("line", F.explode("grams").alias("gram")).join(F.broadcast(known), "gram")
    held = pairs.groupBy("line", "family", "notice").agg((F.count(F.lit(1)) / F.first("size")).alias("share")).groupBy("line", "family").agg(F.max("share").alias("share"))
    every = sorted({" ".join(p) for texts in NOTICES.values() for n in texts for p in zip(_cut(n), _cut(n)[1:], strict=False)})
    two = F.filter("grams", lambda g: F.contains(g, F.lit(" ")))
    own = F.size(F.filter(two, lambda g: g.isin(*every))) / F.greatest(F.size(two), F.lit(1))
    named = F.array_compact(F.array(*[F.when(F.arrays_overlap("grams", F.array(*map(F.lit, found))), F.lit(f)) for f, found in NAMES.items()]))
    facts = parts.select("line", own.alias("own"), named.alias("named"))
    joined = predicted.join(held, ["line", "family"], "left").join(facts, "line")
    sure = (F.col("family") != UNKNOWN) & (F.col("probability") >= model.least)
    alone = F.size(F.array_except("named", F.array("family"))) == 0
    whole = F.coalesce("share", F.lit(0.0)) >= CONTAINED
    like = whole | (F.array_contains("named", F.col("family")) & (F.col("own") >= CONTAINED))
    return joined.select("line", "family", "probability", sure.alias("predicted"), (sure & alone & like).alias("confirmed"), (sure & alone & whole).alias("contained"))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document: `doc_id`, `n_paragraphs`, `n_predicted`, `n_confirmed` (lines, of all; and families that a passage shows over
    several lines or within one, of which none of its lines is predicted or confirmed) and `families`, the
    confirmed ones in alphabetical order, joined by commas."""
    spark = docs.sparkSession
    model = model or Model(_training_rows(docs, spark))
    rows = passages(docs, model)
    found = cut_lineage(units(rows))
    judged = classify(found.select("line").distinct(), model).filter("predicted").select("line", "family", "confirmed", "contained")
    # A run is cut to clues, so what it has of its own says nothing.
    hits = found.join(judged, "line").filter("contained or not run")
    # A row per passage and family.
    by_family = hits.groupBy("row", "passage", "family").agg(
        F.count_if("single").alias("lines"),
        F.count_if(F.col("single") & F.col("confirmed")).alias("sure_lines"),
        F.max("confirmed").alias("sure"),
    )
    by_row = by_family.groupBy("row").agg(
        F.sum(F.greatest("lines", F.lit(1))).alias("n_predicted"),
        F.sum(F.when(F.col("sure"), F.greatest("sure_lines", F.lit(1))).otherwise(0)).alias("n_confirmed"),
        F.collect_set(F.when(F.col("sure"), F.col("family"))).alias("found"),
    )
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    families = F.array_join(F.sort_array(F.coalesce("found", F.array().cast("array<string>"))), ",").alias("families")
    return rows.select("row", "doc_id", "n_paragraphs").join(by_row, "row", "left").select("doc_id", "n_paragraphs", count("n_predicted"), count("n_confirmed"), families)
