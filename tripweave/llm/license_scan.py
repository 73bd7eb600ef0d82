"""Licence statements found by Dice similarity over word bigrams.

A text as a whole and each of its lines are normalised (lower case, everything but letters and digits
is a blank) and reduced to their set of word bigrams. Templates whose bigram count rules out the wanted
similarity are pruned by size before any overlap is counted. Only DataFrame functions are used, in one
pass without a shuffle.

Defined cases: null and empty texts, and units of fewer than two words, match nothing. Of several
templates that reach the threshold, the most similar is reported; ties go to the first in name order.
Rows that repeat are reported as often. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
WHOLE_TEXT = -1  # line number of a match of the whole text

# Public licence statements and headers, by SPDX-like name.
TEMPLATES = {
    "Apache-2.0/statement": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD-3-Clause/statement": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0/statement": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0/statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0/statement": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0/sentence": (
        "This work is licensed under the Creative Commons Attribution 4.0 International License."
    ),
    "GPL-3.0/statement": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version."
    ),
    "ISC/grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies."
    ),
    "MIT/statement": "Released under the MIT License.",
    "MIT/grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "MPL-2.0/header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."
    ),
}


def bigrams(text: Column) -> Column:
    """The distinct pairs of consecutive words of the normalised text."""
    words = F.filter(
        F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda word: F.length(word) > 0
    )
    # The words are bound once, so that they are not split again for either half of the pairs.
    return F.element_at(
        F.transform(
            F.array(words),
            lambda w: F.array_distinct(
                F.zip_with(
                    F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))),
                    F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))),
                    lambda left, right: F.concat_ws(" ", left, right),
                )
            ),
        ),
        1,
    )


def template_bigrams(templates: dict[str, str]) -> dict[str, list[str]]:
    """The same normalisation for the (few, fixed) templates."""
    found = {}
    for name in sorted(templates):
        text = "".join(c if c.isalnum() else " " for c in templates[name].lower()).split()
        found[name] = sorted({f"{a} {b}" for a, b in zip(text, text[1:])})
    return found


def scan_licenses(
    df: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per text or line that matches a template.

    Columns: the document id, ``line_no`` (from 0; -1 for the text as a whole), ``template``,
    ``license`` (the template's name up to the slash), ``n_bigrams`` of the unit, ``dice``.
    """
    known = template_bigrams(TEMPLATES if templates is None else templates)
    table = F.array(
        *[
            F.struct(
                F.lit(-order).alias("order"),
                F.lit(name).alias("name"),
                F.lit(len(pairs)).alias("size"),
                F.array(*[F.lit(p) for p in pairs]).alias("pairs"),
            )
            for order, (name, pairs) in enumerate(known.items())
        ]
    )
    lines = F.transform(
        F.split(F.col(text), "\n", -1), lambda line, at: F.struct(at.alias("no"), line.alias("body"))
    )
    whole = F.array(F.struct(F.lit(WHOLE_TEXT).alias("no"), F.col(text).alias("body")))
    # Pairs are made inside the generator, so that no filter above repeats the work.
    made = F.transform(
        F.concat(whole, lines), lambda u: F.struct(u.no.alias("no"), bigrams(u.body).alias("pairs"))
    )
    units = df.select(F.col(doc).alias("__doc"), F.inline(made)).withColumnRenamed("pairs", "__pairs")
    # Dice >= t needs 2 * min(sizes) >= t * (sum of sizes).
    size = F.size("__pairs")
    fitting = F.filter(
        table,
        lambda t: 2.0 * F.least(size, t["size"]) >= threshold * (size + t["size"]),
    )
    scored = units.where(size > 0).withColumn("__near", fitting).where(F.size("__near") > 0)
    best = F.array_max(
        F.transform(
            "__near",
            lambda t: F.struct(
                (
                    2.0
                    * F.size(F.array_intersect(F.col("__pairs"), t["pairs"]))
                    / (F.size("__pairs") + t["size"])
                ).alias("dice"),
                t["order"].alias("order"),
                t["name"].alias("name"),
            ),
        )
    )
    return (
        scored.withColumn("__best", best)
        .where(F.col("__best.dice") >= threshold)
        .select(
            F.col("__doc").alias(doc),
            F.col("no").alias("line_no"),
            F.col("__best.name").alias("template"),
            F.split_part(F.col("__best.name"), F.lit("/"), F.lit(1)).alias("license"),
            F.size("__pairs").cast("long").alias("n_bigrams"),
            F.col("__best.dice").alias("dice"),
        )
    )
