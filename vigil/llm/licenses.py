"""License scan: normalised text against license templates by Dice over word bigrams.

A document's lines, and the document as a whole, are passages. A passage and a template
are compared by the Dice coefficient of their sets of word bigrams (lower-cased runs of
letters and digits). Dice can reach ``least`` only if the smaller set has at least
``least / (2 - least)`` times the larger one's size, so each template is listed under every
size it could match and passages meet templates by an equi-join on the size: templates of
other sizes are never compared. A passage takes its best template (ties: smaller license
name) if that reaches ``least``.

The template list is an argument (a few hundred passages), hence the broadcast. Column
expressions and joins only.

Edge cases: null or empty texts, and passages of one word, have no bigram and match
nothing; documents without a match give no row. Rows that share an id are reported
together (a null id like any other); repeated rows count their passages each. Repeated
templates are compared once. An empty table or template list gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import normal_words

# Wording of common license notices (license, passage).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Use of this source code is governed by the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
            'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
            'the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and '
            'to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def with_bigrams(df: DataFrame, passage: str, out: str) -> DataFrame:
    """``df`` with a passage column replaced by the set (array) of its word bigrams."""
    # words are a column of their own: inside the lambda they would be made anew for each bigram
    df = df.withColumn("_words", normal_words(F.col(passage)))
    words = F.col("_words")
    n = F.greatest(F.size(words) - 1, F.lit(0))
    grams = F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)))
    return df.withColumn(out, grams).drop("_words", passage)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text: str = "text",
         least: float = 0.8) -> DataFrame:
    """``(id, license, passages, dice)``: per id and license found the number of passages
    and the best Dice coefficient."""
    spark = docs.sparkSession
    known = spark.createDataFrame(sorted(set(TEMPLATES if templates is None else templates)), "license string, passage string")
    known = with_bigrams(known, "passage", "template").withColumn("b", F.size("template")).where("b > 0")
    share = least / (2 - least)
    sizes = F.sequence(F.greatest(F.ceil(F.col("b") * share - 1e-9), F.lit(1)), F.floor(F.col("b") / share + 1e-9))
    sized = known.select("license", "template", "b", F.explode(sizes.cast("array<int>")).alias("a"))

    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(body, "\n")
    # a text of one line is one passage, not two
    parts = F.when(F.size(lines) > 1, F.concat(lines, F.array(body))).otherwise(lines)
    passages = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.posexplode(parts).alias("at", "part"))
    passages = with_bigrams(passages, "part", "grams").withColumn("a", F.size("grams"))
    both = F.size(F.array_intersect("grams", "template"))
    dice = 2 * both / (F.col("a") + F.col("b"))
    matched = (passages.join(F.broadcast(sized), "a").select("id", "row", "at", "license", dice.alias("dice"))
               .where(F.col("dice") >= least))
    best = matched.groupBy("id", "row", "at").agg(
        F.min(F.struct((-F.col("dice")).alias("d"), F.col("license").alias("license"))).alias("m"))
    return best.groupBy(F.col("id").alias(id_col), F.col("m.license").alias("license")).agg(
        F.count("*").alias("passages"), F.max(-F.col("m.d")).alias("dice"))
