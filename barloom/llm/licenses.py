"""Licence scans with a trained paragraph classifier, in DataFrame functions only.

A paragraph ends at a blank line (comment marks aside) or at a line that ends a sentence, so that a notice that is wrapped
over lines is one paragraph, and a line of its own too. A multinomial logistic regression over word bigrams names the
licence family of a paragraph. It is trained on the notices below, whole and in parts, against an unknown class: sentences
about licences that grant none, and all paragraphs of the scanned texts, less those that the comparison below confirms for any
notice: else the commonest licences would be learnt as unknown. They are counted as patterns of the notices' bigrams. A family that shares its wording
with others (``PROOF``) is open only to a paragraph that has one of its own word pairs, such as ``version 3``, and closed to
one that has those of a family named after it. A paragraph is a hit if its family's probability reaches a cut-off that was
set on held-back unknown paragraphs, and if the comparison with the family's notices confirms it: enough of the shorter
side's distinct bigrams must be in the other. Hits of one family that follow each other within ``NEAR`` paragraphs are one
notice. Only bigrams of the notices and proofs are looked up, so the table that is broadcast has a fixed size, and a
paragraph without any of them is unknown by the constants alone.

Defined results: a null or empty text has no paragraphs and no hits; texts are scanned by content, so repeated rows
and rows with a null id get the hits of their text; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm._common import attach, written

#: Short public licence notices by family.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Distributed under the terms of the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "This project is licensed under the MIT License", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "either version 3 of the License, or (at your option) any later version of the GNU General Public License", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "either version 2 of the License, or (at your option) any later version", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL": ["Licensed under the GNU Lesser General Public License", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License", "Use of this source code is governed by a BSD-style license"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal", "Dedicated to the public domain under CC0 1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
}
#: Word pairs, one of which a paragraph of the family must have; and families whose pairs close it.
PROOF = {
    "GPL-2.0": ["version 2", "version 2.0", "license v2", "identifier gpl-2.0-only", "identifier gpl-2.0-or-later", "identifier gpl-2.0"],
    "GPL-3.0": ["version 3", "version 3.0", "license v3", "identifier gpl-3.0-only", "identifier gpl-3.0-or-later", "identifier gpl-3.0"],
    "LGPL": ["lesser general", "library general", "identifier lgpl-2.1-only", "identifier lgpl-2.1-or-later", "identifier lgpl-3.0-only", "identifier lgpl-3.0-or-later"],
    "AGPL-3.0": ["affero general", "identifier agpl-3.0-only", "identifier agpl-3.0-or-later"],
    "Apache-2.0": ["apache license", "identifier apache-2.0"],
    "CC-BY-NC": ["by-nc 4.0", "attribution-noncommercial 4.0"],
    "CC-BY": ["by 4.0", "attribution 4.0"],
    "MPL-2.0": ["mozilla public", "identifier mpl-2.0"],
    "EPL-2.0": ["eclipse public", "identifier epl-2.0"],
    "BSL-1.0": ["boost software", "identifier bsl-1.0"],
    "MIT": ["mit license", "hereby granted", "identifier mit"],
    "ISC": ["isc license", "hereby granted", "identifier isc"],
}
CLOSED_BY = {"GPL-2.0": ("LGPL", "AGPL-3.0"), "GPL-3.0": ("LGPL", "AGPL-3.0")}
NO_GRANT = [
    "All rights reserved.", "You need a driver's license to rent this car.", "The license plate was registered under another name.", "The software is provided to students as part of the course.",
    "See the license agreement between the parties for details.", "This work is the result of many years of effort under the direction of the author.", "Released under the title of the first album.",
    "The version 2 of the report was released in May.", "Fishing licenses are issued by the county.", "He was granted permission to use the source of the river.",
]
UNKNOWN = "unknown"
#: What all scanned paragraphs that train the unknown class weigh together; a notice weighs 1.
UNKNOWN_WEIGHT = 1_000.0
#: Hits of a family at most so many paragraphs apart are one notice.
NEAR = 6
#: The share of held-back unknown paragraphs that may pass the cut-off, and the least cut-off.
FALSE_SHARE, LEAST = 0.001, 0.5
CONFIRM = 0.6
#: The cut-off is found to 1 / STEPS.
STEPS = 10_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.+-]+|\.(?=\s|$)"), lambda w: w != "")


def bigrams(w: Column) -> Column:
    """The distinct word pairs of a paragraph, with a mark at either end."""
    at = F.sequence(F.lit(0), F.size(w))
    return F.array_distinct(F.transform(at, lambda i: F.concat_ws(" ", F.coalesce(F.get(w, i - 1), F.lit("^")), F.coalesce(F.get(w, i), F.lit("$")))))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(text_key, par, w): the words of each paragraph of the texts in docs (text); text_key is the text's MD5."""
    cut = F.regexp_replace("text", r"([.!?][ \t\r]{0,80}|\n[ \t\r*#/;%-]{0,80})\n", "$1\n\u0000")
    rows = docs.filter("text IS NOT NULL").select(F.md5("text").alias("text_key"), F.posexplode(F.split(cut, "\u0000", -1)).alias("par", "value"))
    return rows.select("text_key", "par", words(F.col("value")).alias("w"))


def notices(spark: SparkSession) -> DataFrame:
    """(family, notice, grams) of the fixed notices."""
    rows = [(f, f"{f}/{i}", t) for f, texts in NOTICES.items() for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "family string, notice string, text string").select("family", "notice", words(F.col("text")).alias("w"))
    return df.select("family", "notice", bigrams(F.col("w")).alias("grams"), "w")


def matched(docs: DataFrame) -> DataFrame:
    """(text_key, par, size, n, grams, proved, sure, of) of every paragraph of two words or more with a word pair of the
    notices or proofs: size counts its pairs, n the rows of its text, grams are the pairs met; sure tells whether the
    comparison with any notice confirms it, and of lists (notice, family, n) of each pair then."""
    spark = docs.sparkSession
    held = notices(spark).select("notice", "family", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    held = held.groupBy("gram").agg(F.collect_list(F.struct("notice", "family", "n")).alias("of"))
    proofs = spark.createDataFrame([(g, [f for f, own in PROOF.items() if g in own]) for g in sorted({g for own in PROOF.values() for g in own})], "gram string, proves array<string>")
    rows = paragraphs(docs).filter(F.size("w") > 1).select("text_key", "par", bigrams(F.col("w")).alias("grams"))
    # The outer form adds no filter on the array, which the optimizer would push down into the splitting of paragraphs.
    rows = rows.select("text_key", "par", F.size("grams").alias("size"), F.explode_outer("grams").alias("gram"))
    met = rows.join(F.broadcast(held.join(proofs, "gram", "full")), "gram")
    met = met.groupBy("text_key", "par", "size", "gram").agg(F.first("of").alias("of"), F.first("proves").alias("proves"), F.count("*").alias("n"))
    met = met.groupBy("text_key", "par", "size").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("gram")).alias("grams"), F.flatten(F.collect_list("of")).alias("of"), F.flatten(F.collect_set("proves")).alias("proved"))
    sure = F.exists(F.array_distinct("of"), lambda o: F.size(F.filter("of", lambda x: x["notice"] == o["notice"])) / F.least(o["n"], F.col("size")) >= CONFIRM)
    return written(met.withColumn("sure", sure).withColumn("of", F.when(F.col("sure"), F.col("of"))))


def training_paragraphs(docs: DataFrame, spark: SparkSession, met: DataFrame | None = None) -> DataFrame:
    """(family, grams, held, weight): notices whole and without their ends, sentences that grant nothing, and all
    unconfirmed paragraphs of docs, as the patterns of notice pairs that they have, weighted by how often each occurs."""
    whole = notices(spark)
    cuts = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.slice("w", i + 1, F.greatest(F.size("w") - 2 * i, F.least(F.size("w"), F.lit(3)))))
    parts = whole.select("family", F.explode(cuts).alias("w")).filter(F.size("w") > 2).select("family", bigrams(F.col("w")).alias("grams"))
    none = spark.createDataFrame([(t,) for t in NO_GRANT], "text string").select(F.lit(UNKNOWN).alias("family"), words(F.col("text")).alias("w"))
    fixed = parts.unionByName(none.select("family", bigrams(F.col("w")).alias("grams"))).withColumns({"held": F.lit(False), "weight": F.lit(1.0)})
    met, held = matched(docs) if met is None else met, F.pmod("par", F.lit(2)) == 1
    some = met.filter("NOT sure").groupBy("grams", held.alias("held")).agg(F.sum("n").alias("n"))
    every = paragraphs(docs).filter(F.size("w") > 1).groupBy(held.alias("held")).agg(F.count("*").alias("n"))
    rest = every.join(met.groupBy(held.alias("held")).agg(F.sum("n").alias("met")), "held", "left")  # those without any pair
    rest = rest.select(F.array().cast("array<string>").alias("grams"), "held", (F.col("n") - F.coalesce("met", F.lit(0))).alias("n")).filter("n > 0")
    some = written(some.unionByName(rest))
    total = some.groupBy("held").agg(F.sum("n").alias("total"))
    some = some.join(F.broadcast(total), "held").select(F.lit(UNKNOWN).alias("family"), "grams", "held", (F.col("n") / F.col("total") * UNKNOWN_WEIGHT).alias("weight"))
    return fixed.unionByName(some)


def train(docs: DataFrame, spark: SparkSession, met: DataFrame | None = None):
    """(weights, constants, cut-off): (bigram -> weight of each class), both small and fixed in size."""
    grams = sorted({g for r in notices(spark).select("grams").collect() for g in r.grams})
    vectors = CountVectorizerModel.from_vocabulary(grams, inputCol="grams", outputCol="features", minTF=1.0)
    vectors.setBinary(True)
    texts = vectors.transform(written(training_paragraphs(docs, spark, met))).cache()
    order = [*NOTICES, UNKNOWN]
    label = F.array_position(F.array(*[F.lit(f) for f in order]), F.col("family")).cast("double") - 1
    model = LogisticRegression(family="multinomial", regParam=3e-4, maxIter=30, weightCol="weight").fit(texts.filter("NOT held").select("features", label.alias("label"), "weight"))
    matrix, constants = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    weights = {g: [float(x) for x in matrix[:, i]] for i, g in enumerate(grams)}
    chance = model.transform(texts.filter("held").select("features", "weight")).select((1 - F.element_at(vector_to_array("probability"), len(order))).alias("p"), "weight")
    steps = chance.filter(F.col("p") >= LEAST).groupBy(F.floor(F.col("p") * STEPS).alias("step")).agg(F.sum("weight").alias("weight"))
    passed, above = 0.0, 0.0
    for r in steps.orderBy(F.desc("step")).collect():  # at most STEPS rows
        above += r.weight
        if above > FALSE_SHARE * UNKNOWN_WEIGHT:
            passed = (r.step + 1) / STEPS
            break
    texts.unpersist()
    return weights, [float(c) for c in constants], max(LEAST, min(0.95, passed)), order


def scan(docs: DataFrame, model=None) -> DataFrame:
    """(text_key, par, family, p, overlap) of every paragraph that is a hit; docs: (text); model: what ``train`` gives."""
    spark, met = docs.sparkSession, matched(docs)
    weights, constants, cut, order = model or train(docs, spark, met)
    none = [0.0] * len(order)
    proofs = {g for own in PROOF.values() for g in own}
    table = spark.createDataFrame([(g, weights.get(g, none)) for g in sorted({*weights, *proofs})], "gram string, weights array<double>")
    sums = [F.sum(F.get("weights", k)).alias(f"s{k}") for k in range(len(order))]
    keys = ["text_key", "par", "size"]
    # Only what a notice confirms can become a hit.
    rows = met.filter("sure").select(*keys, "of", "proved", F.explode("grams").alias("gram"))
    lined = rows.join(F.broadcast(table), "gram").groupBy(*keys).agg(*sums, F.first("of").alias("of"), F.first("proved").alias("proved"))
    has = lambda f: F.array_contains("proved", f)
    scores = []
    for k, f in enumerate(order):
        barred = [has(g) for g in CLOSED_BY.get(f, ())] + ([~has(f)] if f in PROOF else [])
        own = F.col(f"s{k}") + constants[k]
        scores.append(F.when(F.greatest(F.lit(False), *barred), -1e9).otherwise(own) if barred else own)
    lined = lined.select(*keys, "of", F.array(*scores).alias("scores"))
    top = F.array_max("scores")
    total = F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp(s - top))
    named = F.element_at(F.array(*[F.lit(f) for f in order]), F.array_position("scores", top).cast("int"))
    lined = lined.select(*keys, "of", named.alias("family"), (F.exp(F.array_max(F.slice("scores", 1, len(order) - 1)) - top) / total).alias("p"))
    lined = lined.filter((F.col("family") != UNKNOWN) & (F.col("p") >= cut))
    shared = lined.select(*keys, "family", "p", F.explode("of").alias("o")).filter("o.family = family")
    shared = shared.groupBy(*keys, "family", "p", "o.notice", "o.n").agg(F.count("*").alias("k"))
    share = F.col("k") / F.least("n", "size")
    hits = shared.groupBy("text_key", "par", "family", "p").agg(F.max(share).alias("overlap"))
    return hits.filter(F.col("overlap") >= CONFIRM)


def licenses(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with n_hits, the sorted families, and the hits as structs (par, last, family, p, overlap): a
    notice from its first paragraph to its last one."""
    own = Window.partitionBy("text_key", "family").orderBy("par")
    hits = scan(docs.select("text")).withColumn("_new", F.coalesce((F.col("par") - F.lag("par").over(own) > NEAR).cast("int"), F.lit(1)))
    hits = hits.withColumn("_at", F.sum("_new").over(own)).groupBy("text_key", "family", "_at").agg(F.min("par").alias("par"), F.max("par").alias("last"), F.max("p").alias("p"), F.max("overlap").alias("overlap"))
    hit = F.struct("par", "last", "family", F.round("p", 6).alias("p"), F.round("overlap", 6).alias("overlap"))
    found = written(hits.groupBy("text_key").agg(F.array_sort(F.collect_list(hit)).alias("hits")))
    kind = dict(found.dtypes)["hits"]
    joined = attach(docs.select("doc_id", F.md5("text").alias("text_key")), found, "text_key", F.col("doc_id"))
    hits = F.coalesce("hits", F.array().cast(kind))
    return joined.select("doc_id", F.size(hits).cast("long").alias("n_hits"), F.array_sort(F.array_distinct(hits["family"])).alias("families"), hits.alias("hits"))
