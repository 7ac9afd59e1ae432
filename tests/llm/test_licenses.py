import random
import re

from barloom.llm import licenses
from barloom.llm.queries import op10_license_paragraphs


def test_families_and_edges(spark):
    texts = [
        "Intro line\nLicensed under the Apache License, Version 2.0.", "released UNDER the mit license\nmore", "A driver's license is needed.\nAll rights reserved.", None, "",
        "This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2.", "x " * 20_000, "Licensed under CC BY-NC 4.0.", "the of and\n\n\n", "Licensed under CC BY-NC 4.0.",
    ]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, family string")
    got = {r.doc_id: (r.n_hits, r.families) for r in licenses.licenses(docs).collect()}
    assert got == {0: (1, ["Apache-2.0"]), 1: (1, ["MIT"]), 2: (0, []), 3: (0, []), 4: (0, []), 5: (1, ["GPL-3.0"]), 6: (1, ["GPL-2.0"]), 7: (0, []), 8: (1, ["CC-BY-NC"]), 9: (0, []), 10: (1, ["CC-BY-NC"])}
    assert licenses.licenses(docs.limit(0)).count() == 0


def test_query_finds_the_notices(spark):
    d = "/root/testdata/sf0.01"
    family = {"Apache License": "Apache-2.0", "MIT License": "MIT", "General Public License, version 3": "GPL-3.0", "CC BY-NC": "CC-BY-NC"}
    want = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        want[r.doc_id] = ",".join(sorted({f for k, f in family.items() if re.search(k, r.text or "")}))
    assert {r.doc_id: r.families for r in op10_license_paragraphs(spark, d).collect()} == want


def test_common_notice_is_found(spark):
    r = random.Random(3)
    prose = lambda: " ".join(r.choices(["the", "of", "work", "version", "river", "law", "public", "use", "stone", "file"], k=12))
    texts = ["\n".join([prose(), *(["Licensed under the Apache License, Version 2.0."] if i % 3 == 0 else []), prose(), *(["Released under the MIT License."] if i % 50 == 1 else [])]) for i in range(600)]
    want = {i: (["Apache-2.0"] if i % 3 == 0 else []) + (["MIT"] if i % 50 == 1 else []) for i in range(600)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.families for x in licenses.licenses(docs).collect()} == want
    assert not {tuple(x.grams) for x in licenses.training_paragraphs(docs, spark).filter("family = 'unknown'").collect()} & {tuple(x.grams) for x in licenses.notices(spark).collect()}


GNU = """{this} is free software{a} you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation{b} either version {v} of the License, or
(at your option) any later version.

{this} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {kind}General Public License for more details.
"""
WRAPPED = {
    "Apache-2.0": """Copyright 2020 Some Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "GPL-2.0": GNU.format(this="This program", a=";", b=";", kind="", v="2"),
    "GPL-3.0": GNU.format(this="This program", a=":", b=",", kind="", v="3"),
    "LGPL": GNU.format(this="This library", a=";", b=";", kind="Lesser ", v="2.1"),
    "AGPL-3.0": GNU.format(this="This program", a=":", b=",", kind="Affero ", v="3"),
    "MIT": """Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "BSD": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:

1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "BSL-1.0": """Distributed under the Boost Software License, Version 1.0.
(See accompanying file LICENSE_1_0.txt or copy at
http://www.boost.org/LICENSE_1_0.txt)""",
}


def test_wrapped_headers(spark):
    """One hit of the right family each, plain and behind comment marks, with code around."""
    texts, want = [], {}
    for f, t in WRAPPED.items():
        for mark in ("", "# ", " * "):
            want[len(texts)] = (1, [f])
            texts.append("import something\n" + "\n".join((mark + line).rstrip() for line in t.split("\n")) + "\n\nx = 1\n")
    for t in ("(at your option) any later version.", "See the GNU General Public License for more details.", "version 3 of the report was free software of a kind."):
        want[len(texts)] = (0, [])
        texts.append(t)
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string")
    got = {r.doc_id: (r.n_hits, r.families) for r in licenses.licenses(docs).collect()}
    assert got.pop(None) == want[0]
    assert got == want


def test_scan_against_plain_python(spark):
    import math

    r = random.Random(5)
    bits = [x for ts in licenses.NOTICES.values() for t in ts for x in (t, t[: len(t) // 2], t[len(t) // 3 :])] + licenses.NO_GRANT
    texts = ["".join(r.choice(bits) + r.choice(["\n", ".\n", " ", "\n\n", "!\n"]) for _ in range(6)) for _ in range(60)] + ["word\n" * 3000 + "Released under the MIT License."]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    weights, constants, cut, order = model = licenses.train(docs, spark)

    def words(t):
        return [w for w in re.split(r"[^\w.+-]+|\.(?=\s|$)", t.lower().replace("_", " ")) if w]

    def grams(w):
        w = ["^", *w, "$"]
        return {f"{a} {b}" for a, b in zip(w, w[1:])}

    want = set()
    for t in texts:
        for par, p in enumerate(re.sub(r"([.!?][ \t\r]{0,80}|\n[ \t\r*#/;%-]{0,80})\n", "\\1\n\0", t).split("\0")):
            w = words(p)
            g = grams(w)
            if len(w) < 2 or not g & (set(weights) | {x for own in licenses.PROOF.values() for x in own}):
                continue
            proved = {f for f, own in licenses.PROOF.items() if g & set(own)}
            s = [sum(weights.get(x, [0.0] * len(order))[k] for x in g) + constants[k] for k in range(len(order))]
            s = [-1e9 if f in licenses.PROOF and f not in proved or proved & set(licenses.CLOSED_BY.get(f, ())) else v for f, v in zip(order, s)]
            best = max(s)
            k = s.index(best)
            chance = math.exp(max(s[:-1]) - best) / sum(math.exp(v - best) for v in s)
            if order[k] != "unknown" and chance >= cut:
                over = max(len(g & n) / min(len(g), len(n)) for n in map(grams, map(words, licenses.NOTICES[order[k]])))
                if over >= licenses.CONFIRM:
                    want.add((t, par, order[k]))
    from pyspark.sql import functions as F

    keyed = docs.select(F.md5("text").alias("text_key"), "text").distinct()
    got = {(x.text, x.par, x.family) for x in licenses.scan(docs, model).join(keyed, "text_key").collect()}
    assert got == want and len(want) > 60


def test_every_paragraph_trains(spark):
    rows = [(i, f"the river of the license runs here {i}\n\nplain prose number {i} of the day\n\nplain prose again") for i in range(900)] + [(900, "the river of the license runs here 0")] + [(901, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shown = licenses.training_paragraphs(docs, spark).filter("family = 'unknown'").groupBy("held").agg({"weight": "sum"}).collect()
    sums = {r.held: r[1] for r in shown}
    assert abs(sums[False] - licenses.UNKNOWN_WEIGHT - len(licenses.NO_GRANT)) < 1e-6 and abs(sums[True] - licenses.UNKNOWN_WEIGHT) < 1e-6
    met = licenses.matched(docs)
    assert {r.n for r in met.collect()} == {1} and met.filter("array_contains(grams, 'the license')").count() == 901
