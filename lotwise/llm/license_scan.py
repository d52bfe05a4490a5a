"""Licence scan: a trained classifier of paragraphs, confirmed by comparison with templates.

A paragraph is a run of lines between blank ones; it is judged line by line and by all its telling lines together, so that notices on one line and texts wrapped over several are both found. Features are
the runs of one to three words. A sparse multinomial logistic regression (elastic net), trained on the texts and notices below, on cut and varied copies of them and on paragraphs that are
no licences, gives each family a probability; the threshold below which a family is unknown is calibrated on wordings that were not trained on and on licences of no known family. A
prediction counts as confirmed if the unit holds enough of a template of that family, or lies within one.

Runs of nothing but words that are everyday ones in the corpus are no features, and sparse weights leave most others without any. Each run with a weight for a licence has a rarest word; a
line without any of these words holds no such run, its score is known beforehand (no licence) and it is not looked at. So the words that are looked for follow from the trained weights. Scoring is a join of features with the weights, in DataFrame operations only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import common as C

#: Names of licences by family, as notices use them.
NAMES = {
    "agpl": ("GNU Affero General Public License", "Affero GPL", "AGPL", "AGPLv3", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "apache": ("Apache License", "Apache License, Version 2.0", "Apache License 2.0", "Apache-Lizenz", "Apache 2.0", "Apache-2.0", "licence Apache", "licencia Apache"),
    "artistic": ("Artistic License", "Artistic License 2.0", "Artistic-2.0", "Perl Artistic License"),
    "boost": ("Boost Software License", "Boost Software License 1.0", "BSL-1.0"),
    "bsd": ("BSD License", "BSD 3-Clause", "BSD 2-Clause", "BSD-3-Clause", "BSD-2-Clause", "BSD 3-Clause License", "New BSD License", "Simplified BSD License", "BSD-style license", "BSD-Lizenz", "licence BSD", "licencia BSD"),
    "cc": ("Creative Commons", "Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC BY-SA 4.0", "CC BY-NC 4.0", "CC BY-ND 4.0", "CC BY-NC-SA 3.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC BY 3.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike License"),
    "cc0": ("CC0", "CC0 1.0", "CC0-1.0", "CC0 1.0 Universal", "Creative Commons Zero", "Creative Commons CC0 public domain dedication"),
    "cddl": ("Common Development and Distribution License", "CDDL", "CDDL-1.0"),
    "epl": ("Eclipse Public License", "Eclipse Public License 2.0", "EPL 2.0", "EPL-2.0", "EPL-1.0"),
    "eupl": ("European Union Public Licence", "EUPL", "EUPL-1.2", "EUPL v1.2"),
    "gpl": ("GNU General Public License", "GNU General Public License, version 3", "GNU GPL", "GPL", "GPLv2", "GPLv3", "GPL v2", "GPL v3", "GPL v2 or later", "GPL-3.0-only", "GPL-2.0", "GPL-3.0-or-later", "licence GPL", "licencia GPL", "GPL-Lizenz"),
    "isc": ("ISC License", "ISC-Lizenz", "ISC licence"),
    "lgpl": ("GNU Lesser General Public License", "Lesser GPL", "LGPL", "LGPLv2.1", "LGPLv3", "LGPL-2.1", "LGPL-3.0-or-later", "GNU Library General Public License"),
    "mit": ("MIT License", "MIT-Lizenz", "MIT licence", "licence MIT", "licencia MIT", "Expat License", "X11 License"),
    "mpl": ("Mozilla Public License", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0", "MPL-1.1"),
    "unlicense": ("Unlicense", "The Unlicense"),
    "wtfpl": ("WTFPL", "Do What The Fuck You Want To Public License"),
    "zlib": ("zlib License", "zlib/libpng License", "zlib licence"),
}
#: Passages of the licences themselves and of the headers that they recommend.
TEXTS = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work",
    ),
    "artistic": (
        "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself.",
        "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "cc": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
        "You are free to share, copy and redistribute the material in any medium or format, and to adapt, remix, transform, and build upon the material, under the following terms: you must give appropriate credit, provide a link to the license, and indicate if changes were made.",
        "Dieses Werk ist lizenziert unter einer Creative Commons Namensnennung 4.0 International Lizenz",
        "Cette œuvre est mise à disposition selon les termes de la licence Creative Commons Attribution 4.0 International",
        "Esta obra está bajo una licencia de Creative Commons Reconocimiento 4.0 Internacional",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
    ),
    "cddl": (
        "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License.",
        "You can obtain a copy of the license at usr/src/OPENSOLARIS.LICENSE or http://www.opensolaris.org/os/licensing. When distributing Covered Code, include this CDDL HEADER in each file",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    ),
    "eupl": (
        "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence.",
        "This European Union Public Licence (the EUPL) applies to the Work (as defined below) which is provided under the terms of this Licence.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
        "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY. See the GNU Lesser General Public License for more details.",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "For more information, please refer to https://unlicense.org",
    ),
    "wtfpl": ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. You just do what the fuck you want to.",),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ),
}
#: Wordings around a name; every third is for the calibration.
NOTICES = (
    "Licensed under {}", "Released under the {}", "Distributed under {}", "This work is licensed under the {}", "Lizenziert unter der {}", "{}", "Publié sous {}", "Publicado bajo la {}", "SPDX-License-Identifier: {}",
    "This software is distributed under the terms of the {}", "Veröffentlicht unter der {}", "licensed to you under the terms of {}", "License: {}", "Distribué sous {}", "Licenciado bajo {}",
)
#: Paragraphs with words of licensing that are no licences, and passages of licences of no family above.
OTHERS = (
    "He lost his driving license after the accident", "The city council may license new taxis next year", "A fishing license is needed at the lake", "The software was released in version 2", "Permission to enter the building was granted",
    "Mozilla is a town in a story", "An apache helicopter was seen over the general hospital", "A person may copy the documentation", "Creative people hold the commons dear", "The public library gives a copy of each file", "Use the source",
    "The licensed dealer sold the car", "License plates are made of metal", "The foundation published a general report", "Her attribution of the work is wrong", "Terms and conditions of the sale", "The spdx group met at noon",
    "The gnu is a large antelope", "Redistribution of income", "License and registration please", "All rights reserved", "Copyright 2020 the authors", "mit dem Hund und der License", "Er kam mit der Bahn", "La licence de pêche coûte vingt euros",
    "La licencia de conducir caduca en mayo", "Die Lizenz für den Laden wurde erteilt", "The author disclaims any knowledge of the matter", "Released under pressure", "Distributed under the trees", "The boost in sales was large", "The eclipse was seen in public",
    "Artistic freedom is a public good", "The common development of the region", "The European Union published a report", "Lesser known works of the general", "Free of charge for any person under twelve",
)
FOREIGN = (
    "Redistributions of any form whatsoever must retain the following acknowledgment: this product includes PHP software, freely available from http://www.php.net/software/",
    "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit", "This font software is licensed under the SIL Open Font License, Version 1.1", "Licensed under the Sleepycat License",
    "Released under the Microsoft Public License", "This file is proprietary and confidential; unauthorized copying is strictly prohibited", "Distributed under the Beerware license", "Published under the GNU Free Documentation License",
)
UNKNOWN = "unknown"


def _tokens(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


@dataclass(frozen=True)
class LicenseParams:
    """confirm: share of a template's word pairs that the unit must hold, or of the unit's pairs that the template must. most_negative: corpus texts (those with the
    least hash) whose first lines are added to the training set as no licences. everyday: share of these texts from which a word is an everyday one; single: and from which it is no feature on its own. least: smallest
    absolute weight that is kept."""

    confirm: float = 0.6
    most_negative: int = 600
    everyday: float = 0.1
    single: float = 0.003
    least: float = 0.02
    most_broadcast: int = 200_000


@dataclass(frozen=True)
class LicenseModel:
    """weights: (run of words, family, weight); bias by family; threshold: least probability of a known family; anchors: words of which every weighted run holds one."""

    weights: list[tuple[str, str, float]]
    bias: dict[str, float]
    threshold: float
    anchors: tuple[str, ...]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def features(words: Column) -> Column:
    """Distinct runs of one to three words."""
    none = F.array().cast("array<string>")
    runs = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(none)
    return F.array_distinct(F.concat(words, runs(2), runs(3)))


def trie(words: tuple[str, ...]) -> str:
    """A pattern for any of the words that shares their beginnings, so that a text without them is passed over fast."""
    by: dict[str, list[str]] = {}
    for w in words:
        if w:
            by.setdefault(w[0], []).append(w[1:])
    parts = [head + trie(tuple(rest)) for head, rest in sorted(by.items())]
    body = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})" if parts else ""
    return f"(?:{body})?" if "" in words and body else body


def _pattern(anchors: tuple[str, ...]) -> str:
    return rf"(?i)(?<![a-z0-9])(?:{trie(anchors)})(?![a-z0-9])"


def units(docs: DataFrame, anchors: tuple[str, ...]) -> DataFrame:
    """(doc_id, body, block, unit): the words, joined by one space, of each line that holds an anchor, and of all such lines of a paragraph together, with the paragraph's number."""
    pattern = _pattern(anchors)
    held = docs.where(F.col("text").isNotNull()).where(F.col("text").rlike(pattern)).select("doc_id", F.xxhash64("text").alias("body"), F.posexplode(F.split("text", r"\n[\x20\x09\x0B-\x0D]*\n")).alias("block", "x"))
    lines = F.split("x", "\n")
    some = F.filter(lines, lambda v: v.rlike(pattern))
    both = held.where(F.col("x").rlike(pattern)).select("doc_id", "body", "block", F.explode(F.concat(some, F.when(F.size(some) > 1, F.array(F.array_join(some, " "))).otherwise(F.array().cast("array<string>")))).alias("unit"))
    return both.select("doc_id", "body", "block", F.array_join(tokens(F.col("unit")), " ").alias("unit"))


def _examples() -> list[tuple[str, str, bool]]:
    """(family, text, held for the calibration): notices of every name, passages whole, cut and wrapped, and what is no licence."""
    rows = []
    for family, names in NAMES.items():
        for i, name in enumerate(names):
            for j, notice in enumerate(NOTICES):
                rows.append((family, " ".join(_tokens(notice.format(name))), (i + j) % 3 == 2))
    for family, texts in TEXTS.items():
        for text in texts:
            words = _tokens(text)
            cuts = [words, words[: len(words) * 2 // 3], words[len(words) // 3 :], ["copyright", "2020", "the", "authors", *words], [*words, "all", "rights", "reserved"]]
            cuts += [words[k : k + 12] for k in range(0, len(words) - 6, 8)]
            rows += [(family, " ".join(cut), k % 3 == 2) for k, cut in enumerate(cuts)]
    for text in OTHERS:
        for k, (before, after) in enumerate((("", ""), ("note that", "see the file"), ("und", "siehe oben"))):
            rows.append((UNKNOWN, " ".join([*before.split(), *_tokens(text), *after.split()]), k == 2))
    return rows + [(UNKNOWN, " ".join(_tokens(t)), True) for t in FOREIGN]


def train(docs: DataFrame, params: LicenseParams = LicenseParams()) -> LicenseModel:
    """Fits the classifier on the examples and on a bounded number of corpus lines, and calibrates its threshold on the examples held back."""
    spark = docs.sparkSession
    rows = spark.createDataFrame(_examples(), "family string, text string, held boolean").select("family", tokens(F.col("text")).alias("words"), "held")
    texts = docs.where("text is not null").select("text")
    last = texts.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(params.most_negative).agg(F.max("h")).first()[0]  # so that no text is moved to be ordered
    sample = C.cut(texts.where(F.xxhash64("text") <= F.lit(last).cast("bigint")).distinct())
    counts = sample.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    ours = {w for _, text, _ in _examples() for w in text.split()}
    known = spark.createDataFrame([(w,) for w in sorted(ours)], "w string")  # the words of the examples
    seen_in = {r["w"]: r["n"] for r in counts.join(F.broadcast(known), "w").collect()}
    drawn_texts = sample.count()
    everyday = [w for w, n in seen_in.items() if n > params.everyday * drawn_texts or w.isdigit()] + [w for w in sorted(ours) if w.isdigit() and w not in seen_in]
    drawn = sample.select(tokens(F.element_at(F.split("text", "\n"), 1)).alias("words")).where(F.size("words") > 0)
    negative = drawn.select(F.lit(UNKNOWN).alias("family"), F.slice("words", 1, 60).alias("words"), F.lit(False).alias("held"))
    families = [UNKNOWN, *sorted(NAMES)]
    label = F.array_position(F.array(*[F.lit(x) for x in families]), F.col("family")).cast("double") - 1
    plain = F.array(*[F.lit(w) for w in everyday]).cast("array<string>")
    alone = F.array(*[F.lit(w) for w, n in seen_in.items() if n > params.single * drawn_texts]).cast("array<string>")  # these say something in company only
    telling = F.filter(features(F.col("words")), lambda g: (F.size(F.array_except(F.split(g, " "), plain)) > 0) & ~F.array_contains(alone, g))
    data = C.cut(rows.union(negative).withColumn("grams", telling).withColumn("label", label).coalesce(1))
    vectorizer = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2.0).fit(data.where("not held"))
    seen = vectorizer.transform(data)
    model = LogisticRegression(family="multinomial", maxIter=50, regParam=0.0005, elasticNetParam=0.5, standardization=False).fit(seen.where("not held"))
    matrix = model.coefficientMatrix.toArray()
    found = [(gram, family, float(matrix[k, j])) for j, gram in enumerate(vectorizer.vocabulary) for k, family in enumerate(families) if abs(matrix[k, j]) >= params.least]
    # a run matters only if it speaks for a licence; its rarest word among what is no licence leads to it
    speaking = {gram for gram, family, w in found if family != UNKNOWN and w > 0}
    anchors = tuple(sorted({min(gram.split(), key=lambda w: (w in everyday, seen_in.get(w, 0), -len(w), w)) for gram in speaking}))
    bias = {family: float(model.interceptVector[k]) for k, family in enumerate(families)}
    rough = LicenseModel(found, bias, 0.0, anchors)
    scored = _scores(data.where("held").withColumn("row", F.monotonically_increasing_id()).select("row", "family", "words"), ["row", "family"], rough).select("family", "guess", "p").collect()
    C.drop(data, sample)
    right = [r["p"] for r in scored if r["family"] == r["guess"]]
    wrong = [r["p"] for r in scored if r["guess"] is not None and r["family"] != r["guess"]]
    # the threshold that misjudges the fewest held examples: right ones below it and wrong ones from it on
    threshold = min((sum(x < t for x in right) + sum(x >= t for x in wrong), t) for t in (k / 100 for k in range(20, 96)))[1]
    return LicenseModel(found, bias, threshold, anchors)


def _scores(rows: DataFrame, keys: list[str], model: LicenseModel) -> DataFrame:
    """(keys, guess, p, others): the most probable known family of each row of words, its probability among all families and unknown, and the other families with theirs against unknown alone (kind, p)."""
    spark = rows.sparkSession
    table = spark.createDataFrame(model.weights, "gram string, kind string, weight double")  # as many rows as the trained weights
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("b")) for k, v in model.bias.items()])
    sums = rows.select(*keys, F.explode(features(F.col("words"))).alias("gram")).join(F.broadcast(table), "gram").groupBy(*keys).agg(F.collect_list(F.struct("kind", "weight")).alias("w"))
    total = lambda b: b["b"] + F.aggregate(F.filter("w", lambda x: x["kind"] == b["kind"]), F.lit(0.0), lambda a, x: a + x["weight"])
    odds = sums.withColumn("odds", F.transform(kinds, lambda b: F.struct(F.exp(F.least(total(b), F.lit(300.0))).alias("odds"), b["kind"].alias("kind"))))
    top = F.array_max(F.filter("odds", lambda x: x["kind"] != UNKNOWN))
    whole = F.aggregate("odds", F.lit(0.0), lambda a, x: a + x["odds"])
    none = F.element_at(F.filter("odds", lambda x: x["kind"] == UNKNOWN), 1)["odds"]
    others = F.transform(F.filter("odds", lambda x: (x["kind"] != UNKNOWN) & (x["kind"] != top["kind"])), lambda x: F.struct(x["kind"].alias("kind"), (x["odds"] / (x["odds"] + none)).alias("p")))
    return odds.select(*keys, top["kind"].alias("guess"), (top["odds"] / whole).alias("p"), others.alias("others"))


def _pairs(words: Column) -> Column:
    """Distinct pairs of neighbouring words; the word itself if it is alone."""
    return F.when(F.size(words) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, i, 2), " ")))).otherwise(words)


def license_scan(docs: DataFrame, params: LicenseParams = LicenseParams(), model: LicenseModel | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_paragraphs, n_licensed (paragraphs with a confirmed licence), n_unknown (paragraphs that the classifier takes for a licence that is not
    confirmed), families (confirmed, sorted, comma-joined; empty if none; a line may name several), best_p (null if no line holds a word of a licence).

    A null or empty text has no paragraphs; very long texts are judged whole. Repeated rows give repeated results; rows of one id with different texts have results of their own. Of equally
    probable families (ties) the last in the alphabet is the guess. An empty table gives an empty result. Columns other than doc_id and text are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    model = model or train(docs, params)
    found = C.cut(units(docs, model.anchors).withColumn("key", F.sha2("unit", 256)))
    # equal units are scored once; a unit is known by its words
    distinct = found.groupBy("key").agg(F.first("unit").alias("unit")).select("key", F.split("unit", " ").alias("words"))
    templates = [(f, _tokens(t)) for table in (NAMES, TEXTS) for f, group in table.items() for t in group]
    shown = spark.createDataFrame(templates, "guess string, template array<string>").select("guess", _pairs(F.col("template")).alias("template"))
    shown = shown.groupBy("guess").agg(F.collect_list("template").alias("templates"))  # one row for each family
    scored = _scores(distinct, ["key", "words"], model).join(F.broadcast(shown), "guess", "left").withColumn("pairs", _pairs(F.col("words")))

    def alike(t: Column) -> Column:
        shared = F.size(F.array_intersect("pairs", t))
        single = F.when((F.size(t) == 1) & ~F.contains(t[0], F.lit(" ")), F.array_contains("words", t[0]).cast("double")).otherwise(0.0)
        return F.greatest(single, shared / F.greatest(F.size(t), F.lit(1)), F.when(F.size("pairs") >= 3, shared / F.size("pairs")).otherwise(0.0))

    compared = scored.withColumn("alike", F.array_max(F.transform("templates", alike)))
    verdict = compared.select("key", "guess", "p", ((F.col("p") >= model.threshold) & (F.coalesce("alike", F.lit(0.0)) >= params.confirm)).alias("confirmed"))
    # a unit may name several licences: each other family that is as sure against unknown and confirmed by a template of its own, of which no template of the guess holds the words, counts as well
    also = scored.select("key", "words", "pairs", "guess", F.col("templates").alias("guessed"), F.explode(F.filter("others", lambda x: x["p"] >= model.threshold)).alias("o"))
    also = also.join(F.broadcast(shown.select(F.col("guess").alias("kind"), F.col("templates").alias("own"))), F.col("o.kind") == F.col("kind"))
    sure = lambda t: (alike(t) >= params.confirm) & ~F.exists("guessed", lambda g: F.size(F.array_intersect(F.array_intersect("pairs", t), g)) > 0)
    also = also.where(F.exists("own", sure)).groupBy("key").agg(F.collect_set("kind").alias("more"))
    verdict = C.cut(verdict.join(also, "key", "left").withColumn("more", F.when(F.col("confirmed"), F.col("more"))))
    near = F.broadcast(verdict) if C.small(verdict, params.most_broadcast) else verdict
    # a repeated row's units count once, as they come back to each of the rows
    blocks = found.select("doc_id", "body", "block", "key").distinct().join(near, "key").groupBy("doc_id", "body", "block").agg(
        F.max("confirmed").alias("sure"), F.max(F.col("p") >= model.threshold).alias("taken"), F.flatten(F.collect_list(F.when(F.col("confirmed"), F.concat(F.array("guess"), F.coalesce("more", F.array().cast("array<string>")))))).alias("kinds"), F.max("p").alias("p")
    )
    hits = C.cut(
        blocks.groupBy("doc_id", "body").agg(
            F.count_if("sure").alias("n_licensed"), F.count_if(F.col("taken") & ~F.col("sure")).alias("n_unknown"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))), ",").alias("families"), F.max("p").alias("best_p")
        )
    )
    C.drop(found, verdict)
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\n[\x20\x09\x0B-\x0D]*\n"), lambda x: x.rlike(C.WORD)))
    rows = docs.select("doc_id", F.xxhash64("text").alias("body"), n.cast("bigint").alias("n_paragraphs"))
    hits = F.broadcast(hits) if C.small(hits, params.most_broadcast) else hits
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.body") == F.col("b.body"))
    out = rows.alias("a").join(hits.alias("b"), same, "left")
    return out.select("a.doc_id", "n_paragraphs", F.coalesce("n_licensed", F.lit(0)).cast("bigint").alias("n_licensed"), F.coalesce("n_unknown", F.lit(0)).cast("bigint").alias("n_unknown"), F.coalesce("families", F.lit("")).alias("families"), "best_p")
