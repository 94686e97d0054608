"""Licence notices in text: a paragraph classifier, an unknown class with a calibrated threshold, and templates."""

from __future__ import annotations

import functools
import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"

#: Usual notices of each family, which confirm a prediction. The classifier doesn't learn from them.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache License 2.0.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution License.",
        "This work is licensed under CC BY-SA 4.0.",
        "Licensed under the Creative Commons Attribution-ShareAlike 3.0 License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This work is licensed under CC BY-NC-SA 4.0.",
        "Licensed under the Creative Commons Attribution-NonCommercial-NoDerivs 3.0 License.",
    ],
    "CC0": [
        "This work is dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released into the public domain.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GNU GPL v2.",
        "Released under the GNU Lesser General Public License.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GPLv2",
        "GPLv3",
        "LGPLv3",
        "AGPLv3",
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright (c) 2021 Example Corporation. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "This software is proprietary and confidential; unauthorized copying of this file is strictly prohibited.",
        "Unauthorized reproduction or distribution of this copyrighted work is illegal.",
    ],
}

#: What the classifier learns from, in other words than the templates.
EXAMPLES = {
    "Apache-2.0": [
        "This file is licensed to you under the Apache License, Version 2.0.",
        "Distributed under the terms of the Apache 2.0 license; see the NOTICE file.",
        "The code is available under the Apache License v2.0.",
        "License: Apache-2.0",
        "SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception",
        "See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Foundation under one or more contributor license agreements; the files are licensed under the Apache License.",
        "You may use this library under the Apache License 2.0, a copy of which is included.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.",
    ],
    "BSD": [
        "This code is distributed under the 2-clause BSD license.",
        "License: BSD-2-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution in source and binary forms, with or without changes, is permitted provided that the conditions below are met.",
        "Redistributions of the source code must retain the copyright notice and the disclaimer below.",
        "Redistributions in binary form must reproduce the copyright notice and this list of conditions in other materials.",
        "The package is available under the new BSD license; see the LICENSE file.",
        "Redistribution and use in source and binary forms are permitted if the copyright notice and this list of conditions are retained.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistributions in any form must keep the copyright notice, the list of conditions and the disclaimer in the documentation.",
        "Governed by a BSD-style license.",
        "All code here is under a three-clause BSD licence.",
    ],
    "CC-BY": [
        "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution 4.0 licence.",
        "Photos are shared under CC BY 2.0.",
        "License: CC-BY-4.0",
        "This article is published under CC BY-SA 3.0.",
        "You are free to share and adapt the text under the Creative Commons Attribution-ShareAlike licence.",
        "Available under a Creative Commons Attribution International licence, which permits any use if the author is credited.",
        "The figures are licensed CC BY 4.0.",
    ],
    "CC-BY-NC": [
        "This report may be shared for noncommercial purposes under CC BY-NC 3.0.",
        "License: CC-BY-NC-ND-4.0",
        "Images are available under a Creative Commons Attribution-NonCommercial licence.",
        "You may not use the material for commercial purposes; it is licensed under CC BY-NC-ND 4.0.",
        "Text licensed under Creative Commons NonCommercial ShareAlike 4.0 terms.",
        "The course is published under CC BY-NC-SA 2.5.",
    ],
    "CC0": [
        "To the extent possible under law the authors have dedicated all copyright and related rights to the public domain.",
        "License: CC0-1.0",
        "The data set is in the public domain under CC0.",
        "Anyone is free to copy, modify, publish, use, compile, sell or distribute this software, which is in the public domain.",
        "This work has been placed into the public domain by its author, who has waived all rights.",
        "The files are released under the Unlicense into the public domain.",
        "The author waived all copyright to this text.",
    ],
    "GPL": [
        "You can redistribute this file and modify it under the terms of the GNU General Public License, version 2 or later.",
        "This package is free software under the GNU GPL version 3.",
        "Distributed under the GPLv3.",
        "License: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "GPLv3 or later.",
        "GPLv2 only.",
        "Licence: LGPLv3 or later",
        "AGPLv3 only.",
        "The module is under GPLv3.",
        "Published under GPLv2 or AGPLv3.",
        "It is released under the LGPL, the GNU Lesser General Public License 2.1.",
        "The server is licensed under the AGPLv3, the GNU Affero General Public License.",
        "Along with this library you should have received a copy of the GNU Lesser General Public License.",
        "Released under GPLv2; modified versions must be redistributed under the same licence.",
        "This program is distributed in the hope that it will be useful, see the GNU General Public License for more details.",
        "LGPLv3 licensed.",
    ],
    "MIT": [
        "This software is available under the MIT licence.",
        "License: MIT",
        "SPDX-License-Identifier: MIT-0",
        "Permission is hereby granted, free of charge, to anyone who obtains this software and its documentation files.",
        "MIT licensed, see the LICENSE file.",
        "The library is free to use under the terms of the MIT License.",
        "Permission is granted, free of charge, to any person who obtains a copy of the software, to use, copy, modify, merge, publish, distribute, sublicense and sell copies without restriction.",
        "The copyright notice and this permission notice shall appear in all copies of the Software.",
        "Distributed under the MIT License.",
        "Permission to deal in the software without restriction is hereby granted, free of charge, including the rights to use and sell copies.",
    ],
    "MPL-2.0": [
        "The files are subject to the Mozilla Public License 2.0.",
        "License: MPL-2.0",
        "This code is distributed under the terms of the Mozilla Public License, version 2.0.",
        "Covered by the MPL 2.0; a copy can be had at mozilla.org/MPL.",
        "You may obtain a copy of the MPL with this source code form.",
        "Mozilla Public License v2.0 applies to the source code.",
    ],
    "proprietary": [
        "Copyright 2019 by the author, all rights reserved.",
        "All rights are reserved by the publisher.",
        "No part of this book may be reproduced in any form without written permission from the publisher.",
        "This document is confidential and proprietary to the company.",
        "Unauthorized copying or distribution of this material is strictly prohibited.",
        "The material is protected by copyright and may not be copied, distributed or transmitted without permission.",
        "(c) 2020 The Company. All rights reserved worldwide.",
        "No part of the work may be transmitted or reproduced by any means without prior permission in writing.",
        "Unauthorized use or reproduction of copyrighted material is a violation of the law.",
        "Unauthorized distribution of this work is illegal.",
        "Reproduction of any part without prior permission of the copyright owner is prohibited.",
    ],
}

#: Paragraphs that use the same words without being a notice of a known family.
OTHERS = [
    "She lost her driving license and had to apply for a new licence at the office.",
    "The city issued a fishing license to every resident.",
    "A license plate was found near the bridge, and the public was asked for help.",
    "He studied at MIT and released his first record under a new name.",
    "The Apache helicopter landed under heavy fire.",
    "Researchers at MIT published version 3 of the report.",
    "Copyright law protects authors in many countries.",
    "They asked for permission to enter the building and were granted access.",
    "Human rights must be protected, and all people have equal rights.",
    "A table was reserved for eight; all seats are reserved.",
    "The gnu is an antelope that lives in the plains.",
    "The House of Commons passed the public bill, version 2.0 of the plan.",
    "Creative people often work under pressure with common tools.",
    "The domain was registered by a public company in 2004.",
    "Distribution of food and redistribution of wealth were discussed without modification.",
    "The Mozilla browser opened a page in the public library.",
    "His warranty expired and the liability was limited by the contract.",
    "Licensed under the terms of the example agreement between both parties.",
    "This file is distributed under a custom license; ask the owner for terms.",
    "Released under an open license of the city archive.",
    "The licensed electrician worked under the supervision of the general contractor.",
    "All copies of the proprietary recipe are kept in a safe.",
    "Licensed for the sale of wine and spirits.",
    "Software license fees rose by ten percent.",
    "The publication of the notice was copied by the press, and rights were sold.",
    "Der Film wurde mit einer Lizenz gezeigt, alle waren mit dabei.",
    "The pilot's licence was withdrawn after the accident.",
    "The museum has all rights to the painting, which was reserved for the opening.",
    "Permission to build the bridge was granted by the council in May.",
    "Smoking is prohibited in all public rooms.",
    "Voting rights were granted to all residents of the commons.",
    "Copyright is a subject of the second chapter.",
    "The publication of the report was delayed by a week.",
    "The letter is confidential and must not be opened.",
    "Unauthorized persons may not enter the yard.",
    "Redistribution of land was the first law of the new government.",
    "The company licensed its brand to a maker of shoes.",
    "The Apache people lived in the mountains of the south.",
    "A domain of the public library was moved to a new host.",
    "Seats are reserved for members of the general public.",
    "Licensing hours in the town are from ten to eleven.",
    "She works on the law of human rights and on copyright.",
    "He got his licence from the public office, version two of the form.",
    "The software was sold under a licence that ran for one year.",
    "The terms of the licence were read by both parties of the agreement.",
    "House of Commons, second session, all members present.",
]

#: A feature holds one of these words, so a paragraph without any of them has no feature.
ANCHORS = "license licence licensed licenses licensing sublicense copyright copyrighted rights reserved permission permitted redistribution redistributions redistribute proprietary confidential unauthorized spdx gnu gpl lgpl agpl gplv2 gplv3 lgplv3 agplv3 apache mozilla mpl bsd cc cc0 commons domain waived unencumbered publication prohibited attribution noncommercial sharealike nc".split()

_WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
ANCHOR_PATTERN = r"(?i)(?<![a-z0-9])(?:" + "|".join(sorted(ANCHORS)) + r")(?![a-z0-9])"


def words(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def ngrams(ws: list[str], widths: tuple[int, ...] = (1, 2, 3)) -> set[str]:
    return {" ".join(ws[i : i + n]) for n in widths for i in range(len(ws) - n + 1)}


def features(text: str) -> set[str]:
    known = set(ANCHORS)
    return {g for g in ngrams(words(text)) if known & set(g.split())}


#: From this similarity to a template on, a prediction is confirmed.
SIMILARITY = 0.6


def template_similarity(text: str, family: str) -> float:
    """The larger, over the family's templates, of the share of the template's word 3-grams in the text and the share of the text's in it."""
    ws, out = words(text), 0.0
    for own in map(words, TEMPLATES[family]):
        n = min(3, len(own))
        a, b = ngrams(ws, (n,)), ngrams(own, (n,))
        out = max(out, len(a & b) / len(b), len(a & b) / max(len(a), 1))
    return out


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # the last is UNKNOWN
    bias: tuple[float, ...]
    weights: dict[str, tuple[float, ...]]
    threshold: float

    def probabilities(self, text: str) -> np.ndarray:
        z = np.array(self.bias) + sum((np.array(self.weights[g]) for g in features(text) if g in self.weights), np.zeros(len(self.families)))
        e = np.exp(z - z.max())
        return e / e.sum()


def _softmax_fit(x: np.ndarray, y: np.ndarray, classes: int, ridge: float = 3e-4, steps: int = 1000, rate: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], classes)), np.zeros(classes)
    target = np.eye(classes)[y]
    share = 1 / np.maximum(1, np.bincount(y, minlength=classes))[y]
    share = (share / share.sum())[:, None]
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = share * (p - target)
        w -= rate * (x.T @ g + ridge * w)
        b -= rate * g.sum(axis=0)
    return w, b


@functools.cache
def train() -> Model:
    """Fit on EXAMPLES and OTHERS, whole and with words left out; calibrate on those held out of each fold.

    Calibration scales the weights by the temperature that suits the held-out paragraphs best.
    The threshold is the lowest at which at most one in ten of the held-out paragraphs
    without a notice is named (templates have yet to confirm that), and at most one in twenty of the held-out names that a
    template confirms is wrong.
    """
    families = (*sorted(EXAMPLES), UNKNOWN)
    examples = [(t, families.index(f)) for f, ts in sorted(EXAMPLES.items()) for t in ts] + [(t, len(families) - 1) for t in OTHERS]
    rng = np.random.default_rng(11)
    texts, labels, folds = [], [], []
    for k, (t, y) in enumerate(examples):
        ws = words(t)
        for copy in range(4):
            keep = [w for w in ws if copy == 0 or rng.random() > 0.12]
            texts.append(" ".join(keep))
            labels.append(y)
            folds.append(k % 4)
    grams = sorted({g for t in texts for g in features(t)})
    place = {g: i for i, g in enumerate(grams)}
    x = np.zeros((len(texts), len(grams)))
    for i, t in enumerate(texts):
        x[i, [place[g] for g in features(t)]] = 1
    y, fold = np.array(labels), np.array(folds)
    logits = np.zeros((len(texts), len(families)))
    for k in range(4):
        w, b = _softmax_fit(x[fold != k], y[fold != k], len(families))
        logits[fold == k] = x[fold == k] @ w + b

    def soft(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    scale = min(np.linspace(0.25, 4, 16), key=lambda s: -np.log(soft(s * logits)[np.arange(len(y)), y] + 1e-12).mean())
    p = soft(scale * logits)[:, :-1]
    best, guess, other = p.max(axis=1), p.argmax(axis=1), y == len(families) - 1
    confirmed = np.array([template_similarity(t, families[g]) >= SIMILARITY for t, g in zip(texts, guess, strict=True)])

    def allowed(t: float) -> bool:
        named = best >= t
        return named[other].mean() <= 0.1 and (named & confirmed & (guess != y)).sum() <= 0.05 * (named & confirmed).sum()

    threshold = float(min((t for t in np.sort(best) if allowed(t)), default=1.0))
    w, b = _softmax_fit(x, y, len(families))
    w, b = np.round(w * scale, 6), np.round(b * scale, 6)
    return Model(families, tuple(b.tolist()), {g: tuple(w[i].tolist()) for g, i in place.items()}, threshold)


def _lookup(table: dict[str, object], value_type: str):
    """A column function from a key to its value: a constant array of small maps, picked by the key's hash."""
    n = 2 * len(table) + 1
    slots: list[dict] = [{} for _ in range(n)]
    for k, v in table.items():
        slots[zlib.crc32(k.encode()) % n][k] = v
    constant = F.from_json(F.lit(json.dumps(slots)), f"array<map<string,{value_type}>>")
    return lambda key: F.try_element_at(F.get(constant, (F.crc32(key.cast("binary")) % n).cast("int")), key)


def _gram_at(ws: Column, n: int):
    return lambda i: F.array_join(F.slice(ws, i + 1, n), " ")


def _grams_of(ws: Column, widths: tuple[int, ...]) -> Column:
    parts = []
    for n in widths:
        starts = F.when(F.size(ws) >= n, F.sequence(F.lit(0), F.size(ws) - n)).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(starts, _gram_at(ws, n)))
    return F.array_distinct(F.concat(*parts))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_paragraphs and notices for every row, without a join or a shuffle.

    A paragraph is a \\n-separated line, or several that are one wrapped notice: from a line with
    an anchor word to the next ones that have one, with at most two others between, none of
    them blank. Such a run is judged as a whole where none of its lines is a confirmed notice
    by itself, and stands for its lines if it is confirmed. notices holds, in text order, each
    paragraph that uses an anchor word: paragraph (0-based first line), n_lines, family
    (unknown where the best family's calibrated probability is under the model's threshold),
    probability (of that class), similarity and confirmed. similarity is the larger, over the family's templates, of the share of the
    template's word 3-grams in the paragraph and the share of the paragraph's in the template
    (2-grams or words where the template is shorter); a notice is confirmed from 0.6 on.

    The weights and templates are constants of the plan, as large as the built-in notices.
    Every paragraph of a text is judged, a paragraph at a time. Null text: 0 paragraphs and no
    notices; text without an anchor word: no notices; repeated rows repeat, an empty table
    gives none; a null id stays null; other columns are never read.
    """
    model = model or train()
    named = len(model.families) - 1
    weight = _lookup({g: list(w) for g, w in model.weights.items()}, "array<double>")
    templates: dict[str, list] = {}
    for f, ts in TEMPLATES.items():
        templates[f] = [{"n": n, "g": sorted(ngrams(ws, (n,)))} for ws in map(words, ts) for n in [min(3, len(ws))]]
    template = _lookup(templates, "array<struct<n:int,g:array<string>>>")
    bias = F.array(*map(F.lit, model.bias))
    names = F.array(*map(F.lit, model.families))
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).isNotNull().alias("_some"), text.alias("_t"))
    some = F.rlike("_t", F.lit(ANCHOR_PATTERN))
    out = out.withColumn("_l", F.split("_t", "\n", -1)).withColumn("_n", F.when(F.col("_some"), F.size("_l")).otherwise(0))
    hit = F.filter(F.transform("_l", lambda x, i: F.when(F.rlike(x, F.lit(ANCHOR_PATTERN)), i)), lambda i: i.isNotNull())
    span = lambda first, last: F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"))
    none = F.array().cast("array<struct<first:int,last:int>>")
    out = out.withColumn("_hit", F.when(some, hit).otherwise(F.array().cast("array<int>"))).drop("_t")
    goes_on = lambda last, i: (i - last <= 3) & ~F.exists(F.slice("_l", last + 1, i - last), lambda x: F.btrim(x, F.lit(" \t\r\v\f")) == "")
    runs = F.aggregate(
        "_hit",
        none,
        lambda acc, i: F.when((F.size(acc) > 0) & F.coalesce(goes_on(F.get(acc, F.size(acc) - 1)["last"], i), F.lit(False)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(span(F.get(acc, F.size(acc) - 1)["first"], i)))).otherwise(F.concat(acc, F.array(span(i, i)))),
    )
    out = out.withColumn("_runs", F.filter(runs, lambda r: r["last"] > r["first"]))
    spans = F.concat(F.transform("_hit", lambda i: span(i, i)), F.col("_runs"))
    ws = lambda r: F.regexp_extract_all(F.lower(F.array_join(F.slice("_l", r["first"] + 1, r["last"] - r["first"] + 1), " ")), F.lit(_WORD), 0)
    out = out.withColumn("_p", F.transform(spans, lambda r: F.struct(r.alias("paragraph"), ws(r).alias("ws")))).drop("_l", "_hit")
    out = out.withColumn("_p", F.transform("_p", lambda s: F.struct(s["paragraph"].alias("paragraph"), s["ws"].alias("ws"), F.filter(F.transform(_grams_of(s["ws"], (1, 2, 3)), weight), lambda w: w.isNotNull()).alias("w"))))
    logit = lambda s: F.transform(F.sequence(F.lit(0), F.lit(named)), lambda f: F.aggregate(s["w"], F.get(bias, f), lambda acc, w: acc + F.get(w, f)))
    out = out.withColumn("_p", F.transform("_p", lambda s: F.struct(s["paragraph"].alias("paragraph"), s["ws"].alias("ws"), logit(s).alias("z"))))
    out = out.withColumn("_p", F.transform("_p", lambda s: F.struct(s["paragraph"].alias("paragraph"), s["ws"].alias("ws"), F.transform(s["z"], lambda v: F.exp(v - F.array_max(s["z"]))).alias("e"))))
    out = out.withColumn("_p", F.transform("_p", lambda s: F.struct(s["paragraph"].alias("paragraph"), s["ws"].alias("ws"), F.transform(s["e"], lambda v: v / F.aggregate(s["e"], F.lit(0.0), lambda a, x: a + x)).alias("p"))))
    best = lambda s: F.array_max(F.slice(s["p"], 1, named))
    out = out.withColumn("_p", F.transform("_p", lambda s: F.struct(s["paragraph"].alias("paragraph"), s["ws"].alias("ws"), s["p"].alias("p"), F.when(best(s) >= model.threshold, F.get(names, (F.array_position(s["p"], best(s)) - 1).cast("int"))).otherwise(F.lit(UNKNOWN)).alias("family"))))

    def alike(s: Column) -> Column:
        def one(t: Column) -> Column:
            grams = [F.when(t["n"] == n, _grams_of(s["ws"], (n,))) for n in (1, 2, 3)]
            own = F.coalesce(*grams)
            both = F.size(F.array_intersect(own, t["g"]))
            return F.greatest(both / F.size(t["g"]), both / F.greatest(F.size(own), F.lit(1)))

        return F.array_max(F.transform(template(s["family"]), one))

    done = F.transform(
        "_p",
        lambda s: F.struct(
            s["paragraph"]["first"].alias("paragraph"),
            (s["paragraph"]["last"] - s["paragraph"]["first"] + 1).alias("n_lines"),
            s["family"].alias("family"),
            F.when(s["family"] == UNKNOWN, F.get(s["p"], F.lit(named))).otherwise(best(s)).alias("probability"),
            F.coalesce(alike(s), F.lit(0.0)).alias("similarity"),
        ),
    )
    out = out.withColumn("_all", F.transform(done, lambda s: s.withField("confirmed", s["similarity"] >= similarity)))
    within = lambda line, run: (line["paragraph"] >= run["paragraph"]) & (line["paragraph"] < run["paragraph"] + run["n_lines"])
    lines, joined = F.filter("_all", lambda s: s["n_lines"] == 1), F.filter("_all", lambda s: (s["n_lines"] > 1) & s["confirmed"])
    out = out.withColumn("_lines", lines).withColumn("_joined", joined).withColumn("_joined", F.filter("_joined", lambda r: ~F.exists("_lines", lambda x: within(x, r) & x["confirmed"])))
    out = out.withColumn("notices", F.array_sort(F.concat(F.filter("_lines", lambda x: ~F.exists("_joined", lambda r: within(x, r))), F.col("_joined"))))
    return out.select("doc_id", F.col("_n").cast("long").alias("n_paragraphs"), "notices")
