"""Licence scans with a trained paragraph classifier.

A multinomial logistic regression over sparse word 1- to 3-grams is trained in numpy, in a fixed way. Its classes are
licence families, `unknown` (a licence of no family) and `none`. Words outside the training vocabulary are one word and
numbers are another, so that "<word> Public License, version <number>" is a pattern of unknown licences. Training texts
are notices and sentences of the families' public texts, names of licences put into frames ("Released under the ..."),
other licences, made-up ones, and prose with single legal words in it. Frames, sentences and whole other licences are
dealt out into three parts: to train, to calibrate (a temperature, fitted on texts that training has not seen), and to
report on (`Model.report`: precision and recall of families, share of unseen licences found, calibration error).

A family is given where its calibrated probability is at least THRESHOLD and a comparison confirms it: one of its names
occurs in the paragraph, or a sufficient share of the paragraph's 2-grams occurs in one of its notices. Where licence
classes together reach THRESHOLD but no family does or is confirmed, the paragraph is of unknown class.

A paragraph ends at an empty line, behind a line that ends a sentence, and behind a line that is too short or too long
to have been wrapped. A paragraph with none of a few marker words is no licence; every training text of a licence has one
of them, and one scan of the text for them leaves few paragraphs to score.

Defined cases: null and empty texts have no paragraphs and no families; very long paragraphs are scored whole; repeated
rows and null ids give a row each; an empty table gives no rows; columns that the result also has must be renamed before.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tune

THRESHOLD = 0.5
CONFIRM = 0.6
WRAPPED = (40, 120)  # lengths of lines that may go on in the next

#: Names by which licences are referred to.
NAMES = {
    "MIT": ["MIT License", "MIT licence", "Expat License", "MIT/X11 License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0", "Apache Software License"],
    "GPL": ["GNU General Public License", "GNU General Public License, version 3", "GNU General Public License v2", "GPL version 3", "GPLv3", "GPLv2", "GNU GPL", "GPL-3.0-or-later", "GPL-2.0-only"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "LGPL version 3", "LGPLv3", "LGPLv2.1", "GNU LGPL", "LGPL-2.1-or-later"],
    "AGPL": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL version 3", "AGPLv3", "GNU AGPL", "AGPL-3.0-only"],
    "BSD": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "New BSD License", "Simplified BSD License", "Modified BSD license", "BSD-3-Clause", "BSD-style license"],
    "MPL": ["Mozilla Public License", "Mozilla Public License, v. 2.0", "Mozilla Public License, version 1.1", "MPL 2.0", "MPL-2.0"],
    "CC-BY": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "Creative Commons Attribution 3.0 Unported License", "CC BY 4.0", "CC BY 3.0", "CC-BY-4.0"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "Creative Commons Attribution-Share Alike 3.0 License", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA-4.0"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License", "Creative Commons Attribution-NonCommercial-NoDerivatives License", "CC BY-NC 4.0", "CC BY-NC-ND 4.0", "CC BY-NC-SA 4.0", "CC-BY-NC-4.0"],
    "CC0": ["CC0 1.0 Universal", "CC0 1.0", "CC0 Public Domain Dedication", "CC0-1.0"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "ISC": ["ISC License", "ISC licence"],
    "EPL": ["Eclipse Public License", "Eclipse Public License, version 2.0", "Eclipse Public License 1.0", "EPL-2.0", "EPL 2.0"],
}
#: Sentences of the families' public texts and usual notices.
SENTENCES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ],
    "Apache-2.0": [
        "you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Foundation under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
        "without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details.",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation", "See the GNU Lesser General Public License for more details.",
    ],
    "AGPL": [
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "You should have received a copy of the GNU Affero General Public License along with this program.",
        "See the GNU Affero General Public License for more details.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "The contents of this file are subject to the Mozilla Public License Version 1.1",
    ],
    "CC-BY": ["This is an open access article distributed under the Creative Commons Attribution License, which permits unrestricted use, distribution, and reproduction in any medium, provided the original work is properly cited.", "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"],
    "CC-BY-SA": ["Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.", "To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"],
    "CC-BY-NC": ["which permits non-commercial use under the Creative Commons Attribution-NonCommercial License, provided the original work is properly cited", "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary", "For more information, please refer to http://unlicense.org"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"],
    "proprietary": [
        "All rights reserved.", "Copyright. All rights reserved.", "All rights reserved worldwide.", "Copyright (c) 2020 by the author. All rights reserved.", "No part of this publication may be reproduced, stored or transmitted in any form without the prior written permission of the publisher.",
        "All rights reserved. No part of this work may be reproduced in any form without permission.", "This document is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "All trademarks and copyrights are the property of their respective owners, all rights reserved.",
    ],
}
FRAMES = [
    "Licensed under {}", "Distributed under the {}", "This project is licensed under the {}", "This software is released under the terms of the {}", "The code is made available under the {}", "See the {} for details",
    "Use of this file is governed by the {}", "You may use this file under the terms of the {}", "License: {}", "SPDX-License-Identifier: {}", "Published under the {}", "Content on this site is licensed under {}",
    "This library is covered by the {}", "The source is free under the {}", "Released under {}", "This work is made available under a {}", "Dual licensed under the {}", "This package is distributed under the same terms as the {}",
]
#: Other licences: names and sentences. Whole ones are kept from training.
OTHERS = [
    ("Boost Software License, Version 1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib License", "This software is provided 'as-is', without any express or implied warranty. Altered source versions must be plainly marked as such"),
    ("European Union Public Licence", "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission"),
    ("Artistic License 2.0", "This license establishes the terms under which a given free software package may be copied, modified and distributed"),
    ("Microsoft Public License", "This license governs use of the accompanying software. If you use the software, you accept this license"),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
    ("PostgreSQL License", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("SIL Open Font License, Version 1.1", "This Font Software is licensed under the SIL Open Font License"),
    ("Server Side Public License, version 1", "If you make the functionality of the program available to third parties as a service, you must make the service source code available"),
    ("Common Development and Distribution License", "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("Academic Free License version 3.0", "Licensed under the Academic Free License version 3.0"),
    ("Business Source License 1.1", "The Licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the Licensed Work"),
    ("Python Software Foundation License", "Licensee hereby grants a nonexclusive, royalty-free, world-wide license to reproduce, analyze, test, perform and prepare derivative works"),
    ("Universal Permissive License", "Subject to the condition set forth below, permission is hereby granted to any person obtaining a copy of this software"),
    ("Open Software License 3.0", "Licensed under the Open Software License version 3.0"),
]
MADE_UP = ["{} License", "{} License, Version {n}", "{} Public License", "{} Public License, version {n}", "{} Software License", "{} Open License v{n}", "{} Source Licence", "{} Community License {n}", "{} Permissive Licence", "{} Free License version {n}"]
#: Sentences with legal words that are no licence.
LEGAL_PROSE = [
    "The court granted permission to appeal", "He lost his driving license last year", "The warranty on the car has expired", "Copyright law is debated in parliament", "She applied for a license to sell wine", "the license of the house",
    "The ministry licensed three new banks", "They asked for permission to use the hall", "Public opinion changed after the vote", "The software is slow and the author knows it", "A general of the army spoke in public", "All seats are reserved for guests",
    "Rights of workers were discussed at the conference", "The patent office received a copy of the letter", "No part of the house was damaged", "The article discusses how licences are granted to fishermen", "A table was reserved under the name of the author",
    "Distribution of food began without restriction", "The provided documents were not sufficient", "His license plate was found in the river", "Free of charge entry is offered to children", "He may not use the kitchen without permission", "The library is open to the public",
    "Source code was shown on the screen", "Attribution of the painting is uncertain", "The eclipse was visible to the public", "A copy of the book was sold for a high price", "Creative people share common ideas", "The apache helicopter landed", "Students at MIT built a robot",
]
PROSE = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through years where much your way well down should because each just those people good very der die und das ist nicht ein eine zu mit sich auf dem den von le la les et des un une que qui dans pour pas sur el los las por con para como su".split()
#: Words of notices that prose has as well: no markers.
PLAIN = {*PROSE, *"under above form forms document library version software source program information public free code work works part uses used provided author include including general terms text".split()}
WORD = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*")
OTHER, NUMBER = "<w>", "<n>"


def tokens(paragraph: str) -> list[str]:
    return WORD.findall(paragraph.lower())


def pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def texts_by_part() -> list[list[tuple[str, str]]]:
    """(class, text) to train, to calibrate and to report on. Frames, sentences, other licences and prose are dealt out whole."""
    out: list[list[tuple[str, str]]] = [[], [], []]
    part = lambda i: (0, 0, 1, 0, 0, 2)[i % 6]
    for i, frame in enumerate(FRAMES):
        for family, names in NAMES.items():
            out[part(i)] += [(family, frame.format(n)) for n in names]
        for j, (name, _) in enumerate(OTHERS):
            if part(i) == part(j):
                out[part(i)].append(("unknown", frame.format(name)))
        for j, name in enumerate(MADE_UP):
            out[part(i)].append(("unknown", frame.format(name.format(f"Zq{chr(97 + i)}x{j}", n=1 + (i + j) % 9))))
    for family, sentences in SENTENCES.items():
        out[0] += [(family, s) for s in sentences]
    for j, (_, sentence) in enumerate(OTHERS):
        out[part(j)].append(("unknown", sentence))
    for j, sentence in enumerate(LEGAL_PROSE):
        out[part(j)].append(("none", sentence))
    return out


class Model:
    """columns: 1- to 3-gram -> column; weights (columns, classes)."""

    def __init__(self, seed: int = 0, rounds: int = 200):
        rng = np.random.default_rng(seed)
        train, calibrate, self.held = texts_by_part()
        self.names = ["none", "unknown", *SENTENCES]
        often = Counter(w for c, t in train for w in set(tokens(t)))
        # words of unknown licences' names count as any other word, or they would be learnt by heart
        names = {w for ns in NAMES.values() for n in ns for w in tokens(n)} | {w for ss in SENTENCES.values() for s in ss for w in tokens(s)}
        self.words = {w for w, n in often.items() if (n >= 2 and w in names) or w in PROSE}
        prose = lambda n: list(rng.choice(PROSE, n))
        data: list[tuple[str, list[str]]] = [(c, tokens(t)) for c, t in train]
        for c, ws in list(data):
            extra = [*prose(int(rng.integers(0, 8))), *["qzx"] * int(rng.integers(0, 5))]
            data.append((c, [*rng.permutation(extra).tolist(), *ws, *prose(int(rng.integers(0, 5)))]))
        for c, ss in SENTENCES.items():
            for s in ss:
                ws = tokens(s)
                for _ in range(6 if len(ws) > 9 else 1):  # pieces, as wrapped lines have them
                    n = int(rng.integers(min(len(ws), max(4, len(ws) // 2)), len(ws) + 1))
                    at = int(rng.integers(0, len(ws) - n + 1)) if len(ws) >= n else 0
                    data.append((c, ws[at : at + n]))
        legal = sorted(self.words - set(PROSE))
        for _ in range(900):
            ws = [*prose(int(rng.integers(3, 30))), *["qzx"] * int(rng.integers(0, 12)), *rng.choice(legal, int(rng.integers(0, 4)))]
            data.append(("none", rng.permutation(ws).tolist()))
        for word in ("license", "licence", "licensed", "licenses", "copyright", "permission", "warranty", "distribution"):
            for _ in range(40):  # one such word in prose is no licence
                ws = [*prose(int(rng.integers(3, 12))), *["qzx"] * int(rng.integers(0, 6)), word]
                data.append(("none", rng.permutation(ws).tolist()))
        found = Counter(g for _, ws in data for g in self.grams(ws))
        self.columns = {g: i for i, g in enumerate(sorted(g for g, n in found.items() if n >= 3))}
        x, y = self.matrix([ws for _, ws in data]), np.array([self.names.index(c) for c, _ in data])
        each = np.bincount(y, minlength=len(self.names))
        weight = (len(y) / len(each) / each[y])[:, None].astype(np.float32) ** 0.5
        want = np.eye(len(self.names), dtype=np.float32)[y]
        w = np.zeros((x.shape[1], len(self.names)), np.float32)
        first, second = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, rounds + 1):
            g = x.T @ (weight * (softmax(x @ w) - want)) / len(y) + 1e-4 * w
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            w -= 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        self.weights = w
        z, at = self.matrix([tokens(t) for _, t in calibrate]) @ w, np.array([self.names.index(c) for c, _ in calibrate])
        loss = lambda k: -np.log(softmax(z / k)[np.arange(len(at)), at] + 1e-12).mean()
        self.temperature = float(min((0.25 * 1.1**i for i in range(40)), key=loss))
        self.notices = {f: [pairs(tokens(s)) for s in ss] for f, ss in SENTENCES.items()}
        self.called = {f: [" ".join(tokens(n)) for n in ns] for f, ns in NAMES.items()}
        self.markers = self.choose_markers([tokens(t) for c, t in train if c != "none"])

    def choose_markers(self, texts: list[list[str]]) -> list[str]:
        """A few strings, none of them plain words, of which each text holds one; the most frequent first."""
        left, out = [" ".join(ws) for ws in texts], []
        while left:
            found = Counter(w for t in left for w in set(t.split()) if len(w) > 3 and w in self.words and w not in PLAIN)
            if not found:
                break
            out.append(min(found.items(), key=lambda x: (-x[1], x[0]))[0])
            left = [t for t in left if out[-1] not in t]
        return out

    def grams(self, words: list[str]) -> set[tuple[str, ...]]:
        ws = [w if w in self.words else NUMBER if w[0].isdigit() or (w[0] == "v" and w[1:2].isdigit()) else OTHER for w in words]
        out = {g for n in (1, 2, 3) for g in zip(*(ws[i:] for i in range(n)), strict=False)}
        return {g for g in out if not set(g) <= {OTHER, NUMBER}}

    def row(self, words: list[str]) -> list[int]:
        return sorted(self.columns[g] for g in self.grams(words) if g in self.columns)

    def matrix(self, texts: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.columns) + 1), np.float32)
        for i, ws in enumerate(texts):
            x[i, self.row(ws)] = 1
        x[:, -1] = 1
        return x

    def probabilities(self, words: list[str]) -> np.ndarray:
        return softmax(((self.weights[self.row(words)].sum(axis=0) + self.weights[-1]) / self.temperature)[None])[0]

    def likeness(self, family: str, words: list[str]) -> float:
        """1 where a name of the family occurs; else the share of the paragraph's 2-grams in its best notice, or of the notice's in the paragraph."""
        line = f" {' '.join(words)} "
        if any(f" {n} " in line for n in self.called.get(family, [])):
            return 1.0
        own = pairs(words)
        return max((len(own & t) / max(1, min(len(own), len(t))) for t in self.notices[family]), default=0.0)

    def predict(self, paragraph: str) -> tuple[str, float, float]:
        """(family, 'unknown' or 'none'), the probability of that, likeness to the best family."""
        ws = tokens(paragraph)
        if not ws or not self.row(ws):
            return "none", 1.0, 0.0
        p = self.probabilities(ws)
        best = int(p[2:].argmax()) + 2
        alike = self.likeness(self.names[best], ws)
        if p[best] >= THRESHOLD and alike >= CONFIRM:
            return self.names[best], float(p[best]), alike
        if p[1:].sum() >= THRESHOLD:
            return "unknown", float(p[1:].sum()), alike
        return "none", float(p[0]), alike

    def report(self) -> dict[str, float]:
        """On texts that neither training nor calibration has seen."""
        got = [(c, *self.predict(t)) for c, t in self.held]
        family = [g for g in got if g[0] not in ("none", "unknown")]
        said = [g for g in got if g[1] not in ("none", "unknown")]
        p = np.array([self.probabilities(tokens(t)) for _, t in self.held])
        top, right = p.max(axis=1), np.array([self.names[i] for i in p.argmax(axis=1)]) == np.array([c for c, _ in self.held])
        bins = np.minimum((top * 10).astype(int), 9)
        share = lambda hits, of: sum(hits) / max(1, len(of))
        return {
            "texts": len(got), "family_recall": share((g[0] == g[1] for g in family), family), "family_precision": share((g[0] == g[1] for g in said), said),
            "unseen_licences_unknown": share((g[1] == "unknown" for g in got if g[0] == "unknown"), [g for g in got if g[0] == "unknown"]),
            "prose_none": share((g[1] == "none" for g in got if g[0] == "none"), [g for g in got if g[0] == "none"]),
            "calibration_error": float(sum(abs(top[bins == b].mean() - right[bins == b].mean()) * (bins == b).mean() for b in set(bins.tolist()))), "temperature": self.temperature,
        }


@functools.cache
def model() -> Model:
    return Model()


def paragraphs(text: str) -> Iterator[str]:
    """Lines, put together where they look wrapped."""
    held = ""
    for line in text.split("\n"):
        s = line.strip()
        if not s:
            if held:
                yield held
            held = ""
            continue
        held = f"{held} {s}" if held else s
        if s[-1] in ".!?:;" or not WRAPPED[0] <= len(s) <= WRAPPED[1]:
            yield held
            held = ""
    if held:
        yield held


DDL = "paragraphs int, license_paragraphs int, unknown_paragraphs int, families string, probability double, similarity double, found array<struct<paragraph: string, family: string, probability: double, similarity: double>>"


def scan(documents: DataFrame) -> DataFrame:
    """documents with their licence paragraphs; its columns are kept and must include text."""
    tune(documents.sparkSession)
    names = ["paragraphs", "license_paragraphs", "unknown_paragraphs", "families", "probability", "similarity", "found"]
    if clash := sorted({c.lower() for c in documents.columns} & set(names)):
        raise ValueError(f"rename the columns {clash} first")
    at = documents.columns.index("text")
    share = documents.sparkSession.sparkContext.broadcast(model())
    kinds = [pa.int32()] * 3 + [pa.string(), pa.float64(), pa.float64(), pa.list_(pa.struct([("paragraph", pa.string()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = share.value
        seen: dict[str, tuple] = {}
        for b in batches:
            rows = []
            for t in b.column(at).to_pylist():
                ps, found = list(paragraphs(t or "")), []
                low = (t or "").lower()
                markers = [w for w in m.markers if w in low]
                for p in ps if markers else ():
                    own = p.lower()
                    if not any(w in own for w in markers):
                        continue
                    if p not in seen:
                        if len(seen) > 50_000:
                            seen.clear()
                        seen[p] = m.predict(p)
                    if seen[p][0] != "none":
                        found.append((p, *seen[p]))
                sure = [f for f in found if f[1] != "unknown"]
                rows.append((len(ps), len(sure), len(found) - len(sure), ",".join(sorted({f[1] for f in sure})), max((f[2] for f in sure), default=0.0), max((f[3] for f in sure), default=0.0), [dict(zip(("paragraph", "family", "probability", "similarity"), f, strict=True)) for f in found]))
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *names])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return documents.mapInArrow(run, f"{ddl}, {DDL}")


def op10(documents: DataFrame) -> DataFrame:
    return scan(documents.select("doc_id", "text")).drop("text", "found")
