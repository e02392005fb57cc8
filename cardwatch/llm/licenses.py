"""License scans: a paragraph classifier over word n-grams, an unknown class with a calibrated limit, and template comparison.

A paragraph is a line with a word. Its words are runs of letters and digits, lower-cased; its features are the shares of those
one- and two-word n-grams that the learned vocabulary holds, and the share of words outside it. A softmax regression over the license
families and "other" is trained by ``spark.ml`` on windows of the templates, with words dropped, and on lines of the corpus. The limit of the
winning probability is set on corpus lines kept apart: the smallest under which at most ``FALSE_SHARE`` of them are called a
license. A paragraph under the limit is unknown if all families together pass a limit set the same way. A prediction is confirmed if enough of the paragraph's
three-word strings (all words together, if fewer) occur in the family's templates. It is unknown if words in or beside it contradict the family:
a near license's word, a denial, another version, or none of the family's names in a short window.

A notice may stand beside other words: besides the whole line, its windows are judged the same way. A window is a run of three-word strings of
any template, and runs up to ``GAP`` strings apart together; it has a word of ``MARKS`` or eight words. A line gives one row per
family, the best: confirmed before not, then by probability. Limits are set on lines with their windows.

Learning takes every line of one half of the documents (by seeded hash of the key), and the limits every line of the other half; lines with half
of their three-word strings in a template are no examples of "other". Tasks add up lines of like features before they are stored; limits come from
running sums over the distinct probabilities. Sums of gradients are added as tasks end, so last digits of a score may differ between runs. Scoring reads every line of every text in one pass without a shuffle.

Edges: null, empty and blank texts have no paragraph: family none, score 0; long texts are read whole; equal scores go to the earlier
line, then to the family's name; null or repeated ids are scored like others; an empty table gives no rows; only key and text are read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from cardwatch.llm.common import table
from cardwatch.operators.running import running_sums
from cardwatch.runtime import stored

# Wording by which these licenses are declared, from their public texts.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file in the project root for full license information.",
        "This project is licensed under the terms of the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.",
    ],
    "GPL": [
        "Released under the GNU General Public License.",
        "Licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see "
        "https://www.gnu.org/licenses/.",
    ],
    "MPL-2.0": [
        "Released under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "Public-Domain": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or "
        "as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
# Warranty paragraphs of the full texts: they count for containment, but declare no license by themselves.
WARRANTIES = {
    "MIT": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "BSD": [
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED.",
    ],
    "GPL": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
}
#: sentences with the same words that declare nothing, beside lines of the corpus
OTHERS = [
    "The driver lost his license after the accident.", "You need a fishing license to use this lake.",
    "The copy was distributed to all members of the public.", "She was granted permission to use the software at work.",
    "Version 2.0 of the program was released in May.", "All rights reserved.", "See the file for more information.",
    "Apache helicopters were seen over the city.", "The University of California and MIT published the work.",
    "Terms and conditions apply to this offer.", "The foundation is free to modify the terms of the agreement.",
]
# Words of a family's name, words by which near licenses differ from it, words that deny.
NAMES = {
    "MIT": {"mit"}, "Apache-2.0": {"apache"}, "BSD": {"bsd"}, "GPL": {"gnu", "gpl"}, "MPL-2.0": {"mozilla", "mpl"},
    "CC-BY": {"creative", "creativecommons", "cc"}, "CC-BY-NC": {"creative", "creativecommons", "cc"},
    "Public-Domain": {"domain", "cc0", "unencumbered"},
}
NEAR = {
    "GPL": {"lesser", "affero", "library", "documentation", "lgpl", "agpl"}, "MPL-2.0": {"eclipse", "common", "artistic"},
    "CC-BY": {"noncommercial", "nc", "noderivatives", "noderivs", "nd"}, "CC-BY-NC": {"noderivatives", "noderivs", "nd"},
}
DENIED = {"not", "never", "no", "nor", "neither", "cannot", "isn", "wasn", "longer", "instead"}
#: families whose name holds a version: another number right after the notice is another license
VERSIONED = {"Apache-2.0", "MPL-2.0"}
FAMILIES = sorted(TEMPLATES)
NONE, UNKNOWN = "none", "unknown"
WORD = re.compile(r"[^\W_]+")
#: share of lines kept apart that may pass the limit, share of three-word strings a template must hold
FALSE_SHARE, CONTAINED = 0.0005, 0.6
#: words beside a window that may contradict it, words from which on a window needs no name
#: words of which a short window holds one, three-word strings between runs taken together
AROUND, WORDY = 4, 8
MARKS, GAP = {"license", "licensed", "mit", "apache", "bsd", "gnu", "mozilla", "creative", "spdx", "domain"}, 3
ROUNDS, RIDGE, COPIES = 100, 1e-4, 12
#: unlike lines a task holds before it hands their counts on
AT_ONCE = 50_000


def terms(text: str) -> list[str]:
    return WORD.findall(text.lower())


def strings(found: list[str]) -> set[tuple[str, ...]]:
    """Three-word strings, or all words together if there are fewer."""
    return {tuple(found[k:k + 3]) for k in range(max(len(found) - 2, 1))} if found else set()


def pieces(found: list[str]) -> list[str]:
    return found + [f"{a} {b}" for a, b in zip(found, found[1:], strict=False)]


#: three-word strings of every family, also of each template's short runs
HELD = {
    f: set().union(*(strings(terms(t)) for t in [*ts, *WARRANTIES.get(f, [])])) | {tuple(terms(t)) for t in ts} for f, ts in TEMPLATES.items()
}


#: those of all families
ANY = set().union(*HELD.values())


def spans(found: list[str]) -> list[tuple[int, int]]:
    """Parts of a line, short of the whole, that hold template strings: runs of them, and near runs together."""
    hits = [k for k, x in enumerate(zip(found, found[1:], found[2:], strict=False)) if x in ANY]
    parts = set()
    for gap in (1, GAP + 1):
        start = 0
        for k in range(1, len(hits) + 1):
            if k == len(hits) or hits[k] - hits[k - 1] > gap:
                parts.add((hits[start], hits[k - 1] + 3))
                start = k
    parts.discard((0, len(found)))
    return [(a, b) for a, b in sorted(parts) if b - a >= WORDY or not MARKS.isdisjoint(found[a:b])]


def windows(found: list[str]) -> list[list[str]]:
    return [found[a:b] for a, b in spans(found)]


def contradicted(found: list[str], a: int, b: int, family: str) -> bool:
    """Whether words in or beside the part of a line speak against the family that its words resemble.

    Words of the family's own templates are no contradiction where they stand in such a string.
    """
    inside = found[a:b]
    if len(inside) < WORDY and NAMES[family].isdisjoint(inside):
        return True
    hits = [k for k in range(max(a - 2, 0), b) if tuple(found[k:k + 3]) in HELD[family]]
    if not hits:
        return False
    own = {k + i for k in hits for i in range(3)}
    low, high = max(0, hits[0] - AROUND), hits[-1] + 3 + AROUND
    against = DENIED | NEAR.get(family, set())
    if any(found[k] in against for k in range(low, min(high, len(found))) if k not in own):
        return True
    after = hits[-1] + 3
    return family in VERSIONED and any(w.isdigit() and len(w) < 3 for w in found[after:after + 2])


def containment(found: list[str], family: str) -> float:
    own = strings(found)
    return len(own & HELD[family]) / len(own) if own else 0.0


class Classifier:
    """Softmax regression over the families and, last, "other". ``limit`` is the least probability of a family that counts,
    ``doubt`` the least of all families together. Its vocabulary is that of the license examples."""

    def __init__(self, examples: list[tuple[list[str], int]]):
        import numpy as np

        self.limit, self.doubt, self.vocabulary = 0.5, 0.5, {}
        for found, label in examples:
            if label < len(FAMILIES):
                for p in pieces(found):
                    self.vocabulary.setdefault(p, len(self.vocabulary))
        self.words = {p for p in self.vocabulary if " " not in p}
        self.weights = np.zeros((len(self.vocabulary) + 2, len(FAMILIES) + 1), np.float32)

    def known(self, found: list[str]) -> list[int]:
        """Columns of the one- and two-word n-grams that the vocabulary holds."""
        own, words = self.vocabulary, self.words
        inside = [w in words for w in found]
        pairs = [f"{found[k]} {found[k + 1]}" for k in range(len(found) - 1) if inside[k] and inside[k + 1]]
        return [own[w] for w, hit in zip(found, inside, strict=True) if hit] + [own[p] for p in pairs if p in own]

    def counted(self, found: list[str]) -> tuple[tuple[int, ...], int, int]:
        """What the features of a paragraph follow from: known n-grams, words, words outside; alike for all without a known word."""
        outside = sum(w not in self.words for w in found)
        return (tuple(sorted(self.known(found))), len(found), outside) if outside < len(found) else ((), 1, 1)

    def fit(self, lines: DataFrame, own: list[tuple[list[str], int]]) -> None:
        """Weights from ``own`` examples and lines (held, size, outside, n) that are "other"; every class weighs the same."""
        from collections import Counter

        import numpy as np
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import CountVectorizerModel, Interaction, VectorAssembler

        spark, other = lines.sparkSession, len(FAMILIES)
        times = Counter(label for _, label in own)
        times[other] += lines.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        listed = [(list(held), size, outside, 1, label) for (held, size, outside), label in ((self.counted(x), y) for x, y in own)]
        given = spark.createDataFrame(listed, "held array<int>, size int, outside int, n long, label int")
        each = F.element_at(F.array(*[F.lit(1.0 / max(times[k], 1)) for k in range(other + 1)]), F.col("label") + 1)
        rows = given.unionByName(lines.withColumn("label", F.lit(other))).select(
            F.col("label").cast("double").alias("label"), (F.col("n") * each).alias("weight"), F.col("held").cast("array<string>").alias("held"),
            (1 / F.sqrt("size")).alias("scale"), (3 * F.col("outside") / F.col("size")).alias("strange"))
        columns = [str(k) for k in range(len(self.vocabulary))]
        for stage in (
            CountVectorizerModel.from_vocabulary(columns, inputCol="held", outputCol="counts"),
            Interaction(inputCols=["scale", "counts"], outputCol="shares"),
            VectorAssembler(inputCols=["shares", "strange"], outputCol="features"),
        ):
            rows = stage.transform(rows)
        model = LogisticRegression(
            family="multinomial", regParam=RIDGE, standardization=False, weightCol="weight", maxIter=ROUNDS,
        ).fit(rows.select("features", "label", "weight"))
        found = model.coefficientMatrix.toArray().T
        self.weights = np.vstack([found[:-1], model.interceptVector.toArray()[None], found[-1:]]).astype(np.float32)

    def features(self, found: list[str]):
        """(column, value): shares of known n-grams scaled by the root of the length, a constant, the share of unknown words."""
        import math

        held = self.known(found)
        scale = 1 / math.sqrt(len(found))
        outside = sum(w not in self.words for w in found) / len(found)
        return [(at, scale) for at in held] + [(-2, 1.0), (-1, 3 * outside)]

    def predict(self, found: list[str]):
        """Probabilities of a paragraph's families and "other"; none of its words known is certainly other."""
        if self.words.isdisjoint(found):
            return None
        import numpy as np

        at, value = zip(*self.features(found), strict=True)
        return self.softmax(np.array(value, np.float32) @ self.weights[list(at)])

    @staticmethod
    def softmax(logits):
        import numpy as np

        p = np.exp(logits - logits.max())
        return p / p.sum()

    def scan(self, text: str | None):
        """(line, family, probability, containment, confirmed) of every line that is not other."""
        rows = []
        for line, body in enumerate((text or "").split("\n")):
            found = terms(body)
            if not found or self.words.isdisjoint(found):
                continue
            best: dict[str, tuple] = {}
            for a, b in [(0, len(found)), *spans(found)]:
                row = self.judge(line, found[a:b])
                if row and row[1] != UNKNOWN and contradicted(found, a, b, row[1]):
                    row = (line, UNKNOWN, row[2], row[3], False)
                if row and (row[1] not in best or (row[4], row[2]) > (best[row[1]][4], best[row[1]][2])):
                    best[row[1]] = row
            rows += [best[f] for f in sorted(best)]
        return rows

    def judge(self, line: int, found: list[str]):
        """(line, family, probability, containment, confirmed) of a part of a line, None if it is other."""
        p = self.predict(found)
        if p is None:
            return None
        best = int(p[:-1].argmax())
        if p[best] < self.limit:
            return (line, UNKNOWN, float(p[best]), 0.0, False) if 1 - p[-1] >= self.doubt else None
        share = containment(found, FAMILIES[best])
        return line, FAMILIES[best], float(p[best]), share, share >= CONTAINED


def template_examples(seed: int) -> list[tuple[list[str], int]]:
    """Templates, windows of them, and both with words dropped."""
    import random

    draw, found = random.Random(seed), []
    for label, family in enumerate(FAMILIES):
        for template in TEMPLATES[family]:
            own = terms(template)
            found.append((own, label))
            for _ in range(COPIES):
                size = draw.randint(min(5, len(own)), len(own))
                start = draw.randint(0, len(own) - size)
                window = own[start:start + size]
                kept = [w for w in window if draw.random() > 0.08]
                if set(kept) & MARKS or size >= 8:
                    found.append((kept or window, label))
    return found


def declares(found: list[str]) -> bool:
    """Whether half of a line's three-word strings or more stand in a family's templates: no example of "other"."""
    own = strings(found)
    return not own.isdisjoint(ANY) and any(2 * len(own & h) >= len(own) for h in HELD.values())


def corpus_lines(texts):
    """Words of every line of the texts that declares no license, and a few words from its start on."""
    import zlib

    for text in texts:
        for body in (text or "").split("\n"):
            found = terms(body)
            if found and not declares(found):
                yield found, found[:1 + zlib.crc32(body.encode("utf-8", "replace")) % 5]


def other_lines(docs: DataFrame, model: Classifier) -> DataFrame:
    """(held, size, outside, n) of all lines of docs that declare no license; a task adds up like ones."""

    def count(batches):
        from collections import Counter

        import pandas as pd

        def flushed():
            return pd.DataFrame([(*k, n) for k, n in total.items()], columns=["held", "size", "outside", "n"])

        total: Counter = Counter()
        for batch in batches:
            for both in corpus_lines(batch["text"]):
                total.update(map(model.counted, both))
                if len(total) > AT_ONCE:
                    yield flushed()
                    total.clear()
        if total:
            yield flushed()

    return stored(docs.select("text").mapInPandas(count, "held array<int>, size int, outside int, n long"), "license-lines")


def limits(docs: DataFrame, model: Classifier) -> tuple[float, float]:
    """The smallest limits, from 0.5 to 0.95, that at most ``FALSE_SHARE`` of all lines of docs pass: of the best family, of all together."""

    def judge(batches):
        """Number of lines (kind 2), and their probabilities that can matter (kinds 0 and 1) with how often each is met."""
        from collections import Counter

        import pandas as pd

        total: Counter = Counter()
        for batch in batches:
            for both in corpus_lines(batch["text"]):
                for found in both:
                    total[2, 0.0] += 1
                    judged = [p for part in [found, *windows(found)] if (p := model.predict(part)) is not None]
                    if judged:
                        for kind, value in enumerate((max(float(p[:-1].max()) for p in judged), max(float(1 - p[-1]) for p in judged))):
                            if value > 0.5 - 1e-6:
                                total[kind, value] += 1
            if total:
                yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["kind", "value", "n"])
                total.clear()

    met = stored(docs.select("text").mapInPandas(judge, "kind int, value double, n long"), "license-values")
    points = met.where("kind < 2").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    allowed = int(FALSE_SHARE * (met.where("kind = 2").agg(F.sum("n")).first()[0] or 0))
    run = running_sums(points, ["kind"], "value", ["n"], descending=True)
    found = dict(run.where(F.col("run_n") > allowed).groupBy("kind").agg(F.max("value")).collect())
    return tuple(min(0.95, max(0.5, found.get(kind, 0.0) + 1e-6)) if kind in found else 0.5 for kind in (0, 1))


def learn(docs: DataFrame, *, learn_rows: int | None = None, seed: int) -> Classifier:
    """Classifier of docs (doc_id, text): all lines of one half of the documents, by seeded hash, are examples of "other", all of the
    other half set the limits. A caller may bound each half to about ``learn_rows`` documents."""
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / F.lit(float(1 << 53))
    share = 0.5 if learn_rows is None else min(0.5, learn_rows / max(docs.count(), 1))
    own = template_examples(seed) + [(terms(t), len(FAMILIES)) for t in OTHERS]
    model = Classifier(own)
    model.fit(other_lines(docs.where(place < share), model), own)
    model.limit, model.doubt = limits(docs.where(place >= 1 - share), model)
    return model


def licenses(docs: DataFrame, model: Classifier, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and found: array of (line, family, probability, containment, confirmed)."""
    kind = docs.schema[key].dataType
    item = "struct<line:long,family:string,probability:double,containment:double,confirmed:boolean>"

    def scan(batches):
        import pandas as pd

        names = ("line", "family", "probability", "containment", "confirmed")
        for batch in batches:
            found = [[dict(zip(names, row, strict=True)) for row in model.scan(t)] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "found": found})

    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text"))
    scanned = rows.mapInPandas(scan, f"doc_id string, found array<{item}>")
    return scanned.select(F.col("doc_id").cast(kind).alias(key), "found")


def op2_licenses(spark, sf_dir: str, learn_rows: int | None = None) -> DataFrame:
    """Per document: the best confirmed family, else unknown, else none; its score and line, and the lines found."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses(docs, learn(docs, learn_rows=learn_rows, seed=42))
    order = lambda x: F.struct(
        (~x["confirmed"]).alias("later"), F.negative(x["probability"]).alias("less"), x["line"].alias("line"), x["family"].alias("family")
    )
    best = F.array_min(F.transform("found", order))
    return found.withColumn("best", best).select(
        "doc_id",
        F.when(F.col("best").isNull(), F.lit(NONE)).when(F.col("best.later"), F.lit(UNKNOWN)).otherwise(F.col("best.family")).alias("family"),
        F.coalesce(F.negative("best.less"), F.lit(0.0)).alias("score"), F.col("best.line").alias("line"),
        F.size("found").cast("long").alias("n_found"),
    )
