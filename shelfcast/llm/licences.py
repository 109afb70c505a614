"""Licence notices in texts: a trained classifier of word windows, confirmed by comparison with templates.

DataFrame operations and MLlib's JVM estimators only. Paragraphs are the sentences of every line that hold a cue word or a
family's name. Windows of ``WINDOWS`` words slide over them, so a notice inside prose has windows of its own; those with a
cue are hashed to sparse word 1- and 2-grams. A multinomial logistic regression names their family or "unknown". A family
is accepted above the score that ``FALSE_RATE`` of the held-back unknown rows reach, and confirmed by the longest
run of the window's word pairs in one template: ``RUN`` pairs, or most of the template, or most of the paragraph.

Training rows are crops of the templates below and a bounded sample of the corpus's own lines as unknown.
"""

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.common import bounded_sample
from shelfcast.session import materialize

#: Notices by family, as their publishers word them; sentences that several licences share are in OTHERS.
TEXTS = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
}
#: How notices name a family after "under", and its SPDX identifiers.
NAMES = {
    "apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache License", "the Apache 2.0 License", "Apache License 2.0", "Apache 2.0", "Apache v2"),
    "bsd": ("the BSD 3-Clause License", "the BSD 2-Clause License", "the BSD License", "a BSD-style license", "the 3-Clause BSD License", "BSD 3-Clause", "BSD"),
    "cc-by": ("a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0", "the CC BY 4.0 license", "CC BY 4.0", "CC BY", "CC-BY-4.0", "CC-BY 4.0"),
    "cc-by-nc": ("a Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0", "the CC BY-NC 4.0 license", "CC BY-NC 4.0", "CC BY-NC", "CC-BY-NC-4.0", "CC-BY-NC 4.0"),
    "cc-by-sa": ("a Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0", "the CC BY-SA 4.0 license", "CC BY-SA 4.0", "CC BY-SA", "CC-BY-SA-4.0", "CC-BY-SA 4.0"),
    "cc0": ("CC0 1.0 Universal", "the CC0 1.0 license", "CC0 1.0", "CC0"),
    "gpl": ("the GNU General Public License, version 3", "the GNU General Public License", "the GNU GPL version 3", "the GNU GPL", "the GPL", "the GPL v3", "GPL v3", "GPL v2", "GPLv3", "GPLv2", "GPL version 2", "GPL-3.0"),
    "lgpl": ("the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License", "the GNU LGPL", "the LGPL", "LGPL v3", "LGPL v2.1", "LGPLv3", "LGPL-2.1"),
    "mit": ("the MIT License", "the terms of the MIT License", "an MIT license", "MIT license", "MIT"),
    "mpl-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the Mozilla Public License", "the MPL 2.0", "MPL 2.0", "MPL v2", "MPL-2.0"),
}
SPDX = {
    "apache-2.0": "Apache-2.0", "bsd": "BSD-3-Clause BSD-2-Clause", "cc-by": "CC-BY-4.0 CC-BY-3.0", "cc-by-nc": "CC-BY-NC-4.0", "cc-by-sa": "CC-BY-SA-4.0 CC-BY-SA-3.0", "cc0": "CC0-1.0",
    "gpl": "GPL-3.0-or-later GPL-3.0-only GPL-2.0-or-later GPL-2.0-only", "lgpl": "LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-or-later LGPL-3.0-only", "mit": "MIT", "mpl-2.0": "MPL-2.0",
}
VERBS = ("Licensed", "Released", "Distributed", "Available", "Published", "This work is licensed", "This project is released", "This software is distributed")
#: What a window is compared with: publishers' texts, names and identifiers.
TEMPLATES = {f: (*TEXTS[f], *(f"under {n}" for n in NAMES[f]), *(f"SPDX-License-Identifier: {i}" for i in SPDX[f].split())) for f in TEXTS}
#: Paragraphs that speak of licences and rights without being a notice of a family.
OTHERS = (
    "All rights reserved.",
    "Copyright 2020 by the authors.",
    "Please read the license before you continue.",
    "You need a license to drive a car in this country.",
    "The product comes with a warranty of two years.",
    "Contact the publisher for permission to copy this text.",
    "A licence fee is due for each copy of the software.",
    "The book is now in the public domain.",
    "Her driving license was renewed under the new version of the law.",
    "The general public is free to use the work and the library.",
    "This software is provided as is, without warranty of any kind, express or implied.",
    "In no event shall the authors or copyright holders be liable for any claim, damages or other liability.",
    "Licensed under the GNU Affero General Public License, version 3.",
    "Licensed under CC BY-ND 4.0.",
    "Licensed under CC BY-NC-SA 4.0.",
)
CUE = (
    r"(?i)licen[cs]|copyright|\bcc[ -]by|\bcc0\b|spdx|creative commons|public domain|permission|redistribut|warrant|all rights reserved"
    r"|\ba?l?gpl|\bmpl\b|\bbsd\b|\bapache\b|\bunder\s+(?:the\s+|an?\s+)?mit\b"
)
#: Words of the windows; a paragraph with no more is classified whole.
WINDOWS = (6, 12, 24)
#: Pairs in a row that confirm a family by themselves.
RUN = 6
FEATURES, SAMPLE_DOCS = 1 << 13, 2_000
FALSE_RATE, CONFIRMED = 0.01, 0.6
UNKNOWN = "unknown"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:[.-][a-z0-9]+)*"), F.lit(0))


def _pairs(words: Column) -> Column:
    n = F.size(words)
    return F.when(n < 2, words).otherwise(F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b)))


def _features(df: DataFrame) -> DataFrame:
    """Hashed terms of the column words."""
    df = df.withColumn("pairs", _pairs(F.col("words")))
    terms = df.withColumn("terms", F.concat("words", "pairs"))
    return HashingTF(inputCol="terms", outputCol="features", numFeatures=FEATURES, binary=True).transform(terms)


def paragraphs(text: Column) -> Column:
    """Sentences that hold a cue, of all lines."""
    lines = F.filter(F.split(text, r"\n+"), lambda p: p.rlike(CUE))
    parts = F.flatten(F.transform(lines, lambda p: F.split(p, r"(?<=[.!?;])\s+")))
    return F.when(text.rlike(CUE), F.filter(parts, lambda p: p.rlike(CUE))).otherwise(F.array().cast("array<string>"))


def _windows(words: Column) -> Column:
    """Windows (first place, words) of every size in WINDOWS, a third of their size apart and one at the end; shorter rows are one."""
    n = F.size(words)

    def cut(size: int) -> Column:
        last = F.greatest(n - size + 1, F.lit(1))
        starts = F.array_distinct(F.concat(F.sequence(F.lit(1), last, F.lit(size // 3)), F.array(last)))
        return F.transform(starts, lambda a: F.struct(a.alias("first"), F.slice(words, a, size).alias("words")))

    return F.filter(F.array_distinct(F.concat(*map(cut, WINDOWS))), lambda w: F.array_join(w["words"], " ").rlike(CUE))


def _longest_run(pairs: str, template: str) -> str:
    """SQL: length and last place of the longest row of neighbours in ``pairs`` that all occur in ``template``."""
    return f"""aggregate({pairs}, named_struct('now', 0, 'i', 0, 'run', 0, 'stop', 0),
        (a, x) -> named_struct('now', IF(array_contains({template}, x), a.now + 1, 0), 'i', a.i + 1,
            'run', IF(array_contains({template}, x) AND a.now + 1 > a.run, a.now + 1, a.run),
            'stop', IF(array_contains({template}, x) AND a.now + 1 > a.run, a.i + 1, a.stop)))"""


class Classifier:
    """A fitted model, its families in the order of its labels, and the score from which a family is accepted."""

    def __init__(self, model, families: list[str], limit: float):
        self.model, self.families, self.limit = model, families, limit

    def probabilities(self, featured: DataFrame) -> DataFrame:
        scored = self.model.transform(featured).withColumn("p", vector_to_array("probability"))
        known = F.slice("p", 2, len(self.families) - 1)
        names = F.array(*map(F.lit, self.families[1:]))
        return scored.withColumn("score", F.array_max(known)).withColumn("family", F.element_at(names, F.array_position(known, F.array_max(known)).cast("int")))


def fit(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    families = [UNKNOWN, *sorted(TEMPLATES)]
    named = {f: [f"{v} under {n}." for v in VERBS for n in NAMES[f]] for f in NAMES}
    rows = [(t, families.index(f)) for f, texts in TEMPLATES.items() for t in (*texts, *named[f])] + [(t, 0) for t in OTHERS]
    notices = spark.createDataFrame(rows, "paragraph string, label int").select("label", _words(F.col("paragraph")).alias("w"))
    n, longest = F.size("w"), F.lit(max(WINDOWS))
    sizes = F.sequence(F.least(n, F.lit(4)), F.least(n, longest))
    crops = notices.select("label", "w", F.explode(sizes).alias("k")).select("label", "w", "k", F.explode(F.sequence(F.lit(1), n - F.col("k") + 1)).alias("a"))
    crops = crops.select(F.slice("w", F.col("a"), F.col("k")).alias("words"), "label")
    # A crop of the others that a family's notice holds too does not speak against the family.
    crops = crops.where(F.col("label") > 0).union(crops.where(F.col("label") == 0).join(crops.where(F.col("label") > 0).select("words").distinct(), "words", "left_anti"))
    lines = F.filter(F.split(F.col(text_col), r"\n+"), lambda p: (F.length(p) > 0) & ~p.rlike(CUE))
    sample = bounded_sample(docs.where(F.col(text_col).isNotNull()).select(id_col, text_col), id_col, SAMPLE_DOCS)
    prose = sample.select(F.explode(F.slice(lines, 1, 3)).alias("paragraph")).select(_words(F.col("paragraph")).alias("words"), F.lit(0).alias("label"))
    # A full notice counts as twenty crops.
    whole = notices.select(F.col("w").alias("words"), "label", F.lit(20).alias("weight"))
    every = _features(whole.union(crops.union(prose).withColumn("weight", F.lit(1))))
    every = materialize(every.select("features", "label", "weight", F.pmod(F.xxhash64("words"), F.lit(5)).alias("fold")), "licence-training")
    model = LogisticRegression(family="multinomial", maxIter=60, regParam=1e-3, weightCol="weight").fit(every.where(F.col("fold") > 0))
    bare = Classifier(model, families, 0.5)
    held = bare.probabilities(every.where((F.col("fold") == 0) & (F.col("label") == 0)))
    top = held.agg(F.percentile("score", 1 - FALSE_RATE, F.col("weight"))).first()[0]
    return Classifier(model, families, max(0.5, top or 0.0))


def find(docs: DataFrame, classifier: Classifier, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_paragraphs (sentences with a cue), n_notices (those with a confirmed window), families (confirmed
    ones, sorted, comma-joined; "unknown" if paragraphs with a cue were none of them; null without one), score (highest of
    a confirmed notice).

    Whole texts are searched. Null and empty texts have no paragraph. Null and repeated ids are rows like others; an empty
    table gives no rows; other columns are not read. Paragraphs with a cue are written once, with a key of their row. Of
    confirmed windows of one paragraph whose runs overlap, the longer run decides the family: lgpl is not gpl too.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("doc_id"), paragraphs(text).alias("found"))
    rows = materialize(rows, "licence-paragraphs")
    each = rows.select("key", F.posexplode("found").alias("place", "paragraph")).select("key", "place", _words(F.col("paragraph")).alias("all"))
    each = each.select("key", "place", F.size("all").alias("n_words"), F.explode(_windows(F.col("all"))).alias("w"))
    featured = _features(each.select("key", "place", "n_words", "w.first", "w.words"))
    templates = spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "of string, template string")
    templates = templates.groupBy("of").agg(F.collect_list(_pairs(_words(F.col("template")))).alias("tps"))
    accepted = classifier.probabilities(featured).where(F.col("score") >= classifier.limit).drop("features", "p", "terms", "rawPrediction", "probability", "prediction")
    runs = F.expr(f"transform(tps, tp -> named_struct('r', {_longest_run('pairs', 'tp')}, 'n', size(tp)))")
    enough = F.expr(
        f"""filter(runs, x -> x.r.run > 0 AND (x.r.run >= {RUN} OR x.r.run >= {CONFIRMED} * x.n OR x.r.run >= {CONFIRMED} * (n_words - 1)))"""
    )
    judged = accepted.join(templates, F.col("family") == F.col("of")).withColumn("runs", runs).withColumn("best", F.array_max(F.transform(enough, lambda x: F.struct(x["r"]["run"], x["r"]["stop"]))))
    stop = F.col("first") + F.col("best")["stop"]
    span = F.struct("family", "score", F.col("best")["run"].alias("run"), (stop - F.col("best")["run"] - 1).alias("start"), stop.alias("stop"))
    by_paragraph = judged.where(F.col("best").isNotNull()).groupBy("key", "place").agg(F.collect_list(span).alias("hits"))
    clear = F.expr("filter(hits, h -> NOT exists(hits, o -> o.family != h.family AND o.start < h.stop AND h.start < o.stop AND (o.run > h.run OR (o.run = h.run AND o.score > h.score))))")
    by_row = by_paragraph.withColumn("hits", clear).groupBy("key").agg(
        F.count("*").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits.family")))), ",").alias("named"),
        F.max(F.array_max("hits.score")).alias("score"),
    )
    out = rows.withColumn("n_paragraphs", F.size("found").cast("long")).drop("found").join(by_row, "key", "left")
    families = F.coalesce("named", F.when(F.col("n_paragraphs") > 0, F.lit(UNKNOWN)))
    return out.select("doc_id", "n_paragraphs", F.coalesce("n_notices", F.lit(0)).alias("n_notices"), families.alias("families"), "score")
