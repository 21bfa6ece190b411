"""Licence scans by sparse TF-IDF cosine to templates, with inheritance along paths, in built-in functions only.

A text that holds a licence word is cut into lines and sentences. Every run of up to WINDOW of these pieces with a
licence word, wrapped notices and comment blocks included, and every such text as a whole is compared with the templates
over the templates' terms, weighted by their inverse document frequency over all files. A file that is a licence text as
a whole gives its licence to its directory. A file without a licence of its own takes that of its nearest ancestor
directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import heavy_keys, join_heavy, written

# Short forms of licence notices, several a licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("proprietary", "All rights reserved."),
]
DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_3 = BSD_2 + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
GNU_FULL = GNU + " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see http://www.gnu.org/licenses/."
#: Versions of the GNU licences: label, name, version, abbreviation.
GNU_LICENCES = [
    ("GPL-2.0", "General Public License", "2", "GPL"), ("GPL-3.0", "General Public License", "3", "GPL"), ("LGPL-2.0", "Library General Public License", "2", "LGPL"), ("LGPL-2.1", "Lesser General Public License", "2.1", "LGPL"),
    ("LGPL-3.0", "Lesser General Public License", "3", "LGPL"), ("AGPL-3.0", "Affero General Public License", "3", "AGPL"),
]
#: Creative Commons licences, each in versions 3.0 and 4.0.
CC_LICENCES = [
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
]
#: Names in short notices and identifiers.
NAMED = [
    ("Apache-2.0", "Apache License 2.0"), ("MIT", "MIT License"), ("MPL-2.0", "Mozilla Public License 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD", "BSD License"),
    ("ISC", "ISC License"), ("Unlicense", "Unlicense"), ("CC0-1.0", "CC0 1.0 Universal License"),
]
TEMPLATES += [(name, f"{verb} under the {title}.") for name, title in NAMED for verb in ("Licensed", "Released", "This work is licensed")]
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in ("Apache-2.0", "MIT", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "CC0-1.0", *(x[0] for x in GNU_LICENCES))]
TEMPLATES += [(name, form) for name, title, version, short in GNU_LICENCES for form in (
    f"This work is licensed under the GNU {title}, version {version}.", f"Released under the GNU {title} v{version}.", f"Licensed under the {short} version {version}.", f"Licensed under {short}v{version}.",
    GNU.format(title, version), GNU_FULL.format(title, version),
)]
TEMPLATES += [(f"CC-{kind}-{version}", form) for kind, title in CC_LICENCES for version in ("3.0", "4.0") for form in (
    f"Licensed under CC {kind} {version}.", f"SPDX-License-Identifier: CC-{kind}-{version}", f"This work is licensed under a Creative Commons {title} {version} International License.",
    f"This work is licensed under the Creative Commons {title} {version} International License. To view a copy of this license, visit http://creativecommons.org/licenses/{kind.lower()}/{version}/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
)]
TEMPLATES += [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", BSD_2), ("BSD-2-Clause", f"{BSD_2} {DISCLAIMER}"), ("BSD-3-Clause", BSD_3), ("BSD-3-Clause", f"{BSD_3} {DISCLAIMER}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. Licensed under CC0 1.0 Universal."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
]
#: Terms that tell licences and their versions apart, with what they stand for.
MARKS = {x: [x] for x in ("1", "2", "3", "4", "nc", "sa", "nd", "lesser", "library", "affero", "endorse")} | {
    "v1": ["1"], "v2": ["2"], "v3": ["3"], "v4": ["4"], "gplv2": ["2"], "gplv3": ["3"], "lgpl": ["lesser"], "lgplv2": ["lesser", "2"], "lgplv3": ["lesser", "3"], "agpl": ["affero"], "agplv3": ["affero", "3"],
    "noncommercial": ["nc"], "commercial": ["nc"], "sharealike": ["sa"], "alike": ["sa"], "noderivatives": ["nd"], "noderivs": ["nd"], "derivatives": ["nd"], "derivs": ["nd"],
}
_KINDS = {"SA", "NC", "ND"}
#: Marks that a candidate must have, and that it must not have, to be called so.
RULES = {
    "Apache-2.0": (["2"], []), "MPL-2.0": (["2"], []), "GPL-2.0": (["2"], ["lesser", "affero"]), "GPL-3.0": (["3"], ["lesser", "affero"]), "LGPL-2.0": (["2"], ["1", "affero"]), "LGPL-2.1": (["lesser", "2", "1"], ["affero"]),
    "LGPL-3.0": (["lesser", "3"], ["affero"]), "AGPL-3.0": (["affero", "3"], ["lesser"]), "BSD-2-Clause": (["2"], ["endorse"]),
} | {f"CC-{k}-{v}.0": ([v, *(x.lower() for x in k.split("-")[1:])], [x.lower() for x in sorted(_KINDS - set(k.split("-")))]) for k, _ in CC_LICENCES for v in "34"}
#: Wordings that another licence's notice may hold too: named after all others (a reservation of rights: 0).
GENERAL = {"proprietary": 0, "BSD": 1}
BARE_BSD = 9  # the template of the two lines that all BSD licences begin with

#: A candidate holds one of these words; every template does.
TRIGGER = r"(?i)\b(licen[sc]ed?|unlicen[sc]e|spdx|public\s+domain|copyright|permission|redistribut\w+|rights\s+reserved|free\s+software|creative\s+commons)\b"
#: Pieces of a candidate at most; the longest notice has about 40 in narrow lines.
WINDOW = 64
#: Pieces end with a line or a sentence.
PIECE = r"[\r\n]+|(?<=[.!?])[\"')]*\s+"


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: t != "")


def _templates(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(k).alias("template"), F.lit(name).alias("licence"), F.lit(text).alias("wording")) for k, (name, text) in enumerate(TEMPLATES)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _rank(k: int) -> int:
    return 1 if k == BARE_BSD else GENERAL.get(TEMPLATES[k][0], 2)


def _bits(marks: list[str]) -> int:
    """Marks as the bits of a number."""
    known = sorted({x for own in MARKS.values() for x in own})
    return sum(1 << known.index(x) for x in marks)


def _rules(spark: SparkSession) -> DataFrame:
    """template, rank, must, never."""
    text = "array<string>"
    marks = lambda k, name: F.array(*map(F.lit, RULES.get(name, ([], []))[k])).cast(text)
    rows = [F.struct(F.lit(k).alias("template"), F.lit(_rank(k)).alias("rank"), marks(0, name).alias("must"), marks(1, name).alias("never")) for k, (name, _) in enumerate(TEMPLATES)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def term_weights(files: DataFrame, templates: DataFrame, text_col: str = "text") -> DataFrame:
    """term, idf of the templates' terms: 1 + ln((1 + files) / (1 + files with the term)), over all files."""
    vocabulary = templates.select(F.explode(F.array_distinct(_terms(F.col("wording")))).alias("term")).distinct()
    known = [r["term"] for r in vocabulary.collect()]  # the templates are fixed and few
    # one pass; only the templates' terms leave a file
    words = F.array_intersect(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^a-z0-9]+"), F.array(*map(F.lit, sorted(known))))
    seen = files.select(F.explode(F.concat(F.array(F.lit("")), words)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    seen = written(seen, "licence-term-counts")
    total = seen.where("term = ''").select(F.col("n").alias("files"))
    counted = vocabulary.join(F.broadcast(seen.where("term <> ''")), "term", "left")  # at most the templates' terms
    return counted.join(F.broadcast(total), how="left").select("term", (1 + F.log((1 + F.coalesce("files", F.lit(0))) / (1 + F.coalesce("n", F.lit(0))))).alias("idf"))


def _covered(words: DataFrame, top: float, least: float) -> DataFrame:
    """key, n (the piece's place, from 1), licence_word, words, reach, cover of the pieces in runs worth judging.

    reach is the last piece of such a run that begins here, or null; cover the last piece of those that hold this one.
    Only runs that can't reach `least` are left out: a cosine of c asks that the terms outside the templates weigh at
    most 1 / c^2 - 1 of those inside (squared), a term weighs at least `top` each time, and the inner norm of a run is
    at most the sum of its pieces'.
    """
    known = F.col("idf").isNotNull()
    sums = words.groupBy("key", "piece").agg(
        F.max(F.col("licence_word").cast("int")).alias("licence_word"), F.sum(F.when(~known, F.col("tf") * top * top).otherwise(0.0)).alias("outer"), F.sqrt(F.sum(F.when(known, F.pow(F.col("tf") * F.col("idf"), F.lit(2))).otherwise(0.0))).alias("inner"),
        F.collect_list(F.struct("term", "tf", "idf")).alias("words"),
    )
    order = Window.partitionBy("key").orderBy("piece")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = {c: F.col(c) for c in ("licence_word", "outer", "inner")}
    placed = sums.select("key", "piece", "words", *own.values(), F.row_number().over(order).alias("n"), *(F.sum(c).over(before).alias(f"{c}_so_far") for c in own))
    following = F.collect_list(F.struct("n", *(F.col(f"{c}_so_far").alias(c) for c in own))).over(order.rowsBetween(Window.currentRow, WINDOW - 1))
    # a run's sums: the totals up to its end, less those up to its first piece, and that piece's own
    of = lambda x, c: x[c] - F.col(f"{c}_so_far") + own[c]
    fits = lambda x: (of(x, "licence_word") > 0) & (of(x, "outer") <= (1 / least**2 - 1) * F.pow(of(x, "inner"), F.lit(2)) + 1e-6)
    reach = F.array_max(F.transform(F.filter(following, fits), lambda x: x["n"]))
    runs = placed.select("key", "piece", "n", "licence_word", "words", reach.alias("reach"))
    covers = F.max("reach").over(order.rowsBetween(1 - WINDOW, Window.currentRow))
    return runs.select("key", "n", "licence_word", "words", "reach", covers.alias("cover")).where("cover >= n")


def _best_runs(words: DataFrame, patterns: DataFrame, top: float, least: float) -> DataFrame:
    """key, hit (rank, similarity, order: less the template) of the best run from each piece that begins one.

    Runs and words are never paired. A run's products with the templates are the sums of its pieces', and its squared
    norm the sum of its pieces' squares and of their products with each piece before in it: both are added up piece by
    piece. A piece meets at most WINDOW - 1 pieces before it, so the work is in proportion to the text.
    patterns: term, tws (a weight for each template, over the template's norm).
    """
    pieces = _covered(words, top, least)
    place = Window.partitionBy("key", "term").orderBy("n").rangeBetween(1 - WINDOW, -1)
    terms = pieces.select("key", "n", "licence_word", "reach", "cover", F.inline("words"))
    terms = terms.withColumn("earlier", F.collect_list(F.struct("n", "tf", "cover")).over(place)).withColumn("square", F.pow(F.coalesce("idf", F.lit(top)), F.lit(2)) * F.col("tf"))
    met = F.transform(F.filter("earlier", lambda x: x["cover"] >= F.col("n")), lambda x: F.struct((F.col("n") - x["n"]).alias("back"), (2 * F.col("square") * x["tf"]).alias("product")))
    own = F.array(F.struct(F.lit(0).alias("back"), (F.col("square") * F.col("tf")).alias("product")))
    bits = F.coalesce(F.create_map(*[x for t, m in MARKS.items() for x in (F.lit(t), F.lit(_bits(m)))])[F.col("term")], F.lit(0))
    terms = terms.join(F.broadcast(patterns), "term", "left").select("key", "n", "licence_word", "reach", bits.alias("bits"), F.when(F.col("idf").isNotNull(), F.struct((F.col("tf") * F.col("idf")).alias("hw"), "tws")).alias("share"), F.inline(F.concat(own, met)))
    shares = F.collect_list(F.when(F.col("back") == 0, F.col("share")))
    sums = terms.groupBy("key", "n", "back").agg(F.sum("product").alias("product"), F.max("licence_word").alias("licence_word"), F.max("reach").alias("reach"), F.bit_or("bits").alias("bits"), shares.alias("shares"))
    sums = sums.groupBy("key", "n").agg(F.collect_list(F.struct("back", "product")).alias("products"), F.max("licence_word").alias("licence_word"), F.max("reach").alias("reach"), F.bit_or("bits").alias("bits"), F.flatten(F.collect_list("shares")).alias("shares"))
    none = F.array_repeat(F.lit(0.0), len(TEMPLATES))
    dots = F.aggregate("shares", none, lambda s, x: F.zip_with(s, x["tws"], lambda a, b: a + x["hw"] * b))
    vectors = sums.select("key", "n", "licence_word", "reach", "bits", "products", dots.alias("dots"))

    names = [name for name, _ in TEMPLATES]
    ranks, must, never = (F.array(*map(F.lit, x)) for x in ([_rank(k) for k in range(len(names))], *([_bits(RULES.get(name, ([], []))[k]) for name in names] for k in (0, 1))))
    close = lambda a, dot: dot >= (least - 1e-6) * F.sqrt(a["square"])  # noqa: E731  before rounding

    def judged(a: Column) -> Column:
        """The best hit after the run that `a` holds."""
        similar = lambda dot: F.round(dot / F.sqrt(a["square"]), 9)
        called = lambda k: (a["bits"].bitwiseAND(must[k]) == must[k]) & (a["bits"].bitwiseAND(never[k]) == 0)
        hits = F.transform(a["dots"], lambda dot, k: F.when(close(a, dot) & called(k) & (similar(dot) >= least), F.struct(ranks[k].alias("rank"), similar(dot).alias("similarity"), (-k).alias("order"))))
        return F.when((a["licence_word"] > 0) & close(a, F.array_max(a["dots"])), F.greatest(a["hit"], F.array_max(hits))).otherwise(a["hit"])

    def longer(a: Column, x: Column) -> Column:
        """The run in `a` is judged, then piece x is added."""
        added = F.aggregate(F.filter(x["products"], lambda p: p["back"] <= x["n"] - F.col("n")), F.lit(0.0), lambda s, p: s + p["product"])
        return F.struct(
            F.zip_with(a["dots"], x["dots"], lambda p, q: p + q).alias("dots"), (a["square"] + added).alias("square"), a["bits"].bitwiseOR(x["bits"]).alias("bits"), (a["licence_word"] + x["licence_word"]).alias("licence_word"),
            judged(a).alias("hit"),
        )

    start = F.struct(none.alias("dots"), F.lit(0.0).alias("square"), F.lit(0).alias("bits"), F.lit(0).alias("licence_word"), F.lit(None).cast("struct<rank: int, similarity: double, order: int>").alias("hit"))
    following = F.collect_list(F.struct("n", "licence_word", "bits", "products", "dots")).over(Window.partitionBy("key").orderBy("n").rowsBetween(Window.currentRow, WINDOW - 1))
    runs = vectors.select("key", "n", "reach", following.alias("next")).where("reach is not null")
    hit = F.aggregate(F.filter("next", lambda x: x["n"] <= F.col("reach")), start, longer, judged)
    return runs.select("key", hit.alias("hit")).where("hit is not null")


def detect(files: DataFrame, least: float = 0.8, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Every row of files: doc_id, path, licence (or null), similarity, whole (the file is a licence text).

    A candidate's terms outside the templates weigh as much as the rarest term inside them. A hit must have
    its licence's marks (version, kind) and none of others. Of a file's hits, a licence goes before a wording that others
    share and a mere reservation of rights, the file as a whole before its parts, then the higher similarity, then the
    first template. Null and empty texts have no licence.
    """
    spark = files.sparkSession
    templates = _templates(spark)
    weights = F.broadcast(written(term_weights(files, templates, text_col), "licence-terms"))  # the templates' terms
    top = float(weights.agg(F.max("idf")).first()[0])

    pattern = templates.select("template", "licence", F.explode(_terms(F.col("wording"))).alias("term")).groupBy("template", "licence", "term").agg(F.count("*").alias("tf")).join(weights, "term")
    pattern = pattern.select("template", "licence", "term", (F.col("tf") * F.col("idf")).alias("tw"))
    norms = pattern.groupBy("template", "licence").agg(F.sqrt(F.sum(F.pow("tw", F.lit(2)))).alias("norm")).join(F.broadcast(_rules(spark)), "template")
    # written: read again by every join
    pattern, norms = written(pattern, "licence-patterns"), written(norms, "licence-norms")
    meant = F.create_map(*[x for t, m in MARKS.items() for x in (F.lit(t), F.array(*map(F.lit, m)))])
    texts = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("held", F.rlike("text", F.lit(TRIGGER)))
    rows = written(texts.select("doc_id", "path", F.when(F.col("held"), F.unhex(F.md5("text"))).alias("key"), F.when(F.col("held"), F.col("text")).alias("text")), "licence-rows")
    # equal texts are judged once
    held = rows.where("key is not null")
    judged = written(held.groupBy("key").agg(F.first("text").alias("text")), "licence-texts")
    # only texts are dealt, by key: what follows of a text is grouped where it lies, and made anew where it is needed twice
    dealt = judged.repartition("key")

    def weighed(terms: DataFrame, part: list[str]) -> DataFrame:
        """The columns `part`, term, tf, idf."""
        return terms.groupBy(*part, "term").agg(F.count("*").alias("tf")).join(weights, "term", "left")

    def hits(vectors: DataFrame, part: list[str]) -> DataFrame:
        """The columns `part`, template, licence, rank, similarity of vectors: part, term, tf, idf."""
        sums = vectors.groupBy(*part, "term").agg((F.sum("tf") * F.coalesce(F.first("idf"), F.lit(top))).alias("hw"), F.first("idf").isNotNull().alias("known"))
        sums = written(sums, "licence-vectors")
        lengths = sums.groupBy(*part).agg(F.sqrt(F.sum(F.pow("hw", F.lit(2)))).alias("hnorm"), F.flatten(F.collect_set(F.element_at(meant, F.col("term")))).alias("marks"))
        dots = sums.where("known").join(F.broadcast(pattern), "term").groupBy(*part, "template").agg(F.sum(F.col("hw") * F.col("tw")).alias("dot"))
        near = dots.join(lengths, part).join(F.broadcast(norms), "template").where((F.size(F.array_except("must", "marks")) == 0) & ~F.arrays_overlap("never", "marks"))
        return near.select(*part, "template", "licence", "rank", F.round(F.col("dot") / (F.col("hnorm") * F.col("norm")), 9).alias("similarity")).where(F.col("similarity") >= least)

    texts = dealt.select("key", F.explode(_terms(F.col("text"))).alias("term"))
    whole = written(hits(weighed(texts, ["key"]), ["key"]).select("key", "template", "licence", "rank", "similarity", F.lit(True).alias("whole")), "licence-whole")
    # the parts of a file that is a licence as a whole would not be asked
    open_texts = dealt.join(whole.where("rank = 2").select("key").distinct(), "key", "left_anti")
    pieces = open_texts.select("key", F.posexplode(F.split("text", PIECE)).alias("piece", "wording")).withColumn("licence_word", F.rlike("wording", F.lit(TRIGGER)))
    words = weighed(pieces.select("key", "piece", "licence_word", F.explode(_terms(F.col("wording"))).alias("term")), ["key", "piece", "licence_word"])
    weight = F.map_from_entries(F.collect_list(F.struct("template", F.col("tw") / F.col("norm"))))
    patterns = pattern.join(F.broadcast(norms.select("template", "norm")), "template").groupBy("term").agg(weight.alias("tws"))
    patterns = patterns.select("term", F.transform(F.sequence(F.lit(0), F.lit(len(TEMPLATES) - 1)), lambda k: F.coalesce(F.col("tws")[k], F.lit(0.0))).alias("tws"))
    best = _best_runs(words, written(patterns, "licence-term-patterns"), top, least).groupBy("key").agg(F.max("hit").alias("hit"))
    parts = best.select("key", (-F.col("hit.order")).alias("template"), "hit.rank", "hit.similarity").join(F.broadcast(norms.select("template", "licence")), "template")
    parts = parts.select("key", "template", "licence", "rank", "similarity", F.lit(False).alias("whole"))
    order = F.struct("rank", "whole", "similarity", (-F.col("template")).alias("order"), "licence")
    own = written(whole.unionByName(parts).groupBy("key").agg(F.max(order).alias("hit")).select("key", "hit.licence", "hit.similarity", "hit.whole"), "licence-hits")
    copies = held.groupBy("key").agg(F.count("*").alias("n"))
    found = join_heavy(held.select("key", "doc_id", "path"), own, ["key"], heavy_keys(copies, ["key"])).select("doc_id", "path", "licence", "similarity", F.coalesce("whole", F.lit(False)).alias("whole"))
    return found.unionByName(rows.where("key is null").select("doc_id", "path", F.lit(None).cast("string").alias("licence"), F.lit(None).cast("double").alias("similarity"), F.lit(False).alias("whole")))


def parents(path: Column) -> Column:
    """All directories of a path, the nearest first, the root "" last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scan(files: DataFrame, least: float = 0.8, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """doc_id, path, own_licence, similarity, licence_file, inherited_from, licence for every row of files.

    A directory's licence is that of its licence texts: the most frequent, then the first by name. Files without a path
    lie in the root. Repeated rows have a row each.
    """
    source = files.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.col(text_col).alias("text"))
    found = written(detect(source, least, id_col="doc_id"), "licences")

    folder = F.element_at(parents(F.col("path")), 1)
    given = found.where("whole and licence is not null").groupBy(folder.alias("folder"), "licence").agg(F.count("*").alias("n"))
    first = given.groupBy("folder").agg(F.min_by("licence", F.struct(-F.col("n"), F.col("licence"))).alias("folder_licence"))
    # every directory that holds files is resolved once, then the files take its answer
    folders = written(found.groupBy(folder.alias("of")).agg(F.count("*").alias("n")), "licence-folders")
    chain = folders.select("of", F.posexplode(F.concat(F.array("of"), F.when(F.col("of") != "", parents(F.col("of"))).otherwise(F.array().cast("array<string>")))).alias("steps", "folder"))
    nearest = chain.join(first, "folder").groupBy("of").agg(F.min(F.struct("steps", "folder", "folder_licence")).alias("near"))
    with_folder = join_heavy(found.withColumn("of", folder), written(nearest, "licence-nearest"), ["of"], heavy_keys(folders, ["of"]))
    inherits = F.col("licence").isNull()
    return with_folder.select(
        "doc_id", "path", F.col("licence").alias("own_licence"), "similarity", F.col("whole").alias("licence_file"),
        F.when(inherits, F.col("near.folder")).alias("inherited_from"), F.coalesce("licence", F.col("near.folder_licence")).alias("licence"),
    )
