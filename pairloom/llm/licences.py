"""Licence scan by Dice coefficient over word bigrams, in DataFrame operations only.

Lines, paragraphs, the whole text and, wherever they stand in it, runs of words that are neighbours in
templates too are normalised (lower case, words of
letters, digits and dots between digits, joined by one space) and compared with
the templates: 2 * |A n B| / (|A| + |B|) over their sets of word bigrams.  A
coefficient of d needs sizes within [d / (2 - d), (2 - d) / d] of each other, so
only templates within these bounds are compared, and at least d / (2 - d) of the
passage's bigrams in the template, so a passage with fewer in all templates
together is compared with none.

Defined results: null and empty texts have no passages and no licence; equal
coefficients go to the first licence by name; repeated rows each come out.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_APACHE = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."


def _gnu(name: str, version: str, either: str) -> tuple[str, ...]:
    """Header notices: the first paragraph, for this version or later ones, and all of it."""
    own = f"you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation"
    rest = f"is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License for more details. You should have received a copy of the GNU {name} Public License along with this program. If not, see https://www.gnu.org/licenses/."
    out = []
    for what in ("This program", "This library"):
        for first in (f"{what} is free software: {own}, {either}, or (at your option) any later version.", f"{what} is free software; {own}; version {version} of the License."):
            out += [first, f"{first} {what} {rest}"]
    return tuple(out)


#: Notices by which texts name their licence, and the standard header notices of longer licences.
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 " + _APACHE,
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", *_gnu("General", "2", "either version 2 of the License")),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", *_gnu("General", "3", "either version 3 of the License")),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", *_gnu("Lesser General", "3", "either version 3 of the License")),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", *_gnu("Affero General", "3", "either version 3 of the License")),
    "ISC": ("Released under the ISC License.",),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}


def _texts() -> dict[str, tuple[str, ...]]:
    """Each notice, and of the files of whole licences the text and, up to 300 words, its paragraphs of ten words or more."""
    out = dict(NOTICES)
    for file in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        paragraphs = [p for p in re.split(r"\n{2,}", text) if len(p.split()) >= 10] if len(text.split()) <= 300 else []
        if file.stem == "BSD-3-Clause":
            paragraphs = [p for p in paragraphs if p.startswith("3.")]  # the others are those of BSD-2-Clause
        out[file.stem] = (*out.get(file.stem, ()), text, *paragraphs)
    return out


TEMPLATES: dict[str, tuple[str, ...]] = _texts()
#: Licences whose whole text stands in another: they are listed, but the other is the licence of the document.
WITHIN = {"BSD-2-Clause": "BSD-3-Clause"}

_WORD = r"\p{L}+|\p{N}+(?:\.\p{N}+)*"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_WORD})"), F.lit(1))


def bigrams(items: Column) -> Column:
    """Distinct word bigrams; a single word stands for itself."""
    pairs = F.zip_with(F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))), F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.when(F.size(items) == 1, items).otherwise(pairs))


def _template_bigrams(text: str) -> list[str]:
    found = re.findall(r"[^\W\d_]+|\d+(?:\.\d+)*", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(found, found[1:], strict=False)} or set(found))


def _better(a: Column, b: Column) -> Column:
    """Higher scores first, then by licence and passage."""
    by_name = F.when(a["licence"] < b["licence"], -1).when(a["licence"] > b["licence"], 1).when(a["passage"] < b["passage"], -1).when(a["passage"] > b["passage"], 1)
    return F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(by_name.otherwise(0))


def scan_licences(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", templates: Mapping[str, Sequence[str]] | None = None, dice: float = 0.8) -> DataFrame:
    """(doc_id, licences array<struct<licence, score, passage>>, licence, score) for each row of `docs`.

    A passage counts for its best licence alone.  licences holds, for each licence found, its best score and the normalised
    passage; licence and score are the best of them (but not of a licence `WITHIN` another of them), null without any.
    """
    listed = sorted((name, grams) for name, texts in (templates or TEMPLATES).items() for grams in map(_template_bigrams, texts) if grams)
    factor = (2 - dice) / dice + 1e-9  # what stands exactly on a bound is compared
    most = int(max((len(g) for _, g in listed), default=0) * factor)  # distinct bigrams of a passage that can match
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    known = ", ".join(f"'{g}'" for g in sorted({g for _, grams in listed for g in grams})) or "''"  # words hold no quotes
    # a word goes on with the one before where templates have the two so; what is cut off so is a passage too
    linked = F.expr(f"transform(all_words, (w, i) -> concat(if(i > 0 and concat(get(all_words, i - 1), ' ', w) in ({known}), ' ', '\\n'), w))")
    runs = F.filter(F.split(F.array_join(linked, ""), "\n"), lambda r: r.contains(" "))
    passages = F.array_distinct(F.concat(F.split("body", r"\R"), F.split("body", r"\R{2,}"), F.array("body"), runs))
    worded = F.filter(F.transform(F.filter(passages, lambda p: F.length(p) > 0), words), lambda w: F.size(w) > 0)
    ready = F.filter(F.transform(worded, lambda w: F.struct(bigrams(w).alias("grams"), w.alias("words"))), lambda p: F.size(p["grams"]) <= most)
    near = F.expr(f"filter(ready, p -> size(filter(p.grams, g -> g in ({known}))) * {factor!r}D >= size(p.grams))")

    def score(passage: Column, template: list[str]) -> Column:
        size = F.size(passage["grams"])
        fits = (size * factor >= len(template)) & (size <= len(template) * factor)
        common = F.size(F.array_intersect(passage["grams"], F.split(F.lit("\n".join(template)), "\n")))
        return F.when(fits, 2.0 * common / (size + len(template)))

    def scores(passage: Column) -> Column:
        each = [F.struct(F.lit(name).alias("licence"), score(passage, template).alias("score"), F.array_join(passage["words"], " ").alias("passage")) for name, template in listed]
        return F.slice(F.array_sort(F.filter(F.array(*each), lambda s: s["score"] >= dice), _better), 1, 1)

    hits = F.flatten(F.transform(near, scores)) if listed else F.array().cast("array<struct<licence:string,score:double,passage:string>>")
    held = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body")).withColumn("all_words", words(F.col("body")))
    out = held.select("doc_id", ready.alias("ready")).select("doc_id", hits.alias("hits"))
    names = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["licence"])))
    best_of = lambda name: F.element_at(F.array_sort(F.filter("hits", lambda h: h["licence"] == name), _better), 1)
    out = out.select("doc_id", F.transform(names, best_of).alias("licences"))
    within = lambda h: F.coalesce(F.create_map(*(F.lit(x) for pair in WITHIN.items() for x in pair))[h["licence"]], F.lit(""))
    free = F.filter("licences", lambda h: ~F.array_contains(F.transform("licences", lambda x: x["licence"]), within(h)))
    top = F.when(F.size("licences") > 0, F.element_at(F.array_sort(free, _better), 1))
    return out.select("doc_id", "licences", top["licence"].alias("licence"), top["score"].alias("score"))
