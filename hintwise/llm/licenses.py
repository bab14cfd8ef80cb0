"""Licence scans: Dice coefficients of word bigrams between passages and licence templates.

A passage is a run of as many words as the template has, wherever it lies: across line ends, inside a sentence, in
the middle of a text. Words are normalised, so comment signs and punctuation do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hintwise.llm.common import let, lower_ascii

# fixed values: notices as licensors ask for them, and the texts of short licences; a user passes more
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."
    ),
    "mit": "Released under the MIT License",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "mit-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License "
        "for more details."
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
    "all-rights-reserved": "All rights reserved",
}
LEAST = 0.8
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MATCH = "array<struct<start:int,words:int,license:string,dice:double>>"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), NOT_WORD), "")


def bigrams(words: Column) -> Column:
    """Pairs of neighbouring words in order; none of fewer than two words."""
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", words[i], words[i + 1])))


def _plain_words(text: str) -> list[str]:
    import re

    return [w for w in re.split(NOT_WORD, text.translate({c: c + 32 for c in range(65, 91)})) if w]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """(doc_id, matches), one row per input row: passages whose Dice coefficient with a template is
    at least ``least``, as (start, words, license, dice), by start, then in the order of the templates. The start counts words.

    A passage has the template's number of words, or is the whole of a shorter text. It begins with a word pair of the
    template, or as late as it can. Of passages of one template that overlap, those stay that no better one overlaps, the
    earlier one being better if they are alike.

    A coefficient of t needs t / (2 - t) of a template's word pairs at least. A text that holds fewer of them is not compared
    with that template, and one that holds none of any template is put aside by one look-up. Null and empty texts have no
    match. Repeated rows give repeated results, other columns are ignored. Texts are read whole. No shuffle.
    """
    sets = {}
    for name, text in (TEMPLATES if templates is None else templates).items():
        w = _plain_words(text)
        if len(w) > 1:
            sets[name] = (len(w), sorted({f"{a} {b}" for a, b in zip(w, w[1:])}))
    if not sets:
        return docs.select("doc_id", F.array().cast(MATCH).alias("matches"))
    every = F.array(*map(F.lit, sorted({g for _, s in sets.values() for g in s})))
    needed = {name: least * len(s) / (2 - least) - 1e-9 for name, (_, s) in sets.items()}
    none = F.array().cast(MATCH)

    def against(name: str, grams: Column) -> Column:
        m, s = sets[name]
        own = F.array(*map(F.lit, s))
        last = F.greatest(F.size(grams) - (m - 1), F.lit(0))

        def dice(at: Column) -> Column:
            return let(F.array_distinct(F.slice(grams, at + 1, m - 1)), lambda a: F.struct(
                at.alias("start"), F.least(F.size(grams) + 1, F.lit(m)).alias("words"), F.lit(name).alias("license"),
                (2.0 * F.size(F.array_intersect(own, a)) / (F.size(a) + len(s))).alias("dice")))

        starts = F.array_distinct(F.transform(F.filter(
            F.sequence(F.lit(0), F.size(grams) - 1), lambda i: F.array_contains(own, F.get(grams, i))), lambda i: F.least(i, last)))
        found = F.filter(F.transform(starts, dice), lambda x: x["dice"] >= least)
        return let(found, lambda f: F.filter(f, lambda x: ~F.exists(f, lambda y: (F.abs(y["start"] - x["start"]) < m) & (
            (y["dice"] > x["dice"]) | ((y["dice"] == x["dice"]) & (y["start"] < x["start"])))))).cast(MATCH)

    def of_grams(grams: Column) -> Column:
        def of_shared(shared: Column) -> Column:
            each = [F.when(F.size(F.array_intersect(F.array(*map(F.lit, s)), shared)) >= needed[name], against(name, grams)).otherwise(none)
                    for name, (_, s) in sets.items()]
            order = {name: i for i, name in enumerate(sets)}
            place = F.create_map(*[F.lit(x) for item in order.items() for x in item])
            return F.array_sort(F.concat(*each), lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(
                place[x["license"]] - place[y["license"]]))

        return let(F.array_intersect(every, grams), lambda shared: F.when(
            F.size(shared) >= min(needed.values()), of_shared(shared)).otherwise(none))

    grams = let(_words(F.coalesce("text", F.lit(""))), bigrams)
    return docs.select("doc_id", let(grams, lambda g: F.when(F.size(g) > 0, of_grams(g)).otherwise(none)).alias("matches"))
