"""Licence scan: windows of a text against licence templates by the Dice coefficient of their word bigrams.

A text is taken as its words in lower case, runs of letters and digits; line ends and the marks of comments fall away
with the rest of the punctuation, so a notice may run over the lines of a comment. A template of n words is compared
with windows of n consecutive words: those that begin with one of its bigrams, and the one that ends the text. A text
of fewer words is one window. Sizes prune: a window of b distinct bigrams and a template of a have at most
2 min(a, b) / (a + b), so a template is a candidate only where the text holds two thirds of its bigrams, and a window
only where as many stand in it. Where windows that reach the coefficient overlap, the one with more bigrams in common
stays (then the larger coefficient, the earlier start, the smaller name): the words of one licence that are also in
another do not name the other. A few words of the templates are enough to tell that a text can match none
(``keywords``), so most texts are settled by one look at their words. All of it is column expressions over one row:
no join, no shuffle and no Python.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

DICE = 0.8
BESIDE = 6  # windows on either side that one is compared with first

# Notices and opening paragraphs of public licences.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "BSD-2-Clause": [
        "Released under the 2-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "BSD-3-Clause": [
        "Released under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used "
        "to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-ND-4.0": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
        "option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "LGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
    ],
}
# Words too common to tell a licence.
COMMON = frozenset("a and any are as at be by for from in is it may not of on or that the this to use with you".split())


def words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams(text: str) -> list[str]:
    found = words(text)
    return sorted({f"{a} {b}" for a, b in zip(found, found[1:])})


def size_bounds(size: int, dice: float = DICE) -> tuple[int, int]:
    """Fewest and most bigrams that a part may have to reach the coefficient with a template of ``size``."""
    return math.ceil(dice * size / (2 - dice) - 1e-9), math.floor((2 - dice) * size / dice + 1e-9)


def templates() -> list[tuple[str, int, int, list[str]]]:
    """``licence, number, words, bigrams`` of every template."""
    return [(name, number, len(words(text)), bigrams(text)) for name, texts in sorted(TEMPLATES.items()) for number, text in enumerate(texts)]


def keywords() -> list[str]:
    """Words one of which is in every part that matches a template.

    A match lacks at most a third of a template's bigrams; so many of its words are taken, those in most bigrams first,
    that more than a third hold one.
    """
    chosen: set[str] = set()
    for _, _, _, found in templates():
        left, needed = [g.split() for g in found], len(found) // 3 + 1
        telling = sorted({w for g in left for w in g} - COMMON)
        while len(found) - len(left) < needed:
            word = max(telling, key=lambda w: (w in chosen, sum(w in g for g in left)) if any(w in g for g in left) else (False, 0))
            chosen.add(word)
            left = [g for g in left if word not in g]
    return sorted(chosen)


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _telling() -> Column:
    return F.array(*map(F.lit, keywords()))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _windows(t: Column, grams: Column, at: Column, dice: float) -> Column:
    """Windows of one template that reach the coefficient; ``at`` lists the positions of bigrams of any template."""
    last = F.greatest(F.size(grams) - t["words"] + 1, F.lit(0))  # where the window that ends the text begins

    def window(start: Column) -> Column:
        stop = F.least(start + t["words"] - 2, F.size(grams) - 1)
        return _let(F.array_distinct(F.slice(grams, start + 1, stop - start + 1)), lambda g: _let(
            F.size(F.array_intersect(g, t["grams"])), lambda shared: F.struct(
                start.alias("start"), stop.alias("stop"), (-shared).alias("shared"),
                (-2.0 * shared / (F.size(g) + F.size(t["grams"]))).alias("dice"),
                t["license"].alias("license"), t["template"].alias("template"))))

    def found(own: Column) -> Column:
        # the position that completes the fewest bigrams a window needs must lie in the window
        near = F.filter(own, lambda x, i: (x["p"] <= last) & (F.try_element_at(own, i + t["least"])["p"] <= x["p"] + t["words"] - 2))
        starts = F.array_distinct(F.concat(F.transform(near, lambda x: x["p"]), F.array(last)))
        return F.filter(F.transform(starts, window), lambda w: w["dice"] <= -dice)

    return _let(F.filter(at, lambda x: F.array_contains(t["grams"], x["gram"])), found)


def _best(windows: Column) -> Column:
    """Windows that no better one overlaps: more bigrams in common, then the larger coefficient, the earlier start, names."""
    known = templates()
    # windows by their start: no more than this many begin within the length of one
    reach = max(n for _, _, n, _ in known) * len(known)

    def rank(w: Column) -> Column:
        return F.struct(w["shared"], w["dice"], w["start"], w["license"], w["template"])

    def beaten(every: Column, w: Column, i: Column, reach: int) -> Column:
        return F.exists(F.slice(every, F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + 1)),
                        lambda v: (v["start"] <= w["stop"]) & (w["start"] <= v["stop"]) & (rank(v) < rank(w)))

    # nearly all are beaten by one beside them; the others are compared with all that can overlap them
    return _let(F.array_sort(windows), lambda every: F.filter(
        every, lambda w, i: ~beaten(every, w, i, BESIDE) & ~beaten(every, w, i, reach)))


def scan(df: DataFrame, text: str = "text", out: str = "licenses", dice: float = DICE) -> DataFrame:
    """Add ``out``: array of struct ``license, template, dice, part`` for the windows that reach ``dice``.

    Sorted by licence, template and part, the words of the window. Null and empty texts, and texts without a match, give
    an empty array; a part that occurs more than once in a text counts once. A column named ``out`` is replaced; the
    other columns and repeated rows stay; an empty table gives an empty table.
    """
    prepare(df.sparkSession)
    known = F.array(*[F.struct(
        F.lit(name).alias("license"), F.lit(number).alias("template"), F.lit(n).alias("words"),
        F.lit(size_bounds(len(found), dice)[0]).alias("least"), F.array(*map(F.lit, found)).alias("grams"),
    ) for name, number, n, found in templates()])
    every = F.array(*map(F.lit, sorted({g for _, _, _, found in templates() for g in found})))

    def matches(w: Column, grams: Column, shared: Column) -> Column:
        near = F.filter(known, lambda t: F.size(F.array_intersect(shared, t["grams"])) >= t["least"])
        numbered = F.transform(grams, lambda g, i: F.struct(i.alias("p"), g.alias("gram")))
        found = _let(F.filter(numbered, lambda x: F.array_contains(shared, x["gram"])),
                     lambda at: F.flatten(F.transform(near, lambda t: _windows(t, grams, at, dice))))
        return F.transform(_best(found), lambda k: F.struct(
            k["license"].alias("license"), k["template"].alias("template"), (-k["dice"]).alias("dice"),
            F.array_join(F.slice(w, k["start"] + 1, k["stop"] - k["start"] + 2), " ").alias("part")))

    none = F.expr("cast(array() AS array<struct<license: string, template: int, dice: double, part: string>>)")

    def settled(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))
        found = _let(grams, lambda g: _let(F.array_intersect(g, every), lambda shared: matches(w, g, shared)))
        return F.when((F.size(w) > 1) & F.arrays_overlap(w, _telling()), F.array_sort(F.array_distinct(found))).otherwise(none)

    return df.withColumn(out, _let(F.split(_plain(F.coalesce(F.col(text), F.lit(""))), " "), settled))
