import random

from skyledger.llm import licenses


def dice(a: str, b: str) -> float:
    left, right = set(licenses.bigrams(a)), set(licenses.bigrams(b))
    return 2 * len(left & right) / (len(left) + len(right)) if left or right else 0.0


def scan(spark, texts):
    rows = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, licenses string")
    return {r["doc_id"]: r["licenses"] for r in licenses.scan(rows).collect()}


def test_every_template_finds_itself(spark):
    texts = [(name, text) for name, found in licenses.TEMPLATES.items() for text in found]
    found = scan(spark, ["Some words.\n" + text.upper() + "\nMore words." for _, text in texts])
    for i, (name, _) in enumerate(texts):
        assert any(m["license"] == name and m["dice"] == 1.0 for m in found[i])


def test_near_texts_and_other_texts(spark):
    notice = licenses.TEMPLATES["BSD-3-Clause"][1]
    texts = [notice.replace("binary forms", "binary form"), "We love the public and free software license.", None, "", "license",
             "a b " * 50_000 + "\nReleased under the MIT License.", "Wrapped:\n\n" + notice.replace(", with", ",\nwith") + "\n\nend"]
    found = scan(spark, texts)
    assert found[0][0]["license"] == "BSD-3-Clause" and abs(found[0][0]["dice"] - dice(texts[0], notice)) < 1e-12
    assert all(found[i] == [] for i in (1, 2, 3, 4))
    assert {m["license"] for m in found[5]} == {"MIT"} and {m["license"] for m in found[6]} == {"BSD-3-Clause"}
    assert licenses.scan(spark.createDataFrame([], "text string")).count() == 0


def test_bounds_and_keywords_lose_no_match():
    known = set(licenses.keywords())
    for _, _, _, grams in licenses.templates():
        size = len(grams)
        least, most = licenses.size_bounds(size)
        reach = [n for n in range(1, 5 * size) if 2 * min(n, size) / (n + size) >= licenses.DICE]
        assert (least, most) == (reach[0], reach[-1])
        assert sum(bool(known & set(g.split())) for g in grams) > size / 3


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU {1}General Public License as published by
the Free Software Foundation{2} either version {3} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_THIRD = """
3. Neither the name of {0} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
NOTICES = {
    "MIT": MIT, "GPL-3.0": GPL.format(":", "", ",", 3), "GPL-2.0": GPL.format(";", "", ";", 2),
    "LGPL-3.0": GPL.format(":", "Lesser ", ",", 3), "AGPL-3.0": GPL.format(":", "Affero ", ",", 3), "Apache-2.0": APACHE, "MPL-2.0": MPL,
    "LGPL-2.1": GPL.format(";", "Lesser ", ";", "2.1").replace("program", "library"),
    "BSD-2-Clause": BSD, "BSD-3-Clause": BSD + BSD_THIRD.format("the copyright holder"),
}


def test_notices_in_comments(spark):
    """Whole notices behind comment marks, in code: found, and named as nothing else."""
    cases = [(name, mark) for name in NOTICES for mark in ("# ", "// ", " * ", "")]
    texts = ["import os\n" + mark + "Copyright (c) 2020 Somebody\n" + "\n".join(mark + line for line in NOTICES[name].split("\n")) +
             "\n\ndef start(a, b):\n    return a + b\n" * 3 for name, mark in cases]
    found = scan(spark, texts)
    for i, (name, mark) in enumerate(cases):
        assert {m["license"] for m in found[i]} == {name}, (name, mark)
    company = scan(spark, ["// " + (BSD + BSD_THIRD.format("Example Works Inc.")).replace("\n", "\n// ")])
    assert {m["license"] for m in company[0]} == {"BSD-3-Clause"}


def test_two_licences_of_one_family_in_one_text(spark):
    between = " ".join(f"word{i}" for i in range(60))
    found = scan(spark, [NOTICES["GPL-2.0"] + between + NOTICES["GPL-3.0"], NOTICES["BSD-3-Clause"] + between + NOTICES["BSD-2-Clause"],
                         (NOTICES["GPL-3.0"] + between) * 30])
    assert {m["license"] for m in found[0]} == {"GPL-2.0", "GPL-3.0"}
    assert {m["license"] for m in found[1]} == {"BSD-2-Clause", "BSD-3-Clause"}
    assert {m["license"] for m in found[2]} == {"GPL-3.0"}


def brute(text):
    """Every window of every template, then those that no better one overlaps."""
    told = licenses.words(text)
    pairs = [f"{a} {b}" for a, b in zip(told, told[1:])]
    hits = []
    for name, number, n, grams in licenses.templates():
        last = max(len(told) - n, 0)
        for first in range(last + 1) if pairs else ():
            window = set(pairs[first:first + n - 1])
            dice = 2 * len(window & set(grams)) / (len(window) + len(grams))
            if dice >= licenses.DICE and (pairs[first] in grams or first == last):
                final = min(first + n - 2, len(pairs) - 1)
                hits.append((-len(window & set(grams)), -dice, first, name, number, final))
    kept = [w for w in hits if not any(v[2] <= w[5] and w[2] <= v[5] and v[:5] < w[:5] for v in hits)]
    return sorted({(name, number, -dice, " ".join(told[first:final + 2])) for _, dice, first, name, number, final in kept})


def test_scan_equals_all_windows(spark):
    draw = random.Random(3)
    notices = [text for found in licenses.TEMPLATES.values() for text in found]
    texts = ["SPDX-License-Identifier", "SPDX-License-Identifier: Zlib", "the License"]
    for _ in range(60):
        told = []
        for text in draw.sample(notices, 3):
            told += [w for w in licenses.words(text) if draw.random() > 0.06] + [draw.choice("the license of a b".split()) for _ in range(draw.randrange(9))]
        texts.append(" ".join(told))
    found = scan(spark, texts)
    for i, text in enumerate(texts):
        assert [tuple(m) for m in found[i]] == brute(text)
