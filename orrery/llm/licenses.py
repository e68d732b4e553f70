"""Licence scan: normalised text against licence templates by Dice over word bigrams.

A unit of text is a line, a paragraph of several lines (between lines without words) or a whole
text of several paragraphs. Its bigrams, with repeats, are compared to those of each template:
Dice = 2 * shared / (bigrams of the unit + bigrams of the template). Dice of ``threshold`` or more
needs sizes within a factor of (2 - threshold) / threshold, so units and templates of other sizes
are never compared, and a posting list of the templates' bigrams leaves those that share one.

Beside these units any run of words is compared, wherever it begins or ends in lines, sentences
and paragraphs (unit ``run``). A nearest run begins and ends with a bigram of its template and has
as many of them as the least fitting size, which the posting list finds. Of overlapping runs the
nearest stands, of equally near ones the longest; one that overlaps a unit found is left out where that has the same licence or is
as near.

Normalised: lower-case A-Z, everything but letters, digits and non-ASCII characters as white
space. Of several templates over the threshold a unit goes to the nearest, of equal ones to the
first by name.

Defined results: null text and text without words give no rows; repeated rows and null ids have
rows of their own; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, pairwise
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
FOUND = "doc_id long, license string, unit string, start_line long, end_line long, dice double"

#: Notices and short texts of common licences, and whether they let text be reused
#: for any purpose.
TEMPLATES: dict[str, tuple[bool, list[str]]] = {
    "0BSD": (True, [
        "Released under the BSD Zero Clause License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ]),
    "AGPL-3.0": (False, [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3.",
    ]),
    "Apache-2.0": (True, [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ]),
    "BSD-2-Clause": (True, [
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ]),
    "BSD-3-Clause": (True, [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ]),
    "BSL-1.0": (True, ["Distributed under the Boost Software License, Version 1.0.", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"]),
    "CC-BY-4.0": (True, ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."]),
    "CC-BY-NC-4.0": (False, ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."]),
    "CC-BY-NC-ND-4.0": (False, ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."]),
    "CC-BY-NC-SA-4.0": (False, ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."]),
    "CC-BY-ND-4.0": (False, ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."]),
    "CC-BY-SA-3.0": (False, ["Licensed under CC BY-SA 3.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."]),
    "CC-BY-SA-4.0": (False, ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."]),
    "CC0-1.0": (True, ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."]),
    "EPL-2.0": (False, ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"]),
    "GPL-2.0": (False, [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ]),
    "GPL-3.0": (False, [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ]),
    "ISC": (True, ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."]),
    "LGPL-2.1": (False, [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ]),
    "LGPL-3.0": (False, [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ]),
    "MIT": (True, [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ]),
    "MPL-2.0": (False, ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."]),
    "MS-PL": (True, ["This code is released under the Microsoft Public License (Ms-PL)."]),
    "Unlicense": (True, ["This is free and unencumbered software released into the public domain."]),
    "Zlib": (True, ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"]),
}

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() or c == 10 else 32 for c in range(256))


def normalised(text: bytes) -> bytes:
    """The text as words and line ends."""
    return text.translate(_TABLE)


class Matcher:
    """Templates with their bigrams, sizes and posting lists."""

    def __init__(self, templates: dict[str, tuple[bool, list[str]]], threshold: float):
        self.threshold = threshold
        self.names, self.bags, self.sizes = [], [], []
        for name in sorted(templates):
            for t in templates[name][1]:
                bag = Counter(pairwise(normalised(t.encode()).split()))
                self.names.append(name)
                self.bags.append(bag)
                self.sizes.append(sum(bag.values()))
        self.posting: dict[tuple[bytes, bytes], list[int]] = {}
        for i, bag in enumerate(self.bags):
            for gram in bag:
                self.posting.setdefault(gram, []).append(i)
        self.firsts = {gram[0] for gram in self.posting}
        ratio = threshold / (2 - threshold)
        self.fits = [{i for i, m in enumerate(self.sizes) if ratio * m <= n <= m / ratio} for n in range(int(max(self.sizes) / ratio) + 2)]

    def best(self, words: list[bytes]) -> tuple[float, str] | None:
        """Dice and name of the nearest template at or over the threshold."""
        n = len(words) - 1
        if n < 1 or n >= len(self.fits) or not self.fits[n] or self.firsts.isdisjoint(words):
            return None
        mine = Counter(pairwise(words))
        near = {i for g in mine for i in self.posting.get(g, ())} & self.fits[n]
        scored = [(2 * sum(min(k, self.bags[i][g]) for g, k in mine.items()) / (n + self.sizes[i]), self.names[i]) for i in near]
        scored = [s for s in scored if s[0] >= self.threshold]
        return min(scored, key=lambda s: (-s[0], s[1])) if scored else None

    def scan(self, text: bytes) -> list[tuple[str, str, int, int, float]]:
        """(license, unit, first line, last line + 1, dice) of each unit that matches."""
        lines = [x.split() for x in normalised(text).split(b"\n")]
        found = []

        def look(unit: str, a: int, b: int, words: list[bytes]) -> None:
            if hit := self.best(words):
                found.append((hit[1], unit, a, b, hit[0]))

        longest = len(self.fits) + 1
        parts, a = [], None
        for i, words in enumerate([*lines, []]):
            if words:
                look("line", i, i + 1, words)
                a = i if a is None else a
            elif a is not None:
                parts.append((a, i))
                a = None
        for a, b in parts:
            if b - a > 1 and sum(map(len, lines[a:b])) <= longest:
                look("paragraph", a, b, [w for x in lines[a:b] for w in x])
        if len(parts) > 1 and sum(map(len, lines)) <= longest:
            look("text", parts[0][0], parts[-1][1], [w for x in lines for w in x])
        return found + self.runs(lines, found)

    def windows(self, words: list[bytes]) -> list[tuple[float, str, int, int]]:
        """(dice, license, first word, last word + 1): for each place where a run over the threshold
        begins, the nearest one."""
        at: dict[int, list[int]] = {}
        grams = list(pairwise(words))
        for p, g in enumerate(grams):
            for i in self.posting.get(g, ()):
                at.setdefault(i, []).append(p)
        out = []
        for i, places in at.items():
            m, bag = self.sizes[i], self.bags[i]
            least = self.threshold / (2 - self.threshold) * m
            most, need = m * m / least + 1e-9, max(1, ceil(least - 1e-9))
            for j in range(len(places) - need + 1):
                a = places[j]
                if places[j + need - 1] - a + 1 > most:
                    continue
                seen, shared, best = Counter(), 0, (0.0, 0)
                for p in places[j:]:
                    n = p - a + 1
                    if n > most:
                        break
                    seen[grams[p]] += 1
                    shared += seen[grams[p]] <= bag[grams[p]]
                    best = max(best, (2 * shared / (n + m), -p))
                if best[0] >= self.threshold:
                    out.append((best[0], self.names[i], a, 2 - best[1]))
        return out

    def runs(self, lines: list[list[bytes]], found: list[tuple[str, str, int, int, float]]) -> list[tuple[str, str, int, int, float]]:
        """Runs of words that match, in the form of ``scan``, beside the units found."""
        first = [0, *accumulate(map(len, lines))]
        taken: dict[int, tuple[float, set[str]]] = {}

        def take(name: str, a: int, b: int, dice: float) -> None:
            for w in range(a, b):
                d, names = taken.get(w, (0.0, set()))
                taken[w] = (max(d, dice), names | {name})

        for name, _, a, b, dice in found:
            take(name, first[a], first[b], dice)
        out = []
        for dice, name, a, b in sorted(self.windows([w for x in lines for w in x]), key=lambda r: (-r[0], r[2] - r[3], r[1], r[2])):
            if not any(w in taken and (taken[w][0] >= dice or name in taken[w][1]) for w in range(a, b)):
                take(name, a, b, dice)
                out.append((a, (name, "run", bisect_right(first, a) - 1, bisect_right(first, b - 1), dice)))
        return [row for _, row in sorted(out)]


def scan(docs: DataFrame, templates: dict[str, tuple[bool, list[str]]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per unit of text that a licence template matches, with its lines from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
        names = ["doc_id", "license", "unit", "start_line", "end_line", "dice"]
        for b in batches:
            rows = [(doc, *f) for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary())) for f in matcher.scan(t.as_py() or b"")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(run, FOUND)


def documents(docs: DataFrame, found: DataFrame, templates: dict[str, tuple[bool, list[str]]] = TEMPLATES, id_col: str = "doc_id") -> DataFrame:
    """Each doc_id with its licences, and whether all of them let it be reused for any purpose
    (null where none was found)."""
    free = [name for name, (ok, _) in templates.items() if ok]
    per = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("license")).alias("licenses"), F.min(F.col("license").isin(free)).alias("permissive"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id")).join(per, "doc_id", "left")
