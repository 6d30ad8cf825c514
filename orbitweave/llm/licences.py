"""Licence scan (operator 6): runs of lines, and of words from any place to any other, compared with
licence templates by Dice's coefficient over word bigrams.

A template of b bigrams can only reach the coefficient t with a run of between t / (2 - t) * b and (2 - t) / t * b
bigrams; runs of other sizes are never compared with it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DICE = 0.8
#: Texts whose matches a task remembers, so that copies are scanned once.
REMEMBERED = 512

# Notices by which works are put under a licence.
NOTICES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    "CC-BY-NC-4.0": "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

def templates() -> dict[str, str]:
    """The notices, and the full texts of the files beside this module, by name."""
    texts = Path(__file__).with_name("licence_texts").glob("*.txt")
    return NOTICES | {p.stem: p.read_text(encoding="utf-8") for p in sorted(texts)}


Bigrams = frozenset[tuple[str, str]]
WORD = re.compile(r"[^\W_]+")


def bigrams(words: list[str]) -> Bigrams:
    """Distinct word bigrams; a single word counts as one with an empty mate."""
    return frozenset(zip(words, words[1:], strict=False)) if len(words) > 1 else frozenset((w, "") for w in words)


def normalised(text: str) -> list[str]:
    return WORD.findall(text.lower())


def dice(a: Bigrams, b: Bigrams) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        self.templates = {name: bigrams(normalised(text)) for name, text in templates.items()}
        self.sizes = {name: (least / (2 - least) * len(b), (2 - least) / least * len(b)) for name, b in self.templates.items()}
        # A run reaches a template only if it shares this many bigrams with it.
        self.needed = {name: least / (2 - least) * len(b) for name, b in self.templates.items()}
        self.owners: dict[tuple[str, str], list[str]] = {}
        for name, b in self.templates.items():
            for pair in b:
                self.owners.setdefault(pair, []).append(name)

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(licence, coefficient, first line, lines) of the best runs that don't overlap, by line. Of runs that overlap the
        one of most shared bigrams times coefficient stays, so that a text wins over a notice inside it.

        A run of lines begins and ends with a line that has part of a bigram of the template; others only dilute it. Where
        whole lines don't reach a template, runs of words do that begin and end with such a bigram, in one line or over several.
        """
        lines = [normalised(x) for x in text.split("\n")]
        words = [w for x in lines for w in x]
        pairs = list(zip(words, words[1:], strict=False))
        places: dict[str, list[int]] = {}
        for k, pair in enumerate(pairs):
            for name in self.owners.get(pair, ()):
                places.setdefault(name, []).append(k)
        places = {name: at for name, at in places.items() if len(at) >= self.needed[name] and len({pairs[k] for k in at}) >= self.needed[name]}
        if not places:
            return []
        line_of = [i for i, x in enumerate(lines) for _ in x]
        first, last = {}, {}
        for k, i in enumerate(line_of):
            first.setdefault(i, k)
            last[i] = k
        before: dict[tuple[str, str], int] = {}
        earlier = np.empty(len(pairs), np.int64)
        for k, pair in enumerate(pairs):
            earlier[k] = before.get(pair, -1)
            before[pair] = k
        lines_of, ends = np.array(line_of), np.array([last[i] for i in line_of])
        whole, parts = [], []
        for name, at in places.items():
            begins = {first[line_of[k]] for k in at}
            size, own = len(self.templates[name]), np.zeros(len(pairs), bool)
            own[at] = True
            for a in begins | set(at):
                if len(at) - bisect_left(at, a) < self.needed[name]:
                    continue
                new = self._new(earlier, a, int(self.sizes[name][1]) + 1)
                mine = own[new]
                hits = np.cumsum(mine)
                if not len(hits) or hits[-1] < self.needed[name]:
                    continue
                n = np.arange(1, len(new) + 1)
                if own[a]:
                    d = np.where(mine, 2 * hits / (n + size), 0.0)
                    parts += [(-float(hits[x] * d[x]), a, int(new[x]) + 1, name, float(d[x])) for x in self._records(d, hits)]
                if a in begins:  # up to the end of the line in which each bigram ends
                    m = np.searchsorted(new, ends[new + 1])
                    upto = np.append(0, hits)[m]
                    d = np.where(mine, 2 * upto / (m + size), 0.0)
                    whole += [(-float(upto[x] * d[x]), line_of[a], int(lines_of[new[x] + 1]) - line_of[a] + 1, name, float(d[x])) for x in self._records(d, upto)]
        taken: set[int] = set()
        used: set[int] = set()
        out = []
        parts.sort(key=lambda x: (x[0], x[1], x[2] - x[1], x[3]))
        for _, i, n, name, d in sorted(whole):
            if taken.isdisjoint(range(i, i + n)):
                taken.update(range(i, i + n))
                out.append((name, d, i, n, first[i]))
                # Words of these lines beside the template's own may hold another licence.
                a, z = next(((a, z) for _, a, z, other, _ in parts if other == name and first[i] <= a and z <= last[i + n - 1]), (first[i], last[i + n - 1]))
                used.update(range(a, z + 1))
        for _, a, z, name, d in parts:
            if used.isdisjoint(range(a, z + 1)):
                used.update(range(a, z + 1))
                out.append((name, d, line_of[a], line_of[z] - line_of[a] + 1, a))
        return [x[:4] for x in sorted(out, key=lambda x: (x[2], x[4]))]

    def _records(self, d: np.ndarray, hits: np.ndarray) -> list[int]:
        """Where ``d`` reaches the threshold and ``hits`` times it exceeds all before that do."""
        weight = np.where(d >= self.least, hits * d, 0.0)
        return np.flatnonzero(weight > np.append(0.0, np.maximum.accumulate(weight)[:-1])).tolist()

    @staticmethod
    def _new(earlier: np.ndarray, a: int, most: int) -> np.ndarray:
        """Places from ``a`` on, ``most`` at most, of bigrams that don't stand between ``a`` and them."""
        size = 2 * most
        while True:
            new = np.flatnonzero(earlier[a : a + size] < a)
            if len(new) >= most or a + size >= len(earlier):
                return new[:most] + a
            size *= 2


def licence_scan(docs: DataFrame, wanted: dict[str, str] | None = None, least: float = DICE) -> DataFrame:
    """(doc_id, n_licences, licences, best_dice, matches) by row of ``docs`` (doc_id, text; other columns are not read).

    ``licences`` joins the distinct names by comma; ``matches`` is an array of (licence, dice, line, lines), lines from
    0. Null and empty texts match nothing: best_dice is 0. Of runs that overlap the one of most shared bigrams times
    coefficient stays, whole lines before other runs of words, ties to the earlier, shorter, then by name. Repeated rows and null ids pass through; an empty table gives no rows.
    """
    wanted = wanted or templates()
    kinds = pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("line", pa.int32()), ("lines", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = lru_cache(REMEMBERED)(Scanner(wanted, least).scan)
        for b in batches:
            rows = [[dict(zip(("licence", "dice", "line", "lines"), m, strict=True)) for m in scan(t or "")] for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(rows, pa.list_(kinds))], ["doc_id", "matches"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, matches array<struct<licence: string, dice: double, line: int, lines: int>>")
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_licences"),
        F.array_join(F.array_sort(F.array_distinct("matches.licence")), ",").alias("licences"),
        F.coalesce(F.array_max("matches.dice"), F.lit(0.0)).alias("best_dice"),
        "matches",
    )
