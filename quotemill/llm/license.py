"""Licence scans: normalised text compared with licence templates by the Dice coefficient over word bigrams.

A passage is a window of as many words as the template has (the whole text if it is shorter). Bounds on sizes and on common
bigrams prune templates and windows before any coefficient is taken; counts of common bigrams slide from window to window; so
the result is that of trying every window. A window must name what its template names: the words that tell one licence or
version from another are the same on both sides. Of windows that overlap the one
that explains most counts alone, by coefficient times words: a whole text isn't lost to a line inside it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import text_or_empty

MIN_DICE = 0.8
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
Templates = tuple[tuple[str, str], ...]

# What public licences are called, by SPDX identifier or a plain name.
NAMES = (
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache 2.0 License"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-2.0", "GNU GPL v2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-3.0", "GNU GPL v3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("EPL-2.0", "Eclipse Public License, version 2.0"),
    ("CC0-1.0", "CC0 1.0"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
)
# How a line says so.
PHRASES = (
    "Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "Distributed under the {}.", "Available under the {}.", "This project is licensed under the {}.", "This software is licensed under the {}.",
    "This work is licensed under the {}.", "This work is licensed under a {}.", "This program is distributed under the terms of the {}.", "See the {} for details.",
)
# Short names, how a line says those, and the identifiers of a source file's licence tag.
SHORT_NAMES = (
    ("MIT", "MIT"), ("Apache-2.0", "Apache 2.0"), ("GPL-2.0", "GPLv2"), ("GPL-3.0", "GPLv3"), ("LGPL-2.1", "LGPLv2.1"), ("LGPL-3.0", "LGPLv3"), ("AGPL-3.0", "AGPLv3"), ("BSD-2-Clause", "BSD 2-Clause"), ("BSD-3-Clause", "BSD 3-Clause"), ("ISC", "ISC"),
    ("MPL-2.0", "MPL 2.0"), ("EPL-2.0", "EPL 2.0"), ("CC0-1.0", "CC0 1.0"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
)
SHORT_PHRASES = ("is {} licensed", "are {} licensed", "under the {} license")
TAG = "SPDX-License-Identifier: {}"
TAGS = (
    ("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2.0"), ("GPL-2.0", "GPL-2.0-only"), ("GPL-2.0", "GPL-2.0-or-later"), ("GPL-3.0", "GPL-3.0"), ("GPL-3.0", "GPL-3.0-only"), ("GPL-3.0", "GPL-3.0-or-later"),
    ("LGPL-2.1", "LGPL-2.1-only"), ("LGPL-2.1", "LGPL-2.1-or-later"), ("LGPL-3.0", "LGPL-3.0-only"), ("LGPL-3.0", "LGPL-3.0-or-later"), ("AGPL-3.0", "AGPL-3.0-only"), ("AGPL-3.0", "AGPL-3.0-or-later"), ("BSD-2-Clause", "BSD-2-Clause"),
    ("BSD-3-Clause", "BSD-3-Clause"), ("ISC", "ISC"), ("MPL-2.0", "MPL-2.0"), ("EPL-2.0", "EPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("Zlib", "Zlib"), ("BSL-1.0", "BSL-1.0"), ("Unlicense", "Unlicense"),
)
# Words that tell one licence from another. A version's number counts without its v and trailing zeros.
MARKS = frozenset("mit apache gpl lgpl agpl lesser affero bsd isc mozilla eclipse cc0 cc by sa nc nd attribution sharealike noncommercial noderivatives clause 2-clause 3-clause".split())
_VERSION = re.compile(r"v?([0-9]{1,2}(?:\.[0-9]+)?)")

# Public licence texts and notices.
NOTICES: Templates = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License."""),
    *((name, f"""This program is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public
License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.""")
      for name, kind, version, colon in (("GPL-2.0", "", "2", ";"), ("GPL-3.0", "", "3", ":"), ("LGPL-2.1", "Lesser ", "2.1", ";"), ("LGPL-3.0", "Lesser ", "3", ":"), ("AGPL-3.0", "Affero ", "3", ":"))),
    *((name, f"""you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free
Software Foundation, either version {version} of the License, or (at your option) any later version.""")
      for name, kind, version in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"))),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED
BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the
copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
The origin of this software must not be misrepresented; you must not claim that you wrote the original software."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit
the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do
so, all subject to the following"""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("All-rights-reserved", "All rights reserved."),
)


def full_texts(folder: str | Path = Path(__file__).parent / "licenses") -> Templates:
    """Whole licence texts, one file each, named by its licence: those beside this module, or any folder of that layout."""
    return tuple((p.stem, p.read_text(encoding="utf-8")) for p in sorted(Path(folder).glob("*.txt")))


#: Lines by name and phrase, tags, notices, whole texts.
TEMPLATES: Templates = (
    *((name, phrase.format(called)) for names, phrases in ((NAMES, PHRASES), (SHORT_NAMES, SHORT_PHRASES), (TAGS, (TAG,))) for name, called in names for phrase in phrases), *NOTICES, *full_texts())


def normalised(text: str) -> list[str]:
    """Lower-case words: letters a-z and digits, numbers with their points; all else parts words."""
    return WORD.findall(text.lower())


def bigrams(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    total = sum(a.values()) + sum(b.values())
    return 2 * sum(min(n, b[g]) for g, n in a.items() if g in b) / total if total else 0.0


def mark(word: str) -> str | None:
    """What a word says about which licence this is: a name's word, or a version."""
    if word in MARKS:
        return word
    version = _VERSION.fullmatch(word)
    return (version[1].rstrip("0").rstrip(".") if "." in version[1] else version[1]) if version else None


class _Template:
    def __init__(self, name: str, text: str, min_dice: float):
        words = normalised(text)
        self.name, self.size, self.wanted = name, len(words), Counter(bigrams(words))
        # long texts name other licences and number their sections: there the words themselves decide
        self.marks = frozenset(m for m in map(mark, words) if m) if self.size <= 120 else frozenset()
        # words that a text needs for the coefficient to be possible
        self.least = next(w for w in range(2, self.size + 1) if 2 * (w - 1) / (self.size + w - 2) >= min_dice - 1e-12)


class Scanner:
    def __init__(self, templates: Templates, min_dice: float):
        self.min_dice = min_dice
        made = {(t.name, t.size, frozenset(t.wanted.items())): t for t in (_Template(n, x, min_dice) for n, x in templates if len(normalised(x)) > 1)}
        self.templates = sorted(made.values(), key=lambda t: (t.least, t.name, t.size))
        self.least = [t.least for t in self.templates]
        self.of: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i, t in enumerate(self.templates):
            for g in t.wanted:
                self.of[g].append(i)

    def windows(self, words: list[str]) -> Iterator[tuple[float, int, int, str]]:
        """(coefficient, first word, words, licence) of every window of min_dice or more that names what its template names."""
        grams, hits, possible = bigrams(words), defaultdict(list), bisect_left(self.least, len(words) + 1)
        for at, g in enumerate(grams):
            for t in self.of.get(g, ()):
                if t >= possible:
                    break
                hits[t].append(at)
        said = [(i, m) for i, m in enumerate(map(mark, words)) if m] if hits else []
        spots = [i for i, _ in said]
        for t, places in hits.items():
            template = self.templates[t]
            width = min(template.size, len(words)) - 1  # bigrams of a window
            need = math.ceil(self.min_dice * (template.size - 1 + width) / 2 - 1e-9)
            if len(places) < need:
                continue
            last = len(grams) - width
            starts = sorted({min(p, last) for i, p in enumerate(places) if i + need <= len(places) and places[i + need - 1] < min(p, last) + width} | ({last} if len(places) - bisect_left(places, last) >= need else set()))
            counts, common, low, high = Counter(), 0, 0, 0
            for start in starts:
                # bigrams of the template that leave the window, and those that come into it
                while high < len(places) and places[high] < start + width:
                    g = grams[places[high]]
                    counts[g] += 1
                    common += counts[g] <= template.wanted[g]
                    high += 1
                while low < high and places[low] < start:
                    g = grams[places[low]]
                    common -= counts[g] <= template.wanted[g]
                    counts[g] -= 1
                    low += 1
                value = 2 * common / (template.size - 1 + width)
                if value < self.min_dice - 1e-12:
                    continue
                end = start + width + 1
                if template.marks and template.marks != {m for _, m in said[bisect_left(spots, start) : bisect_left(spots, end)]}:
                    continue
                yield value, start, end - start, template.name

    def scan(self, text: str) -> dict[str, tuple[float, int]]:
        """Licence -> coefficient and first word of its best window, of those that no better one overlaps: by coefficient times
        words, then coefficient, place and name."""
        words = normalised(text)
        kept: list[tuple[int, int]] = []
        found: dict[str, tuple[float, int]] = {}
        for value, start, size, name in sorted(self.windows(words), key=lambda w: (-round(w[0] * w[2], 9), -round(w[0], 12), w[1], w[3])):
            at = bisect_left(kept, (start, 0))
            if (at and kept[at - 1][1] > start) or (at < len(kept) and kept[at][0] < start + size):
                continue
            kept.insert(at, (start, start + size))
            found.setdefault(name, (value, start))
        return found


@lru_cache(maxsize=4)
def _scanner(templates: Templates, min_dice: float) -> Scanner:
    return Scanner(templates, min_dice)


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: Templates = TEMPLATES, min_dice: float = MIN_DICE) -> DataFrame:
    """One row per row of docs: key, licenses: array of struct(license, dice, word) by falling coefficient, then name.

    word is the first word, from 0, of the licence's best window that starts with a bigram of the template, or is the last. Of
    ties the better, then the earlier window, then the lesser name counts. A null or empty text has no licence; null keys and
    repeated rows are scanned like others; an empty table gives an empty result; other columns don't matter. Templates
    are a catalogue that travels with the code: pass others, full_texts of a folder for one.
    """

    @F.pandas_udf("array<struct<license:string,dice:double,word:long>>")
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = _scanner(templates, min_dice)
        for batch in texts:
            yield pd.Series([[{"license": n, "dice": d, "word": w} for n, (d, w) in sorted(scanner.scan(t).items(), key=lambda x: (-x[1][0], x[0]))] for t in batch], dtype=object)

    return docs.select(F.col(key), scan(text_or_empty(text)).alias("licenses"))
