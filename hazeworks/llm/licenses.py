"""Licence scans: text segments against licence templates by the Dice coefficient of word bigrams.

Every line, every paragraph (lines up to a blank one) and the whole text is a segment. A segment is normalised (lower case,
runs of other characters than a-z and 0-9 become one space), its distinct word bigrams are compared with each template's, and
``2 * shared >= threshold * (own + template's)`` counts as a match; the best template wins, the first name on ties.

Notices that fill no segment, such as one inside a sentence or one with blank lines in a longer text, are found in windows of the
normalised text: wherever one of a template's anchors (its bigrams that hold a gate word) occurs, the window of the template's length
that is aligned with it is compared. Each template's best window, the first on ties, counts as a match of kind ``window`` at its first word. A document's licence
is that of the match whose template has most bigrams found less those missing, so that a short notice that is part of a longer one, or the
start of it, doesn't stand for it; then that of the larger coefficient, then the first name.

Two bounds keep this cheap, both exact. Size: Dice t needs between ``t / (2 - t)`` and ``(2 - t) / t`` times the template's
bigrams. Words: a match shares at least ``t / (2 - t)`` of a template's bigrams, so it must contain one of a few gate words,
chosen per template such that fewer bigrams than that are free of them; a text without a gate word is not cut up at all.

Nulls: a null text has no segments, like an empty one; one word gives no bigram and no match. Very long texts cost linear
time. Repeated rows get equal results, an empty table an empty one; only key and text are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Percent.
THRESHOLD = 80

_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
        HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
        LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
        ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
        USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution."""
_ENDORSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
        this software without specific prior written permission."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software."""

#: Public licence notices; names in -full are whole licence texts below their copyright line.
TEMPLATES = {
    "AGPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
        FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": _BSD,
    "BSD-2-Clause-full": f"{_BSD} {_AS_IS}",
    "BSD-3-Clause": f"{_BSD} {_ENDORSE}",
    "BSD-3-Clause-full": f"{_BSD} {_ENDORSE} {_AS_IS}",
    "BSD-statement": "Released under the BSD License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
        FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
        FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "ISC": _ISC,
    "ISC-full": f"""{_ISC} THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
        TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "LGPL-2.1-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This
        library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
        or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "LGPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
        program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
        or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "MIT": "Released under the MIT License.",
    "MIT-full": f"""{_MIT} THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
        BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT-text": _MIT,
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}

#: Words too common in prose to gate on.
COMMON = frozenset("a action all an and any are as at be by copy do for in including is it may must not of on or shall source that the this to use version was with without you".split())


def _pairs(text: str) -> list[tuple[str, str]]:
    w = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return list(zip(w, w[1:]))


def bigrams(text: str) -> set[str]:
    """Distinct word bigrams of the normalised text."""
    return {f"{a} {b}" for a, b in _pairs(text)}


def length(text: str) -> int:
    """Number of word bigrams of the normalised text, repeated ones included."""
    return len(_pairs(text))


def least_shared(size: int, threshold: int) -> int:
    """The fewest bigrams a match shares with a template of ``size``."""
    return math.ceil(threshold * size / (200 - threshold))


def gate_words(templates: dict[str, str], threshold: int) -> list[str]:
    """Words of which every match holds one: per template, the most covering uncommon words until too few bigrams are left."""
    gate: set[str] = set()
    for name in sorted(templates):
        left = bigrams(templates[name])
        need = least_shared(len(left), threshold)
        left = {b for b in left if not gate.intersection(b.split())}
        while len(left) >= need:
            found = Counter(w for b in left for w in set(b.split()))
            word = max(found, key=lambda w: (w not in COMMON, found[w], len(w), w))
            gate.add(word)
            left = {b for b in left if word not in b.split()}
    return sorted(gate)


def anchors(templates: dict[str, str], threshold: int) -> list[tuple[str, str, int]]:
    """(template, bigram, its place in the template) of every bigram that holds a gate word."""
    gate = set(gate_words(templates, threshold))
    return [(n, f"{a} {b}", i) for n in sorted(templates) for i, (a, b) in enumerate(_pairs(templates[n])) if {a, b} & gate]


def _normal_words(segment: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(segment), "[^a-z0-9]+", " ")), " ")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bigrams(segment: Column) -> Column:
    """All word bigrams in order."""
    return _let(_normal_words(segment), lambda w: F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1))))


def _windows(b: Column, templates: dict[str, str], threshold: int) -> Column:
    """Per template the best window of a text with bigrams ``b``, as (kind, i, best)."""
    names = sorted(n for n in templates if bigrams(templates[n]))
    found = [(x, names.index(n), o) for n, x, o in anchors(templates, threshold) if n in names]
    spots = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(t).alias("t"), F.lit(o).alias("o")) for x, t, o in found))
    table = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(n).alias("name"), F.lit(length(templates[n])).alias("n"), F.array(*map(F.lit, sorted(bigrams(templates[n])))).alias("b")) for t, n in enumerate(names)))
    hits = F.filter(F.transform(b, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda h: h["x"].isin(sorted({x for x, _, _ in found})))
    # A start and a template as one number, which makes them distinct by hashing.
    code = lambda h, a: F.greatest(h["i"] - a["o"], F.lit(0)).cast("long") * len(names) + a["t"]
    starts = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(F.filter(spots, lambda a: a["x"] == h["x"]), lambda a: code(h, a)))))

    def rated(c: Column) -> Column:
        def dice(x: Column) -> Column:
            own = F.array_distinct(F.slice(b, F.floor(c / len(names)).cast("int") + 1, x["n"]))
            met = _let(own, lambda w: F.struct(F.size(F.array_intersect(w, x["b"])).alias("shared"), F.size(w).alias("own")))
            return _let(met, lambda m: F.struct((-2.0 * m["shared"] / (m["own"] + F.size(x["b"]))).alias("d"), F.floor(c / len(names)).cast("int").alias("i"), x["t"].alias("t"), m["shared"].alias("shared")))

        return _let(F.get(table, (c % len(names)).cast("int")), dice)

    def least(near: Column) -> Column:
        one = lambda x: F.array_min(F.filter(near, lambda r: r["t"] == x["t"]))
        each = F.transform(table, lambda x: _let(one(x), lambda r: F.struct(F.lit("window").alias("kind"), r["i"].alias("i"), F.when(r.isNotNull(), F.struct(r["d"].alias("d"), x["name"].alias("name"), r["shared"].alias("shared"))).alias("best"))))
        return F.filter(each, lambda s: s["best"].isNotNull())

    return _let(F.filter(F.transform(starts, rated), lambda r: -100 * r["d"] >= threshold), least)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: int = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: licence and dice of its best match, number of matches (segments and windows), and all of them as text."""
    chosen = TEMPLATES if templates is None else templates
    sets = {name: sorted(bigrams(body)) for name, body in sorted(chosen.items()) if bigrams(body)}
    if not sets:  # nothing to compare with
        return docs.select(F.col(key).alias("doc_id"), F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("dice"), F.lit(0).cast("long").alias("n_matches"), F.lit("").alias("matches"))
    table = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(len(b)).alias("size"), F.array(*map(F.lit, b)).alias("bigrams")) for n, b in sets.items()))
    smallest = min(least_shared(len(b), threshold) for b in sets.values())
    largest = max(len(b) * (200 - threshold) // threshold for b in sets.values())
    gate = rf"(?<![a-z0-9])(?:{'|'.join(gate_words(chosen, threshold))})(?![a-z0-9])"
    t = F.coalesce(F.col(text), F.lit(""))

    def named(parts: Column, kind: str) -> Column:
        return F.transform(parts, lambda s, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), s.alias("s")))

    def of(parts: Column) -> Column:
        return F.filter(parts, lambda s: F.lower(s["s"]).rlike(gate))

    segments = of(F.concat(named(F.split(t, "\n", -1), "line"), named(F.split(t, r"\n[\x20\x09\r]*\n", -1), "paragraph"), named(F.array(t), "text")))

    def best(s: Column) -> Column:
        def rated(b: Column) -> Column:
            own = F.size(b)
            fitting = F.filter(table, lambda x: (own * (200 - threshold) >= x["size"] * threshold) & (own * threshold <= x["size"] * (200 - threshold)))
            shared = F.transform(fitting, lambda x: F.struct(F.size(F.array_intersect(b, x["bigrams"])).alias("shared"), (own + x["size"]).alias("both"), x["name"].alias("name")))
            near = F.filter(shared, lambda x: 200 * x["shared"] >= threshold * x["both"])
            # The largest coefficient first, then the first name.
            return F.array_min(F.transform(near, lambda x: F.struct((-2.0 * x["shared"] / x["both"]).alias("d"), x["name"].alias("name"), x["shared"].alias("shared"))))

        return F.element_at(F.transform(F.array(F.array_distinct(_bigrams(s["s"]))), lambda b: F.when(F.size(b).between(smallest, largest), rated(b))), 1)

    found = F.transform(segments, lambda s: F.struct(s["kind"].alias("kind"), s["i"].alias("i"), best(s).alias("best")))
    matches = F.concat(F.filter(found, lambda s: s["best"].isNotNull()), _let(_bigrams(t), lambda b: _windows(b, chosen, threshold)))
    none = F.array().cast("array<struct<kind:string,i:int,best:struct<d:double,name:string,shared:int>>>")
    rows = docs.select(F.col(key).alias("doc_id"), F.when(F.lower(t).rlike(gate), matches).otherwise(none).alias("m"))
    sizes = F.create_map(*(F.lit(x) for n, b in sets.items() for x in (n, len(b))))
    missing = lambda m: F.element_at(sizes, m["name"]) - 2 * m["shared"]
    top = F.array_min(F.transform("m", lambda s: F.struct(missing(s["best"]).alias("missing"), s["best"]["d"].alias("d"), s["best"]["name"].alias("name"))))
    said = F.transform("m", lambda s: F.concat_ws(":", s["kind"], s["i"].cast("string"), s["best"]["name"], F.round(-s["best"]["d"], 4).cast("string")))
    return rows.select("doc_id", top["name"].alias("license"), F.round(-top["d"], 4).alias("dice"), F.size("m").cast("long").alias("n_matches"), F.array_join(said, ",").alias("matches"))
