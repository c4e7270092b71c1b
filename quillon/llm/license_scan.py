"""License scan: normalised passages compared to licence templates by the Dice coefficient over word bigrams, candidates pruned by size bounds."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import chunks, lean, to_batch
from quillon.llm.license_texts import TEXTS
from quillon.llm.words import mix, words

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details."""

#: (licence, text): a licence may have several, notices and its whole text. SQL-safe: no template holds a single quote.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT),
    ("MIT", f"{_MIT} {_MIT_WARRANTY}"),
    ("ISC", _ISC),
    ("ISC", f"{_ISC} {_ISC_WARRANTY}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GPL.format(kind="General Public License", version=2)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GPL.format(kind="General Public License", version=3)),
    ("LGPL-2.1", _GPL.format(kind="Lesser General Public License", version="2.1")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GPL.format(kind="Affero General Public License", version=3)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
    *TEXTS.items(),
]
#: A passage is reported from this Dice coefficient on.
THRESHOLD = 0.8

_OUT = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("dice", pa.float64())])
_C0, _C1 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407)


def _bigrams(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * _C0 + h[1:] * _C1) if len(h) > 1 else np.empty(0, np.uint64)


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, license, dice): for each document and each licence that one of its passages matches, the best coefficient, to 6 places.

    Passages are the whole text, its paragraphs (parted by blank lines) and its lines, lower-cased, as sequences of runs
    of letters, marks and digits. With A and B the sets of word bigrams of passage and template, dice = 2|A n B| /
    (|A| + |B|). dice >= t needs t/(2-t) |B| <= |A| <= (2-t)/t |B|, so a passage is compared only to templates whose
    size allows it, and only if it holds enough bigrams of any template at all; neither loses a match.

    One pass without a shuffle; the templates travel with the task. Whole texts of any length. Null and empty texts,
    and passages or templates of fewer than two words, match nothing. Rows with a null id are scanned like others; each
    repeated row is reported by itself; extra columns are ignored; an empty table gives no rows.
    """
    templates = TEMPLATES if templates is None else templates
    sets = [(name, np.unique(_bigrams(words([text])[0]))) for name, text in templates]
    sets = [(name, s) for name, s in sets if len(s)]
    known = np.unique(np.concatenate([s for _, s in sets])) if sets else np.zeros(1, np.uint64)
    low = threshold / (2 - threshold)
    least = max(1, int(np.ceil(low * min((len(s) for _, s in sets), default=1) - 1e-9)))

    def matches(passage: np.ndarray) -> dict[str, float]:
        own, best = np.unique(passage), {}
        for name, s in sets:
            if low * len(s) - 1e-9 <= len(own) <= len(s) / low + 1e-9:
                dice = 2 * len(np.intersect1d(own, s, assume_unique=True)) / (len(own) + len(s))
                if dice >= threshold - 1e-12:
                    best[name] = max(best.get(name, 0), dice)
        return best

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                lines, doc, blank = [], [], []
                for i, t in enumerate(texts[a:b]):
                    own = t.split("\n") if t else []
                    lines += own
                    doc += [i] * len(own)
                    blank += [not x.strip(" \t\r") for x in own]
                if not lines:
                    continue
                h, _, off = words(lines)
                gram = _bigrams(h)
                hit = known[np.minimum(np.searchsorted(known, gram), len(known) - 1)] == gram
                doc = np.array(doc)
                line = np.repeat(np.arange(len(lines)), np.diff(off))
                part = np.cumsum(np.array(blank) | (np.diff(doc, prepend=-1) != 0))
                found: dict[tuple, float] = {}
                for unit in (line, part[line], doc[line]):
                    inside = unit[:-1] == unit[1:]
                    for u in np.flatnonzero(np.bincount(unit[:-1][inside & hit]) >= least):
                        x, y = np.searchsorted(unit, [u, u + 1])
                        for name, dice in matches(gram[x : y - 1]).items():
                            key = (int(doc[line[x]]), name)
                            found[key] = max(found.get(key, 0), dice)
                if found:
                    yield to_batch(_OUT, doc_id=[ids[a + i] for i, _ in found], license=[n for _, n in found], dice=[round(d, 6) for d in found.values()])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, license string, dice double")


def best_run(gram: np.ndarray, template: np.ndarray, threshold: float) -> float:
    """The best coefficient of any run of consecutive bigrams with a template's set, 0 if that is below the threshold.

    A best run begins and ends with a bigram of the template, its first one not occurring in it again: others shrink to
    such runs without loss. It holds at most (2-t)/t |B| distinct bigrams, t/(2-t) |B| of them the template's.
    """
    hit = np.isin(gram, template)
    at = np.flatnonzero(hit)
    need, most = max(1, int(np.ceil(threshold / (2 - threshold) * len(template) - 1e-9))), int((2 - threshold) / threshold * len(template) + 1e-9)
    order = np.argsort(gram, kind="stable")
    same = np.flatnonzero(gram[order][1:] == gram[order][:-1])
    before, after = np.full(len(gram), -1), np.full(len(gram), len(gram))
    before[order[same + 1]], after[order[same]] = order[same], order[same + 1]
    best = 0.0
    for x in at[: max(0, len(at) - need + 1)].tolist():
        length, end = 2 * most + 2, int(after[x])
        while True:
            new = before[x : min(end, x + length)] < x
            distinct = np.cumsum(new)
            if x + length >= end or distinct[-1] > most:
                break
            length *= 2
        common = np.cumsum(new & hit[x : x + len(new)])
        if common[-1] >= need:
            best = max(best, float((2 * common / (distinct + len(template))).max()))
    return best if best >= threshold - 1e-12 else 0.0


def license_runs(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, license, dice) as of license_scan, but passages are all runs of consecutive words of a text, wherever they begin and end.

    So a notice is found in several paragraphs, across lines, or on a line with other prose; what license_scan finds is
    found too, with a coefficient as high at least. A text is searched for a template if it holds as many of its bigrams
    as any match needs; that loses none. Everything else is as in license_scan.
    """
    templates = TEMPLATES if templates is None else templates
    sets = [(name, np.unique(_bigrams(words([text])[0]))) for name, text in templates]
    sets = [(name, s) for name, s in sets if len(s)]
    known = np.unique(np.concatenate([s for _, s in sets])) if sets else np.zeros(1, np.uint64)
    has = np.array([np.isin(known, s) for _, s in sets]).reshape(len(sets), len(known))
    low = threshold / (2 - threshold)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                h, _, off = words(texts[a:b])
                gram = _bigrams(h)
                place = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                at = np.flatnonzero(known[place] == gram)
                doc = np.searchsorted(off, at, side="right") - 1
                inside = at + 1 < off[doc + 1]
                pair = np.unique(doc[inside] * len(known) + place[at[inside]])
                doc, place = pair // len(known), pair % len(known)
                found: dict[tuple, float] = {}
                for k, (name, s) in enumerate(sets):
                    for i in np.flatnonzero(np.bincount(doc[has[k, place]], minlength=1) >= max(1, np.ceil(low * len(s) - 1e-9))).tolist():
                        if dice := best_run(gram[off[i] : off[i + 1] - 1], s, threshold):
                            found[i, name] = max(found.get((i, name), 0), dice)
                if found:
                    yield to_batch(_OUT, doc_id=[ids[a + i] for i, _ in found], license=[n for _, n in found], dice=[round(d, 6) for d in found.values()])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, license string, dice double")


def brute_force_runs(rows: list[tuple], templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> list[tuple]:
    """The same with Python sets, every run of words against every template."""
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    out = []
    for i, t in rows:
        w, best = split(t or ""), {}
        pairs = list(zip(w, w[1:]))
        for name, text in templates:
            tw = split(text)
            b = set(zip(tw, tw[1:]))
            for x in range(len(pairs)) if b else ():
                a: set = set()
                for y in range(x, len(pairs)):
                    a.add(pairs[y])
                    if (d := 2 * len(a & b) / (len(a) + len(b))) >= threshold - 1e-12:
                        best[name] = max(best.get(name, 0), round(d, 6))
        out += [(i, n, d) for n, d in best.items()]
    return out


def brute_force(rows: list[tuple], templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> list[tuple]:
    """The same with Python sets, every passage against every template."""

    def grams(t: str) -> set:
        w = re.findall(r"[^\W_]+", t.lower())
        return set(zip(w, w[1:]))

    out = []
    for i, t in rows:
        best: dict = {}
        for p in [t, *re.split(r"\n[ \t\r]*\n", t), *t.split("\n")] if t else []:
            for name, text in templates:
                a, b = grams(p), grams(text)
                if a and b and (d := 2 * len(a & b) / (len(a) + len(b))) >= threshold - 1e-12:
                    best[name] = max(best.get(name, 0), round(d, 6))
        out += [(i, n, d) for n, d in best.items()]
    return out


SQL = r"""
WITH t AS (SELECT * FROM (VALUES {values}) AS v(tid, license, txt)),
passages AS (SELECT doc_id, text AS p FROM documents UNION ALL SELECT doc_id, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) FROM documents
  UNION ALL SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents),
numbered AS (SELECT row_number() OVER () AS pid, doc_id, regexp_extract_all(lower(p), '[\p{L}\p{M}\p{N}]+') AS w FROM passages WHERE p IS NOT NULL),
pg AS (SELECT pid, doc_id, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM numbered WHERE len(w) > 1),
tw AS (SELECT tid, license, regexp_extract_all(lower(txt), '[\p{L}\p{M}\p{N}]+') AS w FROM t),
tg AS (SELECT tid, license, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM tw WHERE len(w) > 1),
ps AS (SELECT pid, count(*) AS n FROM pg GROUP BY 1), ts AS (SELECT tid, count(*) AS n FROM tg GROUP BY 1),
o AS (SELECT pg.pid, any_value(pg.doc_id) AS doc_id, tg.tid, any_value(tg.license) AS license, count(*) AS c FROM pg JOIN tg USING (g) GROUP BY pg.pid, tg.tid)
SELECT doc_id, license, max(round(2.0::DOUBLE * c / (ps.n + ts.n), 6)) AS dice FROM o JOIN ps USING (pid) JOIN ts USING (tid)
WHERE 2.0::DOUBLE * c / (ps.n + ts.n) >= {threshold}::DOUBLE - 1e-12::DOUBLE GROUP BY 1, 2
""".replace("{values}", ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))).replace("{threshold}", str(THRESHOLD))
