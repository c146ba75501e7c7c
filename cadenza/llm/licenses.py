"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams.

Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased. For distinct bigram
sets S and T, Dice is 2 |S & T| / (|S| + |T|). A template's score is the best of all windows of a text:
runs of consecutive bigrams, wherever they begin and end, so that lines, paragraphs and comment signs
don't matter. Size bounds prune: a window can reach the threshold t only with t / (2 - t) of the
template's bigrams in it, and a window of more than (2 - t) / t times as many bigrams is not tried. Only
texts that hold so many of a template's bigrams at all are searched for its windows.

Each template stands for a licence. Where the best windows of templates overlap in a text, only the best
stays (the higher score, then the larger template, then the first in the alphabet): a header that differs
from another licence's in a few words names one licence, and two licences apart in a text name two.

The templates are a fixed list of notices, headers, tags and texts, bounded by themselves; they go along
with the task.

Defined cases: a null or empty text, or one without a bigram, matches nothing; rows are scanned each
by itself, so repeated or null ids are kept; columns named like an output column are replaced; of a
template's windows of one score the first and then the shortest counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cadenza.llm.bpe import as_double
from cadenza.llm.common import ALNUM, sequence_hashes, slices, words_of

#: Notices, headers and texts of public licences.
TEMPLATES = {
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-notice": "Licensed under the BSD License.",
    "bsl-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "lgpl-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>.",
    "mit": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>',
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
#: Licences as tags name them.
TAGS = (
    "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only",
    "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
TEMPLATES |= {f"{tag.lower()}-tag": f"SPDX-License-Identifier: {tag}" for tag in TAGS} | {"mit-title": "The MIT License (MIT)"}
_SHORT = {"bsd-notice": "bsd", "cc-by-notice": "cc-by-4.0", "cc-by-sa-notice": "cc-by-sa-4.0"}
THRESHOLD = 0.8
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def license_of(template: str) -> str:
    """The licence that a template stands for."""
    return _SHORT.get(template) or re.sub(r"(-only|-or-later)?-(header|text|long|tag|title|notice)$", "", template)


def bigrams(text: str) -> list[str]:
    """The distinct bigrams of a normalised text, sorted."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(_UPPER))
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


class _Templates:
    def __init__(self, templates: dict[str, str]):
        self.names, self.sets = [], []
        for name in sorted(templates):
            data = np.frombuffer(templates[name].encode(), np.uint8)
            found = np.unique(sequence_hashes(words_of(data, np.array([0, len(data)]), ALNUM).hashes(), 2))
            if len(found):
                self.names.append(name)
                self.sets.append(found)
        self.all = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)


def _within(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def bounds_of(size: int, threshold: float) -> tuple[int, int]:
    """Least shared bigrams and most bigrams of a window, for a template of so many."""
    return int(np.ceil(threshold / (2 - threshold) * size - 1e-9)), int(np.floor((2 - threshold) / threshold * size + 1e-9))


def _best_window(codes: np.ndarray, own: np.ndarray, size: int, threshold: float) -> tuple[float, int, int]:
    """The best Dice of all windows of a text, and the window's first and last bigram: of equal ones the first
    and then the shortest. codes: the text's bigrams; own: which are the template's."""
    least, most = bounds_of(size, threshold)
    at = np.flatnonzero(own)
    reach = np.searchsorted(at, at + most) - np.arange(len(at))  # own bigrams within a window from each
    best = (0.0, 0, 0)
    for i in at[reach >= least].tolist():  # the best window begins and ends with one
        part = codes[i : i + most]
        new = np.zeros(len(part), bool)
        new[np.unique(part, return_index=True)[1]] = True
        scores = 2 * np.cumsum(new & own[i : i + most]) / (np.cumsum(new) + size)
        to = int(scores.argmax())
        if scores[to] > best[0]:
            best = (float(scores[to]), i, i + to)
    return best


def _scan(templates: _Templates, data: np.ndarray, bounds: np.ndarray, threshold: float) -> list[dict[int, tuple[float, int, int]]]:
    """For each row, the best window of each matching template: score, first and last bigram."""
    rows = len(bounds) - 1
    out: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(rows)]
    w = words_of(data, bounds, ALNUM)
    h, whole = sequence_hashes(w.hashes(), 2), w.whole(2)
    hits = np.flatnonzero(whole & _within(h, templates.all)) if len(h) else np.zeros(0, np.int64)
    if not len(hits):
        return out
    order = hits[np.lexsort((h[hits], w.row[hits]))]
    distinct = order[np.append(True, (w.row[order][1:] != w.row[order][:-1]) | (h[order][1:] != h[order][:-1]))]
    for t, own in enumerate(templates.sets):
        held = np.bincount(w.row[distinct], _within(h[distinct], own), rows)
        for r in np.flatnonzero(held >= bounds_of(len(own), threshold)[0]).tolist():
            codes = h[w.first[r] : w.first[r + 1] - 1]
            best = _best_window(codes, _within(codes, own), len(own), threshold)
            if best[0] >= threshold:
                out[r][t] = best
    return out


def _standing(templates: _Templates, found: dict[int, tuple[float, int, int]]) -> list[tuple[str, float]]:
    """The licence and score of the windows that no better one overlaps, best first."""
    ranked = sorted(found, key=lambda t: (-found[t][0], -len(templates.sets[t]), templates.names[t]))
    out = []
    for i, t in enumerate(ranked):
        score, first, last = found[t]
        if not any(found[u][1] <= last and first <= found[u][2] for u in ranked[:i]):
            out.append((license_of(templates.names[t]), score))
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the text, with n_licenses, licenses (sorted), best_license and best_score."""
    made = ("n_licenses", "licenses", "best_license", "best_score")
    own = [c for c in docs.columns if c not in made and c != "text"]
    held = _Templates(TEMPLATES if templates is None else templates)
    schema = T.StructType([docs.schema[c] for c in own]).add("n_licenses", "long").add("licenses", T.ArrayType(T.StringType())).add("best_license", "string").add("best_score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for _, _, data, bounds in slices(batch.column(batch.schema.get_field_index("text"))) for x in _scan(held, data, bounds, threshold)]
            found = [_standing(held, x) for x in rows]
            names = [sorted({license for license, _ in x}) for x in found]
            columns = [
                pa.array([len(x) for x in names], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array([x[0][0] if x else None for x in found], pa.string()),
                as_double(np.array([x[0][1] if x else np.nan for x in found], float)),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in own), *columns], names=[*own, *made])

    return docs.select(*own, "text").mapInArrow(run, schema)


def template_values() -> tuple[str, str]:
    """The templates' bigrams as SQL rows (name, bigram), and (name, licence, size, least, most) of each."""
    quoted = lambda x: x.replace("'", "''")
    sets = {name: bigrams(text) for name, text in sorted(TEMPLATES.items())}
    sizes = (f"('{name}', '{license_of(name)}', {len(own)}, {', '.join(map(str, bounds_of(len(own), THRESHOLD)))})" for name, own in sets.items())
    return ", ".join(f"('{name}', '{quoted(b)}')" for name, own in sets.items() for b in own), ", ".join(sizes)
