"""License scan: TF-IDF cosine of notices and licence files to templates, and inheritance from the nearest directory."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineage_jobs.runtime import materialize, spread_join

# The notices and openings by which the public licences are recognised.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
#: Least cosine of a header with a template, and of a whole text for it to be a licence file.
HEADER_COSINE, FILE_COSINE = 0.7, 0.5
#: Words of a piece: lines are pieces, longer ones are cut.
PIECE = 25
#: Share of a piece's pairs of words that must occur in templates.
SHARED = 0.4
#: Licensed directories up to which their table is broadcast, at some 100 bytes each.
MAX_FOLDERS = 100_000

WORD = re.compile(r"\w+(?:\.\d+)*")


def terms_of(text: str) -> list[str]:
    """Words and numbers, lower-cased, and each two of them in a row."""
    return word_terms(WORD.findall(text.lower()))


def word_terms(words: list[str]) -> list[str]:
    return [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]


class Scanner:
    """TF-IDF vectors of the templates, and the cosine of texts to them."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[str, int], lines: int):
        self.names = [name for name, _ in templates]
        self.most = math.log(lines + 1) + 1
        bags = [Counter(terms_of(t)) for _, t in templates]
        said = [WORD.findall(t.lower()) for _, t in templates]
        self.pairs = {p for w in said for p in zip(w, w[1:], strict=False)}
        self.lengths = sorted({len(w) for w in said})
        self.idf = {t: math.log((lines + 1) / (counts.get(t, 0) + 1)) + 1 for b in bags for t in b}
        self.index: dict[str, list[tuple[int, float]]] = {}
        for k, bag in enumerate(bags):
            weights = {t: (1 + math.log(n)) * self.idf[t] for t, n in bag.items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            for t, w in weights.items():
                self.index.setdefault(t, []).append((k, w / norm))

    def cosine(self, terms: list[str]) -> tuple[float, str | None]:
        """The highest cosine with a template and its licence; ties go to the first template."""
        bag = Counter(terms)
        if not any(t in self.index for t in bag):
            return 0.0, None
        norm, dots = 0.0, {}
        for t, n in bag.items():
            w = (1 + math.log(n)) * self.idf.get(t, self.most)
            norm += w * w
            for k, v in self.index.get(t, ()):
                dots[k] = dots.get(k, 0.0) + w * v
        if not dots:
            return 0.0, None
        best = max(dots, key=lambda k: (dots[k], -k))
        return min(1.0, dots[best] / math.sqrt(norm)), self.names[best]


    def header(self, text: str) -> tuple[float, str | None]:
        """The highest cosine of a header in a text, and its licence.

        Pieces of whose pairs of words a share of :data:`SHARED` occurs in templates are put together with such neighbours
        (one piece or blank line between them may not). Each piece, each such block, and in longer blocks each window of a
        template's length, moved by a quarter of it, is a header.
        """
        blocks: list[list[list[str]]] = []
        gap, between = 2, []
        for line in text.split("\n"):
            words = WORD.findall(line.lower())
            for k in range(0, max(1, len(words)), PIECE):
                piece = words[k : k + PIECE + 1] if len(words) > PIECE else words  # a pair across the cut counts for the first
                if len(piece) < 2 or sum(map(self.pairs.__contains__, zip(piece, piece[1:], strict=False))) < SHARED * (len(piece) - 1):
                    gap += 1
                    between = piece
                    continue
                piece = piece[:PIECE] if len(words) > PIECE else piece
                if gap > 1 or not blocks:
                    blocks.append([])
                elif gap == 1 and between:
                    blocks[-1].append(between[:PIECE])
                blocks[-1].append(piece)
                gap, between = 0, []
        best = (0.0, None)
        for block in blocks:
            whole = [w for piece in block for w in piece]
            parts = [*block, whole] if len(block) > 1 else block
            for n in self.lengths:
                if PIECE < n < len(whole):
                    parts = [*parts, *(whole[k : k + n] for k in range(0, len(whole) - n + 1, max(1, n // 4)))]
            best = max([best, *(self.cosine(word_terms(p)) for p in parts)], key=lambda x: x[0])
        return best


def line_counts(files: DataFrame, templates: list[tuple[str, str]]) -> tuple[dict[str, int], int]:
    """In how many lines of all files each term of the templates occurs, and how many lines there are.

    What is gathered is a number for each term of the templates.
    """
    terms = {t for _, text in templates for t in terms_of(text)}

    def run(batches):
        seen, n = Counter(), 0
        for batch in batches:
            for value in batch.column(0):
                for line in (value.as_py() or "").split("\n"):
                    n += 1
                    words = WORD.findall(line.lower())
                    seen.update(terms.intersection(words))
                    seen.update(terms.intersection(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))
        seen[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    rows = files.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r["term"]: r["n"] for r in rows}
    return counts, counts.pop("", 0)


def folder_of(path):
    """The directory of a path, without a slash at its end; empty at the top."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def license_scan(
    files: DataFrame,
    templates: list[tuple[str, str]] | None = None,
    header_cosine: float = HEADER_COSINE,
    file_cosine: float = FILE_COSINE,
    file_id: str = "doc_id",
    path: str = "path",
    text: str = "text",
) -> DataFrame:
    """``(doc_id, path, licence, how, cosine, from_folder)``, one row for each file.

    The headers of a text (see :meth:`Scanner.header`) are compared with the templates, and the whole text too. The best header
    of at least ``header_cosine`` gives the file's own licence (``how`` = header). A file named LICENSE, LICENCE, COPYING or NOTICE,
    or whose whole text reaches ``file_cosine``, is a licence file (``file``) and licenses its directory: of several the one of the
    highest cosine, then of the least path. A file without a licence of its own inherits that of the nearest
    directory above it that has one (``inherited``, with ``from_folder``); else it has none (``none``). Null texts
    have no licence of their own; null paths no directory. Repeated rows stay.
    """
    templates = templates or TEMPLATES
    rows = files.select(F.col(file_id).cast("long").alias("doc_id"), F.col(path).alias("path"), F.col(text).alias("text"))
    scanner = files.sparkSession.sparkContext.broadcast(Scanner(templates, *line_counts(rows, templates)))

    def run(batches):
        scan = scanner.value
        for batch in batches:
            out = []
            for value in batch.column(2):
                whole = value.as_py() or ""
                best, licence = scan.header(whole)
                total, named = scan.cosine(terms_of(whole)) if licence else (0.0, None)
                out.append((best, licence, total, named))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = [pa.float64(), pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "path", "line_cosine", "line_licence", "text_cosine", "text_licence"],
            )

    schema = "doc_id long, path string, line_cosine double, line_licence string, text_cosine double, text_licence string"
    named = F.col("path").rlike(r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$")
    whole = (F.col("text_cosine") >= file_cosine) | (F.coalesce(named, F.lit(False)) & (F.col("line_cosine") >= header_cosine))
    scanned = materialize(
        rows.mapInArrow(run, schema)
        .withColumn("is_file", whole)
        .withColumn("licence", F.when(F.col("text_cosine") >= file_cosine, F.col("text_licence")).when(F.col("line_cosine") >= header_cosine, F.col("line_licence")))
        .withColumn("cosine", F.greatest(F.when(F.col("text_cosine") >= file_cosine, F.col("text_cosine")), F.when(F.col("line_cosine") >= header_cosine, F.col("line_cosine"))))
        .withColumn("folder", folder_of(F.col("path")))
        .select("doc_id", "path", "folder", "is_file", "licence", "cosine")
    )
    granted = scanned.where("is_file and folder is not null").groupBy(F.col("folder").alias("above")).agg(
        F.min_by("licence", F.struct(-F.col("cosine"), "path")).alias("granted")
    )
    folders = scanned.where("licence is null and folder is not null").select("folder").distinct()
    parts = F.split("folder", "/")
    upward = folders.select(
        "folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("above")
    ).distinct()
    nearest = upward.join(granted, "above").groupBy("folder").agg(
        F.max_by(F.struct("granted", "above"), F.length("above")).alias("got")
    )
    nearest = materialize(nearest)
    own, n = F.col("licence").isNotNull(), nearest.count()
    met = scanned.join(F.broadcast(nearest), "folder", "left") if n <= MAX_FOLDERS else spread_join(scanned, nearest, "folder", "left")
    return met.select(
        "doc_id",
        "path",
        F.coalesce("licence", "got.granted").alias("licence"),
        F.when(own & F.col("is_file"), "file").when(own, "header").when(F.col("got").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.coalesce("cosine", F.lit(0.0)).alias("cosine"),
        F.when(~own, F.col("got.above")).alias("from_folder"),
    )
