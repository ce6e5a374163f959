"""License scan: sparse TF-IDF cosine to templates, then inheritance by directory.

A text is compared line by line (short notices), paragraph by paragraph
(standard headers of several lines) and as a whole (license texts) with
templates of all three kinds; its own license is the best one at or above
``THRESHOLD``.  A text that as a whole is like a full license text, or that
has a license and the file name of one, is a license *file* and speaks for its
directory; a notice or header in a source file never does, however short the
file is.  Documents without a license of their own take that of the nearest
ancestor directory that has such a file, found by equality joins on the
ancestors' paths.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vec
from .store import written

#: Least cosine of a line, paragraph or text to a template.
THRESHOLD = 0.75
#: Names of license files, in either case; fixed values.
FILE_NAME = r"(?i)(^|/)(un)?(licen[cs]e|copying|copyright|notice)[^/]*$"

#: Short notices and standard headers that licenses ask for; fixed values.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)"],
    "ISC": ["Licensed under the ISC License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU General Public License version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This program is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": ["Redistributed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "BSD-2-Clause": ["Redistributed under the BSD 2-Clause License."],
    "MPL-2.0": [
        "Subject to the terms of the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0."],
    "Proprietary": ["Copyright. All rights reserved."],
}
#: Every template has one of these; a line, paragraph or text without any is not compared.
MARKERS = ("licen[cs]e", "copyright", "rights reserved", "public domain", "redistribut", "mozilla", "spdx", "creative commons", "permission", "warrant", "merchantability")
_MARKER = re.compile("|".join(MARKERS), re.IGNORECASE)
_WORD = re.compile(r"[a-z0-9\x80-\U0010FFFF]+")
_CAPITALS = {c: c + 32 for c in range(0x41, 0x5B)}


def words_of(text: str) -> list[str]:
    """Runs of ASCII letters, digits and all beyond ASCII, ASCII letters small."""
    return _WORD.findall(text.translate(_CAPITALS))


@functools.cache
def templates() -> list[tuple[str, str]]:
    """Name and text of all templates: notices, headers, tags by rule, and full license texts."""
    out = [(name, text) for name, notices in NOTICES.items() for text in notices]
    out += [(name, f"SPDX-License-Identifier: {name}") for name in NOTICES if name != "Proprietary"]
    folder = resources.files(__package__) / "license_texts"
    for file in sorted(folder.iterdir(), key=lambda f: f.name):
        text = file.read_text("utf-8")
        out.append((file.name.removesuffix(".txt"), text))
        if file.name == "BSD-3-Clause.txt":  # without the third clause
            out.append(("BSD-2-Clause", re.sub(r"3\. Neither.*?permission\.\n", "", text, flags=re.DOTALL)))
    return out


@functools.cache
def full_texts() -> int:
    """How many of the templates, the last ones, are full license texts."""
    return len(templates()) - sum(len(notices) + (name != "Proprietary") for name, notices in NOTICES.items())


@functools.cache
def vocabulary() -> list[str]:
    return sorted({w for _, text in templates() for w in words_of(text)})


class Matcher:
    """TF-IDF cosines of texts to all templates; ``df`` counts documents of the corpus with each vocabulary word."""

    def __init__(self, df: np.ndarray, n: int):
        self.names = [name for name, _ in templates()]
        self.at = {w: i for i, w in enumerate(vocabulary())}
        self.idf = np.log((1 + n) / (1 + df)) + 1
        #: words outside the vocabulary weigh as one seen once
        self.other = float(np.log((1 + n) / 2) + 1)
        rows = np.zeros((len(self.at), len(self.names)))
        for j, (_, text) in enumerate(templates()):
            for w, k in Counter(words_of(text)).items():
                rows[self.at[w], j] = k * self.idf[self.at[w]]
        self.matrix = rows / np.sqrt((rows**2).sum(0))

    def best(self, words: list[str]) -> tuple[float, str, float]:
        """Highest cosine and its license, of equal ones the first template; and the highest to a full license text."""
        known, weight, square = [], [], 0.0
        for w, k in Counter(words).items():
            i = self.at.get(w)
            if i is None:
                square += (k * self.other) ** 2
            else:
                known.append(i)
                weight.append(k * self.idf[i])
        if not known:
            return 0.0, "", 0.0
        value = np.array(weight)
        score = value @ self.matrix[known] / np.sqrt(square + (value**2).sum())
        return float(score.max()), self.names[int(score.argmax())], float(score[-full_texts() :].max())

    def judge(self, text: str) -> tuple[str | None, float, bool]:
        """Own license of a text, its cosine (0 without), and whether the whole is a full license text."""
        found: list[tuple[float, str]] = []

        def look(words: list[str]) -> float:
            cosine, name, to_full = self.best(words)
            if cosine >= THRESHOLD:
                found.append((cosine, name))
            return to_full

        words = [words_of(line) for line in text.split("\n")]
        paragraph: list[list[str]] = []
        for line in [*words, []]:
            if line:
                paragraph.append(line)
                continue
            if paragraph:
                joined = [w for part in paragraph for w in part]
                if _MARKER.search(" ".join(joined)):
                    for part in paragraph:
                        if _MARKER.search(" ".join(part)):
                            look(part)
                    look(joined)
                paragraph = []
        whole = look([w for line in words for w in line])
        if not found:
            return None, 0.0, False
        cosine, name = max(found, key=lambda f: f[0])
        return name, cosine, whole >= THRESHOLD


def _vocabulary_hashes() -> tuple[np.ndarray, np.ndarray]:
    raw = [w.encode() for w in vocabulary()]
    end = np.cumsum([len(w) for w in raw])
    h = vec.Hasher(np.frombuffer(b"".join(raw), np.uint8)).of(np.append(0, end[:-1]), end)
    order = np.argsort(h)
    return h[order], order


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, word = _vocabulary_hashes()
    total = np.zeros(len(word) + 1, np.int64)
    for batch in batches:
        buf, off, _ = vec.column(batch.column(0))
        for i, j in vec.chunks(off):
            part, o = vec.LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
            spans = vec.runs((part >= 0x80) | ((part >= 0x61) & (part <= 0x7A)) | ((part >= 0x30) & (part <= 0x39)), o)
            h = vec.Hasher(part).of(spans.start, spans.end)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            known = hashes[at] == h
            pair = np.unique(spans.row[known] * len(word) + word[at[known]])
            total[:-1] += np.bincount(pair % len(word), minlength=len(word))
            total[-1] += j - i
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["term", "n"])


def matcher_for(docs: DataFrame) -> Matcher:
    """The matcher with document frequencies of all of ``docs``: as many numbers as the templates have words."""
    counts = np.zeros(len(vocabulary()) + 1, np.int64)
    for term, n in docs.select("text").mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n")).collect():
        counts[term] = n
    return Matcher(counts[:-1], int(counts[-1]))


def _scan(matcher: Matcher) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = pc.match_substring_regex(batch.column(1), "|".join(MARKERS).replace(" ", r"[^a-z0-9\x{80}-\x{10FFFF}]+"), ignore_case=True)
            own: list[tuple[str | None, float, bool]] = [(None, 0.0, False)] * batch.num_rows
            for k in np.flatnonzero(np.asarray(marked.fill_null(False))).tolist():
                own[k] = matcher.judge(batch.column(1)[k].as_py())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([o[0] for o in own], pa.string()), pa.array([o[1] for o in own], pa.float64()), pa.array([o[2] for o in own], pa.bool_())],
                names=["doc_id", "path", "own_license", "cosine", "is_file"],
            )

    return run


def ancestors(path: Column) -> Column:
    """Directories above a path, nearest first; the root is the empty path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scan(docs: DataFrame) -> DataFrame:
    """License of every document of ``docs`` (``doc_id``, ``text``, ``path``; others play no part).

    Returns ``doc_id``, ``path``, ``own_license``, ``cosine`` (of its best
    line, paragraph or whole, 0 without), ``is_file``, ``license`` and
    ``inherited_from`` (the directory, null where the license is its own or
    there is none).  Of several license files in a directory the highest
    cosine decides, then the first name.

    A null text is an empty one and has no license of its own; a null path has
    no directory and inherits nothing.  Repeated rows get one result each; an
    empty table gives an empty result.
    """
    scanned = docs.select("doc_id", "text", "path").mapInArrow(_scan(matcher_for(docs)), "doc_id long, path string, own_license string, cosine double, is_file boolean")
    named = F.col("own_license").isNotNull() & F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    own = written(scanned.withColumn("is_file", F.col("is_file") | named))
    directory = F.element_at(ancestors(F.col("path")), 1)
    files = own.where("is_file and path is not null")
    by_directory = files.groupBy(directory.alias("directory")).agg(F.min_by("own_license", F.struct(-F.col("cosine"), "own_license")).alias("directory_license"))
    # which directories a path lies in is the same for all its directory's documents
    places = own.where("path is not null and own_license is null").select(directory.alias("at"), "path").groupBy("at").agg(F.min("path").alias("path"))
    up = places.select("at", F.posexplode(ancestors(F.col("path"))).alias("distance", "directory"))
    nearest = up.join(by_directory, "directory").groupBy("at").agg(F.min_by(F.struct("directory", "directory_license"), "distance").alias("nearest"))
    keyed = own.withColumn("at", F.when(F.col("own_license").isNull(), directory))
    with_place = keyed.where("at is not null").join(nearest, "at", "left")
    without = keyed.where("at is null").withColumn("nearest", F.lit(None).cast(nearest.schema["nearest"].dataType))
    return with_place.unionByName(without).select(
        "doc_id",
        "path",
        "own_license",
        "cosine",
        "is_file",
        F.coalesce("own_license", "nearest.directory_license").alias("license"),
        F.col("nearest.directory").alias("inherited_from"),
    )


def with_paths(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``path`` where there is none: the digits of ``doc_id`` are nested folders, and the first documents of a folder stand above it.

    1234 is ``1/2/3/1234.txt``, 1230 is ``1/2/1230.txt``, 1200 is ``1/1200.txt``.
    """
    if "path" in docs.columns:
        return docs
    digits = F.col("doc_id").cast("string")
    stem = F.regexp_replace(digits, ".0*$", "")
    return docs.withColumn("path", F.concat(F.regexp_replace(stem, "(.)", "$1/"), digits, F.lit(".txt")))
