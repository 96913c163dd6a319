"""Licence scans: TF-IDF cosine of header lines and licence files to templates, then inheritance by directory.

Units of a text are its lines, its paragraphs (runs of lines with words, so that a notice wrapped over comment lines is
one) and its head (the lines up to the first that is neither blank nor begins like a comment); a licence file (LICENSE,
LICENCE, COPYING or UNLICENSE with any ending) is also one whole unit, and speaks for its directory.  Every unit is a
sparse TF-IDF vector over lower-cased runs of letters and digits.  Of the templates whose cosine to some unit reaches the
threshold, a file's own licence is that of the largest evidence, the cosine squared times the template's length as a
vector: so the three clauses of a licence outweigh the opening that it shares with another.  A file without a licence of its own
takes that of the nearest ancestor directory which has one: each distinct directory is exploded to its ancestors, joined
to the licence directories by path, and the deepest match joins the files again.

Weights are log((1 + T) / (1 + df)) + 1 over the T templates; words of no template have df 0 and each counts as a term
of its own.  Ties go to the smaller licence name; of several licence files of one directory,
to the larger score, then the smaller path.  Null and empty texts have no licence of their own but inherit; a null path
inherits nothing.  Repeated rows get equal results.  Extra columns are carried in ``row``, whatever their names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import map_batches, materialize
from .textkit import ALNUM, LOWER, NOT_SPACE, Rolling, Words, byte_class, runs, text_blocks

THRESHOLD = 0.6
LICENCE_FILE = r"(?i)^(un)?licen[sc]e([.-].*)?$|^copying([.-].*)?$"

_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, {1}."
_LATER = "either version {0} of the License, or (at your option) any later version"
_LIBRARY = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation; {1}."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)

#: The usual notices of public licences.
TEMPLATES = (
    ("AGPL-3.0", _GPL.format("Affero General Public License", _LATER.format(3))),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD-2-Clause", _BSD),
    ("BSD-2-Clause", " ".join((_BSD, *_CLAUSES[:2]))),
    ("BSD-3-Clause", " ".join((_BSD, *_CLAUSES))),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation."),
    ("GPL-2.0", _GPL.format("General Public License", _LATER.format(2))),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GPL.format("General Public License", _LATER.format(3))),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", _LIBRARY.format("Lesser General Public License", _LATER.format(2.1))),
    ("LGPL-3.0", _LIBRARY.format("Lesser General Public License", _LATER.format(3))),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


@dataclass(frozen=True)
class TemplateIndex:
    names: tuple  # licence of each template
    vocabulary: np.ndarray  # sorted word hashes
    weights: np.ndarray  # idf of each word
    vectors: np.ndarray  # word x template, unit length
    norms: np.ndarray  # of the templates before that
    outside: float  # idf of any other word


def _terms(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def index_templates(templates=TEMPLATES) -> TemplateIndex:
    templates = sorted(templates)  # a tie is the smaller name
    hashing = Rolling(8)

    def hashed(word: str) -> int:
        data = np.frombuffer(word.encode(), np.uint8)
        return int(hashing.slices(hashing.sums(data), np.array([0]), np.array([len(data)]))[0])

    bags = [_terms(text) for _, text in templates]
    words = sorted({hashed(w) for bag in bags for w in bag})
    place = {h: i for i, h in enumerate(words)}
    tf = np.zeros((len(words), len(bags)))
    for j, bag in enumerate(bags):
        for w in bag:
            tf[place[hashed(w)], j] += 1
    n = len(bags)
    idf = np.log((1 + n) / (1 + (tf > 0).sum(1))) + 1
    vectors = tf * idf[:, None]
    norms = np.maximum(np.linalg.norm(vectors, axis=0), 1e-12)
    return TemplateIndex(tuple(name for name, _ in templates), np.array(words, np.uint64), idf, vectors / norms, norms, math.log(1 + n) + 1)


def _best(unit: np.ndarray, words: np.ndarray, n: int, index: TemplateIndex, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per unit (``unit`` is sorted) the template of the largest evidence, its cosine and that evidence, 0 if none reaches the threshold."""
    near = np.minimum(np.searchsorted(index.vocabulary, words), len(index.vocabulary) - 1)
    known = index.vocabulary[near] == words
    square = np.bincount(unit[~known], minlength=n)[:n] * index.outside**2
    key = np.sort(unit[known] * len(index.vocabulary) + near[known])
    first, tf = runs(key)
    of, term = key[first] // len(index.vocabulary), key[first] % len(index.vocabulary)
    weight = tf * index.weights[term]
    square = square + np.bincount(of, weight**2, n)[:n]
    evidence, score, which = np.zeros(n), np.zeros(n), np.full(n, -1)
    for j in range(len(index.names)):
        held = index.vectors[term, j] > 0
        dot = np.bincount(of[held], weight[held] * index.vectors[term[held], j], n)[:n] / np.sqrt(np.maximum(square, 1e-12))
        mine = np.where(dot >= threshold - 1e-12, np.round(dot**2 * index.norms[j], 9), 0.0)
        better = mine > evidence
        evidence[better], score[better], which[better] = mine[better], dot[better], j
    return which, np.minimum(score, 1.0), evidence


MARKS = byte_class((0x23, 0x23), (0x25, 0x25), (0x2A, 0x2A), (0x2D, 0x2D), (0x2F, 0x2F), (0x3B, 0x3C))  # of comments: # % * - / ; <


def _units(data: np.ndarray, at: np.ndarray, words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(selected words, their unit, ascending) of lines, paragraphs and heads."""
    line = np.concatenate(([0], np.cumsum(data == 0x0A)))[words.starts] + words.row  # one more at every row
    broken = np.concatenate(([False], (np.diff(line) > 1) | (np.diff(words.row) > 0))) if len(line) else np.zeros(0, bool)
    begins = np.sort(np.concatenate((at[:-1][np.diff(at) > 0], np.flatnonzero(data[:-1] == 0x0A) + 1))) if len(data) else at[:0]
    begins = np.unique(begins)
    solid = np.flatnonzero(NOT_SPACE[data])
    next_ = np.searchsorted(solid, begins)
    ends = np.append(begins[1:], len(data))
    head = np.zeros(len(begins), np.uint8)
    has = next_ < len(solid)
    has[has] = solid[next_[has]] < ends[has]
    head[has] = data[solid[next_[has]]]
    code = has & ~MARKS[head]
    row = np.searchsorted(at, begins, "right") - 1
    many = np.cumsum(code)
    before = np.concatenate(([0], many))[np.searchsorted(begins, at[row])]  # code lines before the row
    open_ = many == before
    top = open_[np.searchsorted(begins, words.starts, "right") - 1] if len(begins) else np.zeros(0, bool)
    every = np.arange(len(words))
    return [(every, np.cumsum(np.diff(line, prepend=line[:1]) > 0)), (every, np.cumsum(broken)), (np.flatnonzero(top), words.row[top])]


def own_licences(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """path, [row,] own_licence, own_score: the licence of the largest evidence over the units, and its cosine."""
    index = index_templates(templates)
    others = [c for c in files.columns if c not in ("path", "text")]
    frame = files.select("path", "text", F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE), F.lit(False)).alias("whole"), *([F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")] if others else []))
    out = [f for f in frame.schema.fields if f.name in ("path", "row")]

    def kernel(batch: pa.RecordBatch):
        hashing = Rolling(8)
        flags = batch.column(2).to_numpy(zero_copy_only=False)
        for lo, hi, data, at in text_blocks(batch.column(1)):
            n, data = hi - lo, LOWER[data]
            words = Words(data, at, ALNUM)
            hashes = hashing.words(data, words)
            best, score, licence = np.zeros(n), np.zeros(n), np.full(n, -1)
            whole = np.flatnonzero(flags[lo:hi].astype(bool)[words.row])
            for some, unit in [*_units(data, at, words), (whole, words.row[whole])]:
                if not len(some):
                    continue
                distinct = int(unit[-1]) + 1
                row_of = np.zeros(distinct, np.int64)
                row_of[unit] = words.row[some]
                which, cosine, evidence = _best(unit, hashes[some], distinct, index, threshold)
                order = np.lexsort((which, -evidence, row_of))
                got = order[runs(row_of[order])[0]]
                got = got[(evidence[got] > best[row_of[got]]) | (evidence[got] == best[row_of[got]]) & (which[got] < licence[row_of[got]])]
                best[row_of[got]], score[row_of[got]], licence[row_of[got]] = evidence[got], cosine[got], which[got]
            hit = best > 0
            names = pa.array([index.names[k] if ok else None for k, ok in zip(licence, hit)], pa.string())
            kept = [batch.column(i).slice(lo, n) for i, c in enumerate(batch.schema.names) if c in ("path", "row")]
            yield pa.RecordBatch.from_arrays([*kept, names, pa.array(np.where(hit, score, 0.0))], names=[f.name for f in out] + ["own_licence", "own_score"])

    return map_batches(frame, kernel, T.StructType([*out, T.StructField("own_licence", T.StringType()), T.StructField("own_score", T.DoubleType())]))


def inherit(owned: DataFrame) -> DataFrame:
    """Adds directory, licence and inherited_from to the rows of ``own_licences``."""
    owned = owned.withColumn("directory", F.regexp_replace("path", r"/?[^/]*$", ""))
    name = F.element_at(F.split("path", "/"), -1)
    by_dir = (
        owned.where(F.col("path").isNotNull() & F.col("own_licence").isNotNull() & name.rlike(LICENCE_FILE))
        .groupBy(F.col("directory").alias("holder"))
        .agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_licence")).alias("best"))
        .select("holder", F.col("best.own_licence").alias("held"))
    )
    parts = F.split("directory", "/")
    ancestors = owned.where("path is not null").select("directory").distinct().withColumn("up", F.explode(F.sequence(F.lit(0), F.size(parts)))).withColumn("holder", F.array_join(F.slice(parts, 1, F.col("up")), "/"))
    nearest = ancestors.join(by_dir, "holder").groupBy("directory").agg(F.max_by(F.struct("holder", "held"), "up").alias("near"))
    return owned.join(nearest, "directory", "left").select(
        *owned.columns, F.coalesce("own_licence", "near.held").alias("licence"), F.when(F.col("own_licence").isNull(), F.col("near.holder")).alias("inherited_from")
    )


def scan_licences(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """path, [row,] own_licence, own_score, directory, licence, inherited_from for every row of ``files`` (path, text)."""
    return inherit(materialize(own_licences(files, templates, threshold)))


def own_licence_in_memory(path: str | None, text: str | None, templates=TEMPLATES, threshold: float = THRESHOLD) -> tuple:
    """Brute-force own licence of one file.  For tests."""
    from collections import Counter

    templates = sorted(templates)
    bags = [Counter(_terms(t)) for _, t in templates]
    df = Counter(w for b in bags for w in b)
    idf = lambda w: math.log((1 + len(bags)) / (1 + df[w])) + 1

    def cosine(a: list[str], b: Counter) -> float:
        inside, outside = Counter(w for w in a if w in df), [w for w in a if w not in df]
        norm = math.sqrt(sum((n * idf(w)) ** 2 for w, n in inside.items()) + len(outside) * (math.log(1 + len(bags)) + 1) ** 2)
        other = math.sqrt(sum((n * idf(w)) ** 2 for w, n in b.items()))
        return sum(n * idf(w) * b[w] * idf(w) for w, n in inside.items()) / (norm * other) if norm else 0.0

    lines = (text or "").split("\n")
    paragraphs, head = [[]], []
    for line in lines:
        if _terms(line):
            paragraphs[-1].append(line)
        else:
            paragraphs.append([])
    for line in lines:
        if (bare := line.strip("\t\n\v\f\r ")) and bare[0] not in "#%*-/;<":
            break
        head.append(line)
    units = lines + ["\n".join(p) for p in paragraphs] + ["\n".join(head)] + ([text or ""] if path and re.match(LICENCE_FILE, path.rsplit("/", 1)[-1]) else [])
    best = (0.0, "", 0.0)
    for (name, _), bag in zip(templates, bags):
        length = math.sqrt(sum((n * idf(w)) ** 2 for w, n in bag.items()))
        for u in units:
            if (score := round(cosine(_terms(u), bag), 12)) >= threshold and round(score**2 * length, 9) > best[0]:
                best = (round(score**2 * length, 9), name, score)
    return (best[1], best[2]) if best[1] else (None, 0.0)


def licences_in_memory(files: list[tuple]) -> list[tuple]:
    """Brute force over (path, text): (path, own licence, licence, the directory it comes from).  For tests."""
    owned = [(path, *own_licence_in_memory(path, text)) for path, text in files]
    held: dict[str, tuple] = {}
    for path, name, score in owned:
        if path is not None and name and re.match(LICENCE_FILE, path.rsplit("/", 1)[-1]):
            folder = path.rpartition("/")[0]
            held[folder] = min(held.get(folder, (0.0, "", "")), (-round(score, 9), path, name))
    out = []
    for path, name, _ in owned:
        licence, source, folder = name, None, path
        while path is not None and licence is None and folder:
            folder = folder.rpartition("/")[0]
            if folder in held:
                licence, source = held[folder][2], folder
        out.append((path, name, licence, source))
    return out
