"""License scans: an exact set-similarity join of text blocks and license templates by containment.

A block is a run of lines of a text, so that a wrapped notice is found: a line of any length, or several lines with at most STRETCH
times the words of the template.  Its token set holds its lower-cased words.  A block matches a template of token set T if it
holds at least ceil(CONTAINMENT * |T|) of T's tokens and no run of lines within it does.  Every matching pair is found:

* tokens of the templates are ordered by how often they occur in the whole corpus, rarest first;
* prefix filter: a block that matches T must hold one of the first |T| - need + 1 tokens of T, so only lines around such tokens are looked at;
* length filter: these must hold at least ``need`` tokens of T in all;
* positional filter: with their rarest common token at place i of T and at place j of their known tokens, at
  most 1 + min(|T| - i - 1, known - j - 1) tokens can be shared;
* in what is left two pointers walk over the lines and count exactly.

Templates are few and of fixed size, so they go to every task; no text is shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow
from .line_dedup import split_lines

CONTAINMENT, STRETCH = 0.8, 2
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "CC-BY-4.0": ("Licensed under the Creative Commons Attribution 4.0 International License.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Zlib": ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
}
SCHEMA = "doc_id bigint, line int, lines int, license string, template int, shared int, containment double"


_TOKEN = "[0-9a-z\u0080-\U0010ffff]+"


def _lower(text: str) -> str:
    """ASCII and Latin-1 capitals in lower case, as ``kernels.lower`` does it."""
    return "".join(c.lower() if ord(c) < 0xDF and ord(c) != 0xD7 else c for c in text)


def token_set(text: str) -> list[str]:
    return sorted(set(re.findall(_TOKEN, _lower(text))))


def needed(size: int, containment: float) -> int:
    return max(1, math.ceil(containment * size - 1e-9))


def _hash(tokens: list[str]) -> np.ndarray:
    raw = [t.encode() for t in tokens]
    end = np.cumsum([len(x) for x in raw])
    return K.span_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], end[:-1]]), end)


def _known(batch: pa.RecordBatch, at: int, vocabulary: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of a text column: (first row, row of each line, words of each line, line and vocabulary number of each known word)."""
    data, off = K.buffers(batch.column(at))
    for lo, hi in K.slices(off):
        part = data[off[lo] : off[hi]]
        lines, row = split_lines(part, off[lo : hi + 1] - off[lo])
        held = [(np.zeros(len(row), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for a, b in K.slices(lines):
            h, line = K.word_hashes(part[lines[a] : lines[b]], lines[a : b + 1] - lines[a])
            place = np.searchsorted(vocabulary, h)
            place[place == len(vocabulary)] = 0
            hit = vocabulary[place] == h
            held[0][0][a:b] = np.bincount(line, minlength=b - a)
            held.append((None, line[hit] + a, place[hit]))
        yield lo, row, held[0][0], np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])


def frequencies(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each token of the vocabulary occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for *_, place in _known(batch, 0, vocabulary):
                total += np.bincount(place, minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary))), pa.array(total)], names=["token", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for r in arrow(docs.select(F.col("text").cast("string")), run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect():  # as many rows as the templates have tokens
        out[r["token"]] = r["n"]
    return out


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, line, lines, license, template, shared, containment) of every block and template that match: its first line, counted from 0, and how many lines it has.

    A null or empty text has no match, a null doc_id stays null, rows that repeat are each reported, an empty table or no
    template gives an empty result.  Blocks that overlap without one holding the other are each reported.  A text of any length is read in
    blocks of lines.  Columns other than doc_id and text are not looked at, so their names can't clash."""
    sets = [(name, i, token_set(t)) for name, texts in templates.items() for i, t in enumerate(texts)]
    sets = [s for s in sets if s[2]]
    if not sets:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    words = sorted({w for _, _, s in sets for w in s})
    hashes = _hash(words)
    order = np.argsort(hashes)
    vocabulary = hashes[order]
    count = frequencies(docs, vocabulary)
    rank = np.empty(len(words), np.int64)
    rank[np.lexsort((vocabulary, count))] = np.arange(len(words))  # place in the global order, rarest first
    number = {words[w]: int(rank[i]) for i, w in enumerate(order)}
    ranked = [np.sort([number[w] for w in s]) for _, _, s in sets]
    need = [needed(len(s), containment) for s in ranked]
    by_prefix: list[list[tuple[int, int]]] = [[] for _ in words]
    for t, s in enumerate(ranked):
        for i in range(len(s) - need[t] + 1):
            by_prefix[s[i]].append((t, i))
    rare = np.array([bool(x) for x in by_prefix])
    names, ids, sizes = [s[0] for s in sets], [s[1] for s in sets], [len(s) for s in ranked]
    member = np.zeros((len(sets), len(words)), bool)
    for t, s in enumerate(ranked):
        member[t, s] = True
    limit = [STRETCH * len(re.findall(_TOKEN, _lower(x))) for texts in templates.values() for x in texts if token_set(x)]

    def blocks(t: int, lines: np.ndarray, tokens: np.ndarray, total: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first line, last line, shared) of the least runs of lines with enough of template t's ``tokens``; total: words before each line."""
        many: dict[int, int] = {}
        left = 0
        best = None
        for right in range(len(lines)):
            many[tokens[right]] = many.get(tokens[right], 0) + 1
            if right + 1 < len(lines) and lines[right + 1] == lines[right]:
                continue  # all tokens of a line count together
            while True:  # the last first line with which the run still has enough
                after = left
                while after <= right and lines[after] == lines[left]:
                    after += 1
                lose = sum(many[x] == tokens[left:after].count(x) for x in set(tokens[left:after]))
                if len(many) - lose < need[t] or after > right:
                    break
                for x in tokens[left:after]:
                    many[x] -= 1
                    if not many[x]:
                        del many[x]
                left = after
            if len(many) >= need[t] and (best is None or lines[left] > best):
                best = lines[left]  # else a shorter run has matched before
                if lines[left] == lines[right] or total[lines[right] + 1] - total[lines[left]] <= limit[t]:
                    yield lines[left], lines[right], len(many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int, int, int, int]] = []
            for lo, row, count, line, place in _known(batch, 1, vocabulary):
                pair = np.unique(line * len(words) + rank[place])
                line, token = pair // len(words), pair % len(words)
                total = np.concatenate([[0], np.cumsum(count)])
                begin = np.searchsorted(row, row)  # the first line of each line's text
                end = np.searchsorted(row, row, "right")
                seeds: dict[int, set[int]] = {}
                hit = np.flatnonzero(rare[token])
                for at, w in zip(line[hit].tolist(), token[hit].tolist(), strict=True):
                    for t, _ in by_prefix[w]:
                        seeds.setdefault(t, set()).add(at)
                for t, lines in seeds.items():
                    at = np.array(sorted(lines))
                    # lines that can be in a block with a seed: as many before and behind as the words allow
                    first = np.maximum(begin[at], np.searchsorted(total, total[at + 1] - limit[t]))
                    last = np.minimum(end[at], np.searchsorted(total, total[at] + limit[t], "right") - 1)
                    first, last = np.minimum(first, at), np.maximum(last, at + 1)
                    fresh = np.concatenate([[True], first[1:] >= np.maximum.accumulate(last)[:-1]])
                    starts = first[fresh]
                    stops = np.maximum.reduceat(last, np.flatnonzero(fresh))
                    for a, b in zip(np.searchsorted(line, starts), np.searchsorted(line, stops), strict=True):
                        own = member[t, token[a:b]]
                        common = np.unique(token[a:b][own])
                        if len(common) < need[t]:
                            continue
                        i, known = int(np.searchsorted(ranked[t], common[0])), np.unique(token[a:b])
                        if 1 + min(sizes[t] - i - 1, len(known) - int(np.searchsorted(known, common[0])) - 1) < need[t]:
                            continue
                        for x, y, shared in blocks(t, line[a:b][own].tolist(), token[a:b][own].tolist(), total):
                            found.append((lo + int(row[x]), int(x - begin[x]), int(y - x + 1), t, shared))
            if found:
                r, ln, many, t, s = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(r)), pa.array(ln, pa.int32()), pa.array(many, pa.int32()), pa.array([names[x] for x in t]), pa.array([ids[x] for x in t], pa.int32()), pa.array(s, pa.int32()), pa.array([x / sizes[y] for x, y in zip(s, t, strict=True)], pa.float64())],
                    names=["doc_id", "line", "lines", "license", "template", "shared", "containment"],
                )

    return arrow(docs.filter("text is not null").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), run, SCHEMA)


def oracle(templates: dict[str, tuple[str, ...]] = TEMPLATES, containment: float = CONTAINMENT) -> str:
    """Every run of lines that holds enough of a template, less those within which another one does; lines without a token of the template are only counted."""
    rows = ", ".join(f"('{name}', {i}, [{', '.join(repr(w) for w in token_set(t))}], {needed(len(token_set(t)), containment)}, {STRETCH * len(re.findall(_TOKEN, _lower(t)))})" for name, texts in templates.items() for i, t in enumerate(texts))
    lower = "translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ', 'abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ')"
    return f"""
WITH t(license, template, tokens, need, most) AS (VALUES {rows}),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
w AS (SELECT doc_id, line, regexp_extract_all({lower}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM l),
b AS (SELECT doc_id, line, list_distinct(words) AS words, sum(len(words)) OVER (PARTITION BY doc_id ORDER BY line) AS upto, len(words) AS n FROM w),
k AS (SELECT doc_id, line, upto, n, license, template, need, most, len(tokens) AS size, list_intersect(words, tokens) AS own FROM b, t WHERE len(list_intersect(words, tokens)) > 0),
g AS (SELECT doc_id, license, template, list_distinct(flatten(list(own))) AS own, any_value(need) AS need FROM k GROUP BY ALL HAVING len(own) >= any_value(need)),
c AS (SELECT k.* FROM k JOIN (SELECT DISTINCT doc_id, license, template FROM g) USING (doc_id, license, template)),
r AS (SELECT x.doc_id, x.license, x.template, x.line AS a, y.line AS b, x.need, x.size, list_distinct(flatten(list(z.own))) AS own
  FROM c x JOIN c y USING (doc_id, license, template) JOIN c z USING (doc_id, license, template)
  WHERE y.line >= x.line AND (x.line = y.line OR y.upto - x.upto + x.n <= x.most) AND z.line BETWEEN x.line AND y.line
  GROUP BY x.doc_id, x.license, x.template, x.line, y.line, x.need, x.size),
m AS (SELECT * FROM r WHERE len(own) >= need)
SELECT doc_id, a::INTEGER AS line, (b - a + 1)::INTEGER AS lines, license, template::INTEGER AS template, len(own)::INTEGER AS shared, len(own) / size::DOUBLE AS containment
FROM m WHERE NOT EXISTS (SELECT 1 FROM m i WHERE i.doc_id = m.doc_id AND i.license = m.license AND i.template = m.template AND i.a >= m.a AND i.b <= m.b AND (i.a > m.a OR i.b < m.b))
"""
