"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

A window as long as a template slides over the words of a text; a window's MinHash is the minimum of its five-word shingles under each of
``BANDS`` hash functions. With one row a band, a window whose similarity to a template is s shares a band with
it with probability 1 - (1 - s)**BANDS: above 0.999 at 0.5. A band's hash is one to one, so a window can only share it where it holds the very
shingle that is the template's minimum: one lookup of all shingles in the sorted minima of all templates finds these places, however many
templates there are, and sliding minima around them tell which windows share the band. Retrieved templates are then compared exactly: the share of
their shingles that occur around the window must reach ``CONTAINMENT``. Of templates of two licenses at one place, such as two versions of
a notice, the one with the larger share counts. A notice shorter than a shingle is one shingle of its own length.

No shuffle; a text is scanned whole, on its own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.llm import textvec as tv
from lodestar.llm.common import batch, each, table

SHINGLE, BANDS, CONTAINMENT = 5, 10, 0.8
#: Notices of public licenses.
TEMPLATES = {
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "All rights reserved": ("All rights reserved.",),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "BSD-3-Clause": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    ),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "CC0-1.0": ("To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}

_FOLD = tv.lower(np.arange(256, dtype=np.uint8))
_FOLD[[b for b in range(128) if not (chr(b).isalnum() or b == 46)]] = 32
_A = np.random.default_rng(8).integers(0, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _folded(c: tv.Chunk) -> tuple[tv.Words, tv.Rolling]:
    """Words of the folded text (letters, digits and inner full stops, lower case) and the hashes of their runs."""
    data = _FOLD[c.data]
    dot = np.flatnonzero(data == 46)
    if len(dot):
        after = np.where(dot + 1 < len(data), data[np.minimum(dot + 1, len(data) - 1)], 32)
        last = np.isin(dot + 1, c.off)
        data[dot[(after == 32) | (after == 46) | last]] = 32
    w = tv.words(tv.Chunk(c.row, data, c.off))
    return w, tv.Rolling(tv.word_hashes(data, w))


class Template(NamedTuple):
    name: str
    size: int
    shingles: np.ndarray


def _templates() -> list[Template]:
    out = []
    for name, texts in TEMPLATES.items():
        for t in texts:
            for c in tv.chunks(pa.array([t])):
                w, h = _folded(c)
                out.append(Template(name, len(w.start), np.unique(h.grams(min(SHINGLE, len(w.start))))))
    return out


_ALL = _templates()
_SHORT = sorted({t.size for t in _ALL if t.size < SHINGLE})


def _minima() -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Shingles that are a template's minimum in a band, sorted, and the (template, band) pairs of each."""
    of: dict[int, list[tuple[int, int]]] = {}
    for i, t in enumerate(_ALL):
        for k in range(BANDS) if t.size >= SHINGLE else ():
            with np.errstate(over="ignore"):
                of.setdefault(int(t.shingles[(t.shingles * _A[k]).argmin()]), []).append((i, k))
    keys = sorted(of)
    return np.array(keys, np.uint64), [of[x] for x in keys]


_KEYS, _OF = _minima()


def _scan(c: tv.Chunk) -> list[dict[tuple[int, int], float]]:
    """For each document: {(template, first word): containment}."""
    found: list[dict[tuple[int, int], float]] = [{} for _ in range(c.n)]
    w, h = _folded(c)
    for size in _SHORT:
        grams = h.grams(size)
        for t, template in enumerate(_ALL):
            for i in np.flatnonzero(grams == template.shingles[0]).tolist() if template.size == size else ():
                doc = int(np.searchsorted(w.first, i, "right")) - 1
                if i + size <= w.first[doc + 1]:
                    found[doc][(t, i - int(w.first[doc]))] = 1.0
    g = h.grams(SHINGLE)
    near = np.minimum(np.searchsorted(_KEYS, g), len(_KEYS) - 1)
    for i in np.flatnonzero(_KEYS[near] == g).tolist():
        for t, k in _OF[near[i]]:
            width = _ALL[t].size - SHINGLE + 1
            lo, hi = max(0, i - width + 1), i + width
            with np.errstate(over="ignore"):
                around = g[lo:hi] * _A[k]
            # a window that holds this shingle shares the band if nothing in it is less
            if (tv.sliding_min(around, min(width, len(around))) == around[i - lo]).any():
                _verify(found, w, g, i, t)
    return [_without_lesser(f) for f in found]


def _verify(found: list, w: tv.Words, g: np.ndarray, at: int, template: int) -> None:
    doc = int(np.searchsorted(w.first, at, "right")) - 1
    first, last = int(w.first[doc]), int(w.first[doc + 1]) - SHINGLE + 1
    if at >= last:
        return  # the shingle runs over the document's end
    _, size, shingles = _ALL[template]
    lo, hi = max(first, at - size), min(last, at + size)
    here = np.isin(g[lo:hi], shingles)
    share = len(np.unique(g[lo:hi][here])) / len(shingles)
    if share >= CONTAINMENT:
        start = lo + int(np.flatnonzero(here)[0]) - first
        key = (template, start)
        found[doc][key] = max(share, found[doc].get(key, 0.0))


def _without_lesser(hits: dict[tuple[int, int], float]) -> dict[tuple[int, int], float]:
    """Without those that another license overlaps with a larger share."""
    out, spans = {}, sorted((s, s + _ALL[t].size, share, t) for (t, s), share in hits.items())
    longest = max((e - s for s, e, *_ in spans), default=0)
    starts = [x[0] for x in spans]
    for s, e, share, t in spans:
        rivals = spans[bisect_left(starts, s - longest) : bisect_left(starts, e)]
        if not any(y > s and more > share and _ALL[u].name != _ALL[t].name for _, y, more, u in rivals):
            out[(t, s)] = share
    return out


_FOUND = "doc_id long, licenses string, n_matches long, containment double, matches string"


def _rows(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for c in tv.chunks(b.column("text")):
        names, n, best, where = [], [], [], []
        for hits in _scan(c):
            names.append(",".join(sorted({_ALL[t].name for t, _ in hits})))
            n.append(len(hits))
            best.append(max(hits.values(), default=0.0))
            where.append(",".join(f"{_ALL[t].name}:{s}:{s + _ALL[t].size}" for t, s in sorted(hits, key=lambda h: (h[1], h[0]))))
        yield batch(doc_id=b["doc_id"].slice(c.row, c.n), licenses=pa.array(names, pa.string()), n_matches=pa.array(n, pa.int64()), containment=pa.array(best, pa.float64()), matches=pa.array(where, pa.string()))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: licenses (names, sorted), n_matches, the best containment, matches (name:first word:end).

    Words are counted in the folded text. A null or empty text matches nothing, and one of fewer than five words only shorter notices.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each(_rows), _FOUND)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


queries = {"op8_licenses": op8_licenses}
oracle_sql: dict[str, str] = {}
