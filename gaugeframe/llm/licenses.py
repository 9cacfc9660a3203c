"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

A template of ``n`` five-word shingles is sought in windows of ``2w`` shingles that start every ``w``, ``w`` the power of two at or above
``n``: any stretch of ``w`` shingles lies in one of them. A window that holds the ``containment`` share ``c`` of a template has a
Jaccard similarity of at least ``c / (4 + 1 - c)`` (for 0.8 that is 0.19), so ``BANDS`` bands of one MinHash each miss it with a
probability under ``(1 - 0.19) ** 64``, about 1.4e-6. A band can only collide if the window holds the template's own minimum of that
band, so signatures are computed for windows with such a shingle alone; all shingles of all texts are looked up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import LOWER, chunks, flat, mix, runs, span_hashes, thrifty

SHINGLE, BANDS, CONTAINMENT = 5, 64, 0.8
_WORDS = np.zeros(256, np.uint8)
_WORDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1

#: Notices by license name; fixed values: they are the licenses' own published words, or the usual line that names one.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
     "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
     "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
     "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
     "or substantial portions of the Software."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Distributed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
     "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-2.0", "Licensed under the GNU General Public License v2.0."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
     "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
     "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
     "version 2 as published by the Free Software Foundation."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
     "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License v3.0."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
     "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
     "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GFDL-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, "
     "Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no "
     "Back-Cover Texts."),
    ("GFDL-1.2", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, "
     "Version 1.2 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no "
     "Back-Cover Texts."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
     "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
     "disclaimer."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
     "derived from this software without specific prior written permission."),
    ("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement: This "
     "product includes software developed by"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
     "that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
     "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and "
     "to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
     "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
     "commercial applications, and to alter it and redistribute it freely"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
     "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file "
     "except in compliance with the License."),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You "
     "may not use this file except in compliance with the License."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
     "available at https://www.eclipse.org/legal/epl-2.0"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which "
     "accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters and digits; bytes beyond ASCII are letters."""
    data = np.frombuffer(text, np.uint8)
    low = LOWER[data].tobytes()
    start, end, *_ = runs(data, np.array([0, len(data)]), _WORDS)
    return [low[a:b] for a, b in zip(start.tolist(), end.tolist())]


def shingles_of(words: list[bytes]) -> list[bytes]:
    return [b" ".join(words[k: k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)]


def _combine(words: np.ndarray) -> np.ndarray:
    """Hash of each run of five word hashes."""
    if len(words) < SHINGLE:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        total = total * np.uint64(0x100000001B3) + words[k: len(words) - SHINGLE + 1 + k]
    return mix(total)


_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes[None, :] ^ _SEEDS[:, None]).min(1)


class Templates:
    """Templates by window step, with their signatures and the shingles those come from."""

    def __init__(self, templates: list[tuple[str, str]], containment: float):
        self.containment = containment
        self.steps: dict[int, list[int]] = {}
        self.names, self.sets, self.signs, self.keys = [], [], [], {}
        for which, (name, text) in enumerate(templates):
            words = words_of(text.encode())
            if len(words) < SHINGLE:
                raise ValueError(f"template {which} has under {SHINGLE} words")
            data = np.frombuffer(b" ".join(words), np.uint8)
            start, end, *_ = runs(data, np.array([0, len(data)]), _WORDS)
            hashes = np.unique(_combine(span_hashes(data, start, end)))
            spread = mix(hashes[None, :] ^ _SEEDS[:, None])
            self.names.append(name)
            self.sets.append(set(shingles_of(words)))
            self.signs.append(spread.min(1))
            step = 1 << max(0, len(hashes) - 1).bit_length()
            self.steps.setdefault(step, []).append(which)
            self.keys.setdefault(step, []).append(hashes[spread.argmin(1)])
        self.keys = {step: np.unique(np.concatenate(k)) for step, k in self.keys.items()}

    def scan(self, column: pa.Array):
        """``(row, template, containment, first word, last word, region)`` per window that holds a template; the region is the words
        of the stretch as long as the template that holds most of it."""
        data, offs = flat(column)
        for a, b in chunks(offs):
            part = LOWER[data[offs[a]: offs[b]]]
            start, end, _, row = runs(part, offs[a: b + 1] - offs[a], _WORDS)
            if len(start) < SHINGLE:
                continue
            hashes = _combine(span_hashes(part, start, end))
            whole = row[: len(hashes)] == row[SHINGLE - 1:]
            first_word = np.searchsorted(row, np.arange(b - a + 1), "left")
            for step, keys in self.keys.items():
                slot = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                at = np.flatnonzero((keys[slot] == hashes) & whole)
                local = at - first_word[row[at]]
                own = local // step
                windows = np.unique(np.stack([np.concatenate([row[at], row[at]]), np.concatenate([own, own - 1])], 1), axis=0)
                for r, w in windows[windows[:, 1] >= 0].tolist():
                    lo = first_word[r] + w * step
                    hi = min(lo + 2 * step, first_word[r + 1] - SHINGLE + 1)
                    sign = signature(hashes[lo:hi])
                    for which in self.steps[step]:
                        if (sign == self.signs[which]).any():
                            texts = [b" ".join(part[start[k]: end[k]].tobytes() for k in range(s, s + SHINGLE)) for s in range(lo, hi)]
                            held = [k for k, t in enumerate(texts) if t in self.sets[which]]
                            share = len({texts[k] for k in held}) / len(self.sets[which])
                            if share >= self.containment:
                                place = np.array(held)
                                many = np.searchsorted(place, place + len(self.sets[which]), "left") - np.arange(len(place))
                                best = int(many.argmax())
                                region = int(w * step + place[best]), int(w * step + place[best + many[best] - 1] + SHINGLE - 1)
                                yield a + r, which, share, int(w * step + held[0]), int(w * step + held[-1] + SHINGLE - 1), region


def told_apart(hits: list[tuple], sizes: list[int]) -> list[tuple]:
    """Of a text's hits ``(template, containment, first, last, region)`` those whose region no better hit of another template takes.

    A better hit holds a larger share of its template, or an equal share of a longer one, or of an earlier one. It takes a region
    of which it covers over half, or whose greater part lies in it: near-equal notices, as those of two versions of a license,
    are told by the one whose words they are.
    """
    order = sorted(hits, key=lambda h: (-h[1], -sizes[h[0]], h[0], h[2]))
    taken: dict[int, list[tuple[int, int, int]]] = {}  # by the coarse places a region touches
    kept = []
    for hit in order:
        lo, hi = hit[4]
        cells = range(lo >> 6, (hi >> 6) + 1)
        if not any(which != hit[0] and 2 * (min(hi, b) - max(lo, a) + 1) > min(hi - lo, b - a) + 1
                   for cell in cells for which, a, b in taken.get(cell, ())):
            kept.append(hit)
            for cell in cells:
                taken.setdefault(cell, []).append((hit[0], lo, hi))
    return kept


def find_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES,
                  containment: float = CONTAINMENT) -> DataFrame:
    """``(key, template, license, containment, first_word, last_word, windows)`` per row and template it holds. A stretch of words that
    holds several templates, as near-equal notices do, counts for the one it holds most of.

    ``containment`` is the largest over the windows and the words (counted from 0 in the text's runs of letters and digits) are of the first window that reaches it;
    ``windows`` counts those that hold the template. Null, empty and unlicensed texts give no row, repeated rows one
    each. Other columns are ignored. The templates are an argument, read once per task.
    """
    shape = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("template", T.IntegerType()),
                          T.StructField("license", T.StringType()), T.StructField("containment", T.DoubleType()),
                          T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
                          T.StructField("windows", T.IntegerType())])
    kinds = [pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int32()]

    def work(batches):
        ready = Templates(templates, containment)
        sizes = [len(own) for own in ready.sets]
        for batch in thrifty(batches):
            best: dict[tuple[int, int], list] = {}
            hits: dict[int, list] = {}
            for row, *hit in ready.scan(batch.column(1)):
                hits.setdefault(row, []).append(tuple(hit))
            for row, own in hits.items():
                for which, share, first, last, _ in told_apart(own, sizes):
                    now = best.setdefault((row, which), [share, first, last, 0])
                    if (-share, first) < (-now[0], now[1]):
                        now[:3] = share, first, last
                    now[3] += 1
            if best:
                rows = [(which, ready.names[which], *v) for (_, which), v in best.items()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([r for r, _ in best])), *map(pa.array, map(list, zip(*rows)), kinds)], names=shape.names)

    return docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(work, shape).withColumnRenamed("id", key)
