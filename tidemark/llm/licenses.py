"""License scans by patience alignment of template and text."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.codes import text_bytes, word_bounds
from tidemark.llm.decontaminate import normal_words, shingles
from tidemark.llm.tasks import of_batches

#: Share of a template's words, in hundredths, that must be aligned.
COVERAGE = 80
#: A region begins where so many words of a template stand in a row, not all of them from COMMON.
SEED = 2
# Words of ordinary prose.
COMMON = "a all any and are as at be by for from if in is it may not of on one or that the this to under was which with you".split()

# Names and public texts of license notices.
TEMPLATES: dict[str, tuple[str, str]] = {
    "mit-notice": ("MIT", "Released under the MIT License."),
    "mit-grant": ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    "apache-notice": ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    "apache-header": ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    "gpl-notice": ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    "gpl-header": ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "cc-by-nc-notice": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    "cc-by-notice": ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    "bsd-grant": ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    "isc-grant": ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "gpl-2-notice": ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    "gpl-2-header": ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "lgpl-2-header": ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    "lgpl-header": ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "agpl-header": ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "mpl-header": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    "cc-by-sa-notice": ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    "cc-by-nd-notice": ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    "cc-by-nc-sa-notice": ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    "cc-by-nc-nd-notice": ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    "bsl-grant": ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    "0bsd-grant": ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    "unlicense-notice": ("Unlicense", "This is free and unencumbered software released into the public domain."),
    "zlib-grant": ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
}

# The names and versions that tell licenses apart; each must stand whole in the matched words.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License",), "Apache-2.0": ("Apache License", "2.0"), "MPL-2.0": ("Mozilla Public License", "2.0"),
    "GPL-3.0": ("GNU General Public License", "3"), "GPL-2.0": ("GNU General Public License", "2"), "AGPL-3.0": ("GNU Affero General Public License", "3"),
    "LGPL-2.1": ("GNU Lesser General Public License", "2.1"), "LGPL-3.0": ("GNU Lesser General Public License", "3"),
    "CC-BY-4.0": ("CC BY 4.0",), "CC-BY-NC-4.0": ("CC BY-NC 4.0",), "CC-BY-SA-4.0": ("CC BY-SA 4.0",), "CC-BY-ND-4.0": ("CC BY-ND 4.0",),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",), "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0",),
}


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by piles as in patience sorting."""
    tops: list[int] = []
    top_at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        back.append(top_at[p - 1] if p else -1)
        tops[p : p + 1] = [v]
        top_at[p : p + 1] = [i]
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def longest_common(text: list, template: list) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence; words of the text that the template lacks are passed over."""
    there = set(template)
    places = [i for i, w in enumerate(text) if w in there]
    best = [[0] * (len(template) + 1) for _ in range(len(places) + 1)]
    for r in range(len(places) - 1, -1, -1):
        for j in range(len(template) - 1, -1, -1):
            best[r][j] = best[r + 1][j + 1] + 1 if text[places[r]] == template[j] else max(best[r + 1][j], best[r][j + 1])
    out, r, j = [], 0, 0
    while r < len(places) and j < len(template):
        if text[places[r]] == template[j]:
            out.append((places[r], j))
            r, j = r + 1, j + 1
        elif best[r + 1][j] >= best[r][j + 1]:
            r += 1
        else:
            j += 1
    return out


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Pairs (place in text, place in template) of equal words, rising in both.

    Words unique to both sides anchor the alignment along their longest increasing subsequence; equal words next to an
    anchor or an end are matched outwards; the gaps between are aligned in the same way. In a gap without a common unique
    word, a longest common subsequence is taken.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(text[a:b], a) if here[w] == 1}
        common = [(place[w], j) for j, w in enumerate(template[c:d], c) if there[w] == 1 and w in place]
        anchors = [common[i] for i in increasing([i for i, _ in common])]
        if not anchors:
            out += [(a + i, c + j) for i, j in longest_common(text[a:b], template[c:d])]
            continue
        out += anchors
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def _regions(hits: np.ndarray, size: int, n: int) -> list[tuple[int, int]]:
    """Stretches around the hits, a template long on either side; overlapping ones are one."""
    out: list[tuple[int, int]] = []
    for h in hits.tolist():
        a, b = max(0, h - size), min(n, h + size + SEED)
        if out and a <= out[-1][1] and h - out[-1][2] <= size:
            out[-1] = (out[-1][0], b, h)
        else:
            out.append((a, b, h))
    return [(a, b) for a, b, _ in out]


@dataclass
class Template:
    words: np.ndarray
    seeds: np.ndarray
    names: list[list[int]]  # runs of words that must stand in the text

    def best(self, words: np.ndarray, pairs: np.ndarray) -> tuple[int, int, int] | None:
        """(aligned words, first, last) of the best match in a stretch of text."""
        hits = np.flatnonzero(np.isin(pairs, self.seeds))
        found = None
        for a, b in _regions(hits, len(self.words), len(words)) if len(hits) else ():
            text = words[a:b].tolist()
            matched = align(text, self.words.tolist())
            if not matched or len(matched) * 100 < COVERAGE * len(self.words):
                continue
            places = [i for i, _ in matched]
            for k in range(len(places) - 2, -1, -1):  # equal words nearer to the next aligned one
                places[k] = next(i for i in range(places[k + 1] - 1, places[k] - 1, -1) if text[i] == text[places[k]])
            span = text[places[0] : places[-1] + 1]
            if all(any(span[i : i + len(n)] == n for i in range(len(span) - len(n) + 1)) for n in self.names) and (found is None or len(matched) > found[0]):
                found = len(matched), a + places[0], a + places[-1]
        return found


def scan(words: np.ndarray, templates: dict[str, Template], pairs: np.ndarray) -> list[tuple[str, int, int, int]]:
    """(template, first word, words, coverage in thousandths) of the matches of one text, none of which overlap.

    The match with the most aligned words is taken first, then the text before and after it is searched again.
    """
    out, todo = [], [(0, len(words), list(templates))]
    while todo:
        a, b, names = todo.pop()
        found = {t: templates[t].best(words[a:b], pairs[a : max(a, b - SEED + 1)]) for t in names}
        found = {t: m for t, m in found.items() if m}
        if not found:
            continue
        name = max(found, key=lambda t: (found[t][0], found[t][0] / len(templates[t].words)))
        n, first, last = found[name]
        out.append((name, a + first, last - first + 1, n * 1000 // len(templates[name].words)))
        todo += [(a, a + first, list(templates)), (a + last + 1, b, list(templates))]
    return sorted(out, key=lambda m: m[1])


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, with one for all spellings of a version: 2, 2.0, v2, v2.0."""
    words = normal_words(data, starts, ends)
    for k in np.flatnonzero(np.isin(words, _VERSIONS[:, 0])):
        words[k] = _VERSIONS[np.flatnonzero(_VERSIONS[:, 0] == words[k])[0], 1]
    return words


def _hashed(text: str, of=_words) -> np.ndarray:
    data, offsets = text_bytes(pa.array([text], pa.string()))
    starts, ends, _ = word_bounds(data, offsets)
    return of(data, starts, ends)


_VERSIONS = np.array([_hashed(f"{form} {n}", normal_words) for n in range(1, 6) for form in (f"v{n}", f"{n}.0", f"v{n}.0")])


def prepared(templates: dict[str, tuple[str, str]]) -> dict[str, Template]:
    common, out = _hashed(" ".join(COMMON)), {}
    for key, (name, text) in templates.items():
        words = _hashed(text)
        plain = np.isin(words, common)
        seeds = shingles(words, SEED)
        # all words in a row are common: no seed, unless the template has no other
        rare = ~np.logical_and.reduce([plain[j : len(words) - SEED + 1 + j] for j in range(SEED)]) if len(words) >= SEED else np.ones(len(seeds), bool)
        names = [_hashed(n).tolist() for n in NAMES.get(name, ()) if n.lower() in text.lower()]  # a grant names no license
        out[key] = Template(words, np.unique(seeds[rare] if rare.any() else seeds), names)
    return out


def _scan(templates: dict[str, tuple[str, str]]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = prepared(templates)
        every = np.unique(np.concatenate([t.seeds for t in known.values()]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data, offsets = text_bytes(part.column(1))
                starts, ends, first = word_bounds(data, offsets)
                words = _words(data, starts, ends)
                pairs = shingles(words, SEED) if len(words) >= SEED else words[:0]
                hit = every[np.minimum(np.searchsorted(every, pairs), len(every) - 1)] == pairs
                count = np.concatenate(([0], np.cumsum(hit), [hit.sum()]))
                rows = []
                for doc, a, b in zip(part.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    end = max(a, b - SEED + 1)
                    if count[end] > count[a]:
                        rows += [(doc, templates[t][0], t, *m) for t, *m in scan(words[a:b], known, pairs[a:end])]
                columns = zip(*rows, strict=True) if rows else [()] * 6
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "license", "template", "start_word", "n_words", "coverage"])

    return find


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, license, template, start_word, n_words, coverage (thousandths): every match that a template covers by COVERAGE or more.

    The whole text is scanned; words are compared without case and without punctuation after them. A region is looked at
    where SEED words of a template stand in a row, not all of them common. A match holds the license's NAMES. Of overlapping
    matches the one with the most words is reported; the text around it is searched again, so copies are reported each. Null and
    blank texts match nothing; repeated rows are reported each; a null doc_id stays null; an empty table gives no row.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(of_batches(_scan(templates or TEMPLATES)), "doc_id long, license string, template string, start_word long, n_words long, coverage long")
