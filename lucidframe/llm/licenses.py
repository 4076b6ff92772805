"""Fuzzy search for short licence notices.

A notice occurs where a text is within k edits of it (k grows with its length). Pigeonhole: cut into p pieces (of 8 characters, k + 2 at least), p - k pieces at least occur
exactly, at places that k edits can explain, so an Aho-Corasick automaton of all pieces locates the windows that can hold an occurrence, and the regex library's
bounded-error matching verifies each window and gives span and edits. Windows in which every match would overlap an exact one, which wins, are left out. Letter case counts as equal, and
any white-space character as a space.

Of overlapping matches the one with the fewest edits per character of its notice stays (then the longer, then the earlier, then the notice that the catalogue names first).

Result: a row a match: doc_id, license, notice, start, end (characters, end exclusive), errors, matched.

Defined results: null and empty texts have no matches; texts count whole; rows that repeat have their matches repeated; a null id is kept;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lucidframe.llm.common import c, ensure_workers

PIECE = 8  # characters of a seed
EDITS_PER = 14  # one edit for so many characters of a notice, two at most a word of it
_CC = {"CC-BY": "BY", "CC-BY-SA": "BY-SA", "CC-BY-ND": "BY-ND", "CC-BY-NC": "BY-NC", "CC-BY-NC-SA": "BY-NC-SA", "CC-BY-NC-ND": "BY-NC-ND"}
_CC_LONG = {"CC-BY": "Attribution", "CC-BY-SA": "Attribution-ShareAlike", "CC-BY-ND": "Attribution-NoDerivatives", "CC-BY-NC": "Attribution-NonCommercial", "CC-BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "CC-BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_PUBLISHED = "as published by the Free Software Foundation"
NOTICES: list[tuple[str, str]] = [  # by SPDX identifier, or by family where the notice leaves the version open
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification"),
    ("BSD", "Released under the BSD License"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it"),
    ("LGPL-2.1", "licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "Released under CC0 1.0 Universal"),
    ("SPDX", "SPDX-License-Identifier:"),
    *[(f"{name}-{v}", f"Licensed under CC {short} {v}") for name, short in _CC.items() for v in ("4.0", "3.0")],
    *[(f"{name}-{v}", f"licensed under a Creative Commons {long} {v} {port} License") for name, long in _CC_LONG.items() for v, port in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"))],
    ("CC0-1.0", "waived all copyright and related or neighboring rights to this work"),
    ("AFL-3.0", "Licensed under the Academic Free License version 3.0"),
    ("AGPL-3.0-or-later", f"GNU Affero General Public License {_PUBLISHED}, either version 3 of the License"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("APSL-2.0", "subject to the Apple Public Source License Version 2.0"),
    ("Artistic-2.0", "under the terms of the Artistic License 2.0"),
    ("Beerware", "As long as you retain this notice you can do whatever you want with this stuff"),
    ("BlueOak-1.0.0", "Licensed under the Blue Oak Model License 1.0.0"),
    ("BSD-2-Clause", "licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("BSD-3-Clause", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("BUSL-1.1", "Licensed under the Business Source License 1.1"),
    ("CDDL-1.0", "subject to the terms of the Common Development and Distribution License, Version 1.0"),
    ("CDDL", "subject to the terms of the Common Development and Distribution License (the"),
    ("CECILL", "This software is governed by the CeCILL license under French law"),
    ("CPL-1.0", "made available under the terms of the Common Public License v1.0"),
    ("ECL-2.0", "Licensed under the Educational Community License, Version 2.0"),
    ("EFL-2.0", "licensed under the Eiffel Forum License, version 2"),
    ("Elastic-2.0", "Licensed under the Elastic License 2.0"),
    ("EPL-1.0", "made available under the terms of the Eclipse Public License v1.0"),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("EUPL-1.1", "Licensed under the EUPL, Version 1.1"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2"),
    ("FSFAP", "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty"),
    ("FTL", "Portions of this software are copyright by The FreeType Project"),
    ("GFDL-1.2", "under the terms of the GNU Free Documentation License, Version 1.2"),
    ("GFDL-1.3", "under the terms of the GNU Free Documentation License, Version 1.3"),
    ("GPL-2.0-only", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("GPL-2.0-or-later", f"GNU General Public License {_PUBLISHED}; either version 2 of the License"),
    ("GPL-3.0-or-later", f"GNU General Public License {_PUBLISHED}, either version 3 of the License"),
    ("GPL", "You should have received a copy of the GNU General Public License along with this program"),
    ("HPND", "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("IJG", "This software is based in part on the work of the Independent JPEG Group"),
    ("IPL-1.0", "made available under the terms of the IBM Public License v1.0"),
    ("LGPL-2.0-or-later", f"GNU Library General Public License {_PUBLISHED}; either version 2 of the License"),
    ("LGPL-2.1-or-later", f"GNU Lesser General Public License {_PUBLISHED}; either version 2.1 of the License"),
    ("LGPL-3.0-or-later", f"GNU Lesser General Public License {_PUBLISHED}, either version 3 of the License"),
    ("Libpng", "The PNG Reference Library is supplied \"AS IS\""),
    ("LPPL-1.3c", "may be distributed and/or modified under the conditions of the LaTeX Project Public License, either version 1.3c"),
    ("MIT-0", "licensed under the MIT No Attribution License"),
    ("MPL-1.0", "The contents of this file are subject to the Mozilla Public License Version 1.0"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("MS-PL", "licensed under the Microsoft Public License (Ms-PL)"),
    ("MS-RL", "licensed under the Microsoft Reciprocal License (Ms-RL)"),
    ("MulanPSL-2.0", "licensed under Mulan PSL v2"),
    ("NCSA", "licensed under the University of Illinois/NCSA Open Source License"),
    ("NPL-1.1", "subject to the Netscape Public License Version 1.1"),
    ("ODbL-1.0", "made available under the Open Database License"),
    ("ODC-By-1.0", "made available under the Open Data Commons Attribution License"),
    ("PDDL-1.0", "made available under the Public Domain Dedication and License v1.0"),
    ("OFL-1.1", "licensed under the SIL Open Font License, Version 1.1"),
    ("OGL-UK-3.0", "licensed under the Open Government Licence v3.0"),
    ("OpenSSL", "This product includes software developed by the OpenSSL Project"),
    ("OSL-3.0", "Licensed under the Open Software License version 3.0"),
    ("PHP-3.01", "This source file is subject to version 3.01 of the PHP license"),
    ("PostgreSQL", "for any purpose, without fee, and without a written agreement is hereby granted"),
    ("PSF-2.0", "licensed under the Python Software Foundation License Version 2"),
    ("QPL-1.0", "under the terms of the Q Public License as defined by Trolltech"),
    ("RPL-1.5", "licensed under the Reciprocal Public License 1.5"),
    ("Ruby", "You can redistribute it and/or modify it under either the terms of the 2-clause BSDL"),
    ("SGI-B-2.0", "licensed under the SGI Free Software License B, Version 2.0"),
    ("SSPL-1.0", "under the terms of the Server Side Public License, version 1"),
    ("UPL-1.0", "Licensed under the Universal Permissive License v 1.0"),
    ("Unicode-3.0", "licensed under the Unicode License V3"),
    ("Vim", "There are no restrictions on distributing unmodified copies of Vim"),
    ("W3C", "licensed under the W3C Software Notice and License"),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("ZPL-2.1", "subject to the provisions of the Zope Public License, Version 2.1"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty"),
    ("0BSD", "licensed under the Zero-Clause BSD license"),
    ("PublicDomain", "This work has been released into the public domain by its author"),
    ("Proprietary", "This file is proprietary and confidential. Unauthorized copying of this file, via any medium is strictly prohibited"),
]


def edits(notice: str) -> int:
    return max(1, len(notice) // EDITS_PER)


def fold(text: str) -> str:
    """Lower case and plain spaces, character by character."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := ch.lower()) == 1 else ch for ch in text)
    return re.sub(r"\s", " ", low)


def split(notice: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces with their offsets."""
    n = len(notice)
    cuts = [i * n // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def without_overlaps(found: list[tuple[float, int, int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, errors) of the matches that stay, in their order; found: edits a character, -length, start, notice, end, errors."""
    kept: list[tuple[int, int, int, int]] = []
    starts: list[int] = []
    for _, _, start, i, end, e in sorted(found):
        at = bisect.bisect_left(starts, start)
        if (at == 0 or kept[at - 1][2] <= start) and (at == len(starts) or end <= starts[at]):
            starts.insert(at, start)
            kept.insert(at, (i, start, end, e))
    return kept


class Scanner:
    def __init__(self, notices: list[tuple[str, str]]):
        self.notices = [(name, text, fold(text)) for name, text in notices]
        self.k = [edits(t) for _, _, t in self.notices]
        self.pieces = [max(k + 2, len(t) // PIECE) for (_, _, t), k in zip(self.notices, self.k)]
        seeds: dict[str, list[tuple[int, int, int]]] = {}
        for i, (_, _, t) in enumerate(self.notices):
            if len(t) < self.pieces[i]:
                raise ValueError(f"notice too short: {t!r}")
            for n, (at, piece) in enumerate(split(t, self.pieces[i] - 1)):
                seeds.setdefault(piece, []).append((i, at, n))
            seeds.setdefault(t, []).append((i, 0, -1))  # all of it
        self.automaton = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(f"(?e)(?:{regex.escape(t)}){{e<={k}}}") for (_, _, t), k in zip(self.notices, self.k)]

    def scan(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, errors) of the matches that stay."""
        low = fold(text)
        found: list[tuple[float, int, int, int, int, int]] = []
        seen: dict[int, list[tuple[int, int]]] = {}  # where an occurrence would begin, and the piece that says so
        for last, (n, where) in self.automaton.iter(low):
            for i, at, piece in where:
                if piece < 0:
                    found.append((0.0, -n, last + 1 - n, i, last + 1, 0))
                else:
                    seen.setdefault(i, []).append((last + 1 - n - at, piece))
        exact = without_overlaps(found)
        starts = [s for _, s, _, _ in exact]
        for i, places in seen.items():
            k, size = self.k[i], len(self.notices[i][2])
            need = self.pieces[i] - k
            if len(places) < need:
                continue
            places.sort()
            merged: list[list[int]] = []
            held: dict[int, int] = {}
            m = 0
            for j, (start, piece) in enumerate(places):
                while m < len(places) and places[m][0] <= start + k:
                    held[places[m][1]] = held.get(places[m][1], 0) + 1
                    m += 1
                enough = len(held) >= need  # different pieces, at most k apart
                held[piece] -= 1
                if not held[piece]:
                    del held[piece]
                if enough:
                    a, b = max(0, start - k), min(len(low), start + 2 * k + size)
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
            for a, b in merged:
                at = bisect.bisect_left(starts, a)
                if at < len(exact) and exact[at][1] - a < size - k and b - exact[at][2] < size - k:
                    continue
                for m in self.patterns[i].finditer(low, a, b):
                    e = sum(m.fuzzy_counts)
                    found.append((e / len(self.notices[i][2]), -(m.end() - m.start()), m.start(), i, m.end(), e))
        return without_overlaps(found)


@functools.lru_cache(4)
def scanner(notices: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(list(notices))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", notices: list[tuple[str, str]] | None = None) -> DataFrame:
    ensure_workers(docs.sparkSession)
    chosen = tuple(notices or NOTICES)
    kind = docs.select(c(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(chosen)
        for batch in batches:
            rows: list[int] = []
            hits: list[tuple[int, int, int, int]] = []
            matched: list[str] = []
            for i in range(batch.num_rows):
                t = batch.column(1)[i].as_py()
                for hit in scan.scan(t) if t else ():
                    rows.append(i)
                    hits.append(hit)
                    matched.append(t[hit[1] : hit[2]])
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([chosen[h[0]][0] for h in hits], pa.string()), pa.array([chosen[h[0]][1] for h in hits], pa.string())]
            columns += [pa.array([h[k] for h in hits], pa.int32()) for k in (1, 2, 3)] + [pa.array(matched, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "license", "notice", "start", "end", "errors", "matched"])

    schema = f"doc_id {kind}, license string, notice string, start int, `end` int, errors int, matched string"
    return docs.select(c(id_col).alias("doc_id"), c(text).cast("string").alias("text")).mapInArrow(run, schema)
