"""Operator 9: license notices by conditional compression, confirmed by wording.

A candidate block, the words around a match of CANDIDATE across line ends, is compressed
alone and with each template as zstandard raw dictionary. Templates are ranked by the
share of their own bytes that they save, and in that order compared word by word with
the block: the first whose exact wording differences are few enough is the notice.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import mapped

#: Usual wordings of license notices by SPDX id.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Proprietary", "All rights reserved."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "Licensed under GPLv2."),
    ("GPL-3.0", "Licensed under GPLv3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
)
#: SPDX ids that may follow "SPDX-License-Identifier:", and addresses of licences.
IDENTIFIERS = ("AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense")
ADDRESSES = (
    ("Apache-2.0", "www.apache.org/licenses/LICENSE-2.0"),
    ("CC-BY-4.0", "creativecommons.org/licenses/by/4.0"),
    ("CC-BY-NC-4.0", "creativecommons.org/licenses/by-nc/4.0"),
    ("CC-BY-SA-4.0", "creativecommons.org/licenses/by-sa/4.0"),
    ("CC0-1.0", "creativecommons.org/publicdomain/zero/1.0"),
    ("MIT", "opensource.org/licenses/MIT"),
)
#: Titles, which are notices only word for word and where they fill their lines.
TITLES = (
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("ISC", "ISC License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
)
TEMPLATES += (*((name, f"SPDX-License-Identifier: {name}") for name in IDENTIFIERS), *ADDRESSES)
CANDIDATE = re.compile(r"licen[cs]|copyright|creative[\W_]*commons|\bcc[\W_]?(?:by|0)\b|public[\W_]+domain|permission[\W_]+is[\W_]+hereby|redistribut|all[\W_]+rights[\W_]+reserved|gpl|unencumbered|eclipse|permission[\W_]+to[\W_]+use", re.IGNORECASE)
#: A text without any of these has no match of CANDIDATE; the two letters match i there but don't fold to it.
HINTS, OTHER_I = ("licen", "copyright", "commons", "cc", "domain", "permission", "redistribut", "rights", "gpl", "unencumbered", "eclipse"), ("\u0130", "\u0131")
LEAST_SAVED = 0.2  # of the bytes that a template saves for itself: below that share it isn't compared by wording
MAX_DIFFERENT = 0.15  # share of the template's words that may differ
SHORT_DIFFERENT = 3  # a quarter of a short template's words may differ, at most so many and one at least
LEVEL = 3  # of compression
SHORT = 16  # words of a template whose core words are all required
#: Words that tell licenses apart: required where a template has them, never added where it has not. So are version numbers.
TELLING = frozenset("mit apache bsd clause gnu gpl lgpl agpl lesser affero library mozilla mpl eclipse epl isc unlicense gplv1 gplv2 gplv3 cc cc0 by zero nc sa nd noncommercial commercial sharealike noderivatives noderivs not no non".split())
#: Words without which a short template says something else.
CORE = frozenset("license general public creative commons attribution domain spdx identifier all rights reserved".split())
#: Words that deny a notice which begins up to NEGATION_REACH words later in the same clause.
NEGATIONS = frozenset("not no never neither nor without cannot isn aren wasn weren don".split())
NEGATION_REACH = 3
_CLAUSE_END = re.compile(r"[.!?;:]")
_WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")
_VERSION = re.compile(r"v?([0-9]{1,2}(?:\.[0-9]+)*?)(?:\.0)*")


def _word(found: str) -> str:
    """A word as it is compared: folded, license spelt with s, a version without v and final .0."""
    word = found.casefold().replace("licenc", "licens")
    version = _VERSION.fullmatch(word)
    return version[1] if version else word


def _words(text: str) -> list[str]:
    return [_word(w) for w in _WORD.findall(text)]


def allowed(n: int) -> int:
    """Words that may differ from a template of n words."""
    return max(1, min((n + 1) // 4, SHORT_DIFFERENT), int(MAX_DIFFERENT * n))


class Wording:
    """A template's words, those that a notice must have and how many may differ."""

    def __init__(self, text: str):
        self.words = _words(text)
        self.most = allowed(len(self.words))
        self.known = frozenset(self.words)
        self.versioned = any(_VERSION.fullmatch(w) for w in self.words)
        kept = TELLING | CORE if len(self.words) <= SHORT else TELLING
        self.required = frozenset(w for w in self.words if w in kept or _VERSION.fullmatch(w))
        self.first = frozenset(self.words[: self.most + 1])

    def foreign(self, word: str) -> bool:
        return word not in self.known and (word in TELLING or word in NEGATIONS or self.versioned and bool(_VERSION.fullmatch(word)))

    def places(self, block: list[str]) -> list[tuple[int, int, int]]:
        """(from, to, words different) of each stretch of the block that words the template, one for each start.

        A stretch shares words with the template in order (a longest common subsequence);
        different are those of the longer one that aren't shared, so a changed word counts once.
        """
        size, most = len(self.words), self.most
        if not self.required.issubset(block):
            return []
        known = list(itertools.accumulate((w in self.known for w in block), initial=0))
        out = []
        for start, word in enumerate(block):
            end = min(len(block), start + size + most)
            if word not in self.first or known[end] - known[start] < size - most or not self.required.issubset(block[start:end]):
                continue
            row, best = [0] * (size + 1), None
            for at in range(start, end):
                if self.foreign(block[at]):
                    break
                before, row = row, [0]
                for i, w in enumerate(self.words):
                    row.append(before[i] + 1 if w == block[at] else max(before[i + 1], row[i]))
                different = max(size, at + 1 - start) - row[size]
                if row[size] > before[size] and different <= most and (best is None or different < best[2]) and self.required.issubset(block[start : at + 1]):
                    best = (start, at + 1, different)
            if best:
                out.append(best)
        return out


class Templates:
    """Wordings with their compressors; titles come last."""

    def __init__(self, templates: tuple[tuple[str, str], ...], titles: tuple[tuple[str, str], ...]):
        every = (*templates, *titles)
        self.names, self.texts = [n for n, _ in every], [t.casefold().encode() for _, t in every]
        self.wordings = [Wording(t) for _, t in every]
        self.titles_from = len(templates)
        self.reach = max(len(w.words) + w.most for w in self.wordings)
        self._alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self._given = []
        for t in self.texts:
            known = zstandard.ZstdCompressionDict(t, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self._given.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False))
        self.own = [max(1, self.saved(t, i)) for i, t in enumerate(self.texts)]

    def saved(self, block: bytes, i: int) -> int:
        """Bytes that template i saves in compressing the block."""
        return len(self._alone.compress(block)) - len(self._given[i].compress(block))

    def ranked(self, block: str) -> list[int]:
        """The templates that save enough in the block, the largest share of their own bytes first."""
        raw = block.casefold().encode(errors="replace")
        alone = len(self._alone.compress(raw))
        share = [(alone - len(c.compress(raw))) / own for c, own in zip(self._given, self.own, strict=True)]
        return sorted((i for i, x in enumerate(share) if x >= LEAST_SAVED), key=lambda i: (-share[i], i))


@functools.cache
def _of(templates: tuple[tuple[str, str], ...], titles: tuple[tuple[str, str], ...]) -> Templates:
    return Templates(templates, titles)


class _Text:
    """A text's words, and which of them notices have."""

    def __init__(self, text: str):
        self.text, self.found = text, list(_WORD.finditer(text))
        self.starts, self.words = [m.start() for m in self.found], [_word(m[0]) for m in self.found]
        self.taken = bytearray(len(self.words))

    def denied(self, first: int) -> bool:
        for i in range(first - 1, max(-1, first - 1 - NEGATION_REACH), -1):
            if _CLAUSE_END.search(self.text, self.found[i].end(), self.starts[i + 1]):
                return False
            if self.words[i] in NEGATIONS:
                return True
        return False

    def passage(self, a: int, b: int) -> str:
        return self.text[self.starts[a] : self.found[b - 1].end()]

    def fills_lines(self, a: int, b: int) -> bool:
        low = self.text.rfind("\n", 0, self.starts[a]) + 1
        high = self.text.find("\n", self.found[b - 1].end())
        return not _WORD.search(self.text, low, self.starts[a]) and not _WORD.search(self.text, self.found[b - 1].end(), len(self.text) if high < 0 else high)


def notice_at(t: _Text, at: int, given: Templates, order: Callable[[str], Iterable[int]]) -> tuple[int, int, int, int] | None:
    """(from, to, template, words different) of the notice that has the word ``at``: of the templates in order the first that its block words."""
    low, high = max(0, at - given.reach), min(len(t.words), at + given.reach + 1)
    block = t.words[low:high]
    for i in order(t.passage(low, high)):
        fits = [
            (different, low + a, low + b)
            for a, b, different in given.wordings[i].places(block)
            if low + a <= at < low + b and not any(t.taken[low + a : low + b]) and not t.denied(low + a) and (i < given.titles_from or not different and t.fills_lines(low + a, low + b))
        ]
        if fits:
            different, a, b = min(fits)
            return a, b, i, different
    return None


def notices(text: str, templates: tuple[tuple[str, str], ...] = TEMPLATES, titles: tuple[tuple[str, str], ...] = TITLES) -> tuple[int, list[tuple[str, int, int]]]:
    """Lines with a match of CANDIDATE, and (SPDX id, bytes saved, words different) of each notice in order."""
    low = text.casefold()
    if not any(h in low for h in HINTS) and not any(c in text for c in OTHER_I):
        return 0, []
    at = [m.start() for m in CANDIDATE.finditer(text)]
    if not at:
        return 0, []
    t, given = _Text(text), _of(templates, titles)
    n_lines, line_end, out = 0, -1, []
    for place in at:
        if place > line_end:
            n_lines += 1
            line_end = text.find("\n", place)
            line_end = len(text) if line_end < 0 else line_end
        word = max(0, bisect.bisect_right(t.starts, place) - 1)
        found = None if t.taken[word] else notice_at(t, word, given, given.ranked)
        if found:
            a, b, i, different = found
            t.taken[a:b] = b"\1" * (b - a)
            out.append((a, (given.names[i], given.saved(t.passage(a, b).casefold().encode(errors="replace"), i), different)))
    return n_lines, [notice for _, notice in sorted(out)]


def scan_licenses(docs: DataFrame, *, key: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Per row of docs: doc_id, n_blocks, n_confirmed, license, licenses, n_different, saved.

    ``n_blocks`` counts the lines in which a candidate starts, ``n_confirmed`` the notices,
    of which a line may hold several. ``license`` is of the notice with the fewest
    differences, then most bytes saved, then earliest; null without one. ``licenses``
    lists the distinct ids in order.
    Null and empty texts have no blocks, an empty table gives no rows, repeated rows stay. One
    narrow pass; templates have a fixed size. A text of any length is read whole: beside its words
    each candidate takes the compression of one block of some hundred bytes by every template.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1).to_pylist():
                n_lines, found = notices(value, templates) if value else (0, [])
                best = min(found, key=lambda f: (f[2], -f[1]), default=(None, None, None))
                out.append((n_lines, len(found), best[0], ",".join(sorted({f[0] for f in found})), best[2], best[1]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_blocks", "n_confirmed", "license", "licenses", "n_different", "saved"])

    return mapped(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")), run, "doc_id bigint, n_blocks bigint, n_confirmed bigint, license string, licenses string, n_different bigint, saved bigint")
