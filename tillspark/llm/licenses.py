"""Licence notices by conditional compression against known templates.

A text's candidate blocks are the characters around licence words, over line
ends. The words of a block are cut into overlapping windows; each window is
compressed alone and with every template as a raw zstandard dictionary, and
the templates are ranked by the bytes they save for each of their own bytes.
Only the winners of that ranking are compared word by word; a winner that
says the same but for few words is a notice. The words before and after it are
ranked again, so that notices beside each other are all found. A short
template is ranked in short windows, since in a long one the code lengths of
the other words hide what it saves.

Defined results: a null or empty text has no blocks and the empty list; of
equal stretches the longest template counts, then the least name; repeated rows are scanned
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import quoted, text_map

#: Short notices as they are commonly written, with their SPDX identifiers. The
#: rights notice has none, so its name is one of SPDX's own kind for others.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License."),
    "MIT": (
        "Released under the MIT License.",
        "Distributed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files"),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted"),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free "
        "Software Foundation, either version 3 of the License"),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License"),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License",),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.",),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, "
                "v. 2.0.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms "
                "of the Eclipse Public License 2.0",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0-1.0": ("Released into the public domain under CC0 1.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.",),
    "LicenseRef-All-Rights-Reserved": ("All rights reserved.",),
}
#: A tag line for each identifier.
TEMPLATES = {name: (*notices, f"SPDX-License-Identifier: {name}")
             for name, notices in TEMPLATES.items()}

TRIGGER = re.compile(
    r"(?ai:licen[sc]ed?\b|copyright\b|permission\W{1,40}(?:is|to\W{1,40}use)|public\W{1,40}domain|redistribut|spdx|"
    r"free\W{1,40}software|rights\W{1,40}reserved|\bCC0\b)")
#: The rest of a line after a hyphen, with the marks before the next line's text.
_WRAP = r"(?<=-)[^\S\n]*\n[^\w\n]*(?=[A-Za-z0-9])"
_WORD = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9.+-]|{_WRAP})*")
#: More words than a piece can have.
_MANY = 1 << 20


#: Lower levels search less and miss matches near the end of a window.
LEVEL = 12
#: Words of the shortest window; longer ones are four times as long each.
_WINDOW = 32


@dataclass(frozen=True)
class ScanPolicy:
    """``around`` characters at least on either side of a trigger form a block.

    A winner is one of the ``winners`` templates that save most of a window, and
    saves ``least_saving`` bytes at least for each of its own.
    """

    around: int = 240
    winners: int = 4
    least_saving: float = 0.15
    most_differences: float = 0.15


def wording(text: str) -> list[str]:
    return [re.sub(_WRAP, "", w).rstrip(".-").lower() for w in _WORD.findall(text)]


def blocks(text: str, around: int) -> list[tuple[int, int]]:
    """Stretches of ``around`` characters on both sides of the trigger words.

    They run on over line ends, since notices are wrapped; stretches that
    overlap or touch are joined.
    """
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        start, end = max(0, m.start() - around), min(len(text), m.end() + around)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def stretches(block: list[str], template: list[str], most: float) -> list[tuple[int, int, int]]:
    """(words to add, drop or change, first word, end) where the block has the template.

    Edit distance of the whole template to a stretch of the block, one for each
    end with at most ``most`` differences: the nearest, of equal ones the shortest.
    """
    row = [-j for j in range(len(block) + 1)]  # differences * _MANY - first word
    for i, w in enumerate(template, 1):
        last, row[0] = row[0], i * _MANY
        for j, b in enumerate(block, 1):
            last, row[j] = row[j], min(last + (w != b) * _MANY, row[j] + _MANY, row[j - 1] + _MANY)
    found = []
    for end, value in enumerate(row):
        n = -(-value // _MANY)
        if n <= most:
            found.append((n, n * _MANY - value, end))
    return found


class Scanner:
    """Templates with their raw dictionaries, ready for blocks."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES,
                 policy: ScanPolicy = ScanPolicy()):
        self.policy = policy
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.known = []
        #: Templates by the length of the windows in which they are ranked; a
        #: notice with its extra words is at most half as long as the window.
        self.by_window: dict[int, list[int]] = {}
        for name, notices in templates.items():
            for notice in notices:
                words = wording(notice)
                plain = " ".join(words).encode()
                raw = zstandard.ZstdCompressionDict(
                    plain, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                size = _WINDOW
                while 2 * len(words) * (1 + policy.most_differences) > size:
                    size *= 4
                self.by_window.setdefault(size, []).append(len(self.known))
                self.known.append((name, zstandard.ZstdCompressor(level=LEVEL, dict_data=raw),
                                   words, len(plain)))
        longest = max((len(n) for notices in templates.values() for n in notices), default=0)
        #: A notice with comment marks and blanks at its line starts is longer than its template.
        self.around = max(policy.around, 2 * longest)

    def rank(self, words: list[str], among: list[int]) -> list[int]:
        """The templates that save most of these words, best first."""
        data = " ".join(words).encode()
        alone = len(self.plain.compress(data))
        saved = []
        for k in among:
            _, given, _, size = self.known[k]
            share = (alone - len(given.compress(data))) / size
            if share >= self.policy.least_saving:
                saved.append((-share, k))
        return [k for _, k in sorted(saved)[:self.policy.winners]]

    def confirm(self, words: list[str], k: int) -> tuple[int, int, int] | None:
        """(differing words, first word, end) where template ``k`` is nearest, if near enough."""
        template = self.known[k][2]
        near = stretches(words, template, self.policy.most_differences * len(template))
        return min((s for s in near if s[1] < s[2]), default=None)

    def notices(self, words: list[str], among: list[int],
                start: int = 0) -> list[tuple[int, int, str, int, int]]:
        """(differing words, -length, identifier, first word, end) of a window's notices.

        The nearest winner is taken and the words on its two sides are ranked anew.
        """
        if not words:
            return []
        best = None
        for k in self.rank(words, among):
            hit = self.confirm(words, k)
            if hit:
                name, _, template, _ = self.known[k]
                one = (hit[0], -len(template), name, hit[1], hit[2])
                best = min(best or one, one)
        if best is None:
            return []
        n, size, name, a, b = best
        return [(n, size, name, start + a, start + b),
                *self.notices(words[:a], among, start),
                *self.notices(words[b:], among, start + b)]

    def scan(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, identifier, differing words) of each confirmed notice.

        Of notices that overlap the one with the fewest differences counts, then
        the longest template.
        """
        out = []
        for start, end in blocks(text, self.around):
            piece = text[start:end]
            spots = [m.span() for m in _WORD.finditer(piece)]
            words, found = wording(piece), set()
            for size, among in self.by_window.items():
                # Windows overlap by half, so that a notice lies whole in one.
                for at in range(0, max(1, len(words) - size // 2), size // 2):
                    found.update(self.notices(words[at:at + size], among, at))
            taken: list[tuple[int, int, str, int]] = []
            for n, _, name, a, b in sorted(found):
                a, b = start + spots[a][0], start + spots[b - 1][1]
                if all(b <= x or y <= a for x, y, _, _ in taken):
                    taken.append((a, b, name, n))
            out += sorted(taken)
        return out


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
         templates: dict[str, tuple[str, ...]] | None = None,
         policy: ScanPolicy = ScanPolicy()) -> DataFrame:
    """doc_id, n_blocks, n_notices, licenses (sorted, comma-joined), notices.

    ``notices`` lists identifier:start:end:differences of each notice; start and
    end are those of its own words.
    """
    known = dict(templates or TEMPLATES)

    def setup():
        scanner = Scanner(known, policy)

        def compute(texts):
            n_blocks, n_found, names, notices = [], [], [], []
            for t in texts:
                hits = scanner.scan(t or "")
                n_blocks.append(len(blocks(t or "", scanner.around)))
                n_found.append(len(hits))
                names.append(",".join(sorted({h[2] for h in hits})))
                notices.append(",".join(f"{n}:{s}:{e}:{d}" for s, e, n, d in hits))
            return n_blocks, n_found, names, notices
        return compute
    plain = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    return text_map(plain, "text", [("n_blocks", T.LongType()), ("n_notices", T.LongType()),
                                    ("licenses", T.StringType()), ("notices", T.StringType())],
                    setup, ["doc_id"])
