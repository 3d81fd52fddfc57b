"""License scans by conditional compression.

Candidate blocks are windows of words around each of the TRIGGERS, to either side as many as the longest template may
take with max_differing of its words added; line breaks and comment marks are no words. Templates of whose words more
than max_differing are not in the block are out; the others are ranked by how much smaller they make the block, which
is compressed on its own, and once with each template as zstandard's raw dictionary. In this order they are then held
against the block word by word (lower case, punctuation left out), and the one with the fewest differing words wins, if
these are at most max_differing of the template's words; of equal ones the one with the larger reduction, then the first
of the templates. Behind the best `tries`, templates that lack as many words in the block as the best so far differs in
are passed over, as they can't win. The differences are returned as they stand: "-word" for one that the block lacks,
"+word" for one that it has beside the template.

A notice is found wherever its template's words stand, so words before and after aren't differences. Its words are then
taken, and the rest of the window is judged again, so every notice comes back that doesn't overlap a better one. One
row comes back for each: line is that of its first word, block its lines as they stand (of lines that go on for more
than a window before or after it, only that much), reduction that of the block. Texts without a notice, null and empty
texts have no row. Repeated rows have their rows repeated, null ids stay null. Whole texts are read. Other
columns, of whatever name, are left out; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import in_arrow, slices

TRIGGERS = re.compile(r"licen[cs]e|copyright|permission|warrant|public domain|redistribut", re.IGNORECASE)
_RUN = re.compile(r"[A-Za-z0-9.\-]+")

#: The wording of common notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
}


def placed_words(text: str) -> tuple[list[str], list[int]]:
    """Words in lower case, and where each starts."""
    words, starts = [], []
    for run in _RUN.finditer(text):
        if word := run[0].strip(".-"):
            words.append(word.lower())
            starts.append(run.start() + run[0].index(word))
    return words, starts


def words_of(text: str) -> list[str]:
    return placed_words(text)[0]


def aligned(template: list[str], block: list[str]) -> tuple[list[str], int, int]:
    """The fewest differences between the template and any part of the block, and where that part starts and ends."""
    n = len(block)
    rows = [[0] * (n + 1)]
    for i, w in enumerate(template, 1):
        above, row = rows[-1], [i]
        for j in range(n):
            row.append(above[j] if block[j] == w else min(above[j + 1], row[j]) + 1)
        rows.append(row)
    end = j = min(range(n + 1), key=rows[-1].__getitem__)
    i, out = len(template), []
    while i:
        if j and block[j - 1] == template[i - 1]:
            i, j = i - 1, j - 1
        elif rows[i][j] == rows[i - 1][j] + 1:
            i -= 1
            out.append(f"-{template[i]}")
        else:
            j -= 1
            out.append(f"+{block[j]}")
    return out[::-1], j, end


class Scanner:
    def __init__(self, templates: dict[str, str], level: int, tries: int, max_differing: float):
        import zstandard

        self.names, self.words = list(templates), [words_of(t) for t in templates.values()]
        self.bags = [Counter(w) for w in self.words]
        plain = {"level": level, "write_content_size": False, "write_checksum": False}
        self.alone = zstandard.ZstdCompressor(**plain).compress
        self.given = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **plain).compress for t in templates.values()]
        self.tries, self.max_differing = tries, max_differing
        self.reach = math.ceil((1 + max_differing) * max(map(len, self.words), default=0))

    def gain(self, i: int, block: str) -> float:
        raw = block.lower().encode()
        return 1 - len(self.given[i](raw)) / len(self.alone(raw))

    def _best(self, words: list[str], block: str) -> tuple[int, list[str], int, int] | None:
        """Number of the winner, its differences, and the first and last of the words that it covers."""
        bag, best = Counter(words), None
        lacking = [(own - bag).total() for own in self.bags]
        likely = [i for i, n in enumerate(lacking) if n <= self.max_differing * len(self.words[i])]
        for k, (_, i) in enumerate(sorted(((self.gain(i, block), -i) for i in likely), reverse=True)):
            if k >= self.tries and best and lacking[-i] >= len(best[1]):
                continue
            differing, start, end = aligned(self.words[-i], words)
            if start < end and len(differing) <= self.max_differing * len(self.words[-i]) and (best is None or len(differing) < len(best[1])):
                best = -i, differing, start, end
        return best

    def judge(self, block: str) -> tuple[str, float, list[str]] | None:
        """License, size reduction and differences of the winner."""
        found = self._best(words_of(block), block)
        return found and (self.names[found[0]], self.gain(found[0], block), found[1])

    def notices(self, text: str) -> list[tuple[int, str, str, float, list[str]]]:
        """line, block, license, size reduction and differences of each notice, from the first to the last."""
        words, starts = placed_words(text)
        ends = [a + len(w) for a, w in zip(starts, words, strict=True)]
        breaks = [m.start() for m in re.finditer("\n", text)]
        taken, out = bytearray(len(words)), []
        for t in sorted({max(bisect_right(starts, m.start()) - 1, 0) for m in TRIGGERS.finditer(text)} if words else ()):
            while not taken[t]:
                lo = max(t - self.reach, taken.rfind(1, 0, t) + 1)
                hi = taken.find(1, t, t + self.reach + 1)
                hi = min(t + self.reach + 1, len(words)) if hi < 0 else hi
                found = self._best(words[lo:hi], text[starts[lo] : ends[hi - 1]])
                if not found:
                    break
                i, differing, a, b = found[0], found[1], lo + found[2], lo + found[3]
                taken[a:b] = b"\1" * (b - a)
                first, last = bisect_right(breaks, starts[a]), bisect_right(breaks, starts[b - 1])
                left = breaks[first - 1] + 1 if first else 0
                right = breaks[last] if last < len(breaks) else len(text)
                if a > self.reach:
                    left = max(left, starts[a - self.reach])
                if b + self.reach < len(words):
                    right = min(right, ends[b + self.reach])
                block = text[left:right]
                out.append((a, (first, block, self.names[i], self.gain(i, block), differing)))
        return [x for _, x in sorted(out, key=lambda x: x[0])]


def scan(documents: DataFrame, templates: dict[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text", level: int = 19, tries: int = 3, max_differing: float = 0.25) -> DataFrame:
    """id_col, line (from 0), block, license, reduction, n_differing, differences."""
    templates = TEMPLATES if templates is None else templates
    kind = documents.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, level, tries, max_differing)
        for batch in slices(batches):
            rows: dict[str, list] = {k: [] for k in ("row", "line", "block", "license", "reduction", "n_differing", "differences")}
            for i, text in enumerate(batch.column("text").to_pylist()):
                if not text or not TRIGGERS.search(text):
                    continue
                for *found, differing in scanner.notices(text):
                    for name, value in zip(rows, (i, *found, len(differing), differing), strict=True):
                        rows[name].append(value)
            ids = batch.column("id").take(pa.array(rows.pop("row"), pa.int64()))
            types = [pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, t) for v, t in zip(rows.values(), types, strict=True))], names=["id", *rows])

    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = in_arrow(texts, find, f"id {kind}, line int, block string, license string, reduction double, n_differing int, differences array<string>")
    return found.withColumnRenamed("id", id_col)
