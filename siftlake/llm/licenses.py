"""License scans: a fuzzy search for short notices.

A notice may differ by `edits` inserted, deleted or replaced characters.  It is
split into edits + 1 pieces; a match with no more edits holds one piece exactly
(pigeonhole), so the pieces are the seeds of one automaton over all notices.
Around each seed, in a window that the notice and its edits can fill, the regex
library's bounded-error matching verifies the notice and gives its span, which
begins and ends at the edge of a word; white space in the text matches as one
space.  Exact phrases are found among the text's words (as hashes, then compared).

Labels are distinct and sorted.  The score is the share of a notice's letters
that its best match keeps, over all labels; 1 for an exact phrase, 0 for none.
Null and empty texts have no words, no labels, null positions and score 0.  Bytes
that are no UTF-8 count as letters of words and as the replacement character.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from siftlake.llm.shared import annotate
from siftlake.llm.text import ALNUM, LOWER, Words, combine, utf8

#: Exact phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short notices, their labels; matched with edits.
NOTICES = {
    "licensed under the apache license, version 2.0": "apache-2.0",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "released under the mit license": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
}

_FOLD = bytes(LOWER.tolist())
#: What words consist of, in lower-cased text.
LETTER = "[0-9a-z\\x80-\\U0010FFFF]"


def edits_of(notice: str) -> int:
    """One edit for every twelve characters."""
    return max(1, len(notice) // 12)


def pieces(notice: str, count: int) -> list[tuple[int, str]]:
    """(offset, piece): `count` pieces of almost equal length."""
    cut = [len(notice) * i // count for i in range(count + 1)]
    return [(a, notice[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Scanner:
    def __init__(self, base: dict[str, str], notices: dict[str, str]):
        import ahocorasick

        self.notices = [(n, label, edits_of(n)) for n, label in notices.items()]
        self.patterns = [regex.compile(f"(?be)(?<!{LETTER})(?:{regex.escape(n, literal_spaces=True)}){{e<={k}}}(?!{LETTER})") for n, _, k in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (n, _, k) in enumerate(self.notices):
            for offset, piece in pieces(n, k + 1):
                seeds.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()
        self.base = []
        for phrase, label in base.items():
            words = phrase.encode().split()
            data = b" ".join(words)
            h = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ALNUM).hashes()
            self.base.append((words, label, combine(h, len(words))[0]))

    def fuzzy(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, first, last, edits): matches in the text, lower-cased and with white space as single spaces; best ones first to claim a place."""
        hits: dict[int, list[int]] = {}
        for end, (size, uses) in self.automaton.iter(text):
            for i, offset in uses:
                hits.setdefault(i, []).append(end + 1 - size - offset)
        found = []
        for i, starts in hits.items():
            n, _, k = self.notices[i]
            done = -len(n) - k - 1  # below every seed: letters lost before one put its start before the text
            for at in sorted(set(starts)):
                lo, hi = max(0, at - k), min(len(text), at + len(n) + k + 1)  # one more shows whether a word goes on
                if at <= done:
                    continue
                m = self.patterns[i].search(text, lo, hi)
                if m:
                    found.append((i, m.start(), m.end(), sum(m.fuzzy_counts)))
                    done = m.end() - len(n) // 2
        return found


@lru_cache(maxsize=2)
def _scanner(base: tuple, notices: tuple) -> Scanner:
    return Scanner(dict(base), dict(notices))


_SPACE = regex.compile(r"\s+")


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """(row, n_words, n_base, first_word, last_word, base_labels, labels, score, spans); spans: (label, first, last, edits) by characters of the normalised text."""
    key = tuple(base.items()), tuple(notices.items())

    def run(column):
        scanner = _scanner(*key)
        buf, offsets = utf8(column)
        words = Words(buf, offsets, ALNUM)
        h, doc = words.hashes(), words.document()
        n = len(column)
        count, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
        base_labels: list[set[str]] = [set() for _ in range(n)]
        for phrase, label, value in scanner.base:
            size = len(phrase)
            at = np.flatnonzero(combine(h, size) == value)
            at = at[doc[at] == doc[at + size - 1]] if len(at) else at
            at = at[[all(buf[words.start[i + j] : words.end[i + j]].tobytes().translate(_FOLD) == phrase[j] for j in range(size)) for i in at.tolist()]] if len(at) else at
            d = doc[at]
            place = at - words.first[d]
            np.add.at(count, d, 1)
            np.minimum.at(first, d, place)
            np.maximum.at(last, d, place)
            for i in np.unique(d).tolist():
                base_labels[i].add(label)
        labels, score, spans = [], [], []
        for i in range(n):
            raw = buf[offsets[i] : offsets[i + 1]].tobytes().translate(_FOLD).decode("utf-8", "replace")
            found = scanner.fuzzy(_SPACE.sub(" ", raw))
            labels.append(",".join(sorted(base_labels[i] | {scanner.notices[f[0]][1] for f in found})))
            score.append(max([1.0 if base_labels[i] else 0.0, *(1 - f[3] / len(scanner.notices[f[0]][0]) for f in found)]))
            spans.append([{"label": scanner.notices[f[0]][1], "first": f[1], "last": f[2], "edits": f[3]} for f in found])
        none = count == 0
        span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("edits", pa.int32())]))
        return [pa.array(words.count, pa.int64()), pa.array(count), pa.array(first, pa.int64(), mask=none), pa.array(last, pa.int64(), mask=none), pa.array([",".join(sorted(x)) for x in base_labels], pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(spans, span)]

    return annotate(docs, text, run, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string;first:int;last:int;edits:int>>".replace(";", "\x1f"), keep)
