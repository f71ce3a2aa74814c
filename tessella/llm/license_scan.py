"""Licence texts in documents: winnowed fingerprints pick candidates, banded alignment measures them.

Templates are word sequences. The hashes of their k-grams of words are winnowed (of each window of w
neighbouring hashes the least, the rightmost of equal ones) into an inverted index. Documents are
winnowed in the same way over their whole length; a stretch of w + k - 1 words that a template has too
always shares a hash. A hit is a place in the document and one in the template; its diagonal is their
difference.

Where a hit's diagonal shows the whole template word for word, that is an occurrence, and its words are
taken. The other hits are gathered, from the lowest diagonal on, into bands of at most ``slack``
diagonals. A band is aligned within ``slack`` diagonals on either side of it, over the stretch of the document
that those diagonals can reach; so both the band and the stretch are bounded by the template's length,
however long the text and however often a phrase recurs in it. A band whose stretch doesn't have enough
of the template's words, in whatever order, isn't aligned. Matches gain two, substitutions and gaps cost
one; of equal scores the one with more matches counts. Of all bands the alignment with the most matched
words is taken, its words leave the others' stretches, and so on until none reaches the least coverage.
Coverage is the share of the template's words that are matched; first and last match give the span.

A match that lies within another one with more matched words (of equally many, the one that begins
earlier, then that whose name sorts first) is left out.

Cases: null and empty texts give no rows. Equal texts and repeated rows give their rows each. A null
key is carried along. Several occurrences of a template are several rows, also where they follow each
other directly. Other columns aren't read.
"""

from __future__ import annotations

import bisect
import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.license_texts import TEMPLATES

WORD = re.compile(r"[^\W_]+")
NONE = np.uint64(2**64 - 1)


def grams(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of word numbers; with a word that no template has (0), the highest value."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, bad = np.zeros(n, np.uint64), np.zeros(n, bool)
    for j in range(k):
        part = ids[j : j + n]
        bad |= part == 0
        h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h[bad | (h == NONE)] = NONE
    return h


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions that winnowing selects; shorter sequences are one window."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, min(w, len(hashes)))
    at = view.shape[1] - 1 - view[:, ::-1].argmin(axis=1) + np.arange(len(view))
    at = np.unique(at)
    return at[hashes[at] != NONE]


#: A cell's value is its score times this, plus its matches: a higher score wins, then more matches.
UNIT = 1 << 20


def align(doc: np.ndarray, template: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(matched words, first, last word of doc) of the best local alignment whose diagonals lie in low..high.

    A row of cells is a word of the template, a cell a diagonal; gaps along the row come from a running
    maximum. A cell remembers where its alignment's first and last match are.
    """
    width, n = high - low + 1, len(doc)
    at = np.arange(width)
    slope = at * UNIT
    padded = np.full(width + 1 + len(template), -1, np.int64)
    begin, end = max(0, low), min(n, high + len(template))
    padded[begin - low : end - low] = doc[begin:end]
    inside = np.zeros(len(padded), bool)
    inside[begin - low : end - low] = True
    value, first, last = np.zeros(width + 1, np.int64), np.zeros(width + 1, np.int64), np.zeros(width + 1, np.int64)
    best = (0, 0, 0)
    for j, word in enumerate(template.tolist()):
        here = low + j + at
        same = padded[j : j + width] == word
        diagonal = value[:width] + np.where(same, 2 * UNIT + 1, -UNIT)
        begins = np.where(same & (value[:width] == 0), here, first[:width])
        ends = np.where(same, here, last[:width])
        up = value[1:] - UNIT  # the template's word is left out; past the band there is nothing to come from
        better = up > diagonal
        base = np.where(better, up, diagonal)
        begins, ends = np.where(better, first[1:], begins), np.where(better, last[1:], ends)
        base = np.where(inside[j : j + width], np.maximum(base, 0), 0)
        # A gap in the template: the best of the cells before, less one a step.
        run = np.maximum.accumulate(base + slope)
        source = np.maximum.accumulate(np.where(base + slope == run, at, 0))
        row = np.where(inside[j : j + width], np.maximum(run - slope, 0), 0)
        value, first, last = np.append(row, 0), np.append(begins[source], 0), np.append(ends[source], 0)
        top = int(row.argmax())
        if row[top] > best[0]:
            best = int(row[top]), int(first[top]), int(last[top])
    return best[0] % UNIT, best[1], best[2]


class Scanner:
    def __init__(self, templates: dict[str, str], k: int, w: int, least: float):
        self.k, self.w, self.least = k, w, least
        self.words: dict[str, int] = {}
        self.templates, self.bags = {}, {}
        self.index: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for name, text in templates.items():
            ids = np.array([self.words.setdefault(x, len(self.words) + 1) for x in WORD.findall(text.lower())], np.int64)
            if len(ids) < k:
                raise ValueError(f"template {name} has less than {k} words")
            self.templates[name] = ids
            self.bags[name] = np.unique(ids, return_counts=True)
            h = grams(ids, k)
            for p in winnow(h, w).tolist():
                self.index[int(h[p])].append((name, p))
        self.hashes = np.array(sorted(self.index), np.uint64)

    def exact(self, ids: np.ndarray, t: np.ndarray, hits: np.ndarray) -> list[tuple[int, int, int]]:
        """The places where the whole template stands, from left to right without overlaps."""
        out, free = [], 0
        for d in np.unique(hits[:, 0] - hits[:, 1]).tolist():
            if d >= free and d + len(t) <= len(ids) and ids[d] == t[0] and np.array_equal(ids[d : d + len(t)], t):
                free = d + len(t)
                out.append((len(t), d, free - 1))
        return out

    def occurrences(self, ids: np.ndarray, name: str, hits: np.ndarray) -> list[tuple[int, int, int]]:
        """(matched words, first, last word) of a template's occurrences, from its hits (place, place in the template)."""
        t = self.templates[name]
        out = self.exact(ids, t, hits)
        if out:
            begin, end = np.array([m[1] for m in out]), np.array([m[2] for m in out])
            before = np.searchsorted(begin, hits[:, 0], "right") - 1
            hits = hits[(before < 0) | (hits[:, 0] > end[before])]
        if not len(hits):
            return out
        taken = sorted((a, b) for _, a, b in out)
        slack, need = min(4 + len(t) // 5, len(t) - 1), math.ceil(self.least * len(t) - 1e-9)
        diagonals = np.unique(hits[:, 0] - hits[:, 1])
        waiting: list[tuple[int, int, int, int, int]] = []  # (-matched, first, last, low, high)

        def measure(low: int, high: int) -> None:
            """The best alignment of a band in each stretch that nobody has taken."""
            reach, stop = max(0, low), min(len(ids), high + len(t))
            i = bisect.bisect_left(taken, (reach, -1))
            if i and taken[i - 1][1] >= reach:
                reach = taken[i - 1][1] + 1
            while reach < stop:
                end = min(stop, taken[i][0]) if i < len(taken) else stop
                if end - reach >= need and self.enough(ids[reach:end], name, need):
                    matched, a, b = align(ids[reach:end], t, low - reach, high - reach)
                    if matched >= need:
                        heapq.heappush(waiting, (-matched, reach + a, reach + b, low, high))
                reach = taken[i][1] + 1 if i < len(taken) else stop
                i += 1

        at = 0
        while at < len(diagonals):
            to = int(np.searchsorted(diagonals, diagonals[at] + slack, "right"))
            measure(int(diagonals[at]) - slack, int(diagonals[to - 1]) + slack)
            at = to
        while waiting:
            matched, a, b, low, high = heapq.heappop(waiting)
            i = bisect.bisect_left(taken, (a, -1))
            if (i < len(taken) and taken[i][0] <= b) or (i and taken[i - 1][1] >= a):
                continue  # someone took some of its words since; what is left was measured then
            out.append((-matched, a, b))
            taken.insert(i, (a, b))
            crossed = {(low, high)} | {w[3:] for w in waiting if w[1] <= b and w[2] >= a}
            for band in crossed:
                measure(*band)
        return list(dict.fromkeys(out))

    def enough(self, words: np.ndarray, name: str, need: int) -> bool:
        """Whether a stretch has so many of the template's words, whatever their order."""
        own, counts = self.bags[name]
        at = np.minimum(np.searchsorted(own, words), len(own) - 1)
        have = np.bincount(at[own[at] == words], minlength=len(own))
        return np.minimum(have, counts).sum() >= need

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched words, first, end) of each match; places are characters of text."""
        get = self.words.get
        ids = np.array([get(x, 0) for x in WORD.findall(text.lower())], np.int64)
        h = grams(ids, self.k)
        if not len(h) or (h == NONE).all():
            return []
        at = winnow(h, self.w)
        at = at[np.isin(h[at], self.hashes)]
        if not len(at):
            return []
        spots = list(WORD.finditer(text))
        if len(spots) != len(ids):  # lower case may have other letters; then places refer to words that are lowered one by one
            ids = np.array([get(m[0].lower(), 0) for m in spots], np.int64)
            at = winnow(h := grams(ids, self.k), self.w)
            at = at[np.isin(h[at], self.hashes)]
        hits = defaultdict(list)
        for p in at.tolist():
            for name, q in self.index[int(h[p])]:
                hits[name].append((p, q))
        found = []
        for name, own in hits.items():
            size = len(self.templates[name])
            found += [(name, matched / size, matched, a, b) for matched, a, b in self.occurrences(ids, name, np.array(own, np.int64))]
        return [(n, c, k, spots[a].start(), spots[b].end()) for n, c, k, a, b in outermost(found)]


def outermost(found: list[tuple]) -> list[tuple]:
    """Matches (name, coverage, matched, first, last) without those within one that ranks before, in order of place."""
    found.sort(key=lambda m: (-m[2], m[3], m[0]))
    firsts, lasts, kept = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64), []
    for m in found:
        n = len(kept)
        if not ((firsts[:n] <= m[3]) & (lasts[:n] >= m[4])).any():
            firsts[n], lasts[n] = m[3], m[4]
            kept.append(m)
    return sorted(kept, key=lambda m: (m[3], m[0]))


@lru_cache(maxsize=4)
def _scanner(templates: tuple[tuple[str, str], ...], k: int, w: int, least: float) -> Scanner:
    return Scanner(dict(templates), k, w, least)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, k: int = 3, w: int = 3, least_coverage: float = 0.8) -> DataFrame:
    """One row a match: id_col, license, coverage, matched_words, span_start, span_end (characters), span."""
    frozen = tuple(sorted((templates or TEMPLATES).items()))
    kind = df.schema[id_col].dataType.simpleString()
    names = ["key", "license", "coverage", "matched_words", "span_start", "span_end", "span"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(frozen, k, w, least_coverage)
        for batch in batches:
            rows = [(n, *m, t[m[3] : m[4]]) for n, t in enumerate(batch.column(1).to_pylist()) if t for m in scanner.scan(t)]
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0])), *[pa.array(c, x) for c, x in zip(cols[1:], kinds, strict=True)]], names)

    found = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("t")).mapInArrow(run, f"key {kind}, license string, coverage double, matched_words long, span_start long, span_end long, span string")
    return found.withColumnRenamed("key", id_col)
