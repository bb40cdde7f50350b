"""Licence scans: normalised text compared to licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches
from .license_texts import TEMPLATES

#: Dice coefficient from which a passage is a licence.
LEAST = 0.8

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?;:])\s+")


def bigrams(text: str) -> Counter:
    """Pairs of neighbouring words of a normalised text (lower case, letters and digits only), with their counts."""
    words = _WORD.findall(text.lower())
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    """Twice the common bigrams over all, counts included; 0 if neither has any."""
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Templates:
    """Licence templates with what prunes them.

    At a coefficient of `least`, a passage of p bigrams and a template of t have p between t * least / (2 - least) and
    t * (2 - least) / least, and at least t * least / (2 - least) common bigrams. So among any t - that many + 1
    bigrams of the template one is in the passage: `signs` maps such bigrams, the rarest, to templates.
    """

    def __init__(self, texts: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> None:
        self.least, self.names = least, [n for n, _ in texts]
        self.grams = [bigrams(t) for _, t in texts]
        self.bounds = [(math.ceil(g.total() * least / (2 - least) - 1e-9), math.floor(g.total() * (2 - least) / least + 1e-9)) for g in self.grams]
        spread = Counter(b for g in self.grams for b in g)
        self.signs: dict[tuple[str, str], set[int]] = {}
        for i, g in enumerate(self.grams):
            ranked = sorted(g.elements(), key=lambda b: (spread[b], -len(b[0]) - len(b[1]), b))
            for b in ranked[: g.total() - self.bounds[i][0] + 1]:
                self.signs.setdefault(b, set()).add(i)
        self.counts: dict[tuple[str, str], list[tuple[int, int]]] = {}  # of each bigram, the templates that have it and how often
        for i, g in enumerate(self.grams):
            for b, n in g.items():
                self.counts.setdefault(b, []).append((i, n))

    def matches(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(licence, coefficient, start, end) of the passages that match, best for each, in order, in code points of `text`.

        A passage is a run of whole sentences or lines. Only those that hold a template's sign are compared, and only
        with templates whose size bounds hold. A run grows by a sentence at a time, and with it the number of bigrams
        that it has in common with each template, so a run costs its last sentence only.
        """
        text = text or ""
        words = _WORD.findall(text.lower())
        if self.signs.keys().isdisjoint(zip(words, words[1:])):
            return []
        units, at = [], 0  # sentences with their places, bigrams across the ends of neighbours counted on joining
        for line in re.split(r"(?<=\n)", text):
            for s in _SENTENCE.split(line):
                start = text.index(s, at) if s else at
                at = start + len(s)
                if w := _WORD.findall(s.lower()):
                    units.append((start, at, w))
        found: list[tuple[str, float, int, int]] = []
        longest = max(hi for _, hi in self.bounds)
        for first in range(len(units)):
            size, before = 0, None
            common, seen = [0] * len(self.names), {}  # bigrams shared with each template; how often the run has a bigram
            signed: set[int] = set()
            for last in range(first, len(units)):
                own = units[last][2]
                size += len(own)
                if size - 1 > longest:
                    break
                for b in zip(own if before is None else [before, *own], own[1:] if before is None else own):
                    if b in self.counts:
                        seen[b] = k = seen.get(b, 0) + 1
                        for i, n in self.counts[b]:
                            common[i] += k <= n
                        signed |= self.signs.get(b, frozenset())
                before = own[-1]
                for i in signed:
                    lo, hi = self.bounds[i]
                    if lo <= size - 1 <= hi and (d := 2 * common[i] / (size - 1 + self.grams[i].total())) >= self.least:
                        found.append((self.names[i], d, units[first][0], units[last][1]))
        out: list[tuple[int, int, str, float]] = []  # apart from each other, in order
        for m in sorted(found, key=lambda m: (-m[1], m[2] - m[3], m[2], m[0])):
            at = bisect(out, (m[2],))
            if (at == 0 or out[at - 1][1] <= m[2]) and (at == len(out) or m[3] <= out[at][0]):
                out.insert(at, (m[2], m[3], m[0], m[1]))
        return [(name, d, start, end) for start, end, name, d in out]


def license_scan(docs: DataFrame, texts: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row per document: doc_id, license (of the best match, null if none), dice (of it, else 0), n_matches, matches.

    `matches` lists licence:start:end, end exclusive, in code points. Whole texts are read; a null or empty one matches
    nothing; ties go to the longer, then the earlier passage. Repeated rows are scanned each; an empty table gives no rows.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Templates(texts, least)
        for b in batches:
            rows = [known.matches(t) for t in b["text"]]
            best = [max(m, key=lambda x: (x[1], x[3] - x[2], -x[2]), default=(None, 0.0)) for m in rows]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "license": [x[0] for x in best], "dice": [x[1] for x in best], "n_matches": [len(m) for m in rows],
                "matches": [",".join(f"{n}:{s}:{e}" for n, _, s, e in m) for m in rows],
            })

    rows = text_batches(docs).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = rows.mapInPandas(scan, "doc_id string, license string, dice double, n_matches long, matches string")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
