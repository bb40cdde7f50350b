"""Packing documents into token sequences: linear grouping of large lengths, configurations of few sizes, then best fit of small ones.

What is packed are counts of lengths, of which there are no more than a sequence has tokens, so the driver's part doesn't grow
with the table; documents then find their place by their number among those of equal length.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import saved, small, text_batches

#: Where the public vocabulary lies by default; a parameter everywhere. The id behind each document.
VOCABULARY, END = "/opt/tokenizers/byte_bpe_50k.json", 0
#: Tokens of a sequence, numbers of groups of large lengths that are tried, and the length up to which a piece is small.
SEQUENCE, GROUPS, SMALL = 2048, (256, 512, 1024, 2048), 256
#: Words that a worker remembers, and characters of a word from which the library itself encodes it.
KNOWN_WORDS, LONG_WORD = 600_000, 500

_GAP, _ODD_GAP = re.compile(r" (?=\S)"), re.compile(r" (?!\S)")


class Ids(dict):
    """Token ids as little-endian bytes, remembered by word.

    The byte-level pre-tokenizer starts a part at every space before a character that is no space, so the stretches between
    such spaces encode on their own. A stretch that follows a space is remembered without it, the text's first one behind a NUL.
    Merges in the file are in the order of the ids they make (checked), so ids are ranks. Texts with a NUL or an added
    token's string, and very long words, go to the library as they are.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges, pre = spec["model"]["vocab"], spec["model"]["merges"], spec["pre_tokenizer"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or made != sorted(set(made)):
            raise ValueError("only byte-level BPE vocabularies without normaliser or added space are supported")
        self.whole = Tokenizer.from_file(path)
        added = [t["content"] for t in spec["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        # The file writes bytes as characters: printable ones of Latin-1 as they are, the others from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte[c] for c in word): i for word, i in vocab.items() if word not in added}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.parts = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        text = word[1:] if word[:1] == "\0" else f" {word}"
        ids = self.parts(text) if len(text) < LONG_WORD else self.whole.encode(text, add_special_tokens=False).ids
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(text) < LONG_WORD:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        if "\0" in text or self.added and self.added.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = _GAP.split(text) if _ODD_GAP.search(text) else text.split(" ")
        words[0] = f"\0{words[0]}"
        return b"".join(map(self.__getitem__, words))


_KNOWN: dict[str, Ids] = {}
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])


def _cut(path: str, size: int):
    """Documents into pieces, each with its task's number (part) and how many pieces of its length that task had before (nth)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _KNOWN:
            _KNOWN[path] = Ids(path)
        ids = _KNOWN[path]
        seen, part, end = np.zeros(size + 1, np.int64).tolist(), TaskContext.get().partitionId(), struct.pack("<I", END)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                data = memoryview(ids.encode(text.as_py() or "") + end)
                n = len(data) // 4
                start = 0
                for piece, stop in enumerate(range((n - 1) % size + 1, n + 1, size)):
                    length = stop - start
                    rows.append((doc_id, piece, start, length, zlib.crc32(data[4 * start : 4 * stop]), part, seen[length]))
                    seen[length] += 1
                    start = stop
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _PIECES)] if rows else [pa.nulls(0, f.type) for f in _PIECES], schema=_PIECES)

    return task


class Plan:
    """Places for pieces, from how many there are of each length.

    A run is a number of sequences in a row that are filled alike. `places` rows (length, first, sequence, per, offset)
    say: pieces of this length from number `first` on go, `per` to a sequence, one behind the other, into the sequences
    from `sequence` on, at `offset`. There are at most some ten rows for each run and length, whatever the counts.
    """

    def __init__(self, counts: dict[int, int], size: int = SEQUENCE, groups: int = GROUPS[0], small: int = SMALL) -> None:
        self.size, self.sequences, self.places = size, 0, []
        self.room: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by tokens left: (first sequence, how many)
        self.open = 0  # bits of the lengths in `room` that aren't empty
        self._large({n: c for n, c in counts.items() if n > small and c}, groups)
        for length in sorted((n for n, c in counts.items() if n <= small and c), reverse=True):
            self._small(length, counts[length])
        self.places.sort()

    def _leave(self, left: int, sequence: int, count: int) -> None:
        if left:
            self.room[left].append((sequence, count))
            self.open |= 1 << left

    def _large(self, counts: dict[int, int], groups: int) -> None:
        """Round each of the equal groups up to its largest length, fill sequences by configurations of these few sizes, and put the groups' own pieces there."""
        each = -(-sum(counts.values()) // groups)
        sizes: dict[int, list[list[int]]] = {}  # rounded length -> stretches [length, first, count]
        left, rounded = 0, 0
        for length in sorted(counts, reverse=True):
            first = 0
            while first < counts[length]:
                if not left:
                    left, rounded = each, length
                n = min(left, counts[length] - first)
                sizes.setdefault(rounded, []).append([length, first, n])
                first, left = first + n, left - n
        for config, times in configurations({s: sum(x[2] for x in parts) for s, parts in sizes.items()}, self.size):
            self._fill({s: self._take(sizes[s], a * times) for s, a in config.items()}, config, times)

    @staticmethod
    def _take(parts: list[list[int]], n: int) -> list[tuple[int, int, int]]:
        out = []
        while n:
            length, first, count = parts[0]
            k = min(n, count)
            out.append((length, first, k))
            parts[0] = [length, first + k, count - k]
            if k == count:
                parts.pop(0)
            n -= k
        return out

    def _fill(self, taken: dict[int, list[tuple[int, int, int]]], config: dict[int, int], times: int) -> None:
        """`times` sequences of one configuration, cut into runs within which actual lengths stay the same."""
        cuts = {0, times}
        for s, parts in taken.items():
            at = 0
            for _, _, n in parts:
                at += n
                cuts |= {at // config[s], -(-at // config[s])}
        edges = sorted(cuts)
        for low, high in zip(edges, edges[1:]):
            used = 0
            for s, a in config.items():
                for length, first, n in self._take(self._queue(taken, s), (high - low) * a):
                    per = a if high - low > 1 else n
                    self.places.append((length, first, self.sequences + low, per, used))
                    used += per * length
            self._leave(self.size - used, self.sequences + low, high - low)
        self.sequences += times

    @staticmethod
    def _queue(taken: dict[int, list], s: int) -> list[list[int]]:
        if taken[s] and isinstance(taken[s][0], tuple):
            taken[s] = [list(x) for x in taken[s]]
        return taken[s]

    def _small(self, length: int, count: int) -> None:
        """Best fit: into the sequences with the least room that suffices, as many as each takes, then into new ones."""
        first = 0
        while first < count:
            fits = self.open >> length
            if fits:
                left = length + (fits & -fits).bit_length() - 1
                sequence, n = self.room[left].pop()
                if not self.room[left]:
                    self.open ^= 1 << left
            else:
                left, sequence, n = self.size, self.sequences, max(1, (count - first) // (self.size // length))
                self.sequences += n
            per = min(left // length, count - first)
            k = min(n, (count - first) // per)
            self.places.append((length, first, sequence, per, self.size - left))
            if n > k:
                self._leave(left, sequence + k, n - k)
            self._leave(left - per * length, sequence, k)
            first += k * per


def configurations(counts: dict[int, int], size: int) -> Iterator[tuple[dict[int, int], int]]:
    """Fillings of a sequence by few sizes, with how often to use each, until all are gone.

    The largest size left goes first and the rest of the sequence is filled as far as any choice of the sizes left can,
    large ones rather than small (a subset sum over bit sets); then as often as the counts allow. Each configuration uses up a size or
    leaves fewer of it than a sequence holds, so there are at most some ten for each size.
    """
    left = dict(sorted(counts.items()))
    while left:
        top = max(left)
        left[top] -= 1
        room = size - top
        mask = (1 << room + 1) - 1
        sums, order = [1], [s for s in left if s <= room and left[s]]
        for s in order:  # ascending
            now = sums[-1]
            for _ in range(min(left[s], room // s)):
                now |= now << s & mask
            sums.append(now)
        best, config = sums[-1].bit_length() - 1, {top: 1}
        for k in range(len(order) - 1, -1, -1):
            s = order[k]
            for n in range(min(left[s], best // s), -1, -1):
                if sums[k] >> best - n * s & 1:
                    break
            if n:
                config[s] = config.get(s, 0) + n
                best -= n * s
        left[top] += 1
        times = min(left[s] // n for s, n in config.items())
        yield config, times
        for s, n in config.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]


def _place(plan: Plan):
    """Give each piece (length, number) its sequence and offset."""
    table = np.array(plan.places, np.int64).reshape(-1, 5)
    keys, (length, first, sequence, per, offset) = table[:, 0] << 44 | table[:, 1], table.T
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(keys, n << 44 | number, side="right") - 1
            q = number - first[at]
            places = sequence[at] + q // per[at], offset[at] + q % per[at] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:5]), *map(pa.array, places)], names)

    return task


def packed(documents: DataFrame, size: int = SEQUENCE, groups: tuple[int, ...] = GROUPS, small_length: int = SMALL, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A document is its ids and one END behind them; one of more than `size` ids is cut into pieces of `size`, of which the
    first may be shorter. A null or empty text is one piece of length 1. Rows that repeat an id, or have none, are
    documents of their own. An empty table gives no rows. Other columns are not read.

    Pieces are saved without texts, with their number among those of their length in their task; one row a task and
    length gives their number in all. So a length that a third of all pieces have needs no task of its own, and nothing
    is sorted. The driver gets the count of each length, `size` rows at most, and takes the number of groups that
    needs the fewest sequences.
    """
    docs = text_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = saved(docs.mapInArrow(_cut(vocabulary, size), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"))
    each = saved(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = small(saved(each.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))))
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = min((Plan(counts, size, g, small_length) for g in groups), key=lambda p: p.sequences)
    numbered = pieces.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("number"))
    return numbered.mapInArrow(_place(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
